"""The registered queries themselves, over whole small tables, against brute force in every column that is fixed."""

import hashlib
import zlib

import pytest
import tiktoken
import public_tokenizers

from glotta.llm import bpe, queries
from tests.llm.test_operators import components, hit_words, prints_of

SF = "/root/testdata/sf0.001"
LONG = "un mot Deux zwei three " * 90_000  # 2 MB


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with the corpus tables and awkward rows: nulls, empties, a very long text, ties, repeats, other columns."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").first()["text"]
    odd = [(9001, None), (9002, ""), (9003, "  "), (9004, LONG), (9005, first), (9006, "one two"), (9007, "été 12 \u3000x")]
    more = spark.createDataFrame([(i, t, "fr", "s", 0) for i, t in odd], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.unionByName(more).repartition(2).write.parquet(f"{folder}/documents.parquet")
    items = spark.createDataFrame([(900, "one two"), (901, None), (902, "...")], "item_id bigint, text string")
    spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(items).write.parquet(f"{folder}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    urls = [(9001, None), (9002, ""), (9003, "no scheme.org/"), (9004, "HTTP://Sub.Example.ORG/en/12?q#f"), (9005, "http://x.com/" + "a" * 200_000), (9006, "a://b.com/de/?x"), (9007, "http://y.com/fr/#z"), (9008, "http://org/")]
    spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame(urls, "page_id bigint, url string")).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="module")
def texts(spark, corpus):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def rest(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def test_op1(spark, corpus, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").select("item_id", "text").collect()]
    want = {(i, n, hit, len(found), sha(",".join(found)), bool(hit and 20 * hit >= n)) for i, (n, hit, found) in hit_words(texts, items).items()}
    rows = queries.op1_decontamination(spark, corpus).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(texts)


def test_op2(spark, corpus, texts):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(queries.RANKS)), special_tokens={})
    want = {(i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")) for i, t in texts.items() for ids in [encoding.encode_ordinary(t or "")]}
    assert {tuple(r) for r in queries.op2_byte_bpe(spark, corpus).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_op3(spark, corpus, texts):
    rows = {r["doc_id"]: r for r in queries.op3_pii(spark, corpus).collect()}
    assert rows.keys() == texts.keys()
    assert all((r["text"] == texts[i]) == (r["n_values"] == 0) for i, r in rows.items())


def test_op4(spark, corpus, texts):
    prints = prints_of(texts)
    ids = list(prints)
    groups = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert {tuple(r) for r in queries.op4_simhash(spark, corpus).select("doc_id", "fingerprint", "component_id").collect()} == {(i, f"{prints[i]:016x}", groups[i]) for i in ids}


def test_op7(spark, corpus):
    rows = queries.op7_url_filter(spark, corpus).collect()
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{corpus}/pages.parquet").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        url = urls[r["page_id"]] or ""
        left = url.partition("://")[2]
        at = min([k for k in map(left.find, "/?#") if k >= 0], default=len(left))
        host, path = left[:at].lower(), left[at:].split("?")[0].split("#")[0]
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0] + best[1])
        assert r["verdict"] == best[2] if best else r["verdict"] == ("block" if r["url_score"] >= 0.5 else "allow")


def test_op8(spark, corpus, texts):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.op8_language(spark, corpus).collect()}
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        assert r["held_out"] == (rest(i, 3) == 1) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in set(langs.values()) if any(c.isalpha() for c in texts[i] or "") else r["lang_pred"] == "und"
    held = [langs[i] == r["lang_pred"] for i, r in rows.items() if r["held_out"] and i < 9000]
    assert sum(held) > 0.95 * len(held)


def test_op10(spark, corpus, texts):
    rows = {r["doc_id"]: r for r in queries.op10_quality(spark, corpus).collect()}
    assert rows.keys() == texts.keys()
    assert all(r["held_out"] == (rest(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in rows.items())
    assert rows[9001]["score"] == rows[9002]["score"]
