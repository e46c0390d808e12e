"""Each operator against a brute-force version, on a small table with every awkward case."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from glotta.llm import bpe, decontaminate, exact, langid, ngrams, pii, quality, queries, repeats, simhash, urls
from glotta.llm.graph import connected_components

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path(queries.RANKS)
COLUMNS = "doc_id bigint, text string, key string, fp string, ids int, score string, n_words string, spans int, items int, component int, n_values string"


def low(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


@pytest.fixture(scope="module")
def texts(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    top = max(rows) + 1
    odd = [None, "", "   ", "ÉTÉ été", "one two", "a" * 5000, "Word word. " * 3000, "x", "\x1c\x85  　", "12 $$ ''s 's 've  \n\n ", "日本語テキスト" * 40]
    rows |= {top + k: x for k, x in enumerate([*odd, rows[1], rows[1] + " tail", "head " + rows[2]])}
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns that clash with the operators' own names."""
    return spark.createDataFrame([(i, t, "k", "f", 1, "s", "n", 2, 3, 4, "v") for i, t in texts.items()], COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def benchmark(spark):
    own = [(900, "one two"), (901, None), (902, "..."), (903, "x"), (903, "x"), (None, "été")]
    return spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame(own, "item_id bigint, text string"))


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hit_words(texts, items, window=13):
    windows = defaultdict(set)
    for item, text in items:
        w = WORDS.findall(low(text or ""))
        for k in [tuple(w)] if 0 < len(w) < window else [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]:
            windows[k].add("" if item is None else str(item))
    out = {}
    for doc_id, text in texts.items():
        w, hit, found = WORDS.findall(low(text or "")), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out[doc_id] = len(w), len(hit), sorted(found)
    return out


@pytest.mark.parametrize("block_words", [1_000_000, 100])
def test_decontamination(docs, texts, benchmark, block_words):
    found = decontaminate.overlaps(docs, benchmark, block_words=block_words)
    got = {r["doc_id"]: (r["n_words"], r["hit"], r["items"]) for r in found.withColumn("hit", decontaminate.n_hit()).collect()}
    want = hit_words(texts, [tuple(r) for r in benchmark.select("item_id", "text").collect()])
    assert got == want
    kept = decontaminate.decontaminate(docs, benchmark, block_words=block_words)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (n, hit, _) in want.items() if not (hit and 20 * hit >= n)}


def test_decontamination_cuts_spans(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"Before, {item.upper()}! After."), (2, "clean"), (3, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(docs, items).collect()} == {1: "Before, ! After.", 2: "clean", 3: None}


def test_bpe(docs, texts):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    encoded = bpe.encode(docs, ranks_path=RANKS, pattern=public_tokenizers.PATTERN)
    got = {r["doc_id"]: (list(r["ids"]), bytes(r["decoded"]), r["key"]) for r in bpe.decode(encoded, ranks_path=RANKS).collect()}
    want = {i: (encoding.encode_ordinary(t or ""), (t or "").encode(), "k") for i, t in texts.items()}
    assert got == want
    both = bpe.encode_and_decode(docs, ranks_path=RANKS, pattern=public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: (list(r["ids"]), bytes(r["decoded"]), r["key"]) for r in both} == want


def test_bpe_merges_alone_and_side_by_side_agree():
    coder = bpe.BytePairCoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    pieces = [b"internationalisation", b"zzzzzzzzzzzzz", "été".encode(), b"ab", bytes(range(40))]
    assert coder.merge_side_by_side(pieces) == [coder.merge_alone(x) for x in pieces]


def test_pii_formats_and_links(spark):
    values = ["4111111111111111", "4111 1111 1111 1111", "Jo.Doe9@mail.example.com", "+1 (212) 555-0198", "10.0.0.255", "2024-02-29", "31.12.1999", "02/28/2023", "0123456789abcdef0123456789abcdef01234567", "AB" * 15 + "C7"]
    stays = ["4111111111111112", "10.0.0.256", "2024-02-30", "word", "1234", "+12"]
    rows = [(k, f"A: {v}, and {v}. {s}") for k, (v, s) in enumerate(zip(values, stays * 2))] + [(90, None), (91, ""), (92, "plain text"), (93, values[0])]
    out = {r["doc_id"]: (r["text"], r["n_values"], r["extra"]) for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("extra", F.lit(1)), key="k").collect()}
    for k, v in enumerate(values):
        text, n, _ = out[k]
        new = re.fullmatch(r"A: (.*), and (.*)\. .*", text)
        assert new[1] == new[2] != v and n == 2 and v not in text
        assert re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", new[1]))) == re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", v))) or k in (4, 8, 9)
        assert text.endswith((stays * 2)[k])
    assert out[90][:2] == (None, 0) and out[91][:2] == ("", 0) and out[92][:2] == ("plain text", 0)
    assert out[93][0] == re.match("A: ([0-9]+)", out[0][0])[1]
    digits = [int(c) for c in out[93][0]][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_pii_permutes(spark):
    """All values of a small format have different pseudonyms of that format."""
    rows = spark.range(1000).select(F.format_string("%03d", "id").alias("v"))
    new = rows.select(pii._permuted(F.col("v"), "k", "x", ["0123456789"]).alias("w")).collect()
    assert {r["w"] for r in new} == {f"{k:03d}" for k in range(1000)}
    days = spark.range(73049).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    moved = days.select(pii._date(F.col("v"), "k").alias("w")).where("w between '1900-01-01' and '2099-12-31'")
    assert moved.distinct().count() == 73049


def prints_of(texts):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        out[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return out


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("block", [1024, 3])
def test_simhash(docs, texts, block):
    prints = prints_of(texts)
    ids = list(prints)
    want = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 3])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, block=block).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("layout", simhash.LAYOUTS[:1] + simhash.LAYOUTS[2:3] + simhash.LAYOUTS[-1:])
def test_every_layout_finds_all_links(spark, layout):
    """Fingerprints with 0 to 3 flipped bits are linked by any partitions and thresholds that sum to what is needed."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 30, dtype=np.int64)
    rows = [int(x) for x in base]
    for x in base:
        for d in (1, 2, 3):
            rows.append(int(x) ^ sum(1 << int(b) for b in rng.choice(63, d, replace=False)))
    nodes = spark.createDataFrame([(x, k) for k, x in enumerate(dict.fromkeys(rows))], "fp bigint, node bigint")
    groups = [list(range(16 * k, 16 * k + 16)) for k in range(4)]
    need = 3 - len(layout) + 1
    thresholds = [0] * (len(layout) - 1) + [need] if need else [0] * len(layout)
    if len(layout) == 2:
        thresholds = [1, 1]
    parts = [simhash.Partition(sum(1 << b for g in p for b in groups[g]), e) for p, e in zip(layout, thresholds)]
    found = simhash.links(nodes, parts).collect()
    own = {r["node"]: r["fp"] for r in nodes.collect()}
    pairs = [(a, b) for a in own for b in own if a < b and ((own[a] ^ own[b]) & (2**64 - 1)).bit_count() <= 3]
    assert components(own, [tuple(r) for r in found]) == components(own, pairs)


def test_threshold_allocation():
    cost, chosen = simhash.allocate([16] * 4, [[100, 200, 300, 400]] * 3 + [[1e9, 2e9, 2e9, 2e9]], 10, 0)
    assert sum(chosen) == 0 and chosen[3] == -1


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}


@pytest.mark.parametrize("options", [{}, {"capacity": 4, "hot_share": 0.01}])
def test_exact(spark, docs, texts, options):
    more = docs.unionByName(spark.createDataFrame([(None, "", *["k", "f", 1, "s", "n", 2, 3, 4, "v"]), (None, "lone", *["k", "f", 1, "s", "n", 2, 3, 4, "v"])], COLUMNS))
    groups = defaultdict(list)
    for i, t in [*texts.items(), (None, ""), (None, "lone")]:
        groups[t or ""].append(i)
    want = set()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want |= {(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids}
    got = exact.exact_duplicates(more, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(texts) + 2
    kept = exact.drop_exact_duplicates(docs, **options)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {max(x for x in ids if x is not None) for t, ids in groups.items() if any(x is not None for x in ids)}


def test_exact_reads_its_directory(docs):
    """A document that the directory sends to another bucket isn't found there."""
    index = exact.build_index(docs, capacity=4)
    assert exact.probe(docs, index).count() == docs.count() and index.directory.select("bucket").distinct().count() > 4
    shifted = index.directory.select("slot", (F.col("bucket") + 1).alias("bucket"), "local_depth")
    assert exact.probe(docs, exact.ExtendibleIndex(index.entries, shifted, index.global_depth, index.n_rows)).count() == 0
    fitting = index.entries.groupBy("bucket").agg(F.countDistinct("key").alias("n")).agg(F.max("n")).first()[0]
    assert fitting <= 4


def test_exact_chains_texts_that_share_a_key(spark, docs, texts, monkeypatch):
    """With one key for all texts, bytes alone tell them apart."""
    whole = exact._keyed
    monkeypatch.setattr(exact, "_keyed", lambda *a: whole(*a).withColumn("key", F.lit(7).cast("bigint")))
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t or ""].append(i)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_duplicates(docs).collect()}
    assert got == {i: (max(ids), len(ids)) for ids in groups.values() for i in ids}


def test_split_buckets(spark):
    keys = spark.createDataFrame([(k << 60,) for k in [0] * 5 + [1] + [2, 2] + [7]], "key bigint")
    found = {(r["level"], r["prefix"]): r["n"] for r in exact.split_buckets(keys, 4, 3).collect()}
    assert sum(found.values()) == 9 and found[4, 0] == 5 and all(n <= 3 for (level, _), n in found.items() if level < 4)


def spans_of(texts, passage, within=False):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    where = defaultdict(set)
    for i, w in words.items():
        for s in range(len(w) - passage + 1):
            where[tuple(w[s : s + passage])].add((i, s) if within else i)
    out = set()
    for i, w in words.items():
        now = []
        for s in range(len(w) - passage + 1):
            if len(where[tuple(w[s : s + passage])]) > 1:
                if now and now[-1][1] >= s:
                    now[-1][1] = s + passage
                else:
                    now.append([s, s + passage])
        out |= {(i, a, b) for a, b in now}
    return out


@pytest.mark.parametrize("passage,seed,within", [(50, 20, False), (8, 3, False), (8, 3, True)])
def test_repeats(docs, texts, passage, seed, within):
    got = repeats.repeated_spans(docs, passage=passage, seed=seed, within_documents=within).collect()
    assert {tuple(r) for r in got} == spans_of(texts, passage, within) and len(got) == len({tuple(r) for r in got})


def test_repeats_do_not_trust_one_hash(docs, texts, monkeypatch):
    """All seeds and first digests collide: the second digest still tells runs and windows apart."""
    whole = repeats.runs

    def colliding(*a):
        seeds, one, two, first, count, windows, windows2 = whole(*a)
        return seeds * np.uint64(0), one * np.uint64(0), two, first, count, windows * np.uint64(0), windows2

    monkeypatch.setattr(repeats, "runs", colliding)
    got = repeats.repeated_spans(docs, passage=50, seed=20).collect()
    assert {tuple(r) for r in got} == spans_of(texts, 50)


def test_repeats_by_document(docs, texts):
    want = defaultdict(list)
    for i, a, b in sorted(spans_of(texts, 50)):
        want[i].append((a, b))
    got = {r["doc_id"]: (r["n_spans"], r["n_repeated"], r["longest"], [tuple(x) for x in r["spans"]]) for r in repeats.repeats_by_document(docs).collect()}
    assert got == {i: (len(x), sum(b - a for a, b in x), max(b - a for a, b in x), x) for i, x in want.items()}


def test_urls(spark):
    cases = {
        "http://EXAMPLE.org/en/12?x#y": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://a.b.example.org/es/": ("a.b.example.org", "/es/", "example.org/es/", "block"),
        "http://notexample.org/es/1": ("notexample.org", "/es/1", "org/", "allow"),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
        "http://x.com/de/a": ("x.com", "/de/a", "com/de/", "block"),
        "http://cheap-pills.example.net/": ("cheap-pills.example.net", "/", None, "block"),
        "http://library.example.net/": ("library.example.net", "/", None, "allow"),
        "http://a.org?q=/": ("a.org", "", None, "allow"),
        "no scheme.org/": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
    }
    pages = spark.createDataFrame([(u, "h", "v") for u in cases], "url string, host string, verdict string")
    model = urls.train()
    for r in urls.judge(pages, queries.URL_RULES, model).collect():
        host, path, rule, verdict = cases[r["url"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict or verdict is None and r["verdict"] in ("allow", "block")
    right = [(model.score(*urls._parts(u)) >= 0.5) == bool(y) for u, y in urls.read_labelled()]
    assert np.mean(right) > 0.97
    assert urls.train([]).score("a", "/") == 0.5
    assert urls.judge(pages.where("false"), queries.URL_RULES, model).count() == 0


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(9001, None, "fr"), (9002, "", None), (9003, "123 ...", None), (9004, "x" * 100_000, None)], "doc_id bigint, text string, lang string")
    every = docs.unionByName(odd)
    model = langid.fit(every, where=F.col("doc_id") % 3 != 1)
    rows = langid.predict(every.withColumn("score", F.lit("clash")), model).collect()
    held = [r["lang"] == r["lang_pred"] for r in rows if r["doc_id"] < 9000 and r["doc_id"] % 3 == 1]
    assert np.mean(held) > 0.95
    assert {r["doc_id"]: r["lang_pred"] for r in rows if 9001 <= r["doc_id"] <= 9003} == dict.fromkeys((9001, 9002, 9003), "und")
    assert all(0 <= r["score"] <= 1 for r in rows)
    empty = langid.fit(every.where("false"))
    assert {r["lang_pred"] for r in langid.predict(docs.limit(3), empty).collect()} == {"und"}


def test_language_filter_has_no_misses():
    """Every n-gram that was put in is found, whatever else shares its slots."""
    model = langid.LanguageFilter(["a", "b"], np.zeros(64, np.uint64))
    grams, _ = langid.ngrams(["bonjour", "été"])
    for at in model.places(grams).T:
        np.bitwise_or.at(model.slots, at, np.uint64(2))
    assert model.counts(["bonjour"])[0].tolist() == [len(langid.ngrams(["bonjour"])[0]), 0, len(langid.ngrams(["bonjour"])[0])]


def test_language_model_prefers_seen_pairs(spark):
    """After a word, the words that followed it in training gain most over their place at a start."""
    train = [(k, t) for k, t in enumerate(["a b a b a c", "b a", "a b c", "c"])]
    words = ["a", "b", "c", "new"]
    # P(text of w) = P(w | end) P(end | w); P(text of a w) = P(a | end) P(w | a) P(end | w)
    tries = [(100 + k, w) for k, w in enumerate(words)] + [(200 + k, f"a {w}") for k, w in enumerate(words)] + [(300, "")]
    docs = spark.createDataFrame(train + tries, "doc_id bigint, text string")
    p = {r["doc_id"]: 10 ** r["score"] for r in ngrams.score_documents(docs, learn=F.col("doc_id") < 100).collect()}
    # the two ratios differ by the same factor P(a | end) for all words: P(w | a) / P(w | end)
    ratio = [p[200 + k] / p[100 + k] for k in range(4)]
    assert 0 < p[300] < 1 and all(x > 0 for x in ratio) and ratio[1] > ratio[0]


def test_language_model_on_nothing(none):
    assert ngrams.score_documents(none, learn=F.lit(True)).count() == 0


def test_quality(spark, docs, none):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(table, labels)
    held = labels.where(queries.id_crc("doc_id", 5) == 0).join(quality.score(table, model), "doc_id").select("quality", "score").collect()
    good, bad = ([r["score"] for r in held if r["quality"] == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    scored = quality.score(docs, model).collect()
    assert all(0 <= r["score"] <= 1 for r in scored) and len(scored) == docs.count()
    assert quality.keep_good(docs, model).columns == docs.columns
    nothing = quality.fit(none, labels.where("false"))
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert np.mean((model.score(x) > 0.5) == y) > 0.9 and (model.pairs[0][:2] == (1, 0))


def test_empty_tables(none, benchmark):
    assert decontaminate.overlaps(none, benchmark).count() == 0
    assert decontaminate.overlaps(none, benchmark.where("false")).count() == 0
    assert bpe.decode(bpe.encode(none, ranks_path=RANKS, pattern=public_tokenizers.PATTERN), ranks_path=RANKS).count() == 0
    assert pii.pseudonymise(none, key="k").count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert exact.exact_duplicates(none).count() == 0
    assert repeats.repeated_spans(none).count() == 0


def test_no_items_hit_nothing(docs, texts, benchmark):
    found = decontaminate.overlaps(docs, benchmark.where("false")).select(decontaminate.n_hit().alias("n")).collect()
    assert len(found) == len(texts) and {r["n"] for r in found} == {0}


def test_missing_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (None, None), (1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (2, "other words here now")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == 6 and {r["component_id"] for r in found if r["doc_id"]} == {1} and {r["component_id"] for r in found if r["doc_id"] is None} == {None}
    assert exact.exact_duplicates(docs).count() == 6
    assert len(ngrams.score_documents(docs, learn=F.lit(True)).collect()) == 6
