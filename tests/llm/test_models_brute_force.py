"""The queries of the URL filter, language identification and quality against plain second writings, over every row."""

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glotta.llm import langid, quality, queries, urls
from tests.llm.test_query_columns import SF, corpus, rest, texts  # noqa: F401

MASK = (1 << 64) - 1


def test_op7_scores_and_verdicts(spark, corpus):  # noqa: F811
    model = urls.train()
    rows = queries.op7_url_filter(spark, corpus).collect()
    for r in rows:
        weights = [model.weights[zlib.crc32(tag + part[i : i + n]) % 65536]
                   for tag, part in ((b"h", b"^" + r["host"].encode() + b"$"), (b"p", b"^" + r["path"].encode() + b"$"))
                   for n in (3, 4, 5) for i in range(len(part) - n + 1)]
        margin = model.bias + math.fsum(weights) / math.sqrt(len(weights)) if weights else model.bias
        score = 1 / (1 + math.exp(-margin))
        assert r["url_score"] == pytest.approx(score, abs=1e-9)
        if r["rule"] is None:
            assert r["verdict"] == ("block" if score >= 0.5 else "allow")
    assert {r["verdict"] for r in rows if r["rule"] is None} == {"allow", "block"}


def test_op7_blocks_unseen_urls():
    rows, found = urls.read_labelled(), Counter()
    for fold in range(5):
        model = urls.train([r for r in rows if zlib.crc32(r[0].encode()) % 5 != fold])
        for url, block in rows:
            if zlib.crc32(url.encode()) % 5 == fold:
                found[block, model.score(*urls._parts(url)) >= 0.5] += 1
    assert found[1, True] >= 0.45 * (found[1, True] + found[1, False])
    assert found[0, True] <= 0.05 * (found[0, True] + found[0, False])


def grams_of(word):
    marked = f"_{word}_".encode()
    return [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]


def words_of(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def plain_filter(docs, least_rate, least_part, slots):
    """Per language the set of slots that its n-grams set; the places of an n-gram; the chance of a false hit."""
    counts = defaultdict(Counter)
    for lang, text in docs:
        for word, n in Counter(words_of(text)).items():
            for g in grams_of(word):
                counts[lang][g] += n
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    rates = defaultdict(dict)
    for lang, c in counts.items():
        for g, n in c.items():
            rates[g][lang] = n / totals[lang]

    def places(g):
        h = int.from_bytes(bytes([len(g)]) + g, "big") * 0x9E3779B97F4A7C15 & MASK
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & MASK
        a, b = h >> 33, h & 0xFFFFFFFF | 1
        return [(a + b * k) % slots for k in range(3)]

    bits = {lang: set() for lang in sorted(totals)}
    for g, by_lang in rates.items():
        for lang, rate in by_lang.items():
            if rate >= least_rate and rate >= least_part * max(by_lang.values()):
                bits[lang].update(places(g))
    return bits, places, {lang: (len(b) / slots) ** 3 for lang, b in bits.items()}


def plain_language(text, bits, places, false):
    counts, total = Counter(), 0
    for word, n in Counter(words_of(text)).items():
        for g in grams_of(word):
            total += n
            at = places(g)
            for lang, own in bits.items():
                counts[lang] += n * own.issuperset(at)
    if not total:
        return "und", 0.0
    shares = {lang: min(max((counts[lang] / total - false[lang]) / (1 - false[lang]), 0), 1) for lang in bits}
    best = max(shares, key=shares.get)
    return best, 1 / sum(math.exp(30 * (s - shares[best])) for s in shares.values())


def test_op8_every_row(spark, corpus, texts):  # noqa: F811
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}
    learned = [(langs[i], t) for i, t in texts.items() if rest(i, 3) != 1 and langs[i] is not None]
    plain = plain_filter(learned, 2e-5, 0.05, 1 << 20)
    rows = {r["doc_id"]: r for r in queries.op8_language(spark, corpus).collect()}
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        lang, score = plain_language(texts[i], *plain)
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-9)


def test_every_ngram_is_in_the_filter_without_least_rates(spark, corpus, texts):  # noqa: F811
    docs = spark.read.parquet(f"{corpus}/documents.parquet").select("lang", "text")
    bits, _, _ = plain_filter([tuple(r) for r in docs.collect() if r["lang"] is not None], 0, 0, 5003)
    model = langid.fit(docs, least_rate=0, least_part=0, slots=5003)
    assert model.languages == sorted(bits)
    assert [set(np.nonzero(model._bit(model.slots, k))[0].tolist()) for k in range(len(bits))] == list(bits.values())


def test_slots_follow_the_ngrams_within_bounds():
    assert [langid.slots_for(k) for k in (0, 10, 52_428, 52_429, 10**9)] == [1 << 20, 1 << 20, 1 << 20, 1 << 21, 1 << 24]


def plain_features(text):
    data = (text or "").encode()
    words, share = data.split(), lambda chars: sum(data.count(bytes([c])) for c in chars) / len(data)
    if not words:
        return [0.0, np.log1p(len(data)), *[0.0] * 17]
    n, counts, lines = len(words), Counter(words), [x for x in data.split(b"\n") if x.strip()]
    return [
        np.log1p(n), np.log1p(len(data)), len(data) / n,
        *map(share, (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~<>{}[]\\=+_", b"!?", b"|", b".,;:", range(128, 256), b" \t\r\n\x0b\x0c")),
        len(counts) / n, counts.most_common(1)[0][1] / n, sum(words[k] == words[k - 1] for k in range(1, n)) / n,
        np.log1p(max(len(w) for w in words)), n / len(lines), len(set(lines)) / len(lines),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), sum(b"A" <= w[:1] <= b"Z" for w in words) / n,
    ]


def test_op10_every_row(spark, corpus, texts):  # noqa: F811
    docs, labels = (spark.read.parquet(f"{corpus}/{x}.parquet") for x in ("documents", "labels"))
    model = quality.fit(docs, labels, held_out_of=5)
    assert len(model.pairs) == 8 and sum(np.ptp(t) > 0 for t in model.tables) > 1
    rows = {r["doc_id"]: r for r in queries.op10_quality(spark, corpus).collect()}
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        x = plain_features(texts[i])
        margin = model.base + sum(t[bisect_right(c, v)] for t, c, v in zip(model.tables, model.cuts, x, strict=True))
        margin += sum(t[bisect_right(model.pair_cuts[a], x[a])][bisect_right(model.pair_cuts[b], x[b])] for a, b, t in model.pairs)
        score = 1 / (1 + math.exp(-margin))
        assert r["score"] == pytest.approx(score, abs=1e-9)
        assert r["predicted"] == (r["score"] >= 0.3)


def test_labels_said_twice_teach_once(spark, corpus):  # noqa: F811
    docs, labels = (spark.read.parquet(f"{corpus}/{x}.parquet") for x in ("documents", "labels"))
    once = quality.fit(docs, labels)
    more = labels.unionByName(labels).select("doc_id", "quality", F.lit("x").alias("text"))
    twice = quality.fit(docs.unionByName(docs), more.union(spark.createDataFrame([(None, 1, "x"), (1, None, "x")], "doc_id bigint, quality int, text string")))
    assert once.base == twice.base and all((a == b).all() for a, b in zip(once.tables, twice.tables, strict=True))


def test_quality_stage_on_nulls_repeats_and_clashing_columns(spark, corpus):  # noqa: F811
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    odd = docs.unionByName(docs.where("doc_id in (1, 2, 9001)")).withColumns({"score": F.lit("s"), "features": F.lit(1), "y": F.lit(None).cast("string")})
    kept = corpus_pipeline.quality_filter(spark, odd, SF)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert kept.columns == odd.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in odd.collect() if scores[r["doc_id"]] >= 0.3)
