"""Operator 13 against a plain computation and a full sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glotta.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(x.encode()) % 10000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute(rows, target, percent=25, least=20, seed=7):
    """(doc_id, n_features, weight, score, rank); ids are distinct and not null."""
    found = {i: runs(text) for i, text in rows}
    s, t = Counter(b for _, x in found.values() for b in x), Counter(b for text in target for b in runs(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = {}
    for i, (n_words, x) in found.items():
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        out[i] = (n_words, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    order = sorted((i for i in out if out[i][0] >= least), key=lambda i: (-out[i][3], i))
    rank = {i: k + 1 for k, i in enumerate(order[: percent * len(order) // 100])}
    return sorted((i, *out[i][1:], rank.get(i)) for i in out)


def result(spark, rows, target, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = resample.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), **options)
    return sorted(tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect())


def words_of(k, n):
    rng = random.Random(k)
    return " ".join(rng.choice(["Alpha", "beta", "été", "日本", "x9", "7", "of", "the", f"w{k}"]) for _ in range(n))


ROWS = [(k * 3 - 50, words_of(k, k % 60)) for k in range(150)] + [(1000, None), (1001, ""), (1002, "!?"), (-(2**63), words_of(7, 40)), (2**63 - 1, words_of(8, 40))]
TARGET = [words_of(1, 30), None, "", "the of the été"]


@pytest.mark.parametrize("percent", [0, 1, 25, 99, 100])
def test_against_brute_force(spark, percent):
    assert result(spark, ROWS, TARGET, percent=percent) == brute(ROWS, TARGET, percent)


def test_ties_go_to_smaller_ids(spark):
    rows = spark.createDataFrame([(5 * k, k % 3) for k in range(300)], "doc_id bigint, score bigint").repartition(3)
    keys = [F.bitwise_not("score"), F.col("doc_id")]
    for k in (1, 99, 100, 101, 250, 300):
        got = {tuple(r) for r in rows.where(resample.radix_select(rows, keys, k)).select("score", "doc_id").collect()}
        assert got == set(sorted(((i % 3, 5 * i) for i in range(300)), key=lambda x: (-x[0], x[1]))[:k])


def test_wide_keys(spark):
    values = [-(2**63), -(2**40), -1, 0, 1, 65535, 65536, 2**40, 2**63 - 1]
    rows = spark.createDataFrame([(x,) for x in values], "x bigint")
    for k in range(1, 10):
        assert sorted(r["x"] for r in rows.where(resample.radix_select(rows, [F.col("x")], k)).collect()) == values[:k]
        assert sorted(r["x"] for r in rows.where(resample.radix_select(rows, [F.bitwise_not("x")], k)).collect()) == values[-k:]


def test_repeated_rows_and_null_ids(spark):
    rows = [(4, words_of(4, 30))] * 40 + [(None, words_of(5, 30))] * 40 + [(None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = resample.resample(docs, spark.createDataFrame([(x,) for x in TARGET], "text string"), percent=60).collect()
    assert len(found) == 83
    drawn = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 49))
    assert drawn == sorted(drawn, key=lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0, r["n_features"]))


def test_no_documents_and_no_target(spark):
    assert result(spark, [], TARGET) == [] and result(spark, ROWS, []) == brute(ROWS, [])


def test_long_texts_further_columns_and_clashes(spark):
    rows = [(1, "un Deux trois " * 300_000), *((k, words_of(k, 25)) for k in range(2, 12))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS weight", "2 AS rank", "3 AS _row", "4 AS _text", "'s' AS source")
    found = resample.resample(docs, spark.createDataFrame([("un",)], "text string"), keep=["text", "source"]).collect()
    assert sorted((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found) == brute(rows, ["un"])
    assert {(r["doc_id"], r["text"], r["source"]) for r in found} == {(i, text, "s") for i, text in rows}
    with pytest.raises(ValueError, match="weight"):
        resample.resample(docs, docs, keep=["weight"])
