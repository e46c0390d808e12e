"""Of the sets of shingles only those that pairs name are dealt out, whatever the size of the tables."""

import numpy as np
from pyspark.sql import functions as F

from glotta.llm import jaccard


def test_rows_that_no_pair_names_stay_where_they_are(spark):
    random = np.random.default_rng(5)
    nodes = random.integers(-(2**63), 2**63 - 1, 20_000).tolist()
    rows = spark.createDataFrame([(x,) for x in nodes], "node bigint")
    named = spark.createDataFrame([(x,) for x in [*nodes[:300], -1, 0, 2**63 - 1, -(2**63)]], "node bigint")
    left = {r["node"] for r in jaccard.may_be_named(rows, named).collect()}
    assert set(nodes[:300]) <= left and len(left) < 600
    # with too few bits more rows stay, and none is lost
    left = {r["node"] for r in jaccard.may_be_named(rows, named, most_bits=1 << 8).collect()}
    assert set(nodes[:300]) <= left
    assert jaccard.may_be_named(rows, named.limit(0)).count() == 0


def test_sets_that_are_dealt_out_follow_the_pairs(spark, monkeypatch):
    random = np.random.default_rng(6)
    sets = [(x, random.integers(0, 2**62, 20).tolist()) for x in random.integers(0, 2**62, 3000).tolist()]
    sets[1] = (sets[1][0], sets[0][1])
    rows = spark.createDataFrame(sets, "node bigint, grams array<bigint>")
    pairs = spark.createDataFrame([(sets[0][0], sets[1][0]), (sets[2][0], sets[3][0])], "a bigint, b bigint")
    dealt = []
    join = type(rows).join

    def noted(left, other, *args):
        if args[-1:] == ("left_semi",):
            dealt.append(left.select("node").count())
        return join(left, other, *args)

    monkeypatch.setattr(type(rows), "join", noted)
    found = [tuple(r) for r in jaccard.verified(pairs, rows).collect()]
    assert found == [(sets[0][0], sets[1][0])]
    assert len(dealt) == 1 and dealt[0] < 100


def test_near_dedup_passes_small_batches(spark, monkeypatch):
    seen = []
    found = jaccard.near_duplicates
    monkeypatch.setattr(jaccard, "near_duplicates", lambda *a, **k: seen.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) or found(*a, **k))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y")], "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs).select("doc_id").collect()) == [1, 3]
    assert seen == [str(jaccard.BATCH_BYTES)] and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
