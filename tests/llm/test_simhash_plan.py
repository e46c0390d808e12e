"""The planner's pair counts, and partitions of wide thresholds against all pairs."""

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from glotta.llm import simhash
from tests.llm.test_operators import components


def test_transform_counts_pairs_by_distance():
    count = np.random.default_rng(1).integers(0, 5, 256).astype(float)
    apart = simhash._hadamard(simhash._hadamard(count) ** 2) / 256
    got = np.bincount(np.bitwise_count(np.arange(256)), apart)
    for d in range(9):
        want = sum((count * count[np.arange(256) ^ sum(1 << b for b in f)]).sum() for f in combinations(range(8), d))
        assert got[d] == pytest.approx(want)


@pytest.mark.parametrize("distance", [5, 8])
def test_planned_partitions_find_all_links(spark, distance):
    rng = np.random.default_rng(distance)
    rows = [int(x) for x in rng.integers(0, 2**63, 20, dtype=np.int64)]
    rows += [x ^ sum(1 << int(b) for b in rng.choice(63, d, replace=False)) for x in rows for d in range(1, 11)]
    nodes = spark.createDataFrame([(x, k) for k, x in enumerate(dict.fromkeys(rows))], "fp bigint, node bigint")
    found = simhash.links(nodes, simhash.plan_partitions(nodes, distance), distance).collect()
    own = {r["node"]: r["fp"] for r in nodes.collect()}
    pairs = [(a, b) for a, b in combinations(own, 2) if (own[a] ^ own[b]).bit_count() <= distance]
    assert components(own, [tuple(r) for r in found]) == components(own, pairs)


def test_the_stage_calls_the_operator(spark, monkeypatch):
    called, whole = [], simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a, **k: called.append(k["shingle"]) or whole(*a, **k))
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "else")], "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {1, 3} and called == [5]


def test_a_distance_without_a_plan_is_refused(spark):
    nodes = spark.createDataFrame([(k * 7919, k) for k in range(50)], "fp bigint, node bigint")
    for distance in (24, 40):
        with pytest.raises(ValueError, match=f"distance {distance}"):
            simhash.plan_partitions(nodes, distance)
