"""Operator 12 against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glotta.llm import neighbours, queries

SF = "/root/testdata/sf0.1"


def brute(rows, asked, k=10):
    """(query_id, rank, vec_id, score) over rows (vec_id, vector), each a candidate of its own."""
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = []
    for at in np.nonzero([asked(i) for i in ids])[0]:
        far = np.sqrt(((m - m[at]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, far)) if j != at][:k]
        out += [(int(ids[at]), r + 1, int(ids[j]), float(far[j])) for r, j in enumerate(order)]
    return sorted(out)


def result(df, **options):
    return sorted(tuple(r) for r in neighbours.nearest_neighbours(df, F.col("vec_id") % 100 == 0, **options).select("query_id", "rank", "vec_id", "score").collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def assert_same(got, want):
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-12, atol=1e-12)


def random_rows(n, dim=5, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(n, dim)))]


def test_small_tables_are_exact(spark):
    rows = random_rows(230)
    assert_same(result(frame(spark, rows)), brute(rows, lambda i: i % 100 == 0))


def test_rows_that_take_no_part(spark):
    rows = random_rows(120)
    odd = [(1000, None), (1001, []), (1002, [0.0] * 5), (1100, [1.0, None, 0.0, 0.0, 0.0]), (1200, [float("nan")] * 5), (1300, [1.0, float("-inf"), 0.0, 0.0, 0.0]), (1400, [1.0, 2.0]), (None, [1.0] * 5)]
    assert_same(result(frame(spark, rows + odd)), brute(rows, lambda i: i % 100 == 0))


def test_equal_vectors_and_repeated_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 300)] + [(1000 + i, [float(i), 0.5]) for i in range(5)] + [(500, [9.0, 9.0])] * 4 + [(600, [9.0, 9.0])]
    assert_same(result(frame(spark, rows).repartition(3)), brute(rows, lambda i: i % 100 == 0))


def test_ties_and_few_candidates(spark):
    rows = [(100, [1.0, 0.0]), (5, [0.0, 1.0]), (3, [0.0, -1.0]), (7, [2.0, 1.0]), (1, [2.0, -1.0])]
    got = result(frame(spark, rows))
    assert [(r, v) for _, r, v, _ in got] == [(1, 1), (2, 3), (3, 5), (4, 7)]
    assert result(frame(spark, rows[:1])) == []


def test_empty_table_and_further_columns(spark):
    assert result(frame(spark, [])) == []
    rows = random_rows(110)
    more = frame(spark, rows).selectExpr("*", "1 AS row", "2 AS vector", "3 AS q", "4 AS list", "'x' AS label")
    assert_same(result(more), brute(rows, lambda i: i % 100 == 0))


def test_large_components(spark):
    rows = [(i, [1e200 * (i + 1), -1e180]) for i in range(0, 300, 50)]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    assert len(got) == 3 * 5 and all(r["score"] == float("inf") for r in got)


def test_recall_of_the_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got, want = queries.op12_neighbours(spark, SF).collect(), brute(rows, lambda i: i % 100 == 0)
    true = {(q, v): s for q, _, v, s in want}
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    assert len(got) == len(want) and len(found) == len(got)
    assert len(found.keys() & true.keys()) >= 0.9 * len(true)
    assert all(abs(found[x] - true[x]) < 1e-12 for x in found.keys() & true.keys())


def test_small_blocks_and_many_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * 10
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=6)]) for i in range(1500)]
    got, want = result(frame(spark, rows), list_rows=20), brute(rows, lambda i: i % 100 == 0)
    assert len(got) == len(want) and len({x[::2] for x in got} & {x[::2] for x in want}) >= 0.9 * len(want)


@pytest.fixture(scope="module")
def graph():
    rng = np.random.default_rng(5)
    sample = rng.normal(size=(6000, 8))
    return sample, neighbours.Graph.of(neighbours.balanced_centroids(sample, 8))


def test_no_cluster_exceeds_its_bound(graph):
    sample, g = graph
    assert len(sample) / 8 <= len(g.centroids) <= len(sample)
    nearest = np.argmin(neighbours._squares(sample, g.centroids), axis=1)
    assert np.bincount(nearest).max() <= 8 * 8


def test_the_graph_finds_the_nearest_centroids(graph):
    sample, g = graph
    lists, far = g.nearest(sample[:200], 16)
    assert 2 * 16 < len(g.centroids) and np.all(np.diff(far, axis=1) >= 0)
    true = np.argsort(neighbours._squares(sample[:200], g.centroids), axis=1)[:, :16]
    assert np.mean([len(set(a) & set(b)) / 16 for a, b in zip(lists, true)]) > 0.95
    assert all(len(set(a)) == 16 for a in lists)


def test_boundary_vectors_stand_in_several_lists(graph):
    sample, g = graph
    lists, taken = g.homes(sample)
    assert taken[:, 0].all() and taken.sum(1).max() == neighbours.COPIES and 0.05 < np.mean(taken.sum(1) > 1) < 1


def test_ratio_and_rows_decide_the_visits(graph):
    sample, g = graph
    sizes = np.full(len(g.centroids), 4)
    few, many = g.visited(sample[:50], 1.0, sizes, 1), g.visited(sample[:50], 1.5, sizes, 1)
    assert all(len(x) == 1 for x in few) and np.mean([len(x) for x in many]) > 5
    assert all(set(a) <= set(b) for a, b in zip(few, many))
    assert all(len(x) >= 3 for x in g.visited(sample[:50], 1.0, sizes, 11))
    assert {len(x) for x in g.visited(sample[:5], 1e9, sizes, 1)} == {len(g.centroids)}
