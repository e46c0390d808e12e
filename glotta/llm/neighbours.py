"""Approximate nearest neighbours by balanced posting lists.

Distinct vectors stand in lists, each list around a centroid. The centroids come from balanced
hierarchical k-means over a bounded sample; every vector is in the list of its nearest centroid, and
one near a boundary in several. A graph of the centroids, small enough to be sent to all tasks, is
searched for a vector's nearest lists. A query visits the lists whose centroids are at most
``ratio`` times as far as its nearest one; the ratio is fitted on a bounded sample of vectors, of
which the true neighbours are known, to find the part ``recall`` of those. Lists and the queries
that visit them meet in blocks of bounded size, where distances are exact.

Rows that share a vector are one entry of the index, with its smallest ids: no others can be among
the nearest. Each row is a candidate by itself, repeated ids included; a query leaves out one
row, its own. Null vectors, vectors without a length, with null or non-finite components, of
another number of components than most, and rows without an id take no part. Ties go to smaller
ids. An empty table has no result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glotta.llm.common import broadcast_value, last_table, materialise, noted_paths

#: Vectors that the centroids are fitted on, at most about; lists have about LIST_ROWS vectors until the sample is used up.
SAMPLE_ROWS, LIST_ROWS = 32_768, 256
#: Vectors whose true neighbours the ratio is fitted on.
TRIED = 512
#: Links of a centroid: to its nearest ones, and to others, which keep the graph together.
NEAR_LINKS, FAR_LINKS = 16, 8
#: A vector is in so many lists at most, those within NEAR times its nearest distance.
COPIES, NEAR = 2, 1.15
#: Rows of a list, or queries of one, that meet at a time.
BLOCK_ROWS = 4096
_SEED = 17


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y, by products."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T), 0)


def _split(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """The part 0..k-1 of each row: k-means whose large parts cost more, so that all end near the same size."""
    centres, counts = rows[rng.choice(len(rows), k, replace=False)], np.zeros(k)
    for _ in range(6):
        far = _squares(rows, centres)
        part = np.argmin(far + far.min(1).mean() * counts[None] * k / len(rows), axis=1)
        counts = np.bincount(part, minlength=k).astype(float)
        for j in np.nonzero(counts)[0]:
            centres[j] = rows[part == j].mean(0)
    return part


def balanced_centroids(sample: np.ndarray, most: int) -> np.ndarray:
    """Centroids of clusters of at most ``most`` rows of the sample, which are distinct."""
    rng, out, work = np.random.default_rng(_SEED), [], [np.arange(len(sample))]
    while work:
        own = work.pop()
        if len(own) <= most:
            out.append(sample[own].mean(0))
            continue
        part = _split(sample[own].copy(), min(8, -(-len(own) // most)), rng)
        if part.min() == part.max():  # too close for the arithmetic
            part = np.arange(len(own)) % 2
        work += [own[part == j] for j in np.unique(part)]
    return np.array(out)


@dataclass(frozen=True)
class Graph:
    """Centroids, and the links of each to others."""

    centroids: np.ndarray
    links: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Graph:
        n, rng = len(centroids), np.random.default_rng(_SEED)
        near = min(NEAR_LINKS, n)
        links = np.concatenate([np.argpartition(_squares(centroids[a : a + 1024], centroids), near - 1, axis=1)[:, :near] for a in range(0, n, 1024)])
        return cls(centroids, np.concatenate([links, rng.integers(0, n, (n, FAR_LINKS))], axis=1))

    def nearest(self, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances) of about the ``width`` nearest centroids of each point, nearest first.

        All points are searched side by side: each step follows the links of the best centroid
        not yet followed of every point, until the best ``width`` all are. A search as wide as
        half the centroids looks at all of them.
        """
        n, rows = len(self.centroids), np.arange(len(points))[:, None]
        if 2 * width >= n:
            far = _squares(points, self.centroids)
            order = np.argsort(far, axis=1, kind="stable")[:, :width]
            return order, np.sqrt(far[rows, order])
        sizes, own = (self.centroids**2).sum(1), (points**2).sum(1)

        def far_of(lists: np.ndarray) -> np.ndarray:
            return np.maximum(sizes[lists] + own[:, None] - 2 * np.einsum("pd,pld->pl", points, self.centroids[lists]), 0)

        lists = np.tile(np.linspace(0, n - 1, width, dtype=np.int64)[None], (len(points), 1))
        far, seen = far_of(lists), np.zeros((len(points), n), bool)
        seen[rows, lists] = True
        followed = np.zeros(lists.shape, bool)
        while True:
            best = np.argmin(np.where(followed, np.inf, far), axis=1)[:, None]
            if np.all(followed[rows, best]):
                break
            followed[rows, best] = True
            new = np.sort(self.links[lists[rows, best][:, 0]], axis=1)
            fresh = ~seen[rows, new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            seen[rows, new] = True
            lists, far, followed = np.concatenate([lists, new], 1), np.concatenate([far, np.where(fresh, far_of(new), np.inf)], 1), np.concatenate([followed, ~fresh], 1)
            keep = np.argpartition(far, width - 1, axis=1)[:, :width]
            lists, far, followed = lists[rows, keep], far[rows, keep], followed[rows, keep]
        order = np.argsort(far, axis=1, kind="stable")
        return lists[rows, order], np.sqrt(far[rows, order])

    def homes(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lists, taken): the lists near each point and which of them it stands in.

        Those are its nearest one and further ones on whose boundary it is, but none that is nearer to
        a list already taken than to the point.
        """
        lists, far = self.nearest(points, min(4 * COPIES, len(self.centroids)))
        taken = np.zeros(lists.shape, bool)
        taken[:, 0] = True
        for j in range(1, lists.shape[1]):
            good = (far[:, j] <= NEAR * far[:, 0]) & (taken.sum(1) < COPIES)
            for i in range(j):
                between = np.sqrt(((self.centroids[lists[:, i]] - self.centroids[lists[:, j]]) ** 2).sum(1))
                good &= ~taken[:, i] | (between >= far[:, j])
            taken[:, j] = good
        return lists, taken

    def visited(self, points: np.ndarray, ratio: float, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists within ``ratio`` times each point's nearest distance, and further ones while those have fewer than ``least`` rows (``sizes``).

        The search is widened until the last list found is one too many.
        """
        out: list = [None] * len(points)
        width, left = min(16, len(self.centroids)), np.arange(len(points))
        while len(left):
            lists, far = self.nearest(points[left], width)
            within = (far <= ratio * far[:, :1]) | (np.cumsum(sizes[lists], axis=1) - sizes[lists] < least)
            done = ~within[:, -1] | (width == len(self.centroids))
            for k in np.nonzero(done)[0]:
                out[left[k]] = lists[k][within[k]]
            left, width = left[~done], min(4 * width, len(self.centroids))
        return out


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest_rows(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, most: np.ndarray | float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's ``k`` nearest rows at a distance of at most ``most``, ties by ids.

    Products find who can be among them, differences decide.
    """
    most = np.broadcast_to(most, len(queries))
    with np.errstate(over="ignore", invalid="ignore"):
        far = _squares(queries, rows)
        if not np.isfinite(far).all():
            far = np.stack([((rows - q) ** 2).sum(1) for q in queries])
        k = min(k, len(rows))
        slack = 1e-12 * ((queries**2).sum(1) + (rows**2).sum(1).max(initial=0))
        last = np.minimum(np.partition(far, k - 1, axis=1)[:, k - 1], most * most) + slack
        out = []
        for i, q in enumerate(queries):
            own = np.nonzero(far[i] <= last[i])[0]
            exact = np.sqrt(((rows[own] - q) ** 2).sum(1))
            order = np.lexsort((ids[own], exact))[:k]
            order = order[exact[order] <= most[i]]
            out.append((np.full(len(order), i), own[order], exact[order]))
    return tuple(np.concatenate(x) for x in zip(*out))


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector")).where("vec_id is not null and vector is not null")
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (usual["n"] if usual else 0))


def _first_ids(rows: DataFrame, k: int) -> DataFrame:
    """(vector, ids): each distinct vector with its ``k`` smallest ids; Spark drops the others before the shuffle."""
    order = W.partitionBy("vector").orderBy("vec_id")
    first = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)
    return first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _drawn(index: DataFrame, most: int, n: int, salt: int) -> np.ndarray:
    """About ``most`` of the distinct vectors, by a hash of the vector."""
    part = F.pmod(F.xxhash64("vector", F.lit(salt)), F.lit(2**32)) < int(2**32 * min(1.0, most / max(1, n)))
    found = index.where(part).select("vector").limit(2 * most).toArrow().column(0).combine_chunks()
    return matrix(found) if len(found) else np.zeros((0, 1))


def _exact(index: DataFrame, tried: np.ndarray, k: int) -> dict[int, np.ndarray]:
    """The ``k`` nearest other vectors of each tried one, each task sending its own nearest."""
    held = broadcast_value(index, tried)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column(0))
                q, row, far = nearest_rows(held.value, rows, np.arange(len(rows)), k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(far), batch.column(0).take(pa.array(row))], names=["q", "far", "vector"])

    found = index.select("vector").mapInArrow(over, f"q bigint, far double, vector {index.schema['vector'].dataType.simpleString()}")
    nearest = found.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy("far"))).where(F.col("k").between(2, k + 1))  # the first is the vector itself
    rows = nearest.select("q", "vector").toArrow()
    vectors, q = matrix(rows.column("vector").combine_chunks()) if rows.num_rows else np.zeros((0, 1)), rows.column("q").to_numpy()
    return {i: vectors[q == i] for i in np.unique(q)}


def fitted_ratio(graph: Graph, tried: np.ndarray, nearest: dict[int, np.ndarray], recall: float) -> float:
    """The least ratio with which the tried vectors visit a list of the part ``recall`` of their true neighbours."""
    needed = []
    for i, vectors in nearest.items():
        q = tried[i : i + 1]
        first = graph.nearest(q, min(16, len(graph.centroids)))[1][0, 0]
        lists, taken = graph.homes(vectors)
        far = np.sqrt(((graph.centroids[lists] - q[:, None]) ** 2).sum(-1))
        needed += list(np.where(taken, far, np.inf).min(1) / max(first, 1e-300))
    return float(np.quantile(needed, recall)) * (1 + 1e-9) if needed else 1.0


def _postings(index: DataFrame, graph) -> DataFrame:
    """(list, home, row, vector, ids): the vectors in their lists; ``home`` marks the nearest one."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                lists, taken = graph.value.homes(matrix(part.column(1)))
                row, j = np.nonzero(taken)
                at = pa.array(row)
                columns = [pa.array(lists[row, j]), pa.array(j == 0), *(c.take(at) for c in part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "home", "row", "vector", "ids"])

    kind = index.schema["vector"].dataType.simpleString()
    return index.select("row", "vector", "ids").mapInArrow(over, f"list bigint, home boolean, row bigint, vector {kind}, ids array<bigint>")


def _visits(queries: DataFrame, graph, ratio: float, sizes: np.ndarray, least: int) -> DataFrame:
    """(list, first, q, vector): the queries at the lists that they visit.

    Of m lists the nearest root of m come first, and as many as have ``least`` rows.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = graph.value.visited(matrix(part.column(1)), ratio, sizes, least)
                at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                first = [(np.arange(len(x)) < np.sqrt(len(x))) | (np.cumsum(sizes[x]) - sizes[x] < least) for x in lists]
                columns = [pa.array(np.concatenate(lists)), pa.array(np.concatenate(first)), *(c.take(at) for c in part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "first", "q", "vector"])

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.select("q", "vector").mapInArrow(over, f"list bigint, first boolean, q bigint, vector {kind}")


def _in_blocks(rows: DataFrame, key: Column, own: str, other: str, counts: DataFrame) -> DataFrame:
    """``rows`` in their block of the list, once for each block of the other side."""
    sizes = counts.select("list", own, other)
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(f"{other}_no")
    return rows.join(sizes, "list").select(*rows.columns, F.pmod(F.xxhash64(key), F.col(own)).alias(f"{own}_no"), blocks)


def _met(postings: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """(q, row, far, ids): each query's nearest rows of every list visited, at a distance of at most ``most``."""
    number = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias(name))
    counts = number(postings, "blocks").join(number(visits, "turns"), "list")
    left = _in_blocks(postings, F.col("row"), "blocks", "turns", counts)
    right = _in_blocks(visits, F.col("q"), "turns", "blocks", counts)
    keys = ["list", "blocks_no", "turns_no"]

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "far": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        rows, asked = rows.combine_chunks(), asked.combine_chunks()
        ids = rows.column("ids").combine_chunks()
        first = ids.flatten().to_numpy()[np.diff(ids.offsets.to_numpy(), prepend=0).cumsum()[:-1]]
        points, own = (matrix(x.column("vector").combine_chunks()) for x in (asked, rows))
        q, row, far = nearest_rows(points, own, first, k, asked.column("most").to_numpy())
        at = pa.array(row)
        return pa.table({"q": asked.column("q").take(pa.array(q)), "row": rows.column("row").take(at), "far": pa.array(far), "ids": rows.column("ids").take(at)})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "q bigint, row bigint, far double, ids array<bigint>")
    return found.groupBy("q", "row").agg(F.first("far").alias("far"), F.first("ids").alias("ids"))


def nearest_neighbours(
    vectors: DataFrame, queries: Column, *, k: int = 10, recall: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of every row that ``queries`` (a condition on vec_id) holds for, by Euclidean distance.

    ``recall`` is what the ratio is fitted to; what is reached is held against brute force in the tests.
    """
    spark, known = vectors.sparkSession, noted_paths(vectors.sparkSession)
    rows = valid(vectors, id_col, vector_col)
    # a query leaves out its own row, so one more is looked for
    index = materialise(_first_ids(rows, k + 1).withColumn("row", F.monotonically_increasing_id()), "neighbours-index")
    asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), "vector")
    n = index.count()
    if not n:
        empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
        return last_table(empty, "neighbours", known)
    sample = _drawn(index, sample_rows, n, 1)
    sample = sample if len(sample) else matrix(index.limit(1).select("vector").toArrow().column(0).combine_chunks())
    lists = max(1, min(-(-n // list_rows), len(sample) // 8))
    graph = Graph.of(balanced_centroids(sample, -(-len(sample) // lists)))
    tried = _drawn(index, TRIED, n, 2)
    ratio = fitted_ratio(graph, tried, _exact(index, tried, k), recall) if len(tried) else 2.0
    held = broadcast_value(vectors, graph)

    distinct = materialise(asked.select("vector").distinct().withColumn("q", F.monotonically_increasing_id()), "neighbours-queries")
    postings = materialise(_postings(index, held), "neighbours-lists")
    sizes = np.zeros(len(graph.centroids), np.int64)
    for number, count in postings.where("home").groupBy("list").count().collect():
        sizes[number] = count
    visits = materialise(_visits(distinct, held, ratio, sizes, k + 1), "neighbours-visits")
    postings, beyond = postings.drop("home"), F.lit(float("inf"))
    best = lambda met: met.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy("far", F.col("ids")[0]))).where(F.col("k") <= k + 1).drop("k")
    # the first lists bound the distance, so that the others send few rows
    first = materialise(best(_met(postings, visits.where("first").withColumn("most", beyond), k + 1)), "neighbours-first")
    bounds = first.groupBy("q").agg(F.when(F.count(F.lit(1)) > k, F.max("far")).otherwise(beyond).alias("most"))
    others = _met(postings, visits.where("not first").join(bounds, "q"), k + 1)
    near = best(first.unionByName(others).groupBy("q", "row").agg(F.first("far").alias("far"), F.first("ids").alias("ids")))
    # of equal vectors all smallest ids stand for themselves
    single = near.select("q", "far", F.explode("ids").alias("vec_id"))
    single = single.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy("far", "vec_id"))).where(F.col("k") <= k + 1)
    found = single.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("far", "vec_id"))).alias("found"))
    answered = asked.join(distinct, "vector").select("query_id", "q").join(found, "q")
    own = F.array_position(F.transform("found", lambda x: (x["far"] == 0) & (x["vec_id"] == F.col("query_id"))), True)
    rest = F.when(own > 0, F.filter("found", lambda x, i: i != own - 1)).otherwise(F.col("found"))
    out = answered.select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("at", "x"))
    return last_table(out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.far").alias("score")), "neighbours", known)
