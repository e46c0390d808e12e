"""Connected components by alternating star steps; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotta.llm.common import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of a link between two nodes, with the smallest node it reaches.

    Each round hangs the larger neighbours of every node on its smallest neighbour, then does
    the same with the smaller ones, until nothing changes; the number of rounds grows as the
    logarithm of the number of nodes. Each round is a written table, so a lost executor costs
    one round at most. A hub is a hot key of a join with one row for each node on the other
    side, which adaptive execution can split. Links with a null, loops and repeats are ignored.
    """
    now = materialise(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links"
    )
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(
            F.explode(
                F.array(
                    F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
                    F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")),
                )
            ).alias("x")
        )
        now = materialise(small.select("x.hi", "x.lo").where("hi != lo").distinct(), "links")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
