"""Exact duplicates through an extendible-hash index on shared files.

Native: DataFrame functions only.

1. Every text gets a 64-bit key. The directory addresses keys by their leading bits: the
   distinct keys of each slot are counted, and a bucket that holds more than ``capacity`` keys
   is split, which doubles the directory where needed, until each bucket fits or the directory
   has its full depth. It has MOST_SLOTS slots at most, whatever the corpus, so it is broadcast;
   capacity grows where fewer keys a bucket would need more slots.
2. Every text is routed through the directory to its bucket. The task that owns a bucket's key
   compares the bytes of all texts that share it: equal texts fall together (already on the map
   side, so a group of copies that holds a third of all rows arrives as one row per task), and
   different texts with one key become separate links of the key's chain.
3. Owner tasks each take a range of buckets, number the chains, and write the entries, sorted,
   to the shared folder.
4. Each document is routed to its bucket again and follows the chain of its key there to the
   link with its digest, which says what stays. Entries of groups over ``hot_share`` of all rows
   are few (1 / hot_share at most); their keys are salted so that no task gets a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glotta.llm.common import last_table, materialise, noted_paths, text_or_empty

KEY_BITS = 64
#: The directory can be this many bits deeper than an even spread of keys would need.
SPARE_DEPTH = 3
#: Slots of a directory, at most; two 64-bit numbers each, so 16 MB.
MOST_DEPTH = 20
MOST_SLOTS = 1 << MOST_DEPTH


@dataclass(frozen=True)
class ExtendibleIndex:
    """entries: bucket, key, chain, digest, keep_id, group_size, sorted, in files of bucket ranges.
    directory: slot, bucket, local_depth; 2**global_depth slots."""

    entries: DataFrame
    directory: DataFrame
    global_depth: int
    n_rows: int


def _keyed(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column] | None) -> DataFrame:
    text = text_or_empty(text_col)
    text = normalise(text) if normalise else text
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).withColumn("key", F.xxhash64("_text"))


def _slot(depth: int) -> Column:
    """The leading ``depth`` bits of the key."""
    return F.shiftrightunsigned(F.col("key"), KEY_BITS - depth) if depth else F.lit(0).cast("bigint")


def split_buckets(keys: DataFrame, depth: int, capacity: int) -> DataFrame:
    """(level, prefix, n) of the buckets after all splits, from a frame with the column ``key``.

    A bucket is a prefix whose keys fit while those of its parent didn't; at the full depth
    a bucket stays as it is.
    """
    slots = keys.groupBy(_slot(depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    nodes = (
        slots.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "slot", "n")
        .select("level", F.expr(f"shiftright(slot, {depth} - level)").alias("prefix"), "n")
        .groupBy("level", "prefix")
        .agg(F.sum("n").alias("n"))
    )
    fits = nodes.where((F.col("n") <= capacity) | (F.col("level") == depth))
    over = nodes.where((F.col("n") > capacity) & (F.col("level") < depth)).select(
        (F.col("level") + 1).alias("level"), F.col("prefix").alias("parent")
    )
    below = (
        fits.where("level > 0")
        .withColumn("parent", F.shiftright("prefix", 1))
        .join(over, ["level", "parent"], "left_semi")
        .select("level", "prefix", "n")
    )
    return fits.where("level = 0").select("level", "prefix", "n").unionByName(below)


def build_index(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    capacity: int = 4096,
) -> ExtendibleIndex:
    """Index every distinct text of ``docs`` and write it to the shared folder."""
    rows = _keyed(docs, id_col, text_col, normalise)
    keys = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "exact-keys")
    n_keys, n_rows = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    capacity = max(capacity, math.ceil(n_keys * (1 << SPARE_DEPTH) / MOST_SLOTS))
    depth = min(MOST_DEPTH, max(0, math.ceil(math.log2(max(1, n_keys / capacity)))) + SPARE_DEPTH)
    # a pointer for every slot that a bucket covers
    first = F.expr(f"shiftleft(prefix, {depth} - level)")
    directory = split_buckets(keys, depth, capacity).select(
        F.explode(F.sequence(first, F.expr(f"shiftleft(prefix + 1, {depth} - level) - 1"))).alias("slot"),
        first.alias("bucket"),
        F.col("level").alias("local_depth"),
    )
    directory = materialise(directory, "exact-directory")
    links = (
        _routed(rows, directory, depth)
        .groupBy("bucket", "key", "_text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("bucket", "key", F.unhex(F.sha2("_text", 256)).alias("digest"), "keep_id", "group_size")
    )
    chain = F.row_number().over(W.partitionBy("bucket", "key").orderBy("digest"))
    entries = (
        materialise(links, "exact-links")
        .repartitionByRange("bucket")
        .withColumn("chain", chain)
        .sortWithinPartitions("bucket", "key", "chain")
        .select("bucket", "key", "chain", "digest", "keep_id", "group_size")
    )
    return ExtendibleIndex(materialise(entries, "exact-index"), directory, depth, n_rows)


def _routed(rows: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """``rows`` (key) with the bucket that the directory, a table of MOST_SLOTS rows at most, has in their slot."""
    pointers = directory.select(F.col("slot").alias("_slot"), "bucket")
    return rows.withColumn("_slot", _slot(depth)).join(F.broadcast(pointers), "_slot").drop("_slot")


def probe(
    docs: DataFrame,
    index: ExtendibleIndex,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    hot_share: float = 1e-4,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of the documents whose text the index has."""
    per_salt = max(1, math.ceil(hot_share * index.n_rows))
    entries = index.entries.select("bucket", "key", "digest", "keep_id", "group_size")
    # at most 1 / hot_share groups have more rows than per_salt: a bounded broadcast
    hot = entries.where(F.col("group_size") > per_salt).groupBy("key").agg(F.ceil(F.max("group_size") / per_salt).cast("int").alias("salts"))
    salted = lambda rows: rows.join(F.broadcast(hot), "key", "left")
    sought = salted(_keyed(docs, id_col, text_col, normalise).select("doc_id", "key", F.unhex(F.sha2("_text", 256)).alias("digest")))
    sought = _routed(sought, index.directory, index.global_depth).withColumn("salt", F.coalesce(F.pmod(F.hash("doc_id"), F.col("salts")), F.lit(0)))
    links = salted(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("salts")
    return sought.join(links, ["bucket", "key", "digest", "salt"]).select(
        F.col("doc_id"),
        F.col("keep_id"),
        F.col("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    capacity: int = 4096,
    hot_share: float = 1e-4,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the row with the largest doc_id stays; a null id
    is below all others and stays only if no row of its group has an id. Rows that repeat both
    id and text are one document said twice and share their verdict. An empty table gives an
    empty result; other columns of ``docs`` are ignored, whatever their names. A text of any
    length is one value, which the task that owns it must hold.
    """
    known = noted_paths(docs.sparkSession)
    index = build_index(docs, id_col=id_col, text_col=text_col, normalise=normalise, capacity=capacity)
    found = probe(docs, index, id_col=id_col, text_col=text_col, normalise=normalise, hot_share=hot_share)
    return last_table(found, "exact-verdicts", known)


def keep_rows(docs: DataFrame, verdicts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``verdicts`` (doc_id, text_sha256, kept) doesn't keep, and all columns.

    Rows without verdict stay. Of rows that repeat both id and text, null ids included, one stays.
    """
    digest = F.sha2(text_or_empty(text_col), 256)
    marks = verdicts.groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    marks = materialise(marks.where("not kept or n > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"), "kept"), "marks")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (digest == F.col("_digest"))
    # merged at any size, so that the cost has no step where the marks grow too large to broadcast
    left = docs.join(marks.hint("merge"), same, "left_anti")
    again = marks.where("kept")
    if again.isEmpty():
        return left
    again = docs.join(materialise(again, "marks-again"), same, "left_semi").withColumn("_digest", digest)
    return left.unionByName(again.dropDuplicates([id_col, "_digest"]).drop("_digest"))


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the kept row of each group, one of those that repeat its id, and all its columns."""
    verdicts = exact_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    return keep_rows(docs, verdicts, id_col=id_col, text_col=text_col)
