"""Importance resampling towards a target: documents are drawn by how much likelier their words are in the target.

Hashed runs of one or two words are counted in the documents and in the target. The gain of a
bucket is the logarithm of its two shares' quotient, in thousandths; a document's weight is the
mean of its gains. With a draw of Gumbel's law added, the highest scores are a sample without
replacement in proportion to the exponentiated weights.

The k-th highest score is found without a sort: the key (score, id) is cut into digits of 16 bits,
each round counts the values of the next digit among the rows that share the digits so far, and
the driver sees at most 65,536 counts. Rows up to that key are drawn; only they are sorted, by
ranges, and numbered by the sizes of the ranges.

Null texts have no words. A null id is ``7:`` to the draw and comes after all other ids. Texts of
any length are read whole. Rows that repeat an id are documents of their own; of equal keys the
one with fewer features comes first, after that any. Without documents there is no row, without
target texts all gains come from the documents alone. Other columns are ignored, but for ``keep``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotta.llm.common import broadcast_value, last_table, map_texts, materialise, noted_paths, text_bytes

#: Runs of digits, letters and all characters beyond ASCII, in lower-cased bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
DIGIT_BITS = 16
_OWN = ("doc_id", "n_words", "n_features", "weight", "score", "rank")


def features(text: bytes, buckets: int, longest: int = 2) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of each run of 1 to ``longest`` words, by the CRC-32 of the run joined by blanks."""
    words = WORD.findall(text.lower())
    last = list(map(crc32, words))
    found = list(last)
    for k in range(1, longest):
        # a checksum goes on from that of the run without its last word
        last = [crc32(b" " + w, c) for c, w in zip(last, words[k:])]
        found += last
    return len(words), np.array(found, np.int64) % buckets


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """How many features of all texts fall in each bucket; a task sends one count a bucket."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                n += np.bincount(features(text.as_py(), buckets, longest)[1], minlength=buckets)
        own = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own])], names=["bucket", "n"])

    counted = texts.select(text_bytes(text_col).alias("text")).mapInArrow(over, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's share over the documents' share), by bucket; every bucket has one feature more than counted."""
    all_raw, all_target, buckets = float(raw.sum()), float(target.sum()), len(raw)
    quotient = (target + 1.0) * (all_raw + buckets) / ((raw + 1.0) * (all_target + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in quotient], np.int64)


def gumbel(id_col: str, seed: int) -> Column:
    """A draw of Gumbel's law in thousandths, rounded down, which the seed and the id decide."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ascending() -> list[Column]:
    """The composite key as signed numbers of which smaller ones come first; the complement turns an order round without overflow."""
    last_id = F.lit(2**63 - 1).cast("bigint")
    return [F.bitwise_not("score"), F.coalesce(F.col("doc_id").cast("bigint"), last_id), F.col("n_features"), F.col("_row")]


def radix_select(rows: DataFrame, keys: Sequence[Column], k: int) -> Column:
    """The condition that holds for the ``k`` rows of ``rows`` (at least k > 0) with the smallest composite keys, which are distinct.

    Each round is a count by one digit, aggregated before its shuffle; the rows aren't moved.
    """
    bounds = rows.agg(*(f(key) for key in keys for f in (F.min, F.max))).first()
    same, below = F.lit(True), F.lit(False)  # rows with the digits so far; rows before them
    for key, low, high in zip(keys, bounds[::2], bounds[1::2]):
        shift = next(s for s in range(0, 65, DIGIT_BITS) if s == 64 or low >> s == high >> s)
        while shift:
            shift -= DIGIT_BITS
            digit = F.shiftright(key, shift)
            counts = sorted(map(tuple, rows.where(same).groupBy(digit.alias("digit")).count().collect()))
            for value, n in counts:
                if k <= n:
                    break
                k -= n
            below, same = below | (same & (digit < value)), same & (digit == value)
            if k == n:
                return below | same
        same = same & (key == (low if low == high else value))
    raise ValueError("rows repeat a key")


def ranked(rows: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """``rows`` with ``rank`` from 1 on in the order of the keys: sorted by ranges, a range's rows follow those of the ranges before."""
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    ordered = materialise(ordered, "resample-ranges")  # the ranges must be the same when they are counted and numbered
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND(2**33 - 1)
    sizes, starts, before = sorted(map(tuple, ordered.groupBy(part.alias("part")).count().collect())), [], 0
    for number, n in sizes:
        starts.append((number, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "_part bigint, _before bigint")
    return ordered.join(offsets, part == F.col("_part")).withColumn("rank", F.col("_before") + within + 1).drop("_place", "_part", "_before")


def weighted(docs: DataFrame, target: DataFrame, *, text_col: str = "text", buckets: int = 10_000, longest: int = 2) -> DataFrame:
    """``docs`` with n_words, n_features and weight, the floored mean gain of its features (none: 0)."""
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, text_col, buckets, longest))
    gain = broadcast_value(docs, gain)

    def each(texts: list[bytes]) -> list[pa.Array]:
        rows = []
        for text in texts:
            n_words, found = features(text, buckets, longest)
            rows.append((n_words, len(found), int(gain.value[found].sum()) // max(1, len(found))))
        return [pa.array([x[k] for x in rows], pa.int64()) for k in range(3)]

    return map_texts(docs, [T.StructField(x, T.LongType()) for x in ("n_words", "n_features", "weight")], each, text_col)


def resample(
    docs: DataFrame, target: DataFrame, *, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10_000, longest: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """Every document: doc_id, n_words, n_features, weight, score and, of those drawn, rank; and the columns ``keep``, such as the text.

    ``percent`` of the documents with ``least_words`` words or more are drawn, rounded down, without replacement.
    """
    if clash := set(keep) & {*_OWN, "_row"}:
        raise ValueError(f"columns of these names are made here: {sorted(clash)}")
    spark, known = docs.sparkSession, noted_paths(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *keep)
    scored = weighted(read, target.select(F.col(text_col).alias("_text")), text_col="_text", buckets=buckets, longest=longest).drop("_text")
    scored = scored.withColumn("score", F.col("weight") + gumbel("doc_id", seed)).withColumn("_row", F.monotonically_increasing_id())
    scored = materialise(scored, "resample-scores")
    columns = [*_OWN[:-1], *keep]
    none = F.lit(None).cast("bigint").alias("rank")
    enough = F.col("n_words") >= least_words
    k = percent * scored.where(enough).count() // 100
    if not k:
        return last_table(scored.select(*columns, none), "resample", known)
    chosen = enough & radix_select(scored.where(enough), _ascending(), k)
    drawn = ranked(scored.where(chosen), _ascending()).select(*columns, "rank")
    return last_table(scored.where(~chosen).select(*columns, none).unionByName(drawn), "resample", known)
