"""Repeated passages by sparse suffix arrays.

Only the suffixes at content-selected places are kept: of every ``passage - seed + 1`` words in
a row, the one whose next ``seed`` words have the least hash (the first of equals). Two copies
of a passage of ``passage`` words select the same places, so each shared passage has a pair of
kept suffixes that begin alike. One suffix in about (passage - seed) / 2 is kept.

A kept suffix stands for the run of passage windows that selected it. The suffixes are put in
order of their seed, then of the digest of the whole run; equal ones fall together. Neighbours
with one seed but different runs are then extended left and right: the windows of their runs
are compared one offset after another. A window that comes back is a repeat, and touching
windows make one passage.

The order is that of digests, not of letters, for the text of every kept suffix (80 words each,
one kept in 15 words) would be shuffled, some twelve times the input. Runs and windows are equal
where two independent 64-bit digests are; seeds, which only bring runs together, have one. Hot
seeds are summed on the map side and never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotta.llm.common import last_table, materialise, noted_paths, text_bytes

#: Odd multipliers modulo 2**64, for two digests of word sequences.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Prefixes:
    """Hashes of the word sequences of one text in constant time each."""

    def __init__(self, hashes: np.ndarray, base: int = BASES[0]):
        n = len(hashes)
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(powers)[:-1], dtype=np.uint64)])
        back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        back[0] = 1
        self.back = np.cumprod(back)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


def _word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word."""
    twice = np.array([(x & 0xFFFFFFFFFFFFFFFF, x >> 64) for x in map(xxhash.xxh3_128_intdigest, words)], np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(twice[:, 0]), np.ascontiguousarray(twice[:, 1])


def runs(text: bytes, passage: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of each kept suffix: seed hash, two run digests, first window start, number of windows; and two digests of all windows."""
    words = text.split()
    n = len(words) - passage + 1
    if n < 1:
        return tuple(np.empty(0, kind) for kind in (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.uint64, np.uint64))
    digests = [Prefixes(h, base) for h, base in zip(_word_hashes(words), BASES)]
    at = np.arange(len(words) - seed + 1)
    seeds = digests[0].of(at, at + seed)
    width = passage - seed + 1
    starts = np.arange(n)
    chosen = np.empty(n, np.int64)
    for k in range(0, n, 1 << 16):
        part = seeds[k : k + (1 << 16) + width - 1]
        chosen[k : k + (1 << 16)] = k + np.lib.stride_tricks.sliding_window_view(part, width)[: 1 << 16].argmin(1) + np.arange(min(1 << 16, n - k))
    first = np.concatenate([[0], np.nonzero(np.diff(chosen))[0] + 1])
    count = np.diff(np.concatenate([first, [n]]))
    # where the seed stands in the run, and the run's length, are part of what must be equal
    shape = _mix((chosen[first] - first).astype(np.uint64) << np.uint64(32) | count.astype(np.uint64))
    whole = [_mix(d.of(first, first + count + passage - 1) ^ shape) for d in digests]
    return seeds[chosen[first]], *whole, first, count, *(d.of(starts, starts + passage) for d in digests)


def _suffixes(docs: DataFrame, passage: int, seed: int) -> DataFrame:
    """(seed, run, run2, doc_id, start, n) of the kept suffixes of (doc_id, text)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs(x, passage, seed)[:5] for x in batch.column(1).to_pylist()]
            if found:
                seeds, whole, second, first, count = (np.concatenate(x) for x in zip(*found, strict=True))
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x[0]) for x in found])
                signed = [pa.array(x.view(np.int64)) for x in (seeds, whole, second)]
                yield pa.RecordBatch.from_arrays([*signed, pa.array(ids), pa.array(first), pa.array(count)], names=["seed", "run", "run2", "doc_id", "start", "n"])

    return docs.mapInArrow(over, "seed bigint, run bigint, run2 bigint, doc_id bigint, start bigint, n bigint")


_RUN = ["seed", "run", "run2"]


def _windows(docs: DataFrame, wanted: DataFrame, passage: int, seed: int) -> DataFrame:
    """(seed, run, run2, at, window, window2, first, last) of the windows of the wanted runs (seed, run, run2, first, last).

    first and last are the least and the greatest place (doc_id, start) of a window.
    """
    rest = F.struct(F.col("first.start").alias("start"), "run", "run2", F.col("last.doc_id").alias("last_id"), F.col("last.start").alias("last_start"))
    lists = wanted.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(rest).alias("wanted"))
    names = ["seed", "run", "run2", "at", "window", "window2", "first_id", "first_start", "last_id", "last_start"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            for doc_id, text, rows in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                seeds, whole, second, first, count, windows, windows2 = (x.view(np.int64) for x in runs(text, passage, seed))
                place = {a: k for k, a in enumerate(first.tolist())}
                for row in rows:
                    k = place.get(row["start"])
                    if k is not None and (whole[k], second[k]) == (row["run"], row["run2"]):  # rows that repeat an id can have other texts
                        n, a = int(count[k]), row["start"]
                        steps, full = np.arange(n), lambda x: np.full(n, x)
                        own = windows[a : a + n], windows2[a : a + n]
                        columns = full(seeds[k]), full(row["run"]), full(row["run2"]), steps, *own, full(doc_id), a + steps, full(row["last_id"]), row["last_start"] + steps
                        for column, x in zip(out, columns, strict=True):
                            column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)

    rows = docs.join(lists, "doc_id").select("doc_id", "text", "wanted")
    found = rows.mapInArrow(over, ", ".join(f"{x} bigint" for x in names))
    place = lambda x: F.struct(F.col(f"{x}_id").alias("doc_id"), F.col(f"{x}_start").alias("start")).alias(x)
    return found.select(*names[:6], place("first"), place("last"))


def repeated_spans(
    docs: DataFrame, *, passage: int = 50, seed: int = 20, within_documents: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, start, end): the maximal word spans [start, end) made of windows that come back.

    Words are what stands between ASCII white space, compared as they are. A window is
    ``passage`` words in a row; it comes back where documents with different ids contain it,
    and with ``within_documents`` also where one document does at two places. Documents without
    a repeat have no row, nor have null or shorter texts. Rows without id are left out; rows
    that repeat an id are one document. A very long text is worked on as a whole by its task.
    An empty table gives an empty result; other columns of ``docs`` are ignored, whatever their
    names.
    """
    known = noted_paths(docs.sparkSession)
    again = F.col("first") != F.col("last") if within_documents else F.col("first.doc_id") != F.col("last.doc_id")
    ends = lambda a, b: (F.min(a).alias("first"), F.max(b).alias("last"))
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text")).where("doc_id is not null")
    suffixes = materialise(_suffixes(named, passage, seed), "suffixes")
    place = F.struct("doc_id", "start")
    equal = materialise(suffixes.groupBy(*_RUN).agg(*ends(place, place)), "suffix-runs")
    # seeds that several runs share
    neighbours = equal.groupBy("seed").agg(F.count(F.lit(1)).alias("n_runs"), *ends("first", "last"))
    shared = neighbours.where(again & (F.col("n_runs") > 1)).select("seed")
    windows = materialise(_windows(named, equal.join(shared, "seed", "left_semi"), passage, seed), "windows")
    twice = windows.groupBy("window", "window2").agg(*ends("first", "last")).where(again).select("window", "window2")
    partly = windows.where(~again).join(twice, ["window", "window2"], "left_semi").select(*_RUN, "at")
    whole = equal.where(again).select(*_RUN, F.lit(None).cast("bigint").alias("at"))
    found = suffixes.join(whole.unionByName(partly), _RUN)
    first = F.col("start") + F.coalesce(F.col("at"), F.lit(0))
    last = F.col("start") + F.coalesce(F.col("at"), F.col("n") - 1) + passage
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct(first.alias("start"), last.alias("end"))).alias("spans"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            lists = batch.column(1)
            ends, values = lists.offsets.to_numpy(), lists.values
            starts, stops = (values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), ends, ends[1:]):
                order = np.argsort(starts[a:b], kind="stable")
                s, e = starts[a:b][order], np.maximum.accumulate(stops[a:b][order])
                new = np.concatenate([[0], np.nonzero(s[1:] > e[:-1])[0] + 1]).astype(np.int64)
                out[0].extend([doc_id] * len(new))
                out[1].extend(s[new].tolist())
                out[2].extend(e[np.concatenate([new[1:] - 1, [len(e) - 1]])].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=schema.names)

    return last_table(spans.mapInArrow(merged, schema), "spans", known)


def repeats_by_document(docs: DataFrame, **options) -> DataFrame:
    """One row per document with a repeat: doc_id, n_spans, n_repeated (words), longest, spans (in order).

    The cases of ``repeated_spans`` hold: an empty table gives an empty result, null and short
    texts and rows without id have no row, rows that repeat an id make one.
    """
    spans = repeated_spans(docs, **options)
    size = F.col("end") - F.col("start")
    return spans.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.sum(size).alias("n_repeated"),
        F.max(size).alias("longest"),
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
    )
