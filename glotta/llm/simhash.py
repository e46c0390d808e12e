"""Near-duplicates by SimHash with the generalised pigeonhole principle.

1. Every text gets a 64-bit fingerprint of its word shingles; equal fingerprints are one node.
2. The bits are put into groups of 16 so that correlated bits share a group (a co-occurrence
   count over all fingerprints). The exact histogram of each group gives the number of pairs of
   fingerprints at each distance within the group.
3. Groups may be joined to wider partitions. With m partitions, thresholds e_i >= -1 that sum
   to t - m + 1 suffice: two fingerprints that differ in t bits or fewer are within e_i bits of
   each other in some partition i. For each layout a dynamic programme allocates the thresholds
   to the least estimated cost (candidates plus probes); the cheapest layout is taken. The
   choice changes cost only, never the links that are found.
4. Every fingerprint is put under its partition value and those that differ in up to half of e_i
   bits, rounded up, so that any two within e_i bits meet. Each bucket's candidates are verified with a population count; what leaves a task
   is a spanning forest of the verified links, never all pairs. A bucket above ``block`` rows is
   dealt to several tasks as blocks of its chunks.
5. Connected components over the forests give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotta.llm.common import last_table, map_texts, materialise, noted_paths
from glotta.llm.graph import connected_components

BITS, GROUP_BITS, SEED = 64, 16, 42
#: Partitions are made of these base groups of 16 bits.
LAYOUTS = [[(0,), (1,), (2,), (3,)], *([(a,), (b,), tuple(sorted({0, 1, 2, 3} - {a, b}))] for a, b in combinations(range(4), 2)), *([(0, a), tuple(sorted({1, 2, 3} - {a}))] for a in (1, 2, 3))]
#: A probe in a block costs about this many candidate comparisons.
PROBE_COST = 20
MOST_VARIANTS = 600


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of the text as an unsigned integer; a text without words has zero."""
    import xxhash

    words = text.lower().split()  # of bytes: lower() changes A-Z only, split() is at \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    elif shingle == 3:
        parts = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:])]
    else:
        parts = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    hash_ = xxhash.xxh64_intdigest
    return of_hashes(np.fromiter((hash_(x, SEED) for x in parts), np.uint64, len(parts)))


def of_hashes(hashes: np.ndarray) -> int:
    """The SimHash of a text's shingle hashes, repeats included; without any it is zero."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, *, name: str = "fp", shingle: int = 3, text_col: str = "text") -> DataFrame:
    """``docs`` with the fingerprint of every whole text, as a signed 64-bit integer."""

    def each(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64))]

    return map_texts(docs, [T.StructField(name, T.LongType())], each, text_col)


@dataclass(frozen=True)
class Partition:
    mask: int
    threshold: int


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_groups(nodes: DataFrame) -> list[list[int]]:
    """Four groups of 16 bits; each starts with the first bit left and takes those most correlated with it."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS), pa.int32()), pa.array(both.ravel()), pa.array([float(n)] * BITS * BITS)], names=["at", "x", "n"])

    rows = nodes.select("fp").mapInArrow(over, "at int, x double, n double").groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    both, n = np.zeros(BITS * BITS), max([1.0, *(r["n"] for r in rows)])
    for r in rows:
        both[r["at"]] = r["x"]
    both = both.reshape(BITS, BITS) / n
    mean = np.diag(both)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tied = np.abs(both - np.outer(mean, mean)) / np.outer(spread, spread)
    left, groups = list(range(BITS)), []
    while left:
        group = [left.pop(0)]
        while len(group) < GROUP_BITS:
            best = max(left, key=lambda b: (sum(tied[b, g] for g in group), -b))
            left.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def pair_counts(nodes: DataFrame, groups: list[list[int]], most: int) -> np.ndarray:
    """For each group, the number of ordered pairs of fingerprints at distance 0..most within it.

    The histograms have at most 2**16 values a group, so they fit the driver at any input size.
    """
    masks = [sum(1 << b for b in g) for g in groups]
    parts = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for k, m in enumerate(masks)))
    found = nodes.select(F.explode(parts).alias("x")).groupBy("x.k", "x.value").agg(F.count(F.lit(1)).alias("n")).toPandas()
    out = np.zeros((len(groups), most + 1))
    for k, group in enumerate(groups):
        own = found[found["k"] == k]
        values = own["value"].to_numpy(np.int64).view(np.uint64)
        short = np.zeros(len(values), np.int64)
        for at, bit in enumerate(group):
            short |= ((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << at
        count = np.zeros(1 << GROUP_BITS)
        count[short] = own["n"]
        apart = np.maximum(_hadamard(_hadamard(count) ** 2) / (1 << GROUP_BITS), 0)  # pairs by the exclusive or of their values
        out[k] = np.bincount(np.bitwise_count(np.arange(1 << GROUP_BITS)), apart, most + 1)[: most + 1]
    return out


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of a vector whose length is a power of two."""
    width = 1
    while width < len(x):
        a, b = x.reshape(-1, 2, width).swapaxes(0, 1)
        x = np.stack([a + b, a - b], 1).reshape(-1)
        width *= 2
    return x


def radius(threshold: int) -> int:
    """The bits that both sides of a pair within ``threshold`` bits change at most to have a value in common."""
    return (threshold + 1) // 2


def allocate(widths: list[int], candidates: list[list[float]], n: float, total: int) -> tuple[float, list[int]]:
    """The thresholds (-1 or more, summing to ``total``) of least cost; candidates[i][e]: pairs within e bits."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for width, counts in zip(widths, candidates, strict=True):
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for e in range(-1, len(counts)):
                variants = sum(comb(width, d) for d in range(radius(e) + 1))
                if variants > MOST_VARIANTS:
                    break
                met = counts[min(2 * radius(e), len(counts) - 1)]
                own = cost + (PROBE_COST * n * variants + met if e >= 0 else 0)
                if used + e not in after or own < after[used + e][0]:
                    after[used + e] = own, [*chosen, e]
        best = after
    return best.get(total, (float("inf"), []))


def plan_partitions(nodes: DataFrame, distance: int = 3) -> list[Partition]:
    """The partitions and thresholds by which ``nodes`` (fp) are probed; a distance that none can serve is refused."""
    groups = bit_groups(nodes)
    pairs = pair_counts(nodes, groups, distance)
    n = max(1.0, nodes.count())
    best = (float("inf"), [], [])
    for layout in LAYOUTS:
        candidates, widths = [], []
        for part in layout:
            share = np.array([1.0, *[0.0] * distance])
            for g in part:  # groups are taken as independent, as correlated bits share one
                share = np.convolve(share, pairs[g] / n**2)[: distance + 1]
            candidates.append(list(np.cumsum(share) * n**2))
            widths.append(GROUP_BITS * len(part))
        cost, chosen = allocate(widths, candidates, n, distance - len(layout) + 1)
        if cost < best[0]:
            best = cost, layout, chosen
    if best[0] == float("inf"):
        raise ValueError(f"no partitions of {BITS} bits find all links at distance {distance} with {MOST_VARIANTS} probes of each or fewer")
    return [Partition(sum(1 << b for g in part for b in groups[g]), e) for part, e in zip(best[1], best[2], strict=True) if e >= 0]


@lru_cache
def flips(mask: int, most: int) -> tuple[int, ...]:
    """All changes of up to ``most`` bits of the mask."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    return tuple(_signed(sum(1 << b for b in x)) for d in range(most + 1) for x in combinations(bits, d))


def _forest(fp: np.ndarray, node: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node) of the components within each run of equal ``group``."""
    n = len(fp)
    left, right, apart = [], [], 1
    open_ = np.arange(n)
    while len(open_):
        open_ = open_[open_ + apart < n]
        open_ = open_[group[open_] == group[open_ + apart]]
        near = open_[np.bitwise_count(fp[open_] ^ fp[open_ + apart]) <= distance]
        left.append(near)
        right.append(near + apart)
        apart += 1
    a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (left, right))
    root, before = np.arange(n), None
    while before is None or (root != before).any():
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
    moved = np.nonzero(node != node[root])[0]
    return node[moved], node[root[moved]]


def links(nodes: DataFrame, partitions: list[Partition], distance: int = 3, block: int = 1024) -> DataFrame:
    """(a, b): a spanning forest of each block of the links between ``nodes`` (fp, node)."""
    parts = [
        nodes.select(
            F.lit(k).alias("part"),
            F.explode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(p.mask))).bitwiseXOR(F.lit(x)) for x in flips(p.mask, radius(p.threshold))))).alias("key"),
            "fp",
            "node",
        )
        for k, p in enumerate(partitions)
    ]
    probes = parts[0]
    for x in parts[1:]:
        probes = probes.unionByName(x)
    sizes = probes.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / block).cast("int")
    chunk = F.pmod(F.hash("fp"), chunks)
    dealt = (
        probes.join(sizes, ["part", "key"])
        .select("part", "key", "fp", "node", chunk.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        .select("part", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "node")
        .repartition("part", "key", "i", "j")
        .sortWithinPartitions("part", "key", "i", "j")
        .select(F.xxhash64("part", "key", "i", "j").alias("bucket"), "fp", "node")
    )

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 3

        def forest(group, fp, node):
            a, b = _forest(fp, node, group, distance)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held = [np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False)]) for k, x in enumerate(held)]
            other = np.nonzero(held[0] != held[0][-1])[0] if len(held[0]) else []
            if len(other):  # whole buckets; the last may go on in the next batch
                last = int(other[-1]) + 1
                yield forest(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if len(held[0]):
            yield forest(*held)

    return dealt.mapInArrow(over, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, block: int = 1024) -> DataFrame:
    """One row per document: doc_id, fp, fingerprint (16 hexadecimal digits), component_id.

    Documents link where their fingerprints differ in ``distance`` bits or fewer; component_id
    is the smallest doc_id that is reached over links, the own included. Null texts count as
    empty; texts without words have the fingerprint zero and link like any other. A row without
    id gets its fingerprint and a null component, and links nothing. A repeated id is the same
    document said again: its rows are linked. An empty table gives an empty result; other
    columns of ``docs`` are ignored, whatever their names; texts of any length are read whole.
    """
    known = noted_paths(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialise(with_fingerprint(named, shingle=shingle).select("doc_id", "fp"), "simhash")
    nodes = materialise(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    found = links(nodes, plan_partitions(nodes, distance), distance, block)
    repeats = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high").select("doc_id")
    same = prints.join(repeats, "doc_id", "left_semi").join(nodes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    parts = connected_components(found.unionByName(same))
    placed = nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    rows = prints.join(placed, "fp", "left").select(
        "doc_id",
        "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
    return last_table(rows, "simhash-groups", known)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the row of the smallest id of each group; rows without id stay. All columns stay."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
