"""Sums over all blocks of a corpus for each block's own keys, by a butterfly of shuffles.

A block has up to a few million distinct 64-bit keys, each with a number. Every block is to
learn, for each of its keys, the sum over all blocks. Nearly every key is rare, so a row for
each would cost several times its eight bytes; keys travel packed instead:

1. A block is cut by the first bits of its keys into ``fan`` pieces.
2. Up to ``fan`` blocks' pieces with the same first bits make one group, which has about as many
   keys as one block. While there are more blocks than ``fan``, each group becomes a block of
   its own (a sum of its pieces), and the next bits are cut, and so on.
3. Once all pieces with the same bits are in one group, their sums are the sums over the corpus;
   they go back the way that they came.

So a round moves ``fan`` rows for each block, a group never holds more than about one block, and
there are log(blocks) / log(fan) rounds: what is moved grows with the corpus, not with its square.
A key that all blocks have is one entry of each piece, and one of each sum.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotta.llm.common import materialise

#: Pieces of a block, and blocks in a group; a power of two.
FAN = 512
#: Low bytes of the differences of keys that are as good as random at any number of keys of a block.
NOISE = 5


class _Codecs(threading.local):
    """One compressor for all pieces; made anew for each, they cost more than what they compress."""

    def __init__(self):
        self.compress = zstandard.ZstdCompressor(level=1).compress
        self.decompress = zstandard.ZstdDecompressor().decompress


_CODECS = _Codecs()


def _planes(x: np.ndarray, first: int, last: int) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize)[:, first:last].T).tobytes()


def pack(x: np.ndarray) -> bytes:
    """Integers in byte planes, compressed; planes above the largest number's are left out."""
    x = np.ascontiguousarray(x)
    most = int(x.view(f"u{x.itemsize}").max(initial=0))
    size = max(1, (most.bit_length() + 7) // 8)
    return bytes([size]) + _CODECS.compress(_planes(x, 0, size))


def unpack(x: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(_CODECS.decompress(memoryview(x)[1:]), np.uint8).reshape(x[0], -1)
    if x[0] == np.dtype(kind).itemsize:
        return np.ascontiguousarray(raw.T).reshape(-1).view(kind)
    found = np.zeros((raw.shape[1], np.dtype(kind).itemsize), np.uint8)
    found[:, : x[0]] = raw.T
    return found.reshape(-1).view(kind)


def pack_narrow(x: np.ndarray) -> bytes:
    """Integers of zero or more, in as few byte planes as the largest needs."""
    size = np.min_scalar_type(int(x.max(initial=0))).itemsize
    return bytes([size]) + pack(x.astype(f"u{size}"))


def unpack_narrow(x: bytes) -> np.ndarray:
    return unpack(x[1:], f"u{x[0]}")


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, as differences. Their low bytes are noise, which isn't compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return len(keys).to_bytes(8, "little") + _planes(steps, 0, NOISE) + _CODECS.compress(_planes(steps, NOISE, 8))


def unpack_keys(x: bytes) -> np.ndarray:
    size = int.from_bytes(x[:8], "little")
    planes = np.empty((size, 8), np.uint8)
    planes[:, :NOISE] = np.frombuffer(x, np.uint8, NOISE * size, 8).reshape(NOISE, size).T
    planes[:, NOISE:] = np.frombuffer(_CODECS.decompress(memoryview(x)[8 + NOISE * size :]), np.uint8).reshape(8 - NOISE, size).T
    return np.cumsum(planes.reshape(-1).view(np.uint64), dtype=np.uint64)


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of integers of zero or more, and the integers in it.

    Keys and their places are sorted as single numbers, which is several times faster than an
    indirect sort. Of keys with too many bits the highest take part; where that leaves some out
    of order, the indirect sort follows.
    """
    if not len(keys):
        return np.empty(0, np.int64), keys
    least = keys.min()
    rest = (keys - least).astype(np.uint64, copy=False)
    wide, low = int(rest.max()).bit_length(), (len(keys) - 1).bit_length()
    cut = max(0, wide + low - 64)
    rest >>= np.uint64(cut)
    rest <<= np.uint64(low)
    rest |= np.arange(len(keys), dtype=np.uint64)
    rest.sort()
    order = (rest & np.uint64((1 << low) - 1)).view(np.int64)
    if not cut:
        rest >>= np.uint64(low)
        return order, rest.astype(keys.dtype, copy=False) + least
    found = keys[order]
    if (found[1:] < found[:-1]).any():
        order = np.argsort(keys, kind="stable")
        found = keys[order]
    return order, found


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, where each stands first, and each key's place among them."""
    order, found = ordered(keys)
    new = np.ones(len(keys), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return found[new], order[new], place


def _pieces(blocks: DataFrame, depth: int, groups: int, fan: int) -> DataFrame:
    """(path, digit, grp, block, keys, n) of blocks (path, block, keys, n) whose keys share ``depth`` digits."""
    bits = fan.bit_length() - 1

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, grp, keys, n in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                keys, n = unpack_keys(keys), unpack(n, np.int64)
                digits = (keys << np.uint64(bits * depth)) >> np.uint64(64 - bits)
                found, starts = np.unique(digits, return_index=True)
                ends = [*starts[1:].tolist(), len(keys)]
                size = len(found)
                columns = [
                    pa.array([path] * size, pa.int64()),
                    pa.array(found.astype(np.int32)),
                    pa.array([grp] * size, pa.int32()),
                    pa.array([block] * size, pa.int64()),
                    pa.array([pack_keys(keys[a:b]) for a, b in zip(starts, ends)], pa.binary()),
                    pa.array([pack(n[a:b]) for a, b in zip(starts, ends)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "digit", "grp", "block", "keys", "n"])

    grouped = blocks.select("path", "block", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("grp"), "keys", "n")
    return grouped.mapInArrow(over, "path bigint, digit int, grp int, block bigint, keys binary, n binary")


def _summed(pieces: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The distinct keys of some pieces, their sums, the place of each piece's keys among them, and where pieces end."""
    keys = [unpack_keys(x) for x in pieces["keys"].to_pylist()]
    every, _, place = distinct(np.concatenate(keys))
    n = np.concatenate([unpack(x, np.int64) for x in pieces["n"].to_pylist()])
    sums = np.zeros(len(every), np.int64)
    np.add.at(sums, place, n & ~1)
    shared = np.bincount(place, 1 + (n & 1), len(every)) > 1
    return every, sums | shared, place, np.cumsum([len(x) for x in keys]).tolist()


def _dealt(pieces: pa.Table, sums: np.ndarray, place: np.ndarray, ends: list[int]) -> list[bytes]:
    return [pack(sums[place[a:b]]) for a, b in zip([0, *ends[:-1]], ends)]


def totals(blocks: DataFrame, n_blocks: int, *, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(block, n), and (tokens, distinct) rows, of blocks (block bigint, keys binary, n binary).

    keys are packed, sorted and distinct (``pack_keys``), n packed 64-bit numbers in their order
    (``pack``), all even: twice what is to be summed. The result's n has the sums over all
    blocks in the same order, as the pieces of the block (an array in key order); the lowest bit
    is one where another block has the key, too. The second result, summed over its rows, has
    half the sum over the keys with a lowest bit of one, and how many of them have a sum above
    zero. A block without keys has no row.
    """
    start = blocks.select(F.lit(0).cast("bigint").alias("path"), "block", "keys", "n")
    return _totals(start, n_blocks, 0, fan)


def _totals(blocks: DataFrame, n_blocks: int, depth: int, fan: int) -> tuple[DataFrame, DataFrame]:
    bits = fan.bit_length() - 1
    if n_blocks <= fan or (depth + 1) * bits > 56:
        pieces = _pieces(blocks, depth, 1, fan)

        def answer(group: pa.Table) -> pa.Table:
            every, sums, place, ends = _summed(group)
            own = sums[(every & np.uint64(1)) == 1] >> 1
            rest = [0] * (len(ends) - 1)
            marks = [pa.array([int(own.sum()), *rest], pa.int64()), pa.array([int((own > 0).sum()), *rest], pa.int64())]
            return pa.table([group["block"], group["digit"], pa.array(_dealt(group, sums, place, ends), pa.binary()), *marks], names=["block", "digit", "n", "tokens", "distinct"])

        schema = "block bigint, digit int, n binary, tokens bigint, distinct bigint"
        answers = materialise(pieces.groupBy("path", "digit").applyInArrow(answer, schema), "sums")
        marks = answers.select("tokens", "distinct")
    else:
        groups = -(-n_blocks // fan)
        pieces = materialise(_pieces(blocks, depth, groups, fan), "pieces")

        def merged(group: pa.Table) -> pa.Table:
            every, sums, _, _ = _summed(group)
            path = group["path"][0].as_py() * fan + group["digit"][0].as_py()
            return pa.table({"path": pa.array([path], pa.int64()), "grp": group["grp"].slice(0, 1), "keys": pa.array([pack_keys(every)], pa.binary()), "n": pa.array([pack(sums)], pa.binary())})

        joint = materialise(pieces.groupBy("path", "digit", "grp").applyInArrow(merged, "path bigint, grp int, keys binary, n binary"), "joint-blocks")
        named = F.xxhash64("path", "grp").alias("block")
        above, marks = _totals(joint.select("path", named, "keys", "n"), groups, depth + 1, fan)
        own = F.xxhash64(F.col("path") * fan + F.col("digit"), F.col("grp")).alias("joint")
        left = pieces.select(own, "block", "digit", "keys", "n").groupBy("joint")
        right = above.select(F.col("block").alias("joint"), F.col("n").alias("parts")).groupBy("joint")

        def back(group: pa.Table, whole: pa.Table) -> pa.Table:
            _, _, place, ends = _summed(group)
            sums = np.concatenate([unpack(x, np.int64) for x in whole["parts"][0].as_py()])
            return pa.table([group["block"], group["digit"], pa.array(_dealt(group, sums, place, ends), pa.binary())], names=["block", "digit", "n"])

        answers = materialise(left.cogroup(right).applyInArrow(back, "block bigint, digit int, n binary"), "sums")
    lists = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("digit", "n"))).alias("x"))
    return lists.select("block", F.col("x.n").alias("n")), marks
