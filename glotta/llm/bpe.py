"""Byte-level BPE with a public vocabulary: encoding and decoding.

Each piece of text that the pattern matches is encoded separately. A segment tree over its byte
positions holds, in every node, the leftmost minimum of the pair ranks below. A merge reads the
root, joins the two neighbours and updates three leaves (the joined pair, the pair before and
the pair that went) and their ancestors: a logarithmic number of nodes. The trees of many short
pieces stand side by side in one matrix and take their merges together; a long piece gets a
tree of its own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glotta.llm.common import broadcast_value, map_texts

#: Longer pieces get a tree of their own.
SIDE_BY_SIDE = 64
#: Above every leaf of a tree, and above every rank.
NONE = np.int32(2**31 - 1)
NO_RANK = np.int32(2**24)
POS_BITS = 32
#: Chunks of text remembered by a worker; the memory is emptied when it is full.
REMEMBERED = 200_000
#: The pattern for which a cut before every single space is known to leave the pieces as they are.
SPACE_CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_AFTER_SPACE_ASCII = [" " + c for c in " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"]
_AFTER_SPACE = [" " + chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _amid_white(text: str) -> bool:
    """Whether white space stands after a space, so that the space can be amid a run of it."""
    return any(x in text for x in _AFTER_SPACE_ASCII) or not text.isascii() and any(x in text for x in _AFTER_SPACE)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def tokens_of(ranks: dict[bytes, int]) -> pa.Array:
    """The bytes of every id."""
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return pa.array(table, pa.large_binary())


def decoded_lists(tokens: pa.Array, lists: pa.ListArray) -> pa.Array:
    """The bytes of all ids stand one after another; a row's bytes end where its last id's do."""
    taken = tokens.take(lists.flatten())
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
    ends = np.frombuffer(taken.buffers()[1], np.int64)[sizes] if len(taken) else sizes * 0
    text = memoryview(taken.buffers()[2]) if len(taken) else b""
    return pa.array([bytes(text[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())


class BytePairCoder:
    """Encodes and decodes with given ranks; ``pattern`` splits text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        # \s of the vocabulary's own engine is the White_Space property
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        # this pattern's pieces never go on over a space after another character, so a text can be cut there
        self.cuts_at_spaces = pattern == SPACE_CUT_PATTERN
        self.ranks = ranks
        self.tokens = tokens_of(ranks)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << POS_BITS | right)
                    merged.append(rank)
        self._fill_slots(np.array(keys, np.int64), np.array(merged, np.int32))
        self.known: dict[str, bytes] = {}

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged rank of each pair, or NO_RANK: hashed slots, probed until key or gap."""
        keys = left.astype(np.int64) << POS_BITS | right
        slot = self._slots_of(keys)
        out = np.where(self.slot_keys[slot] == keys, self.slot_ranks[slot], NO_RANK)
        open_ = np.nonzero((self.slot_keys[slot] != keys) & (self.slot_keys[slot] >= 0))[0]
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.slot_keys) - 1)
            there = self.slot_keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.slot_ranks[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def _slots_of(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def _fill_slots(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """A table of four slots a pair, linear probing."""
        self.slot_bits = max(4, int(4 * len(keys)).bit_length())
        self.slot_keys = np.full(1 << self.slot_bits, -1, np.int64)
        self.slot_ranks = np.full(1 << self.slot_bits, NO_RANK, np.int32)
        slot, left = self._slots_of(keys), np.arange(len(keys))
        while len(left):
            free = left[self.slot_keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.slot_keys[slot[placed]], self.slot_ranks[slot[placed]] = keys[placed], ranks[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            taken = left[self.slot_keys[slot[left]] != keys[left]]
            slot[taken] = (slot[taken] + 1) & (len(self.slot_keys) - 1)

    def merge_side_by_side(self, pieces: Sequence[bytes]) -> list[bytes]:
        """The ids of each piece as int32 bytes; the trees of all pieces are one flat array."""
        n, width = len(pieces), 2
        size = np.fromiter(map(len, pieces), np.int64, n)
        while width < size.max():
            width *= 2
        bits = width.bit_length() - 1
        filled = np.arange(width)[None, :] < size[:, None]
        grid = np.zeros((n, width), np.int32)
        grid[filled] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        leaves = np.full((n, width), NONE, np.int32)
        row, at = np.nonzero(filled[:, 1:])
        found = self._ranks_of(grid[row, at], grid[row, at + 1])
        leaves[row, at] = np.where(found < NO_RANK, found << bits | at, NONE)
        tree = np.empty((n, 2 * width), np.int32)
        tree[:, width:] = leaves
        for level in range(bits - 1, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        ids, tree, live = grid.ravel(), tree.ravel(), filled.copy().ravel()
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), n)
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), n)
        rows = np.nonzero(tree[1 :: 2 * width] < NONE)[0]
        while len(rows):
            base, trunk = rows * width, rows * (2 * width)
            root = tree[trunk + 1]
            left, rank = root & (width - 1), root >> bits
            right = after[base + left]
            ids[base + left] = rank
            live[base + right] = False
            beyond, prior = after[base + right], before[base + left]
            after[base + left] = beyond
            tree[trunk + width + right] = NONE
            tree[trunk + width + left] = NONE
            k = np.nonzero(beyond < size[rows])[0]
            before[base[k] + beyond[k]] = left[k]
            joined = self._ranks_of(rank[k], ids[base[k] + beyond[k]])
            tree[trunk[k] + width + left[k]] = np.where(joined < NO_RANK, joined << bits | left[k], NONE)
            k = np.nonzero(prior >= 0)[0]
            joined = self._ranks_of(ids[base[k] + prior[k]], rank[k])
            tree[trunk[k] + width + prior[k]] = np.where(joined < NO_RANK, joined << bits | prior[k], NONE)
            for leaf in (right, left, np.maximum(prior, 0)):
                node = (leaf + width) >> 1
                for _ in range(bits):
                    under = trunk + 2 * node
                    tree[trunk + node] = np.minimum(tree[under], tree[under + 1])
                    node >>= 1
            rows = rows[tree[trunk + 1] < NONE]
        flat = ids[live].tobytes()
        ends = np.cumsum(live.reshape(n, width).sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge_alone(self, piece: bytes) -> bytes:
        """The ids of one long piece: the same tree, in a list."""
        n, width, none = len(piece), 1, 1 << 62
        while width < n:
            width *= 2
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\x01" * n)
        bits, top, keys, ranks = 64 - self.slot_bits, len(self.slot_keys) - 1, self.slot_keys, self.slot_ranks

        def leaf(p: int) -> int:
            q = after[p]
            if q >= n:
                return none
            key = ids[p] << POS_BITS | ids[q]
            slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> bits
            while (there := keys[slot]) != key:
                if there < 0:
                    return none
                slot = slot + 1 & top
            return int(ranks[slot]) << POS_BITS | p

        tree = [none] * (2 * width)
        for p in range(n - 1):
            tree[width + p] = leaf(p)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(p: int, value: int) -> None:
            node = width + p
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                a = a if a < b else b
                if tree[node] == a:
                    break
                tree[node] = a

        while width > 1 and tree[1] < none:
            left, rank = tree[1] & ((1 << POS_BITS) - 1), tree[1] >> POS_BITS
            right = after[left]
            ids[left], live[right] = rank, 0
            after[left] = beyond = after[right]
            if beyond < n:
                before[beyond] = left
            put(right, none)
            put(left, leaf(left))
            if before[left] >= 0:
                put(before[left], leaf(before[left]))
        return np.array([i for i, x in zip(ids, live, strict=True) if x], np.int32).tobytes()

    def _merged(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece."""
        raws = [x.encode("utf-8") for x in pieces]
        whole = list(map(self.ranks.get, raws))
        found = {x: np.int32(i).tobytes() for x, i in zip(pieces, whole) if i is not None}
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        size[[i is not None for i in whole]] = 0
        order = np.argsort(size, kind="stable")
        ends = np.searchsorted(size[order], [0, *(1 << k for k in range(1, SIDE_BY_SIDE.bit_length()))], "right")
        for a, b in zip(ends, ends[1:]):  # pieces of up to 2, 4, 8, ... bytes
            for k in range(a, b, 8192):
                part = order[k : min(k + 8192, b)].tolist()
                found.update(zip((pieces[i] for i in part), self.merge_side_by_side([raws[i] for i in part]), strict=True))
        found.update((pieces[i], self.merge_alone(raws[i])) for i in order[ends[-1] :].tolist())
        return found

    def _chunks(self, text: str) -> list[str]:
        """The text in chunks that are encoded separately: before each space, else by pieces.

        A space amid white space would cut its run, so texts with one go by pieces.
        """
        if not self.cuts_at_spaces or _amid_white(text):
            return self.pieces(text)
        words = text.split(" ")
        return [words[0], *(" " + w for w in words[1:])]

    def _pieces_of(self, chunks: Iterable[str]) -> tuple[list[str], dict[str, list[str]]]:
        """The chunks that are one piece, and the pieces of each other one.

        Chunks that begin with a space and have no other white space at their ends are split in one go.
        """
        single, several, plain = [], {}, []
        for x in chunks:
            if self.cuts_at_spaces and x[:1] == " " and not (x[1:2].isspace() or x[-1:].isspace()):
                plain.append(x)
            else:
                several[x] = self.pieces(x)
        following = iter(self.pieces("".join(plain)))
        for x in plain:
            piece = next(following)
            left = len(x) - len(piece)
            if not left:
                single.append(x)
                continue
            several[x] = parts = [piece]
            while left:
                parts.append(next(following))
                left -= len(parts[-1])
        return single, several

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as int32 bytes."""
        out, start, known = [], 0, self.known
        while start < len(texts):
            split, held, end = [], 0, start
            while end < len(texts) and held < 1_000_000:  # characters that are in chunks at a time
                split.append(self._chunks(texts[end]))
                held += len(texts[end])
                end += 1
            if len(known) > REMEMBERED:
                known.clear()
            single, several = self._pieces_of(set().union(*split).difference(known))
            found = self._merged(list(set(single).union(*several.values())))
            known.update(zip(single, map(found.__getitem__, single), strict=True))
            known.update((x, b"".join(map(found.__getitem__, p))) for x, p in several.items())
            out += [b"".join(map(known.__getitem__, chunks)) for chunks in split]
            start = end
        return out

    def encode_lists(self, texts: list[bytes]) -> pa.ListArray:
        """The ids of each text of UTF-8 bytes."""
        found = self.encode_batch([x.decode("utf-8", "replace") for x in texts])
        ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_lists(pa.array([ids], pa.list_(pa.int32())))[0].as_py()

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids; null or no ids give none."""
        return decoded_lists(self.tokens, lists)


_IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
_DECODED = T.StructField("decoded", T.BinaryType())
#: One coder for a worker: what it remembers serves all its tasks.
_coders: dict[tuple[str, str], BytePairCoder] = {}


def coder_of(ranks_path: str, pattern: str, ranks: dict[bytes, int]) -> BytePairCoder:
    """This worker's coder of a vocabulary."""
    if (ranks_path, pattern) not in _coders:
        _coders[ranks_path, pattern] = BytePairCoder(ranks, pattern)
    return _coders[ranks_path, pattern]


def encode(docs: DataFrame, *, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the token ids of every whole text in ``ids`` (array of int), without special tokens.

    Null counts as empty; empty texts have no ids. Repeated rows are encoded again; an empty table
    gives an empty one. A column ``ids`` of ``docs`` is replaced, all others stay.
    """
    ranks = broadcast_value(docs, read_ranks(ranks_path))

    def each(texts: list[bytes]) -> list[pa.Array]:
        return [coder_of(ranks_path, pattern, ranks.value).encode_lists(texts)]

    return map_texts(docs, [_IDS], each, text_col)


def encode_and_decode(docs: DataFrame, *, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``encode``, then ``decode`` of the ids, in one pass of the same workers: ``docs`` with ids and decoded."""
    ranks = broadcast_value(docs, read_ranks(ranks_path))

    def each(texts: list[bytes]) -> list[pa.Array]:
        coder = coder_of(ranks_path, pattern, ranks.value)
        ids = coder.encode_lists(texts)
        return [ids, coder.decode_lists(ids)]

    return map_texts(docs, [_IDS, _DECODED], each, text_col)


def decode(encoded: DataFrame, *, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the bytes that the ids of ``ids_col`` stand for in ``decoded``; null or no ids give no bytes.

    The bytes are those of the text, so casting them to string gives it back. A column ``decoded``
    is replaced.
    """
    ranks = broadcast_value(encoded, read_ranks(ranks_path))
    kept = [x for x in encoded.schema if x.name != "decoded"]
    schema = T.StructType([*kept, _DECODED])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(ranks.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                at = batch.schema.get_field_index
                made = decoded_lists(tokens, batch.column(at(ids_col)))
                yield pa.RecordBatch.from_arrays([*(batch.column(at(x.name)) for x in kept), made], names=schema.names)

    return encoded.mapInArrow(over, schema)
