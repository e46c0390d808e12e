"""Sorting and packing of keys: what numpy's plain forms give, without their indirect sorts and a compressor for each piece."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from glotta.llm import exchange, ngrams


def key_sets():
    rng = np.random.default_rng(5)
    wide = rng.integers(0, 2**64, 5_000, dtype=np.uint64, endpoint=False)
    yield np.empty(0, np.uint64)
    yield np.array([7], np.uint64)
    yield np.array([2**64 - 1, 0, 2**64 - 1], np.uint64)
    yield rng.integers(0, 50, 5_000)
    yield np.concatenate([wide, wide[::3], wide[:1]])
    # beside far ones, keys that only their lowest bits tell apart, out of order: places don't leave room for these
    yield np.concatenate([wide, wide[:100] ^ np.uint64(1), wide[:100], wide[:100] ^ np.uint64(1)])


@pytest.mark.parametrize("keys", list(key_sets()))
def test_distinct_keys_are_those_of_numpy(keys):
    every, first, place = exchange.distinct(keys)
    want = np.unique(keys, return_index=True, return_inverse=True)
    assert all(x.tolist() == y.tolist() for x, y in zip((every, first, place), want, strict=True))
    assert every.dtype == keys.dtype


@pytest.mark.parametrize("kind", [np.int32, np.uint32, np.int64, np.uint64])
def test_packing_keeps_numbers_and_leaves_out_empty_planes(kind):
    for most in (0, 1, 255, 256, 70_000, 2**31 - 1, np.iinfo(kind).max):
        x = np.array([0, most, 3], kind)
        packed = exchange.pack(x)
        assert exchange.unpack(packed, kind).tolist() == x.tolist()
        assert packed[0] == max(1, (int(x.max()).bit_length() + 7) // 8)
    assert len(exchange.unpack(exchange.pack(np.empty(0, kind)), kind)) == 0
    if kind in (np.int32, np.int64):
        assert exchange.unpack(exchange.pack(np.array([-1, 5], kind)), kind).tolist() == [-1, 5]


def test_packed_keys_come_back():
    for keys in key_sets():
        keys = np.unique(keys.astype(np.uint64))
        assert exchange.unpack_keys(exchange.pack_keys(keys)).tolist() == keys.tolist()


def test_pieces_share_a_compressor(monkeypatch):
    def no(*_, **__):
        raise AssertionError("one compressor for each piece")

    monkeypatch.setattr(exchange.zstandard, "ZstdCompressor", no)
    monkeypatch.setattr(exchange.zstandard, "ZstdDecompressor", no)
    x = np.arange(1, 900, 7, dtype=np.uint64)
    assert exchange.unpack(exchange.pack(x), np.uint64).tolist() == x.tolist()
    assert exchange.unpack_keys(exchange.pack_keys(x)).tolist() == x.tolist()


class Rows:
    """A table whose tasks run here."""

    def __init__(self, batches):
        self.batches = batches

    def mapInArrow(self, over, schema):
        return list(over(iter(self.batches)))


def test_grams_are_counted_without_indirect_sorts(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [b" ".join(b"W%d" % k for k in np.minimum(rng.zipf(1.4, rng.integers(0, 200)), 500)) for _ in range(40)]
    learn = [k % 5 > 0 for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(learn), pa.array(texts, pa.binary())], names=["doc_id", "learn", "text"])
    (chunk,) = ngrams._chunks(Rows([batch]), 10**6)
    row = chunk.to_pylist()[0]

    def no(*_, **__):
        raise AssertionError("an indirect sort")

    with monkeypatch.context() as patched:
        for name in ("unique", "argsort"):
            patched.setattr(np, name, no)
        grams = ngrams.Grams(row["words"], row["stream"])
        keys, n, place = grams.ask_words_and_pairs(learn)
        at, triple_of, own, ask, asked = grams.triples(learn, np.ones(len(grams.pairs), bool))
    want = [Counter(), Counter(), Counter()]
    tokens = [[*text.lower().split(), b" "] for text in texts]
    for t, teaches in zip(tokens, learn, strict=True):
        for size, counts in enumerate(want, 1):
            s = [b" ", *t] if size > 1 else t
            for k in range(len(s) - size + 1):
                counts[tuple(s[k : k + size])] += teaches
    counts = n[place]
    word, pair = counts[: len(grams.words)][grams.stream], counts[len(grams.words) :][grams.pair_of]
    flat = [(b" ", *t[max(0, k - 2) : k + 1])[-3:] if k < 2 else tuple(t[k - 2 : k + 1]) for t in tokens for k in range(len(t))]
    assert word.tolist() == [want[0][x[-1:]] for x in flat]
    assert pair.tolist() == [want[1][x[-2:]] for x in flat]
    assert own[triple_of].tolist() == [want[2][flat[k]] for k in at]
    assert ask.all() and len(asked) == len(own) == len(set(asked.tolist()))
    assert set(keys[(keys & np.uint64(1)) == 1].tolist()) == {xxhash.xxh3_64_intdigest(x) | 1 for (x,) in want[0]}
