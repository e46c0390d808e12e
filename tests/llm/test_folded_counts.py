"""The EM reads each chunk's distinct counts, which give the sums of all its tokens."""

import numpy as np

from glotta.llm import exchange, ngrams


def test_folded_counts_give_the_sums_of_all_tokens():
    random = np.random.default_rng(3)
    word, context, pair, wide, triple = (np.minimum(random.zipf(1.5, 20_000), 10**6) - 1 for _ in range(5))
    pair = np.minimum(pair, np.minimum(word, context))
    triple = np.minimum(triple, np.minimum(pair, wide))
    counts = ngrams.Counts(word, pair, triple, context, wide)
    folded, tries = counts.folded()
    assert len(folded.word) < 0.6 * len(word) and folded.times.sum() == len(word)
    narrow = ngrams.Counts(*(exchange.unpack_narrow(exchange.pack_narrow(getattr(folded, x))) for x in folded.__dataclass_fields__))
    weights = ngrams.Weights.of(random.random(4 * ngrams.BUCKETS + 2) * 100)
    every = weights.sums(counts, 1e6, 1e-5)
    for some in (folded, narrow):
        assert np.allclose(weights.sums(some, 1e6, 1e-5, tries), every, rtol=1e-10, atol=1e-7)


def test_no_counts_fold_to_none():
    folded, tries = ngrams.Counts(*[np.empty(0, np.int64)] * 5).folded()
    assert not tries.any() and not ngrams.Weights.even().sums(folded, 1.0, 0.5, tries).any()
    assert len(exchange.unpack_narrow(exchange.pack_narrow(folded.word))) == 0


def test_narrow_packing_keeps_large_numbers():
    for most in (0, 255, 256, 65_536, 2**32, 2**40):
        x = np.array([0, most, 1], np.int64)
        assert exchange.unpack_narrow(exchange.pack_narrow(x)).astype(np.int64).tolist() == x.tolist()
