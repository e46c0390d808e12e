"""The near-dedup stage against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest

import corpus_pipeline
from glotta.llm import jaccard
from tests.llm.test_operators import components

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w)} if 0 < len(w) <= 5 else {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)}


def kept_of(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    alike = lambda a, b: not (a or b) or 5 * len(a & b) >= 4 * len(a | b)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if alike(sets[a], sets[b])]
    return set(components(ids, pairs).values()), pairs


def test_stage_keeps_one_of_each_group(spark):
    docs = corpus_pipeline.exact_dedup(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    want, pairs = kept_of({r["doc_id"]: r["text"] for r in docs.collect()})
    assert pairs and {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == want


@pytest.mark.parametrize("block", [1024, 3])
def test_similarities_around_the_bound(spark, block):
    """Copies with some words changed, one after another and all from one text; short texts and a common line."""
    rng = random.Random(3)
    line = " ".join(f"c{k}" for k in range(12))
    texts = {1: None, 2: "  ", 3: "A b", 4: "a B", 5: "a b c d e", 6: "a b c d e f"}
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([15, 60, 150]))]
        for _ in range(9):
            texts[len(texts) + 1] = " ".join(words) + (f" {line}" if base % 2 else "")
            new = list(words)
            for _ in range(rng.choice([1, 1, 2, 4])):
                new[rng.randrange(len(new))] = f"x{rng.randrange(9999)}"
            words = new if base % 3 else words[:-1] + [f"y{rng.randrange(9999)}"]
    want, pairs = kept_of(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    assert len(pairs) > 100 and {r["doc_id"] for r in jaccard.keep_one(docs, block=block).collect()} == want


@pytest.mark.parametrize("n", [1, 319, 330, 700, 5000, 200_000])
def test_counts_rule_out_no_pair_that_is_alike(n):
    """Sets at the bound, also where one has finer counts than the other or counts beyond 255, and sets that are far apart."""
    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 2**64, n, np.uint64))
    for cut in (0, n // 5, n // 9):
        b = np.concatenate([a[: n - cut], rng.integers(0, 2**64, min(cut, (n - cut) // 4 - cut) if cut == n // 9 else 0, np.uint64)])
        if not 5 * (n - cut) >= 4 * (n + len(b) - (n - cut)):
            continue
        fine = [jaccard.sketch(x, jaccard.fine_buckets(len(x))) if jaccard.fine_buckets(len(x)) > jaccard.SKETCH else b"" for x in (a, b)]
        coarse = [np.frombuffer(jaccard.sketch(x, jaccard.SKETCH), np.uint8).reshape(1, -1) for x in (a, b)]
        assert jaccard._possible(np.array([len(a)]), np.array([len(b)]), *coarse).all()
        assert jaccard._finely_possible(len(a), len(b), *fine)
    if 330 <= n <= 5000:
        other = rng.integers(0, 2**64, n, np.uint64)
        fine = [jaccard.sketch(x, jaccard.fine_buckets(n)) for x in (a, other)]
        assert not jaccard._finely_possible(n, n, *fine)
