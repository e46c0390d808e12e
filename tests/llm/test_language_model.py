"""Deleted interpolation against a plain version: counts in dictionaries, EM token by token."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glotta.llm import exchange, ngrams, queries
from tests.llm.test_operators import docs, low, texts  # noqa: F401


def bucket(n):
    return n if n <= 8 else n.bit_length() + 5


def plain_model(tokens, learn, rounds=200):
    """Counts, weights and the log10 probability of each text."""
    c1, c2, c3, one, two = Counter(), Counter(), Counter(), Counter(), Counter()
    grams = {}
    for i, t in tokens.items():
        grams[i] = [(u, v, w) for u, v, w in zip([None, " ", *t], [" ", *t], t)]  # the first has no trigram
        if learn[i]:
            for u, v, w in grams[i]:
                c1[w] += 1
                c2[v, w] += 1
                one[v] += 1
                if u is not None:
                    c3[u, v, w] += 1
                    two[u, v] += 1
    total, base = sum(c1.values()), 1 / (len(c1) + 1)

    def counts(u, v, w, less):
        three, wide = (c2[v, w], one[v]) if u is None else (c3[u, v, w], two[u, v])
        return three - less, wide - less, c2[v, w] - less, one[v] - less, c1[w] - less

    a3, a2, a1 = defaultdict(lambda: 0.5), defaultdict(lambda: 0.5), 0.5

    def parts(c, n):
        x3, x2 = (a3[bucket(c[1])] if c[1] else 0), (a2[bucket(c[3])] if c[3] else 0)
        rest = (1 - x3) * (1 - x2)
        return x3 * c[0] / max(c[1], 1), (1 - x3) * x2 * c[2] / max(c[3], 1), rest * a1 * c[4] / max(n, 1), rest * (1 - a1) * base

    rows = Counter(counts(*g, 1) for i, t in grams.items() if learn[i] for g in t)
    for _ in range(rounds):
        use3, try3, use2, try2, use1, try1 = Counter(), Counter(), Counter(), Counter(), 0, 0
        for c, n in rows.items():
            p = parts(c, total - 1)
            s3, s2, s1 = (n * x / sum(p) for x in p[:3])
            use3[bucket(c[1])] += s3
            try3[bucket(c[1])] += n
            use2[bucket(c[3])] += s2
            try2[bucket(c[3])] += n - s3
            use1, try1 = use1 + s1, try1 + n - s3 - s2
        a3.update({b: (use3[b] + 1) / (n + 2) for b, n in try3.items()})
        a2.update({b: (use2[b] + 1) / (n + 2) for b, n in try2.items()})
        a1 = (use1 + 1) / (try1 + 2)
    return c1, total, {i: sum(math.log10(sum(parts(counts(*g, 0), total))) for g in t) for i, t in grams.items()}


@pytest.mark.parametrize("options", [{}, {"chunk_tokens": 3000, "fan": 4}])
def test_query_columns(docs, texts, options):  # noqa: F811
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", low(t or "")), " "] for i, t in texts.items()}
    learn = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in tokens}
    counts, total, scores = plain_model(tokens, learn)
    rows = {r["doc_id"]: r for r in ngrams.score_documents(docs, learn=queries.id_crc("doc_id", 7) != 2, **options).collect()}
    assert rows.keys() == tokens.keys()
    for i, t in tokens.items():
        r = rows[i]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not learn[i], len(t), sum(counts[w] > 0 for w in t), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        # the EM stops near its end, so a token's logarithm is off by a few thousandths at most
        assert abs(r["score"] - scores[i]) < 5e-3 * len(t)
    held = [r for i, r in rows.items() if not learn[i]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def blocks_of(spark, blocks):
    rows = [(k, exchange.pack_keys(np.array(sorted(b), np.uint64)), exchange.pack(2 * np.array([b[x] for x in sorted(b)], np.int64))) for k, b in enumerate(blocks)]
    return spark.createDataFrame([(a, bytearray(b), bytearray(c)) for a, b, c in rows], "block bigint, keys binary, n binary")


@pytest.mark.parametrize("fan", [2, 4, 256])
def test_exchange_sums_numbers_beyond_32_bits(spark, fan):
    """Every block gets the sums of its keys, through as many rounds as it takes; sums pass 2**32."""
    rng = np.random.default_rng(2)
    common = [2 * int(x) + 1 for x in rng.integers(0, 2**63, 20, dtype=np.int64)]
    blocks = [{**{x: 2**31 + k for x in common}, **{int(x): k for x in rng.integers(0, 2**63, 30, dtype=np.int64)}} for k in range(9)]
    want = Counter()
    for b in blocks:
        want.update(b)
    sums, marks = exchange.totals(blocks_of(spark, blocks), len(blocks), fan=fan)
    for r in sums.collect():
        got = np.concatenate([exchange.unpack(bytes(x), np.int64) for x in r["n"]])
        assert got.tolist() == [2 * want[k] + (k in common) for k in sorted(blocks[r["block"]])]
    odd = [n for k, n in want.items() if k & 1]
    assert max(odd) > 2**32
    assert tuple(marks.agg(F.sum("tokens"), F.sum("distinct")).first()) == (sum(odd), sum(n > 0 for n in odd))


def test_exchange_moves_fan_rows_a_block(spark):
    """Rows grow with the number of blocks, not with its square."""
    rng = np.random.default_rng(3)
    blocks = [{int(x): 1 for x in rng.integers(0, 2**63, 200, dtype=np.int64)} for _ in range(12)]
    few, many = (exchange._pieces(blocks_of(spark, b).withColumn("path", F.lit(0).cast("bigint")), 0, 1, 8).count() for b in (blocks[:3], blocks))
    assert few <= 8 * 3 and many <= 8 * 12
