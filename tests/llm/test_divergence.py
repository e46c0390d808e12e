"""Operator 11 against a plain count of every term in every pair of sources."""

import re
from collections import Counter

import pytest

from glotta.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FIELDS = "text string, lang string, source string"


def brute(rows, least=10, most=10):
    rows = [tuple(x or "" for x in row) for row in rows]
    n, df, groups = {}, Counter(), sorted({(lang, source) for _, lang, source in rows})
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOWER))
        n.setdefault((lang, source), Counter()).update(terms)
        df.update((lang, t) for t in set(terms))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for x, t in df if x == lang and df[x, t] >= least]
        sources = [s for x, s in groups if x == lang]

        def shares(count):
            whole = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (whole + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        own = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(own[s][t], q[t]), t) for t in kept if n[lang, s][t] and own[s][t] > q[t]]
            for part, found, last in (("pair", pairs, None), ("term", terms, most)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:last])]
    return sorted(out)


def result(spark, rows, **options):
    found = divergence.source_divergence(spark.createDataFrame(rows, FIELDS), **options)
    return sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect())


ROWS = [(f"the Été {'abc'[i % 3]} x{'yz' * (i % 4)} word{'s' * (i % 2)} {'rare ' * (i == 3)}", ["en", None, "fr"][i % 3], ["s1", "s2", None, "s4", "S"][i % 5]) for i in range(90)]
ODD = [(None, "en", "quiet"), ("", "de", "alone"), ("12 34 !", "de", "other"), (None, None, None), ("　ÀÉ日本語 naïve" * 3, "fr", "s1"), ("ABC abc Abc", "fr", "s2"), ("ABC abc Abc", "fr", "s2")]


@pytest.mark.parametrize("least", [1, 2, 10])
def test_against_brute_force(spark, least):
    assert result(spark, ROWS + ODD, least_docs=least) == brute(ROWS + ODD, least)


def test_small_pieces_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_PAIRS", 3)
    monkeypatch.setattr(divergence, "HELD_TERMS", 2)
    assert result(spark, ROWS, least_docs=2, most_terms=3) == brute(ROWS, 2, 3)


def test_a_group_without_kept_terms_has_pairs_of_zero(spark):
    assert result(spark, [("a b", "en", "x"), (None, "en", "y")]) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_no_rows(spark):
    assert result(spark, []) == []


def test_long_texts_hot_groups_and_further_columns(spark):
    rows = [("un deux trois " * 200_000, "fr", "hot")] + [("un autre mot", "fr", "hot")] * 400 + ROWS
    df = spark.createDataFrame(rows, FIELDS).selectExpr("text", "lang", "source", "1 AS n", "2 AS value", "3 AS term", "4 AS rank", "5 AS m")
    found = divergence.source_divergence(df).collect()
    assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in found) == brute(rows)


def test_equal_vectors_are_evaluated_once(spark):
    rows = [(" ".join(f"t{'abcdefghij'[k]}" for k in range(10)), "en", s) for s in ("a", "b") for _ in range(10)]
    kept = divergence.count_vectors(divergence.term_counts(spark.createDataFrame(rows, FIELDS)), 10)
    assert kept.count() == 10 and kept.select("vector").distinct().count() == 1
    assert result(spark, rows) == brute(rows)


def test_counts_beyond_64_bits_stay_exact(spark):
    big = 3 * 10**11
    row = spark.range(1).select(divergence.share(divergence.F.lit(big), divergence.F.lit(7 * big), divergence.F.lit(5)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (big + 2) // (7 * big + 10)
