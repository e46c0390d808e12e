"""The fold of reviews against a plain loop, with cards that span tasks."""

import datetime as dt
import random

import pytest

from glotta.operators import scheduling

START = dt.datetime(2024, 1, 1)
SCHEMA = "learner_id bigint, lemma string, ts timestamp, review_id bigint, q int"


def brute(rows):
    out, found = {}, {}
    for learner, lemma, ts, i, q in rows:
        found.setdefault((learner, lemma), []).append((ts, i, q))
    for card, reviews in found.items():
        state = scheduling.NEW
        for _, _, q in sorted(reviews, key=lambda x: x[:2]):
            state = scheduling.reviewed(*state, q)
        last = max(reviews, key=lambda x: x[:2])
        out[card] = (*state, last[0].date() + dt.timedelta(days=min(max(1, state[0]), 36500)), last[2], min(reviews, key=lambda x: x[:2])[0])
    return out


def folded(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = scheduling.card_states(spark.createDataFrame(rows, SCHEMA).repartition(5), ["learner_id", "lemma"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == len({tuple(r)[:2] for r in found})
    return {tuple(r)[:2]: tuple(r)[2:] for r in found}


def reviews(n, hot, seed=1):
    rng = random.Random(seed)
    card = lambda: (7, "hot") if rng.random() < hot else (rng.randrange(40), rng.choice("abc"))
    return [(*card(), START + dt.timedelta(hours=rng.randrange(n)), i, rng.choice([0, 1, 2, 3, 3, 3, None, 9])) for i in range(n)]


@pytest.mark.parametrize("partitions,hot", [(1, 0.0), (4, 0.34), (16, 0.34), (16, 0.95), (64, 1.0)])
def test_cards_that_span_tasks(spark, partitions, hot):
    rows = reviews(3000, hot)
    assert folded(spark, rows, partitions) == brute(rows)


def test_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(scheduling, "PIECE", 3)
    rows = reviews(500, 0.8)
    assert folded(spark, rows, 8) == brute(rows)


def test_null_keys_repeated_rows_and_no_rows(spark):
    rows = [(None, None, START, 1, 3), (None, None, START, 1, 3), (1, None, START, 2, 0), (None, "a", START, 3, 2), (1, "a", START, 4, 1)]
    assert folded(spark, rows, 4) == brute(rows) and folded(spark, [], 4) == {}


def test_long_histories_do_not_overflow(spark):
    rows = [(1, "a", START + dt.timedelta(days=k), k, 3) for k in range(400)]
    got = folded(spark, rows, 4)
    assert got == brute(rows) and got[1, "a"][0] == 2**63 - 1


def test_no_list_of_a_card_is_collected(spark):
    plan = scheduling.card_states(spark.createDataFrame(reviews(10, 0.5), SCHEMA), ["learner_id", "lemma"])._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "rangepartitioning" in plan
