"""The stream of card events against the batch fold: out-of-order input, late reviews, a restart, due days."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from glotta.operators import scheduling
from glotta.streaming import timeline

START = dt.datetime(2024, 1, 1)
SCHEMA = "learner_id bigint, lemma string, ts timestamp, review_id bigint, q int"


@pytest.fixture
def rocks(spark):
    key, value = timeline.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    yield spark
    spark.conf.set(key, before)


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path):
    """What one run of the query adds; it goes on from its checkpoint."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = timeline.card_timeline(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert query.awaitTermination(300) and query.exception() is None
    return sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)


def last_states(rows):
    out = {}
    for learner, lemma, kind, *card, at in rows:
        if kind == "reviewed":
            out[learner, lemma] = max(out.get((learner, lemma), (START - dt.timedelta(1),)), (at, *card), key=lambda x: (x[0], x[2] if len(x) > 2 else 0))
    return {k: v[1:] for k, v in out.items()}


def test_out_of_order_reviews_and_a_restart_end_at_the_batch_fold(rocks, tmp_path):
    rng = random.Random(2)
    rows = [(k % 3, "mot", START + dt.timedelta(hours=12 * k), k, rng.choice([0, 1, 2, 3, 3, None])) for k in range(60)]
    shuffled = [r for k in range(0, 60, 10) for r in rng.sample(rows[k : k + 10], 10)]
    late = (0, "mot", START, 999, 0)  # far behind the watermark of then
    for k in range(0, 40, 10):
        write(rocks, shuffled[k : k + 10], str(tmp_path / "in"))
    run(rocks, tmp_path)
    write(rocks, [*shuffled[40:50], late], str(tmp_path / "in"))
    write(rocks, shuffled[50:], str(tmp_path / "in"))
    write(rocks, [(9, "end", START + dt.timedelta(days=400), 1000, 3)], str(tmp_path / "in"))
    found = run(rocks, tmp_path)
    batch = scheduling.card_states(rocks.createDataFrame(rows, SCHEMA), ["learner_id", "lemma"]).collect()
    assert last_states(found) == {(r["learner_id"], r["lemma"]): (r["interval"], r["reps"], r["ef"], r["lapses"], r["due"]) for r in batch}
    told = [(r[0], r[1], r[7]) for r in found if r[2] == "due"]
    due = set(told)
    assert len(told) == len(due) and {(r["learner_id"], r["lemma"], r["due"]) for r in batch if r["due"] < (START + dt.timedelta(days=393)).date()} <= due


def test_a_card_is_due_once_and_not_before_its_day(rocks, tmp_path):
    write(rocks, [(1, "a", START, 1, 3), (2, "b", START, 2, 3)], str(tmp_path / "in"))
    write(rocks, [(2, "b", START + dt.timedelta(days=2), 3, 0), (3, "end", START + dt.timedelta(days=11), 4, 3)], str(tmp_path / "in"))
    told = [(r[0], r[7]) for r in run(rocks, tmp_path) if r[2] == "due"]
    assert told == [(2, dt.date(2024, 1, 4))]  # the watermark is at 5 January
    write(rocks, [(3, "end", START + dt.timedelta(days=14), 5, 3)], str(tmp_path / "in"))
    write(rocks, [(3, "end", START + dt.timedelta(days=30), 6, 3)], str(tmp_path / "in"))
    due = sorted((r[0], r[7]) for r in run(rocks, tmp_path) if r[2] == "due" and r[0] < 3)
    assert due == [(1, dt.date(2024, 1, 6)), (2, dt.date(2024, 1, 4))]
