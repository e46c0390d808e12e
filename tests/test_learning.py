"""Scheduling, reports, backups, and that the stream agrees with the batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from glotta.operators import backup, reports, scheduling
from glotta.streaming import reviews as streams

DAY = dt.datetime(2024, 1, 1)


def review_frame(spark, rows):
    return spark.createDataFrame([(k, "mot", DAY + dt.timedelta(days=i), n, q) for n, (k, i, q) in enumerate(rows)], "learner_id bigint, lemma string, ts timestamp, review_id bigint, q int")


def test_fold(spark):
    rows = [(1, i, 3) for i in range(5)] + [(2, i, 3) for i in range(5)] + [(2, 5, 0)] + [(3, 0, 1), (3, 1, 2), (3, 2, 9)]
    cards = {r["learner_id"]: r for r in scheduling.card_states(review_frame(spark, rows), ["learner_id", "lemma"]).collect()}
    assert cards[1]["interval"] > 1 and cards[1]["reps"] == 5 and cards[1]["lapses"] == 0
    assert (cards[2]["interval"], cards[2]["lapses"]) == (0, 1) and cards[2]["due"] == dt.date(2024, 1, 7)
    state = (0, 0, 2.5, 0)
    for q in (1, 2, 9):
        state = streams.reviewed(*state, q)
    assert (cards[3]["interval"], cards[3]["reps"], cards[3]["ef"], cards[3]["lapses"]) == state


def test_reports(spark):
    reviews = review_frame(spark, [(1, 0, 3), (1, 1, 0), (2, 0, 2)])
    cards = scheduling.card_states(reviews, ["learner_id", "lemma"])
    found = {r["learner_id"]: r for r in reports.learner_report(cards, reviews).collect()}
    assert (found[1]["known"], found[1]["weak"], found[1]["accuracy"]) == (0, 1, 50) and (found[2]["known"], found[2]["accuracy"]) == (1, 100)
    assert reports.mastery(cards, "lemma").first()["percent"] == 50
    assert scheduling.due_forecast(cards, "2024-01-01").agg(F.count(F.lit(1)), F.sum("n")).first()[:] == (14, 2)
    plan = scheduling.study_plan(cards, "2024-01-02", "2024-01-03").first()
    assert (plan["n_cards"], plan["n_learned"], plan["days"], plan["per_day"]) == (2, 2, 1, 2)
    assert [r["allowed"] for r in scheduling.within_daily_limit(reviews, "lemma", 1, tie_col="review_id").orderBy("review_id").collect()] == [True, True, False]


def test_merge_is_idempotent_and_takes_the_later_day(spark):
    schema = "learner_id bigint, lemma string, due date, reps bigint"
    mine = spark.createDataFrame([(1, "a", dt.date(2024, 1, 2), 1), (1, "b", dt.date(2024, 1, 1), 1)], schema)
    theirs = spark.createDataFrame([(1, "a", dt.date(2024, 1, 2), 9), (1, "b", dt.date(2024, 1, 5), 9), (1, "c", dt.date(2024, 1, 1), 9)], schema)
    merged = backup.merge_cards(mine, theirs, ["learner_id", "lemma"])
    assert {r["lemma"]: r["reps"] for r in merged.collect()} == {"a": 1, "b": 9, "c": 9}
    assert sorted(backup.merge_cards(merged, theirs, ["learner_id", "lemma"]).collect()) == sorted(merged.collect())


def test_backup_round_trip(spark):
    cards = spark.createDataFrame([(1, "été", "2024-01-02")], "learner_id bigint, lemma string, due string")
    saved = backup.backup_json(cards, "learner_id")
    bad = spark.createDataFrame([(2, '{"format":"other"}'), (3, '{"format":"glotta-backup","version":1,"state":{"foo":1}}'), (4, "not json")], "learner_id bigint, json string")
    read = backup.valid_backups(saved.unionByName(bad), "struct<lemma:string,due:string>").collect()
    assert [(r["learner_id"], r["cards"][0]["lemma"]) for r in read] == [(1, "été")]


@pytest.fixture
def event_files(spark, tmp_path):
    rows = review_frame(spark, [(k % 3, k, (k * 7) % 4) for k in range(30)])
    for k in range(3):
        rows.where(f"review_id between {10 * k} and {10 * k + 9}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, str(tmp_path / "in")


def test_stream_of_cards_ends_at_the_batch_fold(spark, event_files):
    rows, path = event_files
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = streams.card_stream(stream).writeStream.outputMode("update").format("memory").queryName("cards_out").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {}
    for r in spark.table("cards_out").collect():
        if r["reps"] > last.get(r["learner_id"], (0, 0))[0]:
            last[r["learner_id"]] = (r["reps"], r["interval"], round(r["ef"], 9), r["lapses"], r["due"])
    batch = scheduling.card_states(rows, ["learner_id", "lemma"]).collect()
    assert last == {r["learner_id"]: (r["reps"], r["interval"], round(r["ef"], 9), r["lapses"], r["due"]) for r in batch}


def test_daily_calls(spark, event_files):
    rows, path = event_files
    stream = spark.readStream.schema(rows.schema).parquet(path)
    query = streams.daily_calls(stream, "learner_id").writeStream.outputMode("complete").format("memory").queryName("calls_out").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("calls_out").agg(F.sum("n")).first()[0] == 30


def test_gloss_table_keeps_the_first(spark, tmp_path):
    path = str(tmp_path / "glosses")
    spark.createDataFrame([("a", "one")], "lemma string, gloss string").write.parquet(path)
    batch = spark.createDataFrame([("a", "two"), ("b", "bee"), ("c", "")], "lemma string, gloss string")
    streams.merged_glosses(batch, path)(batch, 0)
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", "one"), ("b", "bee")}


def test_orders_and_stops(spark):
    rows = spark.createDataFrame([("f", k, k in (0, 2, 3)) for k in range(6)], "path string, page int, failed boolean")
    assert [r["page"] for r in reports.until_failures(rows, "path", "page", "failed").orderBy("page").collect()] == [0, 1, 2, 3]
    first, again = ([r["page"] for r in reports.shuffled(rows, seed, "page").collect()] for seed in (1, 1))
    assert first == again and sorted(first) == list(range(6))
    cards = spark.createDataFrame([(1, "v", 2), (1, "v", 1), (1, "n", 9)], "learner_id int, pos string, reps int")
    assert reports.conjugation_mastery(cards, "learner_id").first()["percent"] == 50
