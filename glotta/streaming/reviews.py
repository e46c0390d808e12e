"""Streams of reviews and calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glotta.operators.scheduling import START_EASE, reviewed
from glotta.sources.store import Store

_STATE = "interval bigint, reps bigint, ef double, lapses bigint"
_OUT = "learner_id bigint, lemma string, interval bigint, reps bigint, ef double, lapses bigint, due date"


def card_stream(reviews: DataFrame) -> DataFrame:
    """The state of each card after each micro-batch that reviews it; reviews: learner_id, lemma, ts, review_id, q.

    Within a batch reviews count in the order of ts and review_id; the state is a few numbers a card.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0, START_EASE, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "review_id"])
        for q in rows["q"]:
            now = reviewed(*now, int(q))
        state.update(now)
        days = pd.Timedelta(days=min(max(1, now[0]), 36500))
        yield pd.DataFrame([[*key, *now, (rows["ts"].iloc[-1].normalize() + days).date()]], columns=["learner_id", "lemma", "interval", "reps", "ef", "lapses", "due"])

    return reviews.groupBy("learner_id", "lemma").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def daily_calls(calls: DataFrame, key: str, time_col: str = "ts", keep: str = "48 hours") -> DataFrame:
    """(key, day, n) of a stream of calls by event-time day; state older than ``keep`` is dropped."""
    counted = calls.withWatermark(time_col, keep).groupBy(key, F.window(time_col, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("day"), "n")


def merged_glosses(glosses: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds a batch's unseen glosses (lemma, gloss) to a table; the first gloss of a lemma stays."""
    spark = glosses.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        known = spark.read.schema("lemma string, gloss string").parquet(path)
        new = batch.where("gloss != ''").groupBy("lemma").agg(F.min("gloss").alias("gloss")).join(known, "lemma", "left_anti")
        new.write.mode("append").parquet(path)

    return merge


def gloss_batches(glosses: Store, stream: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds a batch's unseen glosses (lemma, gloss) to a store, once however often the batch is replayed."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = batch.where("gloss != ''").groupBy("lemma").agg(F.min("gloss").alias("gloss")).join(glosses.read(), "lemma", "left_anti")
        glosses.append(new, stream=stream, batch=batch_id)

    return merge
