"""Spaced repetition: card state from reviews, what is due, forecasts, plans and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

# First intervals and interval factors by quality 0..3, the start and floor of the ease factor.
FIRST_INTERVAL = [0, 1, 3, 5]
FACTOR = [0.0, 0.8, 1.0, 1.3]
START_EASE, LEAST_EASE = 2.5, 1.3


#: A state is (interval, reps, ef, lapses).
State = tuple[int, int, float, int]
NEW: State = (0, 0, START_EASE, 0)
MOST_INTERVAL = 2**63 - 1
#: Reviews in one piece of a history that is handed on.
PIECE = 1_000_000


def reviewed(interval: int, reps: int, ef: float, lapses: int, q: int | None) -> State:
    """The state after a review of quality 0 (forgotten) to 3 (easy); others count as the nearest of those, none as 3."""
    q = 3 if q is None else max(0, min(3, q))
    if q == 0:
        return 0, reps + 1, max(LEAST_EASE, ef - 0.2), lapses + 1
    missing = float(3 - q)
    if interval == 0:
        interval = FIRST_INTERVAL[q]
    else:
        grown = interval * ef * FACTOR[q] + 0.5
        interval = int(grown) if grown < MOST_INTERVAL else MOST_INTERVAL
    return interval, reps + 1, max(LEAST_EASE, ef + (0.1 - missing * (0.08 + missing * 0.02))), lapses


def _runs(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The runs of equal keys of a batch, whose first ``n_keys`` columns are the keys."""
    keys = list(zip(*(batch.column(k).to_pylist() for k in range(n_keys))))
    start = 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[start]:
            yield keys[start], batch.slice(start, k - start)
            start = k


def _compacted(n_keys: int, schema: pa.Schema):
    """Reviews in order of card and time to rows (keys, part, piece, first, last, last_q, interval, reps, ef, lapses, rest).

    A card that begins in this task has its state. The task's first card may go on from the task
    before, so its qualities are handed on, a byte each, in pieces.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, card, rest, state, piece = TaskContext.get().partitionId(), None, bytearray(), NEW, 0
        first = last = q = None
        done: list[tuple] = []
        head = True  # until the first card has ended

        def end(handed: bool) -> None:
            done.append((*card, part, piece, first, last, q, *((None,) * 4 if handed else state), bytes(rest) if handed else None))

        for batch in batches:
            for key, run in _runs(batch, n_keys):
                times, qualities = run.column(n_keys), run.column(n_keys + 1).to_pylist()
                if key != card:
                    if card is not None:
                        end(head)
                        head = False
                    card, rest, state, piece, first = key, bytearray(), NEW, 0, times[0].as_py()
                last, q = times[len(run) - 1].as_py(), qualities[-1]
                if not head:
                    for x in qualities:
                        state = reviewed(*state, x)
                    continue
                rest += bytes(3 if x is None else max(0, min(3, x)) for x in qualities)
                if len(rest) >= PIECE:
                    end(True)
                    rest, piece = bytearray(), piece + 1
            if done:
                yield _rows(done, schema)
                done.clear()
        if card is not None:
            end(head)
            yield _rows(done, schema)

    return over


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _carried(n_keys: int, schema: pa.Schema):
    """A card's rows in order of part and piece to its state: a state stands for all before it, qualities go on from there."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        card, state, first, last, q, done = None, NEW, None, None, None, []

        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)))
            for row in rows:
                key, (_, _, since, until, quality, *made, rest) = row[:n_keys], row[n_keys:]
                if key != card:
                    if card is not None:
                        done.append((*card, *state, first, last, q))
                    card, state, first = key, NEW, since
                last, q = until, quality
                if rest is None:
                    state = tuple(made)
                else:
                    for x in rest:
                        state = reviewed(*state, x)
            if done:
                yield _rows(done, schema)
                done = []
        if card is not None:
            done.append((*card, *state, first, last, q))
            yield _rows(done, schema)

    return over


def card_states(reviews: DataFrame, keys: list[str], *, time_col: str = "ts", tie_col: str = "review_id", quality_col: str = "q") -> DataFrame:
    """One row per card: keys, interval, reps, ef, lapses, last_q, first_ts, due.

    A card's reviews are folded in the order of time, then of ``tie_col``. Reviews are sorted by ranges
    of card and time, so a card with any part of them spans as many tasks as it needs; each task
    folds what it reads as a stream. Of a card that spans tasks, the later ones hand their
    qualities on, which a second pass over cards folds in order, as a stream again.
    """
    rows = reviews.select(*keys, F.col(time_col).alias("_t"), F.col(quality_col).cast("int").alias("_q"), F.col(tie_col).alias("_i"))
    ordered = rows.repartitionByRange(*keys, "_t", "_i").sortWithinPartitions(*keys, "_t", "_i").drop("_i")
    key_fields, time_field = [rows.schema[k] for k in keys], rows.schema["_t"].dataType
    fields = [("interval", T.LongType()), ("reps", T.LongType()), ("ef", T.DoubleType()), ("lapses", T.LongType())]
    made = [("part", T.IntegerType()), ("piece", T.IntegerType()), ("first", time_field), ("last", time_field), ("last_q", T.IntegerType()), *fields, ("rest", T.BinaryType())]
    compact = T.StructType([*key_fields, *(T.StructField(*x) for x in made)])
    state = T.StructType([*key_fields, *(T.StructField(*x) for x in [*fields, ("first_ts", time_field), ("last", time_field), ("last_q", T.IntegerType())])])
    pieces = ordered.mapInArrow(_compacted(len(keys), to_arrow_schema(compact)), compact)
    gathered = pieces.repartition(*keys).sortWithinPartitions(*keys, "part", "piece")
    due = F.date_add(F.col("last").cast("date"), F.least(F.greatest(F.lit(1), F.col("interval")), F.lit(36500)).cast("int"))
    folded = gathered.mapInArrow(_carried(len(keys), to_arrow_schema(state)), state)
    return folded.select(*keys, "interval", "reps", "ef", "lapses", due.alias("due"), "last_q", "first_ts")


def due_cards(cards: DataFrame, as_of: str) -> DataFrame:
    suspended = F.col("suspended") if "suspended" in cards.columns else F.lit(False)
    return cards.where(~suspended & (F.col("due") <= F.lit(as_of).cast("date")))


def due_forecast(cards: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """(day, n): the cards due on each of the days from ``as_of`` on, days without cards included."""
    start = F.lit(as_of).cast("date")
    window = cards.where(F.col("due").between(start, F.date_add(start, days - 1))).groupBy(F.col("due").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    every = cards.sparkSession.range(days).select(F.date_add(start, F.col("id").cast("int")).alias("day"))
    return every.join(window, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def study_plan(cards: DataFrame, as_of: str, exam: str) -> DataFrame:
    """(n_cards, n_due, n_learned, days, per_day)."""
    days = F.greatest(F.datediff(F.lit(exam).cast("date"), F.lit(as_of).cast("date")), F.lit(0))
    return cards.agg(
        F.count(F.lit(1)).alias("n_cards"), F.count_if(F.col("due") <= F.lit(as_of).cast("date")).alias("n_due"), F.count_if(F.col("reps") > 0).alias("n_learned")
    ).select("*", days.cast("bigint").alias("days"), F.ceil(F.col("n_cards") / F.greatest(days, F.lit(1))).cast("bigint").alias("per_day"))


def within_daily_limit(calls: DataFrame, key: str, limit: int, *, time_col: str = "ts", tie_col: str) -> DataFrame:
    """``calls`` with ``used`` (its number within key and day) and ``allowed``."""
    by_day = W.partitionBy(key, F.to_date(time_col)).orderBy(time_col, tie_col)
    return calls.withColumn("used", F.row_number().over(by_day)).withColumn("allowed", F.col("used") <= limit)


def daily_counts(calls: DataFrame, key: str, time_col: str = "ts") -> DataFrame:
    """(key, day, n) by tumbling windows of a day."""
    return calls.groupBy(key, F.window(time_col, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.to_date("w.start").alias("day"), "n")
