"""Cards as a stream of events: reviews in the order of their time however they come, and the days on which cards fall due."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glotta.operators.scheduling import NEW, reviewed

_CARD = "interval bigint, reps bigint, ef double, lapses bigint, due date"
_WAITING = "ts timestamp, review_id bigint, q int"
_OUT = f"learner_id bigint, lemma string, kind string, {_CARD}, at timestamp"
_COLUMNS = ["learner_id", "lemma", "kind", "interval", "reps", "ef", "lapses", "due", "at"]
_EPOCH = dt.datetime(1970, 1, 1)


def _ms(at: dt.datetime) -> int:
    return round((at - _EPOCH) / dt.timedelta(milliseconds=1))


class CardProcessor(StatefulProcessor):
    """The state of one card: a few numbers, the reviews that wait for the watermark, and a timer for the due day.

    A review waits until the watermark has passed it; those that have waited are folded in the order
    of ts and review_id. When the watermark reaches the due day without a further review, the card is due.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.card = handle.getValueState("card", f"{_CARD}, told boolean")
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, new = timerValues.getCurrentWatermarkInMs(), []
        for frame in rows:
            for ts, review_id, q in zip(frame["ts"], frame["review_id"], frame["q"]):
                new.append((ts.to_pydatetime(), int(review_id), 3 if pd.isna(q) else int(q)))
        if new:
            self.waiting.appendList(new)
            # a timer must lie ahead; a batch's watermark moves after it
            self.handle.registerTimer(max(min(_ms(x[0]) for x in new), passed + 1))
        yield pd.DataFrame([], columns=_COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, out = timerValues.getCurrentWatermarkInMs(), []
        waiting = sorted(tuple(x) for x in self.waiting.get())
        ready, rest = [x for x in waiting if _ms(x[0]) <= passed], [x for x in waiting if _ms(x[0]) > passed]
        *state, due, told = tuple(self.card.get()) if self.card.exists() else (*NEW, None, True)
        if ready:
            for _, _, q in ready:
                state = reviewed(*state, q)
            last = ready[-1][0]
            due, told = last.date() + dt.timedelta(days=min(max(1, state[0]), 36500)), False
            self.waiting.put(rest) if rest else self.waiting.clear()
            out.append((*key, "reviewed", *state, due, last))
        if not told:
            day = dt.datetime.combine(due, dt.time())
            if _ms(day) <= passed:
                out.append((*key, "due", *state, due, day))
                told = True
            else:
                self.handle.registerTimer(_ms(day))
        if due:
            self.card.update((*state, due, told))
        if rest:
            self.handle.registerTimer(_ms(rest[0][0]))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def card_timeline(reviews: DataFrame, late: str = "7 days") -> DataFrame:
    """(learner_id, lemma, kind, interval, reps, ef, lapses, due, at): ``reviewed`` rows as the watermark passes reviews, ``due`` rows as it reaches due days.

    reviews: learner_id, lemma, ts, review_id, q. A review at most ``late`` behind the latest one counts at its
    own time, whatever the order of arrival; one that is later still is dropped by the watermark.
    The session needs the RocksDB state store (``STATE_STORE``).
    """
    rows = reviews.select("learner_id", "lemma", F.col("ts").cast("timestamp").alias("ts"), "review_id", F.col("q").cast("int").alias("q"))
    cards = rows.withWatermark("ts", late).groupBy("learner_id", "lemma")
    return cards.transformWithStateInPandas(CardProcessor(), _OUT, "Append", "EventTime")


#: The session setting that stateful processors need, and its value.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
