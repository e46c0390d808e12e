"""The state store: defaults, restore, reset, replayed batches, crashes between data and version, two writers."""

import pytest
from pyspark.sql import functions as F

from glotta.sources import store
from glotta.streaming import reviews as streams

SCHEMA = "learner_id bigint, exam string, raw_text string, reviews bigint"
DEFAULTS = {"exam": "B1", "raw_text": "", "reviews": 0}


@pytest.fixture
def state(spark, tmp_path):
    return store.Store(spark, str(tmp_path / "state"), SCHEMA)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_nothing_is_there_at_first(state):
    assert rows(state.load(DEFAULTS)) == [] and state.version() == store.Version() and state.vacuum() == []


def test_load_fills_in_defaults(spark, state):
    state.replace(frame(spark, (1, None, None, 5), (2, "A2", "x", None)))
    assert rows(state.load(DEFAULTS)) == [(1, "B1", "", 5), (2, "A2", "x", 0)]


def test_restore_overwrites_and_lacks_nothing(spark, state):
    state.replace(frame(spark, (1, "C1", "old", 9), (2, "C1", "old", 9)))
    state.restore(spark.createDataFrame([(1, 3)], "learner_id bigint, reviews bigint"), DEFAULTS)
    assert rows(state.read()) == [(1, "B1", "", 3)]


def test_reset_is_an_empty_version_and_old_ones_stay_readable(spark, state):
    first = state.replace(frame(spark, (1, "A1", "x", 1)))
    state.reset()
    assert rows(state.load(DEFAULTS)) == [] and rows(state.read(first)) == [(1, "A1", "x", 1)]
    assert len(state.vacuum()) == 1


def test_a_version_that_cannot_be_read_gives_way_to_the_one_before(spark, state, tmp_path):
    state.replace(frame(spark, (1, "A1", "x", 1)))
    (tmp_path / "state/versions/000000000002.json").write_text("{broken")
    assert rows(state.read()) == [(1, "A1", "x", 1)]
    assert state.append(frame(spark, (2, "A1", "y", 1))).number == 3 and len(rows(state.read())) == 2


def test_a_crash_between_data_and_version_changes_nothing(spark, state, monkeypatch):
    state.append(frame(spark, (1, "A1", "x", 1)), stream="s", batch=0)
    with monkeypatch.context() as patched:
        patched.setattr(state, "_put", lambda version: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            state.append(frame(spark, (2, "A1", "y", 1)), stream="s", batch=1)
    assert rows(state.read()) == [(1, "A1", "x", 1)]
    state.append(frame(spark, (2, "A1", "y", 1)), stream="s", batch=1)
    assert len(rows(state.read())) == 2 and len(state.vacuum()) == 1 and len(rows(state.read())) == 2


def test_a_replayed_batch_is_left_out(spark, state):
    for batch in (0, 1, 1, 0, 2):
        state.append(frame(spark, (batch, "A1", "x", 1)), stream="s", batch=batch)
    assert [r[0] for r in rows(state.read())] == [0, 1, 2]
    state.append(frame(spark, (7, "A1", "x", 1)), stream="other", batch=0)
    state.reset()
    assert state.append(frame(spark, (1, "A1", "x", 1)), stream="s", batch=2).segments == ()


def test_of_two_writers_one_is_told(spark, state, monkeypatch):
    old = state.replace(frame(spark, (1, "A1", "x", 1)))
    state.append(frame(spark, (2, "A1", "x", 1)))
    monkeypatch.setattr(state, "version", lambda: old)
    with pytest.raises(store.Conflict):
        state.append(frame(spark, (3, "A1", "x", 1)))
    monkeypatch.undo()
    assert [r[0] for r in rows(state.read())] == [1, 2]


def test_many_segments_are_written_together(spark, state, monkeypatch):
    monkeypatch.setattr(store, "MOST_SEGMENTS", 3)
    for k in range(5):
        version = state.append(frame(spark, (k, "A1", "x", 1)))
    assert len(version.segments) <= 3 and [r[0] for r in rows(state.read())] == list(range(5))


def test_save_leaves_heavy_columns_out_when_they_cannot_be_written(spark, state):
    too_large = F.when(F.col("learner_id") == 1, F.raise_error(F.lit("no space left"))).otherwise(F.lit("text"))
    data = frame(spark, (1, "A1", "x", 1), (2, "A2", "y", 2)).withColumn("raw_text", too_large)
    state.save(data)
    assert rows(state.load({"raw_text": ""})) == [(1, "A1", "", 1), (2, "A2", "", 2)]
    with pytest.raises(Exception, match="no space left"):
        state.save(data, heavy=())


def test_glosses_of_a_stream(spark, tmp_path):
    glosses = store.Store(spark, str(tmp_path / "glosses"), "lemma string, gloss string")
    merge = streams.gloss_batches(glosses, "s")
    first = spark.createDataFrame([("a", "one"), ("a", "two"), ("b", "")], "lemma string, gloss string")
    for batch_id, batch in ((0, first), (0, first), (1, spark.createDataFrame([("a", "new"), ("b", "bee")], first.schema))):
        merge(batch, batch_id)
    assert rows(glosses.read()) == [("a", "one"), ("b", "bee")]
