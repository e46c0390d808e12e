"""The dedup stages on rows that repeat an id, and on rows without one."""

import pytest

import corpus_pipeline

WORDS = " ".join(f"w{k}" for k in range(60))
ROWS = [(1, "one"), (1, "one"), (2, "one"), (2, "one"), (2, "other"), (2, "other"), (None, "lone"), (None, "lone"), (None, "one"), (None, None), (None, ""), (7, WORDS), (7, WORDS), (8, WORDS + " tail"), (None, WORDS + " end")]


def stage_rows(spark, stage, rows):
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, source string").repartition(3)
    out = stage(spark, docs, None)
    assert out.columns == docs.columns
    return sorted(((r["doc_id"] or 0, r["text"] or "") for r in out.collect()))


def test_exact_stage_keeps_one_row(spark):
    want = [(0, ""), (0, "lone"), (0, WORDS + " end"), (2, "one"), (2, "other"), (7, WORDS), (8, WORDS + " tail")]
    assert stage_rows(spark, corpus_pipeline.exact_dedup, ROWS) == want
    assert stage_rows(spark, corpus_pipeline.exact_dedup, ROWS * 2) == want


@pytest.mark.parametrize("times", [1, 2])
def test_near_stage_keeps_one_row(spark, times):
    want = [(0, ""), (0, "lone"), (1, "one"), (2, "other"), (7, WORDS)]
    assert stage_rows(spark, corpus_pipeline.near_dedup, ROWS * times) == want
