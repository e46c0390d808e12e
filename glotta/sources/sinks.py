"""Rows and writers for what leaves the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotta.functions import text as X


def anki_rows(cards: DataFrame) -> DataFrame:
    """``cards`` (lemma, gender, gloss, example, level, pos) with front, back, sentence (the lemma blanked) and tag."""
    blanked = X.blanked(F.coalesce("example", F.lit("")), F.col("lemma"), "[...]")
    return cards.withColumns(
        {
            "front": F.concat("lemma", F.when(F.col("gender") != "", F.concat(F.lit(" ("), "gender", F.lit(")"))).otherwise("")),
            "back": F.col("gloss"),
            "sentence": blanked,
            "tag": F.concat_ws("_", F.lit("glotta"), "level", "pos"),
        }
    )


def write_anki(cards: DataFrame, path: str) -> None:
    """The rows as CSV part files, every cell quoted, quotes doubled."""
    anki_rows(cards).select("front", "back", "sentence", "tag").write.csv(path, quoteAll=True, escape='"')


def write_state(state: DataFrame, path: str, *, slim: bool = False) -> None:
    """A learner table; ``slim`` leaves the raw text out."""
    (state.drop("raw_text") if slim else state).write.mode("overwrite").parquet(path)
