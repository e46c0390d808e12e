"""Which expected answers a text uses: every text against every answer, by one automaton of a block of answers."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotta.functions import text as X

#: Bytes of distinct answers in a block. An automaton takes some hundred bytes for each.
BLOCK_BYTES = 2_000_000


def _automaton(answers: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, answer in enumerate(answers):
        found.add_word(answer, k)
    found.make_automaton()
    return found


def _met(texts: DataFrame, answers: list[str]) -> DataFrame:
    """(doc_id, answer): the answers of a block that each text contains."""
    held = texts.sparkSession.sparkContext.broadcast(answers)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for batch in batches:
            automaton = automaton or _automaton(held.value)
            for k, text in enumerate(batch.column(1)):
                hits = sorted({n for _, n in automaton.iter(text.as_py())})
                if hits:
                    ids = batch.column(0).take(pa.array([k] * len(hits)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([held.value[n] for n in hits], pa.string())], names=["doc_id", "answer"])

    return texts.mapInArrow(over, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, answer string")


def targets_used(docs: DataFrame, targets: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, target_id): every text that contains an expected answer, both without accents, case, marks and blanks.

    docs: doc_id, text; targets: target_id, expected. Answers that are null or empty after that are used
    nowhere. Each text is read once a block of answers; a block is bounded, so is an automaton, which a task
    makes for itself. Repeated rows of either side give repeated pairs.
    """
    wanted = targets.select("target_id", X.normal_answer(F.col("expected")).alias("answer")).where("answer != ''")
    distinct = wanted.select("answer").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("answer")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    texts = docs.select("doc_id", X.normal_answer(F.col("text")).alias("text")).where("text != ''")
    block = F.pmod(F.xxhash64("answer"), F.lit(blocks))
    lists = ([r["answer"] for r in distinct.where(block == k).toLocalIterator()] for k in range(blocks))
    met = None
    for answers in filter(None, lists):
        part = _met(texts, answers)
        met = part if met is None else met.unionByName(part)
    if met is None:
        met = texts.where("false").select("doc_id", F.col("text").alias("answer"))
    return met.join(wanted, "answer").select("doc_id", "target_id")
