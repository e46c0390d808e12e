"""Glosses from an outside model: batches of prompts, an injected client, replies as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glotta.functions import text as X
from glotta.operators.calls import Terms, called, is_page, reply_text

# Words in a prompt, characters of context.
BATCH_WORDS, CONTEXT_CHARS = 6, 42


def prompts(vocab: DataFrame, docs: DataFrame, most: int = 24) -> DataFrame:
    """(doc_id, batch_no, lemmas, prompt): each document's most frequent words without a gloss, six to a prompt."""
    missing = vocab.where("gloss = ''").withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "first_pos"))).where(F.col("k") <= most)
    context = F.substring(F.coalesce(X.context_of(F.col("text"), F.col("lemma")), F.lit("")), 1, CONTEXT_CHARS)
    words = missing.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.floor((F.col("k") - 1) / BATCH_WORDS).alias("batch_no"), F.struct("k", "lemma", context.alias("context")).alias("x"))
    lists = words.groupBy("doc_id", "batch_no").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    lines = F.transform("xs", lambda x: F.concat_ws(" | ", x["lemma"], x["context"]))
    return lists.select("doc_id", "batch_no", F.col("xs.lemma").alias("lemmas"), F.concat(F.lit("One short gloss a line for:\n"), F.array_join(lines, "\n")).alias("prompt"))


def replies(asked: DataFrame, client: Callable[[str], str] | None = None, terms: Terms = Terms()) -> DataFrame:
    """(doc_id, lemmas, reply, error): what the service said to each prompt, and what is wrong with it."""
    said = called(asked.select("doc_id", "lemmas", "prompt"), client, terms=terms).withColumn("reply", reply_text(F.col("reply")))
    wrong = F.when(X.trimmed("reply") == "", "empty reply").when(is_page(F.col("reply")), "a page instead of a reply")
    said = said.withColumn("error", F.coalesce("error", wrong))
    return said.select("doc_id", "lemmas", F.when(F.col("error").isNull(), F.col("reply")).alias("reply"), "error")


def glossed(asked: DataFrame, client: Callable[[str], str] | None = None, terms: Terms = Terms()) -> DataFrame:
    """(doc_id, lemma, gloss) from the client's replies; a prompt that fails twice is left out, as is one without a client (``replies`` says why)."""
    lines = X.gloss_lines(F.col("reply"), F.size("lemmas"))
    return replies(asked, client, terms).select("doc_id", F.explode(F.arrays_zip("lemmas", lines.alias("lines"))).alias("x")).select(
        "doc_id", F.col("x.lemmas").alias("lemma"), F.col("x.lines").alias("gloss")
    ).where("lemma is not null and gloss is not null")


def applied(vocab: DataFrame, glosses: DataFrame) -> DataFrame:
    """``vocab`` whose missing glosses come from (lemma, gloss)."""
    cache = glosses.groupBy("lemma").agg(F.min("gloss").alias("_cached"))
    return vocab.join(cache, "lemma", "left").withColumn("gloss", F.when(F.col("gloss") == "", F.coalesce("_cached", F.lit(""))).otherwise(F.col("gloss"))).drop("_cached")
