"""The corpus pipeline: five filtering and encoding stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.

All stages take null texts as empty, texts of any length whole, tables without rows (no rows
come out), and further columns whatever their names, which stay. Null ids are documents, too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotta.llm import bpe, decontaminate, exact, jaccard, quality
from glotta.llm.common import last_table, noted_paths, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more; without labels all stay. Repeated rows share their score."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), least=0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows that repeat id and text one, null ids included."""
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word Jaccard 0.8 or more) the document with the smallest doc_id.

    Operator 4 proposes groups by SimHash over five-word shingles, whose links are verified by
    whole shingle sets; no number of bits bounds that similarity, so a prefix filter finds the
    pairs beyond its distance. Texts without words are one group.
    """
    return jaccard.keep_one(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, or with less than one hit word in twenty. Without items all stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), one_in=20)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the token ids, and whether decoding them gives back the text; an empty text has no tokens."""
    ranks_path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    coded = bpe.encode_and_decode(docs.select("doc_id", "text"), ranks_path=ranks_path, pattern=public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", (F.col("decoded") == text).alias("round_trip")
    )


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_filter),
    ("byte-level bpe", byte_bpe),
]

#: The classifier, the fingerprints and the encoding aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each one's result is a table in the shared folder; what the stages wrote before it is released."""
    docs, known = table(spark, sf_dir, "documents"), noted_paths(spark)
    for _, stage in STAGES:
        docs = last_table(stage(spark, docs, sf_dir), "pipeline", known)
    return docs
