"""The pipeline against brute force, stage by stage."""

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from glotta.llm import bpe, quality, queries
from tests.llm.test_operators import components, hit_words

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} if w else set()


def alike(a, b):
    return not a and not b or len(a & b) >= 0.8 * len(a | b) > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {r["doc_id"]: r["text"] for r in quality.score(docs, model).where("score >= 0.3").collect()}
    by_text = {t: i for i, t in sorted(left.items())}
    left = {i: t for t, i in by_text.items()}
    sets = {i: shingles(t) for i, t in left.items()}
    ids = sorted(left)
    groups = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if alike(sets[a], sets[b])])
    left = {i: left[i] for i in set(groups.values())}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    left = {i: left[i] for i, (n, hit, _) in hit_words(left, items).items() if not (hit and 20 * hit >= n)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(queries.RANKS)), special_tokens={})
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in rows} == {i: encoding.encode_ordinary(t) for i, t in left.items()}
    assert all(r["round_trip"] for r in rows) and len(rows) == len(left)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns


def test_no_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """Null and empty texts are one text; of rows that repeat one stays; columns with the operators' names stay as they are."""
    line = " ".join(f"w{k}" for k in range(40))
    rows = [(1, line, "k"), (1, line, "k"), (2, line, "k"), (None, line + " x", "k"), (3, None, "k"), (4, "", "k"), (5, "other words " * 30, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string").withColumn("score", F.lit("s")).withColumn("spans", F.lit(1))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    now = corpus_pipeline.exact_dedup(spark, docs, str(tmp_path))
    assert sorted(map(str, (r["doc_id"] for r in now.collect()))) == ["2", "4", "5", "None"] and now.columns == docs.columns
    now = corpus_pipeline.near_dedup(spark, now, str(tmp_path))
    assert {r["doc_id"] for r in now.collect()} == {2, 4, 5} and now.columns == docs.columns
    now = corpus_pipeline.benchmark_filter(spark, now, str(tmp_path))
    assert {(r["doc_id"], r["score"], r["spans"]) for r in now.collect()} == {(i, "s", 1) for i in (2, 4, 5)}
    assert {(r["doc_id"], r["n_tokens"] > 0, r["round_trip"]) for r in corpus_pipeline.byte_bpe(spark, now, str(tmp_path)).collect()} == {(2, True, True), (4, False, True), (5, True, True)}
