"""The data source of whole files and the table function over packages."""

import os
import time

import pytest
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F

from glotta.sources import datasource, files, table_functions
from tests.test_files import folder  # noqa: F401


@pytest.fixture
def sql(spark):
    datasource.register(spark)
    table_functions.register(spark)
    return spark


def chapters(spark, rows):
    return spark.createDataFrame(rows, "name string, text string")


def read_back(spark, path):
    found = spark.sql("SELECT entry, xml, error FROM package_entries(TABLE(SELECT content FROM {books}))", books=spark.read.format("glotta_files").load(str(path)))
    return sorted((r.entry.rsplit("/", 1)[1].removesuffix(".xhtml"), r.xml, r.error) for r in found.collect())


def test_the_source_gives_the_texts_of_binary_files(sql, folder):  # noqa: F811
    name = F.regexp_extract("path", "[^/]+$", 0).alias("name")
    texts = [files.texts_of(x).select(name, "kind", "text").collect() for x in (files.read_files(sql, str(folder)), files.described(sql.read.format("glotta_files").load(str(folder))))]
    assert sorted(texts[0]) == sorted(texts[1]) and len(texts[0]) == 15


def test_filters_and_patterns_choose_files_before_they_are_opened(sql, folder):  # noqa: F811
    (folder / "_hidden.txt").write_text("x")
    sql.sql(f"CREATE OR REPLACE TEMPORARY VIEW some USING glotta_files OPTIONS (path '{folder}')")
    query = sql.sql("SELECT path FROM some WHERE path LIKE '%.docx' AND length > 30")
    plan = sql._jvm.PythonSQLUtils.explainString(query._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [StringEndsWith(path,.docx), GreaterThan(length,30)]" in plan
    assert sorted(r.path.rsplit("/", 1)[1] for r in query.collect()) == ["a.docx", "cells.docx"]
    patterned = sql.read.format("glotta_files").option("pattern", "*.rtf").load(str(folder))
    assert [r.path.rsplit("/", 1)[1] for r in patterned.collect()] == ["f.rtf"]
    assert sql.sql("SELECT * FROM some WHERE length < 0").count() == 0


def test_a_large_file_is_a_row_without_content(sql, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x" * 100)
    (tmp_path / "b.txt").write_bytes(b"")
    rows = sql.read.format("glotta_files").option("most_bytes", 99).load(str(tmp_path)).collect()
    assert sorted((r.length, r.content) for r in rows) == [(0, b""), (100, None)]


def test_files_are_dealt_by_bytes():
    found = [datasource.File(str(k), n, k) for k, n in enumerate([10, 10, 500_000, 10, 10**9])]
    parts = datasource.dealt(found, 200_000, 10**8)
    assert [[f.length for f in p.files] for p in parts] == [[10, 10], [500_000], [10, 10**9]]
    assert datasource.dealt([], 1, 1) == []
    small = [datasource.File(str(k), 1000, k) for k in range(20)]
    assert [len(datasource.dealt(small, 10**8, 10**8, n)) for n in (1, 4, 10, 99)] == [1, 4, 10, 20]


@pytest.mark.parametrize("book_bytes", [1, 50, 2**24])
def test_books_give_back_their_chapters(sql, tmp_path, book_bytes):
    rows = [("1", "<p>a & b</p>"), ("1", "<p>a & b</p>"), ("2", ""), ("3", None), (None, "é\r\n\x01"), ("long", "mot " * 500_000)]
    chapters(sql, rows).repartition(3).write.format("glotta_files").option("book_bytes", book_bytes).mode("append").save(str(tmp_path / "b"))
    assert read_back(sql, tmp_path / "b") == sorted((n or "", t or "", None) for n, t in rows)
    assert not [x for x in os.listdir(tmp_path / "b") if x.startswith("_")]


def test_append_adds_and_overwrite_replaces(sql, tmp_path):
    for mode, text in (("append", "a"), ("append", "b"), ("overwrite", "c")):
        chapters(sql, [("1", text)]).write.format("glotta_files").mode(mode).save(str(tmp_path / "b"))
        assert [x for _, x, _ in read_back(sql, tmp_path / "b")] == {"a": ["a"], "b": ["a", "b"], "c": ["c"]}[text]
    chapters(sql, []).write.format("glotta_files").mode("overwrite").save(str(tmp_path / "b"))
    assert read_back(sql, tmp_path / "b") == []


def test_a_failed_write_leaves_nothing(sql, tmp_path):
    bad = chapters(sql, [("1", "a"), ("2", "b")]).repartition(2).withColumn("text", F.when(F.col("name") == "2", F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    chapters(sql, [("0", "old")]).write.format("glotta_files").mode("append").save(str(tmp_path / "b"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("glotta_files").mode("overwrite").save(str(tmp_path / "b"))
    assert [x for _, x, _ in read_back(sql, tmp_path / "b")] == ["old"]
    assert not [x for x in os.listdir(tmp_path / "b") if x.startswith("_")]


def test_a_task_that_is_repeated_counts_once(tmp_path, monkeypatch):
    class Context:
        attempts = iter(range(9))

        @classmethod
        def get(cls):
            return cls

        @classmethod
        def taskAttemptId(cls):
            return next(cls.attempts)

    import pyarrow as pa

    monkeypatch.setattr(datasource, "TaskContext", Context)
    writer = datasource.BookWriter(str(tmp_path / "b"), False, 10)
    rows = lambda: iter([pa.RecordBatch.from_pydict({"name": ["1", "2"], "text": ["x" * 8, "y" * 8]})])
    writer.write(rows())
    writer.commit([writer.write(rows()), None])
    assert len(os.listdir(tmp_path / "b")) == 2


def test_a_stream_takes_each_file_once_over_a_restart(sql, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()

    def put(name, age):
        (source / name).write_text(name)
        os.utime(source / name, (time.time() - age,) * 2)

    def run():
        stream = sql.readStream.format("glotta_files").option("settle_seconds", 30).load(str(source))
        query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(r.path.rsplit("/", 1)[1] for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    put("a.txt", 300), put("b.txt", 200), put("unsettled.txt", 0)
    run()
    assert sorted(seen) == ["a.txt", "b.txt"]
    put("c.txt", 100)
    run()
    run()
    assert sorted(seen) == ["a.txt", "b.txt", "c.txt"]


def test_the_function_keeps_columns_and_tells_damages(sql, folder):  # noqa: F811
    view = sql.read.format("glotta_files").load(str(folder)).where("path LIKE '%.docx'").selectExpr("7 AS Path", "content AS Content", "CAST(NULL AS DATE) AS day")
    found = sql.sql("SELECT * FROM package_entries(TABLE(SELECT * FROM {v}), entries => 'DOCUMENT[.]xml$', most_bytes => 90)", v=view)
    assert found.columns == ["Path", "day", "entry", "xml", "error"]
    rows = found.collect()
    assert {r.Path for r in rows} == {7} and sum(r.error is None for r in rows) == 0
    assert sorted(r.error.split(":")[0] for r in rows) == ["no directory", "over 90 bytes", "over 90 bytes"]
    assert sql.sql("SELECT * FROM package_entries(TABLE(SELECT CAST(NULL AS BINARY) AS content))").count() == 0


@pytest.mark.parametrize(
    "query",
    ["package_entries('x')", "package_entries(TABLE(SELECT 'x' AS content))", "package_entries(TABLE(SELECT X'00' AS content, 1 AS Entry))", "package_entries(TABLE(SELECT X'00' AS content), entries => '(')", "package_entries(TABLE(SELECT X'00' AS content), most_bytes => 'a')"],
)
def test_wrong_arguments_are_refused_before_the_query_runs(sql, query):
    with pytest.raises((AnalysisException, PythonException)):
        sql.sql(f"SELECT * FROM {query}")


def test_wrong_columns_and_options_are_refused(sql, tmp_path):
    with pytest.raises(Exception, match="name and text"):
        sql.range(1).write.format("glotta_files").mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="zero or more"):
        sql.read.format("glotta_files").option("most_bytes", -1).load(str(tmp_path)).count()
    with pytest.raises(Exception, match="FileNotFoundError|none"):
        sql.read.format("glotta_files").load(str(tmp_path / "none")).count()
