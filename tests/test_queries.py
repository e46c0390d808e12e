"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from glotta import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("documents", "pages", "events", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(frame, columns):
    def plain(x):
        return round(float(x), 6) if isinstance(x, float) else x.item() if hasattr(x, "item") else x

    return sorted(repr(tuple(map(plain, r))) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), db.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - SQL.keys()))
def test_query_without_sql(spark, name):
    first, again = (sorted(map(str, registry.queries()[name](spark, SF).collect())) for _ in range(2))
    assert first and first == again


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The same rows in twelve files a table, which no reader deals out anew."""
    folder = str(tmp_path_factory.mktemp("many"))
    for name in ("documents", "pages", "events", "conversations", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(12).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["skill_scores", "skills_radar", "error_report", "vocab_example", "grammar_hits", "srs_state", "backup_merge", "targets_in_documents"])
def test_the_number_of_files_changes_nothing(spark, db, many_files, name):
    got, want = registry.queries()[name](spark, many_files).toPandas(), db.execute(SQL[name]).fetchdf()
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_sessions_keep_their_own_word_tables(spark):
    other = spark.newSession()
    assert registry.queries()["vocab_summary"](other, SF).collect() == registry.queries()["vocab_summary"](spark, SF).collect()
    assert other._glotta_dims is not spark._glotta_dims
