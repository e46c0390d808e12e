"""Documents without a token, alone and among others: the error queries give the rows of their SQL."""

import duckdb
import pytest

from glotta import registry
from glotta.operators import errors
from tests.test_queries import SF, SQL, rows

BARE = [None, "", "12 345, 6.", " \n\t", "…"]
TEXTS = [*BARE, "the", "la village j'ai pas de les maison the", "Ecole a le problème. Je suis pas une livre.", "que parle"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    found = []
    for texts in (TEXTS, BARE):
        folder = str(tmp_path_factory.mktemp("bare"))
        docs = [(k, t, "fr", "web", len(t or "")) for k, t in enumerate(texts)]
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/events.parquet").write.parquet(f"{folder}/events.parquet")
        found.append(folder)
    return found


def test_neighbours(spark):
    docs = spark.createDataFrame([*enumerate([*BARE, "Un", "La l'eau"])], "doc_id bigint, text string")
    found = errors.neighbours(docs).select("doc_id", "pos", "raw", "w", "before", "raw_before", "after", "raw_after").orderBy("doc_id", "pos").collect()
    assert [tuple(r) for r in found] == [
        (5, 0, "Un", "un", None, None, None, None),
        (6, 0, "La", "la", None, None, "eau", "l'eau"),
        (6, 1, "l'eau", "eau", "la", "La", None, None),
    ]


@pytest.mark.parametrize("name", ["error_hits", "error_report", "skill_scores", "skills_radar"])
def test_query(spark, folders, name):
    for folder in folders:
        con = duckdb.connect()
        for table in ("documents", "events"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        got, want = registry.queries()[name](spark, folder).toPandas(), con.execute(SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
        assert len(want) or folder == folders[-1]
