"""Patterns that are written for speed against plain ones, over all characters; texts are cut once."""

import pytest
from pyspark.sql import functions as F

from glotta.functions import text as X
from glotta.operators import grammar, vocabulary
from glotta.plans import queries

PLAIN_SPACES = [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]


def characters(spark):
    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    return spark.createDataFrame([(c, chr(c)) for c in codes], "code int, c string")


def test_classes_over_all_characters(spark):
    rows = characters(spark)
    assert sorted(r["code"] for r in rows.where(F.col("c").rlike(X.WS)).collect()) == PLAIN_SPACES
    differ = F.col("c").rlike("(?iu)[0-9A-Za-z_]") != F.col("c").rlike("(?iu)" + X._FOLDED_WORD)
    assert rows.where(differ).count() == 0
    token = F.regexp_extract_all("c", F.lit("[A-Za-zÀ-ÿŒœÆæ]+"), F.lit(0))
    assert rows.where(X.raw_tokens(F.col("c")) != token).count() == 0
    capital = F.regexp_replace("c", "^[^A-Za-zÀ-ÿ]+", "").rlike("^[A-ZÀ-Þ]")
    assert rows.where(vocabulary.is_capital(F.col("c")) != capital).count() == 0


def test_blanks_as_before(spark):
    texts = ["", " ", "a", " a  b\t\nc ", "　a  b ", "a. b  ! c\n\n…  d", "x\n", "  \t", "a  ", ". a", "Long enough sentence here.  And another one? Yes   it is so. "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t, ws = F.col("t"), X.WS
    assert rows.where(X.collapsed(t) != F.regexp_replace(t, f"{ws}+", " ")).count() == 0
    plain = lambda x: F.regexp_replace(x, f"^{ws}++|(?<!{ws}){ws}++$", "")
    assert rows.where(X.trimmed(t) != plain(t)).count() == 0
    parts = F.transform(F.split(F.regexp_replace(t, f"{ws}+", " "), r"(?<=[.!?;:…]) +"), plain)
    assert rows.where(X.sentences(t) != F.filter(parts, lambda s: (F.length(s) > 12) & (F.length(s) < 400))).count() == 0


def test_endings_as_before(spark):
    rows = spark.createDataFrame([(1, "Ais PARLAIS parlais_ xrai rai était chantaient_9 _ais finiront ÉTAIT fermait."), (2, None), (3, "")], "doc_id int, text string")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9A-Za-z_]+"), F.lit(0))
    for rule, _, pattern in grammar.RULES[1:4]:
        ends = grammar._SUFFIX_RULE.fullmatch(pattern)[1]
        want = rows.select("doc_id", F.size(F.filter(words, lambda w: w.rlike(f"(?i).(?:{ends})$"))).alias("n")).where("n > 0")
        got = grammar.grammar_hits(rows).where(F.col("rule") == rule).select("doc_id", F.col("n").cast("int").alias("n"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["sentence_stats"])
def test_sentences_are_cut_once(spark, name):
    plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
