"""Values of a megabyte and more, made of what each pattern repeats: no pattern may need a stack or the square of its input."""

import time

import pytest
from pyspark.sql import functions as F

from glotta.functions import text as X
from glotta.operators import grammar, vocabulary
from glotta.sources import files

MB = 1_000_000
REPEATED = ["a-", "a", "l'", "é", "a ", "\t", "\n", "\xa0", ". ", "a\n", "-\n", "| ", "&#65;", "é(é) ", "que il ", "ne va "]


def test_text_functions(spark):
    rows = spark.createDataFrame(list(enumerate(REPEATED)), "doc_id bigint, part string").repartition(8, "doc_id")
    times = (F.lit(MB) / F.length("part")).cast("int")
    docs = rows.select("doc_id", F.concat(F.lit("x"), F.repeat("part", times), F.lit("y")).alias("text"))
    began = time.time()
    found = docs.select(
        F.size(X.raw_tokens(F.col("text"))).alias("tokens"), F.size(X.sentences(F.col("text"))).alias("sentences"), X.word_count(F.col("text")).alias("words"),
        F.length(X.french_clean(F.col("text"))).alias("clean"), F.length(X.page_clean(F.col("text"))).alias("page"), X.text_quality(F.col("text")).alias("quality"),
        F.length(X.normal_answer(F.col("text"))).alias("normal"), F.length(X.unescape(F.col("text"))).alias("unescaped"), (F.length(X.trimmed(F.col("text"))) == F.length("text")).alias("whole"),
    ).collect()
    assert len(found) == len(REPEATED) and all(r["whole"] and r["tokens"] >= 1 for r in found)
    assert vocabulary.token_counts(docs).count() == len(REPEATED)
    assert grammar.grammar_hits(docs).count() >= 3
    assert time.time() - began < 240


def test_one_token_of_many_parts(spark):
    found = spark.range(1).select(X.raw_tokens(F.concat(F.repeat(F.lit("a-"), 500_000), F.lit("a"))).alias("x")).first()["x"]
    assert len(found) == 1 and len(found[0]) == 1_000_001


def rtf(spark, body, **options):
    frame = spark.createDataFrame([("a.rtf", body, True, "rtf")], "path string, content binary, accepted boolean, kind string")
    return [r["text"] for r in files.rtf_texts(frame).collect()]


def test_rtf_of_ordinary_size(spark):
    theme = b"0123456789abcdef" * (5 * MB // 16)
    body = rb"{\rtf1{\*\themedata {" + theme + rb"}}\pard Bonjour {\b tout} le monde\par}"
    assert rtf(spark, body) == ["\\* Bonjour tout le monde"]  # the star of the group stays, as nothing follows it


def test_rtf_groups_of_any_depth(spark):
    deep = b"{a" * 50 + b" secret" + b"}" * 50
    assert rtf(spark, rb"{\rtf1\info" + deep + b" clair}") == ["clair"]
    assert rtf(spark, rb"{\rtf1\info" + b"{x" * 300_000 + b"}" * 300_000 + b" clair}") == ["clair"]
    assert rtf(spark, rb"{\rtf1 avant \stylesheet{\s0 sans fin {x} reste") == ["avant"]


def test_rtf_quirks(spark):
    # the first group after the name goes, others stay; without a group all up to a semicolon
    assert rtf(spark, rb"{\rtf1{\fonttbl{\f0 Arial;}{\f1 Times;}} texte}") == ["Times; texte"]
    assert rtf(spark, rb"{\rtf1{\*\generator Writer 5;} texte}") == ["\\* texte"]
    assert rtf(spark, rb"{\rtf1\information{garde} texte}") == ["garde texte"]
    assert rtf(spark, rb"{\rtf1" + rb"\falt{x}" * 41 + b" texte}") == ["x texte"]
    assert rtf(spark, b" \n{ \\rtf1 texte}") == ["texte"]
    assert rtf(spark, b"no rich text") == []


@pytest.mark.parametrize("body,kind", [
    (b" \n {  \\rtf1 x}", "rtf"), (b"{\\rtf1 x}", "rtf"), (b"\xd0\xcf\x11\xe0" + b"\0" * 600 + b"PowerPoint Document", "ppt"),
    (b"\xd0\xcf\x11\xe0" + b"\0" * 5000 + "PowerPoint".encode("utf-16-le"), "ppt"), (b"\xd0\xcf\x11\xe0" + b"\0" * 9000 + b"PowerPoint", "doc"), (b"PK\x03\x04", "zip"), (b"%PDF-1", "pdf"), (b"plain", "txt"),
])
def test_kinds_by_content(spark, body, kind):
    frame = spark.createDataFrame([("/x/noname", body)], "path string, content binary")
    assert frame.select(files.kind_of(F.col("path"), F.col("content")).alias("k")).first()["k"] == kind


def test_blanked_and_cloze(spark):
    rows = [("La Maison, la maison.", "maison"), ("a.b axb A.B", "a.b"), ("rien", "maison"), ("Il se lève", "lève"), ("Se lever tôt", "se lever"), ("éxécole", "école")]
    frame = spark.createDataFrame(rows, "s string, l string")
    got = [tuple(r) for r in frame.select(X.blanked(F.col("s"), F.col("l"), "[...]"), X.cloze(F.col("s"), F.col("l"))).collect()]
    assert got == [("La [...], la [...].", "La ______, la maison."), ("[...] axb [...]", "______ axb A.B"), ("rien", None), ("Il se [...]", "Il se ______"), ("[...] tôt", "______ tôt"), ("éx[...]", "éx______")]


def test_examples_by_the_index(spark):
    texts = [(1, "Une première phrase ici. Les maisons sont grandes. La maison est là."), (2, "Rien du tout ici. On va SE LEVER demain matin. Il a un xÉcole ici."), (3, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    asked = [(1, "maison"), (1, "mai"), (1, "grand"), (1, "va"), (2, "se lever"), (2, "école"), (2, "a"), (3, "x"), (4, "y")]
    want = {(1, "maison"): "Les maisons sont grandes.", (1, "mai"): "Les maisons sont grandes.", (1, "grand"): "Les maisons sont grandes.", (2, "se lever"): "On va SE LEVER demain matin.", (2, "école"): "Il a un xÉcole ici.", (2, "a"): "Il a un xÉcole ici."}
    vocab = spark.createDataFrame(asked, "doc_id bigint, lemma string")
    assert {(r["doc_id"], r["lemma"]): r["example"] for r in vocabulary.with_example(vocab, docs).collect()} == {k: want.get(k) for k in asked}
    assert "RLIKE" not in vocabulary.with_example(vocab, docs)._jdf.queryExecution().toString()


def test_examples_of_many_lemmas(spark):
    text = " ".join(f"Phrase {k} avec le mot m{k}{'abc'[k % 3]} dedans." for k in range(300))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    vocab = spark.createDataFrame([(1, f"m{k}") for k in range(300)], "doc_id bigint, lemma string")
    got = {r["lemma"]: r["example"] for r in vocabulary.with_example(vocab, docs).collect()}
    first = {f"m{k}": next(j for j in range(300) if str(j).startswith(str(k))) for k in range(300)}
    assert got == {m: f"Phrase {j} avec le mot m{j}{'abc'[j % 3]} dedans." for m, j in first.items()}
