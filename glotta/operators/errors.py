"""Typical learner errors: a token's neighbours and its dictionary entries decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glotta.functions import text as X
from glotta.functions.french import auxiliary
from glotta.lexicon import ENGLISH, small

# Words that the detectors look for; the oral negation; level of each error.
DETERMINERS = "le la les ma mon ta ton sa son notre votre leur ce cette cet ces".split()
ETRE_FORMS = "suis es est sommes êtes sont".split()
ORAL_NEGATION = r"\b(j'ai|je|tu|il|elle|on|nous|vous|ils|elles)\s+(ai|as|a|avons|avez|ont|suis|es|est|sont)\s+pas\b"
ERROR_LEVELS = {"accent": "A1", "genre": "A1", "articles": "A2", "de": "A1", "que_qui": "B1", "aux": "A1", "neg": "A2"}
_NEG_ORDER = 2**40


def accent_index(lexicon: DataFrame, stop_words: DataFrame) -> DataFrame:
    """(w, meant): words that are a lexicon word without its accents, and are no words themselves."""
    bare = lexicon.select(X.strip_accents(F.col("lemma")).alias("w"), "lemma", "ord").where("w != lemma")
    known = lexicon.select(F.col("lemma").alias("w")).unionByName(stop_words.select(F.col("word").alias("w")))
    return bare.join(known, "w", "left_anti").groupBy("w").agg(F.min_by("lemma", "ord").alias("meant"))


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, raw, w, before, raw_before, after, raw_after): each token with those beside it, without a shuffle."""
    lists = docs.select("doc_id", X.raw_tokens(F.col("text")).alias("raws"))
    lists = lists.select("doc_id", "raws", F.transform("raws", X.word_of).alias("ws"))
    none = F.array(F.lit(None).cast("string"))
    # cut to the list's own length, so that an empty list stays empty
    moved = lambda x, name: (F.slice(F.concat(none, x), F.lit(1), F.size(x)).alias(f"{name}before"), F.slice(F.concat(x, none), F.lit(2), F.size(x)).alias(f"{name}after"))
    zipped = F.arrays_zip(F.col("raws").alias("raw"), F.col("ws").alias("w"), *moved("ws", ""), *moved("raws", "raw_"))
    return lists.select("doc_id", F.posexplode(zipped).alias("pos", "x")).select("doc_id", "pos", "x.*")


def error_issues(docs: DataFrame, lexicon: DataFrame, forms: DataFrame, stop_words: DataFrame, english: list[str] = ENGLISH) -> DataFrame:
    """(doc_id, ord, error, snippet): every issue, in the order of the text."""
    near = neighbours(docs)
    genders = lexicon.select(F.col("lemma").alias("w"), "gender")
    verb = forms.select(F.col("form").alias("w"), F.col("inf").alias("verb"))
    verb_after = forms.select(F.col("form").alias("after"), F.lit(True).alias("verb_follows"))
    w, before = F.col("w"), F.col("before")
    # of the tokens few can be in error; only those meet the other tables
    near = near.join(small(accent_index(lexicon, stop_words)), "w", "left")
    near = near.where(F.col("meant").isNotNull() | w.isin([*english, "a", "de", "que"]) | before.isin("le", "la", "un", "une", *ETRE_FORMS))
    marked = near.join(genders, "w", "left").join(verb, "w", "left").join(verb_after, "after", "left")
    after = F.col("after")
    masculine = before.isin("le", "un")
    pair = F.concat_ws(" ", "raw_before", "raw")
    checks = [
        ("accent", F.col("meant").isNotNull(), F.col("raw")),
        ("english", w.isin(english), F.col("raw")),
        ("genre", before.isin("le", "la", "un", "une") & (F.col("gender") != "") & (masculine != (F.col("gender") == "m")), pair),
        ("articles", (w == "a") & after.isin(DETERMINERS), F.concat_ws(" ", "raw_before", F.lit("a"), "raw_after")),
        ("de", (w == "de") & after.isin("le", "les"), F.concat(F.lit("de "), "raw_after")),
        ("que_qui", (w == "que") & F.col("verb_follows"), F.concat(F.lit("que "), "raw_after")),
        ("aux", before.isin(ETRE_FORMS) & (auxiliary(F.col("verb")) == "avoir") & F.col("verb").isNotNull(), pair),
    ]
    found = F.array(*(F.when(cond, F.struct(F.lit(name).alias("error"), F.lit(k).alias("k"), snippet.alias("snippet"))) for k, (name, cond, snippet) in enumerate(checks)))
    by_token = marked.select("doc_id", "pos", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(
        "doc_id", (F.col("pos").cast("bigint") * len(checks) + F.col("x.k")).alias("ord"), "x.error", "x.snippet"
    )
    hits = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(X.ascii_rule(ORAL_NEGATION)), F.lit(0))
    by_text = docs.select("doc_id", F.posexplode(hits).alias("k", "hit")).select(
        "doc_id", (F.col("k") + F.lit(_NEG_ORDER)).alias("ord"), F.lit("neg").alias("error"), X.trimmed(F.col("hit")).alias("snippet")
    )
    return by_token.unionByName(by_text)


def error_groups(issues: DataFrame) -> DataFrame:
    """(doc_id, error, level, n, first_ord, samples): issues by kind, with the first four snippets."""
    first = W.partitionBy("doc_id", "error").orderBy("ord")
    sample = F.when(F.col("k") <= 4, F.struct("ord", "snippet"))
    level = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ERROR_LEVELS.items() for x in kv)), F.col("error")), F.lit("?"))
    return (
        issues.withColumn("k", F.row_number().over(first))
        .groupBy("doc_id", "error")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"), F.array_sort(F.collect_list(sample)).alias("s"))
        .select("doc_id", "error", level.alias("level"), "n", "first_ord", F.col("s.snippet").alias("samples"))
    )


# What is said beside an example of these errors; the others speak for themselves.
HINTS = {"english": "looks like an English word", "neg": "in writing: ne ... pas"}


def error_report(issues: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, rank, error, level, n, samples): each document's errors, the most frequent first, ties by the first place; samples with hints."""
    noun = F.lower(F.element_at(F.split("snippet", " "), -1))
    nouns = lexicon.select(F.col("lemma").alias("_noun"), F.col("gender").alias("_gender"))
    gender = F.when((F.col("error") == "genre") & F.col("_gender").isNotNull(), F.concat(F.lit("should be "), F.when(F.col("_gender") == "m", "le ").otherwise("la "), noun))
    hint = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in HINTS.items() for x in kv)), F.col("error")), gender)
    hinted = issues.withColumn("_word", F.when(F.col("error") == "genre", X.word_of(noun))).join(nouns, F.col("_word") == F.col("_noun"), "left")
    hinted = hinted.withColumn("snippet", F.concat("snippet", F.coalesce(F.concat(F.lit("  — "), hint), F.lit("")))).select(*issues.columns)
    order = W.partitionBy("doc_id").orderBy(F.desc("n"), "first_ord")
    return error_groups(hinted).withColumn("rank", F.row_number().over(order)).select("doc_id", "rank", "error", "level", "n", "samples")
