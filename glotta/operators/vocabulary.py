"""Tokens, sentences, lemmas and the vocabulary of a corpus.

The word tables (lexicon, forms, stop words) are dimension tables; ``lexicon.small`` marks them for
broadcast while they have a bounded number of rows. Counting shuffles once by document and
surface word, so all later steps work on distinct words of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glotta.functions import text as X
from glotta.functions.french import guessed_level, guessed_pos
from glotta.lexicon import NUMERALS, small

# Endings that are taken off to find a lemma, in order.
SUFFIXES = ["ées", "ée", "és", "s", "x", "inement"]


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, raw, w, prefix) of all texts; null texts have none."""
    return docs.select("doc_id", F.posexplode(X.raw_tokens(F.col("text"))).alias("pos", "raw")).select(
        "doc_id", "pos", "raw", X.word_of(F.col("raw")).alias("w"), X.elision(F.col("raw")).alias("prefix")
    )


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_distinct) of the texts that have tokens; the words of a document stay one array, so nothing is shuffled."""
    lettered = F.col("text").rlike("[A-Za-zÀ-ÿŒœÆæ]")  # a filter on the words would work them out twice
    found = docs.where(lettered).select("doc_id", X.words(F.col("text")).alias("words"))
    size = lambda x: F.size(x).cast("bigint")
    return found.select("doc_id", size("words").alias("n_tokens"), size(F.array_distinct("words")).alias("n_distinct"))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_no, sentence)."""
    return docs.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sent_no", "sentence"))


def is_capital(raw: Column) -> Column:
    first = F.substring(raw, 1, 1)  # an ASCII letter decides without a pattern
    return F.when(first.between("a", "z"), False).when(first.between("A", "Z"), True).otherwise(raw.rlike("^[^A-Za-zÀ-ÿ]*+[A-ZÀ-Þ]"))


def surface_lemmas(lexicon: DataFrame) -> DataFrame:
    """(w, lemma): every surface word that is a lexicon word, or one with an ending; the first way wins."""
    ways = [F.struct(F.col("lemma").alias("w"), F.lit(0).alias("way"))]
    for k, suffix in enumerate(SUFFIXES):
        stem = F.col("lemma")
        ways.append(F.struct(F.when(F.length(stem) > 2, F.concat(stem, F.lit(suffix))).alias("w"), F.lit(1 + 2 * k).alias("way")))
        cut = F.regexp_replace(stem, "e$", "")
        ways.append(F.struct(F.when(stem.endswith("e") & (F.length(cut) > 2), F.concat(cut, F.lit(suffix))).alias("w"), F.lit(2 + 2 * k).alias("way")))
    every = lexicon.select("lemma", F.explode(F.array(*ways)).alias("x")).select("lemma", "x.w", "x.way").where("w is not null")
    return every.groupBy("w").agg(F.min_by("lemma", "way").alias("lemma"), F.min("way").alias("way"))


def surface_words(docs: DataFrame) -> DataFrame:
    """(doc_id, w, n, caps, first_pos, forms): the distinct surface words of each document."""
    return (
        tokens(docs)
        .groupBy("doc_id", "w")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(is_capital(F.col("raw"))).alias("caps"),
            F.min("pos").cast("bigint").alias("first_pos"),
            F.collect_set(F.lower("raw")).alias("forms"),
        )
    )


def lemmatised(words: DataFrame, lexicon: DataFrame, forms: DataFrame) -> DataFrame:
    """``words`` (w) with lemma, in_lexicon, pos (null if unknown), level, gender, gloss, is_form.

    A lexicon word comes first, then the word without apostrophes, then without an ending, then
    the verb of an inflected form; else the word is its own lemma.
    """
    by_surface = small(surface_lemmas(lexicon)).select("w", F.col("lemma").alias("by_surface"), "way")
    by_letters = lexicon.select(F.col("lemma").alias("letters"), F.col("lemma").alias("by_letters"))
    by_form = forms.select(F.col("form").alias("w"), F.col("inf").alias("by_form"))
    found = (
        words.withColumn("letters", F.replace(F.replace("w", F.lit("'"), F.lit("")), F.lit("’"), F.lit("")))
        .join(by_surface, "w", "left")
        .join(by_letters, "letters", "left")
        .join(by_form, "w", "left")
        .withColumn("own", F.when(F.col("way") == 0, F.col("by_surface")).otherwise(F.coalesce("by_letters", "by_surface")))
        .withColumn("lemma", F.coalesce("own", "by_form", "w"))
        .withColumn("is_form", F.col("by_form").isNotNull())
        .drop("by_surface", "way", "letters", "by_letters", "by_form")
    )
    dims = lexicon.select("lemma", "pos", "level", "gender", "gloss", F.lit(True).alias("in_lexicon"))
    return found.join(dims, "lemma", "left").withColumns(
        {"in_lexicon": F.coalesce("in_lexicon", F.lit(False)), "pos": F.when(F.col("own").isNull() & F.col("is_form"), "v").otherwise(F.col("pos"))}
    ).drop("own")


def vocabulary(docs: DataFrame, lexicon: DataFrame, forms: DataFrame, stop_words: DataFrame, numerals: list[str] = NUMERALS) -> DataFrame:
    """(doc_id, lemma, n, forms, first_pos, pos, level, gender, gloss, in_lexicon, level_guess, gloss_guess).

    Kept are words of 3 to 26 letters that are no numerals, whose lemma and surface are no stop
    words; unknown words that only occur capitalised count as names and go.
    """
    gated = surface_words(docs).where(F.length("w").between(3, 26)).where(~X.is_number_word(F.col("w"), numerals))
    known = lemmatised(gated, lexicon, forms).where(F.col("in_lexicon") | (F.col("caps") < F.col("n")))
    kept = known.join(stop_words.select(F.col("word").alias("lemma")), "lemma", "left_anti").join(stop_words.select(F.col("word").alias("w")), "w", "left_anti")
    return (
        kept.groupBy("doc_id", "lemma")
        .agg(
            F.sum("n").alias("n"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("forms")))).alias("forms"),
            F.min("first_pos").alias("first_pos"),
            F.min_by(F.struct("pos", "level", "gender", "gloss", "in_lexicon", "is_form"), "first_pos").alias("x"),
        )
        .select(
            "doc_id",
            "lemma",
            "n",
            "forms",
            "first_pos",
            F.coalesce("x.pos", guessed_pos(F.col("lemma"), F.col("x.is_form"))).alias("pos"),
            F.coalesce("x.level", guessed_level(F.col("lemma"), F.col("n"))).alias("level"),
            F.coalesce("x.gender", F.lit("")).alias("gender"),
            F.coalesce("x.gloss", F.lit("")).alias("gloss"),
            F.col("x.in_lexicon").alias("in_lexicon"),
            F.col("x.level").isNull().alias("level_guess"),
            (F.coalesce("x.gloss", F.lit("")) == "").alias("gloss_guess"),
        )
    )


def ranked(vocab: DataFrame) -> DataFrame:
    """``vocab`` with ``rank`` in its document: most frequent first, ties by first place."""
    return vocab.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "first_pos")))


#: Letters of a lemma that are looked up before the lemma is compared.
_KEY = 3
#: A document asked for so many keys lists all its words.
_MANY_KEYS = 64


def first_words(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, key, piece, sent_no): the index of a document's word beginnings, each distinct one with its first sentence.

    asked: doc_id, low, key, the lower-cased lemmas to be found and their first letters. A piece goes to
    the next blank, for lemmas with a blank to the end of its sentence; only pieces with a key that is asked for
    are listed. All of it happens in the document's row.
    """
    long = F.when(F.col("low").contains(" "), F.col("key"))
    wanted = asked.groupBy("doc_id").agg(F.collect_set("key").alias("keys"), F.collect_set(long).alias("long_keys"))
    near = lambda piece, keys: F.exists(F.sequence(F.lit(1), F.lit(_KEY)), lambda n: F.array_contains(keys, F.substring(piece, F.lit(1), n)))

    def pieces(sentence: Column) -> Column:
        short = F.filter(X.word_beginnings(sentence), lambda p: (F.size("keys") > _MANY_KEYS) | near(p, F.col("keys")))
        rest = F.filter(X.word_beginnings(sentence, to_blank=False), lambda p: near(p, F.col("long_keys")))
        return F.array_distinct(F.concat(short, F.when(F.size("long_keys") > 0, rest).otherwise(F.array().cast("array<string>"))))

    lists = docs.select("doc_id", X.sentences(F.col("text")).alias("sentences")).join(wanted, "doc_id")
    every = F.flatten(F.transform("sentences", lambda s, k: F.transform(pieces(s), lambda p: F.struct(p.alias("piece"), k.alias("sent_no")))))
    lists = lists.select("doc_id", "keys", F.sort_array(every).alias("found"))
    first = F.filter("found", lambda x, k: (k == 0) | (F.get("found", k - 1)["piece"] != x["piece"]))
    rows = lists.select("doc_id", "keys", F.explode(first).alias("x")).select("doc_id", "keys", "x.*")
    keys = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(_KEY)), lambda n: F.substring("piece", F.lit(1), n)))
    return rows.select("doc_id", F.explode(F.array_intersect(keys, "keys")).alias("key"), "piece", "sent_no")


def with_example(vocab: DataFrame, docs: DataFrame) -> DataFrame:
    """``vocab`` with ``example``, the first sentence that has a word beginning with the lemma, or null.

    Lemmas meet the document's index of word beginnings by document and first letters, and are
    compared there. The word beginning is an ASCII one, so lemmas that begin with an accented
    letter have no example after a space. The sentences found are read from the document again.
    """
    low = F.lower("lemma")
    asked = vocab.select("doc_id", "lemma", low.alias("low"), F.substring(low, 1, _KEY).alias("key"))
    met = first_words(docs, asked).join(asked, ["doc_id", "key"]).where(F.startswith("piece", F.col("low")))
    places = met.groupBy("doc_id", "lemma").agg(F.min("sent_no").alias("sent_no"))
    by_doc = places.groupBy("doc_id").agg(F.collect_list(F.struct("lemma", "sent_no")).alias("places"))
    lists = docs.select("doc_id", X.sentences(F.col("text")).alias("sentences")).join(by_doc, "doc_id")
    found = F.transform("places", lambda x: F.struct(x["lemma"].alias("lemma"), F.get("sentences", x["sent_no"]).alias("example")))
    examples = lists.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")
    return vocab.join(examples, ["doc_id", "lemma"], "left")


def coverage(vocab: DataFrame, lexicon: DataFrame, levels: dict[str, int], target: int) -> DataFrame:
    """(n_core, n_known, percent): the part of the lexicon up to a level that the vocabulary has; unknown levels count as 3."""
    level = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in levels.items() for x in kv)), F.col("level")), F.lit(3))
    core = lexicon.where(level <= target).select("lemma").join(vocab.select("lemma", F.lit(1).alias("known")).distinct(), "lemma", "left")
    counted = core.agg(F.count(F.lit(1)).alias("n_core"), F.count("known").alias("n_known"))
    return counted.withColumn("percent", F.floor(100.0 * F.col("n_known") / F.greatest(F.col("n_core"), F.lit(1)) + 0.5))
