"""Conjugation tables and the index from inflected forms to verbs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glotta.functions.french import auxiliary, conjugation
from glotta.lexicon import TENSES


def verb_list(lexicon: DataFrame, verbs: DataFrame) -> DataFrame:
    """Every verb once (inf, verb_ord) with its irregular forms or nulls: irregular ones first, then the lexicon's."""
    listed = lexicon.where("pos = 'v'").select(F.col("lemma").alias("inf"), F.col("ord").alias("lex_ord"))
    joined = verbs.join(listed, "inf", "full")
    return joined.withColumn("verb_ord", F.struct(F.coalesce("ord", F.lit(2**30)).alias("a"), F.coalesce("lex_ord", F.lit(-1)).alias("b")))


def conjugations(lexicon: DataFrame, verbs: DataFrame) -> DataFrame:
    """(inf, tense, tense_ord, person, form, verb_ord): six rows for each verb and tense; person counts from 0."""
    aux = verbs.where(F.col("inf").isin("être", "avoir")).select(F.col("inf").alias("aux_used"), F.col("pres").alias("aux_pres"))
    base = verb_list(lexicon, verbs).withColumn("aux_used", F.coalesce("aux", auxiliary(F.col("inf")))).join(aux, "aux_used", "left")
    own = {k: F.col(k) for k in ("pres", "subj", "fut", "pp", "aux", "aux_pres")}
    forms = [
        F.struct(F.lit(t).alias("tense"), F.lit(k).alias("tense_ord"), conjugation(F.col("inf"), t, **own).alias("forms"))
        for k, t in enumerate(TENSES)
    ]
    return base.select("inf", "verb_ord", F.explode(F.array(*forms)).alias("x")).select(
        "inf", F.col("x.tense").alias("tense"), F.col("x.tense_ord").alias("tense_ord"), F.posexplode("x.forms").alias("person", "form"), "verb_ord"
    )


def verb_forms(lexicon: DataFrame, verbs: DataFrame) -> DataFrame:
    """(form, inf): each inflected form of over two letters with the first verb that has it.

    Of a form of several words the last counts. Participles after être also stand in their three
    agreed forms. Infinitives themselves are no forms.
    """
    table = conjugations(lexicon, verbs)
    last = table.withColumn("form", F.lower(F.element_at(F.split("form", " "), -1)))
    participles = last.where("tense = 'pc' and person = 0").where(auxiliary(F.col("inf")) == "être")
    agreed = participles.select(
        "inf", "tense", "tense_ord", "verb_ord", F.posexplode(F.transform(F.array(*map(F.lit, ("e", "s", "es"))), lambda e: F.concat("form", e))).alias("k", "form")
    ).select("inf", "tense", "tense_ord", (F.col("k") + 6).alias("person"), "form", "verb_ord")
    every = last.unionByName(agreed).where((F.length("form") > 2) & (F.col("form") != F.col("inf")))
    first = W.partitionBy("form").orderBy("verb_ord", "tense_ord", "person")
    return every.withColumn("k", F.row_number().over(first)).where("k = 1").select("form", "inf")
