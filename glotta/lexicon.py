"""Language tables: lexicon, function words, irregular verbs.

All are parameters of the operators. The built-in ones are a small start; a full lexicon is read
from a table or from lines ``word|pos|level|gender|gloss`` (``read_lexicon``), irregular verbs
from lines ``infinitive|six present|six subjunctive|future stem|participle,auxiliary``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The order of tenses and persons, and the names of the levels.
TENSES = ["pres", "impar", "pc", "futur", "cond", "subj"]
PERSONS = ["je", "tu", "il/elle", "nous", "vous", "ils/elles"]
LEVELS = {"A1": 1, "A2": 2, "B1": 3, "B2": 4, "C1": 5}

# A core lexicon, word|pos|level|gender|gloss.
LEXICON_LINES = """
être|v|A1||to be
avoir|v|A1||to have
aller|v|A1||to go
faire|v|A1||to do
venir|v|A1||to come
prendre|v|A1||to take
vivre|v|A2||to live
vouloir|v|A1||to want
falloir|v|A2||must
parler|v|A1||to speak
manger|v|A1||to eat
habiter|v|A1||to live in
travailler|v|A1||to work
étudier|v|A1||to study
aimer|v|A1||to like
appeler|v|A2||to call
commencer|v|A1||to begin
finir|v|A1||to finish
préparer|v|A2||to prepare
espérer|v|A2||to hope
acheter|v|A1||to buy
porter|v|B1||to carry
penser|v|A1||to think
rester|v|A1||to stay
décider|v|A2||to decide
cuisiner|v|B1||to cook
attendre|v|A1||to wait
conduire|v|B1||to drive
se lever|v|A1||to get up
maison|n|A1|f|house
problème|n|A1|m|problem
école|n|A1|f|school
université|n|A1|f|university
ville|n|A1|f|town
village|n|A2|m|village
quartier|n|A2|m|district
gare|n|A2|f|station
café|n|A1|m|coffee
eau|n|A1|f|water
livre|n|A1|m|book
jour|n|A1|m|day
année|n|A1|f|year
temps|n|A1|m|time
travail|n|A1|m|work
ami|n|A1|m|friend
enfant|n|A1|m|child
famille|n|A1|f|family
question|n|A1|f|question
changement|n|B1|m|change
société|n|B1|f|society
niveau|n|B2|m|level
opinion|n|B2|f|opinion
hôpital|n|A2|m|hospital
forêt|n|B1|f|forest
bon|adj|A1||good
grand|adj|A1||big
petit|adj|A1||small
vieux|adj|A1||old
difficile|adj|A1||difficult
nécessaire|adj|B1||necessary
souvent|adv|A1||often
vraiment|adv|A2||really
"""

# Function words, which are no vocabulary.
STOP_WORDS = """
le la les l un une des du de d au aux a à et ou où ni mais donc or car que qui quoi dont si comme quand
je tu il elle on nous vous ils elles me te se lui leur leurs y en ce cet cette ces mon ma mes ton ta tes son sa ses
notre nos votre vos par pour avec sans dans sur sous chez vers entre depuis pendant avant après contre selon
ne pas plus jamais rien personne aucun aucune très trop tout toute tous toutes bien peu moins aussi alors ainsi
est sont suis es sommes êtes était étaient été ai as avons avez ont avait avaient sera seront fait faire
déjà encore toujours maintenant ici là même autre autres quel quelle quels quelles comment pourquoi combien
lundi mardi mercredi jeudi vendredi samedi dimanche
""".split()

# Numerals, English words that leak into French, verbs with être, verbs that take a grave accent.
NUMERALS = """zero un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize
vingt trente quarante cinquante soixante quatre-vingts cent mille million milliard""".split()
ENGLISH = """the this is are of with and for to we you have very good like make think because people now want need get
really about what where when not can will my your""".split()
ETRE_VERBS = "aller venir partir arriver entrer sortir monter descendre tomber rester devenir naître mourir retourner rentrer revenir apparaître".split()
GRAVE_VERBS = "acheter racheter mener amener emmener promener ramener lever enlever élever soulever relever peser semer crever geler peler démener".split()

# Irregular verbs, infinitive|present|subjunctive|future stem|participle,auxiliary.
VERB_LINES = """
être|suis,es,est,sommes,êtes,sont|sois,sois,soit,soyons,soyez,soient|ser|été,avoir
avoir|ai,as,a,avons,avez,ont|aie,aies,ait,ayons,ayez,aient|aur|eu,avoir
aller|vais,vas,va,allons,allez,vont|aille,ailles,aille,allions,alliez,aillent|ir|allé,être
faire|fais,fais,fait,faisons,faites,font|fasse,fasses,fasse,fassions,fassiez,fassent|fer|fait,avoir
vouloir|veux,veux,veut,voulons,voulez,veulent|veuille,veuilles,veuille,voulions,vouliez,veuillent|voudr|voulu,avoir
venir|viens,viens,vient,venons,venez,viennent|vienne,viennes,vienne,venions,veniez,viennent|viendr|venu,être
prendre|prends,prends,prend,prenons,prenez,prennent|prenne,prennes,prenne,prenions,preniez,prennent|prendr|pris,avoir
vivre|vis,vis,vit,vivons,vivez,vivent|vive,vives,vive,vivions,viviez,vivent|vivr|vécu,avoir
falloir|faut,faut,faut,faut,faut,faut|faille,failles,faille,faillions,failliez,faillent|faudr|fallu,avoir
"""


def lexicon_rows(lines: str) -> list[tuple[str, str, str, str, str, int]]:
    """(lemma, pos, level, gender, gloss, ord); lines with under four fields are skipped, the last of a word's lines holds."""
    found: dict[str, tuple] = {}
    for line in lines.strip().splitlines():
        parts = line.split("|")
        word = parts[0].strip().lower()
        if len(parts) >= 4 and word:
            # a word keeps the place of its first line
            found[word] = (word, parts[1], parts[2], parts[3], parts[4].strip() if len(parts) > 4 else "")
    return [(*row, k) for k, row in enumerate(found.values())]


def verb_rows(lines: str) -> list[tuple[str, list[str], list[str], str, str, str, int]]:
    """(inf, pres, subj, fut, pp, aux, ord)."""
    found = {}
    for line in lines.strip().splitlines():
        parts = line.split("|")
        if len(parts) >= 5:
            pp, aux = parts[4].split(",")[:2]
            found[parts[0]] = (parts[0], parts[1].split(","), parts[2].split(","), parts[3], pp, aux)
    return [(*row, k) for k, row in enumerate(found.values())]


#: Word tables of up to so many rows are broadcast; larger ones are joined as any table.
MOST_DIM_ROWS = 200_000
_TEXT, _LIST = pa.string(), pa.list_(pa.string())


def _local(spark: SparkSession, rows: list[tuple], columns: dict[str, pa.DataType]) -> DataFrame:
    """A table in the plan itself, whose size Spark knows."""
    values = list(zip(*rows, strict=True)) if rows else [()] * len(columns)
    return spark.createDataFrame(pa.table([pa.array(list(v), t) for v, t in zip(values, columns.values(), strict=True)], names=list(columns)))


def small(df: DataFrame, most: int = MOST_DIM_ROWS) -> DataFrame:
    """A word table worked out once and marked for broadcast, if it has at most ``most`` rows; else as it was."""
    held = df.limit(most + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(held)) if held.num_rows <= most else df


@dataclass(frozen=True)
class Language:
    """The tables of a language, as rows; ``frames`` makes DataFrames of them."""

    lexicon: list[tuple] = field(default_factory=lambda: lexicon_rows(LEXICON_LINES))
    verbs: list[tuple] = field(default_factory=lambda: verb_rows(VERB_LINES))
    stop_words: list[str] = field(default_factory=lambda: list(dict.fromkeys(STOP_WORDS)))

    def lexicon_frame(self, spark: SparkSession) -> DataFrame:
        """The lexicon, with irregular verbs as verbs (level A1 where they weren't in it)."""
        own = _local(spark, self.lexicon, dict.fromkeys(("lemma", "pos", "level", "gender", "gloss"), _TEXT) | {"ord": pa.int32()})
        verbs = self.verbs_frame(spark).select(F.col("inf").alias("lemma"), F.col("ord").alias("verb_ord"))
        return own.join(verbs, "lemma", "full").select(
            "lemma",
            F.when(F.col("verb_ord").isNotNull(), "v").otherwise(F.col("pos")).alias("pos"),
            F.coalesce("level", F.lit("A1")).alias("level"),
            F.coalesce("gender", F.lit("")).alias("gender"),
            F.coalesce("gloss", F.lit("")).alias("gloss"),
            F.coalesce("ord", F.col("verb_ord") + len(self.lexicon)).alias("ord"),
        )

    def verbs_frame(self, spark: SparkSession) -> DataFrame:
        return _local(spark, self.verbs, {"inf": _TEXT, "pres": _LIST, "subj": _LIST, "fut": _TEXT, "pp": _TEXT, "aux": _TEXT, "ord": pa.int32()})

    def words_frame(self, spark: SparkSession, words: list[str]) -> DataFrame:
        return _local(spark, [(w,) for w in dict.fromkeys(words)], {"word": _TEXT})


def read_lexicon(lines: DataFrame) -> DataFrame:
    """A lexicon table from a text source (column ``value``), by the rules of ``lexicon_rows``; lines count in the order of ``line_no``."""
    parts = F.split("value", r"\|")
    rows = lines.select(
        F.lower(F.trim(parts[0])).alias("lemma"),
        parts[1].alias("pos"),
        parts[2].alias("level"),
        parts[3].alias("gender"),
        F.trim(F.coalesce(F.get(parts, F.lit(4)), F.lit(""))).alias("gloss"),
        "line_no",
    ).where((F.size(parts) >= 4) & (F.col("lemma") != ""))
    last = W.partitionBy("lemma").orderBy(F.desc("line_no"))
    first = F.min("line_no").over(W.partitionBy("lemma"))
    return rows.withColumns({"ord": first, "k": F.row_number().over(last)}).where("k = 1").drop("k", "line_no")
