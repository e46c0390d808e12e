"""Progress reports over card states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _percent(part, whole):
    """Halves round up, as the reports say."""
    return F.floor(100.0 * part / F.greatest(whole, F.lit(1)) + 0.5)


def learner_report(cards: DataFrame, reviews: DataFrame, learner: str = "learner_id") -> DataFrame:
    """One row per learner: total, known (learned and last not forgotten), weak (ever lapsed), reviews, correct, accuracy in percent."""
    by_card = cards.groupBy(learner).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if((F.col("reps") > 0) & (F.col("last_q") > 0)).alias("known"),
        F.count_if(F.col("lapses") > 0).alias("weak"),
    )
    by_review = reviews.groupBy(learner).agg(F.count(F.lit(1)).alias("reviews"), F.count_if(F.col("q") > 0).alias("correct"))
    return by_card.join(by_review, learner, "left").withColumn("accuracy", _percent(F.col("correct"), F.col("reviews")))


def _first(rows: DataFrame, order: list[Column | str], n: int, by: str | None) -> DataFrame:
    """The first ``n`` rows of each ``by``, or of all."""
    if by is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def weak_list(cards: DataFrame, keys: list[str], n: int = 30, by: str | None = "learner_id") -> DataFrame:
    """The ``n`` cards with the most lapses of each learner (``by``), or of all where ``by`` is None."""
    return _first(cards.where("lapses > 0"), [F.desc("lapses"), *keys], n, by)


def mastery(cards: DataFrame, by: str) -> DataFrame:
    """(by, n_cards, n_mastered, percent): the share whose last review was remembered."""
    out = cards.groupBy(by).agg(F.count(F.lit(1)).alias("n_cards"), F.count_if((F.col("reps") > 0) & (F.col("last_q") > 0)).alias("n_mastered"))
    return out.withColumn("percent", _percent(F.col("n_mastered"), F.col("n_cards")))


def with_level(cards: DataFrame, lexicon: DataFrame, default: str = "B1") -> DataFrame:
    """``cards`` whose missing level is that of the lexicon, or the default."""
    named = lexicon.select("lemma", F.col("level").alias("_level"))
    own = F.when(F.col("level") != "", F.col("level")) if "level" in cards.columns else F.lit(None)
    return cards.join(named, "lemma", "left").withColumn("level", F.coalesce(own, F.col("_level"), F.lit(default))).drop("_level")


def level_number(level: Column, levels: dict[str, int]) -> Column:
    """The place of a level; unknown ones count as 3."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in levels.items() for x in kv)), level), F.lit(3))


def skills(cards: DataFrame, reviews: DataFrame, structures: DataFrame, levels: dict[str, int], learner: str = "learner_id") -> DataFrame:
    """Six values of 0 to 100 per learner: basic and upper vocabulary, conjugation, grammar, accuracy, correctness.

    cards: learner, level, pos, reps, last_q; structures: learner, n_rules and n_errors of the learner's own
    text. Learners with cards have a row; what they have no cards, reviews or text for is 0.
    """
    known = (F.col("reps") > 0) & (F.coalesce("last_q", F.lit(0)) > 0)
    basic, verb = level_number(F.col("level"), levels) <= 2, F.coalesce(F.col("pos") == "v", F.lit(False))
    part = lambda good, among: F.when(F.count_if(among) > 0, _percent(F.count_if(among & good), F.count_if(among))).otherwise(0)
    by_card = cards.groupBy(learner).agg(part(known, basic).alias("basic"), part(known, ~basic).alias("upper"), part(F.col("reps") > 1, verb).alias("conjugation"))
    by_review = reviews.groupBy(learner).agg(_percent(F.count_if(F.col("q") > 0), F.count(F.lit(1))).alias("accuracy"))
    grammar = F.floor(100 * F.least(F.lit(1.0), F.col("n_rules") / 8.0) + 0.5)
    own = structures.select(learner, grammar.alias("grammar"), F.greatest(F.lit(0), 100 - 6 * F.col("n_errors")).alias("correctness"))
    joined = by_card.join(by_review, learner, "left").join(own, learner, "left")
    return joined.select(learner, *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("basic", "upper", "conjugation", "grammar", "accuracy", "correctness")))


def gap_list(cards: DataFrame, lexicon: DataFrame, levels: dict[str, int], target: int, most: int = 40, learner: str = "learner_id") -> DataFrame:
    """(learner, rank, lemma): the first words of the lexicon up to a level that a learner has no card of, in the order of the lexicon.

    A learner's known words are at most the lexicon's, which meet the lexicon as one list.
    """
    core = lexicon.where(level_number(F.col("level"), levels) <= target).select("lemma", "ord")
    words = F.transform(F.array_sort(F.collect_list(F.struct("ord", "lemma"))), lambda x: x["lemma"])
    listed = core.agg(words.alias("words")).select(F.lit(1).alias("one"), "words")
    had = cards.select(learner, "lemma").join(core.select("lemma", F.lit(True).alias("core")), "lemma", "left")
    had = had.groupBy(learner).agg(F.collect_set(F.when(F.col("core"), F.col("lemma"))).alias("had")).withColumn("one", F.lit(1))
    lacking = F.slice(F.array_except("words", "had"), 1, most)
    return had.join(listed, "one").select(learner, F.posexplode(lacking).alias("k", "lemma")).select(learner, (F.col("k") + 1).alias("rank"), "lemma")


def due_list(cards: DataFrame, as_of: str, most: int = 60, learner: str = "learner_id") -> DataFrame:
    """(learner, rank, lemma, due): the first cards that are due, the longest due first."""
    due = cards.where(F.col("due") <= F.lit(as_of).cast("date"))
    order = W.partitionBy(learner).orderBy("due", "lemma")
    return due.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(learner, "rank", "lemma", "due")


def deck_additions(vocab: DataFrame, deck: DataFrame, top: int = 50) -> DataFrame:
    """The ``top`` words of each document that are not in the deck (lemma)."""
    order = W.partitionBy("doc_id").orderBy(F.desc("n"), "first_pos")
    return vocab.join(deck.select("lemma"), "lemma", "left_anti").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def map_stats(vocab: DataFrame) -> DataFrame:
    """(n_entries, n_occurrences, n_in_lexicon, n_without_gloss) of a vocabulary."""
    return vocab.agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_occurrences"),
        F.count_if("in_lexicon").alias("n_in_lexicon"),
        F.count_if(F.col("gloss") == "").alias("n_without_gloss"),
    )


def filter_vocabulary(vocab: DataFrame, *, level: str | None = None, pos: str | None = None, keyword: str = "", most: int = 300, by: str | None = "doc_id") -> DataFrame:
    """The first ``most`` rows of each document's vocabulary table (``by``), or of all where ``by`` is None, by level, part of speech and a keyword in lemma or gloss."""
    word = F.lit(keyword.lower())
    kept = vocab.where(F.contains("lemma", word) | F.contains(F.lower("gloss"), word))
    kept = kept.where(F.col("level") == level) if level else kept
    kept = kept.where(F.col("pos") == pos) if pos else kept
    return _first(kept, [F.desc("n"), "doc_id", "first_pos"], most, by)


def skill_scores(docs: DataFrame, hits: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc_id, n_rules, grammar, n_errors, correctness): the range of structures (0 to 1, full at eight) and 100 less six for each error."""
    rules = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rules"))
    errors = issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_errors"))
    n_rules, n_errors = F.coalesce("n_rules", F.lit(0)), F.coalesce("n_errors", F.lit(0))
    return docs.select("doc_id").join(rules, "doc_id", "left").join(errors, "doc_id", "left").select(
        "doc_id",
        n_rules.alias("n_rules"),
        F.least(F.lit(1.0), n_rules / 8.0).alias("grammar"),
        n_errors.alias("n_errors"),
        F.greatest(F.lit(0), 100 - 6 * n_errors).alias("correctness"),
    )


def conjugation_mastery(cards: DataFrame, by: str) -> DataFrame:
    """(by, percent): the share of verb cards (pos) that were reviewed more than once."""
    verbs = cards.where("pos = 'v'").groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reps") > 1).alias("k"))
    return verbs.select(by, _percent(F.col("k"), F.col("n")).alias("percent"))


def shuffled(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    """``rows`` in an order that the seed and the keys decide."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def until_failures(pages: DataFrame, group: str, order: str, failed: str, most: int = 3) -> DataFrame:
    """The rows of each group up to the one where ``most`` have failed; later ones are left out."""
    before = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return pages.withColumn("_failed", F.coalesce(F.sum(F.col(failed).cast("int")).over(before), F.lit(0))).where(F.col("_failed") < most).drop("_failed")


def format_size(n: Column | str) -> Column:
    """Bytes as B, KB or MB."""
    n = F.col(n) if isinstance(n, str) else n
    shown = lambda x, unit: F.concat(F.round(x, 1).cast("decimal(20,1)").cast("string"), F.lit(unit))
    return F.when(n < 1024, F.concat(n, F.lit(" B"))).when(n < 2**20, shown(n / 1024, " KB")).otherwise(shown(n / 2**20, " MB"))
