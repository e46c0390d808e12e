"""The registered queries of the language operators, over the corpus tables.

Texts are ``documents``, learners' reviews are ``events`` (card: user and event type; quality:
event_id modulo 4), answers are ``conversations``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotta.functions import text as X
from glotta.lexicon import LEVELS, Language, small
from glotta.operators import backup, conjugation, errors, grammar, quiz, reports, scheduling, targets, vocabulary
from glotta.sources import datasource, table_functions
from glotta.sources.sinks import anki_rows as anki
from glotta.sources.tables import read_table, scratch_folder

AS_OF, EXAM = "2024-02-01", "2024-06-01"
LANGUAGE = Language()
#: A French article, "de" or "que" before a vowel, which written French elides.
UNELIDED = r"(^|[ \n])(?:([LlDd]|[Qq]u)e|([Ll])a) ([aeiouyAEIOUYàâéèêîôûœÀÂÉÈÊÎÔÛŒ])"


_KEYS = {"documents": "doc_id", "pages": "page_id"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name, _KEYS.get(name))


def _docs(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return (docs.where(F.col("lang") == lang) if lang else docs).select("doc_id", "text")


def _dims(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lexicon, verb forms and stop words, worked out once for each session, which keeps them."""
    if not hasattr(spark, "_glotta_dims"):
        lexicon = small(LANGUAGE.lexicon_frame(spark))
        forms = small(conjugation.verb_forms(lexicon, LANGUAGE.verbs_frame(spark)))
        spark._glotta_dims = lexicon, forms, small(LANGUAGE.words_frame(spark, LANGUAGE.stop_words))
    return spark._glotta_dims


def _vocab(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    return vocabulary.vocabulary(_docs(spark, sf_dir, lang), *_dims(spark))


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("learner_id"), F.col("event_type").alias("lemma"), "ts", F.col("event_id").alias("review_id"), (F.col("event_id") % 4).cast("int").alias("q")
    )


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.card_states(_reviews(spark, sf_dir), ["learner_id", "lemma"])


def token_counts(spark, sf_dir):
    return vocabulary.token_counts(_docs(spark, sf_dir))


def elisions(spark, sf_dir):
    return vocabulary.tokens(_docs(spark, sf_dir)).where("prefix != ''").groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


def sentence_stats(spark, sf_dir):
    # number and size in one fold, as two columns would cut the text twice
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("size"))
    fold = lambda x, s: F.struct((x["n"] + 1).alias("n"), (x["size"] + F.length(s)).alias("size"))
    found = _docs(spark, sf_dir).select("doc_id", F.aggregate(X.sentences(F.col("text")), start, fold).alias("x"))
    return found.select("doc_id", F.col("x.n").alias("n_sentences"), F.col("x.size").alias("n_chars"))


def word_stats(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.word_count(F.col("text")).alias("n_words"))


def vocab_topk(spark, sf_dir):
    top = vocabulary.ranked(_vocab(spark, sf_dir, "fr")).where("rank <= 20")
    return top.select("doc_id", F.col("rank").cast("bigint").alias("rank"), "lemma", "n", F.array_join("forms", ";").alias("forms"), "pos", "level", "in_lexicon")


def vocab_levels(spark, sf_dir):
    return _vocab(spark, sf_dir).groupBy("level", "pos").agg(F.count(F.lit(1)).alias("n_entries"), F.sum("n").alias("n_occurrences"))


def proper_nouns(spark, sf_dir):
    lexicon, forms, _ = _dims(spark)
    gated = vocabulary.surface_words(_docs(spark, sf_dir, "fr")).where(F.length("w").between(3, 26))
    return vocabulary.lemmatised(gated, lexicon, forms).where("not in_lexicon and caps = n").select("doc_id", "w", "n")


def vocab_example(spark, sf_dir):
    docs = _docs(spark, sf_dir, "fr")
    top = vocabulary.ranked(vocabulary.vocabulary(docs, *_dims(spark))).where("rank <= 10")
    return vocabulary.with_example(top, docs).select("doc_id", "lemma", "example")


def vocab_summary(spark, sf_dir):
    return reports.map_stats(_vocab(spark, sf_dir, "fr"))


def deck_additions(spark, sf_dir):
    lexicon, *_ = _dims(spark)
    return reports.deck_additions(_vocab(spark, sf_dir, "fr"), lexicon.where("level = 'A1'").select("lemma")).select("doc_id", "lemma", F.col("rank").cast("bigint").alias("rank"))


def lexicon_coverage(spark, sf_dir):
    lexicon, *_ = _dims(spark)
    return vocabulary.coverage(_vocab(spark, sf_dir, "fr"), lexicon, LEVELS, 2)


def grammar_hits(spark, sf_dir):
    return grammar.grammar_hits(_docs(spark, sf_dir)).select("doc_id", "rule", "level", "n")


def grammar_samples(spark, sf_dir):
    return grammar.grammar_hits(_docs(spark, sf_dir)).select("doc_id", "rule", F.array_join("samples", "|").alias("samples"))


def error_hits(spark, sf_dir):
    found = errors.error_groups(errors.error_issues(_docs(spark, sf_dir), *_dims(spark)))
    return found.select("doc_id", "error", "level", "n", F.array_join("samples", "|").alias("samples"))


def vocab_filter(spark, sf_dir):
    found = reports.filter_vocabulary(_vocab(spark, sf_dir, "fr"), level="B1", pos="n", keyword="Tion")
    return found.select("doc_id", "lemma", "n")


def skill_scores(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return reports.skill_scores(docs, grammar.grammar_hits(docs), errors.error_issues(docs, *_dims(spark)))


def file_sizes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", reports.format_size(F.octet_length(F.coalesce("text", F.lit("")))).alias("size"))


def french_clean(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.french_clean(F.col("text")).alias("text"))


def text_quality(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.text_quality(F.col("text")).alias("quality"))


def html_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


def accent_free(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.strip_accents(F.col("text")).alias("text"))


def conjugation_table(spark, sf_dir):
    table = conjugation.conjugations(LANGUAGE.lexicon_frame(spark), LANGUAGE.verbs_frame(spark))
    return table.select("inf", "tense", F.col("person").cast("bigint").alias("person"), "form")


def verb_form_index(spark, sf_dir):
    return conjugation.verb_forms(LANGUAGE.lexicon_frame(spark), LANGUAGE.verbs_frame(spark))


def srs_state(spark, sf_dir):
    return _cards(spark, sf_dir).select("learner_id", "lemma", "interval", "reps", F.round("ef", 6).alias("ef"), "lapses", F.col("due").cast("string").alias("due"), F.col("last_q").cast("bigint").alias("last_q"))


def due_today(spark, sf_dir):
    return scheduling.due_cards(_cards(spark, sf_dir), AS_OF).select("learner_id", "lemma", F.col("due").cast("string").alias("due"))


def due_forecast(spark, sf_dir):
    return scheduling.due_forecast(_cards(spark, sf_dir), AS_OF).select(F.col("day").cast("string").alias("day"), "n")


def study_plan(spark, sf_dir):
    return scheduling.study_plan(_cards(spark, sf_dir), AS_OF, EXAM)


def learner_report(spark, sf_dir):
    return reports.learner_report(_cards(spark, sf_dir), _reviews(spark, sf_dir))


def weak_list(spark, sf_dir):
    return reports.weak_list(_cards(spark, sf_dir), ["learner_id", "lemma"]).select("learner_id", "lemma", "lapses")


def mastery(spark, sf_dir):
    return reports.mastery(_cards(spark, sf_dir), "lemma")


def rate_limit_daily(spark, sf_dir):
    calls = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    found = scheduling.within_daily_limit(calls, "user_id", 3, tie_col="event_id")
    return found.select("event_id", "user_id", F.col("used").cast("bigint").alias("used"), "allowed")


def tumbling_daily(spark, sf_dir):
    return scheduling.daily_counts(_table(spark, sf_dir, "events"), "user_id").select("user_id", F.col("day").cast("string").alias("day"), "n")


def backup_merge(spark, sf_dir):
    reviews = _reviews(spark, sf_dir)
    halves = [scheduling.card_states(reviews.where(F.col("review_id") % 2 == k), ["learner_id", "lemma"]).select("learner_id", "lemma", "due", "reps", "lapses") for k in (0, 1)]
    return backup.merge_cards(halves[0], halves[1], ["learner_id", "lemma"]).withColumn("due", F.col("due").cast("string"))


def _answers(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return turns.select("conv_id", "turn", F.col("text").alias("expected")).join(after, ["conv_id", "turn"])


def grade_answers(spark, sf_dir):
    graded = X.grade_answer(F.col("answer"), F.col("expected"))
    return _answers(spark, sf_dir).select("conv_id", "turn", graded["ok"].alias("ok"), graded["msg"].alias("msg"))


def target_used(spark, sf_dir):
    first = F.regexp_extract("expected", "[A-Za-zÀ-ÿ]{4,}", 0)
    used = X.normal_answer(F.col("answer")).contains(X.normal_answer(first)) & (first != "")
    return _answers(spark, sf_dir).select("conv_id", "turn", used.alias("used"))


def page_ranges(spark, sf_dir):
    e = F.col("event_id")
    spec = F.concat((e % 17 + 1).cast("string"), F.lit("-"), (e % 5 + 1).cast("string"), F.lit(", "), (e % 31).cast("string"))
    pages = X.page_range(spec, F.lit(20))
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(pages.cast("array<string>"), ",").alias("pages"))


def anki_rows(spark, sf_dir):
    docs = _docs(spark, sf_dir, "fr")
    top = vocabulary.ranked(vocabulary.vocabulary(docs, *_dims(spark))).where("rank <= 10")
    return anki(vocabulary.with_example(top, docs)).select("doc_id", "front", "back", "sentence", "tag")


def backup_json(spark, sf_dir):
    return backup.backup_json(_cards(spark, sf_dir).select("learner_id", "lemma", "due", "reps"), "learner_id")


def quiz_distractors(spark, sf_dir):
    found = quiz.distractors(_vocab(spark, sf_dir, "fr").select("doc_id", "lemma", "gloss", "pos"), "doc_id", "lemma")
    return found.select("doc_id", "lemma", F.array_join("distractors", ";").alias("distractors"))


def quiz_questions(spark, sf_dir):
    docs = _docs(spark, sf_dir, "fr")
    lexicon, *_ = _dims(spark)
    top = vocabulary.ranked(vocabulary.vocabulary(docs, *_dims(spark))).where("rank <= 10")
    return quiz.questions(vocabulary.with_example(top, docs), conjugation.conjugations(lexicon, LANGUAGE.verbs_frame(spark)))


def elided_words(spark, sf_dir):
    """Tokens of the French documents, whose invented prose has no elisions, after the elisions of written French are made."""
    docs = _docs(spark, sf_dir, "fr").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), UNELIDED, "$1$2$3'$4"))
    return vocabulary.tokens(docs).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "raw", "w", "prefix")


def gen_passage(spark, sf_dir):
    return quiz.passages(_vocab(spark, sf_dir, "fr"), "B1", verbs=LANGUAGE.verbs_frame(spark)).select("doc_id", "passage", F.array_join("recycled", ";").alias("recycled"))


def _word_reviews(spark, sf_dir):
    """Reviews of lexicon words: an event reviews the word with its number modulo the lexicon's size."""
    lexicon, *_ = _dims(spark)
    events = _table(spark, sf_dir, "events").withColumn("ord", (F.col("event_id") % len(LANGUAGE.lexicon)).cast("int"))
    return events.join(lexicon.select("lemma", "ord"), "ord").select(F.col("user_id").alias("learner_id"), "lemma", "ts", F.col("event_id").alias("review_id"), (F.col("event_id") % 4).cast("int").alias("q"))


def _word_cards(spark, sf_dir):
    lexicon, *_ = _dims(spark)
    cards = scheduling.card_states(_word_reviews(spark, sf_dir), ["learner_id", "lemma"])
    return reports.with_level(cards, lexicon).join(lexicon.select("lemma", "pos"), "lemma", "left")


def skills_radar(spark, sf_dir):
    """A learner's own text is the document with the learner's number."""
    docs = _docs(spark, sf_dir).where("text != ''")
    structures = reports.skill_scores(docs, grammar.grammar_hits(docs), errors.error_issues(docs, *_dims(spark))).withColumnRenamed("doc_id", "learner_id")
    return reports.skills(_word_cards(spark, sf_dir), _word_reviews(spark, sf_dir), structures, LEVELS)


def level_mastery(spark, sf_dir):
    return reports.mastery(_word_cards(spark, sf_dir), "level")


def gap_list(spark, sf_dir):
    lexicon, *_ = _dims(spark)
    return reports.gap_list(_word_cards(spark, sf_dir), lexicon, LEVELS, 3).withColumn("rank", F.col("rank").cast("bigint"))


def due_list(spark, sf_dir):
    return reports.due_list(_word_cards(spark, sf_dir), AS_OF).select("learner_id", F.col("rank").cast("bigint").alias("rank"), "lemma", F.col("due").cast("string").alias("due"))


def error_report(spark, sf_dir):
    lexicon, *_ = _dims(spark)
    found = errors.error_report(errors.error_issues(_docs(spark, sf_dir), *_dims(spark)), lexicon)
    return found.select("doc_id", F.col("rank").cast("bigint").alias("rank"), "error", "level", "n", F.array_join("samples", "|").alias("samples"))


def backup_state(spark, sf_dir):
    """Two halves of each learner's events as two backups: counters and the events of each day."""

    def half(k):
        rows = _reviews(spark, sf_dir).where(F.col("review_id") % 2 == k)
        days = rows.groupBy("learner_id", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("q") > 0).alias("good"))
        done = F.map_from_entries(F.collect_list(F.struct("day", "n"))).alias("done")
        return days.groupBy("learner_id").agg(F.sum("n").alias("reviews"), F.sum("good").alias("correct"), done)

    merged = backup.merge_states(half(0), half(1), "learner_id", ["reviews", "correct"], ["done"])
    entries = F.transform(F.array_sort(F.map_entries("done")), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string")))
    return merged.select("learner_id", "reviews", "correct", F.array_join(entries, ";").alias("done"))


def book_texts(spark, sf_dir):
    """The pages as chapters of e-books, written and read by the data source; entries by the table function, in SQL."""
    datasource.register(spark)
    table_functions.register(spark)
    folder = scratch_folder(spark, "books")
    chapters = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("name"), F.col("html").alias("text"))
    chapters.write.format("glotta_files").mode("append").save(folder)
    entries = spark.sql(
        """SELECT try_cast(regexp_extract(entry, '/(-?[0-9]+)[.]xhtml$', 1) AS BIGINT) AS page_id, xml
        FROM package_entries(TABLE(SELECT path, content FROM {books} WHERE path LIKE '%.epub'))""",
        books=spark.read.format("glotta_files").option("least_tasks", 2 * spark.sparkContext.defaultParallelism).load(folder),
    )
    return entries.select("page_id", X.html_to_text(F.col("xml")).alias("text"))


def targets_in_documents(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("target_id"), F.col("text").alias("expected"))
    return targets.targets_used(_docs(spark, sf_dir), items)


ALL: list[Callable[[SparkSession, str], DataFrame]] = [
    token_counts, elisions, sentence_stats, word_stats, vocab_topk, vocab_levels, proper_nouns, vocab_example, vocab_summary,
    vocab_filter, skill_scores, file_sizes, deck_additions, lexicon_coverage, grammar_hits, grammar_samples, error_hits, french_clean, text_quality, html_text, accent_free,
    conjugation_table, verb_form_index, srs_state, due_today, due_forecast, study_plan, learner_report, weak_list, mastery,
    rate_limit_daily, tumbling_daily, backup_merge, grade_answers, target_used, page_ranges, anki_rows, backup_json,
    quiz_distractors, quiz_questions, gen_passage, elided_words,
    skills_radar, level_mastery, gap_list, due_list, error_report, backup_state, targets_in_documents, book_texts,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}
