"""Merged states, backups with words, skills, gaps, hints, passages."""

import re

import pytest
from pyspark.sql import functions as F

from glotta.lexicon import LEVELS, Language
from glotta.operators import backup, conjugation, errors, quiz, reports

STATE = "learner_id bigint, reviews bigint, correct bigint, done map<string,int>"


def test_merged_states(spark):
    mine = spark.createDataFrame([(1, 5, 2, {"a": 1, "b": None}), (2, 1, 1, None), (4, None, 3, {})], STATE)
    theirs = spark.createDataFrame([(1, 3, 4, {"b": 7, "c": 8}), (3, 9, 9, {"z": 1}), (4, None, None, None)], STATE)
    merged = backup.merge_states(mine, theirs, "learner_id", ["reviews", "correct"], ["done"])
    assert {r["learner_id"]: tuple(r)[1:] for r in merged.collect()} == {1: (5, 4, {"a": 1, "b": None, "c": 8}), 2: (1, 1, {}), 3: (9, 9, {"z": 1}), 4: (0, 3, {})}
    again = backup.merge_states(merged, theirs, "learner_id", ["reviews", "correct"], ["done"])
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.collect()))


def test_words_without_a_due_day_are_mine(spark):
    mine = spark.createDataFrame([("a", "m")], "lemma string, gloss string")
    theirs = spark.createDataFrame([("a", "t"), ("b", "t")], "lemma string, gloss string")
    assert sorted(tuple(r) for r in backup.merge_cards(mine, theirs, ["lemma"]).collect()) == [("a", "m"), ("b", "t")]


def test_a_whole_backup_has_words(spark):
    states = ['{"cards":[]}', '{"cards":[],"vocab":[]}', '{"cards":[],"vocab":{}}', '{"cards":[],"vocab":3}', '{"vocab":[]}']
    rows = spark.createDataFrame([(k, f'{{"format":"glotta-backup","version":1,"state":{s}}}') for k, s in enumerate(states)], "learner_id int, json string")
    assert sorted(r["learner_id"] for r in backup.whole_backups(rows, "struct<lemma:string>").collect()) == [1, 2]


def test_skills(spark):
    lexicon = Language().lexicon_frame(spark)
    cards = [(1, "maison", "n", 2, 3), (1, "gare", "n", 1, 0), (1, "société", "n", 1, 2), (1, "parler", "v", 2, 1), (1, "finir", "v", 1, 1), (2, "inconnu", None, 0, None)]
    cards = reports.with_level(spark.createDataFrame(cards, "learner_id int, lemma string, pos string, reps int, last_q int"), lexicon)
    assert {r["lemma"]: r["level"] for r in cards.collect()}["inconnu"] == "B1"
    reviews = spark.createDataFrame([(1, 3), (1, 0), (1, 1)], "learner_id int, q int")
    own = spark.createDataFrame([(1, 3, 4), (9, 8, 0)], "learner_id int, n_rules int, n_errors int")
    found = {r["learner_id"]: tuple(r)[1:] for r in reports.skills(cards, reviews, own, LEVELS).collect()}
    assert found == {1: (75, 100, 50, 38, 67, 76), 2: (0, 0, 0, 0, 0, 0)}


def test_gaps_and_due_lists(spark):
    lexicon = Language().lexicon_frame(spark)
    first = [r["lemma"] for r in lexicon.where("level = 'A1'").orderBy("ord").limit(5).collect()]
    cards = spark.createDataFrame([(1, first[0]), (1, "autre"), (2, "autre")], "learner_id int, lemma string")
    gaps = sorted((r["learner_id"], r["rank"], r["lemma"]) for r in reports.gap_list(cards, lexicon, LEVELS, 1, most=3).collect())
    assert gaps == [(1, k + 1, w) for k, w in enumerate(first[1:4])] + [(2, k + 1, w) for k, w in enumerate(first[:3])]
    days = spark.createDataFrame([(1, "b", "2024-01-02"), (1, "a", "2024-01-02"), (1, "c", "2024-01-01"), (1, "d", "2025-01-01")], "learner_id int, lemma string, due string").withColumn("due", F.col("due").cast("date"))
    assert [r["lemma"] for r in reports.due_list(days, "2024-06-01", most=2).orderBy("rank").collect()] == ["c", "a"]


def test_errors_with_hints_in_order(spark):
    language = Language()
    lexicon, verbs = language.lexicon_frame(spark), language.verbs_frame(spark)
    text = "la village the of de les le maison un Maison and"
    issues = errors.error_issues(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), lexicon, conjugation.verb_forms(lexicon, verbs), language.words_frame(spark, language.stop_words))
    found = [(r["rank"], r["error"], r["n"], r["samples"]) for r in errors.error_report(issues, lexicon).orderBy("rank").collect()]
    assert found == [
        (1, "genre", 3, ["la village  — should be le village", "le maison  — should be la maison", "un Maison  — should be la maison"]),
        (2, "english", 3, ["the  — looks like an English word", "of  — looks like an English word", "and  — looks like an English word"]),
        (3, "de", 1, ["de les"]),
    ]


@pytest.mark.parametrize("level", ["A1", "A2", "B1", "B2", "C9"])
def test_passages_fill_every_slot(spark, level):
    vocab = [(1, "maison", "n", "f"), (1, "gare", "n", "f"), (1, "petit", "adj", ""), (1, "parler", "v", ""), (1, "être", "v", ""), (2, "jamais", "adv", ""), (3, "temps", "n", "m")]
    vocab = spark.createDataFrame(vocab, "doc_id bigint, lemma string, pos string, gender string")
    found = {r["doc_id"]: r for r in quiz.passages(vocab, level, n=4, verbs=Language().verbs_frame(spark)).collect()}
    templates = quiz.TEMPLATES.get(level, quiz.TEMPLATES["A2"])
    for doc, r in found.items():
        assert "{" not in r["passage"] and "—" not in r["passage"] and "  " not in r["passage"]
        # each of the four templates once, whatever stands in the slots
        assert all(re.search(re.sub(r"\\\{\w+\\\}", ".+?", re.escape(t)), r["passage"]) for t in templates)
    assert set(found) == {1, 2, 3} and set(found[1]["recycled"]) >= {"maison", "gare"}
    assert "temps" not in found[3]["recycled"]  # no plural-looking noun in a singular slot


def test_irregular_forms_in_passages(spark):
    vocab = spark.createDataFrame([(1, "être", "v", "")], "doc_id bigint, lemma string, pos string, gender string")
    passage = quiz.passages(vocab, "A2", n=4, verbs=Language().verbs_frame(spark)).first()["passage"]
    assert "je étais souvent" in passage and "Si tu sois," in passage and "que vous soyez" in passage and "j'ai été " in passage
