"""Lists of each learner and of each document."""

from glotta.operators import reports


def test_lists_rank_within_learner_and_document(spark):
    cards = spark.createDataFrame([(who, f"w{k:02d}", k) for who in (1, 2, 3) for k in range(40)], "learner_id bigint, lemma string, lapses int")
    found = reports.weak_list(cards, ["learner_id", "lemma"]).collect()
    assert sorted((r["learner_id"], r["lapses"]) for r in found) == [(who, k) for who in (1, 2, 3) for k in range(10, 40)]
    rows = [(doc, f"w{k}", "", k, k) for doc in (1, 2) for k in range(310)]
    vocab = spark.createDataFrame(rows, "doc_id bigint, lemma string, gloss string, n int, first_pos int")
    found = reports.filter_vocabulary(vocab).collect()
    assert sorted((r["doc_id"], r["n"]) for r in found) == [(doc, k) for doc in (1, 2) for k in range(10, 310)]
