"""SQL of the learner reports: skills, levels, gaps, due lists, errors with hints, merged states."""

from __future__ import annotations

from glotta.plans.oracles import _ACCENT, _ERRORS, _GRAMMAR, _tokens, _with, CARDS, CONJUGATION, ELIDED, FORMS, LEXICON, STOPS, VERBS
from glotta.plans.queries import AS_OF, LANGUAGE

# A word's reviews: the event's number picks the word
_WORD_CARDS = "WITH RECURSIVE " + LEXICON + "," + CARDS.format(
    source=f"(SELECT e.event_id, e.user_id, e.ts, l.lemma AS event_type FROM events e JOIN lexicon l ON l.ord = e.event_id % {len(LANGUAGE.lexicon)})"
).split("WITH RECURSIVE", 1)[1] + ", leveled AS (SELECT c.*, l.level, l.pos, l.ord FROM cards c JOIN lexicon l USING (lemma))"

_ISSUES = _with(LEXICON, VERBS, STOPS, CONJUGATION, FORMS, _tokens(), _ACCENT, _ERRORS)


def _half(name: str, parity: int) -> str:
    return f"""{name} AS (
        SELECT user_id, count(*) AS reviews, count(*) FILTER (WHERE event_id % 4 > 0) AS correct FROM events WHERE event_id % 2 = {parity} GROUP BY user_id
    ), {name}_days AS (SELECT user_id, ts::DATE::VARCHAR AS day, count(*) AS n FROM events WHERE event_id % 2 = {parity} GROUP BY user_id, ts::DATE)"""


def _share(good: str, among: str) -> str:
    n = f"count(*) FILTER (WHERE {among})"
    return f"CASE WHEN {n} > 0 THEN floor(100.0::DOUBLE * count(*) FILTER (WHERE ({among}) AND ({good})) / {n} + 0.5) ELSE 0 END::BIGINT"


def oracle_sql() -> dict[str, str]:
    known, basic = "reps > 0 AND last_q > 0", "level IN ('A1', 'A2')"
    return {
        "skills_radar": _WORD_CARDS + ", " + _ISSUES.removeprefix("WITH ").replace(LEXICON.strip() + ",", "", 1) + ", " + _GRAMMAR + f""",
            texts AS (SELECT doc_id FROM documents WHERE text <> ''), r AS (SELECT doc_id, count(*) AS n FROM rules WHERE len(hits) > 0 GROUP BY doc_id), i AS (SELECT doc_id, count(*) AS n FROM issues GROUP BY doc_id),
            own AS (
                SELECT t.doc_id, floor(100 * least(1.0::DOUBLE, coalesce(r.n, 0) / 8.0::DOUBLE) + 0.5)::BIGINT AS grammar, greatest(0, 100 - 6 * coalesce(i.n, 0)) AS correctness
                FROM texts t LEFT JOIN r USING (doc_id) LEFT JOIN i USING (doc_id)
            ),
            c AS (SELECT learner_id, {_share(known, basic)} AS basic, {_share(known, "NOT " + basic)} AS upper, {_share("reps > 1", "pos = 'v'")} AS conjugation FROM leveled GROUP BY learner_id),
            a AS (SELECT user_id, floor(100.0::DOUBLE * count(*) FILTER (WHERE event_id % 4 > 0) / count(*) + 0.5)::BIGINT AS accuracy FROM events GROUP BY user_id)
            SELECT learner_id, basic, upper, conjugation, coalesce(grammar, 0)::BIGINT AS grammar, accuracy, coalesce(correctness, 0)::BIGINT AS correctness
            FROM c JOIN a ON user_id = learner_id LEFT JOIN own ON doc_id = learner_id
        """,
        "level_mastery": _WORD_CARDS + f""", m AS (SELECT level, count(*) AS n_cards, count(*) FILTER (WHERE {known}) AS n_mastered FROM leveled GROUP BY level)
            SELECT *, floor(100.0::DOUBLE * n_mastered / n_cards + 0.5)::BIGINT AS percent FROM m
        """,
        "gap_list": _WORD_CARDS + """, lacking AS (
                SELECT u.learner_id, l.lemma, row_number() OVER (PARTITION BY u.learner_id ORDER BY l.ord) AS rank
                FROM (SELECT DISTINCT learner_id FROM cards) u JOIN lexicon l ON l.level IN ('A1', 'A2', 'B1')
                LEFT JOIN cards c ON c.learner_id = u.learner_id AND c.lemma = l.lemma WHERE c.lemma IS NULL
            ) SELECT learner_id, rank, lemma FROM lacking WHERE rank <= 40
        """,
        "due_list": _WORD_CARDS + f""", d AS (
                SELECT learner_id, lemma, due::VARCHAR AS due, row_number() OVER (PARTITION BY learner_id ORDER BY due, lemma) AS rank FROM cards WHERE due <= DATE '{AS_OF}'
            ) SELECT learner_id, rank, lemma, due FROM d WHERE rank <= 60
        """,
        "error_report": _ISSUES + f""", hinted AS (
                SELECT i.doc_id, i.error, i.ord, i.snippet || CASE error
                        WHEN 'english' THEN '  — looks like an English word'
                        WHEN 'neg' THEN '  — in writing: ne ... pas'
                        WHEN 'genre' THEN '  — should be ' || CASE x.gender WHEN 'm' THEN 'le ' ELSE 'la ' END || lower(string_split(i.snippet, ' ')[-1]) ELSE '' END AS sample,
                    row_number() OVER (PARTITION BY i.doc_id, error ORDER BY i.ord) AS k
                FROM issues i LEFT JOIN lexicon x ON i.error = 'genre' AND x.lemma = regexp_replace(replace(lower(string_split(i.snippet, ' ')[-1]), '’', ''''), '{ELIDED}', '')
            ), g AS (
                SELECT doc_id, error, count(*) AS n, min(ord) AS first_ord, string_agg(sample, '|' ORDER BY ord) FILTER (WHERE k <= 4) AS samples FROM hinted GROUP BY doc_id, error
            )
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_ord) AS rank, error,
                   CASE error WHEN 'accent' THEN 'A1' WHEN 'genre' THEN 'A1' WHEN 'articles' THEN 'A2' WHEN 'de' THEN 'A1' WHEN 'que_qui' THEN 'B1' WHEN 'aux' THEN 'A1' WHEN 'neg' THEN 'A2' ELSE '?' END AS level, n, samples
            FROM g
        """,
        "backup_state": "WITH " + _half("mine", 0) + ", " + _half("theirs", 1) + """, days AS (
                SELECT coalesce(m.user_id, t.user_id) AS user_id, coalesce(m.day, t.day) AS day, coalesce(m.n, t.n) AS n
                FROM mine_days m FULL JOIN theirs_days t ON m.user_id = t.user_id AND m.day = t.day
            ), done AS (SELECT user_id, string_agg(day || ':' || n, ';' ORDER BY day) AS done FROM days GROUP BY user_id)
            SELECT d.user_id AS learner_id, greatest(coalesce(m.reviews, 0), coalesce(t.reviews, 0)) AS reviews, greatest(coalesce(m.correct, 0), coalesce(t.correct, 0)) AS correct, done
            FROM done d LEFT JOIN mine m USING (user_id) LEFT JOIN theirs t USING (user_id)
        """,
    }
