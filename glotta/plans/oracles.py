"""The same results as SQL for DuckDB."""

from __future__ import annotations

from glotta.lexicon import ENGLISH, ETRE_VERBS, GRAVE_VERBS, LEVELS, NUMERALS
from glotta.operators.errors import DETERMINERS, ERROR_LEVELS, ETRE_FORMS, ORAL_NEGATION
from glotta.operators.grammar import RULES
from glotta.operators.vocabulary import SUFFIXES
from glotta.plans.queries import AS_OF, EXAM, LANGUAGE

WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TOKEN = "[A-Za-zÀ-ÿŒœÆæ]+(?:[-'’][A-Za-zÀ-ÿŒœÆæ]+)*"
ELIDED = "^(?:l|d|j|m|t|s|n|c|qu|jusqu|puisqu|quoiqu|lorsqu|presqu)''"


def _q(x) -> str:
    if isinstance(x, list):
        return "[" + ", ".join(map(_q, x)) + "]"
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(name: str, columns: str, rows: list) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows) + ")"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(map(_q, words)) + ")"


_VERB_NAMES = [r[0] for r in LANGUAGE.verbs]
_LEXICON = [(r[0], "v" if r[0] in _VERB_NAMES else r[1], *r[2:]) for r in LANGUAGE.lexicon]
LEXICON = _values("lexicon", "lemma, pos, level, gender, gloss, ord", _LEXICON)
VERBS = _values("verbs", "inf, pres, subj, fut, pp, aux, ord", LANGUAGE.verbs)
STOPS = _values("stops", "word", [[w] for w in LANGUAGE.stop_words])

_AUX = f"CASE WHEN regexp_matches(inf, '^(se |s’)') OR inf IN {_in(ETRE_VERBS)} THEN 'être' ELSE 'avoir' END"


def _end(stem: str, endings: str) -> str:
    return "[" + ", ".join(f"{stem} || '{e}'" for e in endings.split()) + "]"


CONJUGATION = f"""
base AS (
    SELECT coalesce(v.inf, l.lemma) AS inf, pres, subj, fut, pp, aux, coalesce(v.ord, 1073741824) AS a, coalesce(l.ord, -1) AS b
    FROM verbs v FULL JOIN (SELECT * FROM lexicon WHERE pos = 'v') l ON v.inf = l.lemma
),
stems AS (
    SELECT *, coalesce(aux, {_AUX}) AS used, left(inf, length(inf) - 2) AS stem FROM base
),
more AS (
    SELECT *,
        CASE WHEN inf LIKE '%ger' THEN stem || 'e' WHEN inf LIKE '%cer' THEN left(stem, length(stem) - 1) || 'ç'
             WHEN inf LIKE '%ir' THEN stem || 'iss' ELSE stem END AS nous,
        CASE WHEN right(stem, 4) LIKE '%é%' THEN regexp_replace(stem, 'é([^é]*)$', 'è\\1')
             WHEN inf IN {_in(GRAVE_VERBS)} THEN regexp_replace(stem, 'e([^e]*)$', 'è\\1')
             WHEN regexp_matches(inf, '(el|et)er$') THEN stem || right(stem, 1) ELSE stem END AS mute,
        CASE WHEN inf LIKE '%er' THEN stem || 'é' WHEN inf LIKE '%uire' THEN left(inf, length(inf) - 3) || 'uit'
             WHEN inf LIKE '%ir' THEN stem || 'i' WHEN inf LIKE '%re' THEN stem || 'u' ELSE '?' END AS part
    FROM stems
),
past AS (
    SELECT *, coalesce(fut, CASE WHEN inf LIKE '%re' THEN left(inf, length(inf) - 1) ELSE inf END) AS future,
        CASE WHEN inf = 'être' THEN 'ét' WHEN pres IS NOT NULL THEN regexp_replace(pres[4], 'ons$', '')
             WHEN inf LIKE '%ger' THEN left(nous, length(nous) - 1) ELSE nous END AS imperfect,
        CASE WHEN nous LIKE '%ge' THEN left(nous, length(nous) - 1) ELSE nous END AS soft
    FROM more
),
tables AS (
    SELECT inf, a, b, 'pres' AS tense, 0 AS t, CASE WHEN pres IS NOT NULL THEN pres
        WHEN inf LIKE '%er' THEN [mute || 'e', mute || 'es', mute || 'e', nous || 'ons', stem || 'ez', mute || 'ent']
        WHEN inf LIKE '%ir' THEN {_end("stem", "is is it issons issez issent")}
        WHEN inf LIKE '%re' THEN [stem || 's', stem || 's', CASE WHEN stem LIKE '%d' THEN stem ELSE stem || 't' END, stem || 'ons', stem || 'ez', stem || 'ent']
        ELSE {_q(["—"] * 6)} END AS forms FROM past
    UNION ALL SELECT inf, a, b, 'impar', 1, {_end("imperfect", "ais ais ait ions iez aient")} FROM past
    UNION ALL SELECT p.inf, a, b, 'pc', 2, list_transform(x.pres, lambda f: f || ' ' || coalesce(p.pp, p.part)) FROM past p JOIN verbs x ON x.inf = p.used
    UNION ALL SELECT inf, a, b, 'futur', 3, {_end("future", "ai as a ons ez ont")} FROM past
    UNION ALL SELECT inf, a, b, 'cond', 4, {_end("future", "ais ais ait ions iez aient")} FROM past
    UNION ALL SELECT inf, a, b, 'subj', 5, coalesce(subj, [nous || 'e', nous || 'es', nous || 'e', soft || 'ions', soft || 'iez', nous || 'ent']) FROM past
),
conj AS (SELECT inf, a, b, tense, t, unnest(forms) AS form, generate_subscripts(forms, 1) - 1 AS person FROM tables)
"""
FORMS = f"""
pieces AS (SELECT inf, a, b, t, tense, person, lower(string_split(form, ' ')[-1]) AS form FROM conj),
agreed AS (
    SELECT inf, a, b, t, person, form FROM pieces
    UNION ALL
    SELECT inf, a, b, t, 6 + e.k, form || e.x FROM pieces, (VALUES (0, 'e'), (1, 's'), (2, 'es')) e(k, x)
    WHERE tense = 'pc' AND person = 0 AND ({_AUX}) = 'être'
),
forms AS (
    SELECT form, inf FROM (
        SELECT *, row_number() OVER (PARTITION BY form ORDER BY a, b, t, person) AS k FROM agreed WHERE length(form) > 2 AND form <> inf
    ) WHERE k = 1
)
"""


def _tokens(where: str = "TRUE") -> str:
    return f"""
raws AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_q(TOKEN)}) AS r FROM documents WHERE {where}),
cut AS (SELECT doc_id, unnest(r) AS raw, generate_subscripts(r, 1) - 1 AS pos FROM raws),
toks AS (
    SELECT doc_id, pos, raw, regexp_replace(replace(lower(raw), '’', ''''), '{ELIDED}', '') AS w,
           regexp_extract(replace(lower(raw), '’', ''''), '{ELIDED}') AS prefix FROM cut
)
"""


_ELIDED_DOCS = r"""
elided AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '(^|[ \n])(?:([LlDd]|[Qq]u)e|([Ll])a) ([aeiouyAEIOUYàâéèêîôûœÀÂÉÈÊÎÔÛŒ])', '\1\2\3''\4', 'g') AS text
    FROM documents WHERE lang = 'fr'
)
"""

SURFACE = """
surface AS (
    SELECT doc_id, w, count(*) AS n, min(pos) AS first_pos, list_distinct(list(lower(raw))) AS forms,
           count(*) FILTER (WHERE regexp_matches(regexp_replace(raw, '^[^A-Za-zÀ-ÿ]+', ''), '^[A-ZÀ-Þ]')) AS caps
    FROM toks GROUP BY doc_id, w
)
"""
_WAYS = "SELECT lemma, lemma AS w, 0 AS way FROM lexicon" + "".join(
    f" UNION ALL SELECT lemma, lemma || {_q(s)}, {1 + 2 * k} FROM lexicon WHERE length(lemma) > 2"
    f" UNION ALL SELECT lemma, left(lemma, length(lemma) - 1) || {_q(s)}, {2 + 2 * k} FROM lexicon WHERE lemma LIKE '%e' AND length(lemma) > 3"
    for k, s in enumerate(SUFFIXES)
)
LEMMAS = f"""
ways AS (SELECT w, arg_min(lemma, way) AS lemma, min(way) AS way FROM ({_WAYS}) GROUP BY w),
looked AS (
    SELECT s.*, CASE WHEN y.way = 0 THEN y.lemma ELSE coalesce(b.lemma, y.lemma) END AS own, f.inf
    FROM surface s LEFT JOIN ways y ON y.w = s.w
    LEFT JOIN lexicon b ON b.lemma = replace(replace(s.w, '''', ''), '’', '')
    LEFT JOIN forms f ON f.form = s.w
    WHERE length(s.w) BETWEEN 3 AND 26
),
lemmas AS (
    SELECT k.*, coalesce(own, inf, w) AS lemma, inf IS NOT NULL AS is_form, x.lemma IS NOT NULL AS in_lexicon, x.level, x.gender, x.gloss,
           CASE WHEN own IS NULL AND inf IS NOT NULL THEN 'v' ELSE x.pos END AS pos
    FROM looked k LEFT JOIN lexicon x ON x.lemma = coalesce(own, inf, w)
)
"""
VOCAB = f"""
kept AS (
    SELECT * FROM lemmas
    WHERE (in_lexicon OR caps < n) AND lemma NOT IN (SELECT word FROM stops) AND w NOT IN (SELECT word FROM stops)
      AND len(list_filter(string_split(w, '-'), lambda x: NOT (list_contains({_q(NUMERALS)}, x) OR regexp_matches(x, '^[0-9]+$')))) > 0
),
grouped AS (
    SELECT doc_id, lemma, sum(n)::BIGINT AS n, list_sort(list_distinct(flatten(list(forms)))) AS forms, min(first_pos) AS first_pos,
           arg_min(struct_pack(pos := pos, level := level, gender := gender, gloss := gloss, in_lexicon := in_lexicon, is_form := is_form), first_pos) AS x
    FROM kept GROUP BY doc_id, lemma
),
scored AS (
    SELECT *, least(n, 12) * 3 + CASE WHEN length(lemma) <= 5 THEN 8 WHEN length(lemma) <= 8 THEN 4 ELSE 0 END
        + CASE WHEN lemma LIKE '%ment' THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lemma, '(tion|sion|té)$') THEN 2 ELSE 0 END AS score
    FROM grouped
),
vocab AS (
    SELECT doc_id, lemma, n, forms, first_pos, x.in_lexicon AS in_lexicon, coalesce(x.gender, '') AS gender, coalesce(x.gloss, '') AS gloss,
        coalesce(x.pos, CASE WHEN x.is_form THEN 'v' WHEN lemma LIKE '%ment' AND length(lemma) > 5 THEN 'adv'
            WHEN regexp_matches(lemma, '(eux|euse|ique|able|ible|ain|el|al)$') THEN 'adj' ELSE 'n' END) AS pos,
        coalesce(x.level, CASE WHEN score >= 30 THEN 'A1' WHEN score >= 20 THEN 'A2' WHEN score >= 12 THEN 'B1' ELSE 'B2' END) AS level,
        row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank
    FROM scored
)
"""
_FR = "lang = 'fr'"
SENTENCES = f"""
sents AS (
    SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_no FROM (
        SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g'), '([.!?;:…]) +', '\\1' || chr(1), 'g'), chr(1)),
            lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: length(x) > 12 AND length(x) < 400) AS s
        FROM documents
    )
)
"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


def _vocab(where: str = "TRUE") -> str:
    return _with(LEXICON, VERBS, STOPS, CONJUGATION, FORMS, _tokens(where), SURFACE, LEMMAS, VOCAB)


_EXAMPLE = """
examples AS (
    SELECT v.doc_id, v.lemma, arg_min(s.sentence, s.sent_no) AS example
    FROM vocab v JOIN sents s ON s.doc_id = v.doc_id AND regexp_matches(s.sentence, '(?i)\\b' || regexp_escape(v.lemma))
    WHERE v.rank <= 10 GROUP BY v.doc_id, v.lemma
)
"""

# Reviews folded one after another
CARDS = """
WITH RECURSIVE reviews AS (
    SELECT user_id AS learner_id, event_type AS lemma, ts, event_id, (event_id % 4)::INT AS q,
           row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k,
           count(*) OVER (PARTITION BY user_id, event_type) AS m
    FROM {source}
),
fold AS (
    SELECT learner_id, lemma, 0::BIGINT AS k, 0::BIGINT AS "interval", 0::BIGINT AS reps, 2.5::DOUBLE AS ef, 0::BIGINT AS lapses
    FROM reviews WHERE k = 1
    UNION ALL
    SELECT f.learner_id, f.lemma, r.k,
        CASE WHEN r.q = 0 THEN 0 WHEN f."interval" = 0 THEN [1, 3, 5][r.q]
             ELSE floor(f."interval" * f.ef * [0.8::DOUBLE, 1.0::DOUBLE, 1.3::DOUBLE][r.q] + 0.5) END::BIGINT,
        f.reps + 1,
        greatest(1.3::DOUBLE, CASE WHEN r.q = 0 THEN f.ef - 0.2::DOUBLE
             ELSE f.ef + (0.1::DOUBLE - (3 - r.q)::DOUBLE * (0.08::DOUBLE + (3 - r.q)::DOUBLE * 0.02::DOUBLE)) END),
        f.lapses + CASE WHEN r.q = 0 THEN 1 ELSE 0 END
    FROM fold f JOIN reviews r ON r.learner_id = f.learner_id AND r.lemma = f.lemma AND r.k = f.k + 1
),
cards AS (
    SELECT f.learner_id, f.lemma, f."interval", f.reps, f.ef, f.lapses, r.q AS last_q,
           (r.ts::DATE + least(greatest(1, f."interval"), 36500)::INT) AS due
    FROM fold f JOIN reviews r ON r.learner_id = f.learner_id AND r.lemma = f.lemma AND r.k = f.k WHERE f.k = r.m
)
"""
_CARDS = CARDS.format(source="events")


def _half(name: str, parity: int) -> str:
    return f"{name} AS (SELECT * FROM ({CARDS.format(source=f'(SELECT * FROM events WHERE event_id % 2 = {parity})')} SELECT learner_id, lemma, due, reps, lapses FROM cards))"


def _ws(pattern: str) -> str:
    return pattern.replace(r"\s", WS)


_GRAMMAR = "rules AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {_q(rule)} AS rule, {_q(level)} AS level, regexp_extract_all(coalesce(text, ''), {_q(_ws(pattern))}, 0, 'i') AS hits FROM documents"
    for rule, level, pattern in RULES
) + ")"
_TRIM = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _distinct_first(hits: str, n: int) -> str:
    """The first distinct values in order."""
    trimmed = f"list_transform({hits}, lambda x: {_TRIM('x')})"
    return f"list_filter({trimmed}, lambda x, i: list_position({trimmed}, x) = i)[1:{n}]"


_ACCENT = """
bare AS (SELECT strip_accents(lemma) AS w, lemma, ord FROM lexicon WHERE strip_accents(lemma) <> lemma),
accents AS (SELECT DISTINCT w FROM bare WHERE w NOT IN (SELECT lemma FROM lexicon) AND w NOT IN (SELECT word FROM stops))
"""
_ERRORS = f"""
near AS (
    SELECT doc_id, pos, raw, w, lag(w) OVER d AS w0, lag(raw) OVER d AS raw0, lead(w) OVER d AS w1, lead(raw) OVER d AS raw1
    FROM toks WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
),
marked AS (
    SELECT near.*, a.w IS NOT NULL AS accent, x.gender, f.inf, g.inf AS inf1
    FROM near LEFT JOIN accents a ON a.w = near.w LEFT JOIN lexicon x ON x.lemma = near.w
    LEFT JOIN forms f ON f.form = near.w LEFT JOIN forms g ON g.form = near.w1
),
issues AS (
    SELECT doc_id, pos * 7 AS ord, 'accent' AS error, raw AS snippet FROM marked WHERE accent
    UNION ALL SELECT doc_id, pos * 7 + 1, 'english', raw FROM marked WHERE w IN {_in(ENGLISH)}
    UNION ALL SELECT doc_id, pos * 7 + 2, 'genre', raw0 || ' ' || raw FROM marked WHERE w0 IN ('le', 'la', 'un', 'une') AND gender <> '' AND (w0 IN ('le', 'un')) <> (gender = 'm')
    UNION ALL SELECT doc_id, pos * 7 + 3, 'articles', concat_ws(' ', raw0, 'a', raw1) FROM marked WHERE w = 'a' AND w1 IN {_in(DETERMINERS)}
    UNION ALL SELECT doc_id, pos * 7 + 4, 'de', 'de ' || raw1 FROM marked WHERE w = 'de' AND w1 IN ('le', 'les')
    UNION ALL SELECT doc_id, pos * 7 + 5, 'que_qui', 'que ' || raw1 FROM marked WHERE w = 'que' AND inf1 IS NOT NULL
    UNION ALL SELECT doc_id, pos * 7 + 6, 'aux', raw0 || ' ' || raw FROM marked WHERE w0 IN {_in(ETRE_FORMS)} AND inf IS NOT NULL AND ({_AUX}) = 'avoir'
    UNION ALL SELECT doc_id, 1099511627776 + k, 'neg', {_TRIM("hit")} FROM (
        SELECT doc_id, unnest(h) AS hit, generate_subscripts(h, 1) AS k FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_q(_ws(ORAL_NEGATION))}, 0, 'i') AS h FROM documents))
)
"""


def _replaced(out: str, pairs: list[tuple[str, str]]) -> str:
    for pattern, new in pairs:
        out = f"regexp_replace({out}, {_q(pattern)}, {new if new.startswith('chr') else _q(new)}, 'g')"
    return out


def _cleaned() -> str:
    # RE2 has no look-ahead: the letter that follows is taken and put back
    out = _replaced("coalesce(text, '')", [
        ("\\r\\n?", "chr(10)"), ("[\\x{2018}\\x{2019}\\x{2BC}\\x{2032}`\\x{B4}]", "'"), ("[\\x{201C}\\x{201D}\\x{201E}]", '"'), ("[\\x{2010}-\\x{2014}]", "-"),
        ("\\x{FB01}", "fi"), ("\\x{FB02}", "fl"), ("\\x{FB00}", "ff"), ("\\x{FB03}", "ffi"), ("\\x{FB04}", "ffl"), ("\\x{AD}", ""),
        ("([A-Za-zÀ-ÿ])-[ \\t]*\\n+[ \\t]*([a-zà-ÿ])", "\\1\\2"), ("([A-Za-zÀ-ÿ0-9»)\\x{201D}\\x{2019}])\\n+([.,;:!?»)\\x{201D}])", "\\1\\2"),
        ("([,;])\\n+([a-zà-ÿ])", "\\1 \\2"), ("\\n[|~*#_•·]{1,3}\\n", "chr(10)"), ("[ \\t]+\\n", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)"), ("[ \\t]{2,}", " "),
    ])
    return _TRIM(out)


_FRENCH = r"\b(le|la|les|de|des|un|une|et|est|dans|pour|avec|sur|que|qui|nous|vous|ils|elle|au|aux|du|ce|cette|mais|ou|où|ne|pas|plus|très|être|avoir|faire)\b"


def _html() -> str:
    out = _replaced("html", [("(?is)<script.*?</script>", ""), ("(?is)<style.*?</style>", ""), (f"(?i)<br{WS}*/?>", "chr(10)"), ("(?i)</(p|div|h[1-6]|li)>", "chr(10)"), ("<[^>]+>", "")])
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, {_q(name)}, {_q(c)})"
    return _TRIM(_replaced(out, [("[ \\t]+", " ")]))


_NORMAL = lambda x: f"""regexp_replace(regexp_replace(lower(strip_accents({x})), '[’''ʼ`·.,!?;:"()]', '', 'g'), '{WS}+', '', 'g')"""
_ANSWERS = "answers AS (SELECT a.conv_id, a.turn, a.text AS expected, b.text AS answer FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"
_LEVEL = "CASE level " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in LEVELS.items()) + " ELSE 3 END"


def oracle_sql() -> dict[str, str]:
    fr = _vocab(_FR)
    errors = _with(LEXICON, VERBS, STOPS, CONJUGATION, FORMS, _tokens(), _ACCENT, _ERRORS)
    level = "CASE error " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in ERROR_LEVELS.items()) + " ELSE '?' END"
    as_of = f"DATE '{AS_OF}'"
    days = f"(DATE '{EXAM}' - {as_of})::BIGINT"
    return {
        "token_counts": _with(_tokens()) + " SELECT doc_id, count(*) AS n_tokens, count(DISTINCT w) AS n_distinct FROM toks GROUP BY doc_id",
        "elisions": _with(_tokens()) + " SELECT prefix, count(*) AS n FROM toks WHERE prefix <> '' GROUP BY prefix",
        "sentence_stats": _with(SENTENCES) + " SELECT d.doc_id, count(sentence) AS n_sentences, coalesce(sum(length(sentence)), 0)::BIGINT AS n_chars FROM documents d LEFT JOIN sents s ON s.doc_id = d.doc_id GROUP BY d.doc_id",
        "word_stats": "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'))::BIGINT AS n_words FROM documents",
        "vocab_topk": fr + " SELECT doc_id, rank, lemma, n, array_to_string(forms, ';') AS forms, pos, level, in_lexicon FROM vocab WHERE rank <= 20",
        "vocab_levels": _vocab() + " SELECT level, pos, count(*) AS n_entries, sum(n)::BIGINT AS n_occurrences FROM vocab GROUP BY level, pos",
        "proper_nouns": fr + " SELECT doc_id, w, n FROM lemmas WHERE NOT in_lexicon AND caps = n",
        "vocab_example": fr + "," + SENTENCES + "," + _EXAMPLE + " SELECT v.doc_id, v.lemma, e.example FROM vocab v LEFT JOIN examples e ON e.doc_id = v.doc_id AND e.lemma = v.lemma WHERE v.rank <= 10",
        "vocab_summary": fr + " SELECT count(*) AS n_entries, coalesce(sum(n), 0)::BIGINT AS n_occurrences, count(*) FILTER (WHERE in_lexicon) AS n_in_lexicon, count(*) FILTER (WHERE gloss = '') AS n_without_gloss FROM vocab",
        "deck_additions": fr + ", left_over AS (SELECT doc_id, lemma, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank FROM vocab WHERE lemma NOT IN (SELECT lemma FROM lexicon WHERE level = 'A1')) SELECT doc_id, lemma, rank FROM left_over WHERE rank <= 50",
        "lexicon_coverage": fr + f", core AS (SELECT lemma FROM lexicon WHERE ({_LEVEL}) <= 2), c AS (SELECT count(*) AS n_core, count(*) FILTER (WHERE lemma IN (SELECT lemma FROM vocab)) AS n_known FROM core) SELECT n_core, n_known, floor(100.0::DOUBLE * n_known / greatest(n_core, 1) + 0.5)::BIGINT AS percent FROM c",
        "grammar_hits": _with(_GRAMMAR) + " SELECT doc_id, rule, level, len(hits)::BIGINT AS n FROM rules WHERE len(hits) > 0",
        "grammar_samples": _with(_GRAMMAR) + f" SELECT doc_id, rule, array_to_string({_distinct_first('hits', 3)}, '|') AS samples FROM rules WHERE len(hits) > 0",
        "error_hits": errors + f", numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, error ORDER BY ord) AS k FROM issues) SELECT doc_id, error, {level} AS level, count(*) AS n, string_agg(snippet, '|' ORDER BY ord) FILTER (WHERE k <= 4) AS samples FROM numbered GROUP BY doc_id, error",
        "vocab_filter": fr + ", f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS k FROM vocab WHERE level = 'B1' AND pos = 'n' AND (contains(lemma, 'tion') OR contains(lower(gloss), 'tion'))) SELECT doc_id, lemma, n FROM f WHERE k <= 300",
        "elided_words": _with(_ELIDED_DOCS, _tokens().replace("FROM documents", "FROM elided")) + " SELECT doc_id, pos::BIGINT AS pos, raw, w, prefix FROM toks",
        "quiz_distractors": fr + ", c AS (SELECT doc_id, lemma, row_number() OVER (PARTITION BY doc_id ORDER BY md5('1|' || lemma), lemma) AS place, count(*) OVER (PARTITION BY doc_id) AS m FROM vocab), a AS (SELECT doc_id, lemma, k, (place + k - 1) % m + 1 AS want FROM c, (VALUES (1), (2), (3)) t(k) WHERE k <= m - 1), d AS (SELECT a.doc_id, a.lemma, string_agg(c.lemma, ';' ORDER BY a.k) AS distractors FROM a JOIN c ON c.doc_id = a.doc_id AND c.place = a.want GROUP BY a.doc_id, a.lemma) SELECT c.doc_id, c.lemma, coalesce(d.distractors, '') AS distractors FROM c LEFT JOIN d USING (doc_id, lemma)",
        "quiz_questions": fr + "," + SENTENCES + "," + _EXAMPLE + """, one AS (SELECT inf, arg_min(struct_pack(tense := tense, person := person, form := form), md5('1|' || inf || '|' || tense || '|' || person)) AS x FROM conj WHERE form <> '—' GROUP BY inf),
            q AS (SELECT v.doc_id, v.lemma, v.gloss, v.pos, e.example, one.x, regexp_extract(e.example, '(?i)\\b' || regexp_escape(v.lemma) || '[0-9A-Za-z_]*') AS hit
                  FROM vocab v LEFT JOIN examples e ON e.doc_id = v.doc_id AND e.lemma = v.lemma LEFT JOIN one ON one.inf = v.lemma WHERE v.rank <= 10)
            SELECT doc_id, lemma, 'recognise' AS mode, lemma AS prompt, gloss AS answer FROM q WHERE gloss <> ''
            UNION ALL SELECT doc_id, lemma, 'listen', coalesce(example, lemma), lemma FROM q
            UNION ALL SELECT doc_id, lemma, 'use', regexp_replace(example, '(?i)\\b' || regexp_escape(lemma) || '[0-9A-Za-z_]*', '______'), lemma FROM q WHERE hit <> ''
            UNION ALL SELECT doc_id, lemma, 'conj', lemma || ' ' || x.tense || ' ' || (x.person + 1), x.form FROM q WHERE pos = 'v' AND x IS NOT NULL
            UNION ALL SELECT doc_id, lemma, 'produce', gloss, lemma FROM q WHERE gloss <> ''
            UNION ALL SELECT doc_id, lemma, 'read', example, gloss FROM q WHERE gloss <> '' AND example IS NOT NULL""",
        "skill_scores": errors + "," + _GRAMMAR + ", r AS (SELECT doc_id, count(*) AS n_rules FROM rules WHERE len(hits) > 0 GROUP BY doc_id), i AS (SELECT doc_id, count(*) AS n_errors FROM issues GROUP BY doc_id) SELECT d.doc_id, coalesce(n_rules, 0) AS n_rules, least(1.0::DOUBLE, coalesce(n_rules, 0) / 8.0::DOUBLE) AS grammar, coalesce(n_errors, 0) AS n_errors, greatest(0, 100 - 6 * coalesce(n_errors, 0)) AS correctness FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id",
        "file_sizes": "WITH s AS (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents) SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN round(n / 1024.0::DOUBLE, 1)::DECIMAL(20, 1)::VARCHAR || ' KB' ELSE round(n / 1048576.0::DOUBLE, 1)::DECIMAL(20, 1)::VARCHAR || ' MB' END AS size FROM s",
        "french_clean": f"SELECT doc_id, {_cleaned()} AS text FROM documents",
        "text_quality": f"WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{2,}}') AS words, len(regexp_extract_all(coalesce(text, ''), '[éèêëàâîïôûùçœæÉÈÊËÀÂÎÏÔÛÙÇŒÆ]')) AS accents FROM documents), h AS (SELECT doc_id, len(words) AS n, accents, len(list_filter(words, lambda x: regexp_matches(x, {_q(_FRENCH)}, 'i'))) AS hints FROM w) SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN n < 8 OR (hints::DOUBLE / n < 0.06::DOUBLE AND accents < 3) THEN 'low' ELSE 'ok' END AS quality FROM h",
        "html_text": f"SELECT page_id, {_html()} AS text FROM pages",
        "book_texts": f"SELECT page_id, coalesce({_html()}, '') AS text FROM pages",
        "accent_free": "SELECT doc_id, strip_accents(text) AS text FROM documents",
        "conjugation_table": _with(LEXICON, VERBS, CONJUGATION) + " SELECT inf, tense, person::BIGINT AS person, form FROM conj",
        "verb_form_index": _with(LEXICON, VERBS, CONJUGATION, FORMS) + " SELECT form, inf FROM forms",
        "srs_state": _CARDS + ' SELECT learner_id, lemma, "interval", reps, round(ef, 6) AS ef, lapses, due::VARCHAR AS due, last_q::BIGINT AS last_q FROM cards',
        "due_today": _CARDS + f" SELECT learner_id, lemma, due::VARCHAR AS due FROM cards WHERE due <= {as_of}",
        "due_forecast": _CARDS + f", days AS (SELECT ({as_of} + i::INT) AS day FROM range(14) r(i)) SELECT day::DATE::VARCHAR AS day, count(lemma) AS n FROM days LEFT JOIN cards ON due = day GROUP BY day",
        "study_plan": _CARDS + f" SELECT count(*) AS n_cards, count(*) FILTER (WHERE due <= {as_of}) AS n_due, count(*) FILTER (WHERE reps > 0) AS n_learned, {days} AS days, ceil(count(*)::DOUBLE / {days})::BIGINT AS per_day FROM cards",
        "learner_report": _CARDS + ", c AS (SELECT learner_id, count(*) AS total, count(*) FILTER (WHERE reps > 0 AND last_q > 0) AS known, count(*) FILTER (WHERE lapses > 0) AS weak FROM cards GROUP BY learner_id), r AS (SELECT learner_id, count(*) AS reviews, count(*) FILTER (WHERE q > 0) AS correct FROM reviews GROUP BY learner_id) SELECT learner_id, total, known, weak, reviews, correct, floor(100.0::DOUBLE * correct / reviews + 0.5)::BIGINT AS accuracy FROM c JOIN r USING (learner_id)",
        "weak_list": _CARDS + " SELECT learner_id, lemma, lapses FROM (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY lapses DESC, lemma) AS k FROM cards WHERE lapses > 0) WHERE k <= 30",
        "mastery": _CARDS + ", m AS (SELECT lemma, count(*) AS n_cards, count(*) FILTER (WHERE reps > 0 AND last_q > 0) AS n_mastered FROM cards GROUP BY lemma) SELECT *, floor(100.0::DOUBLE * n_mastered / n_cards + 0.5)::BIGINT AS percent FROM m",
        "rate_limit_daily": "WITH u AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS used FROM events) SELECT *, used <= 3 AS allowed FROM u",
        "tumbling_daily": "SELECT user_id, (ts::DATE)::VARCHAR AS day, count(*) AS n FROM events GROUP BY user_id, ts::DATE",
        "backup_merge": "WITH " + _half("mine", 0) + ", " + _half("theirs", 1) + ", both_states AS (SELECT *, 1 AS src FROM mine UNION ALL SELECT *, 0 FROM theirs), r AS (SELECT *, row_number() OVER (PARTITION BY learner_id, lemma ORDER BY due DESC, src DESC) AS k FROM both_states) SELECT learner_id, lemma, due::VARCHAR AS due, reps, lapses FROM r WHERE k = 1",
        "backup_json": _CARDS + " SELECT learner_id, to_json(struct_pack(format := 'glotta-backup', version := 1, state := struct_pack(cards := list(struct_pack(lemma := lemma, due := due::VARCHAR, reps := reps) ORDER BY lemma)))) ::VARCHAR AS json FROM cards GROUP BY learner_id",
        "grade_answers": _with(_ANSWERS) + f" SELECT conv_id, turn, CASE WHEN coalesce({_NORMAL('answer')}, '') = '' THEN FALSE ELSE {_NORMAL('answer')} = {_NORMAL('expected')} END AS ok, CASE WHEN coalesce({_NORMAL('answer')}, '') = '' THEN 'empty' WHEN {_NORMAL('answer')} = {_NORMAL('expected')} THEN 'right' ELSE 'wrong' END AS msg FROM answers",
        "target_used": _with(_ANSWERS) + f", f AS (SELECT *, regexp_extract(expected, '[A-Za-zÀ-ÿ]{{4,}}') AS word FROM answers) SELECT conv_id, turn, contains({_NORMAL('answer')}, {_NORMAL('word')}) AND word <> '' AS used FROM f",
        "targets_in_documents": f"WITH d AS (SELECT doc_id, {_NORMAL('text')} AS t FROM documents), b AS (SELECT item_id, {_NORMAL('text')} AS e FROM benchmark) SELECT doc_id, item_id AS target_id FROM d JOIN b ON e <> '' AND contains(t, e)",
        "page_ranges": "WITH e AS (SELECT event_id, least(event_id % 17 + 1, event_id % 5 + 1) AS a, greatest(event_id % 17 + 1, event_id % 5 + 1) AS b, event_id % 31 AS c FROM events) SELECT event_id, array_to_string(list_filter(range(1, 21), lambda p: (p BETWEEN a AND b) OR p = c), ',') AS pages FROM e",
        "anki_rows": fr + "," + SENTENCES + "," + _EXAMPLE + " SELECT v.doc_id, v.lemma || CASE WHEN gender <> '' THEN ' (' || gender || ')' ELSE '' END AS front, gloss AS back, regexp_replace(coalesce(example, ''), regexp_escape(v.lemma), '[...]', 'gi') AS sentence, 'glotta_' || level || '_' || pos AS tag FROM vocab v LEFT JOIN examples e ON e.doc_id = v.doc_id AND e.lemma = v.lemma WHERE v.rank <= 10",
    }
