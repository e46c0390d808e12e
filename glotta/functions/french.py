"""French morphology as column expressions: conjugation, articles, agreement, guesses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glotta.lexicon import ETRE_VERBS, GRAVE_VERBS

# Endings of the six persons.
FUTURE = ["ai", "as", "a", "ons", "ez", "ont"]
PAST = ["ais", "ais", "ait", "ions", "iez", "aient"]
SUBJUNCTIVE = ["e", "es", "e", "ions", "iez", "ent"]
VOWEL = "(?iu)^[aeiouyàâäéèêëîïôöùûüh]"


def without(text: Column, n: int) -> Column:
    """The text without its last ``n`` characters."""
    return F.substring(text, F.lit(1), F.greatest(F.length(text) - n, F.lit(0)))


def _last_changed(text: Column, old: str, new: str) -> Column:
    """The text with the last ``old`` letter changed."""
    return F.regexp_replace(text, f"{old}([^{old}]*)$", f"{new}$1")


def nous_stem(inf: Column) -> Column:
    """The stem of the first person plural of a regular verb."""
    stem = without(inf, 2)
    return (
        F.when(inf.endswith("ger"), F.concat(stem, F.lit("e")))
        .when(inf.endswith("cer"), F.concat(without(stem, 1), F.lit("ç")))
        .when(inf.endswith("ir"), F.concat(stem, F.lit("iss")))
        .otherwise(stem)
    )


def mute_stem(inf: Column) -> Column:
    """The stem before a mute ending of a verb in -er."""
    stem = without(inf, 2)
    return (
        F.when(F.right(stem, F.lit(4)).contains("é"), _last_changed(stem, "é", "è"))
        .when(inf.isin(GRAVE_VERBS), _last_changed(stem, "e", "è"))
        .when(inf.rlike("(el|et)er$"), F.concat(stem, F.right(stem, F.lit(1))))
        .otherwise(stem)
    )


def auxiliary(inf: Column) -> Column:
    return F.when(inf.rlike("^(se |s’)") | inf.isin(ETRE_VERBS), "être").otherwise("avoir")


def participle(inf: Column) -> Column:
    """The past participle of a regular verb; null for other endings."""
    return (
        F.when(inf.endswith("er"), F.concat(without(inf, 2), F.lit("é")))
        .when(inf.endswith("uire"), F.concat(without(inf, 3), F.lit("uit")))
        .when(inf.endswith("ir"), F.concat(without(inf, 2), F.lit("i")))
        .when(inf.endswith("re"), F.concat(without(inf, 2), F.lit("u")))
    )


def _ended(stem: Column, endings: list[str]) -> Column:
    return F.array(*(F.concat(stem, F.lit(e)) for e in endings))


def conjugation(inf: Column, tense: str, *, pres: Column, subj: Column, fut: Column, pp: Column, aux: Column, aux_pres: Column) -> Column:
    """The six forms in a tense. The columns after ``tense`` are an irregular verb's own forms, or null.

    ``aux_pres`` has the present of the auxiliary. A tense that a verb has no rule for has six dashes.
    """
    irregular, stem, nous = pres.isNotNull(), without(inf, 2), nous_stem(inf)
    dashes = F.array(*[F.lit("—")] * 6)
    if tense == "pres":
        mute = mute_stem(inf)
        first = F.array(*(F.concat(mute, F.lit(e)) for e in ("e", "es", "e")), F.concat(nous, F.lit("ons")), F.concat(stem, F.lit("ez")), F.concat(mute, F.lit("ent")))
        second = F.array(*(F.concat(stem, F.lit(e)) for e in ("is", "is", "it", "issons", "issez", "issent")))
        third_person = F.when(stem.endswith("d"), stem).otherwise(F.concat(stem, F.lit("t")))
        third = F.array(F.concat(stem, F.lit("s")), F.concat(stem, F.lit("s")), third_person, *(F.concat(stem, F.lit(e)) for e in ("ons", "ez", "ent")))
        regular = F.when(inf.endswith("er"), first).when(inf.endswith("ir"), second).when(inf.endswith("re"), third).otherwise(dashes)
        return F.when(irregular, pres).otherwise(regular)
    if tense == "impar":
        own = F.when(inf == "être", F.lit("ét")).otherwise(F.regexp_replace(F.get(pres, F.lit(3)), "ons$", ""))
        # computed from the first person plural: its softening e goes
        regular = F.when(inf.endswith("ger"), without(nous, 1)).otherwise(nous)
        return _ended(F.when(irregular, own).otherwise(regular), PAST)
    if tense in ("futur", "cond"):
        regular = F.when(inf.endswith("re"), without(inf, 1)).otherwise(inf)
        return _ended(F.when(irregular, fut).otherwise(regular), FUTURE if tense == "futur" else PAST)
    if tense == "subj":
        softened = F.when(nous.endswith("ge"), without(nous, 1)).otherwise(nous)
        regular = F.array(*(F.concat(softened if e.startswith("i") else nous, F.lit(e)) for e in SUBJUNCTIVE))
        return F.when(irregular, subj).otherwise(regular)
    past = F.when(irregular, pp).otherwise(F.coalesce(participle(inf), F.lit("?")))
    return F.transform(aux_pres, lambda x: F.concat(x, F.lit(" "), past))


def article(kind: str, word: Column, gender: Column) -> Column:
    """The word after its article: def, ind, dem, part, du, a or de."""
    vowel, feminine = word.rlike(VOWEL), gender == "f"
    pick = lambda elided, f, m: F.when(vowel, elided).when(feminine, f).otherwise(m)
    before = {
        "def": pick("l'", "la ", "le "),
        "part": pick("de l'", "de la ", "du "),
        "a": pick("à l'", "à la ", "au "),
        "ind": F.when(feminine, "une ").otherwise("un "),
        "dem": F.when(feminine, "cette ").when(vowel, "cet ").otherwise("ce "),
        "du": F.when(vowel, "de l'").otherwise("du "),
        "de": F.when(vowel, "d'").otherwise("de "),
    }[kind]
    return F.concat(before, word)


def agreed(adjective: Column, gender: Column, plural: Column | bool = False) -> Column:
    plural = F.lit(plural) if isinstance(plural, bool) else plural
    return F.concat(adjective, F.when(gender == "f", "e").otherwise(""), F.when(plural, "s").otherwise(""))


def _ends_in(word: Column, endings: str) -> Column:
    return reduce(lambda a, b: a | b, (word.endswith(x) for x in endings.split("|")))


def guessed_pos(word: Column, is_form: Column) -> Column:
    """The part of speech by the ending, where the lexicon has none."""
    return (
        F.when(is_form, "v")
        .when(word.endswith("ment") & (F.length(word) > 5), "adv")
        .when(_ends_in(word, "eux|euse|ique|able|ible|ain|el|al"), "adj")
        .otherwise("n")
    )


def guessed_level(lemma: Column, count: Column) -> Column:
    """The level by frequency, length and ending, where the lexicon has none."""
    score = (
        F.least(count, F.lit(12)) * 3
        + F.when(F.length(lemma) <= 5, 8).when(F.length(lemma) <= 8, 4).otherwise(0)
        + F.when(lemma.endswith("ment"), 3).otherwise(0)
        + F.when(_ends_in(lemma, "tion|sion|té"), 2).otherwise(0)
    )
    return F.when(score >= 30, "A1").when(score >= 20, "A2").when(score >= 12, "B1").otherwise("B2")
