"""Grammar structures by rules, and their samples."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotta.functions import text as X

# Rule id, level, pattern (boundaries and classes are ASCII, case is ignored).
RULES = [
    ("pc", "A1", r"\b(ai|as|a|avons|avez|ont|suis|es|est|sommes|êtes|sont)\s+(\w+(é|é\(e\)|u|is|it|ert))\b"),
    ("impar", "A2", r"\b\w+(ais|ais|ait|ions|iez|aient)\b"),
    ("futur", "A2", r"\b\w+(rai|ras|ra|rons|rez|ront)\b"),
    ("cond", "B1", r"\b\w+(rais|rais|rait|rions|riez|raient)\b"),
    ("subj", "B1", r"\bque\s+(il|elle|je|tu|nous|vous|ils|elles|on)\s+\w+(e|es|e|ions|iez|ent)\b"),
    ("partitif", "A1", r"\b(du|de la|des)\s+\w+"),
    ("negation", "A1", r"\bne\s+\w+\s+(pas|plus|jamais|rien|personne|aucun)\b"),
    ("relatif", "A2", r"\b(qui|que|dont|où|lequel|laquelle|lesquels|lesquelles)\b"),
    ("pronom", "A2", r"\b(je|tu|il|elle|nous|vous|ils|elles)\s+(le|la|les|lui|leur|y|en)\b"),
    ("passif", "B1", r"\b(est|sont|était|étaient|sera|seront)\s+\w+(é|ée|és|ées)\s+(par|de)\b"),
    ("imperatif", "A2", r"^[^.?!]*\b(va|allons|allez|prends|prenons|prenez|viens|venons|venez)\b"),
    ("gerondif", "B1", r"\ben\s+\w+ant\b"),
    ("pronominal", "A2", r"\b(je me|tu te|il se|elle se|nous nous|vous vous|ils se|elles se)\s+\w+"),
    ("si", "B1", r"\bsi\s+\w+\s+(avais|avait|étais|était|ai|a|est)\b"),
    ("futurproche", "A1", r"\b(vais|vas|va|allons|allez|vont)\s+\w+(er|ir|re|oir)\b"),
]


_SUFFIX_RULE = re.compile(r"\\b\\w\+\(([a-z|]+)\)\\b")
_FIRST_WORDS = re.compile(r"\\b\(?([a-z |]+)\)?\\s\+|\\b\(([a-z |]+)\)")


_WORD = "[0-9A-Za-z_]"


def _first_words(pattern: str) -> list[str]:
    """The first words of a rule that begins with given ASCII words, else none."""
    first = _FIRST_WORDS.match(pattern)
    return sorted({x.split(" ")[0] for x in (first[1] or first[2]).split("|")}) if first else []


def _matches(pattern: str) -> Column:
    return F.regexp_extract_all("text", F.lit(pattern), F.lit(0))


def _one_of(words: list[list[str]]) -> str:
    return "|".join(sorted({x for part in words for x in part}, key=lambda x: (-len(x), x)))


def _hits(pattern: str) -> Column:
    """All matches of a rule in the column text, whose ASCII words with an ending of some rule are the column ended, and those that some rule begins with the column begun.

    A rule on the ends of words looks at the words alone. One that begins with given ASCII words
    looks at texts that have one of them.
    """
    ends = _SUFFIX_RULE.fullmatch(pattern)
    if ends:
        return F.filter("ended", lambda w: w.rlike(f"(?i).(?:{ends[1]})$"))
    every = _matches(X.ascii_rule(pattern))
    named = _first_words(pattern)
    if not named:
        return every
    return F.when(F.arrays_overlap("begun", F.array(*map(F.lit, named))), every).otherwise(F.array().cast("array<string>"))


def grammar_hits(docs: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(doc_id, rule, rule_ord, level, n, samples) of the rules that occur in a document.

    samples are the first three distinct matches, trimmed. One pass over the text, no shuffle.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # one pass each for all rules on ends and all first words; most words of a text are of no rule
    none = F.array().cast("array<string>")
    ends = _one_of([x[1].split("|") for _, _, p in rules if (x := _SUFFIX_RULE.fullmatch(p))])
    last = "".join(sorted({x[-1] for x in ends.split("|") if x}))
    ended = _matches(f"(?i)(?<!{_WORD}){_WORD}++(?<=[{last}])(?<=(?:{ends}))") if ends else none
    first = _one_of([_first_words(p) for _, _, p in rules if not _SUFFIX_RULE.fullmatch(p)])
    begun = _matches(f"(?i)(?<!{_WORD})(?:{first})(?!{_WORD})") if first else none
    texts = texts.withColumns({"ended": ended, "begun": F.array_distinct(F.transform(begun, F.lower))})
    found = [
        F.struct(F.lit(rule).alias("rule"), F.lit(k).alias("rule_ord"), F.lit(level).alias("level"), _hits(pattern).alias("hits"))
        for k, (rule, level, pattern) in enumerate(rules)
    ]
    return (
        texts.select("doc_id", F.explode(F.array(*found)).alias("x"))
        .where(F.size("x.hits") > 0)
        .select(
            "doc_id",
            "x.rule",
            "x.rule_ord",
            "x.level",
            F.size("x.hits").cast("bigint").alias("n"),
            F.slice(F.array_distinct(F.transform("x.hits", X.trimmed)), 1, 3).alias("samples"),
        )
    )
