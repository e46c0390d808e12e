"""Column functions on text. Boundaries and white space follow the ECMAScript rules that the results depend on."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, an ASCII word boundary, tokens, elided words.
_FAR_SPACES = "".join(map(chr, [0xA0, 0x1680, 0x2000])) + "-" + "".join(map(chr, [0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
# Ranges, and those beyond ASCII behind one comparison: a letter of a class is otherwise held against each of its members.
_SPACES = f"[{chr(0xA0)}-{chr(0xFEFF)}&&[{_FAR_SPACES}]]"
WS = rf"[ \t-\r{_SPACES}]"
# An ASCII word character where case is folded in all alphabets, as a class that needs no folding.
_FOLDED_WORD = "(?-iu:[a-z0-9A-Z_" + "".join(map(chr, [0x130, 0x131, 0x17F, 0x212A])) + "])"
BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
# Possessive, as no part of a token is ever given back: a token of any number of parts needs no stack.
TOKEN = r"[a-zA-ZÀ-ÿŒœ]++(?:[-'’][a-zA-ZÀ-ÿŒœ]++)*+"
ELIDED = r"^(?:l|d|j|m|t|s|n|c|qu|jusqu|puisqu|quoiqu|lorsqu|presqu)'"

#: All letters up to U+024F that carry an accent, and their base letters.
_ACCENTED = [chr(c) for c in range(0xC0, 0x250) if len(b := unicodedata.normalize("NFD", chr(c))) > 1 and all(0x300 <= ord(x) < 0x370 for x in b[1:])]
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def ascii_rule(pattern: str) -> str:
    r"""A rule whose ``\b`` and ``\s`` have the ECMAScript meaning, for Spark; case is folded in all alphabets.

    Where what follows or precedes a boundary can only be an ASCII word character, one look-around is enough.
    """
    pieces = pattern.split(r"\b")
    out = pieces[0]
    for before, after in zip(pieces, pieces[1:]):
        if _all_ascii(re.match(r"(\\w|[0-9A-Za-z_])|\(([^()\\]*)\)", after), 0):
            out += f"(?<!{_FOLDED_WORD})"
        elif _all_ascii(re.search(r"(\\w\+?|(?<!\\)[0-9A-Za-z_])$|\(([^()\\]*)\)$", before), -1):
            out += f"(?!{_FOLDED_WORD})"
        else:
            out += BOUNDARY
        out += after
    return "(?iu)" + out.replace(r"\s", WS)


def _all_ascii(found: re.Match | None, at: int) -> bool:
    """Whether a match is a word character, or a group whose alternatives all have one at the end ``at``."""
    return bool(found) and (found[2] is None or all(x and x[at].isascii() and x[at].isalnum() for x in found[2].split("|")))


def quoted(text: Column) -> Column:
    """The text as a pattern that matches itself."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def trimmed(text: Column) -> Column:
    # a run of blanks within the text is tried once, at its beginning
    return F.regexp_replace(text, f"^{WS}++|{WS}(?<!{WS}{WS}){WS}*+$", "")


def collapsed(text: Column) -> Column:
    # a single blank is left as it is
    return F.regexp_replace(text, rf" {WS}++|[\t-\r{_SPACES}]{WS}*+", " ")


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def elision(raw: Column) -> Column:
    """The elided word before a token (``l'``), or empty."""
    low = F.replace(F.lower(raw), F.lit("’"), F.lit("'"))
    return F.when(low.contains("'"), F.regexp_extract(low, ELIDED, 0)).otherwise("")


def word_of(raw: Column) -> Column:
    """The token in lower case, without an elided word before it."""
    return word_of_low(F.lower(raw))


def word_of_low(low: Column) -> Column:
    """``word_of`` of a token in lower case; only a token with an apostrophe meets a pattern."""
    low = F.replace(low, F.lit("’"), F.lit("'"))
    return F.when(low.contains("'"), F.regexp_replace(low, ELIDED, "")).otherwise(low)


def words(text: Column) -> Column:
    """The words of all tokens, in their order."""
    return F.transform(raw_tokens(F.lower(text)), word_of_low)


def sentences(text: Column) -> Column:
    """Sentences of 13 to 399 characters: cut after . ! ? ; : … and white space."""
    # collapsed texts have no white space but single blanks
    parts = F.split(collapsed(F.coalesce(text, F.lit(""))), r" (?<=[.!?;:…] )")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: (F.length(s) > 12) & (F.length(s) < 400))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).cast("bigint")


def strip_accents(text: Column) -> Column:
    """Letters without their accents; ligatures stay. Combining marks go."""
    return F.regexp_replace(F.translate(text, "".join(_ACCENTED), _PLAIN), f"[{chr(0x300)}-{chr(0x36F)}]", "")


def normal_answer(text: Column) -> Column:
    """An answer as it is compared: no accents, lower case, no punctuation, no white space."""
    bare = F.regexp_replace(F.lower(strip_accents(text)), "[’'ʼ`·.,!?;:\"()]", "")
    return F.regexp_replace(bare, f"{WS}+", "")


def grade_answer(answer: Column, expected: Column) -> Column:
    """struct(ok, msg, note): empty, right (with a reminder of the accents) or wrong."""
    given, wanted = normal_answer(answer), normal_answer(expected)

    def said(ok: bool, msg: str, note: Column) -> Column:
        return F.struct(F.lit(ok).alias("ok"), F.lit(msg).alias("msg"), note.alias("note"))

    reminder = F.when(strip_accents(expected) != expected, F.concat(F.lit("mind the accents: "), expected)).otherwise("")
    return (
        F.when(F.coalesce(given, F.lit("")) == "", said(False, "empty", F.lit("")))
        .when(given == wanted, said(True, "right", reminder))
        .otherwise(said(False, "wrong", F.concat(F.lit("expected: "), expected)))
    )


def is_number_word(word: Column, numerals: list[str]) -> Column:
    """Whether every part between hyphens is a numeral or digits."""
    is_number = lambda p: p.isin(numerals) | p.rlike("^[0-9]+$")
    return F.when(word.contains("-"), F.forall(F.split(word, "-"), is_number)).otherwise(is_number(word))


def html_to_text(html: Column) -> Column:
    """The readable text of a page: no scripts, styles and tags, some block ends as line breaks, entities resolved, blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<script.*?</script>", "")
    out = F.regexp_replace(out, r"(?is)<style.*?</style>", "")
    out = F.regexp_replace(out, rf"(?i)<br{WS}*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</(p|div|h[1-6]|li)>", "\n")
    out = unescape(F.regexp_replace(out, "<[^>]+>", ""))
    return trimmed(F.regexp_replace(out, r"[ \t]+", " "))


def escape_html(text: Column) -> Column:
    """The text with the five characters that mark-up gives a meaning as entities, the ampersand first."""
    out = text
    for c, name in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]:
        out = F.replace(out, F.lit(c), F.lit(name))
    return out


# Named entities, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape(text: Column) -> Column:
    """Entities as characters: numeric ones first, then the named ones, the ampersand last."""
    numeric = r"&#(?:x[0-9a-fA-F]{1,6}|[0-9]{1,7});"

    def char(entity: Column) -> Column:
        hexed = F.conv(F.regexp_extract(entity, "x([0-9a-fA-F]+)", 1), 16, 10).cast("int")
        code = F.when(F.instr(entity, "x") > 0, hexed).otherwise(F.regexp_extract(entity, "#([0-9]*)", 1).try_cast("int"))
        high = F.concat(F.lit("0000"), F.lower(F.hex(code)))
        utf32 = F.unhex(F.right(F.concat(F.lit("0000"), high), F.lit(8)))
        return F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.decode(utf32, "UTF-32")).otherwise(entity)

    news = F.transform(F.regexp_extract_all(text, F.lit(numeric), F.lit(0)), char)
    pieces = F.split(text, numeric, -1)
    joined = F.array_join(F.zip_with(pieces, news, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = F.when(text.contains("&#"), joined).otherwise(text)
    for name, c in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(c))
    return out


# Repairs in order. Line ends, quotes, dashes, ligatures, soft hyphens.
CHARACTER_REPAIRS = [("\r\n?", "\n"), ("[‘’ʼ′`´]", "'"), ("[“”„]", '"'), ("[‐‑‒–—]", "-")]
LIGATURES = [("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), (chr(0xAD), "")]
# Words cut at a line end, marks and sentences on the next line.
LINE_REPAIRS = [(r"([A-Za-zÀ-ÿ])-[ \t]*\n+[ \t]*(?=[a-zà-ÿ])", "$1"), (r"([A-Za-zÀ-ÿ0-9»”’)])\n+([.,;:!?»”)])", "$1$2"), (r"([,;])\n+(?=[a-zà-ÿ])", "$1 ")]
# Stray lines; then blanks.
STRAY_LINES = [(r"\n[|~*#_•·]{1,3}\n", "\n")]
BLANK_REPAIRS = [(r"(?<![ \t])[ \t]++\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")]


def _repaired(text: Column, repairs: list[tuple[str, str]]) -> Column:
    out = F.coalesce(text, F.lit(""))
    for pattern, new in repairs:
        out = F.regexp_replace(out, pattern, new)
    return trimmed(out)


def french_clean(text: Column) -> Column:
    """Recognised French text with the faults mended that are safe to mend; null gives an empty text."""
    return _repaired(text, CHARACTER_REPAIRS + LIGATURES + LINE_REPAIRS + STRAY_LINES + BLANK_REPAIRS)


def page_clean(text: Column) -> Column:
    """The text of a page layout with its cut words, lines and blanks mended; quotes and dashes stay."""
    return _repaired(text, LIGATURES + LINE_REPAIRS + BLANK_REPAIRS)


# Words that show French, and the letters with accents that do.
FRENCH_HINT = r"\b(le|la|les|de|des|un|une|et|est|dans|pour|avec|sur|que|qui|nous|vous|ils|elle|au|aux|du|ce|cette|mais|ou|où|ne|pas|plus|très|être|avoir|faire)\b"
FRENCH_ACCENTS = "[éèêëàâîïôûùçœæÉÈÊËÀÂÎÏÔÛÙÇŒÆ]"


def text_quality(text: Column) -> Column:
    """empty, low or ok, by the number of words, of words with a frequent French word between ASCII boundaries, and of accents."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit("[A-Za-zÀ-ÿ]{2,}"), F.lit(0))
    hints = F.size(F.filter(words, lambda w: w.rlike(ascii_rule(FRENCH_HINT))))
    accents = F.length(text) - F.length(F.regexp_replace(text, FRENCH_ACCENTS, ""))
    few = (hints / F.size(words) < 0.06) & (accents < 3)
    return F.when(F.size(words) == 0, "empty").when((F.size(words) < 8) | few, "low").otherwise("ok")


def material_domain(text: Column, least: int = 8, most: int = 70) -> Column:
    """The first line of more than eight characters, cut to seventy; empty where there is none."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), trimmed), lambda x: F.length(x) > least)
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, most), F.lit(""))


def word_beginnings(text: Column, to_blank: bool = True) -> Column:
    """The lower-cased rest of the text from each ASCII word boundary on, up to a blank or to the end."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?s){BOUNDARY}(?=({'[^ ]' if to_blank else '.'}+))"), F.lit(1))


def cloze(sentence: Column, lemma: Column) -> Column:
    """The sentence with the first word that begins with the lemma blanked, or null where there is none."""
    rest = F.get(F.filter(word_beginnings(sentence, to_blank=False), lambda x: F.startswith(x, F.lower(lemma))), F.lit(0))
    at = F.length(sentence) - F.length(rest)
    after = F.substring(sentence, at + F.length(lemma) + 1, F.length(sentence))
    return F.concat(F.substring(sentence, F.lit(1), at), F.lit("______"), F.regexp_replace(after, r"\A[0-9A-Za-z_]+", ""))


def blanked(text: Column, word: Column, blank: str) -> Column:
    """The text with every occurrence of the word, in whatever case, as ``blank``."""
    mark = chr(1)
    pieces = F.split(F.replace(F.lower(F.translate(text, mark, " ")), F.lower(word), F.lit(mark)), mark)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("kept"))
    step = lambda s, p: F.struct((s["at"] + F.length(p) + F.length(word)).alias("at"), F.array_append(s["kept"], F.substring(text, s["at"], F.length(p))).alias("kept"))
    return F.aggregate(pieces, start, step, lambda s: F.array_join(s["kept"], blank))


def context_of(text: Column, lemma: Column, before: int = 30, after: int = 45) -> Column:
    """The text around the first place of the lemma, white space collapsed; null where there is none."""
    at = F.regexp_instr(text, F.concat(F.lit(f"(?iu){BOUNDARY}"), quoted(lemma)))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, trimmed(collapsed(F.substring(text, start, at - start + after))))


def page_range(spec: Column, total: Column) -> Column:
    """``1-10,3,5`` as sorted distinct page numbers within 1..total; null where none is meant."""
    parts = F.split(F.translate(F.coalesce(spec, F.lit("")), "，~", ",-"), f"(?:,|{WS})+")
    valid = F.filter(parts, lambda p: p.rlike("^[0-9]{1,9}(-[0-9]{1,9})?$"))

    def pages(part: Column) -> Column:
        a = F.split(part, "-")[0].cast("int")
        b = F.coalesce(F.get(F.split(part, "-"), F.lit(1)).cast("int"), a)
        low, high = F.greatest(F.least(a, b), F.lit(1)), F.least(F.greatest(a, b), total)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    found = F.array_sort(F.array_distinct(F.flatten(F.transform(valid, pages))))
    return F.when(F.size(found) > 0, found)


def gloss_lines(reply: Column, n: Column, most: int = 24) -> Column:
    """The first ``n`` glosses of a model's reply: one a line, without numbering, bullets, quotes and a word before a colon; markup is refused."""
    lines = F.transform(F.split(reply, "\n"), trimmed)
    bare = F.transform(lines, lambda x: F.regexp_replace(x, rf"^{WS}*(?:[0-9]+{WS}*[.、)]|[-•*]){WS}*", ""))
    bare = F.transform(bare, lambda x: trimmed(F.regexp_replace(x, rf"^{WS}*[*\"'`]+|[*\"'`]+{WS}*$", "")))
    named = F.transform(bare, lambda x: F.when(F.split(x, "[：:]")[0].rlike("[一-龥]"), x).otherwise(F.regexp_replace(x, rf"^[^：:]*[：:]{WS}*", "")))
    good = F.filter(named, lambda x: (x != "") & ~x.rlike("[<>{}]"))
    return F.slice(F.transform(good, lambda x: F.substring(x, 1, most)), F.lit(1), n)
