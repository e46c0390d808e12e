"""Personal data: format-preserving pseudonyms by a keyed Feistel network. DataFrame functions only.

Values are found by patterns, pass after pass over what is left, and validated (card numbers by their check digit, addresses by
their octets, dates by the calendar). A value becomes a row of digits, each with a radix of its
own: a letter in lower or upper case 26, a decimal digit 10, a hexadecimal digit 16, an octet
256, a date the number of its day. The row is cut into two halves; in each round every digit of
one half is shifted, modulo its radix, by a keyed hash of the other half. Whatever the radices,
that permutes the values of a format: equal values get equal pseudonyms in all documents,
different values different ones, and the pseudonym has the format of the value.

Each document is rewritten by itself: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Days from 1900-01-01 to 2099-12-31; 73049 = 17 * 4297, so a day is two digits.
_DATE_RADICES, _FIRST_DAY = (17, 4297), "1900-01-01"

#: What a value of each kind looks like; the order decides where several would fit.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,127}[A-Za-z]{2,24}",
    "secret": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}+\.){3}[0-9]{1,3}+(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/])(?:19|20)[0-9]{2}/[0-9]{1,2}/[0-9]{1,2}(?![0-9/])|(?<![0-9./])[0-9]{1,2}(?<sep>[./])[0-9]{1,2}\k<sep>(?:19|20)[0-9]{2}(?![0-9])",
    "phone": r"\+[0-9]{1,3}+[ .-]?+\([0-9]{2,4}\)[ .-]?+[0-9]{3}[ .-]?+[0-9]{4}(?![0-9])|\+1[ .-]?+[0-9]{3}[ .-]?+[0-9]{3}[ .-]?+[0-9]{4}(?![0-9])|\([0-9]{3}\)[ .-]?+[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9+.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z+])\+[1-9](?:[ .-]?+\(?+[0-9]\)?+){7,14}+(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}(?<gap>[ -])[0-9]{4}\k<gap>[0-9]{4}\k<gap>[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
#: Passes over what the passes before left; a card written in its usual way goes before a phone number that would take part of it.
_PASSES = [("email", "secret", "ip", "date"), ("card",), ("phone",)]
#: Where a card may stand among other numbers: groups of digits, one sign apart.
_RUN = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+"
_CARD_SIZES = range(19, 12, -1)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; within a lambda Spark would compute it at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits that a check digit follows."""

    def add(state, c):
        d = c.cast("int") * F.when(state["i"] % 2 == 1, 2).otherwise(1)
        more = F.when(d > 9, d - 9).otherwise(d)
        return F.struct((state["total"] + more).alias("total"), (state["i"] + 1).alias("i"))

    start = F.struct(F.lit(0).alias("total"), F.lit(1).alias("i"))
    return F.aggregate(_chars(F.reverse(digits)), start, add, lambda state: state["total"])


def _luhn_ok(value: Column) -> Column:

    def ok(digits: Column) -> Column:
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)
        return (_luhn_sum(body) + F.right(digits, F.lit(1)).cast("int")) % 10 == 0

    return _let(_digits(value), ok)


def feistel(values: Column, radices: Column, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """Permutes rows of digits; ``values[i]`` is below ``radices[i]``, both are arrays of int."""

    def halves(x: Column) -> Column:
        cut = (F.size(x) / 2).cast("int")
        return F.struct(F.slice(x, 1, cut).alias("a"), F.slice(x, cut + 1, F.size(x) - cut).alias("b"))

    def shifted(half: Column, limits: Column, other: Column, turn: Column) -> Column:
        said = F.concat_ws(",", F.lit(f"{key}|{kind}"), turn.cast("string"), F.array_join(other.cast("array<string>"), "."), F.lit("#"))

        def shift(said: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                # 48 bits of the digest: what a radix of 4297 leaves uneven is below one in 10^10
                word = F.conv(F.substring(F.sha2(F.concat(said, i.cast("string")), 256), 1, 12), 16, 10).cast("bigint")
                return F.pmod(x + word, F.get(limits, i)).cast("int")

            return F.transform(half, one)

        return _let(said, shift)

    def permuted(limits: Column) -> Column:
        def turned(state: Column, turn: Column) -> Column:
            even = F.struct(shifted(state["a"], limits["a"], state["b"], turn).alias("a"), state["b"].alias("b"))
            odd = F.struct(state["a"].alias("a"), shifted(state["b"], limits["b"], state["a"], turn).alias("b"))
            return F.when(turn % 2 == 0, even).otherwise(odd)

        turns = F.array(*(F.lit(k) for k in range(rounds)))
        return F.aggregate(turns, _let(values, halves), turned, lambda state: F.concat(state["a"], state["b"]))

    return _let(_let(radices, halves), permuted)


def _chars(value: Column) -> Column:
    return F.split(value, "")


def _permuted(value: Column, key: str, kind: str, alphabets: list[str]) -> Column:
    """The value with the characters of the alphabets permuted; all others have radix 1 and stay."""

    def of(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for a in alphabets:
            out = F.when(F.instr(F.lit(a), c) > 0, F.lit(a)).otherwise(out)
        return out

    def moved(chars: Column) -> Column:
        values = F.transform(chars, lambda c: F.coalesce(F.instr(of(c), c) - 1, F.lit(0)))
        radices = F.transform(chars, lambda c: F.coalesce(F.length(of(c)), F.lit(1)))
        new = feistel(values, radices, key, kind)
        return F.array_join(F.zip_with(chars, new, lambda c, v: F.coalesce(F.substring(of(c), v + 1, F.lit(1)), c)), "")

    return _let(_chars(value), moved)


def _email(value: Column, key: str) -> Column:
    at = F.instr(value, "@")
    return F.concat(_permuted(F.substring(value, F.lit(1), at - 1), key, "email", [_LOWER, _UPPER, _DIGITS]), F.substring(value, at, F.length(value)))


def _secret(value: Column, key: str) -> Column:
    # in mixed case every digit is one of both cases' digits
    of = lambda letters: _permuted(value, key, "secret", [_DIGITS + letters])
    upper, lower = value.rlike("[A-F]"), value.rlike("[a-f]")
    return F.when(upper & lower, of("abcdefABCDEF")).when(upper, of("ABCDEF")).otherwise(of("abcdef"))


def _ip(value: Column, key: str) -> Column:
    def moved(octets: Column) -> Column:
        new = feistel(octets, F.array(*[F.lit(256)] * 4), key, "ip")
        return F.when(F.forall(octets, lambda x: x < 256), F.array_join(new.cast("array<string>"), "."))

    return _let(F.transform(F.split(value, r"\."), lambda x: x.cast("int")), moved)


#: A form with another separator must not be parsed with this one; where month and day could both stand first, the month does.
_DATE_FORMS = [("-", "yyyy-MM-dd"), (".", "dd.MM.yyyy"), (".", "d.M.yyyy"), *(("/", x) for x in ("MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d"))]


def _date(value: Column, key: str) -> Column:
    a, b = _DATE_RADICES
    first = F.lit(_FIRST_DAY).cast("date")

    def read(sign: str, form: str) -> Column:
        day = F.datediff(F.try_to_timestamp(F.when(F.instr(value, sign) > 0, value), F.lit(form)).cast("date"), first)
        return _let(day, lambda x: F.when(x.isNotNull(), F.struct(x.alias("day"), F.lit(form).alias("form"))))

    def shown(digits: Column, form: Column) -> Column:
        return F.call_function("date_format", F.date_add(first, F.get(digits, F.lit(1)) * a + F.get(digits, F.lit(0))), form)

    def moved(found: Column) -> Column:
        new = feistel(F.array(F.pmod(found["day"], F.lit(a)), (found["day"] / a).cast("int")), F.array(F.lit(a), F.lit(b)), key, "date")
        return F.when(found.isNotNull(), _let(new, lambda digits: shown(digits, found["form"])))

    return _let(F.coalesce(*(read(*x) for x in _DATE_FORMS)), moved)


def _phone(value: Column, key: str) -> Column:
    country = F.regexp_extract(value, r"^\+(?:[17]|[0-9]{1,3})", 0)
    return _let(country, lambda c: F.concat(c, _permuted(F.substring(value, F.length(c) + 1, F.length(value)), key, "phone", [_DIGITS])))


def _card(value: Column, key: str) -> Column:
    def checked(body: Column) -> Column:
        return F.concat(body, F.pmod(10 - _luhn_sum(_digits(body)) % 10, F.lit(10)).cast("string"))

    body = _permuted(F.substring(value, F.lit(1), F.length(value) - 1), key, "card", [_DIGITS])
    return F.when(_luhn_ok(value), _let(body, checked))


_NEW = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "phone": _phone, "card": _card}


def _judged(value: Column, kinds: tuple[str, ...], key: str) -> Column:
    """The pseudonym of a value of one of the kinds, null where it fails its validation."""

    def kind_of(value: Column) -> Column:
        out = F.lit(kinds[-1])
        for kind in reversed(kinds[:-1]):
            out = F.when(value.rlike(f"^(?:{KINDS[kind]})$"), F.lit(kind)).otherwise(out)
        return out

    def of_kind(kind: Column) -> Column:
        new = F.lit(None).cast("string")
        for name in kinds:
            new = F.when(kind == name, _NEW[name](value, key)).otherwise(new)
        return new

    return _let(kind_of(value), of_kind)


def _segment(text: Column, new: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (F.lit(None).cast("string") if new is None else new).alias("new"))


def _cut(text: Column, pattern: str, judge: Callable[[Column], Column]) -> Column:
    """The text as segments (text, new); what fails its validation stays in the text around it."""

    def of(found: Column) -> Column:
        bits = F.flatten(F.zip_with(found["pieces"], found["values"], lambda p, v: F.array(p, F.coalesce(v, F.lit("")))))
        n = F.size(found["values"])
        good = F.filter(F.transform(found["news"], lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())

        def joined(x: Column) -> Column:
            def segments(before: Column, at: Column) -> Column:
                left = _segment(F.array_join(F.slice(x["bits"], 2 * before + 3, 2 * (at - before) - 1), ""))
                return F.when(at < n, F.array(left, _segment(F.get(found["values"], at), F.get(found["news"], at)))).otherwise(F.array(left))

            return F.flatten(F.zip_with(F.concat(F.array(F.lit(-1)), x["good"]), F.concat(x["good"], F.array(n)), segments))

        return _let(F.struct(bits.alias("bits"), good.alias("good")), joined)

    def with_news(values: Column) -> Column:
        return _let(F.struct(F.split(text, pattern, -1).alias("pieces"), values.alias("values"), F.transform(values, judge).alias("news")), of)

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_news)).otherwise(F.array(_segment(text)))


def _cards_among(run: Column, key: str) -> Column:
    """A run of digit groups as segments: at each group the longest card of whole groups, from the left."""

    def card_at(start: Column) -> Column:
        def of(rest: Column) -> Column:
            sizes = [F.regexp_extract(rest, f"^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])", 0) for n in _CARD_SIZES]
            return F.get(F.filter(F.array(*sizes), lambda x: (x != "") & _luhn_ok(F.when(x != "", x))), F.lit(0))

        # 19 digits and 18 signs, and one character more
        return _let(F.substring(run, start, F.lit(38)), of)

    def starts() -> Column:
        groups = F.split(run, "[ -]")
        ends = F.transform(groups, lambda g: F.length(g) + 1)

        def add(state: Column, size: Column) -> Column:
            def next_(card: Column) -> Column:
                ok = card.isNotNull()
                hit = F.struct(state["at"].alias("at"), card.alias("card"))
                return F.struct(
                    (state["at"] + size).alias("at"),
                    F.when(ok, state["at"] + F.length(card)).otherwise(state["free"]).alias("free"),
                    F.when(ok, F.concat(state["hits"], F.array(hit))).otherwise(state["hits"]).alias("hits"),
                )

            return _let(F.when(state["at"] >= state["free"], card_at(state["at"])), next_)

        start = F.struct(F.lit(1).alias("at"), F.lit(1).alias("free"), F.array().cast("array<struct<at:int,card:string>>").alias("hits"))
        return F.aggregate(ends, start, add, lambda state: state["hits"])

    def segments(hits: Column) -> Column:
        def between(i: Column, hit: Column) -> Column:
            last = F.get(hits, i - 1)
            begin = F.when(i > 0, last["at"] + F.length(last["card"])).otherwise(F.lit(1))
            left = _segment(F.substring(run, begin, F.coalesce(hit["at"], F.length(run) + 1) - begin))
            return F.when(hit.isNotNull(), F.array(left, _segment(hit["card"], _card(hit["card"], key)))).otherwise(F.array(left))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(hits)), lambda i: between(i, F.get(hits, i))))

    return _let(starts(), segments)


def _cut_runs(text: Column, key: str) -> Column:
    def of(found: Column) -> Column:
        runs = F.zip_with(found["pieces"], found["runs"], lambda p, r: F.concat(F.array(_segment(p)), F.when(r.isNotNull(), _cards_among(r, key)).otherwise(F.array(_segment(F.lit(""))))))
        return F.flatten(runs)

    found = F.struct(F.split(text, _RUN, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)).alias("runs"))
    return F.when(text.rlike(_RUN), _let(found, of)).otherwise(F.array(_segment(text)))


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with its personal values replaced in the text, and ``n_values``, the number replaced.

    Kinds: e-mail addresses (the part before @; domains of up to 128 labels, more than any has), hexadecimal secrets of 32 digits or more, in either or both cases, IPv4
    addresses, dates from 1900 to 2099, phone numbers (after the country), card numbers of 13
    to 19 digits (the check digit follows), beside other numbers too. What fails its validation is no value and stays. A
    null text stays null with no values; an empty one stays empty. Repeated rows are rewritten
    alike. All columns stay, but for one named ``n_values``.
    """
    text = F.col(text_col).cast("string")
    out = docs.withColumn("_glotta_found", F.array(_segment(text)))

    def over(cut: Callable[[Column], Column]) -> Column:
        return F.flatten(F.transform("_glotta_found", lambda x: F.when(x["new"].isNotNull(), F.array(x)).otherwise(cut(x["text"]))))

    for kinds in _PASSES:
        pattern = "|".join(f"(?:{KINDS[x]})" for x in kinds)
        out = out.withColumn("_glotta_found", over(lambda x: _cut(x, pattern, lambda value: _judged(value, kinds, key))))  # noqa: B023
    out = out.withColumn("_glotta_found", over(lambda x: _cut_runs(x, key)))
    # every value has an @, a digit or many hexadecimal letters; most texts have none, and skip the passes
    has = text.contains("@") | text.rlike("[0-9]") | text.rlike("[a-fA-F]{32}")
    rewritten = F.array_join(F.transform("_glotta_found", lambda x: F.coalesce(x["new"], x["text"])), "")
    out = out.withColumns(
        {
            text_col: F.when(has, rewritten).otherwise(text),
            "n_values": F.when(has, F.size(F.filter("_glotta_found", lambda x: x["new"].isNotNull()))).otherwise(F.lit(0)),
        }
    )
    return out.drop("_glotta_found")
