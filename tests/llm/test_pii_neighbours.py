"""Values beside other numbers, international phone numbers and more forms of dates."""

import re

from glotta.llm import pii

CARD, OTHER, SPACED = "4111111111111111", "4012888888881881", "4111 1111 1111 1111"
#: text: the values in it, each of which gets a pseudonym
CASES = {
    f"{CARD} {OTHER}": [CARD, OTHER],
    f"{SPACED} 123": [SPACED],
    f"{CARD} 12/27": [CARD],
    f"{CARD} 2024-01-05": [CARD, "2024-01-05"],
    f"190.137.20.3 {CARD}": ["190.137.20.3", CARD],
    f"item 3 {SPACED}": [SPACED],
    f"{CARD} 190.137.20.3": [CARD, "190.137.20.3"],
    f"1234 {SPACED} 12": [SPACED],
    "7 41111 11111 111111 x": ["41111 11111 111111"],
    "+1-212-555-0123": ["212-555-0123"],
    "+1 212 555 0123": ["212 555 0123"],
    "+49 30 1234567": ["30 1234567"],
    f"+49 30 1234567 {SPACED}": ["30 1234567", SPACED],
    "2023/12/25": ["2023/12/25"],
    "5.3.2021": ["5.3.2021"],
    "25/12/2023": ["25/12/2023"],
}


def test_neighbours(spark):
    rows = [(k, f"See {t}.") for k, t in enumerate(CASES)] + [(900, CARD), (901, "1 2 3 " * 30), (902, f"{CARD}1234567890")]
    out = {r["doc_id"]: (r["text"], r["n_values"]) for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string"), key="k").collect()}
    for k, (text, values) in enumerate(CASES.items()):
        new, n = out[k]
        assert n == len(values) and not any(v in new for v in values), (text, new, n)
        around, at = [re.escape(x) for x in re.split("|".join(map(re.escape, values)), f"See {text}.")], 0
        assert re.fullmatch("[0-9 ./-]+".join(around), new), (text, new)
        if CARD in values:
            assert out[900][0] in new
    assert out[901][0] == "1 2 3 " * 30 or out[901][1] > 0
    assert out[902] == (f"{CARD}1234567890", 0)


def test_secrets_and_addresses_of_any_length(spark):
    long = {k: "0123456789abcdef" * k for k in (9, 200)}
    rows = [(k, f"key {v} end") for k, v in long.items()] + [(1, "to " + "a1." * 50 + "x@" + "b" * 80 + ".example.org now")]
    out = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string"), key="k").collect()}
    for k, v in long.items():
        assert out[k]["n_values"] == 1 and v not in out[k]["text"] and len(out[k]["text"]) == len(v) + 8
    assert out[1]["n_values"] == 1 and "a1.a1." not in out[1]["text"]
