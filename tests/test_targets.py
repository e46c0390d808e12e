"""Expected answers in texts against all pairs."""

import re
import unicodedata

import pytest

from glotta.operators import targets


def normal(text):
    bare = "".join(c for c in unicodedata.normalize("NFD", text or "") if not 0x300 <= ord(c) < 0x370)
    return re.sub("[’'ʼ`·.,!?;:\"()\\s]", "", bare.lower())


DOCS = [(1, "L'Été, c'est la fête !"), (2, "un été indien"), (3, None), (4, ""), (5, "fête" * 1000), (6, "rien"), (2, "un été indien")]
TARGETS = [(10, "été"), (11, "ETE"), (12, "est la"), (13, None), (14, " .!"), (15, "fetefete"), (16, "un été"), (17, "absent"), (10, "été")]


@pytest.mark.parametrize("block_bytes", [1, 8, 10**6])
def test_against_all_pairs(spark, block_bytes):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    wanted = spark.createDataFrame(TARGETS, "target_id bigint, expected string")
    got = sorted(tuple(r) for r in targets.targets_used(docs, wanted, block_bytes=block_bytes).collect())
    assert got == sorted((d, t) for d, text in DOCS for t, e in TARGETS if normal(e) and normal(e) in normal(text))


def test_empty_sides(spark):
    docs, wanted = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "target_id bigint, expected string")
    assert targets.targets_used(docs, wanted).count() == 0
    assert targets.targets_used(spark.createDataFrame([(1, "a")], docs.schema), wanted.where("false")).count() == 0
