"""Language identification with more languages than a 64-bit word has bits."""

import random

from glotta.llm import langid


def test_seventy_languages(spark):
    rng = random.Random(1)
    words = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(30)] for k in range(70)}
    docs = spark.createDataFrame([(lang, " ".join(w)) for lang, w in words.items()], "lang string, text string")
    model = langid.fit(docs)
    assert len(model.languages) == 70
    assert all(r["lang_pred"] == r["lang"] for r in langid.predict(docs, model).collect())
