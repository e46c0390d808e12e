"""Outside calls: slow, failing and throttled clients, and what their answers hold."""

import json
import time

import pytest
from pyspark.sql import functions as F

from glotta.operators import calls, gloss

QUICK = calls.Terms(deadline=0.4, pause=0.1, at_once=3)


def ask(spark, prompts, client, terms=QUICK):
    asked = spark.createDataFrame(list(enumerate(prompts)), "doc_id bigint, prompt string").coalesce(1)
    return {r["doc_id"]: (r["reply"], r["error"], r["tries"]) for r in calls.called(asked, client, terms=terms).collect()}


def slow_or_failing(prompt):
    if prompt == "slow":
        time.sleep(3)
    if prompt == "bad":
        raise ValueError("busy")
    return prompt.upper()


def test_slow_and_failing_calls_are_told_and_others_go_on(spark):
    got = ask(spark, ["a", "slow", "bad", None, "b"], slow_or_failing)
    assert got == {0: ("A", None, 1), 1: (None, "TimeoutError: no answer within 0.4 s", 2), 2: (None, "ValueError: busy", 2), 3: (None, "no prompt", 0), 4: ("B", None, 1)}
    assert ask(spark, ["a"], None) == {0: (None, "no client", 0)} and ask(spark, [], slow_or_failing) == {}


def test_another_try_comes_after_a_pause():
    times = []

    def fails_once(prompt):
        times.append(time.monotonic())
        if len(times) == 1:
            raise OSError("down")
        return "up"

    assert calls.answered(fails_once, "x", calls.Terms(pause=0.2), calls.Bucket(None)) == ("up", None, 2)
    assert times[1] - times[0] >= 0.2


def test_no_more_calls_at_once_than_agreed(spark):
    under_way = {"n": 0}  # each task has its own

    def counting(prompt):
        under_way["n"] += 1
        seen = under_way["n"]
        time.sleep(0.05)
        under_way["n"] -= 1
        return str(seen)

    for most in (1, 3):
        got = ask(spark, ["x"] * 20, counting, calls.Terms(at_once=most))
        assert max(int(r) for r, _, _ in got.values()) == most


def test_bucket_keeps_the_rate():
    bucket, began = calls.Bucket(20, burst=3), time.monotonic()
    for _ in range(9):
        bucket.take()
    assert 0.25 <= time.monotonic() - began < 1.5
    free = calls.Bucket(None)
    for _ in range(10_000):
        free.take()


@pytest.mark.parametrize("body,text", [
    (json.dumps({"choices": [{"message": {"content": "chat: cat"}}]}), "chat: cat"), (json.dumps({"choices": []}), ""), ("plain", "plain"), (None, None), ("{broken", "{broken"),
    (json.dumps({"content": [{"type": "text", "text": "a"}, {"type": "tool", "text": "no"}, {"type": "text", "text": "b"}]}), "ab"),
])
def test_envelopes(spark, body, text):
    assert spark.createDataFrame([(body,)], "b string").select(calls.reply_text(F.col("b")).alias("t")).first()["t"] == text


def test_pages_are_no_replies(spark):
    bodies = [" <!DOCTYPE html>", "x <html lang=fr>", "error by Cloudflare", "cloudflared is a word", "a" * 500 + " cloudflare", "chat"]
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").select(calls.is_page(F.col("b")).alias("p")).collect()
    assert [r["p"] for r in rows] == [True, True, True, False, False, False]


def test_replies_say_what_is_wrong(spark):
    asked = spark.createDataFrame([(k, ["chat"], p) for k, p in enumerate(["ok", "page", "empty", "bad"])], "doc_id bigint, lemmas array<string>, prompt string")
    client = lambda p: {"ok": json.dumps({"choices": [{"message": {"content": "1. chat: cat"}}]}), "page": "<html>", "empty": " "}[p]
    found = {r["doc_id"]: r["error"] for r in gloss.replies(asked, client, QUICK).collect()}
    assert found == {0: None, 1: "a page instead of a reply", 2: "empty reply", 3: "KeyError: 'bad'"}
    assert [tuple(r) for r in gloss.glossed(asked, client, QUICK).collect()] == [(0, "chat", "cat")]
