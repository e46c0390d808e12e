"""Calls of an outside service from tasks: bounded in number, time and rate, with what went wrong as a column."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Seconds until a call is given up and before it is tried again, tries.
DEADLINE, PAUSE, TRIES = 30.0, 1.5, 2


@dataclass(frozen=True)
class Terms:
    """How a task may call: seconds a call, seconds before another try, tries, calls at once, and calls a second (None: any) with so many saved up."""

    deadline: float = DEADLINE
    pause: float = PAUSE
    tries: int = TRIES
    at_once: int = 4
    rate: float | None = None
    burst: int = 1


class Bucket:
    """Tokens that come at a rate, up to a number; ``take`` waits for one. Each taker has its place, so none waits for ever."""

    def __init__(self, rate: float | None, burst: int = 1) -> None:
        self.rate, self.burst, self.lock = rate, burst, threading.Lock()
        self.next = time.monotonic() - (burst / rate if rate else 0)

    def take(self) -> None:
        if not self.rate:
            return
        with self.lock:
            now = time.monotonic()
            # the tokens of idle time are kept up to the burst
            self.next = max(self.next, now - self.burst / self.rate) + 1 / self.rate
            wait = self.next - now
        if wait > 0:
            time.sleep(wait)


def within(seconds: float, call: Callable[[str], str], prompt: str) -> str:
    """The call's answer; a ``TimeoutError`` if it has none in time. The call itself can't be stopped, so its thread is left to end."""
    got: list = []

    def run() -> None:
        try:
            got.append((call(prompt), None))
        except Exception as error:
            got.append((None, error))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not got:
        raise TimeoutError(f"no answer within {seconds:g} s")
    answer, error = got[0]
    if error:
        raise error
    return answer


def answered(call: Callable[[str], str], prompt: str, terms: Terms, bucket: Bucket) -> tuple[str | None, str | None, int]:
    """(reply, error, tries) of one prompt."""
    said = None
    for k in range(terms.tries):
        if k:
            time.sleep(terms.pause)
        bucket.take()
        try:
            return within(terms.deadline, call, prompt), None, k + 1
        except Exception as error:  # whatever the service raises is told, and the next prompt goes on
            said = f"{type(error).__name__}: {error}"
    return None, said, terms.tries


def called(asked: DataFrame, client: Callable[[str], str] | None, *, terms: Terms = Terms(), prompt_col: str = "prompt") -> DataFrame:
    """``asked`` with reply, error and tries; without a client every row has the error ``no client``.

    ``client`` takes a prompt and returns the reply; it runs on the executors. A task has
    ``terms.at_once`` calls under way, keeps the rate by itself, and holds one batch of rows. A row whose prompt is null isn't called.
    A task that is run again calls again.
    """
    new = [T.StructField("reply", T.StringType()), T.StructField("error", T.StringType()), T.StructField("tries", T.IntegerType())]
    kept = [f for f in asked.schema if f.name not in {x.name for x in new}]
    schema = T.StructType([*kept, *new])

    def one(prompt: str | None, bucket: Bucket) -> tuple[str | None, str | None, int]:
        if client is None or prompt is None:
            return None, "no client" if client is None else "no prompt", 0
        return answered(client, prompt, terms, bucket)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket(terms.rate, terms.burst)
        with ThreadPoolExecutor(terms.at_once) as pool:
            for batch in batches:
                at = batch.schema.get_field_index
                rows = list(pool.map(lambda p: one(p, bucket), batch.column(at(prompt_col)).to_pylist()))
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(at(f.name)) for f in kept), *made], names=[f.name for f in schema])

    return asked.mapInArrow(over, schema)


def reply_text(body: Column) -> Column:
    """The text in a service's answer: the first choice's message, or all parts of type text; a body that is no such document is the text itself."""
    parts = F.from_json(F.get_json_object(body, "$.content"), "array<struct<type:string,text:string>>")
    texts = F.array_join(F.transform(F.filter(parts, lambda x: x["type"] == "text"), lambda x: F.coalesce(x["text"], F.lit(""))), "")
    first = F.coalesce(F.get_json_object(body, "$.choices[0].message.content"), F.when(F.get_json_object(body, "$.choices").isNotNull(), F.lit("")))
    return F.coalesce(first, F.when(F.get_json_object(body, "$.content").isNotNull(), texts), body)


def is_page(body: Column) -> Column:
    """Whether an answer is a web page, such as a service that is busy or blocked gives."""
    head = body.rlike(r"(?i)\A\s*<(!doctype|html|!--)") | body.rlike(r"(?i)<html[\s>]")
    return head | F.substring(body, 1, 400).rlike(r"(?i)(?<![0-9A-Za-z_])cloudflare(?![0-9A-Za-z_])")
