"""URL filters: rules for hosts and paths first, then a logistic regression on character n-grams.

A URL's host and path become counts of hashed character n-grams (host and path n-grams are kept
apart). The weights are learned from a small labelled table of URLs by full-batch gradient
descent with a ridge; scoring adds the weights of a URL's n-grams. Rules are a small table, so
the longest rule that fits is found by column expressions, without a join.
"""

from __future__ import annotations

import csv
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotta.llm.common import broadcast_value

BUCKETS = 1 << 16
SIZES = (3, 4, 5)

#: Invented URLs (url, block: 1 or 0), one a line; hosts end in reserved names.
LABELLED = Path(__file__).with_name("labelled_urls.csv")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ngrams(host: str, path: str) -> list[int]:
    """The bucket of every character n-gram of host and path, repeats included."""
    out = []
    for tag, part in ((b"h", f"^{host}$".encode()), (b"p", f"^{path}$".encode())):
        for n in SIZES:
            out += [zlib.crc32(tag + part[i : i + n]) % BUCKETS for i in range(len(part) - n + 1)]
    return out


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        """The probability that the URL is to be blocked; n-grams without weight count for nothing."""
        grams = ngrams(host, path)
        margin = self.bias + (self.weights[grams].sum() / np.sqrt(len(grams)) if grams else 0.0)
        return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


def _parts(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    path = rest[cut:]
    return rest[:cut].lower(), path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]


def read_labelled(path: str | Path = LABELLED) -> list[tuple[str, int]]:
    """The rows (url, block) of a labelled file, which has a line of names."""
    with open(path, encoding="utf-8", newline="") as file:
        return [(r["url"], int(r["block"])) for r in csv.DictReader(file)]


def train(labelled: Iterable[tuple[str, int]] | None = None, *, block_share: float = 0.35, rounds: int = 600, rate: float = 4.0, ridge: float = 1e-4) -> UrlModel:
    """Weights from (url, 1 to block or 0 to allow), by default those of the labelled file; without rows every score is one half.

    ``block_share`` is the share of URLs to block that the two kinds are weighed to.
    """
    labelled = read_labelled() if labelled is None else labelled
    rows = [(ngrams(*_parts(u)), y) for u, y in labelled]
    model = UrlModel(np.zeros(BUCKETS), 0.0)
    if not rows:
        return model
    at = np.concatenate([np.array(g, np.int64) for g, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(g) for g, _ in rows])
    size = np.array([1 / np.sqrt(max(1, len(g))) for g, _ in rows])
    y = np.array([k for _, k in rows], float)
    weight = np.where(y > 0, block_share / max(1.0, y.sum()), (1 - block_share) / max(1.0, (1 - y).sum()))
    for _ in range(rounds):
        margin = model.bias + np.bincount(row, model.weights[at], len(rows)) * size
        slope = (y - 1 / (1 + np.exp(-margin))) * weight
        model.weights += rate * (np.bincount(at, (slope * size)[row], BUCKETS) - ridge * model.weights)
        model.bias += rate * slope.sum()
    return model


def judge(urls: DataFrame, rules: list[Rule], model: UrlModel, *, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """``urls`` with host, path, rule, verdict (allow or block) and url_score.

    A rule fits its host and all hosts below it, where the path starts with the rule's; of
    several the longest wins (host and path together; of equal length the first given). Where no
    rule fits, the model blocks from ``threshold`` on. A null URL, or one without ``://``, has
    an empty host and path, which no rule fits. URLs of any length are judged whole; an empty
    table gives an empty result. Repeated rows are judged alike; columns of ``urls`` that are
    named as a new one are replaced.
    """
    host, path = F.col("host"), F.col("path")
    ranked = sorted(rules, key=lambda r: -len(r.name))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ranked):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.name)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    url = F.col(url_col).cast("string")
    named = urls.withColumns({"_host": host_of(url), "_path": path_of(url)}).drop("host", "path").withColumnsRenamed({"_host": "host", "_path": "path"})
    kept = [x for x in named.schema if x.name != "url_score"]
    schema = T.StructType([*kept, T.StructField("url_score", T.DoubleType())])
    shared = broadcast_value(urls, model)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            at = batch.schema.get_field_index
            scores = pa.array([score(h, p) for h, p in zip(batch.column(at("host")).to_pylist(), batch.column(at("path")).to_pylist(), strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(at(x.name)) for x in kept), scores], names=schema.names)

    own = F.when(F.col("url_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return named.mapInArrow(over, schema).withColumns({"rule": rule, "verdict": F.coalesce(verdict, own)})
