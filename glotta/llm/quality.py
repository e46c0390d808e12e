"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a row of features; each feature is cut into quantile bins. Training goes
round the features in turn and fits a shallow tree to the logistic gradient over one feature's
bins, which adds to that feature's lookup table. Then the pairs whose joint bins explain most
of what is left get two-dimensional tables in the same way. A score is the sum of the looked-up
values, so scoring a batch is one addition of an indexed table per feature and pair.

Training reads a bounded sample of the labelled rows (``most_rows``, taken by the hash of the
id); the model is a few thousand numbers. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotta.llm.common import broadcast_value, id_crc, map_texts

FEATURES = [
    "log_words", "log_bytes", "word_bytes", "upper", "digit", "symbol", "bang", "pipe", "stop", "beyond_ascii", "space",
    "distinct_words", "top_word", "same_as_before", "longest_word", "line_words", "distinct_lines", "ended_lines", "first_upper",
]


def _share_of(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


#: One column per feature that is a share of a text's bytes.
BYTE_CLASSES = np.stack([
    _share_of(bytes(range(65, 91))), _share_of(b"0123456789"), _share_of(b"#$%&*@^~<>{}[]\\=+_"), _share_of(b"!?"),
    _share_of(b"|"), _share_of(b".,;:"), _share_of(bytes(range(128, 256))), _share_of(b" \t\r\n\x0b\x0c"),
], axis=1)


def features(text: bytes) -> np.ndarray:
    """The features of a whole text; an empty one has zeros."""
    out = np.zeros(len(FEATURES))
    words = text.split()
    if not words:
        out[1] = np.log1p(len(text))
        return out
    n = len(words)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[0], out[1], out[2] = np.log1p(n), np.log1p(len(text)), len(text) / n
    out[3:11] = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ BYTE_CLASSES / len(text)
    out[11], out[12] = len(counts) / n, max(counts.values()) / n
    out[13] = sum(a == b for a, b in zip(words, words[1:])) / n
    out[14] = np.log1p(max(map(len, counts)))
    out[15], out[16] = n / len(lines), len(set(lines)) / len(lines)
    out[17] = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines)
    out[18] = sum(x[:1].isupper() for x in words) / n
    return out


@dataclass
class AdditiveModel:
    """cuts: bin borders of each feature; tables: a value for each bin; pairs: (i, j, table)."""

    cuts: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            out += table[np.searchsorted(self.cuts[k], x[:, k], "right")]
        for i, j, table in self.pairs:
            out += table[np.searchsorted(self.pair_cuts[i], x[:, i], "right"), np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The values of a tree of up to ``leaves`` leaves over ordered bins with gradient and curvature sums."""
    edges = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(edges) <= leaves:
        best = (1e-9, None)
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                left_g, left_h, all_g, all_h = cg[at] - cg[a], ch[at] - ch[a], cg[b] - cg[a], ch[b] - ch[a]
                won = _gain(left_g, left_h, ridge) + _gain(all_g - left_g, all_h - left_h, ridge) - _gain(all_g, all_h, ridge)
                k = int(won.argmax())
                best = max(best, (float(won[k]), int(at[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a two-dimensional table into four leaves: what it gains, and its values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    all_g, all_h = cg[-1, -1], ch[-1, -1]
    parts = [
        (cg, ch), (cg[-1:, :] - cg, ch[-1:, :] - ch), (cg[:, -1:] - cg, ch[:, -1:] - ch),
        (all_g - cg[-1:, :] - cg[:, -1:] + cg, all_h - ch[-1:, :] - ch[:, -1:] + ch),
    ]
    won = sum(_gain(a, np.maximum(b, 0), ridge) for a, b in parts) - _gain(all_g, all_h, ridge)
    i, j = np.unravel_index(won.argmax(), won.shape)
    out = np.zeros(g.shape)
    for (a, b), rows, cols in zip(parts, (slice(0, i + 1), slice(i + 1, None), slice(0, i + 1), slice(i + 1, None)), (slice(0, j + 1), slice(0, j + 1), slice(j + 1, None), slice(j + 1, None)), strict=True):
        out[rows, cols] = a[i, j] / (max(b[i, j], 0) + ridge)
    return float(won[i, j]), out


def train(x: np.ndarray, y: np.ndarray, *, bins: int = 32, pair_bins: int = 8, rounds: int = 120, rate: float = 0.15, leaves: int = 3, pairs: int = 8, pair_rounds: int = 40, ridge: float = 2.0) -> AdditiveModel:
    """Fit by cyclic boosting; without labelled rows every score is one half, with one class its smoothed share."""
    n, k = x.shape
    model = AdditiveModel([_cuts(x[:, i], bins) if n else np.empty(0) for i in range(k)])
    model.pair_cuts = [_cuts(x[:, i], pair_bins) if n else np.empty(0) for i in range(k)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    share = (y.sum() + 1) / (n + 2)
    model.base = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return model
    at = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(model.cuts)]
    margin = np.full(n, model.base)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i in range(k):
            size = len(model.tables[i])
            if size > 1:
                g, h = slopes()
                step = rate * _tree(np.bincount(at[i], g, size), np.bincount(at[i], h, size), leaves, ridge)
                model.tables[i] += step
                margin += step[at[i]]
    wide = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(model.pair_cuts)]

    def joint(i, j):
        g, h = slopes()
        shape = len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1
        flat = wide[i] * shape[1] + wide[j]
        size = shape[0] * shape[1]
        return flat, np.bincount(flat, g, size).reshape(shape), np.bincount(flat, h, size).reshape(shape)

    ranked = sorted(((_quadrants(*joint(i, j)[1:], ridge)[0], i, j) for i in range(k) for j in range(i)), reverse=True)[:pairs]
    model.pairs = [(i, j, np.zeros((len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1))) for _, i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            flat, g, h = joint(i, j)
            step = rate * _quadrants(g, h, ridge)[1]
            table += step
            margin += step.ravel()[flat]
    return model


def with_features(docs: DataFrame, name: str = "features", text_col: str = "text") -> DataFrame:
    def each(texts: list[bytes]) -> list[pa.Array]:
        rows = np.array([features(x) for x in texts]).reshape(-1, len(FEATURES))
        return [pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))]

    return map_texts(docs, [T.StructField(name, T.ArrayType(T.DoubleType()))], each, text_col)


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", held_out_of: int = 5, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", **options) -> AdditiveModel:
    """Learn from the labelled documents whose crc32(id as text) mod ``held_out_of`` is not 0.

    Of more than ``most_rows`` such labels, those with the smallest hash of the id are taken.
    Rows with a null id or label teach nothing; an id with several labels counts by their mean,
    rounded up; a document said twice teaches once.
    """
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y"))
        .where("doc_id is not null and y is not null")
        .where(id_crc("doc_id", held_out_of) != 0)
        .groupBy("doc_id")
        .agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    )
    # at most most_rows ids and labels, a bounded broadcast
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = with_features(named.join(F.broadcast(sample), "doc_id")).groupBy("doc_id").agg(F.first("features").alias("features"), F.first("y").alias("y")).toPandas()
    rows = rows.sort_values("doc_id")
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    return train(x, rows["y"].to_numpy(float), **options)


def score(docs: DataFrame, model: AdditiveModel, *, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the probability of label 1 of every whole text, of any length; null counts as empty.

    All columns stay, but for one named ``name``, which is replaced. Repeated rows get the same
    score; an empty table gives an empty result; without labels every score is one half.
    """
    shared = broadcast_value(docs, model)

    def each(texts: list[bytes]) -> list[pa.Array]:
        rows = np.array([features(x) for x in texts]).reshape(-1, len(FEATURES))
        return [pa.array(shared.value.score(rows), pa.float64())]

    return map_texts(docs, [T.StructField(name, T.DoubleType())], each, text_col)


def keep_good(docs: DataFrame, model: AdditiveModel, *, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` whose score is at least ``least``; all columns stay."""
    return score(docs, model, name="_glotta_score", text_col=text_col).where(F.col("_glotta_score") >= least).select(docs.columns)
