"""Language identification with a bit-sliced Bloom filter of n-grams.

Training counts the words of each language, then the character n-grams of the distinct words,
weighted. An n-gram is put under a language where its rate is at least ``least_rate`` of that
language's n-grams and at least ``least_part`` of its highest rate in any language: strays of
other languages aren't a language's n-grams (both at zero leave every n-gram in). The filter is
an array of rows of 64-bit words, one bit for each language, whose bits tasks set for their n-grams;
the driver gets and broadcasts the filter, whose size has a bound. The AND of the rows at an n-gram's
hashes is the set of languages that contain it. A text's n-grams are counted for each language by
population counts of bit slices and corrected for the filter's false positives, whose rate for
a language follows from the share of its bits that are set.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotta.llm.common import broadcast_value, map_texts, materialise, noted_paths, release, text_bytes

WORDS = re.compile(r"[^\W\d_]+")
#: Sizes of the n-grams, in bytes; an n-gram and its size fit a 64-bit number.
SIZES = (3, 4, 5)
HASHES = 3
#: Slots of a filter; the most take 128 MB for each 64 languages.
FEWEST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 24
#: Tokens that are judged at a time.
SLICE = 500_000


def words_of(text: bytes) -> list[str]:
    """Runs of letters in lower case."""
    return WORDS.findall(text.decode("utf-8", "replace").lower())


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the words, each between two marks, as numbers; and which word each belongs to."""
    marked = np.frombuffer(f"_{'_'.join(words)}_".encode(), np.uint8)
    marks = np.concatenate([[0], np.cumsum(marked == ord("_"))])
    wide = marked.astype(np.uint64)
    grams, owners = [], []
    for n in SIZES:
        at = np.arange(max(0, len(marked) - n + 1))
        at = at[marks[at + n - 1] == marks[at + 1]]  # no mark inside
        packed = np.full(len(at), n, np.uint64)
        for k in range(n):
            packed = packed << np.uint64(8) | wide[at + k]
        grams.append(packed)
        owners.append(marks[at + 1] - 1)
    return np.concatenate(grams), np.concatenate(owners)


@dataclass
class LanguageFilter:
    languages: list[str]
    slots: np.ndarray  # rows of ceil(languages / 64) 64-bit words, a bit for each language

    def false_rate(self) -> np.ndarray:
        """The chance that an n-gram in no filter seems to be in a language's."""
        return np.array([self._bit(self.slots, k).mean() for k in range(len(self.languages))]) ** HASHES

    def _bit(self, masks: np.ndarray, k: int) -> np.ndarray:
        return (masks.reshape(len(masks), -1)[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)

    def places(self, grams: np.ndarray) -> np.ndarray:
        """HASHES slots of each n-gram, by double hashing."""
        h = grams * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        a, b = h >> np.uint64(33), h & np.uint64(0xFFFFFFFF) | np.uint64(1)
        return ((a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(len(self.slots))).astype(np.int64)

    def counts(self, words: list[str]) -> np.ndarray:
        """For each word the number of its n-grams, and of those in each language's filter.

        The masks of the n-grams are turned into one bit slice a language, in which every word
        starts at a byte of its own; a language's count is the population count of its slice.
        """
        grams, owners = ngrams(words)
        masks = np.bitwise_and.reduce(self.slots[self.places(grams)], axis=1)
        sizes = np.bincount(owners, minlength=len(words))
        ends = np.cumsum(-(-sizes // 8))
        starts = ends - -(-sizes // 8)
        order = np.argsort(owners, kind="stable")
        bits = np.empty(len(grams), np.int64)
        bits[order] = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts * 8, sizes)
        columns = [sizes]
        for k in range(len(self.languages)):
            plane = np.zeros(int(ends[-1]) * 8, np.uint8)
            plane[bits] = self._bit(masks, k)
            columns.append(np.add.reduceat(np.bitwise_count(np.packbits(plane)).astype(np.int64), starts))
        return np.column_stack(columns)

    def predict(self, texts: list[list[str]], false_rate: np.ndarray) -> list[tuple[str, float]]:
        """The language of each text, given as words, and its weight among all; ``und`` where there is no letter."""
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        flat = pa.array([w for x in texts for w in x], pa.string()).dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        counts = self.counts(distinct) if distinct else np.zeros((0, len(self.languages) + 1))
        sums = np.concatenate([np.zeros((1, counts.shape[1])), np.cumsum(counts[flat.indices.to_numpy()], axis=0)])
        ends = np.cumsum([0, *map(len, texts)])
        total = sums[ends[1:]] - sums[ends[:-1]]
        shares = np.clip((total[:, 1:] / np.maximum(total[:, :1], 1) - false_rate) / np.maximum(1 - false_rate, 1e-9), 0, 1)
        best = shares.argmax(1)
        # an own text has a share close to one, which others' texts share in part: weigh the gaps
        odds = np.exp((shares - shares.max(1, keepdims=True)) * 30)
        weight = 1 / odds.sum(1)
        lettered = [any(c.isalpha() for w in x for c in w) for x in texts]
        return [(self.languages[k], float(w)) if ok else ("und", 0.0) for k, w, ok in zip(best, weight, lettered, strict=True)]


def word_counts(docs: DataFrame, lang_col: str, text_col: str, held: int = 200_000) -> DataFrame:
    """(lang, word, n), summed over all rows; each task sums what it can hold before it sends it."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def sent():
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            for k in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + 50_000], strict=True)], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > held:
                yield from sent()
        yield from sent()

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), text_bytes(text_col).alias("text")).where("lang is not null")
    return rows.mapInArrow(over, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(gram, lang, n) of the n-grams of counted words."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, tuple[list[str], list[int]]] = {}
            for lang, word, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words, counts = by_lang.setdefault(lang, ([], []))
                words.append(word)
                counts.append(n)
            for lang, (words, counts) in by_lang.items():
                grams, owners = ngrams(words)
                distinct, place = np.unique(grams, return_inverse=True)
                sums = np.bincount(place, np.array(counts)[owners]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array([lang] * len(distinct)), pa.array(sums)], names=["gram", "lang", "n"])

    return words.select("lang", "word", "n").mapInArrow(over, "gram bigint, lang string, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n"))


def slot_masks(chosen: DataFrame, empty: LanguageFilter) -> DataFrame:
    """(slot, word, mask): the filter's rows of n-grams (gram, numbers of its languages), at most one for each word of a slot.

    Tasks hash their n-grams and join bits before they send them, so neither a task nor the driver
    gets more rows than the filter has words, however many n-grams there are.
    """
    wide = empty.slots.shape[1]
    sized = LanguageFilter(empty.languages, np.broadcast_to(np.zeros(1, np.uint64), empty.slots.shape[:1]))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1)
            owner = np.repeat(np.arange(len(langs)), langs.value_lengths().to_numpy(zero_copy_only=False))
            number = langs.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            masks = np.zeros((len(langs), wide), np.uint64)
            np.bitwise_or.at(masks, (owner, (number // np.uint64(64)).astype(np.int64)), np.uint64(1) << number % np.uint64(64))
            places = sized.places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            slots, at = np.unique(places.ravel(), return_inverse=True)
            rows = np.zeros((len(slots), wide), np.uint64)
            np.bitwise_or.at(rows, at, np.repeat(masks, HASHES, axis=0))
            slot, word = np.nonzero(rows)
            yield pa.RecordBatch.from_arrays([pa.array(slots[slot]), pa.array(word.astype(np.int32)), pa.array(rows[slot, word].view(np.int64))], names=["slot", "word", "mask"])

    return chosen.select("gram", "langs").mapInArrow(over, "slot bigint, word int, mask bigint").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))


def slots_for(kinds: int) -> int:
    """A power of two of slots for so many n-grams in the largest language: twenty each, within FEWEST_SLOTS and MOST_SLOTS."""
    return min(max(1 << max(0, 20 * kinds - 1).bit_length(), FEWEST_SLOTS), MOST_SLOTS)


def fit(docs: DataFrame, *, where: Column | None = None, lang_col: str = "lang", text_col: str = "text", least_rate: float = 2e-5, least_part: float = 0.05, slots: int | None = None) -> LanguageFilter:
    """Learn from the rows that fulfil ``where`` and have a language.

    With ``least_rate`` and ``least_part`` at zero the filter has every n-gram of every language.
    Without ``slots`` their number follows the number of n-grams (``slots_for``).
    """
    rows = docs if where is None else docs.where(where)
    known = noted_paths(docs.sparkSession)
    grams = materialise(gram_counts(word_counts(rows, lang_col, text_col)), "grams")
    sums = grams.groupBy("lang").agg(F.sum("n").cast("double").alias("total"), F.count(F.lit(1)).alias("kinds")).orderBy("lang").collect()
    languages = [r["lang"] for r in sums]
    kinds = max((r["kinds"] for r in sums), default=0)
    size = slots or slots_for(kinds if least_rate <= 0 else min(kinds, int(1 / least_rate)))
    out = LanguageFilter(languages, np.zeros((size, max(1, -(-len(languages) // 64))), np.uint64))
    if languages:
        numbered = grams.sparkSession.createDataFrame([(r["lang"], r["total"], k) for k, r in enumerate(sums)], "lang string, total double, k int")
        rated = grams.join(F.broadcast(numbered), "lang").select("gram", "k", (F.col("n") / F.col("total")).alias("rate"))
        peak = rated.groupBy("gram").agg(F.max("rate").alias("peak"), F.collect_list(F.struct("k", "rate")).alias("all")).where(F.col("peak") >= least_rate)
        chosen = F.filter("all", lambda x: (x["rate"] >= least_rate) & (x["rate"] >= least_part * F.col("peak")))
        found = slot_masks(peak.select("gram", F.transform(chosen, lambda x: x["k"]).alias("langs")), out).toArrow()
        out.slots[found["slot"].to_numpy(), found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    release(docs.sparkSession, [x for x in noted_paths(docs.sparkSession) if x not in known])
    return out


def predict(docs: DataFrame, model: LanguageFilter, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) of every whole text.

    Null texts and texts without a letter are ``und`` with score 0, as are all texts where
    nothing was learned. Of tied languages the first by name is taken. Repeated rows get the same
    answer; an empty table gives an empty result; a text of any length is read whole, a slice of
    tokens at a time. Other columns stay, but for those named as a new one.
    """
    shared = broadcast_value(docs, (model, model.false_rate() if model.languages else None))

    def each(texts: list[bytes]) -> list[pa.Array]:
        found, held, size = [], [], 0
        for text in texts:
            held.append(words_of(text))
            size += len(held[-1])
            if size >= SLICE // shared.value[0].slots.shape[1]:
                found += shared.value[0].predict(held, shared.value[1])
                held, size = [], 0
        found += shared.value[0].predict(held, shared.value[1])
        return [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]

    return map_texts(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], each, text_col)
