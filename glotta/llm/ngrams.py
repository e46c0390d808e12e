"""Language-model scoring by deleted interpolation of trigram, bigram and unigram estimates.

P(w | u, v) = a3 c(u, v, w) / c(u, v) + (1 - a3) P(w | v)
P(w | v)    = a2 c(v, w) / c(v)       + (1 - a2) P(w)
P(w)        = a1 c(w) / N             + (1 - a1) / (V + 1)

a3 and a2 depend on the bucket of the context's frequency, c(u, v) or c(v). The weights are
learned by expectation-maximisation on held-out counts: every training token is taken out of the
counts before it is estimated (the deleted estimate), so no token helps to predict itself.

Corpus counts are looked up in bulk, as most n-grams of a text are keys of their own:

1. Tasks cut their documents into chunks. A chunk has the distinct words and the token numbers
   of its documents, packed.
2. Each chunk asks for its distinct words and bigrams (``llm.exchange``: packed keys, in rounds
   whose size grows with the corpus).
3. Each chunk asks for those of its trigrams whose two bigrams both occur in other chunks; of
   the others its own count is the corpus count.
4. Tokens with their counts are a table. Each chunk's distinct counts, as far as a step of the EM
   depends on them, are a smaller one; each step is one pass over it, whose sums are exact and of
   fixed size. The first steps run on the first tokens of one chunk, to start near the solution.
   Then all documents are scored.

Counts and learning cover all documents, in 64-bit numbers; a task holds a few chunks' worth of
keys at any size of the corpus. N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotta.llm.common import arrow_batches, broadcast_value, last_table, materialise, materialise_parts, noted_paths, only_table, text_bytes
from glotta.llm.exchange import FAN, distinct, pack, pack_keys, pack_narrow, totals, unpack, unpack_narrow

#: Tokens in a chunk, about; a longer document is a chunk by itself.
CHUNK_TOKENS = 400_000
#: Contexts with a frequency of 0, 1, ..., 8, 9-15, 16-31, ... have a bucket each.
BUCKETS = 70
#: Chunks meet their answers in so many turns, which bounds the shuffle files on disk.
TURNS = 3
#: Rows of texts and chunks pass to the tasks in batches of about so many bytes; a chunk's row is often one by itself.
BATCH_BYTES = 4_000_000
#: Tokens that the first steps of the EM run on.
START_TOKENS = 200_000
#: Odd numbers without a pattern; sums of products with them tell tuples of counts apart.
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_END = b" "  # no word contains a space


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of sequences of two parts; their lowest bit is zero."""
    return _mix(a * np.uint64(3) + _mix(b)) & ~np.uint64(1)


class Grams:
    """The words, bigrams and trigrams of a chunk, numbered; token 0 is the end of a document.

    The first token of a document has an end before it, and no trigram.
    """

    def __init__(self, words: bytes, stream: bytes):
        self.words = unpack(words, np.uint64) | np.uint64(1)  # a lowest bit of one marks a word's key
        self.stream = unpack(stream, np.uint32).astype(np.int64)
        before = np.concatenate([[0], self.stream[:-1]])
        self.first = before == 0
        size = len(self.words)
        pairs, _, self.pair_of = distinct(before * size + self.stream)
        self.pairs = _joined(self.words[pairs // size], self.words[pairs % size])
        self.ends = np.nonzero(self.stream == 0)[0]
        self.sizes = np.diff(np.concatenate([[-1], self.ends]))

    def teaches(self, learn: list[bool]) -> np.ndarray:
        """For each token, whether its document teaches."""
        return np.repeat(np.array(learn, bool), self.sizes)

    def ask_words_and_pairs(self, learn: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted keys of words and bigrams, how often the teaching documents have them, and their order."""
        weight = self.teaches(learn).astype(float)
        n = np.concatenate([np.bincount(self.stream, weight, len(self.words)), np.bincount(self.pair_of, weight, len(self.pairs))])
        keys, order, place = distinct(np.concatenate([self.words, self.pairs]))
        return keys, n.astype(np.int64)[order], place

    def triples(self, learn: list[bool], outside: np.ndarray):
        """Numbers of the tokens that have a trigram, which trigram, own counts, which are to be asked for (those whose two bigrams other chunks have), and their keys."""
        teaches = self.teaches(learn)
        at = np.nonzero(~self.first)[0]
        size = max(1, len(self.pairs))
        found, _, triple_of = distinct(self.pair_of[at - 1] * size + self.pair_of[at])
        own = np.bincount(triple_of, teaches[at], len(found)).astype(np.int64)
        a, b = found // size, found % size
        ask = outside[a] & outside[b]
        return at, triple_of, own, ask, _joined(self.pairs[a[ask]], self.pairs[b[ask]])


def _chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """(chunk, ids, learn, words, stream): doc ids and training flags in the order of the stream."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bool]] = []
        tokens: list[bytes] = []
        names = ["chunk", "ids", "learn", "words", "stream"]

        def chunk():
            ids, learn = zip(*held, strict=True)
            flat = pa.array(tokens, pa.binary()).dictionary_encode()
            size = len(flat.dictionary)
            number = np.arange(1, size + 1, dtype=np.uint32)
            number[pc.index(flat.dictionary, pa.scalar(_END, pa.binary())).as_py()] = 0
            stream = number[flat.indices.to_numpy()]
            words = [_END, *flat.dictionary.to_numpy(zero_copy_only=False)]
            hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
            name = uuid.uuid4().int >> 65  # chunks are written once, so the name holds from then on
            held.clear()
            tokens.clear()
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(learn)], pa.list_(pa.bool_())), pa.array([pack(hashes)], pa.binary()), pa.array([pack(stream)], pa.binary())], names=names)

        for batch in batches:
            for doc_id, learn, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                held.append((doc_id, learn))
                tokens.extend(text.lower().split())
                tokens.append(_END)
                if len(tokens) >= chunk_tokens:
                    yield chunk()
        if held:
            yield chunk()

    return docs.mapInArrow(over, "chunk bigint, ids array<bigint>, learn array<boolean>, words binary, stream binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """One row after another, so that one chunk is held at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield [column[k].as_py() for column in batch.columns]


def _asked(chunks: DataFrame) -> DataFrame:
    """(block, keys, n): the words and bigrams of each chunk."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, learn, words, stream in _rows(batches):
            keys, n, _ = Grams(words, stream).ask_words_and_pairs(learn)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([pack_keys(keys)], pa.binary()), pa.array([pack(n * 2)], pa.binary())], names=["block", "keys", "n"])

    return chunks.select("chunk", "learn", "words", "stream").mapInArrow(over, "block bigint, keys binary, n binary")


def _all(parts: list[bytes] | None) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(unpack(x, np.int64) for x in parts or [])])


def _known(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks as tokens: sizes of their documents, counts of each token's word and bigram, and its trigram's
    own count and place among the trigrams that the chunk asks for (0: none); and what it asks for (keys, n)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, learn, words, stream, parts in _rows(batches):
            grams = Grams(words, stream)
            _, _, place = grams.ask_words_and_pairs(learn)
            n = _all(parts)[place]
            word, pair = n[: len(grams.words)], n[len(grams.words) :]
            at, triple_of, own, ask, keys = grams.triples(learn, (pair & 1).astype(bool))
            asked, first, order = distinct(keys)
            places = np.zeros(len(own), np.int32)
            places[ask] = order + 1
            pair = (pair >> 1)[grams.pair_of]
            triple, place = pair.copy(), np.zeros(len(pair), np.int32)  # a first token's trigram is its bigram
            triple[at], place[at] = own[triple_of], places[triple_of]
            values = [chunk, ids, learn, pack(grams.sizes), pack((word >> 1)[grams.stream]), pack(pair), pack(triple), pack(place), pack_keys(asked), pack(own[ask][first] * 2)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _ARROW + [pa.binary()] * 3, strict=True)], names=[*_COLUMNS, "place", "keys", "n"])

    fields = ", ".join(f"{x} binary" for x in ("place", "keys", "n"))
    return chunks.join(answers.withColumnRenamed("block", "chunk"), "chunk", "left").mapInArrow(over, f"{_COUNTED}, {fields}")


_COLUMNS = ["chunk", "ids", "learn", "sizes", "word", "pair", "triple"]
_ARROW = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4]
_COUNTED = "chunk bigint, ids array<bigint>, learn array<boolean>, sizes binary, word binary, pair binary, triple binary"


def _counted(known: DataFrame, answers: DataFrame) -> DataFrame:
    """Documents' sizes and, token by token, the corpus counts c(w), c(v, w) and c(u, v, w) of each chunk."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *kept, triple, place, parts in _rows(batches):
            place = unpack(place, np.int32)
            counts = np.concatenate([np.zeros(1, np.int64), _all(parts) >> 1])[place]
            triple = np.where(place > 0, counts, unpack(triple, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*kept, pack(triple)], _ARROW, strict=True)], names=_COLUMNS)

    rows = known.drop("keys", "n").join(answers.withColumnRenamed("block", "chunk"), "chunk", "left")
    return rows.mapInArrow(over, _COUNTED)


def _in_turns(rows: DataFrame, answers: DataFrame, met: Callable[[DataFrame, DataFrame], DataFrame], name: str) -> DataFrame:
    """``met`` of rows (chunk) and their answers (block), a part of the chunks at a time, as one table."""
    part = lambda df, key, k: df.where(F.pmod(F.xxhash64(key), F.lit(TURNS)) == k)
    return materialise_parts([met(part(rows, "chunk", k), part(answers, "block", k)) for k in range(TURNS)], name)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Frequencies up to 8 have a bucket each, larger ones one for each power of two."""
    return np.where(context <= 8, context, np.frexp(context.astype(float))[1] + 5)


@dataclass
class Counts:
    """Token by token: counts of word, bigram and trigram and of the contexts of the last two."""

    word: np.ndarray
    pair: np.ndarray
    triple: np.ndarray
    context: np.ndarray
    wide_context: np.ndarray
    times: np.ndarray | None = None  # how many tokens have these counts; one each if it isn't given
    wide_bucket: np.ndarray | None = None  # buckets of the contexts, where they are at hand
    bucket: np.ndarray | None = None

    @classmethod
    def read(cls, sizes: np.ndarray, word: bytes, pair: bytes, triple: bytes) -> Counts:
        word, pair, triple = (unpack(x, np.int64) for x in (word, pair, triple))
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        # an end has as many successors as a document has beginnings
        context = np.concatenate([[0], word[:-1]])
        context[first] = word[-1]
        wide = np.concatenate([[0], pair[:-1]])
        wide[first] = word[-1]
        return cls(word, pair, triple, context, wide)

    def without_own(self, teaches: np.ndarray, most: int | None = None) -> Counts:
        """The teaching tokens, each taken out of its counts."""
        return Counts(*(x[teaches][:most] - 1 for x in (self.word, self.pair, self.triple, self.context, self.wide_context)))

    def folded(self) -> tuple[Counts, np.ndarray]:
        """The distinct counts that a step of the EM depends on, with their times, and the tries that no step changes.

        Without its trigram a token says nothing of the trigrams' weights, so its context there goes, and without its
        bigram that one goes, too; the tries of their buckets (those of trigrams, then those of bigrams) are kept.
        """
        no_triple = self.triple == 0
        tries = np.concatenate([np.bincount(bucket_of(self.wide_context), minlength=BUCKETS), np.bincount(bucket_of(self.context[no_triple]), minlength=BUCKETS)])
        context = np.where(no_triple & (self.pair == 0), 0, self.context)
        columns = [self.word, self.pair, self.triple, context, np.where(no_triple, 0, self.wide_context)]
        key = sum(x.view(np.uint64) * np.uint64(by) for x, by in zip(columns, _ODD, strict=True))
        _, first, place = distinct(key)
        times = np.bincount(place, minlength=len(first))
        columns = [x[first] for x in columns]
        return Counts(*columns, times, bucket_of(columns[4]), bucket_of(columns[3])), tries.astype(float)


@dataclass
class Weights:
    """Weights of the estimates: by bucket for trigrams and bigrams, one for words."""

    three: np.ndarray
    two: np.ndarray
    one: float

    def parts(self, c: Counts, total: float, base: float) -> tuple[np.ndarray, ...]:
        """The mixture's four parts, which add up to the probability, and the buckets of the contexts."""
        b3, b2 = (bucket_of(n) if known is None else known for known, n in ((c.wide_bucket, c.wide_context), (c.bucket, c.context)))
        a3, a2 = self.three[b3], self.two[b2]
        p3 = a3 * (c.triple / np.maximum(c.wide_context, 1))
        p2 = (1 - a3) * a2 * (c.pair / np.maximum(c.context, 1))
        rest = (1 - a3) * (1 - a2)
        return p3, p2, rest * self.one * (c.word / max(total, 1.0)), rest * ((1 - self.one) * base), b3, b2

    def sums(self, c: Counts, total: float, base: float, tries: np.ndarray | None = None) -> np.ndarray:
        """The E step: expected uses and tries of each weight, in one row; ``tries`` are those of folded counts."""
        p3, p2, p1, p0, b3, b2 = self.parts(c, total, base)
        p = p3 + p2 + p1 + p0
        n = 1 if c.times is None else c.times
        s3, s2, s1 = p3 / p * n, p2 / p * n, p1 / p * n
        left = n - s3
        if tries is None:
            try3, try2 = np.bincount(b3, minlength=BUCKETS), np.bincount(b2, left, BUCKETS)
        else:
            known = c.triple > 0
            try3, try2 = tries[:BUCKETS], tries[BUCKETS:] + np.bincount(b2[known], left[known], BUCKETS)
        return np.concatenate([np.bincount(b3, s3, BUCKETS), try3, np.bincount(b2, s2, BUCKETS), try2, [s1.sum(), (left - s2).sum()]])

    @classmethod
    def of(cls, sums: np.ndarray) -> Weights:
        """The M step, with one use and one miss more of each weight, so that none is zero or one; an unseen context has weight zero."""
        use3, try3, use2, try2 = sums[: 4 * BUCKETS].reshape(4, BUCKETS)
        three, two = (use3 + 1) / (try3 + 2), (use2 + 1) / (try2 + 2)
        three[0] = two[0] = 0
        return cls(three, two, float((sums[-2] + 1) / (sums[-1] + 2)))

    @classmethod
    def even(cls) -> Weights:
        return cls.of(np.zeros(4 * BUCKETS + 2))

    def moved(self, other: Weights) -> float:
        return float(max(np.abs(self.three - other.three).max(), np.abs(self.two - other.two).max(), abs(self.one - other.one)))


def _folded(counted: DataFrame) -> DataFrame:
    """The folded counts of each chunk's teaching tokens, which the EM reads again and again."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for learn, sizes, *packed in _rows(batches):
            sizes = unpack(sizes, np.int64)
            counts, tries = Counts.read(sizes, *packed).without_own(np.repeat(np.array(learn, bool), sizes)).folded()
            values = [pack_narrow(getattr(counts, x)) for x in names[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([tries], pa.list_(pa.float64())), *(pa.array([x], pa.binary()) for x in values)], names=names)

    names = ["tries", "word", "pair", "triple", "context", "wide_context", "times", "wide_bucket", "bucket"]
    schema = "tries array<double>, " + ", ".join(f"{x} binary" for x in names[1:])
    return counted.select("learn", "sizes", "word", "pair", "triple").mapInArrow(over, schema)


def learn_weights(counted: DataFrame, total: int, base: float, *, start_rounds: int = 60, rounds: int = 12, tolerance: float = 2e-3) -> Weights:
    """Weights by EM on the deleted counts: steps on the first tokens of one chunk, then steps over all until no weight moves by more than ``tolerance``."""
    deleted = max(1.0, total - 1.0)
    weights = Weights.even()
    taught = counted.where(F.exists("learn", lambda x: x))
    least = taught.agg(F.min("chunk")).first()[0]
    start = taught.where(F.col("chunk") == F.lit(least)).select("learn", "sizes", "word", "pair", "triple").collect()  # one chunk
    for learn, sizes, *packed in start:
        sizes = unpack(bytes(sizes), np.int64)
        near = Counts.read(sizes, *map(bytes, packed)).without_own(np.repeat(np.array(learn, bool), sizes), START_TOKENS)
        for _ in range(start_rounds):
            weights = Weights.of(weights.sums(near, deleted, base))
    if not start:
        return weights
    folded = materialise(_folded(taught), "folded")
    for _ in range(rounds):
        shared = broadcast_value(counted, weights)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(4 * BUCKETS + 2)
            for tries, *packed in _rows(batches):
                sums += shared.value.sums(Counts(*map(unpack_narrow, packed)), deleted, base, np.array(tries))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["k", "x"])

        found = folded.mapInArrow(step, "k bigint, x double").groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()
        before, weights = weights, Weights.of(np.array([r["x"] for r in found]))
        if weights.moved(before) <= tolerance:
            break
    return weights


def score_documents(docs: DataFrame, *, learn: Column, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS, fan: int = FAN) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are what stands between ASCII white space, with A-Z in lower case, and one end for
    each document; null texts are empty, so they have the end alone. Rows where ``learn`` is
    true teach; a null there is false. base_score adds one to every count; score is the model's
    log10 probability of the text. Repeated rows teach and are scored again each; ids may be
    null or repeat. A very long text is a chunk by itself, as its task must hold it. If nothing
    is learned, every token is unseen. An empty table gives an empty result; other columns of
    ``docs`` are ignored, whatever their names.
    """
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return _scored(docs, learn, id_col, text_col, chunk_tokens, fan)


def _scored(docs: DataFrame, learn: Column, id_col: str, text_col: str, chunk_tokens: int, fan: int) -> DataFrame:
    spark = docs.sparkSession
    before = noted_paths(spark)
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), text_bytes(text_col).alias("text"))
    chunks = materialise(_chunks(named, chunk_tokens), "chunks")
    n_chunks = chunks.count()
    answers, marks = totals(_asked(chunks), n_chunks, fan=fan)
    total, distinct = marks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    known = only_table(_in_turns(chunks, answers, _known, "known"), before)
    answers, _ = totals(known.select(F.col("chunk").alias("block"), "keys", "n"), n_chunks, fan=fan)
    counted = only_table(_in_turns(known, answers, _counted, "counted"), before)
    base = 1.0 / (distinct + 1)
    weights = broadcast_value(docs, learn_weights(counted, total, base))
    log_base = float(np.log10(total + distinct + 1))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, learn, sizes, *packed in _rows(batches):
            sizes = unpack(sizes, np.int64)
            counts = Counts.read(sizes, *packed)
            own = np.log10(sum(weights.value.parts(counts, float(total), base)[:4]))
            flat = np.log10(counts.word + 1.0) - log_base
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            add = lambda x: np.add.reduceat(x, starts)
            columns = [pa.array(ids, pa.int64()), pa.array([not x for x in learn], pa.bool_()), pa.array(sizes), pa.array(add((counts.word > 0).astype(np.int64))), pa.array(np.full(len(ids), total, np.int64)), pa.array(add(flat)), pa.array(add(own))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType())] + [T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(x, T.DoubleType()) for x in ("base_score", "score")])
    return last_table(counted.drop("chunk").mapInArrow(scores, schema), "ngram-scores", before)
