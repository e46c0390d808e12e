"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items are normalised to words and laid, as sequences of word numbers, into one suffix
automaton. A document's words are streamed through it; at each word the automaton knows the
longest suffix read so far that occurs in some item. Where that length reaches the window (or
the whole of a shorter item), the words under it are hit. Hits merge into spans; documents are
judged by the share of hit words, and spans can be cut out of the text.

The items are a stated query set. They are read in blocks of at most ``block_words`` words, so
each automaton, which is broadcast, has a size bound; documents pass every block.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotta.llm.common import broadcast_value, map_texts

#: Bytes of words stay, A-Z become a-z, all others become spaces.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: The same words, for their places in a text.
WORD_PLACES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class ItemAutomaton:
    """A generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.found: dict[int, tuple[int, tuple[str, ...]]] = {}
        self.short: dict[int, set[str]] = {}
        paths: list[tuple[str, list[int]]] = []
        for item, words in items:
            if words:
                paths.append((item, [self.number.setdefault(w, len(self.number)) for w in words]))
                last = 0
                for w in paths[-1][1]:
                    last = self._extend(last, w)
        self.items: list[set[str]] = [set() for _ in self.next]
        for item, path in paths:
            state = 0
            for w in path:
                state = self.next[state][w]
                up = state
                while up > 0 and item not in self.items[up]:
                    self.items[up].add(item)
                    up = self.link[up]
            if len(path) < window:
                self.short.setdefault(state, set()).add(item)
        # least length of a match in each state that is a whole window or short item
        self.least = [1 << 60] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = self.length[state] if state in self.short else window if self.length[state] >= window else 1 << 60
            self.least[state] = min(own, self.least[self.link[state]])

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def _split(self, p: int, q: int, w: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _at(self, state: int, length: int) -> tuple[int, tuple[str, ...]]:
        """The longest hit that ends here, and the items whose windows end here."""
        longest, items, up = 0, set(), state
        while up > 0:
            if self.length[self.link[up]] < self.window <= min(self.length[up], length):
                longest = max(longest, self.window)
                items |= self.items[up]
            if up in self.short and self.length[up] <= length:
                longest = max(longest, self.length[up])
                items |= self.short[up]
            up = self.link[up]
        return longest, tuple(items)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The spans [start, end) of hit words, merged, and the items with windows in them."""
        step, link, size, least, window = self.next, self.link, self.length, self.least, self.window
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = length = 0
        for i, w in enumerate(map(self.number.get, words)):
            if w is None:
                state = length = 0
                continue
            to = step[state].get(w)
            if to is None:
                while state > 0 and to is None:
                    state = link[state]
                    to = step[state].get(w)
                length = size[state] + 1
                if to is None:
                    state = length = 0
                    continue
            else:
                length += 1
            state = to
            if length >= least[state]:
                key = state * (window + 1) + min(length, window)
                if key not in self.found:
                    self.found[key] = self._at(state, length)
                longest, there = self.found[key]
                items.update(there)
                start = i - longest + 1
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, items


def _blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    block, held = [], 0
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("binary").alias("t"))
    for item, text in rows.distinct().toLocalIterator():
        words = words_of(bytes(text or b""))
        if held + len(words) > block_words and block:
            yield block
            block, held = [], 0
        block.append((item, words))
        held += len(words)
    yield block


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", _SPANS),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = 13,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = 1_000_000,
) -> DataFrame:
    """``docs`` with n_words, spans (word places [start, end) that are hit, merged) and items (sorted ids).

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in
    lower case. A window is ``window`` consecutive words of an item, or the whole of a shorter
    one; items without words have none. Null texts have no words; a null item id counts as the
    empty text; repeated item rows count once, repeated documents are each judged; without items
    nothing is hit. Columns of ``docs`` that are named as a new one are replaced.
    """
    out = docs
    for k, block in enumerate(_blocks(items, item_id_col, item_text_col, block_words)):
        machine = broadcast_value(docs, ItemAutomaton(block, window))

        def each(texts: list[bytes], machine=machine) -> list[pa.Array]:
            scan = machine.value.scan
            words = [words_of(x) for x in texts]
            found = [scan(x) for x in words]
            return [
                pa.array(map(len, words), pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for s, _ in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([sorted(x) for _, x in found], pa.list_(pa.string())),
            ]

        if k == 0:
            out = map_texts(docs, _FIELDS, each, text_col)
        else:
            before = out.withColumnsRenamed({"spans": "_spans", "items": "_items"})
            out = (
                map_texts(before, _FIELDS, each, text_col)
                .withColumn("items", F.array_sort(F.array_union("items", "_items")))
                .withColumn("spans", _merged(F.array_sort(F.concat("spans", "_spans"))))
                .drop("_spans", "_items")
            )
    return out


def _merged(spans):
    """Sorted spans, those that touch or overlap as one."""
    one = lambda s, e: F.array(F.struct(s.alias("start"), e.alias("end")))

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), one(last["start"], F.greatest(last["end"], x["end"])))
        apart = F.concat(done, one(x["start"], x["end"]))
        return F.when((F.size(done) > 0) & (last["end"] >= x["start"]), joined).otherwise(apart)

    return F.aggregate(spans, F.array().cast(_SPANS), add)


def n_hit(spans: str = "spans"):
    """The number of words in merged spans."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])


def contaminated(one_in: int = 20, spans: str = "spans", n_words: str = "n_words"):
    """True where some word is hit, and at least one in ``one_in`` of all."""
    return (n_hit(spans) > 0) & (one_in * n_hit(spans) >= F.col(n_words))


def decontaminate(docs: DataFrame, items: DataFrame, *, one_in: int = 20, **options) -> DataFrame:
    """``docs`` without its contaminated documents; all columns stay, names that clash included."""
    names = {"n_words": "_glotta_n_words", "spans": "_glotta_spans", "items": "_glotta_items"}
    clash = {a: b for a, b in names.items() if a in docs.columns}
    judged = overlaps(docs.withColumnsRenamed(clash), items, **options).where(~contaminated(one_in)).drop(*names)
    return judged.withColumnsRenamed({b: a for a, b in clash.items()}).select(docs.columns)


def cut_spans(docs: DataFrame, items: DataFrame, *, least_words: int = 13, text_col: str = "text", **options) -> DataFrame:
    """``docs`` whose texts lack the hit spans of ``least_words`` words or more; the rest of a text is as it was."""
    found = overlaps(docs, items, text_col=text_col, **options)
    schema = T.StructType([x for x in found.schema if x.name not in ("n_words", "spans", "items")])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            texts = []
            for text, spans in zip(batch.column(at(text_col)).to_pylist(), batch.column(at("spans")).to_pylist(), strict=True):
                long = [x for x in spans if x["end"] - x["start"] >= least_words]
                if long:
                    raw, out, begun = text.encode(), [], 0
                    places = [m.span() for m in WORD_PLACES.finditer(raw)]
                    for x in long:
                        out.append(raw[begun : places[x["start"]][0]])
                        begun = places[x["end"] - 1][1]
                    text = b"".join([*out, raw[begun:]]).decode("utf-8", "replace")
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if x.name == text_col else batch.column(at(x.name)) for x in schema]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return found.mapInArrow(over, schema)
