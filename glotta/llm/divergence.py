"""Source divergence audit: how far the sources of a language differ in their words.

Every kept term of a language has a vector of counts, one for each source that has the term. Many
terms share a vector, so the vectors are counted, each distinct one is evaluated once, and what
it gives is multiplied by the number of its terms. Vectors are sparse. With p the share of a
count and p0 that of no count at all, the sum over the terms of a pair of sources (i, j) is

    V f(p0i, p0j)                                         as if neither had any term
    + sum over i's terms of f(pi, p0j) - f(p0i, p0j)      what i has; likewise what j has
    + sum over common terms of f(pi, pj) - f(pi, p0j) - f(p0i, pj) + f(p0i, p0j)

The second line needs i's counts only, grouped by count; the third meets only the sources that a
vector names. All arithmetic is exact, in whole numbers.

Null texts, languages and sources count as empty; a document without terms still makes its group.
Texts of any length are counted whole. Repeated rows are documents of their own. Ties go by the
UTF-8 bytes of the item. A table without rows has no result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glotta.llm.common import last_table, materialise, noted_paths, slices, text_bytes, text_or_empty

#: Runs of letters and of all characters beyond ASCII, in lower-cased bytes.
TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE = 1_000_000_000
#: A task sends its counts on when it holds those of so many terms.
HELD_TERMS = 400_000
#: Pairs of sources worked on at a time in a task.
HELD_PAIRS = 2_000_000


def share(n: Column, whole: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (whole + 2 terms)), exactly."""
    over = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", over, (whole + 2 * terms).cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of whole numbers."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term (UTF-8 bytes) in a group, and the documents that have it.

    A task adds up what it reads before anything is shuffled.
    """

    def emitted(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            terms = list(n)
            columns = [[lang] * len(terms), [source] * len(terms), terms, list(n.values()), [d[t] for t in terms]]
            kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "n", "docs"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in (part for whole in batches for part in slices(whole, "text")):
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                terms = TERM.findall(text.lower())  # of bytes, lower() takes A-Z alone
                n.update(terms)
                d.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from emitted(held)
                held = {}
        yield from emitted(held)

    read = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_bytes(text_col).alias("text"))
    found = read.mapInArrow(over, "lang string, source string, term binary, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def count_vectors(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, vector): the terms in at least ``least_docs`` documents of their language, with the counts of the sources that have them."""
    vector = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector")
    found = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), vector)
    return found.where(F.col("docs") >= least_docs).drop("docs")


def _common_terms(vectors: DataFrame) -> DataFrame:
    """(lang, a, b, value) with a < b: the sums over common terms, partial ones of each task.

    vectors: lang, m, and entries (source, p, p0) in the order of sources. The pairs of an entry are
    those after it; they are laid out in arrays of a bounded size and summed there.
    """

    def summed(lang, source, m, p, p0, left, right) -> pa.RecordBatch:
        def f(x, y):
            return (x - y) ** 2 // (x + y)

        a, b = left, right
        value = m[a] * (f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b]))
        sources = len(source.dictionary)
        codes = source.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = (lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[a] * sources + codes[a]) * sources + codes[b]
        order = np.argsort(key, kind="stable")
        keys, starts = np.unique(key[order], return_index=True)
        columns = [lang.dictionary.take(pa.array(keys // sources**2)), source.dictionary.take(pa.array(keys // sources % sources)), source.dictionary.take(pa.array(keys % sources)), pa.array(np.add.reduceat(value[order], starts))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            entries = batch.column(at("entries"))
            flat, sizes = entries.flatten(), np.diff(entries.offsets.to_numpy())
            if not len(flat):
                continue
            vector = np.repeat(np.arange(batch.num_rows), sizes)
            lang = batch.column(at("lang")).take(pa.array(vector)).dictionary_encode()
            source = flat.field("source").dictionary_encode()
            m = batch.column(at("m")).to_numpy()[vector]
            p, p0 = flat.field("p").to_numpy(), flat.field("p0").to_numpy()
            # how many entries of its vector stand after each entry
            after = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat)) - 1
            turn = (np.cumsum(after) - after) // HELD_PAIRS
            for k in np.unique(turn[after > 0]):
                own = np.nonzero((turn == k) & (after > 0))[0]
                left = np.repeat(own, after[own])
                step = np.arange(len(left)) - np.repeat(np.cumsum(after[own]) - after[own], after[own])
                yield summed(lang, source, m, p, p0, left, left + 1 + step)

    return vectors.select("lang", "m", "entries").mapInArrow(over, "lang string, a string, b string, value bigint")


def source_divergence(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, most_terms: int = 10
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of language and source.

    ``pair``: each other source of the language and how far it is; ``term``: the ``most_terms``
    terms that set the group apart from its language most, among those it has a larger share of.
    """
    spark, known = docs.sparkSession, noted_paths(docs.sparkSession)
    counts = term_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col)
    kept = materialise(count_vectors(counts, least_docs), "divergence-terms")
    distinct = kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("m")).withColumn("vector_id", F.monotonically_increasing_id())
    distinct = materialise(distinct, "divergence-vectors")

    total = F.aggregate("vector", F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    langs = distinct.groupBy("lang").agg(F.sum("m").alias("terms"), F.sum(F.col("m") * total).alias("lang_whole"))
    every = distinct.select("vector_id", "lang", "m", total.alias("total"), F.explode("vector").alias("x")).select("vector_id", "lang", "m", "total", "x.source", "x.n")
    wholes = every.groupBy("lang", "source").agg(F.sum(F.col("m") * F.col("n")).alias("whole"))
    groups = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source")).distinct()
    none = F.lit(0).cast("bigint")
    groups = groups.join(wholes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("whole", none).alias("whole"), F.coalesce("terms", none).alias("terms"), "lang_whole")
    # without kept terms there are no shares, and nothing to sum
    p0 = F.when(F.col("terms") > 0, share(none, F.col("whole"), F.col("terms"))).otherwise(F.lit(1).cast("bigint"))
    groups = materialise(groups.withColumn("p0", p0), "divergence-groups")

    entries = every.join(groups, ["lang", "source"]).select(
        "vector_id", "lang", "source", "m", "n", "p0", share(F.col("n"), F.col("whole"), F.col("terms")).alias("p"), share(F.col("total"), F.col("lang_whole"), F.col("terms")).alias("q")
    )
    entries = materialise(entries, "divergence-entries")

    pairs = _pairs(entries, groups)
    terms = _terms(entries, distinct, kept, most_terms)
    return last_table(pairs.unionByName(terms), "divergence", known)


def _pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    sources = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "terms")
    none = sources.join(other, "lang").where("a < b").select("lang", "a", "b", (F.col("terms") * apart(F.col("a0"), F.col("b0"))).alias("value"))

    by_count = entries.groupBy("lang", "source", "p", "p0").agg(F.sum("m").alias("m"))
    gain = F.col("m") * (apart(F.col("p"), F.col("b0")) - apart(F.col("p0"), F.col("b0")))
    alone = by_count.join(other, "lang").where("source != b").select("lang", F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b"), gain.alias("value"))
    alone = alone.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    vectors = entries.groupBy("vector_id", "lang", "m").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("entries"))
    common = _common_terms(vectors).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    summed = none.unionByName(alone).unionByName(common).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.select("lang", both, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(order))


def _terms(entries: DataFrame, distinct: DataFrame, kept: DataFrame, most: int) -> DataFrame:
    """A vector's terms share their value, so vectors are ranked first; only the terms of those that can be among the ``most`` are ranked."""
    more = entries.where("p > q").select("lang", "source", "vector_id", apart(F.col("p"), F.col("q")).alias("value"))
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"))
    chosen = more.withColumn("k", F.rank().over(best)).where(F.col("k") <= most).drop("k")
    vectors = chosen.join(distinct.select("vector_id", "vector"), "vector_id")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    ranked = vectors.join(kept, ["lang", "vector"]).select("lang", "source", "value", "term").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
