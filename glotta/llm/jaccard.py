"""Near-duplicates by SimHash, verified by the Jaccard similarity of word shingles (0.8 or more), and every pair beyond.

1. Every text gets the set of its shingles of five words, as 64-bit hashes, in one order for all
   texts: rare shingles first, those that are frequent in a sample last. The order changes cost
   only. Texts with one set are one node. The same hashes give the SimHash of operator 4.
2. Operator 4's links between fingerprints are verified by whole sets; what they connect is known
   from then on, and only what they leave apart is looked for any further.
3. No number of bits bounds the similarity, so the rest is found in an exact way. Two sets of
   similarity 4/5 share a shingle among the first floor(n / 5) + 1 of each: those meet in buckets,
   of which only such with nodes of different components are kept. The rarest shingle that two
   sets share leaves room for their other common ones behind it in both; a bucket where it
   doesn't has nothing to say of that pair.
4. The members of each bucket are compared with the one that has the fewest rarer shingles, as it is alike
   to the most, which joins the copies of a large group by as many pairs as it has members. Then members of a
   bucket that are still apart are compared with each other; a bucket above ``block`` members is
   dealt to several tasks. Pairs whose counts of shingles by some hash bits (six, for large sets
   up to twelve) rule the similarity out go no further.
5. Pairs are verified by the whole sets, of which only those that pairs name are dealt out; connected components over the links give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotta.llm import simhash
from glotta.llm.common import arrow_batches, broadcast_value, last_table, map_texts, materialise, materialise_parts, noted_paths, only_table, text_or_empty
from glotta.llm.exact import keep_rows
from glotta.llm.graph import connected_components

SHINGLE, SEED, SKETCH = 5, 42, 64
#: SimHash links are those of fingerprints that differ in so many bits or fewer.
DISTANCE = 8
#: Buckets and pairs are worked on in so many turns, which bounds the shuffle files on disk.
TURNS = 4
#: Sets of more than ``FILL`` shingles also have finer counts, of about so many for 64 buckets, in at most so many buckets.
FILL, MOST_BUCKETS = 320, 4096
#: Rows of texts and sets pass to the tasks in batches of about so many bytes, to hold less of an executor's memory.
BATCH_BYTES = 4_000_000
#: The nodes that pairs name are marked in at most so many bits; a power of two.
MOST_MARKS = 1 << 26
#: Frequent shingles are sought in one of so many rows; at most so many are put last.
SAMPLE_OF, MOST_FREQUENT = 8, 500_000


def hashes(text: bytes) -> np.ndarray:
    """The hashes of the text's shingles, repeats included; a shorter text is one shingle, one without words has none."""
    import xxhash

    words = text.lower().split()
    if len(words) <= SHINGLE:
        parts = [b" ".join(words)] if words else []
    else:
        parts = [b"%b %b %b %b %b" % x for x in zip(*(words[k:] for k in range(SHINGLE)))]
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in parts), np.uint64, len(parts))


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    return np.unique(hashes(text))


def frequent(docs: DataFrame, text_col: str = "text", held: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come back in a sample of the rows, sorted, and their rank by frequency; a bounded number."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0

        def counted():
            values, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(values[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["gram", "n"])

        for batch in batches:
            for text in batch.column(0):
                found.append(shingles(text.as_py()))
                size += len(found[-1])
                if size > held:
                    yield counted()
                    size = 0
        yield counted()

    text = text_or_empty(text_col)
    sample = docs.where(F.pmod(F.xxhash64(text), F.lit(SAMPLE_OF)) == 0).select(text.cast("binary").alias("text"))
    counts = sample.mapInArrow(over, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "gram").limit(MOST_FREQUENT).toPandas()
    grams = top["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], (len(grams) - order).astype(np.int64)


def sketch(grams: np.ndarray, buckets: int) -> bytes:
    """The counts of the hashes by their leading bits, 255 at most; ``buckets`` is a power of two."""
    at = (grams >> np.uint64(65 - buckets.bit_length())).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=buckets), 255).astype(np.uint8).tobytes()


def fine_buckets(n: int) -> int:
    """The buckets of the finer counts of a set of ``n``: its 64 times a power of two."""
    return min(SKETCH << (max(n - 1, 0) // FILL).bit_length(), MOST_BUCKETS)


def with_shingles(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with node (the set's hash), n, grams (in the order of all texts), sketch (counts by six bits), fine (by more; empty for small sets) and fp (the SimHash)."""
    shared = broadcast_value(docs, frequent(docs, text_col))

    def each(texts: list[bytes]) -> list[pa.Array]:
        import xxhash

        known, ranks = shared.value
        nodes, sets, sketches, finer, prints = [], [], [], [], []
        for text in texts:
            every = hashes(text)
            prints.append(simhash.of_hashes(every))
            grams = np.unique(every)
            nodes.append(xxhash.xxh64_intdigest(grams.tobytes(), SEED))
            sketches.append(sketch(grams, SKETCH))
            buckets = fine_buckets(len(grams))
            finer.append(sketch(grams, buckets) if buckets > SKETCH else b"")
            if len(known):
                at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                grams = grams[np.lexsort((grams, np.where(known[at] == grams, ranks[at], 0)))]
            sets.append(grams.view(np.int64))
        sizes = np.array([len(x) for x in sets], np.int32)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
        return [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes), grams, pa.array(sketches, pa.binary()), pa.array(finer, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64))]

    fields = [T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("fine", T.BinaryType()), T.StructField("fp", T.LongType())]
    return map_texts(docs, fields, each, text_col)


def _alike(both: Column, a: Column, b: Column) -> Column:
    """both / (a + b - both) >= 4 / 5, in whole numbers."""
    return 9 * both >= 4 * (a + b)


def _marked(named: DataFrame, most_bits: int = MOST_MARKS) -> np.ndarray:
    """A Bloom filter of the nodes (two bits each, from the hash that a node is), as 64-bit words of a bounded number."""
    bits = min(most_bits, max(1 << 16, 1 << (16 * named.count()).bit_length()))
    at = F.explode(F.array(*(F.shiftrightunsigned("node", k).bitwiseAND(F.lit(bits - 1)) for k in (0, 32)))).alias("at")
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    found = named.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    words = np.zeros(bits >> 6, np.int64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return words


def may_be_named(rows: DataFrame, named: DataFrame, most_bits: int = MOST_MARKS) -> DataFrame:
    """The rows whose node is among the nodes of ``named``, and few others, found before rows are dealt out."""
    marks = broadcast_value(rows, _marked(named, most_bits))

    @F.arrow_udf("boolean")
    def marked(node: pa.Array) -> pa.Array:
        words, node = marks.value, node.to_numpy(zero_copy_only=False).view(np.uint64)
        ok = np.ones(len(node), bool)
        for k in (0, 32):
            at = ((node >> np.uint64(k)) & np.uint64(64 * len(words) - 1)).astype(np.int64)
            ok &= (words[at >> 6] >> (at & 63) & 1).astype(bool)
        return pa.array(ok)

    return rows.where(marked("node"))


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a similarity of 0.8 or more."""
    known = noted_paths(rows.sparkSession)
    pairs = materialise(pairs, "jaccard-pairs")
    named = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "jaccard-named")
    sets = materialise(may_be_named(rows.select("node", "grams"), named).join(named, "node", "left_semi").groupBy("node").agg(F.first("grams").alias("grams")), "jaccard-sets")
    a, b = (sets.select(F.col("node").alias(x), F.col("grams").alias(f"of_{x}")) for x in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    met = lambda part: part.join(a, "a").join(b, "b").where(_alike(both, F.size("of_a"), F.size("of_b"))).select("a", "b")
    found = materialise_parts([met(pairs.where(_turn("a", k))) for k in range(TURNS)], "jaccard-alike")
    return only_table(found, known)


def _possible(n_a: np.ndarray, n_b: np.ndarray, sketch_a: np.ndarray, sketch_b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes and sketches can be alike: they differ in as many shingles as their counts differ, or more."""
    return 9 * np.abs(sketch_a.astype(np.int16) - sketch_b).sum(1, dtype=np.int64) <= n_a.astype(np.int64) + n_b


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def _finely_possible(n_a: int, n_b: int, fine_a: bytes, fine_b: bytes) -> bool:
    """The same by finer counts, where both sets have them; more buckets are added up to the fewer of the other."""
    buckets = min(len(fine_a), len(fine_b))
    if not buckets:
        return True
    a, b = (np.frombuffer(x, np.uint8).reshape(buckets, -1).sum(1, dtype=np.int64) for x in (fine_a, fine_b))
    return bool(9 * np.abs(a - b).sum() <= n_a + n_b)


def possible(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pairs (a, b) that the profiles (node, n, sketch, fine) don't rule out, so that few whole sets have to meet."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(k).to_numpy() for k in (2, 4))
            ok = _possible(n_a, n_b, _sketches(batch.column(3)), _sketches(batch.column(5)))
            for k in np.nonzero(ok)[0].tolist():
                ok[k] = _finely_possible(int(n_a[k]), int(n_b[k]), batch.column(6)[k].as_py(), batch.column(7)[k].as_py())
            yield batch.select([0, 1]).filter(pa.array(ok))

    a, b = (profiles.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"), F.col("fine").alias(f"fine_{x}")) for x in "ab")
    met = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b", "fine_a", "fine_b")
    return met.mapInArrow(over, "a bigint, b bigint")


def _apart(members: DataFrame, block: int) -> DataFrame:
    """(a, b): pairs of one bucket's members (gram, node, n, at, sketch, component) in different components that can be alike."""
    sizes = members.groupBy("gram").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    chunks = F.ceil(F.col("size") / block).cast("int")
    dealt = (
        members.join(sizes.where("low != high").select("gram", "size"), "gram")
        .select("gram", "node", "n", "at", "sketch", "component", F.pmod(F.hash("node"), chunks).alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        .select(F.xxhash64("gram", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "node", "n", "sketch", "component", "at")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
    )

    def pairs(bucket, node, n, component, at, sketch) -> Iterator[pa.RecordBatch]:
        step, open_ = 1, np.arange(len(bucket))
        while len(open_):
            open_ = open_[open_ + step < len(bucket)]
            open_ = open_[bucket[open_] == bucket[open_ + step]]
            for k in range(0, len(open_), 65536):
                a = open_[k : k + 65536]
                b = a + step
                ok = (component[a] != component[b]) & (9 * np.minimum(n[a] - at[a], n[b] - at[b]) >= 4 * (n[a] + n[b]))
                a, b = a[ok], b[ok]
                ok = _possible(n[a], n[b], sketch[a], sketch[b])
                x, y = node[a[ok]], node[b[ok]]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
            step += 1

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4, 5)]
            new.append(_sketches(batch.column(3)))
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            other = np.nonzero(held[0] != held[0][-1])[0]
            if len(other):  # whole buckets; the last may go on in the next batch
                last = int(other[-1]) + 1
                yield from pairs(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None:
            yield from pairs(*held)

    return dealt.mapInArrow(over, "a bigint, b bigint").distinct()


def _turn(col: str, k: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(TURNS)) == k


def _proposed(profiles: DataFrame, distance: int, block: int) -> DataFrame:
    """(a, b): operator 4's links between the nodes (node, fp), those of one fingerprint with the least of them."""
    heads = materialise(profiles.groupBy("fp").agg(F.min("node").alias("node")), "jaccard-heads")
    near = simhash.links(heads, simhash.plan_partitions(heads, distance), distance, block)
    same = profiles.select("fp", F.col("node").alias("b")).join(heads, "fp").where("node != b").select(F.col("node").alias("a"), "b")
    return near.select("a", "b").unionByName(same)


def _placed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (node) with the component that the links give them."""
    # merged at any size, so that the cost has no step where the components grow too large to broadcast
    return nodes.join(connected_components(links).hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = 1024, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, text_sha256, component.

    Documents link where the Jaccard similarity of their sets of five-word shingles is 0.8 or
    more; a component is what links connect, and its number means nothing else. ``distance``,
    that of the SimHash links, decides how much is left to the prefix filter, and so the cost
    only. Null texts count as empty; texts without words are alike. Ids may be null or repeat.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_or_empty(text_col), 256).alias("text_sha256"), F.col(text_col).alias("text"))
    rows = materialise(with_shingles(named).drop("text"), "jaccard-rows")
    profiles = materialise(rows.groupBy("node").agg(*(F.min(x).alias(x) for x in ("n", "sketch", "fine", "fp"))), "jaccard-profiles")
    found = verified(possible(_proposed(profiles, distance, block), profiles), rows)
    first = F.slice("grams", F.lit(1), F.floor(F.col("n") / 5).cast("int") + 1)
    prefixes = materialise(_placed(rows.groupBy("node").agg(F.first("n").alias("n"), F.first(first).alias("first")), found), "jaccard-prefixes")
    every = prefixes.select(F.posexplode("first").alias("at", "gram"), "node", "n", "component")

    def met(marks: DataFrame) -> DataFrame:
        dealt = marks.repartition("gram")
        buckets = dealt.groupBy("gram").agg(F.min(F.struct("at", "node", "n", "component")).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
        return dealt.join(buckets.where("low != high").select("gram", "hub"), "gram").select("gram", "at", "node", "n", "component", "hub")

    members = materialise_parts([met(every.where(_turn("gram", k))) for k in range(TURNS)], "jaccard-members")
    fits = 9 * F.least(F.col("n") - F.col("at"), F.col("hub.n") - F.col("hub.at")) >= 4 * (F.col("n") + F.col("hub.n"))
    hubs = members.where(fits & (F.col("component") != F.col("hub.component"))).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    found = found.unionByName(verified(possible(hubs, profiles), rows))
    known = materialise(_placed(profiles.select("node", "sketch").join(members.select("node").distinct(), "node", "left_semi"), found), "jaccard-known")
    apart = [_apart(members.where(_turn("gram", k)).drop("hub", "component").join(known, "node"), block) for k in range(TURNS)]
    more = verified(possible(materialise_parts(apart, "jaccard-apart").distinct(), profiles), rows)
    parts = connected_components(found.unionByName(more))
    return rows.join(parts, "node", "left").select("doc_id", "text_sha256", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = 1024, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest id; a null id is above all others. All columns stay."""
    known = noted_paths(docs.sparkSession)
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        placed = last_table(near_duplicates(docs, id_col=id_col, text_col=text_col, block=block, distance=distance), "jaccard-placed", known)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"))
    groups = placed.groupBy("component").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    verdicts = placed.join(groups, "component").select("doc_id", "text_sha256", (F.col("least") == place).alias("kept"))
    return keep_rows(docs, verdicts, id_col=id_col, text_col=text_col)
