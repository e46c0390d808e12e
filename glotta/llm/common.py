"""What several training-data operators share: the shared folder, written tables and column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a fresh folder; a cluster must name one.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    known = getattr(spark.sparkContext, "_glotta_shared", None)
    if known is None:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext._glotta_shared = known
    return known


#: Spark drops the shuffle files of a write as soon as it has ended.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its own class."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def write_shared(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write ``df`` as Parquet to a folder that is deleted when the driver ends, if not released before."""
    spark = df.sparkSession
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)
    fs, own = _file_system(spark, path)
    fs.deleteOnExit(own)


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Batches of at most about ``most`` bytes for Python tasks that start meanwhile; a row is never cut."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the session keeps note of it for ``release_since``."""
    path = f"{shared_dir(spark)}/glotta-{name}-{uuid.uuid4().hex}"
    _noted(spark).append(path)
    return path


def _noted(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if not hasattr(context, "_glotta_paths"):
        context._glotta_paths = []
    return context._glotta_paths


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        fs, own = _file_system(spark, path)
        fs.delete(own, True)
        fs.cancelDeleteOnExit(own)
    left = set(paths)
    _noted(spark)[:] = [x for x in _noted(spark) if x not in left]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what stands before, and a
    table that several later steps read is computed once.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    write_shared(df, path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_parts(parts: Sequence[DataFrame], name: str) -> DataFrame:
    """The union of ``parts`` as one table, each written after the other, so that the shuffles of one are on disk at a time."""
    spark = parts[0].sparkSession
    path = shared_path(spark, name)
    for part in parts:
        write_shared(part, path, "append")
    return spark.read.schema(parts[0].schema).parquet(path)


def last_table(df: DataFrame, name: str, known: list[str]) -> DataFrame:
    """``df`` written and read back, after which all shared tables that aren't ``known`` are released.

    For an operator's last table: what was written on the way is gone when the operator returns.
    """
    return only_table(materialise(df, name), known)


def only_table(table: DataFrame, known: list[str]) -> DataFrame:
    """``table``, the one written last, after a release of all shared tables that aren't ``known``."""
    own = _noted(table.sparkSession)
    release(table.sparkSession, [x for x in own[:-1] if x not in set(known)])
    return table


def noted_paths(spark: SparkSession) -> list[str]:
    """The shared tables that are there now."""
    return list(_noted(spark))


def text_or_empty(col: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_bytes(col: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return text_or_empty(col).cast("binary")


def id_crc(col: str = "doc_id", modulus: int = 3) -> Column:
    """CRC-32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def broadcast_value(df: DataFrame, value):
    """A broadcast variable of the session that ``df`` belongs to."""
    return df.sparkSession.sparkContext.broadcast(value)


#: Texts of about so many bytes are worked on at a time; a longer text is one by itself.
SLICE_BYTES = 8_000_000


def slices(batch: pa.RecordBatch, source: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE_BYTES of text."""
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(source))).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    starts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        yield batch.slice(a, b - a)


def map_texts(
    df: DataFrame,
    fields: list[T.StructField],
    each: Callable[[list[bytes]], list[pa.Array]],
    text_col: str = "text",
) -> DataFrame:
    """``df`` with the columns ``fields``, which ``each`` makes of a batch of whole texts.

    ``each`` gets the UTF-8 bytes (null: empty) of some rows and returns one Arrow array per
    field. A column of ``df`` with the name of a new field is replaced.
    """
    new = {x.name for x in fields}
    source = "_glotta_text"
    kept = [x for x in df.schema if x.name not in new]
    schema = T.StructType([*kept, *fields])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, source)):
            at = batch.schema.get_field_index
            made = each(batch.column(at(source)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(at(x.name)) for x in kept), *made], names=[x.name for x in schema])

    return df.withColumn(source, text_bytes(text_col)).mapInArrow(over, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
