"""Learner state as versioned tables: loading with defaults, saving, restoring, resetting, and batches of a stream.

A table is a folder of data segments and a log of versions. A version is a small file that names the
segments it is made of; the highest number that can be read holds. A writer puts its segment
first and its version last, by a rename that fails where the version is there already, so a crash in
between leaves the old version whole, and of two writers one is told. A version notes the
last batch of each stream, so a batch that is replayed changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Segments of a version before they are written together.
MOST_SEGMENTS = 32


class Conflict(RuntimeError):
    """Another writer has put the version that this one was about to."""


@dataclass(frozen=True)
class Version:
    """``last`` is the highest number that was there, readable or not, when this version was read."""

    number: int = 0
    segments: tuple[str, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)
    last: int = 0


class Store:
    """A table of rows of ``schema`` (a DDL text) at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return [x.getPath().getName() for x in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def versions(self) -> list[int]:
        return sorted(int(x.removesuffix(".json")) for x in self._names("versions") if x.endswith(".json") and x[:-5].isdigit())

    def version(self) -> Version:
        """The highest version that can be read; the empty one where there is none."""
        numbers = self.versions()
        last = numbers[-1] if numbers else 0
        for number in reversed(numbers):
            found = self.spark.read.text(f"{self.path}/versions/{number:012d}.json", wholetext=True).first()
            try:
                said = json.loads(found["value"])
                return Version(number, tuple(said["segments"]), dict(said["batches"]), last)
            except (TypeError, ValueError, KeyError):
                continue
        return Version(last=last)

    def read(self, version: Version | None = None) -> DataFrame:
        """The rows of a version, the present one if none is given."""
        version = version or self.version()
        if not version.segments:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{x}" for x in version.segments))

    def load(self, defaults: dict[str, object]) -> DataFrame:
        """The rows with defaults for what is missing in them."""
        return with_defaults(self.read(), defaults)

    def _put(self, version: Version) -> Version:
        """The version under the next number, or a conflict if that has been taken since ``version`` was read."""
        version = replace(version, number=version.last + 1, last=version.last + 1)
        body = json.dumps({"segments": version.segments, "batches": version.batches})
        temporary, final = self._path(f"versions/.{uuid.uuid4().hex}"), self._path(f"versions/{version.number:012d}.json")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(temporary, False)
        out.write(bytearray(body.encode()))
        out.close()
        files = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(files.Options.Rename, 0)
        try:
            files.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration()).rename(temporary, final, none)
        except Exception as error:
            self._fs.delete(temporary, False)
            if self._fs.exists(final):
                raise Conflict(f"version {version.number} of {self.path} is there already") from error
            raise
        return version

    def _segment(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(self.schema)]
        rows.select(*columns).write.parquet(f"{self.path}/data/{name}")
        return name

    def replace(self, rows: DataFrame) -> Version:
        """A version of these rows alone."""
        before = self.version()
        return self._put(replace(before, segments=(self._segment(rows),)))

    def append(self, rows: DataFrame, *, stream: str | None = None, batch: int | None = None) -> Version:
        """A version with these rows added. A batch of a stream that a version has already is left out."""
        before = self.version()
        if stream is not None and batch <= before.batches.get(stream, -1):
            return before
        batches = before.batches | ({stream: batch} if stream is not None else {})
        segments = (*before.segments, self._segment(rows))
        if len(segments) > MOST_SEGMENTS:
            segments = (self._segment(self.read(replace(before, segments=segments))),)
        return self._put(replace(before, segments=segments, batches=batches))

    def reset(self) -> Version:
        """An empty version; what batches have been taken in stays known."""
        return self._put(replace(self.version(), segments=()))

    def restore(self, rows: DataFrame, defaults: dict[str, object]) -> Version:
        """A version of the incoming rows, with defaults for all columns that they lack or leave null."""
        for f in T.StructType.fromDDL(self.schema):
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        return self.replace(with_defaults(rows, defaults))

    def save(self, rows: DataFrame, *, heavy: tuple[str, ...] = ("raw_text",)) -> Version:
        """``replace``; if that can't be written, once more without the heavy columns."""
        try:
            return self.replace(rows)
        except PySparkException:
            present = [c for c in heavy if c in rows.columns]
            if not present:
                raise
            return self.replace(rows.withColumns({c: F.lit(None) for c in present}))

    def vacuum(self) -> list[str]:
        """Delete the segments that the present version doesn't name, such as those of writers that crashed; no writer may be at work."""
        kept = set(self.version().segments)
        gone = [x for x in self._names("data") if x not in kept]
        for name in gone:
            self._fs.delete(self._path(f"data/{name}"), True)
        return gone


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    kinds = {f.name: f.dataType for f in rows.schema}
    return rows.withColumns({c: F.coalesce(c, F.lit(x).cast(kinds[c])) for c, x in defaults.items() if c in kinds})
