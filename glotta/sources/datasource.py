"""A Spark data source over folders of whole files, which reads, streams and writes them: ``format("glotta_files")``.

Reading gives (path, length, modified, content), in SQL too (``CREATE TEMPORARY VIEW f USING
glotta_files OPTIONS (path '...')``). Options: ``pattern`` (of file names), ``split_bytes`` (of a
task's files, at most 64 MB), ``least_tasks`` (1; few files are dealt to about so many tasks), ``most_bytes`` (of a file,
100 MB). Files are listed once and dealt to tasks by their bytes. Filters on path, length and modified are met before a file is opened;
where the session sets ``spark.sql.python.filterPushdown.enabled``, Spark hands them over. A file
above ``most_bytes`` is a row without content. Names that begin with ``_`` or ``.`` are no files.

A stream takes files in the order of their time of change, once each; a file counts when that time is
``settle_seconds`` (2) past, so that files of one instant stay together. Files are
expected to be moved in whole and never changed; one moved in with a time before the last batch is not seen.

Writing takes (name, text), nulls as empty, and makes e-books of one chapter a row, of ``book_bytes`` of
text (16 MB) or one longer chapter. Tasks write beside the folder's files and the driver moves in what
the tasks that count have written, so lost and repeated tasks leave nothing behind; a reader that
comes while the books are moved in sees some of them.
"""

from __future__ import annotations

import io
import json
import re
import time
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from fnmatch import fnmatchcase
from html import escape

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

READ_SCHEMA = "path string, length bigint, modified timestamp, content binary"
_WRITTEN = ("name", "text")
_ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("content", pa.binary())])
_BESIDE = "_beside"


@dataclass(frozen=True)
class File:
    path: str
    length: int
    micros: int

    @property
    def modified(self) -> datetime:
        return datetime.fromtimestamp(self.micros // 1_000_000, UTC).replace(microsecond=self.micros % 1_000_000)


@dataclass
class Files(D.InputPartition):
    """The files of one task."""

    files: tuple[File, ...]


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def listed(path: str, pattern: str = "*") -> list[File]:
    """The files below a path, or the one file at it, in the order of their time of change and path."""
    system, root = _system(path)
    info = system.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(root, recursive=True))
    out = []
    for x in found:
        below = x.path.removeprefix(root.rstrip("/")).strip("/")
        hidden = any(part.startswith(("_", ".")) for part in below.split("/"))
        if x.type == pafs.FileType.File and not hidden and fnmatchcase(x.base_name, pattern):
            out.append(File(x.path, x.size, x.mtime_ns // 1000))
    return sorted(out, key=lambda f: (f.micros, f.path))


def dealt(files: Sequence[File], split_bytes: int, most_bytes: int, least_tasks: int = 1) -> list[Files]:
    """Files by turns in tasks of ``split_bytes`` (less where that makes under ``least_tasks``) or one larger file.

    Opening a file counts as 64 KB, and one that is not read as no more.
    """
    costs = [65536 + (file.length if file.length <= most_bytes else 0) for file in files]
    split_bytes = min(split_bytes, sum(costs) // max(least_tasks, 1))
    out, held, size = [], [], 0
    for file, cost in zip(files, costs, strict=True):
        if held and size + cost > split_bytes:
            out.append(Files(tuple(held)))
            held, size = [], 0
        held.append(file)
        size += cost
    return [*out, Files(tuple(held))] if held else out


_TESTS = {
    D.EqualTo: lambda x, y: x == y,
    D.In: lambda x, y: x in y,
    D.GreaterThan: lambda x, y: x > y,
    D.GreaterThanOrEqual: lambda x, y: x >= y,
    D.LessThan: lambda x, y: x < y,
    D.LessThanOrEqual: lambda x, y: x <= y,
    D.StringStartsWith: str.startswith,
    D.StringEndsWith: str.endswith,
    D.StringContains: str.__contains__,
}


class FileReader(D.DataSourceReader):
    def __init__(self, path: str, pattern: str, split_bytes: int, most_bytes: int, least_tasks: int) -> None:
        self.path, self.pattern, self.split_bytes, self.most_bytes, self.least_tasks = path, pattern, split_bytes, most_bytes, least_tasks
        self.filters: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """Those on a file's listing are met here, the others by Spark."""
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("path",), ("length",), ("modified",)):
                self.filters.append(f)
            else:
                yield f

    def _meets(self, file: File) -> bool:
        return all(_TESTS[type(f)](getattr(file, f.attribute[0]), f.value) for f in self.filters)

    def partitions(self) -> Sequence[Files]:
        files = [f for f in listed(self.path, self.pattern) if self._meets(f)]
        return self.dealt(files) or [Files(())]

    def dealt(self, files: Sequence[File]) -> list[Files]:
        return dealt(files, self.split_bytes, self.most_bytes, self.least_tasks)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        for file in partition.files:
            content = None
            if file.length <= self.most_bytes:
                with system.open_input_stream(file.path) as source:
                    content = source.read()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((file.path, file.length, file.modified, content), _ARROW.types, strict=True)], schema=_ARROW)


class FileStream(D.DataSourceStreamReader):
    def __init__(self, reader: FileReader, settle_seconds: float) -> None:
        self.reader, self.settle, self.last = reader, settle_seconds, 0

    def initialOffset(self) -> dict:
        return {"micros": 0}

    def latestOffset(self) -> dict:
        settled = int((time.time() - self.settle) * 1e6)
        times = [f.micros for f in listed(self.reader.path, self.reader.pattern) if f.micros <= settled]
        self.last = max([self.last, *times])
        return {"micros": self.last}

    def partitions(self, start: dict, end: dict) -> Sequence[Files]:
        files = [f for f in listed(self.reader.path, self.reader.pattern) if start["micros"] < f.micros <= end["micros"]]
        return self.reader.dealt(files)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept of what has been read."""


@dataclass
class Written(D.WriterCommitMessage):
    """The names of the books of one task."""

    names: tuple[str, ...]


class BookWriter(D.DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, book_bytes: int) -> None:
        self.path, self.overwrite, self.book_bytes, self.run = path, overwrite, book_bytes, uuid.uuid4().hex

    def _beside(self, root: str) -> str:
        return f"{root.rstrip('/')}/{_BESIDE}-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _system(self.path)
        system.create_dir(self._beside(root), recursive=True)
        names: list[str] = []
        held: list[tuple[str, str]] = []
        size = 0

        def put() -> None:
            nonlocal held, size
            names.append(f"{self.run}-{TaskContext.get().taskAttemptId():06d}-{len(names):06d}.epub")
            with system.open_output_stream(f"{self._beside(root)}/{names[-1]}") as out:
                out.write(book(held))
            held, size = [], 0

        for batch in iterator:
            for row in batch.select(_WRITTEN).to_pylist():
                name, text = (row[k] or "" for k in _WRITTEN)
                if held and size + len(text) > self.book_bytes:
                    put()
                held.append((name, text))
                size += len(text)
        if held:
            put()
        return Written(tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        system.create_dir(root, recursive=True)
        before = listed(self.path) if self.overwrite else []
        for message in messages:
            for name in message.names if message else ():
                system.move(f"{self._beside(root)}/{name}", f"{root.rstrip('/')}/{name}")
        for file in before:
            system.delete_file(file.path)
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_system(self.path))

    def _clear(self, system: pafs.FileSystem, root: str) -> None:
        if system.get_file_info(self._beside(root)).type == pafs.FileType.Directory:
            system.delete_dir(self._beside(root))


def book(chapters: Sequence[tuple[str, str]]) -> bytes:
    """An e-book of (name, page) chapters; a page stands as it is. Equal names stay apart by the chapters' numbers."""
    out = io.BytesIO()
    entry = lambda k, name: f"OEBPS/{k:06d}/{name}.xhtml"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        for k, (name, page) in enumerate(chapters):
            package.writestr(entry(k, name), page)
        items = "".join(f'<item id="c{k}" href="{escape(entry(k, name).removeprefix("OEBPS/"))}" media-type="application/xhtml+xml"/>' for k, (name, _) in enumerate(chapters))
        spine = "".join(f'<itemref idref="c{k}"/>' for k in range(len(chapters)))
        package.writestr("OEBPS/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><manifest>{items}</manifest><spine>{spine}</spine></package>')
        package.writestr("META-INF/container.xml", '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
    return out.getvalue()


class FileSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "glotta_files"

    def schema(self) -> str:
        return READ_SCHEMA

    def _path(self) -> str:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]] if "path" in self.options else []
        if len(paths) != 1:
            raise ValueError("glotta_files takes one path")
        return paths[0]

    def _number(self, name: str, default: float) -> float:
        found = float(self.options.get(name, default))
        if not found >= 0:
            raise ValueError(f"{name} is a number of zero or more")
        return found

    def reader(self, schema: T.StructType) -> FileReader:
        return FileReader(self._path(), self.options.get("pattern", "*"), int(self._number("split_bytes", 64 * 2**20)), int(self._number("most_bytes", 100 * 2**20)), int(self._number("least_tasks", 1)))

    def streamReader(self, schema: T.StructType) -> FileStream:
        return FileStream(self.reader(schema), self._number("settle_seconds", 2))

    def writer(self, schema: T.StructType, overwrite: bool) -> BookWriter:
        types = {f.name: f.dataType for f in schema.fields}
        if any(types.get(name) != T.StringType() for name in _WRITTEN):
            raise ValueError("books are written from the text columns name and text")
        return BookWriter(self._path(), overwrite, int(self._number("book_bytes", 16 * 2**20)))


def register(spark: SparkSession) -> None:
    """Name the data source in a session and let Spark hand it filters."""
    spark.dataSource.register(FileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
