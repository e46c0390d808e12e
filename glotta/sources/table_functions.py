"""Table functions that SQL can call.

``package_entries(TABLE(files), entries => '...', most_bytes => n)``: a row for each entry of each
office package or e-book, with all columns of the table but ``content``. The table needs ``content``
(binary) and no column called entry, xml or error. ``entries`` is a pattern of entry names without regard to case (default: those that hold a
format's text), ``most_bytes`` the bytes of an entry that are read. Rows without content give none; what can't be read is a
row with its error. Rows stay in their partitions: no shuffle. One entry at a time is held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from glotta.sources.files import ENTRY_PATTERNS
from glotta.sources.packages import MOST_ENTRY_BYTES
from glotta.sources.packages import entries as read_entries

TEXT_ENTRIES = "|".join(f"(?:{p.removeprefix('(?i)')})" for p in ENTRY_PATTERNS.values())
_NEW = ["entry", "xml", "error"]


class PackageEntries:
    @staticmethod
    def analyze(files: AnalyzeArgument, entries: AnalyzeArgument | None = None, most_bytes: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not files.isTable:
            raise ValueError("package_entries takes a table: package_entries(TABLE(files))")
        names = {f.name.lower(): f.dataType for f in files.dataType.fields}
        if names.get("content") != T.BinaryType():
            raise ValueError("package_entries needs a binary column content")
        if clash := sorted(names.keys() & set(_NEW)):
            raise ValueError(f"package_entries makes columns of these names itself: {', '.join(clash)}")
        for argument, kind in ((entries, str), (most_bytes, int)):
            if argument is not None and not (argument.isConstantExpression and isinstance(argument.value, kind)):
                raise ValueError("entries and most_bytes are constants, a pattern and a number")
        if entries is not None:
            re.compile(entries.value)
        kept = [f for f in files.dataType.fields if f.name.lower() != "content"]
        return AnalyzeResult(T.StructType([*kept, *(T.StructField(x, T.StringType()) for x in _NEW)]))

    def eval(self, files: Row, entries: str = TEXT_ENTRIES, most_bytes: int = MOST_ENTRY_BYTES) -> Iterator[tuple]:
        names = [x.lower() for x in files.__fields__]
        at = names.index("content")
        if files[at] is None:
            return
        kept = (*files[:at], *files[at + 1 :])
        for entry, body, error in read_entries(bytes(files[at]), re.compile(entries, re.I), most_bytes):
            yield (*kept, entry, None if body is None else body.decode("utf-8", "replace"), error)


def register(spark: SparkSession) -> None:
    """Name the table functions in a session."""
    spark.udtf.register("package_entries", udtf(PackageEntries))
