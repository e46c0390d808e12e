"""Files as documents: routing, size gates, and the text of common formats.

Files come from Spark's ``binaryFile`` source. Python opens packages only as far as their
entries (``package_entries``); what the entries say is worked out by column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotta.functions import text as X
from glotta.sources.packages import MOST_ENTRY_BYTES
from glotta.sources.packages import entries as read_entries

# Size gates in bytes, entries that a format's text stands in.
REJECT_BYTES, WARN_BYTES = 100 * 2**20, 25 * 2**20
ENTRY_PATTERNS = {
    "docx": r"^word/document\.xml$",
    "pptx": r"^ppt/(slides/slide|notesSlides/notesSlide)[0-9]+\.xml$",
    "xlsx": r"^xl/(sharedStrings|worksheets/sheet[0-9]+)\.xml$",
    "odt": r"^content\.xml$",
    "epub": r"(?i)\.x?html?$",
}
EXTENSIONS = ["pdf", "docx", "pptx", "xlsx", "odt", "epub", "rtf", "doc", "ppt", "txt", "md", "csv", "html", "htm", "png", "jpg", "jpeg"]


@dataclass(frozen=True)
class Limits:
    """How much of a file counts: characters of a text, sheets of a workbook, chapters of an e-book; None: all."""

    chars: int | None = None
    sheets: int | None = None
    chapters: int | None = None


ALL = Limits()
#: What an import into a browser takes.
BROWSER = Limits(400_000, 20, 60)


def _cut(text: Column, most: int | None) -> Column:
    return text if most is None else F.substring(text, 1, most)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content, kind, accepted, large) of all files below a path, by Spark's binary file source."""
    return described(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def described(files: DataFrame) -> DataFrame:
    """(path, length, content, kind, accepted, large) of files (path, length, content), those of ``sources.datasource`` or a stream of them as well.

    Files of over 100 MB are not accepted; their length is known without reading them. The kind
    is the extension, or what the first bytes say.
    """
    gates = {"accepted": F.col("length") <= REJECT_BYTES, "large": F.col("length") > WARN_BYTES}
    return files.select("path", "length", "content").withColumns({"kind": kind_of(F.col("path"), F.col("content")), **gates})


def kind_of(path: Column, content: Column) -> Column:
    """The extension if it is known; else what the first bytes say, for old binary documents by the name of the program in them."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring(content, F.lit(1), F.lit(8)))
    first = lambda n: F.decode(F.substring(content, F.lit(1), F.lit(n)), "ISO-8859-1")
    slides = first(4096).contains("PowerPoint") | first(8192).contains("\0".join("PowerPoint"))
    by_bytes = (
        F.when(head.startswith("25504446"), "pdf")
        .when(head.startswith("504B"), "zip")
        .when(first(64).rlike(r"\A\s*\{\s*\\rtf"), "rtf")
        .when(head.startswith("D0CF"), F.when(slides, "ppt").otherwise("doc"))
        .when(head.startswith("89504E47"), "png")
        .when(head.startswith("FFD8FF"), "jpg")
        .otherwise("txt")
    )
    return F.when(extension.isin(EXTENSIONS), extension).otherwise(by_bytes)


def plain_texts(files: DataFrame, limits: Limits = ALL) -> DataFrame:
    """(path, text) of text files, as UTF-8; web pages are read as they stand."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.where("accepted and kind in ('txt', 'md', 'csv', 'html', 'htm')").select("path", _cut(text, limits.chars).alias("text"))


def package_entries(files: DataFrame, most_bytes: int = MOST_ENTRY_BYTES) -> DataFrame:
    """(path, kind, entry, entry_no, xml, error): the readable entries of zip packages, with the number in their names.

    A package without a known extension is what its entries show. A package or entry that can't
    be read (cut off, encrypted, an unknown compression, over ``most_bytes``) has a row with what is wrong and no
    xml, one with a wrong checksum has both. Names count without regard to case.
    """
    wanted = re.compile("|".join(f"(?:{p})" if p[:4] != "(?i)" else f"(?:{p[4:]})" for p in ENTRY_PATTERNS.values()), re.I)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for name, body, error in read_entries(content.as_py(), wanted, most_bytes):  # one entry at a time is held
                    row = (path, name, None if body is None else body.decode("utf-8", "replace"), error)
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], names=["path", "entry", "xml", "error"])

    packages = files.where("accepted and kind in ('docx', 'pptx', 'xlsx', 'odt', 'epub', 'zip')")
    entries = packages.select("path", "content").mapInArrow(over, "path string, entry string, xml string, error string")
    shown = F.lit(None).cast("string")
    for kind, pattern in reversed(ENTRY_PATTERNS.items()):
        shown = F.when(F.col("entry").rlike("(?i)" + pattern.removeprefix("(?i)")), F.lit(kind)).otherwise(shown)
    number = F.coalesce(F.regexp_extract("entry", r"([0-9]+)[^0-9]*$", 1).try_cast("int"), F.lit(0))
    return entries.withColumns({"kind": shown, "entry_no": number})


def _runs(xml: Column, tag: str) -> Column:
    """The contents of all elements of a tag, joined."""
    return X.unescape(F.array_join(F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1)), ""))


def _lines(xml: Column, end: str, tag: str) -> Column:
    """A line for each part up to the end tag, made of its runs."""
    line = lambda part: X.trimmed(F.replace(_runs(part, tag), F.lit("\t"), F.lit(" ")))
    return F.array_join(F.filter(F.transform(F.split(xml, f"</{end}>"), line), lambda x: x != ""), "\n")


def entry_text(kind: Column, xml: Column) -> Column:
    """The text of one entry of a package; a document's table cells where its paragraphs have under 40 characters."""
    no_tags = lambda x: X.unescape(F.regexp_replace(x, "<[^>]+>", ""))
    odt = F.array_join(F.filter(F.transform(F.split(xml, "</text:[ph]>"), lambda p: X.trimmed(no_tags(p))), lambda p: p != ""), "\n")
    paragraphs, cells = _lines(xml, "w:p", "w:t"), _lines(xml, "w:tc", "w:t")
    docx = F.when((F.length(X.trimmed(paragraphs)) < 40) & (cells != ""), cells).otherwise(paragraphs)
    return F.when(kind == "docx", docx).when(kind == "pptx", _lines(xml, "a:p", "a:t")).when(kind == "odt", odt).when(kind == "epub", X.html_to_text(xml))


def shared_strings(xml: Column) -> Column:
    """The strings of a workbook, in the order of their numbers."""
    items = F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?s)<si>(.*?)</si>"), F.lit(1))
    return F.transform(items, lambda x: _runs(x, "t"))


def sheet_rows(xml: Column, strings: Column) -> Column:
    """The rows of a sheet that have cells: texts by their numbers in ``strings``, inline texts and values, by tabs."""
    pattern = r"(?s)<c\b([^>]*?)>(.*?)</c>|<c\b([^>]*?)/>"
    group = lambda row, k: F.regexp_extract_all(row, F.lit(pattern), F.lit(k))
    text_tag, value_tag = r"(?s)<t(?:\s[^>]*)?>(.*?)</t>", r"(?s)<v>(.*?)</v>"

    def cell(attributes: Column, inner: Column) -> Column:
        number = F.regexp_extract(inner, value_tag, 1)
        at = F.when(number == "", -1).otherwise(number.try_cast("int"))
        named = F.when((at >= 0) & (at < F.size(strings)), F.get(strings, at))
        own = X.unescape(F.when(inner.rlike(text_tag), F.regexp_extract(inner, text_tag, 1)).otherwise(number))
        return F.when(F.regexp_extract(attributes, r't="([^"]+)"', 1) == "s", named).otherwise(F.when(X.trimmed(own) != "", own))

    def line(row: Column) -> Column:
        attributes = F.zip_with(group(row, 1), group(row, 3), lambda a, b: F.when(a != "", a).otherwise(b))
        return F.array_compact(F.zip_with(attributes, group(row, 2), cell))

    rows = F.filter(F.transform(F.split(xml, "</row>"), line), lambda x: F.size(x) > 0)
    return F.transform(rows, lambda x: F.array_join(x, "\t"))


def workbook_texts(entries: DataFrame, limits: Limits = ALL) -> DataFrame:
    """(path, kind, text) of workbooks: the rows of their sheets, or all their strings where those have under 20 characters."""
    is_strings = F.lower("entry").endswith("sharedstrings.xml")
    sheets = F.array_sort(F.collect_list(F.when(~is_strings, F.struct("entry_no", "entry", "xml")))).alias("sheets")
    books = entries.where("kind = 'xlsx' and xml is not null").groupBy("path", "kind").agg(F.max(F.when(is_strings, F.col("xml"))).alias("strings"), sheets)
    books = books.withColumn("strings", shared_strings(F.col("strings")))
    used = F.col("sheets") if limits.sheets is None else F.slice("sheets", 1, limits.sheets)
    rows = F.array_join(F.flatten(F.transform(used, lambda x: sheet_rows(x["xml"], F.col("strings")))), "\n")
    every = F.array_join(F.filter("strings", lambda x: x != ""), "\n")
    books = books.select("path", "kind", "strings", rows.alias("rows"))
    return books.select("path", "kind", F.when((F.length(X.trimmed(F.col("rows"))) < 20) & (F.size("strings") > 0), every).otherwise(F.col("rows")).alias("text"))


def package_texts(files: DataFrame, limits: Limits = ALL) -> DataFrame:
    """(path, kind, text) of office packages and e-books: entries in natural order, a blank line between.

    Slides with under 60 characters in all give way to their notes, if there are any. Chapters
    whose path begins with toc or nav, in one of the two usual folders or none, are left out.
    """
    entries = package_entries(files)
    navigation = F.col("entry").rlike(r"(?i)^(META-INF|OEBPS)?/?(toc|nav)(?![0-9A-Za-z_])") & (F.col("kind") == "epub")
    notes = F.lower("entry").contains("notesslide")
    part = F.struct("entry_no", "entry", entry_text(F.col("kind"), F.col("xml")).alias("text"), notes.alias("notes"))
    grouped = entries.where("kind != 'xlsx' and xml is not null").where(~navigation).groupBy("path", "kind").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    texts = lambda own: F.filter(F.transform(F.filter("parts", lambda x: x["notes"] == own), lambda x: x["text"]), lambda x: x != "")
    own, beside = texts(F.lit(False)), F.array_join(texts(F.lit(True)), "\n\n")
    if limits.chapters is not None:
        own = F.when(F.col("kind") == "epub", F.slice(own, 1, limits.chapters)).otherwise(own)
    grouped = grouped.select("path", "kind", F.array_join(own, "\n\n").alias("own"), beside.alias("beside"))
    text = F.when((F.col("kind") == "pptx") & (F.length(X.trimmed(F.col("own"))) < 60) & (F.col("beside") != ""), F.col("beside")).otherwise(F.col("own"))
    every = grouped.select("path", "kind", text.alias("text")).unionByName(workbook_texts(entries, limits))
    return every.select("path", "kind", _cut(F.col("text"), limits.chars).alias("text"))


def broken_packages(files: DataFrame) -> DataFrame:
    """(path, entry, error) of the packages and entries that can't be read."""
    return package_entries(files).where("error is not null").select("path", "entry", "error")


# Destinations of RTF that are no text, in the order in which they are taken out.
RTF_DESTINATIONS = """fonttbl colortbl stylesheet info listtable listoverridetable revtbl rsidtbl generator falt fname panose docvar mmathPr
themedata colorschememapping latentstyles datastore mmath filetbl pgdsctbl""".split()


#: Destinations of each name that are taken out of one text; None: all.
RTF_MOST_OF_A_NAME = 40
_RTF_BLANKS = "[\\t\\n\\x0B\\f\\r \xa0]*"


def _group_end(depth: np.ndarray, k: int) -> int | None:
    """The number of the brace that ends the group which brace ``k`` begins; the search widens, so it costs what the group is long."""
    size = 64
    while True:
        below = np.flatnonzero(depth[k : k + size] < depth[k])
        if len(below):
            return k + int(below[0])
        if k + size >= len(depth):
            return None
        size *= 4


def without_destinations(body: str) -> str:
    r"""RTF with a blank for each destination: ``\name`` and the group in braces after it, of any depth, or what follows up to a semicolon.

    The running depth over the places of all braces tells where a group ends. One without an end
    reaches to the end of the text.
    """
    for name in RTF_DESTINATIONS:
        if f"\\{name}" not in body:
            continue
        marks = np.frombuffer(body.encode("latin-1", "replace"), np.uint8)
        braces = np.flatnonzero((marks == ord("{")) | (marks == ord("}")))
        depth = np.cumsum(np.where(marks[braces] == ord("{"), 1, -1))
        kept, at, n = [], 0, 0
        for m in re.finditer(rf"\\{name}(?![0-9A-Za-z_]){_RTF_BLANKS}", body):
            if m.start() < at:
                continue
            if body.startswith("{", m.end()):
                last = _group_end(depth, int(np.searchsorted(braces, m.end())))
                end = len(body) if last is None else int(braces[last]) + 1
            else:
                end = body.find(";", m.end()) + 1 or len(body)
            kept += [body[at : m.start()], " "]
            at, n = end, n + 1
            if n == RTF_MOST_OF_A_NAME:
                break
        body = "".join([*kept, body[at:]])
    return body


@F.arrow_udf(T.StringType())
def _without_destinations(bodies: pa.Array) -> pa.Array:
    return pa.array((None if x is None else without_destinations(x) for x in bodies.to_pylist()), pa.string())


def rtf_texts(files: DataFrame) -> DataFrame:
    """(path, text) of RTF files; one that doesn't begin as RTF has no row."""
    body = F.decode("content", "ISO-8859-1")
    return files.where("accepted and kind = 'rtf'").where(body.rlike(r"\A\s*\{?\s*\\rtf")).select("path", rtf_plain(body).alias("text"))


def _resolved(text: Column, pattern: str, char: Callable[[Column], Column]) -> Column:
    """The text with what the pattern's group stands for in its place."""
    news = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), char)
    return F.array_join(F.zip_with(F.split(text, pattern, -1), news, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def rtf_plain(body: Column) -> Column:
    r"""The text of RTF: destinations out (a group in braces, or up to a semicolon), ``\'hh`` and ``\uN`` as characters,
    control words as blanks (``\par`` among them), lines with a letter kept."""
    out = _without_destinations(body)
    out = _resolved(out, r"\\'([0-9a-fA-F]{2})", lambda h: F.decode(F.unhex(h), "ISO-8859-1"))
    code = lambda n: F.pmod(n.cast("bigint") + 65536, F.lit(65536)).cast("int")
    char = lambda n: F.when(code(n).between(0xD800, 0xDFFF), "").otherwise(F.decode(F.unhex(F.lpad(F.hex(code(n)), 8, "0")), "UTF-32"))
    out = _resolved(out, r"\\u(-?[0-9]+)\??", char)
    for pattern, new in [(r"\\[a-z]+-?[0-9]* ?", " "), (r"[{}]", ""), (r"\\\*[^\s;]+;?", ""), (r"\r?\n[ \t]+", "\n")]:
        out = F.regexp_replace(out, pattern, new)
    lines = F.transform(F.split(out, "\n"), lambda x: X.trimmed(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\\+$", "")))
    return F.array_join(F.filter(lines, lambda x: x.rlike("[A-Za-zÀ-ÿ]")), "\n")


# Lines of old binary documents that are no text.
JUNK_LINE = r"(?i)^(?:[A-Za-z]{1,2}[0-9]?|[0-9.]+|Normal|Times New Roman|Arial|Symbol|Wingdings|Courier New|Calibri|Cambria|Helvetica|Verdana|Tahoma|Segoe UI|Microsoft|Office|Word|PowerPoint|Document|SummaryInformation|WordDocument|Root Entry|1Table|0Table|Data|ObjectPool|\\*[a-z]+)$"


def is_noise(line: Column) -> Column:
    """Whether a line is short, a known name, poor in letters (under 45 %), or more than half one character."""
    letters = F.length(F.regexp_replace(line, "[^A-Za-zÀ-ÿ]", ""))
    chars = F.split(line, "")
    most = F.array_max(F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c))))
    return (F.length(line) < 3) | line.rlike(JUNK_LINE) | (letters == 0) | (letters < 0.45 * F.length(line)) | (most > 0.5 * F.length(line))


def legacy_texts(files: DataFrame) -> DataFrame:
    """(path, text) of old binary documents: readable runs in 8-bit or 16-bit text, whichever has more letters, without noise lines."""
    body = F.decode("content", "ISO-8859-1")
    letters = lambda x: F.length(F.regexp_replace(x, "[^A-Za-zÀ-ÿ]", ""))

    def lines(pattern: str) -> Column:
        # 16-bit text of Western letters has a zero after every byte
        found = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), lambda x: X.trimmed(F.regexp_replace(x, r"\x00", "")))
        return F.array_join(F.filter(found, lambda x: ~is_noise(x)), "\n")

    narrow, wide, size = lines(r"[\t -~À-ÿ]{4,}"), lines(r"(?:[\t -~À-ÿ]\x00){4,}"), letters
    best = F.when(size(F.col("wide")) > size(F.col("narrow")), F.col("wide")).otherwise(F.col("narrow"))
    rows = files.where("accepted and kind in ('doc', 'ppt')").select("path", narrow.alias("narrow"), wide.alias("wide"))
    return rows.select("path", best.alias("text")).where(F.length("text") >= 20)


def texts_of(files: DataFrame, limits: Limits = ALL) -> DataFrame:
    """(path, kind, text) of all files whose format is known; files without text have no row."""
    parts = [plain_texts(files, limits).withColumn("kind", F.lit("txt")), package_texts(files, limits), rtf_texts(files).withColumn("kind", F.lit("rtf")), legacy_texts(files).withColumn("kind", F.lit("ole"))]
    out = parts[0].select("path", "kind", "text")
    for x in parts[1:]:
        out = out.unionByName(x.select("path", "kind", "text"))
    return out.where("text != ''")
