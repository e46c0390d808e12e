"""Packages with each kind of damage."""

import io
import re
import struct
import zipfile

import pytest

from glotta.sources import files, packages

ANY = re.compile("")
XML = "<w:p><w:t>Une phrase lisible, assez longue pour être lue.</w:t></w:p>"


def package(method=zipfile.ZIP_DEFLATED, name="word/document.xml", body=XML, comment=b"", more=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr(name, body)
        for other, text in more:
            z.writestr(other, text)
        z.comment = comment
    return out.getvalue()


def read(content, **options):
    return [(name, None if body is None else body.decode(), error) for name, body, error in packages.entries(content, ANY, **options)]


def unsized(content):
    """The directory says that the entry is empty, as some writers do."""
    at = content.index(b"PK\x01\x02")
    return content[: at + 20] + struct.pack("<I", 0) + content[at + 24 :]


@pytest.mark.parametrize("method", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_whole_packages(method):
    assert read(package(method, comment=b"x" * 60000)) == [("word/document.xml", XML, None)]


@pytest.mark.parametrize("method", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_entries_without_a_size_reach_to_the_next_signature(method):
    assert read(unsized(package(method, more=[("b.xml", "b")]))) == [("word/document.xml", XML, None), ("b.xml", "b", None)]


def test_latin1_names():
    content = package(name="caf_.xml").replace(b"caf_.xml", b"caf\xe9.xml")
    assert [x[0] for x in read(content)] == ["café.xml"]


@pytest.mark.parametrize("content,error", [
    (b"", "no directory"), (b"PK\x03\x04 not a package", "no directory"), (package()[:-10], "no directory"), (package(zipfile.ZIP_LZMA), "compression 14"), (package(zipfile.ZIP_BZIP2), "compression 12"),
])
def test_what_cannot_be_read_is_told(content, error):
    ((_, body, said),) = read(content)
    assert body is None and said.startswith(error)


def test_broken_streams_and_checksums():
    content = package()
    at = content.index(b"document.xml") + len("document.xml")
    ((_, body, error),) = read(content[:at] + b"\xff" * 20 + content[at + 20 :])
    assert body is None and "can't be unpacked" in error
    stored = package(zipfile.ZIP_STORED).replace(b"Une phrase", b"Une phrose", 1)
    ((_, body, error),) = read(stored)
    assert "phrose" in body and error == "the checksum differs"


def test_a_cut_directory_gives_what_is_left():
    content = package(more=[("b.xml", "b")])
    second = content.rindex(b"PK\x01\x02")
    assert [x[0] for x in read(content[:second] + b"XXXX" + content[second + 4 :])] == ["word/document.xml"]


@pytest.mark.parametrize("method", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_entries_have_a_bound(method):
    content = package(method, body="a" * 5_000_000)
    assert read(content, most=1_000_000) == [("word/document.xml", None, "over 1000000 bytes")]
    assert len(read(content, most=5_000_000)[0][1]) == 5_000_000


def test_documents_of_damaged_packages(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(unsized(package()))
    (tmp_path / "b.docx").write_bytes(package(zipfile.ZIP_STORED).replace(b"Une phrase", b"Une phrose", 1))
    (tmp_path / "c.docx").write_bytes(package()[:-10])
    frame = files.read_files(spark, str(tmp_path))
    found = {r["path"][-6:]: r["text"] for r in files.package_texts(frame).collect()}
    assert found == {"a.docx": XML[10:-12], "b.docx": XML[10:-12].replace("phrase", "phrose")}
    assert {r["path"][-6:]: r["error"].split(":")[0] for r in files.broken_packages(frame).collect()} == {"b.docx": "the checksum differs", "c.docx": "no directory"}
