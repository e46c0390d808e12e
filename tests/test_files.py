"""Documents of several formats, built in memory."""

import zipfile

import pytest

from glotta.sources import files, sinks


def package(path, **entries):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, body in entries.items():
            out.writestr(name.replace("__", "/"), body)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "plain.txt").write_text("Une école.", encoding="utf-8")
    package(tmp_path / "a.docx", **{"word/document.xml": "<w:p><w:r><w:t>Bonjour</w:t><w:t xml:space='preserve"
            "'> tous</w:t></w:r></w:p><w:p><w:t>Caf&#233; &amp; th&#xE9;</w:t></w:p>"})
    package(tmp_path / "b.pptx", **{f"ppt/slides/slide{k}.xml": f"<a:p><a:t>Page {k}</a:t></a:p>" for k in (1, 10, 2)})
    cells = '<row><c r="A1" t="s"><v>1</v></c><c t="s"><v>0</v></c></row><row><c t="inlineStr"><is><t>trois &amp;</t></is></c><c><v>4.5</v></c></row><row></row>'
    package(tmp_path / "c.xlsx", **{"xl/sharedStrings.xml": "<si><t>un mot partagé</t></si><si><t>deux</t><t xml:space='preserve'> mots</t></si>", "xl/worksheets/sheet1.xml": cells})
    package(tmp_path / "short.xlsx", **{"xl/sharedStrings.xml": "<si><t>un</t></si><si><t>deux</t></si>", "xl/worksheets/sheet1.xml": '<row><c t="s"><v>0</v></c></row>'})
    package(tmp_path / "notes.pptx", **{"ppt/slides/slide1.xml": "<a:p><a:t>Titre</a:t></a:p>", "ppt/notesSlides/notesSlide1.xml": "<a:p><a:t>Ce que l'on dit</a:t></a:p>"})
    package(tmp_path / "cells.docx", **{"word/document.xml": "<w:tc><w:p><w:t>a</w:t></w:p><w:p><w:t>b</w:t></w:p></w:tc><w:tc><w:p><w:t>c</w:t></w:p></w:tc>"})
    (tmp_path / "page.html").write_text("<p>tel quel</p>", encoding="utf-8")
    package(tmp_path / "navire.epub", **{"navire.xhtml": "<p>Le navire</p>", "OEBPS/nav.xhtml": "<p>menu</p>"})
    package(tmp_path / "d.odt", **{"content.xml": "<text:h>Titre</text:h><text:p>Un <text:span>texte</text:span></text:p>"})
    package(tmp_path / "e.epub", **{"c1.xhtml": "<h1>Chapitre</h1><p>Il pleut.</p>", "nav.xhtml": "<p>menu</p>"})
    package(tmp_path / "unknown.bin", **{"word/document.xml": "<w:p><w:t>caché</w:t></w:p>"})
    (tmp_path / "f.rtf").write_bytes(rb"{\rtf1{\fonttbl{\f0 Arial;}}\f0 L'\'e9t\'e9 arrive\par Fin 1\par 123 \u8211? \u339?}")
    (tmp_path / "g.doc").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"\x00\x01" * 20 + "Une phrase lisible de la vieille archive".encode("latin-1") + b"\x00\x02~~##\x01")
    (tmp_path / "h.ppt").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"\x01\x02" + "Une diapositive très ancienne".encode("utf-16-le") + b"\x03")
    (tmp_path / "broken.docx").write_bytes(b"PK\x03\x04 not a package")
    return tmp_path


def test_texts(spark, folder):
    found = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.texts_of(files.read_files(spark, str(folder))).collect()}
    assert found == {
        "plain.txt": "Une école.", "a.docx": "Bonjour tousCafé & thé", "b.pptx": "Page 1\n\nPage 2\n\nPage 10", "c.xlsx": "deux mots\tun mot partagé\ntrois &\t4.5", "short.xlsx": "un\ndeux", "notes.pptx": "Ce que l'on dit", "cells.docx": "ab\nc", "page.html": "<p>tel quel</p>", "navire.epub": "Le navire",
        "d.odt": "Titre\nUn texte", "e.epub": "Chapitre\nIl pleut.", "unknown.bin": "caché", "f.rtf": "L'été arrive Fin 1 123 – œ", "g.doc": "Une phrase lisible de la vieille archive",
        "h.ppt": "Une diapositive très ancienne",
    }


def test_broken_packages_are_told(spark, folder):
    whole = (folder / "a.docx").read_bytes()
    (folder / "cut.docx").write_bytes(whole.replace(whole[60:70], b"\xff" * 10, 1))
    found = {r["path"].rsplit("/", 1)[1]: r["error"] for r in files.broken_packages(files.read_files(spark, str(folder))).collect()}
    assert set(found) == {"broken.docx", "cut.docx"} and all(found.values())


def test_limits(spark, folder):
    cut = files.plain_texts(files.read_files(spark, str(folder)), files.Limits(chars=3)).where("path like '%plain.txt'").first()
    assert cut["text"] == "Une"


def test_kinds_and_gates(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "REJECT_BYTES", 20)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.read_files(spark, str(folder)).collect()}
    assert rows["plain.txt"]["accepted"] and not rows["a.docx"]["accepted"]
    assert rows["unknown.bin"]["kind"] == "zip" and rows["f.rtf"]["kind"] == "rtf"


def test_anki(spark, tmp_path):
    cards = spark.createDataFrame([("maison", "f", 'the "house"', "La Maison est ici.", "A1", "n"), ("vite", "", "fast", None, "A2", "adv")], "lemma string, gender string, gloss string, example string, level string, pos string")
    sinks.write_anki(cards, str(tmp_path / "out"))
    lines = sorted(x for p in (tmp_path / "out").glob("part-*.csv") for x in p.read_text().splitlines())
    assert lines == ['"maison (f)","the ""house""","La [...] est ici.","glotta_A1_n"', '"vite","fast","","glotta_A2_adv"']
