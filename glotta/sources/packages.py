"""Zip packages as they are found: damaged directories, entries without a size, names in old encodings, sizes out of bounds."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from struct import unpack_from

#: Bytes of one entry, unpacked, that are read; a larger entry is told and has no text.
MOST_ENTRY_BYTES = 256 * 2**20
_PIECE = 2**20
_END, _ENTRY = b"PK\x05\x06", b"PK\x01\x02"
_NEXT = re.compile(rb"PK(?:\x03\x04|\x01\x02|\x05\x06)")


class Damaged(ValueError):
    """What is wrong with a package or an entry."""


@dataclass(frozen=True)
class Entry:
    name: str
    method: int
    packed: int
    size: int
    crc: int
    at: int
    encrypted: bool


def directory(content: bytes) -> list[Entry]:
    """The entries that the directory at the end names, as far as it can be read."""
    end = content.rfind(_END, max(0, len(content) - 22 - 65535), max(0, len(content) - 18))
    if end < 0:
        raise Damaged("no directory: not a package, cut off or protected")
    count, at = unpack_from("<H", content, end + 10)[0], unpack_from("<I", content, end + 16)[0]
    out = []
    for _ in range(count):
        if at + 46 > len(content) or not content.startswith(_ENTRY, at):
            break
        flags, method = unpack_from("<HH", content, at + 8)
        crc, packed, size, name, extra, comment = unpack_from("<IIIHHH", content, at + 16)
        raw = content[at + 46 : at + 46 + name]
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = raw.decode("latin-1")
        out.append(Entry(text, method, packed, size, crc, unpack_from("<I", content, at + 42)[0], bool(flags & 1)))
        at += 46 + name + extra + comment
    return out


def _packed(content: bytes, entry: Entry) -> memoryview:
    """The bytes of an entry; one without a size reaches to the next signature."""
    if entry.at + 30 > len(content):
        raise Damaged("the entry lies beyond the package")
    name, extra = unpack_from("<HH", content, entry.at + 26)
    start = entry.at + 30 + name + extra
    end = start + (entry.packed or entry.size)
    if not entry.packed and (found := _NEXT.search(content, start)):
        end = found.start()
    return memoryview(content)[start : min(end, len(content))]


def read(content: bytes, entry: Entry, most: int = MOST_ENTRY_BYTES) -> bytes:
    """The entry unpacked piece by piece; stored and deflated ones can be read."""
    if entry.encrypted:
        raise Damaged("the entry is encrypted")
    packed = _packed(content, entry)
    if entry.method == 0:
        if len(packed) > most:
            raise Damaged(f"over {most} bytes")
        return bytes(packed)
    if entry.method != 8:
        raise Damaged(f"compression {entry.method} is not known")
    pieces, n, inflate = [], 0, zlib.decompressobj(-15)
    try:
        for a in range(0, len(packed), _PIECE):
            rest = packed[a : a + _PIECE]
            while rest and not inflate.eof:
                pieces.append(inflate.decompress(rest, _PIECE))
                n += len(pieces[-1])
                if n > most:
                    raise Damaged(f"over {most} bytes")
                rest = inflate.unconsumed_tail
    except zlib.error as error:
        raise Damaged(f"the entry can't be unpacked: {error}") from error
    return b"".join([*pieces, inflate.flush()])


def entries(content: bytes, wanted: re.Pattern, most: int = MOST_ENTRY_BYTES) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """(name, bytes, error) of the entries whose names are wanted; an entry with a wrong checksum has both. A package without a directory is one row."""
    try:
        found = directory(content)
    except Damaged as error:
        yield None, None, str(error)
        return
    for entry in found:
        if wanted.search(entry.name):
            try:
                body = read(content, entry, most)
            except Damaged as error:
                yield entry.name, None, str(error)
                continue
            wrong = entry.crc and entry.packed and zlib.crc32(body) != entry.crc
            yield entry.name, body, "the checksum differs" if wrong else None
