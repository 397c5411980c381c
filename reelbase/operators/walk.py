"""Splitting files into elements: the only step that looks at bytes in Python.

A file becomes rows (path, parser, n, up, id, place, at, size, body): its boxes, chunks, frames, packets or directory entries, with
the numbers of their ancestors in ``up`` and their ids in ``place``. What the bytes of an element mean is left to column expressions
(``audio``, ``video``, ``image``, ...). Element 0 has the head of the file as its body and the file's length as its size.

A splitter reads by offset and skips media data, so a file of any length costs a few small reads; the ``hash`` element's ``at`` has the
bytes that were read. What a splitter may spend on a file is its ``Budget``. Where it ends before the file does, what was found is kept and
an ``error`` element that begins with ``left out`` names the limit that was met; ``EXACT`` has no limits. A splitter that meets nonsense
stops with what it has, and a file that can't be opened or read has an ``error`` element only.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 5_000_000


@dataclass(frozen=True)
class Budget:
    """What a splitter may spend on a file; None is without limit."""

    body: int | None = LONGEST  #: bytes of an element's body, else it is left out
    inflated: int | None = LONGEST  #: bytes of what a packed body becomes, else it is cut
    entries: int | None = 200  #: entries of an image's directory
    tags: int | None = 10  #: FLV tags, until those that the header announces are seen
    pages: int | None = 64  #: Ogg pages, until each stream's headers are whole
    tail: int | None = 49_000  #: bytes searched for an Ogg file's last pages
    pictures: int | None = 5 << 20  #: bytes of AVI data searched for the first pictures
    program: int | None = 110_000  #: bytes of an MPEG file's beginning
    program_tail: int | None = 500_000  #: bytes of its end

    def over(self, name: str, n: int) -> bool:
        most = getattr(self, name)
        return most is not None and n > most

    def within(self, name: str, n: int) -> int:
        most = getattr(self, name)
        return n if most is None else min(n, most)


EXACT = Budget(**dict.fromkeys(("body", "inflated", "entries", "tags", "pages", "tail", "pictures", "program", "program_tail")))
HEAD = {"snes": 66_100, "ac3": 2_016, "xml": 65_536, "cue": 65_536, "mpeg": 4, "gameboy": 400}
SCHEMA = "path string, parser string, n int, up array<int>, id string, place string, at long, size long, body binary"
Read = Callable[[int, int], bytes]


class Tree:
    def __init__(self, read: Read, size: int, budget: Budget = Budget()):
        self.read, self.size, self.rows, self.budget, self.met = read, size, [], budget, Counter()

    def over(self, name: str, n: int) -> bool:
        """Whether n is over that limit, which is then noted."""
        if over := self.budget.over(name, n):
            self.met[name] += 1
        return over

    def add(self, up: int | None, ident: str, at: int, size: int, body: bytes | None = None) -> int:
        ups, place = ([], "") if up is None else ([*self.rows[up][0], up], self.rows[up][2])
        self.rows.append((ups, ident, f"{place}/{ident}" if place else ident, at, size, body))
        return len(self.rows) - 1

    def leaf(self, up: int, ident: str, at: int, start: int, size: int) -> int:
        return self.add(up, ident, at, size, None if self.over("body", size) else self.read(start, size))

    def inflated(self, b: bytes) -> bytes:
        d, most = zlib.decompressobj(), self.budget.inflated
        out = d.decompress(b, most or 0)
        self.met["inflated"] += bool(most and d.unconsumed_tail and d.decompress(d.unconsumed_tail, 1))
        return out

    def boxes(self, up: int, at: int, end: int, header, inner: dict[str, int], skip=(), stop=lambda ident, n: False) -> None:
        """Boxes from ``at`` on. header gives (id, start of the body, its size, next box); inner has the containers and where their boxes begin."""
        k = 0
        while at < end and (h := header(self.read, at, end)):
            ident, start, size, after = h
            if stop(ident, k := k + 1) or after <= at:
                return
            if ident in inner:
                self.boxes(self.add(up, ident, at, size), start + inner[ident], min(start + size, end), header, inner, skip, stop)
            elif ident in skip:
                self.add(up, ident, at, size)
            else:
                self.leaf(up, ident, at, start, size)
            at = after


def latin(b: bytes) -> str:
    return b.decode("latin-1")


def riff_head(read: Read, at: int, end: int):
    if len(b := read(at, 12)) < 8:
        return None
    size = struct.unpack("<I", b[4:8])[0]
    ident = latin(b[8:12]) if b[:4] in (b"LIST", b"RIFF", b"SDSS") else latin(b[:4])
    return ident, at + 8, size, at + 8 + size + (size & 1)


def riff(t: Tree) -> None:
    seen = [0]

    def enough(ident: str, _: int) -> bool:  # five pictures show the aspect
        seen[0] += ident.endswith("dc")
        return seen[0] > 5

    kids = {k: 4 for k in ("AVI ", "WAVE", "hdrl", "strl", "odml", "INFO")}
    t.boxes(0, 0, t.size, riff_head, kids, ("movi", "data", "JUNK", "idx1"))
    for n, (_, ident, _, at, size, _) in enumerate(list(t.rows)):
        if ident == "movi":
            t.boxes(n, at + 12, at + t.budget.within("pictures", 8 + size), riff_head, {}, (), enough)
            if not seen[0]:
                t.over("pictures", 8 + size)


def iff_head(read: Read, at: int, end: int):
    if len(b := read(at, 8)) < 8:
        return None
    size = struct.unpack(">I", b[4:])[0]
    return latin(b[:4]), at + 8, size, at + 8 + size + (size & 1)


def atom_head(read: Read, at: int, end: int):
    if len(b := read(at, 16)) < 8:
        return None
    size, head = struct.unpack(">I", b[:4])[0], 8
    if size == 1 and len(b) == 16:
        size, head = struct.unpack(">Q", b[8:])[0], 16
    size = end - at if size == 0 else size
    return (latin(b[4:8]), at + head, size - head, at + size) if size >= head else None


ATOMS = dict.fromkeys(("moov", "trak", "mdia", "minf", "stbl", "dinf", "udta", "ilst", "cmov", "rmra", "rmda"), 0) | {"meta": 4}


def atoms(t: Tree) -> None:
    t.boxes(0, 0, t.size, atom_head, ATOMS, ("mdat", "free", "skip", "wide", "PICT"))
    for n, (_, ident, place, _, _, body) in enumerate(list(t.rows)):
        if ident[0:1] == "©" and place.endswith(f"udta/{ident}") and body:
            at = 0
            while at + 4 <= len(body):
                size, language = struct.unpack(">HH", body[at : at + 4])
                t.add(n, "text", language, size, body[at + 4 : at + 4 + size])
                at += 4 + size
        if ident == "cmvd" and body:
            packed = next((x for x in (body[4:], body) if x[:1] == b"\x78"), b"")
            whole = t.inflated(packed)
            t.read = lambda at, size, whole=whole: whole[at : at + size]
            t.boxes(n, 0, len(whole), atom_head, ATOMS)


def varint(b: bytes, keep: bool) -> tuple[int, int]:
    """(value, length); the length marker stays in the value of an id."""
    if not b or not b[0]:
        raise ValueError("no EBML number")
    n = 9 - b[0].bit_length()
    value = int.from_bytes(b[:n], "big")
    return (value if keep else value & (1 << 7 * n) - 1), n


def ebml_head(read: Read, at: int, end: int):
    if len(b := read(at, 12)) < 2:
        return None
    ident, n = varint(b, True)
    size, m = varint(b[n:], False)
    if size == (1 << 7 * m) - 1:  # unknown
        size = end - at - n - m if ident in (0x18538067, 0x1F43B675) else 0
    return f"{ident:X}", at + n + m, size, at + n + m + size


# Matroska's containers, below the segment.
EBML_INNER = dict.fromkeys("114D9B74 4DBB 1549A966 1654AE6B AE E0 E1 1043A770 45B9 B6 80 1941A469 61A7 1254C367 7373 63C0 67C8".split(), 0)
SEGMENT, SEEK, CLUSTER, CUES = "18538067", "114D9B74", "1F43B675", "1C53BB6B"


def ebml(t: Tree) -> None:
    head = ebml_head(t.read, 0, t.size)
    t.leaf(0, head[0], 0, head[1], head[2])
    ident, start, size, _ = ebml_head(t.read, head[3], t.size)
    if ident != SEGMENT:
        return
    top, at, end = t.add(0, ident, head[3], size), start, min(start + size, t.size)
    done, sought = set(), []
    while at < end and (h := ebml_head(t.read, at, end)):
        if h[0] == CLUSTER and sought:
            break
        done.add(at)
        t.boxes(top, at, min(h[3], end), ebml_head, EBML_INNER, (CLUSTER, CUES, "EC"))
        if h[0] == SEEK:
            sought += [start + int.from_bytes(r[5] or b"", "big") for r in t.rows if r[2] == f"{SEGMENT}/{SEEK}/4DBB/53AC"]
        at = h[3]
    for at in sought:
        if at not in done and at < end and (h := ebml_head(t.read, at, end)):
            done.add(at)
            t.boxes(top, at, min(h[3], end), ebml_head, EBML_INNER, (CLUSTER, CUES, "EC"))


def asf_head(read: Read, at: int, end: int):
    if len(b := read(at, 24)) < 24:
        return None
    size = struct.unpack("<Q", b[16:])[0]
    return (b[:16].hex(), at + 24, size - 24, at + size) if size >= 24 else None


# GUIDs, as stored, of the header object and of its extension.
ASF_HEADER, ASF_EXTENSION = "3026b2758e66cf11a6d900aa0062ce6c", "b503bf5f2ea9cf118ee300c00c205365"


def asf(t: Tree) -> None:
    h = asf_head(t.read, 0, t.size)
    t.boxes(0, 0, min(h[3], t.size), asf_head, {ASF_HEADER: 6, ASF_EXTENSION: 22})
    for n, (_, ident, _, _, _, b) in enumerate(list(t.rows)):
        if b and ident in ASF_LISTS:
            ASF_LISTS[ident](t, n, b)


def asf_text(b: bytes) -> str:
    return b[: len(b) & ~1].decode("utf-16-le", "replace").replace("\0", "")


def descriptors(t: Tree, up: int, b: bytes) -> None:
    """Extended content description: ``at`` is stream 0, ``size`` the value's type."""
    at = 2
    for _ in range(int.from_bytes(b[:2], "little")):
        n = int.from_bytes(b[at : at + 2], "little")
        kind, m = struct.unpack("<HH", b[at + 2 + n : at + 6 + n])
        t.add(up, asf_text(b[at + 2 : at + 2 + n]), 0, kind, b[at + 6 + n : at + 6 + n + m])
        at += 6 + n + m


def metadata(t: Tree, up: int, b: bytes) -> None:
    """Metadata of streams: ``at`` is the stream's number, ``size`` the value's type."""
    at = 2
    for _ in range(int.from_bytes(b[:2], "little")):
        stream, n, kind, m = struct.unpack("<2xHHHI", b[at : at + 12])
        t.add(up, asf_text(b[at + 12 : at + 12 + n]), stream, kind, b[at + 12 + n : at + 12 + n + m])
        at += 12 + n + m


def language_list(t: Tree, up: int, b: bytes) -> None:
    """Languages: ``at`` is the index that streams refer to."""
    at = 2
    for k in range(int.from_bytes(b[:2], "little")):
        t.add(up, "language", k, b[at], asf_text(b[at + 1 : at + 1 + b[at]]).encode())
        at += 1 + b[at]


# GUIDs, as stored, of the lists: extended content description, metadata, languages.
ASF_LISTS = {"40a4d0d207e3d21197f000a0c95ea850": descriptors, "eacbf8c5af5b77488467aa8c44fa4cca": metadata, "a946437ce0effc4bb229393ede415c85": language_list}


def real(t: Tree) -> None:
    def head(read: Read, at: int, end: int):
        b = read(at, 8)
        return (latin(b[:4]), at + 10, size - 10, at + size) if len(b) == 8 and (size := struct.unpack(">I", b[4:])[0]) >= 10 else None

    t.boxes(0, 0, t.size, head, {}, ("DATA", "INDX"))


def flv(t: Tree) -> None:
    at, k, announced = 13, 0, int.from_bytes(t.read(4, 1), "big")
    unseen = {kind for kind, bit in (("audio", 4), ("video", 1)) if announced & bit}
    while len(b := t.read(at, 11)) == 11:
        if t.budget.over("tags", k := k + 1):
            t.met["tags"] += bool(unseen)
            return
        size = int.from_bytes(b[1:4], "big")
        kind = {8: "audio", 9: "video", 18: "meta"}.get(b[0], "other")
        unseen.discard(kind)
        body = t.read(at + 11, size if kind == "meta" else 16)
        n = t.add(0, kind, at, size, body)
        if kind == "meta":
            amf(t, n, body)
        at += 15 + size


def amf(t: Tree, up: int, b: bytes) -> None:
    """Numbers, booleans and strings of arrays in script data, each under its key, its type byte first."""

    def length(b: bytes) -> int:
        return {0: 9, 1: 2, 2: 3 + int.from_bytes(b[1:3], "big"), 5: 1, 6: 1, 11: 11}.get(b[0], 0)

    while b:
        if b[0] in (3, 8):
            b = b[1 + 4 * (b[0] == 8) :]
            while len(b) > 3 and b[:3] != b"\0\0\t":
                k = 2 + int.from_bytes(b[:2], "big")
                if b[k] in (3, 8) or not (m := length(b[k:])):
                    return amf(t, up, b[k:]) if b[k] in (3, 8) else None
                t.add(up, latin(b[2:k]), 0, m, b[k : k + m])
                b = b[k + m :]
            b = b[3:]
        elif m := length(b):
            b = b[m:]
        else:
            return


def png(t: Tree) -> None:
    def head(read: Read, at: int, end: int):
        b = read(at, 8)
        return (latin(b[4:]), at + 8, size, at + 12 + size) if len(b) == 8 and (size := struct.unpack(">I", b[:4])[0]) < 2**31 else None

    t.boxes(0, 8, t.size, head, {}, ("IDAT",))
    for k, (ups, ident, place, at, size, body) in enumerate(t.rows):
        if body and ident in ("zTXt", "iTXt"):
            name, _, rest = body.partition(b"\0")
            if ident == "iTXt":
                packed, method, rest = rest[0], rest[1], rest[2:].partition(b"\0")[2].partition(b"\0")[2]
            else:
                packed, method, rest = 1, rest[0], rest[1:]
            value = (b"\0" + (t.inflated(rest) if packed else rest)) if not (packed and method) else b""
            t.rows[k] = (ups, ident, place, at, size, name + value)


def jpeg(t: Tree) -> None:
    at = 2
    while len(b := t.read(at, 4)) == 4 and b[0] == 0xFF and b[1] != 0xDA:
        if b[1] == 0xFF:
            at += 1
            continue
        size = int.from_bytes(b[2:], "big") - 2
        n = t.leaf(0, f"{b[1]:02X}", at, at + 4, size)
        body = t.rows[n][5] or b""
        if b[1] == 0xE1 and body.startswith(b"Exif\0"):
            directories(t, n, lambda at, size, body=body: body[6 + at : 6 + at + size])
        if b[1] == 0xED and body.startswith(b"Photoshop 3.0\0"):
            resources(t, n, body[14:])
        at += 4 + size


WIDTHS = (0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8)
#: Directories that an entry points to.
SUB = {("Image", 0x8769): "EXIF", ("Image", 0x8825): "GPS", ("EXIF", 0xA005): "Interop"}


def directories(t: Tree, up: int, read: Read) -> None:
    """TIFF directories. An entry's body is its value with numbers in big-endian order, ``at`` its type and ``size`` its count."""
    order = {b"II": "little", b"MM": "big"}.get(read(0, 2))
    todo, seen = [("Image", int.from_bytes(read(4, 4), order or "big"), read, order)] if order else [], set()
    while todo:
        name, base, read_, order_ = todo.pop(0)
        if base and (name, base) not in seen:
            seen.add((name, base))
            todo += directory(t, up, name, base, read_, order_)


def directory(t: Tree, up: int, name: str, base: int, read: Read, order: str) -> list[tuple]:
    """Entries of one directory; the directories that it leads to."""
    number = lambda at, n: int.from_bytes(read(at, n), order)
    count, found, more = number(base, 2), {}, []
    n = t.add(up, name, base, count)
    many = t.budget.within("entries", count)
    t.over("entries", many + bool(read(base + 2 + 12 * many, 12)) if many < count else 0)
    for k in range(min(many, len(read(base + 2, 12 * many)) // 12)):
        at = base + 2 + 12 * k
        tag, kind, many = number(at, 2), number(at + 2, 2), number(at + 4, 4)
        if not 0 < kind < len(WIDTHS):
            continue
        size = WIDTHS[kind] * many
        where = at + 8 if size <= 4 else number(at + 8, 4)
        body = None if t.over("body", size) else read(where, size)
        unit = 4 if kind in (5, 10) else WIDTHS[kind]
        if order == "little" and unit > 1 and body:
            body = np.frombuffer(body[: len(body) // unit * unit], dtype=f"<u{unit}").astype(f">u{unit}").tobytes()
        found[tag] = int.from_bytes(body[:4], "big") if kind in (3, 4) and many == 1 and body else None
        t.add(n, f"{tag:04X}", kind, many, body)
        if tag == 0x927C and name == "EXIF":
            more.append(("MakerNote", *maker_note(where, read, order)))
    more += [(SUB[name, tag], value, read, order) for tag, value in found.items() if (name, tag) in SUB and value]
    if name == "Image" and 0 < (after := number(base + 2 + 12 * count, 4)):
        more.append(("Thumbnail", after, read, order))
    if name == "Thumbnail" and found.get(0x0201) and found.get(0x0202):
        t.add(n, "jpeg", found[0x0201], found[0x0202], None if t.over("body", found[0x0202]) else read(found[0x0201], found[0x0202]))
    return more


def maker_note(at: int, read: Read, order: str) -> tuple[int, Read, str]:
    """Where a maker's directory begins, and how it is read: some have offsets or a byte order of their own."""
    label = read(at, 12)
    if label.startswith(b"Nikon\0\2"):
        inner = lambda x, n: read(at + 10 + x, n)
        own = "little" if inner(0, 2) == b"II" else "big"
        return int.from_bytes(inner(4, 4), own), inner, own
    if label.startswith(b"FUJIFILM"):
        return int.from_bytes(label[8:12], "little"), lambda x, n: read(at + x, n), "little"
    return at + (8 if label.startswith((b"Nikon\0\1", b"OLYMP")) else 0), read, order


def tiff(t: Tree) -> None:
    directories(t, 0, t.read)
    for _, ident, _, kind, many, body in list(t.rows):
        if ident in ("83BB", "8649") and body:
            (resources if body.startswith(b"8BIM") else datasets)(t, 0, body)


def resources(t: Tree, up: int, b: bytes) -> None:
    """Image resource blocks; block 0404 holds IPTC datasets."""
    at = 0
    while b[at : at + 4] == b"8BIM":
        kind, name = int.from_bytes(b[at + 4 : at + 6], "big"), b[at + 6] + 1
        at += 6 + name + (name & 1)
        size = int.from_bytes(b[at : at + 4], "big")
        if kind == 0x0404:
            datasets(t, up, b[at + 4 : at + 4 + size])
        at += 4 + size + (size & 1)


def datasets(t: Tree, up: int, b: bytes) -> None:
    n, at = t.add(up, "IPTC", 0, len(b)), 0
    while b[at : at + 1] == b"\x1c" and at + 5 <= len(b):
        size = int.from_bytes(b[at + 3 : at + 5], "big")
        t.add(n, f"{b[at + 1]}:{b[at + 2]}", at, size, b[at + 5 : at + 5 + size])
        at += 5 + size


def flac(t: Tree) -> None:
    at, last = 4, False
    while not last and len(b := t.read(at, 4)) == 4:
        last, kind, size = b[0] >> 7, b[0] & 127, int.from_bytes(b[1:], "big")
        n = t.leaf(0, {0: "STREAMINFO", 4: "VORBIS_COMMENT", 6: "PICTURE"}.get(kind, str(kind)), at, at + 4, size)
        if kind == 4:
            comments(t, n, t.rows[n][5] or b"")
        at += 4 + size


def comments(t: Tree, up: int, b: bytes) -> None:
    at = 4 + int.from_bytes(b[:4], "little")
    many, at = int.from_bytes(b[at : at + 4], "little"), at + 4
    while many and at + 4 <= len(b):
        size = int.from_bytes(b[at : at + 4], "little")
        t.add(up, "comment", at, size, b[at + 4 : at + 4 + size])
        at, many = at + 4 + size, many - 1


def ogg(t: Tree) -> None:
    """First pages with the packets that they complete (``at`` is the stream's serial number), then the pages of the tail."""

    def page(at: int):
        b = t.read(at, 27)
        if len(b) < 27 or b[:4] != b"OggS":
            return None
        table = t.read(at + 27, b[26])
        return b, table, at + 27 + b[26], at + 27 + b[26] + sum(table)

    at, open_, made, k_ = 0, {}, {}, 0
    while p := page(at):
        if t.budget.over("pages", k_ := k_ + 1):
            t.met["pages"] += any(made.get(x, 0) < 3 for x in open_)
            break
        b, table, start, after = p
        serial = struct.unpack("<I", b[14:18])[0]
        t.add(0, "page", at, after - at, b)
        if made.get(serial, 0) < 3:
            data, k = t.read(start, sum(table)), 0
            for lace in table:
                open_[serial] = open_.get(serial, b"") + data[k : k + lace]
                k += lace
                if lace < 255 and made.get(serial, 0) < 3:
                    packet, made[serial] = open_.pop(serial), made.get(serial, 0) + 1
                    n = t.add(0, "packet", serial, made[serial] - 1, packet)
                    if packet[:7] in (b"\x03vorbis", b"\x81theora"):
                        comments(t, n, packet[7:])
        at = after
    at = max(at, t.size - t.budget.within("tail", t.size))
    tail = t.read(at, t.size - at) if t.size > at else b""
    up, k = t.add(0, "tail", at, len(tail)), tail.find(b"OggS")
    while k >= 0:
        t.add(up, "page", at + k, 27, tail[k : k + 27])
        k = tail.find(b"OggS", k + 27)


def syncsafe(b: bytes) -> int:
    n = 0
    for x in b:
        if x > 127:
            raise ValueError("no syncsafe number")
        n = n << 7 | x
    return n


def id3(t: Tree) -> None:
    """Frames of an ID3v2 tag (``at`` has the frame's flags), 4096 bytes of what follows it, and the last 128 bytes."""
    b, after = t.read(0, 10), 0
    if b[:3] == b"ID3" and b[3] in (2, 3, 4) and len(b) == 10:
        major, flags, size = b[3], b[5], syncsafe(b[6:])
        n, data = t.add(0, f"ID3v2.{major}", 0, size + 10, b), t.read(10, size)
        after = 10 + size + 10 * bool(major == 4 and flags & 16)
        if flags & 128 and major < 4:
            data = data.replace(b"\xff\0", b"\xff")
        at = (4 + int.from_bytes(data[:4], "big") if major == 3 else syncsafe(data[:4])) if flags & 64 and major > 2 else 0
        wide = 3 if major == 2 else 4
        while at + 6 <= len(data) and data[at : at + wide].rstrip(b" \0").isalnum():
            raw = data[at + wide : at + 2 * wide]
            length = int.from_bytes(raw, "big")
            if major == 4 and max(raw) < 128:
                safe = syncsafe(raw)
                follows = data[at + 10 + safe : at + 10 + safe + 4]  # some writers store plain numbers
                length = safe if not follows.strip(b"\0") or follows.isalnum() else length
            head = 6 if major == 2 else 10
            fl = int.from_bytes(data[at + 8 : at + 10], "big") if major > 2 else 0
            t.add(n, latin(data[at : at + wide]), fl, length, frame_body(t, data[at + head : at + head + length], major, fl))
            at += head + length
    start = t.read(after, 4096)
    t.add(0, "sync", after, len(start), start)
    t.add(0, "tail", max(0, t.size - 128), 128, t.read(max(0, t.size - 128), 128))


def frame_body(t: Tree, b: bytes, major: int, flags: int) -> bytes | None:
    """Undo what the flags say; null for encrypted frames."""
    packed, hidden, grouped = (flags & 0x80, flags & 0x40, flags & 0x20) if major == 3 else (flags & 8, flags & 4, flags & 0x40)
    if hidden:
        return None
    b = b[bool(grouped) + 4 * bool(packed if major == 3 else major == 4 and flags & 1) :]
    if major == 4 and flags & 2:
        b = b.replace(b"\xff\0", b"\xff")
    return t.inflated(b) if packed else b


def mpeg(t: Tree) -> None:
    """Start codes (or starts of packets in a transport stream) with what follows them, at both ends."""
    head = t.read(0, t.budget.within("program", t.size))
    step = 188 if head[:1] == b"G" and head[188:189] in (b"G", b"") else 0
    parts = [("head", 0, head)]
    if t.size > len(head):
        at = max(len(head), t.size - t.budget.within("program_tail", t.size))
        at += -at % step if step else 0
        parts.append(("tail", at, t.read(at, t.size - at)))
    for name, base, b in parts:
        up = t.add(0, ("ts-" if step else "") + name, base, len(b))
        if step:
            for at in range(0, len(b) - 187, step):
                pid, start = int.from_bytes(b[at + 1 : at + 3], "big") & 0x1FFF, at + 4 + (b[at + 3] >> 5 & 1 and 1 + b[at + 4])
                if b[at + 1] & 0x40 and b[at] == 0x47 and b[start : start + 3] == b"\0\0\1":
                    t.add(up, "pes", pid, b[start + 3], b[start + 3 : at + 188][:32])
        else:
            at = b.find(b"\0\0\1")
            while 0 <= at < len(b) - 3:
                if b[at + 3] >= 0xB0:
                    t.add(up, f"{b[at + 3]:02X}", base + at, 0, b[at + 4 : at + 28])
                at = b.find(b"\0\0\1", at + 3)


# What marks a disc image.
MARKERS = (b"SVCD", b"TRACKS.SVD", b"ENTRIES.SVD", b"INFO.VCD", b"ENTRIES.VCD", b"UDF", b"VIDEO_TS", b"OSTA UDF Compliant", b"CD-XA001", b"VIDEO_CD", b"SUPERVCD")


def disc(t: Tree) -> None:
    near = t.read(32_768, 60_000)
    far = t.read(32_768, 610_000) if b"UDF" in near else near
    for m in MARKERS:
        if m in (far if m in (b"VIDEO_TS", b"OSTA UDF Compliant") else near):
            t.add(0, latin(m), 0, len(m))


def ifo(t: Tree) -> None:
    """A DVD title set's information: its attributes, and the programme chains with their cells (24 bytes each, playing time at 4)."""
    if t.read(0, 12) != b"DVDVIDEO-VTS":
        return
    number = lambda at, n: int.from_bytes(t.read(at, n), "big")
    t.add(0, "attributes", 0x200, 0x116, t.read(0x200, 0x116))
    table = number(0xCC, 4) * 2048
    for k in range(number(table, 2) if table else 0):
        pgc = table + number(table + 8 + 8 * k + 4, 4)
        n = t.add(0, "pgc", pgc, number(pgc + 3, 1), t.read(pgc, 236))
        cells = pgc + number(pgc + 0xE8, 2)
        for c in range(number(pgc + 3, 1)):
            t.add(n, "cell", cells + 24 * c, c, t.read(cells + 24 * c, 24))


def voc(t: Tree) -> None:
    if t.read(0, 4) == b"FORM":
        t.boxes(0, 12, t.size, iff_head, {}, ("SSND",))
    if t.read(0, 19) == b"Creative Voice File":
        at = int.from_bytes(t.read(20, 2), "little")
        while len(b := t.read(at, 20)) >= 4 and b[0]:
            t.add(0, f"voc{b[0]}", at, int.from_bytes(b[1:4], "little"), b[4:])
            at += 4 + int.from_bytes(b[1:4], "little")


@dataclass(frozen=True)
class Grammar:
    """A chunked format as data, from which its splitter is made: where the first chunk begins, and how a chunk's head is laid out.

    A head of ``head`` bytes has an id of ``id_size`` bytes at ``id_at`` and a size of ``size_bytes`` at ``size_at`` in ``order`` ("big" or
    "little"); ``counted`` of the head's bytes are in the size; a chunk with its head fills a multiple of ``align`` bytes. Chunks named in ``inner`` hold chunks,
    behind so many bytes of their own; those in ``skip`` aren't read. Ids are texts, or hexadecimal with ``hexadecimal``.
    """

    start: int = 0
    head: int = 8
    id_at: int = 0
    id_size: int = 4
    size_at: int = 4
    size_bytes: int = 4
    order: str = "big"
    counted: int = 0
    align: int = 1
    inner: tuple[tuple[str, int], ...] = ()
    skip: tuple[str, ...] = ()
    hexadecimal: bool = False

    def chunk(self, read: Read, at: int, end: int):
        b = read(at, self.head)
        if len(b) < self.head:
            return None
        ident, size = b[self.id_at : self.id_at + self.id_size], int.from_bytes(b[self.size_at : self.size_at + self.size_bytes], self.order) - self.counted
        whole = self.head + size
        return (ident.hex() if self.hexadecimal else latin(ident), at + self.head, size, at + whole + -whole % self.align) if size >= 0 else None

    def split(self, t: Tree) -> None:
        t.boxes(0, self.start, t.size, self.chunk, dict(self.inner), self.skip)


SPLIT = {
    "mp3": id3, "m4a": atoms, "mp4": atoms, "ogg": ogg, "ogm": ogg, "pcm": voc, "asf": asf, "flv": flv, "mkv": ebml, "mpeg": mpeg, "real": real,
    "riff": riff, "iso": disc, "jpeg": jpeg, "png": png, "tiff": tiff, "flac": flac, "ifo": ifo,
}


def word_sum(b: bytes) -> int:
    """The sum of the whole 64-bit little-endian words."""
    n = len(b) // 8
    if n > 500:  # fewer are summed sooner than an array is made
        return int(np.frombuffer(b[: n * 8], dtype="<u8").sum(dtype=np.uint64))
    return sum(struct.unpack_from(f"<{n}Q", b))


def file_hash(read: Read, size: int) -> bytes:
    """Size plus the whole 64-bit little-endian words of both ends, in 16 hexadecimal digits."""
    start = word_sum(read(0, 65_536))
    end = word_sum(read(size - 65_536, 65_536)) if size > 65_536 else start
    return b"%016x" % ((size + start + end) % 2**64)


def split(parser: str | None, read: Read, size: int, budget: Budget = Budget(), grammars: dict[str, Grammar] = {}) -> list[tuple]:  # noqa: B006
    t, failed = Tree(read, size, budget), False
    t.add(None, "", 0, size, read(0, HEAD.get(parser, 512)))
    splitter = grammars[parser].split if parser in grammars else SPLIT.get(parser)
    if splitter:
        try:
            splitter(t)
        except (ValueError, IndexError, TypeError, struct.error, zlib.error) as wrong:
            t.add(0, "error", 0, 0, f"{type(wrong).__name__}: {wrong}".encode())
            failed = True
    if (met := +t.met) and not failed:
        t.add(0, "error", 0, 0, ("left out: " + ", ".join(f"{name} over {getattr(budget, name)} ({n})" for name, n in sorted(met.items()))).encode())
    digest = file_hash(read, size)
    t.add(0, "hash", getattr(read, "bytes", 0), 16, digest)
    return t.rows


class Reader:
    """Reads by offset, in blocks that are kept for a while: splitters ask for many neighbouring bytes. ``bytes`` and ``reads`` say what it took."""

    def __init__(self, fetch: Read, size: int, block: int = 1 << 15, kept: int = 16):
        self.fetch, self.size, self.block, self.kept, self.blocks, self.bytes, self.reads = fetch, size, block, kept, {}, 0, 0

    def take(self, at: int, n: int) -> bytes:
        b = self.fetch(at, min(n, self.size - at))
        self.bytes, self.reads = self.bytes + len(b), self.reads + 1
        return b

    def __call__(self, at: int, n: int) -> bytes:
        if not 0 <= at < self.size or n <= 0:
            return b""
        if self.size <= self.block:  # one block: the whole file
            if not self.blocks:
                self.blocks[0] = self.take(0, self.block)
            return self.blocks[0][at : at + n]
        n = min(n, self.size - at)
        first, last = at // self.block, (at + n - 1) // self.block
        if last - first >= self.kept // 2:
            return self.take(at, n)
        for k in range(first, last + 1):
            if k not in self.blocks:
                while len(self.blocks) >= self.kept:
                    del self.blocks[next(iter(self.blocks))]
                self.blocks[k] = self.take(k * self.block, self.block)
        return b"".join(self.blocks[k] for k in range(first, last + 1))[at - first * self.block :][:n]


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path that all executors reach, and its name there: a mounted path, or a store that Arrow knows (s3, gs, hdfs)."""
    if path.startswith(("file:", "/")):
        name = path.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + name.lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


@contextmanager
def opened(path: str) -> Iterator[Reader]:
    """Reads by offset in a file."""
    store, name = located(path)
    with store.open_input_file(name) as f:
        size = f.size()
        yield Reader(lambda at, n: f.read_at(n, at), size)


def unreadable(wrong: Exception) -> list[tuple]:
    """The elements of a file that can't be opened or read."""
    t = Tree(lambda at, n: b"", 0)
    t.add(None, "", 0, 0, b"")
    t.add(0, "error", 0, 0, f"{type(wrong).__name__}: {wrong}".encode())
    return t.rows


def file_elements(path: str, parser: str, content: bytes | None, budget: Budget, grammars: dict[str, Grammar]) -> list[tuple]:
    """Elements of a file's content, or of the file at the path; what can't be read becomes an ``error`` element."""
    if content is not None:
        return split(parser, Reader(lambda at, n: content[at : at + n], len(content)), len(content), budget, grammars)
    try:
        with opened(path) as read:
            return split(parser, read, read.size, budget, grammars)
    except (OSError, pa.ArrowException) as wrong:
        return unreadable(wrong)


def _batches(batches: Iterator[pa.RecordBatch], budget: Budget, grammars: dict[str, Grammar]) -> Iterator[pa.RecordBatch]:
    names = ("path", "parser", "n", "up", "id", "place", "at", "size", "body")

    def made(files: list[tuple[str, str, int]], held: list[tuple]) -> pa.RecordBatch:
        ups, ids, places, ats, sizes, bodies = zip(*held, strict=True)
        counts = np.fromiter((x[2] for x in files), np.int32, len(files))
        of = pa.array(np.repeat(np.arange(len(files), dtype=np.int32), counts))
        numbers = np.arange(len(held), dtype=np.int32) - np.repeat(np.cumsum(counts, dtype=np.int32) - counts, counts)
        ends = np.cumsum(np.fromiter(chain((0,), map(len, ups)), np.int32, len(ups) + 1), dtype=np.int32)
        up = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(ups), np.int32, int(ends[-1]))))
        columns = [
            pa.array([x[0] for x in files], pa.string()).take(of), pa.array([x[1] for x in files], pa.string()).take(of), pa.array(numbers), up, pa.array(ids, pa.string()), pa.array(places, pa.string()), pa.array(ats, pa.int64()),
            pa.array([min(x, 2**62) for x in sizes], pa.int64()), pa.array(bodies, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=list(names))

    for batch in batches:
        files, held, weight = [], [], 0
        for path, parser, content in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.columns[2], strict=True):
            if parser is None:
                continue
            rows = file_elements(path, parser, content.as_py(), budget, grammars)
            files.append((path, parser, len(rows)))
            held += rows
            weight += 100 * len(rows) + sum([len(r[5]) for r in rows if r[5]])
            if weight > 16_000_000:
                yield made(files, held)
                files, held, weight = [], [], 0
        if held:
            yield made(files, held)


def elements(files: DataFrame, kinds=(), budget: Budget = Budget(), grammars: dict[str, Grammar] | None = None) -> DataFrame:
    """Elements of routed files (path, parser, content); files without content are read by offset at their path.

    ``grammars`` has those of one's own parsers, by name; they are sent to the workers as data.

    Files without a parser, or with another than ``kinds``, go no further. They are dropped behind the scan and not by a filter on
    ``parser``: as a filter, the routing's long expression would be taken into every constraint that the planner infers.
    """
    parser = F.when(F.col("parser").isin(*kinds), F.col("parser")) if kinds else F.col("parser")
    content = F.when(F.col("parser").isNotNull(), F.col("content")) if "content" in files.columns else F.lit(None).cast("binary")
    return files.select("path", parser.alias("parser"), content.alias("content")).mapInArrow(lambda batches: _batches(batches, budget, grammars or {}), SCHEMA)
