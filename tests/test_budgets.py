"""What a splitter may spend on a file, and that it says so where that isn't enough; hand-made bytes of the standards."""

import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from reelbase.operators import relations as R
from reelbase.operators.walk import EXACT, Budget, Reader, split
from reelbase.sources.files import bytes_read, read_elements


def whole(b: bytes):
    return lambda at, n: b[at : at + n] if at >= 0 and n > 0 else b""


def found(kind: str, b: bytes, budget: Budget = Budget()):
    rows = split(kind, whole(b), len(b), budget)
    return rows, next((r[5].decode() for r in rows if r[1] == "error"), None)


def tiff(count: int, order: str = "<") -> bytes:
    """A directory of so many short entries and a second directory behind them, far from the beginning."""
    entries = b"".join(struct.pack(order + "HHIHH", 0x9000 + k, 3, 1, k, 0) for k in range(count))
    far = 8 + 2 + len(entries) + 4 + 20_000
    more = struct.pack(order + "HHHIIHHIIHHII", 2, 0x0201, 4, 1, far + 100, 0x0202, 4, 1, 5, 0, 0, 0, 0)[:26]
    b = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", count) + entries + struct.pack(order + "I", far)
    return b.ljust(far, b"\0") + more.ljust(100, b"\0") + b"thumb"


@pytest.mark.parametrize("order", "<>")
def test_long_directories_and_far_thumbnails(order):
    for count in (1, 150, 200):
        rows, error = found("tiff", tiff(count, order))
        assert error is None and sum(r[2].startswith("Image/") for r in rows) == count
        assert [r[5] for r in rows if r[2] == "Thumbnail/jpeg"] == [b"thumb"]
    rows, error = found("tiff", tiff(300, order))
    assert error == "left out: entries over 200 (1)" and sum(r[2].startswith("Image/") for r in rows) == 200
    rows, error = found("tiff", tiff(300, order), EXACT)
    assert error is None and sum(r[2].startswith("Image/") for r in rows) == 300


def flv(kinds, flags: int) -> bytes:
    tag = lambda k: bytes([k]) + (4).to_bytes(3, "big") + b"\0" * 7 + b"\x22abc" + (15).to_bytes(4, "big")
    return b"FLV\1" + bytes([flags]) + (9).to_bytes(4, "big") + b"\0" * 4 + b"".join(map(tag, kinds))


def test_late_tags():
    for kinds, flags, partial in (([8] * 12 + [9], 5, True), ([8] * 12, 4, False), ([8, 9] * 20, 5, False)):
        rows, error = found("flv", flv(kinds, flags))
        assert len([r for r in rows if r[1] in ("audio", "video")]) == 10 and (error == "left out: tags over 10 (1)") == partial
        rows, error = found("flv", flv(kinds, flags), EXACT)
        assert len([r for r in rows if r[1] in ("audio", "video")]) == len(kinds) and error is None


def test_long_packed_texts():
    text = b"x" * 8_000_000
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"zTXt", b"Comment\0\0" + zlib.compress(text)) + chunk(b"IEND", b"")
    body = lambda rows: next(r[5] for r in rows if r[1] == "zTXt")
    rows, error = found("png", png)
    assert error == "left out: inflated over 5000000 (1)" and len(body(rows)) == 5_000_000 + len(b"Comment\0")
    rows, error = found("png", png, EXACT)
    assert error is None and body(rows) == b"Comment\0" + text
    exact = b"\x89PNG\r\n\x1a\n" + chunk(b"zTXt", b"Comment\0\0" + zlib.compress(b"y" * 5_000_000))
    assert found("png", exact)[1] is None


def test_status_of_files_beyond_the_budget(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff(300))
    (tmp_path / "b.flv").write_bytes(flv([8] * 12 + [9], 5))
    for budget, status in ((Budget(), "partial"), (EXACT, "ok")):
        for ranged in (False, True):
            m = R.media(read_elements(spark, str(tmp_path), ranged=ranged, budget=budget), ("tiff", "flv")).collect()
            assert [r.status for r in m] == [status] * 2


def test_a_file_that_cannot_be_read_is_a_row(spark, tmp_path):
    """Files vanish between listing and reading, or may not be read; the others come whole."""
    for name in ("a.gif", "b.gif", "c.xyz"):
        (tmp_path / name).write_bytes(b"GIF89a\3\0\2\0")
    from reelbase.operators.walk import elements

    files = spark.createDataFrame([(f"file:{tmp_path}/{n}", "gif") for n in ("a.gif", "gone.gif", "b.gif")], "path string, parser string")
    m = {os.path.basename(r.path): r for r in R.media(elements(files), ("gif",)).collect()}
    assert m["a.gif"].status == m["b.gif"].status == "ok" and m["gone.gif"].status == "error" and m["gone.gif"].error.startswith("FileNotFoundError") and m["gone.gif"].width is None
    listed = read_elements(spark, str(tmp_path), ranged=True)
    os.unlink(tmp_path / "b.gif")
    os.symlink(tmp_path / "nowhere", tmp_path / "b.gif")
    got = {os.path.basename(r.path): r.status for r in R.media(listed, ("gif",)).collect()}
    assert got == {"a.gif": "ok", "c.xyz": "ok"}  # Spark's scan leaves it out, and the job goes on


def test_reader_gives_the_bytes_and_counts_them():
    b = bytes(range(256)) * 1000
    r = Reader(whole(b), len(b), block=1000, kept=4)
    for at, n in ((0, 10), (5, 2000), (990, 20), (255_990, 100), (256_000, 5), (-1, 5), (7, 0), (100, 200_000)):
        assert r(at, n) == (b[at : at + n] if at >= 0 else b"")
    assert (r.reads, r.bytes) == (5, 205_000)  # two runs of many blocks past the kept ones, and three blocks


def box(ident: bytes, body: bytes) -> bytes:
    return struct.pack(">I", 8 + len(body)) + ident + body


def test_bytes_read_stay_within_the_budgets(spark, tmp_path):
    """Large files cost their heads, indexes and both ends (for the hash), whatever their media data; the default reads them by offset."""
    size = 40 << 20
    ebml = b"\x1a\x45\xdf\xa3\x84\x42\x86\x81\x01" + b"\x18\x53\x80\x67\x01" + (size - 100).to_bytes(7, "big") + b"\x1f\x43\xb6\x75\x01" + (size - 200).to_bytes(7, "big")
    heads = {
        "a.jpg": b"\xff\xd8\xff\xe1\0\x10Exif\0\0" + b"\0" * 8 + b"\xff\xda", "b.mp3": b"ID3\4\0\0\0\0\1\0" + b"\0" * 128 + b"\xff\xfb\x90\x64", "c.mkv": ebml,
        "d.mp4": box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, 1000, 5000) + b"\0" * 80)) + struct.pack(">I4sQ", 1, b"mdat", size - 200),
        "e.png": b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", size - 100, b"IDAT"),
    }
    for name, head in heads.items():
        with open(tmp_path / name, "wb") as f:
            f.write(head)
            f.truncate(size)
    got = {os.path.basename(r.path): r for r in bytes_read(read_elements(spark, str(tmp_path))).collect()}
    assert got.keys() == heads.keys() and {r.size for r in got.values()} == {size}
    assert all(r.bytes <= 2 * 65_536 + 100_000 + 3 * 32_768 for r in got.values()), got
    small = bytes_read(read_elements(spark, str(tmp_path), longest=1)).where(F.col("bytes") > size / 10).count()
    assert small == 0
