"""Files on disk, broken files, streams, and what the splitter does with nonsense."""

import os
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelbase.functions import binary as B
from reelbase.functions import text as T
from reelbase.operators import id3, relations as R
from reelbase.operators.pick import by_file, head
from reelbase.operators.walk import SPLIT, elements, file_hash, split, syncsafe, varint
from reelbase.plans import fixtures as X
from reelbase.sources.files import list_files, read_elements, unidentified
from reelbase.sources.registry import REGISTRY, Parser, registry, route
from reelbase.streaming.ingest import file_stream, land, landed


def whole(b: bytes):
    return lambda at, n: b[at : at + n] if at >= 0 and n > 0 else b""


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """A few real files of several kinds, and some that nobody takes."""
    root = tmp_path_factory.mktemp("media")
    p, o, c = (X.table(spark, sf, n).limit(6) for n in ("part", "orders", "customer"))
    files = [X.gif(p), X.png(p), X.wav(p), X.flac(o), X.mp4(o), X.avi(o), X.mpeg(o), X.mp3(c, 3), X.ogg(c), X.mkv(X.with_orders(spark, sf).limit(4))]
    for df in files:
        for r in df.collect():
            path = root / r.path.replace("/", "_")
            path.write_bytes(bytes(r.content))
    (root / "junk.mkv").write_bytes(b"junk" * 50)
    (root / "empty.gif").write_bytes(b"")
    return str(root)


def rows(df, *drop):
    return sorted(map(repr, df.drop(*drop).collect()))


def test_ranged_reads_give_the_same_elements(spark, folder):
    a, b = read_elements(spark, folder), read_elements(spark, folder, ranged=True)
    assert rows(a) == rows(b) and a.select("parser").distinct().count() == 9


def box(ident: bytes, body: bytes) -> bytes:
    return struct.pack(">I", 8 + len(body)) + ident + body


def test_files_over_two_gigabytes_are_read_by_offset(spark, tmp_path):
    head = box(b"ftyp", b"isom" + b"\0" * 4 + b"isom")
    mvhd = box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, 1000, 5000) + b"\0" * 80)
    size = 3 << 30
    with open(tmp_path / "film.mp4", "wb") as f:  # sparse: boxes of the standard, written by hand
        f.write(head + struct.pack(">I4sQ", 1, b"mdat", size))
        f.seek(len(head) + size)
        f.write(box(b"moov", mvhd))
    e = R.stage(spark, read_elements(spark, str(tmp_path)))
    row = R.media(e, ("mp4",)).first()
    assert row.parser == "mp4" and row.size > size and row.length == 5.0 and row.status == "ok"


def test_left_out_bodies_are_flagged(spark, folder):
    whole_ = R.media(R.stage(spark, read_elements(spark, folder, kinds=["png"])), ("png",)).first()
    part = R.media(R.stage(spark, read_elements(spark, folder, kinds=["png"], longest=3)), ("png",)).first()
    assert whole_.status == "ok" and part.status == "partial" and part.error.startswith("left out: ")


def test_listing_filters_before_reading(spark, folder):
    files = list_files(spark, folder, suffixes=["gif", "png"], longest=10_000)
    assert "content" not in files.columns
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,10000)" in plan and "content" not in plan.split("ReadSchema")[1][:200]
    assert files.count() == 12


def test_kinds_and_force(spark, folder):
    assert {r.parser for r in read_elements(spark, folder, kinds=["gif"]).select("parser").distinct().collect()} == {"gif"}
    assert {os.path.basename(r.path) for r in unidentified(spark, folder).collect()} == {"junk.mkv"}  # Spark's listing leaves empty files out
    files = spark.createDataFrame([("a.xyz", b"GIF89a\1\0\2\0"), ("b.gif", b"GIF89a\1\0\2\0")], "path string, content binary")
    assert {r.path: r.parser for r in route(files, force=False).collect()} == {"a.xyz": None, "b.gif": "gif"}
    assert {r.path: r.parser for r in route(files, force=True).collect()} == {"a.xyz": "gif", "b.gif": "gif"}


def test_a_stream_lands_what_a_batch_reads(spark, folder, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for _ in range(2):  # the second run finds nothing new
        land(file_stream(spark, folder, per_trigger=7), out, checkpoint).awaitTermination()
    assert rows(landed(spark, out)) == rows(read_elements(spark, folder))


def test_collect_registers_views(spark, folder):
    R.collect(spark, read_elements(spark, folder))
    got = {r.parser: r.n for r in spark.sql("SELECT parser, count(*) AS n FROM media WHERE status = 'ok' GROUP BY parser").collect()}
    assert got == {"gif": 6, "png": 6, "riff": 12, "flac": 6, "mp4": 6, "mpeg": 6, "mp3": 6, "ogg": 6, "mkv": 4}
    assert spark.sql("SELECT count(*) FROM tracks t JOIN media m USING (path) WHERE m.parser = 'mp4'").first()[0] == 12


@pytest.mark.parametrize("kind", sorted(SPLIT))
def test_nonsense_never_raises(kind):
    r = random.Random(kind)
    for n in (0, 1, 3, 10, 11, 30, 127, 128, 500, 5000):
        for _ in range(5):
            b = bytes(r.randrange(256) for _ in range(n))
            found = split(kind, whole(b), len(b))
            assert found[0][3:5] == (0, len(b)) and found[-1][1] == "hash"


def test_cut_files_end_early_but_decode(spark, sf):
    o = X.table(spark, sf, "orders").limit(3)
    for maker, parser in ((X.mp4, "mp4"), (X.avi, "riff"), (X.flac, "flac"), (X.asf, "asf"), (X.ogm, "ogm"), (X.jpeg_exif, "jpeg")):
        full = maker(o).collect()
        cut = [(f"{r.path[:-4]}-{n}{r.path[-4:]}", bytes(r.content)[: len(r.content) * n // 7]) for r in full for n in range(8)]
        files = spark.createDataFrame(cut, "path string, content binary").withColumn("parser", F.lit(parser))
        m = R.media(elements(files), (parser,)).collect()
        assert len(m) == len(cut)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_hash_is_size_plus_words_of_both_ends(b):
    words = struct.unpack(f"<{len(b) // 8}Q", b[: len(b) // 8 * 8])
    assert file_hash(whole(b), len(b)) == b"%016x" % ((len(b) + 2 * sum(words)) % 2**64)


@pytest.mark.parametrize("n", [65535, 65536, 65537, 131072, 131073])
def test_hash_of_long_files(n):
    b = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    ends = b[:65536], b[max(0, n - 65536) :][:65536]
    total = n + sum(sum(struct.unpack(f"<{len(x) // 8}Q", x[: len(x) // 8 * 8])) for x in ends)
    assert file_hash(whole(b), n) == b"%016x" % (total % 2**64)


def test_numbers_round_trip(spark):
    values = [0, 1, 127, 128, 255, 256, 16383, 16384, 2**28 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    r = df.select("v", B.be(B.to_be(F.col("v"), 7), 0, 7).alias("b"), B.le(B.to_le(F.col("v"), 7), 0, 7).alias("l"), B.syncsafe(B.to_syncsafe(F.col("v")), 0).alias("s")).collect()
    assert all(x.v == x.b == x.l == x.s for x in r)
    assert syncsafe(b"\x7f\x7f\x7f\x7f") == 2**28 - 1 and varint(b"\x81", False) == (1, 1) and varint(b"\x40\x02", False) == (2, 2)
    with pytest.raises(ValueError):
        syncsafe(b"\x80")


@pytest.mark.parametrize("major", [2, 3, 4])
def test_id3_texts_round_trip(spark, major):
    texts = ["plain", "é", "日本", "a\0b", "ÿÿ", " x "]
    df = spark.createDataFrame([(f"{i}.mp3", t) for i, t in enumerate(texts)], "path string, t string")
    name = "TT2" if major == 2 else "TIT2"
    for encoding in (1, 3) if major == 4 else (1,):
        tag = id3.id3v2_encode({name: id3.text_body(F.col("t"), encoding)}, major, unsync=major < 4)
        f = id3.frames(elements(df.select("path", tag.alias("content"), F.lit("mp3").alias("parser")))).orderBy("path").collect()
        assert [list(x.texts) for x in f] == [t.split("\0") for t in texts]


def test_id3_other_bodies_round_trip(spark):
    df = spark.createDataFrame([("a.mp3", "é 日", b"\0\xff\xe0pic\0\0", "http://x/y"), ("b.mp3", "", b"", "")], "path string, t string, data binary, u string")
    bodies = {
        "TXXX": id3.described_body(F.col("t"), F.col("u")), "WOAR": id3.url_body(F.col("u")), "WXXX": id3.described_url_body(F.col("t"), F.col("u")),
        "APIC": id3.picture_body(F.col("data"), F.lit("image/png"), F.col("t"), 4),
    }
    tag = id3.id3v2_encode(bodies, 4)
    f = {(x.path, x.frameid): x for x in id3.frames(elements(df.select("path", tag.alias("content"), F.lit("mp3").alias("parser")))).collect()}
    txxx, woar, wxxx, apic = (f["a.mp3", k] for k in ("TXXX", "WOAR", "WXXX", "APIC"))
    assert (txxx.description, list(txxx.texts), woar.url) == ("é 日", ["http://x/y"], "http://x/y")
    # a link's description is in the frame's encoding, the link in Latin-1
    assert (wxxx.description, wxxx.url) == ("é 日", "http://x/y")
    assert (apic.mime, apic.picture_type, apic.description, bytes(apic.data)) == ("image/png", 4, "é 日", b"\0\xff\xe0pic\0\0")
    assert f["b.mp3", "APIC"].picture_type == 4 and f["b.mp3", "WXXX"].url in ("", None)


def test_parsers_of_ones_own(spark, tmp_path):
    """A further kind of picture, with its width in the head; the built-in kinds stay as they are."""
    own = Parser("pix", "image/pix", ("pix",), lambda s, h, n: B.starts(h, b"PIX!"), "image")
    (tmp_path / "a.pix").write_bytes(b"PIX!\x01\x02")
    (tmp_path / "b.bin").write_bytes(b"PIX!\0\7rest")
    (tmp_path / "c.pix").write_bytes(b"GIF89a\3\0\2\0")
    decode = lambda e: by_file(e, width=head(lambda b: B.be(b, 4, 2))).withColumn("mime", F.lit("image/pix"))
    for ranged in (False, True):
        e = read_elements(spark, str(tmp_path), more=[own], ranged=ranged)
        m = R.media(e, ("pix", "gif"), decoders={"pix": decode})
        got = {os.path.basename(r.path): (r.parser, r.mime, r.width, r.status) for r in m.collect()}
        assert got == {"a.pix": ("pix", "image/pix", 258, "ok"), "b.bin": ("pix", "image/pix", 7, "ok"), "c.pix": ("gif", "image/gif", 3, "ok")}
    assert registry(spark, [own]).where("parser = 'pix'").first().place == 25


def test_registry_keeps_the_order_of_trial(spark):
    assert len(REGISTRY) == 25 and REGISTRY[0].name == "mp3" and REGISTRY[-1].name == "flac"
    by = [r.parser for r in registry(spark).where("suffix = 'mp4'").orderBy("place").collect()]
    assert by == ["mp4", "mpeg"]
    assert len({s for p in REGISTRY for s in p.suffixes}) == 51


def test_codes_and_texts_of_odd_input(spark):
    df = spark.createDataFrame([(None,), ("",), ("DIVX",), ("d",), ("0xZZ",), ("99999999999999999999",)], "c string")
    assert [tuple(r.r) for r in df.select(T.resolve_codec(F.col("c")).alias("r")).collect()][:3] == [(None, "Unknown"), (None, ""), ("DIVX", "DivX")]
    r = spark.createDataFrame([("x",), (None,), ("1:2:x",)], "c string").select(T.chapter_seconds(F.col("c")).alias("s"), T.bits_per_second(F.col("c")).alias("b"), T.exif_time(F.col("c")).alias("e")).collect()
    assert all(v is None for x in r for v in x)
