"""Small media files as column expressions over the tables, so that decoders can be held against plain SQL over the same tables.

Every function gives (path, content); the number in the path is the row's key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import join, let, lv, raw, to_be, to_le, zeros
from ..operators import id3
from ..operators.video import ASF, AUDIO, CONTENT, DESCRIPTION, EXTENDED, EXTENSION, FILE, LANGUAGES, METADATA, STREAM, VIDEO
from ..sources.registry import LOGO_GB, LOGO_GBA

C = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(df: DataFrame, key: str, suffix: str | Column, content: Column, folder: str = "") -> DataFrame:
    end = suffix if isinstance(suffix, Column) else F.lit(suffix)
    return df.select(F.concat(F.lit(folder or key), F.lit("/"), C(key).cast("string"), F.lit("."), end).alias("path"), content.alias("content"))


def all_of(*xs: Column) -> Column:
    return reduce(lambda a, b: F.concat(a, b), xs)


def glued(array: Column) -> Column:
    """An array of bytes as one value."""
    return F.aggregate(array, F.lit(bytearray(b"")), lambda a, x: F.concat(a, x))


# --------------------------------------------------------------------------- images
def gif(p: DataFrame) -> DataFrame:
    return files(p, "p_partkey", "gif", join(b"GIF89a", to_le(C("p_partkey") % 65536, 2), to_le(C("p_size"), 2), b"\0\0\0;"))


def bmp(p: DataFrame) -> DataFrame:
    return files(p, "p_partkey", "bmp", join(b"BM", to_le(58, 4), zeros(4), to_le(54, 4), to_le(40, 4), to_le(C("p_partkey"), 4), to_le(C("p_size"), 4), zeros(32)))


def png_chunk(kind: bytes, body: Column) -> Column:
    return let(body, lambda b: join(to_be(F.length(b), 4), kind, b, to_be(F.crc32(join(kind, b)), 4)))


def png(p: DataFrame) -> DataFrame:
    head = join(to_be(C("p_partkey"), 4), to_be(C("p_size"), 4), b"\x08\x02\0\0\0")
    text = all_of(png_chunk(b"tEXt", join(b"Comment\0", C("p_name"))), png_chunk(b"iTXt", join(b"Software\0\0\0en\0\0", C("p_brand"))))
    return files(p, "p_partkey", "png", join(b"\x89PNG\r\n\x1a\n", png_chunk(b"IHDR", head), text, png_chunk(b"IEND", F.lit(bytearray(b"")))))


def ifd(entries: list[tuple[int, int, Column, Column]], number=to_be, follow: int = 0) -> Column:
    """A directory's entries: tag, type, count and the four value bytes."""
    return join(number(len(entries), 2), *[join(number(tag, 2), number(kind, 2), number(count, 4), value) for tag, kind, count, value in entries], number(follow, 4))


def tiff(p: DataFrame) -> DataFrame:
    """Little-endian for even keys with SHORT values, big-endian for odd ones with LONG values."""
    ii = join(b"II*\0", to_le(8, 4), ifd([(0x100, 3, F.lit(1), join(to_le(C("p_partkey") % 65536, 2), b"\0\0")), (0x101, 3, F.lit(1), join(to_le(C("p_size"), 2), b"\0\0"))], to_le))
    mm = join(b"MM\0*", to_be(8, 4), ifd([(0x100, 4, F.lit(1), to_be(C("p_partkey") % 65536, 4)), (0x101, 4, F.lit(1), to_be(C("p_size"), 4))]))
    return files(p, "p_partkey", "tif", F.when(C("p_partkey") % 2 == 0, ii).otherwise(mm))


def segment(marker: int, body: Column) -> Column:
    return let(body, lambda b: join(bytes([0xFF, marker]), to_be(F.length(b) + 2, 2), b))


def jpeg_exif(o: DataFrame) -> DataFrame:
    """Model, Orientation and an EXIF date."""
    model = join(F.concat(F.lit("CAM-"), C("o_orderpriority")), b"\0")
    date = join(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"), b"\0")
    entries = [(0x110, 2, F.length(model), to_be(100, 4)), (0x112, 3, F.lit(1), join(to_be(C("o_orderkey") % 8 + 1, 2), b"\0\0")), (0x8769, 4, F.lit(1), to_be(200, 4))]
    head = join(b"MM\0*", to_be(8, 4), ifd(entries))  # 8 + 2 + 3 * 12 + 4 = 50 bytes
    sub = ifd([(0x9003, 2, F.length(date), to_be(300, 4)), (0x829A, 5, F.lit(1), to_be(340, 4))])
    pad = lambda b, n: F.substring(F.concat(b, zeros(n)), 1, n)
    exif = all_of(pad(head, 100), pad(model, 100), pad(sub, 100), pad(date, 40), to_be(C("o_orderkey") + 2, 4), to_be(2 * (C("o_orderkey") + 2), 4))
    sof = segment(0xC0, join(b"\x08", to_be(C("o_orderkey") % 1000 + 1, 2), to_be(C("o_orderkey") % 2000 + 1, 2), b"\x03"))
    return files(o, "o_orderkey", "jpg", join(b"\xff\xd8", segment(0xE1, join(b"Exif\0\0", exif)), segment(0xFE, join(C("o_orderstatus"))), sof, b"\xff\xda"))


def jpeg_meanings(p: DataFrame) -> DataFrame:
    """Entries whose numbers stand for something, a user comment, and a directory of interoperability."""
    key = C("p_partkey")
    pad = lambda b, n: F.substring(F.concat(b, zeros(n)), 1, n)
    short = lambda x: join(to_be(x, 2), b"\0\0")
    said = join(b"ASCII\0\0\0", C("p_brand"))
    head = join(b"MM\0*", to_be(8, 4), ifd([(0x128, 3, F.lit(1), short(key % 4)), (0x8769, 4, F.lit(1), to_be(60, 4))]))
    sub = ifd([(0x8822, 3, F.lit(1), short(key % 10)), (0x9101, 7, F.lit(4), join(b"\1\2", to_be(key % 7, 1), b"\0")), (0x9209, 3, F.lit(1), short(key % 34)), (0x9286, 7, F.length(said), to_be(200, 4)), (0xA300, 7, F.lit(1), join(to_be(key % 4, 1), zeros(3))), (0xA005, 4, F.lit(1), to_be(160, 4)), (0xA40C, 3, F.lit(1), short(key % 4))])
    exif = all_of(pad(head, 60), pad(sub, 100), pad(ifd([(0x1001, 4, F.lit(1), to_be(key, 4))]), 40), said)
    return files(p, "p_partkey", "jpg", join(b"\xff\xd8", segment(0xE1, join(b"Exif\0\0", exif)), b"\xff\xda"))


def jpeg_maker(p: DataFrame) -> DataFrame:
    """Notes of Nikon (with an own header), Olympus and Fujifilm by turns."""
    key = C("p_partkey")
    kind = key % 3
    pad = lambda b, n: F.substring(F.concat(b, zeros(n)), 1, n)
    make = F.when(kind == 0, "NIKON CORPORATION").when(kind == 1, "OLYMPUS").otherwise("FUJIFILM")
    nikon = join(b"Nikon\0\2\0\0\0", b"II*\0", to_le(8, 4), ifd([(0x12, 7, F.lit(4), join(to_be(key % 12, 1), b"\1\6\0")), (0x2, 3, F.lit(2), join(to_le(0, 2), to_le(C("p_size"), 2)))], to_le))
    olympus = join(b"OLYMP\0\1\0", ifd([(0x200, 4, F.lit(3), to_be(300, 4)), (0x202, 3, F.lit(1), join(to_be(C("p_size"), 2), b"\0\0"))]))
    fuji = join(b"FUJIFILM", to_le(12, 4), ifd([(0x1011, 3, F.lit(1), join(to_le(C("p_size"), 2), b"\0\0"))], to_le))
    head = join(b"MM\0*", to_be(8, 4), ifd([(0x10F, 2, F.lit(20), to_be(60, 4)), (0x8769, 4, F.lit(1), to_be(90, 4))]))
    sub = ifd([(0x927C, 7, F.lit(100), to_be(120, 4))])
    note = F.when(kind == 0, nikon).when(kind == 1, olympus).otherwise(fuji)
    mode = all_of(to_be(key % 4, 4), to_be(C("p_size"), 4), to_be(key % 5, 4))
    exif = all_of(pad(head, 60), pad(join(make), 30), pad(sub, 30), pad(note, 180), mode)
    return files(p, "p_partkey", "jpg", join(b"\xff\xd8", segment(0xE1, join(b"Exif\0\0", exif)), b"\xff\xda"))


def jpeg_canon(p: DataFrame) -> DataFrame:
    """Canon's notes: two arrays of 16-bit numbers, some of which follow the key."""
    key = C("p_partkey")

    def array(n: int, values: dict[int, Column]) -> Column:
        return all_of(to_be(2 * n, 2), *[to_be(values.get(k, F.lit(0)), 2) for k in range(1, n)])

    level = F.when(key % 3 == 0, 0xFFFF).otherwise(key % 3 - 1)
    bias = F.when(key % 3 == 0, 0xFFE0).when(key % 3 == 1, 0).otherwise(0x0C)
    settings = array(33, {1: key % 3, 2: C("p_size"), 4: key % 7, 6: key % 5, 13: level, 17: key % 4 + 3, 29: F.lit(14), 32: key % 2})
    shot = array(20, {7: key % 7, 9: C("p_size"), 15: bias})
    note = ifd([(0x1, 3, F.lit(33), to_be(300, 4)), (0x4, 3, F.lit(20), to_be(366, 4)), (0x8, 4, F.lit(1), to_be(key, 4))])
    pad = lambda b, n: F.substring(F.concat(b, zeros(n)), 1, n)
    head = join(b"MM\0*", to_be(8, 4), ifd([(0x10F, 2, F.lit(6), to_be(60, 4)), (0x8769, 4, F.lit(1), to_be(90, 4))]))
    exif = all_of(pad(head, 60), pad(join(b"Canon"), 30), pad(ifd([(0x927C, 7, F.lit(100), to_be(120, 4))]), 30), pad(note, 180), settings, shot)
    return files(p, "p_partkey", "jpg", join(b"\xff\xd8", segment(0xE1, join(b"Exif\0\0", exif)), b"\xff\xda"))


def jpeg_iptc(c: DataFrame) -> DataFrame:
    dataset = lambda n, x: join(bytes([0x1C, 2, n]), lv(raw(x), 2))
    block = all_of(dataset(105, C("c_name")), dataset(90, C("c_mktsegment")), dataset(25, F.lower("c_mktsegment")), dataset(25, C("c_nationkey").cast("string")), dataset(80, F.lit("")))
    ps = join(b"Photoshop 3.0\0", b"8BIM\x04\x04\0\0", lv(block))
    sof = segment(0xC2, join(b"\x08", to_be(10, 2), to_be(20, 2), b"\x03"))
    return files(c, "c_custkey", "jpg", join(b"\xff\xd8", segment(0xED, ps), sof, b"\xff\xda"))


# --------------------------------------------------------------------------- audio
RATES = (8000, 11025, 16000, 22050, 44100, 48000)


def rate_of(key: str) -> Column:
    return F.array(*[F.lit(r) for r in RATES])[(C(key) % 6).cast("int")]


def wav(p: DataFrame) -> DataFrame:
    rate = rate_of("p_partkey")
    fmt = join(to_le(1, 2), to_le(2, 2), to_le(rate, 4), to_le(rate * 4, 4), to_le(4, 2), to_le(16, 2))
    body = join(b"WAVE", b"fmt ", lv(fmt, 4, to_le), b"fact", lv(to_le(C("p_size"), 4), 4, to_le), b"data", lv(F.lpad(F.lit(bytearray(b"")), C("p_size") * 4, F.lit(bytearray(b"\1"))), 4, to_le))
    return files(p, "p_partkey", "wav", join(b"RIFF", lv(body, 4, to_le)))


def vorbis_comments(*pairs: Column) -> Column:
    return join(lv("maker", 4, to_le), to_le(len(pairs), 4), *[lv(raw(x), 4, to_le) for x in pairs])


def flac(o: DataFrame) -> DataFrame:
    """Rate, channels and bits by the key, a thousand samples to the order; the comments repeat TITLE once in lower case."""
    rate = rate_of("o_orderkey")
    word = rate * 4096 + (C("o_orderkey") % 8) * 512 + F.lit(15 * 16) + F.floor(C("o_orderkey") * 1000 / F.lit(1 << 32))
    info = join(zeros(10), to_be(word, 4), to_be(C("o_orderkey") * 1000 % F.lit(1 << 32), 4), zeros(16))
    text = vorbis_comments(F.lit("title=earlier"), F.concat(F.lit("TITLE=a=b "), C("o_orderkey").cast("string")), F.concat(F.lit("Artist="), C("o_orderpriority")), F.lit("nothing"), F.concat(F.lit("TRACKNUMBER="), (C("o_orderkey") % 12 + 1).cast("string")), F.lit("TRACKTOTAL=12"))
    picture = lambda kind, data: join(to_be(kind, 4), lv("image/png"), lv("cover"), zeros(16), lv(raw(data)))
    block = lambda kind, body, last=0: join(bytes([kind | last << 7]), lv(body, 3))
    return files(o, "o_orderkey", "flac", join(b"fLaC", block(0, info), block(4, text), block(6, picture(0, F.lit("other"))), block(6, picture(3, C("o_orderstatus"))), block(1, zeros(8), 1)))


def ogg_page(granule: Column, serial: int, number: int, packets: list[Column]) -> Column:
    """A page of whole packets, each shorter than 65,025 bytes."""
    laces = [F.concat(F.lpad(F.lit(bytearray(b"")), (F.floor(F.length(p) / 255)).cast("int"), F.lit(bytearray(b"\xff"))), to_be(F.length(p) % 255, 1)) for p in packets]
    table_ = all_of(*laces) if len(laces) > 1 else laces[0]
    return join(b"OggS\0\0", to_le(granule, 8), to_le(serial, 4), to_le(number, 4), zeros(4), to_be(F.length(table_), 1), table_, *packets)


def vorbis_head(channels, rate, nominal) -> Column:
    return join(b"\x01vorbis", zeros(4), to_be(channels, 1), to_le(rate, 4), zeros(4), to_le(nominal, 4), zeros(4), b"\xb8\x01")


def ogg(c: DataFrame) -> DataFrame:
    text = join(b"\x03vorbis", vorbis_comments(F.concat(F.lit("TITLE="), C("c_name")), F.concat(F.lit("ALBUM="), C("c_mktsegment")), F.concat(F.lit("TRACKNUMBER="), (C("c_custkey") % 20).cast("string"))), b"\x01")
    first = ogg_page(F.lit(0), 7, 0, [vorbis_head(C("c_custkey") % 2 + 1, rate_of("c_custkey"), 128000)])
    second = ogg_page(F.lit(0), 7, 1, [text, raw("\x05vorbis setup")])
    third = ogg_page(C("c_custkey") * 100 + 5, 7, 2, [zeros(40)])
    return files(c, "c_custkey", "ogg", F.concat(first, second, third))


def mp3_frame(key: str) -> Column:
    """A sound frame header whose version, layer, bit rate, rate and mode follow the key."""
    version = F.array(F.lit(0), F.lit(2), F.lit(3))[(C(key) % 3).cast("int")]
    layer = F.array(F.lit(1), F.lit(2), F.lit(3))[(F.floor(C(key) / 3) % 3).cast("int")]
    word = F.lit(0xFFE00001) + version * F.lit(1 << 19) + layer * F.lit(1 << 17) + (C(key) % 14 + 1) * 4096 + (C(key) % 3) * 1024 + (C(key) % 4) * 64
    return to_be(word, 4)


def mp3(c: DataFrame, major: int) -> DataFrame:
    """Tags of a version with the customer's name, segment, track and genre, a comment, a picture and a described text."""
    names = {2: ("TT2", "TP1", "TRK", "TCO", "COM", "TXX", "TYE"), 3: ("TIT2", "TPE1", "TRCK", "TCON", "COMM", "TXXX", "TYER"), 4: ("TIT2", "TPE1", "TRCK", "TCON", "COMM", "TXXX", "TDRC")}[major]
    encoding = {2: 0, 3: 1, 4: 3}[major]
    track = F.concat((C("c_custkey") % 15).cast("string"), F.lit("/15"))
    bodies = {
        names[0]: id3.text_body(C("c_name"), encoding), names[1]: id3.text_body(C("c_mktsegment"), encoding), names[2]: id3.text_body(track, 0), names[3]: id3.text_body(F.concat(F.lit("("), (C("c_custkey") % 60).cast("string"), F.lit(")")), 0),
        names[4]: id3.comment_body(C("c_mktsegment")), names[5]: id3.text_body(F.concat(F.lit("balance\0"), C("c_custkey").cast("string")), 0), names[6]: id3.text_body((1970 + C("c_custkey") % 50).cast("string"), 0),
    }
    picture = join(b"\0PNG\x03back\0", C("c_name")) if major == 2 else join(b"\0image/png\0\x03back\0", C("c_name"))
    bodies["PIC" if major == 2 else "APIC"] = picture
    return files(c, "c_custkey", "mp3", F.concat(id3.id3v2_encode(bodies, major, unsync=major == 3), mp3_frame("c_custkey"), zeros(64)))


def id3v1(p: DataFrame) -> DataFrame:
    tag = id3.id3v1_encode(C("p_name"), C("p_brand"), C("p_type"), F.lit("1999"), F.lit("note"), C("p_size"), C("p_size"))
    return files(p, "p_partkey", "mp3", F.concat(zeros(50), tag))


def ac3(p: DataFrame) -> DataFrame:
    key = C("p_partkey")
    mode, low = key % 8, key % 2
    before = F.when((mode % 2 == 1) & (mode != 1), 2).otherwise(0) + F.when(mode >= 4, 2).otherwise(0) + F.when(mode == 2, 2).otherwise(0)
    word = mode * F.lit(1 << 13) + low * F.pow(F.lit(2), 12 - before).cast("long")
    return files(p, "p_partkey", "ac3", join(b"\x0b\x77\0\0", to_be(key % 3 * 64 + key % 19 * 2, 1), b"\x40", to_be(word, 2), zeros(100)))


def atom(kind: bytes, *xs) -> Column:
    body = join(*xs) if xs else F.lit(bytearray(b""))
    return let(body, lambda b: join(to_be(F.length(b) + 8, 4), kind, b))


def m4a(c: DataFrame) -> DataFrame:
    item = lambda kind, x: atom(kind, atom(b"data", to_be(1, 4), zeros(4), raw(x)))
    ilst = atom(b"ilst", item(b"\xa9nam", C("c_name")), item(b"\xa9ART", C("c_mktsegment")), item(b"\xa9alb", F.lit("Album é")), atom(b"trkn", atom(b"data", zeros(8), to_be(C("c_custkey") % 30, 4))))
    mdhd = atom(b"mdhd", zeros(12), to_be(44100, 4), to_be(C("c_custkey") * 441, 4), zeros(4))
    moov = atom(b"moov", atom(b"trak", atom(b"mdia", mdhd)), atom(b"udta", atom(b"meta", zeros(4), ilst)))
    return files(c, "c_custkey", "m4a", F.concat(atom(b"ftyp", b"M4A ", zeros(4)), moov))


def pcm(p: DataFrame) -> DataFrame:
    """AIFF, AU and VOC by turns."""
    key, rate = C("p_partkey"), rate_of("p_partkey")
    shift = F.floor(F.log2(rate.cast("double")))
    mantissa = (rate * F.pow(F.lit(2.0), 31 - shift)).cast("long")
    aiff = join(b"FORM", lv(join(b"AIFF", b"COMM", lv(join(to_be(2, 2), to_be(C("p_size"), 4), to_be(16, 2), to_be(16383 + shift, 2), to_be(mantissa, 4), zeros(4)))), 4))
    au = join(b".snd", to_be(24, 4), to_be(C("p_size") * 2, 4), to_be(3, 4), to_be(rate, 4), to_be(1, 4))
    voc = join(b"Creative Voice File\x1a", to_le(26, 2), zeros(4), b"\x01", lv(join(b"\x83\0", F.lpad(F.lit(bytearray(b"")), C("p_size"), F.lit(bytearray(b"\x80")))), 3, to_le), b"\0")
    kind = key % 3
    return files(p, "p_partkey", F.when(kind == 0, "aif").when(kind == 1, "au").otherwise("voc"), F.when(kind == 0, aiff).when(kind == 1, au).otherwise(voc))


# --------------------------------------------------------------------------- containers
def el(ident: str, *xs) -> Column:
    body = xs[0] if len(xs) == 1 and isinstance(xs[0], Column) else join(*xs)
    return join(bytes.fromhex(ident), b"\x01", lv(body, 7))


def with_orders(spark: SparkSession, sf_dir: str, customers: int = 0) -> DataFrame:
    """(c_custkey, c_name, c_mktsegment, orders): the orders of a customer by their key; customers without orders are left out."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("orders"))
    return table(spark, sf_dir, "customer").join(o, C("c_custkey") == C("o_custkey")).select("c_custkey", "c_name", "c_mktsegment", "orders")


def mkv(x: DataFrame) -> DataFrame:
    """A track and a chapter for each order, tags for the file, for the first order's track and for its chapter, and a cover."""
    uint = lambda v: to_be(v, 8)

    def track(o, i):
        kind = F.when(o["o_orderkey"] % 3 == 0, 1).when(o["o_orderkey"] % 3 == 1, 2).otherwise(17)
        video = el("E0", el("B0", to_be(o["o_orderkey"] % 2000 + 1, 4)), el("BA", to_be(o["o_orderkey"] % 1000 + 1, 2)))
        sound = el("E1", el("9F", to_be(o["o_orderkey"] % 6 + 1, 1)), el("B5", bytes.fromhex("472c4400")))
        name = el("536E", raw(o["o_orderstatus"]))
        return el("AE", el("D7", to_be(i + 1, 2)), el("73C5", uint(o["o_orderkey"] + 1)), el("83", to_be(kind, 1)), el("22B59C", b"ger"), F.when(kind == 1, el("86", b"V_MPEG4/ISO/AVC")).when(kind == 2, el("86", b"A_AC3")).otherwise(el("86", b"S_TEXT/UTF8")), F.when(kind == 1, F.concat(video, el("23E383", to_be(40_000_000, 4)))).when(kind == 2, sound).otherwise(F.lit(bytearray(b""))), name)

    def chapter(o, i):
        return el("B6", el("73C4", uint(o["o_orderkey"] + F.lit(1 << 40))), el("91", uint(i.cast("long") * 1_500_000_000)), el("80", el("85", raw(F.concat(F.lit("first "), o["o_orderstatus"])))), el("80", el("85", raw(o["o_orderpriority"]))))

    tag = lambda name, value, *more: el("67C8", el("45A3", raw(name)), el("4487", raw(value)), *more)
    one = C("orders")[0]["o_orderkey"]
    info = el("1549A966", el("2AD7B1", to_be(1_000_000, 4)), el("4489", bytes.fromhex("40f5f90000000000")), el("7BA9", raw(C("c_name"))), el("4461", to_be(C("c_custkey") * 1_000_000_000, 8)))
    tags = el("1254C367", el("7373", el("63C0", b""), tag("ARTIST", C("c_mktsegment")), tag("KEYWORDS", "a, b"), tag("ORIGINAL", "x", tag("TITLE", "inner"))), el("7373", el("63C0", el("63C5", uint(one + 1))), tag("COMMENT", C("c_name"))), el("7373", el("63C0", el("63C4", uint(one + F.lit(1 << 40)))), tag("ARTIST", "chapter's")), el("7373", el("63C0", el("63C5", uint(F.lit(1 << 50)))), tag("COMMENT", "nobody's")))
    cover = el("1941A469", el("61A7", el("466E", b"cover.png"), el("4660", b"image/png"), el("465C", raw(C("c_name")))))
    body = all_of(info, el("1654AE6B", glued(F.transform("orders", track))), el("1043A770", el("45B9", glued(F.transform("orders", chapter)))), cover, tags, F.when(C("c_custkey") % 2 == 0, el("1C53BB6B", b"\0")).otherwise(F.lit(bytearray(b""))), el("1F43B675", zeros(16)))
    return files(x, "c_custkey", "mkv", F.concat(el("1A45DFA3", el("4282", b"matroska")), el("18538067", body)))


def mp4(o: DataFrame) -> DataFrame:
    """A video and a sound track; version 1 boxes for odd keys; a title in English and in French."""
    key, odd = C("o_orderkey"), C("o_orderkey") % 2 == 1
    head = lambda ident, w, h: F.when(odd, atom(b"tkhd", b"\1\0\0\0", zeros(4), to_be(2082844800 + key, 4), zeros(8), to_be(ident, 4), zeros(4), zeros(8), zeros(52), to_be(w * 65536, 4), to_be(h * 65536, 4))).otherwise(atom(b"tkhd", zeros(4), to_be(2082844800 + key, 4), zeros(4), to_be(ident, 4), zeros(4), zeros(4), zeros(52), to_be(w * 65536, 4), to_be(h * 65536, 4)))
    media = lambda units: F.when(odd, atom(b"mdhd", b"\1\0\0\0", zeros(16), to_be(600, 4), to_be(units, 8), to_be(0x15C7, 2), zeros(2))).otherwise(atom(b"mdhd", zeros(12), to_be(600, 4), to_be(units, 4), to_be(2, 2), zeros(2)))
    trak = lambda ident, w, h, units, hdlr, codec: atom(b"trak", head(ident, w, h), atom(b"mdia", media(units), atom(b"hdlr", zeros(4), b"mhlr", hdlr), atom(b"minf", atom(b"stbl", atom(b"stsd", zeros(4), to_be(1, 4), to_be(16, 4), codec)))))
    title = atom(b"udta", atom(b"\xa9nam", to_be(F.length(C("o_orderpriority")), 2), to_be(0, 2), C("o_orderpriority"), to_be(3, 2), to_be(1, 2), b"nom"))
    mvhd = atom(b"mvhd", zeros(12), to_be(1000, 4), to_be(key, 4), to_be(65536, 4), to_be(256, 2), zeros(10))
    moov = atom(b"moov", mvhd, trak(1, key % 1900 + 1, key % 1000 + 1, key * 6, b"vide", b"avc1"), trak(2, F.lit(0), F.lit(0), key * 12, b"soun", b"mp4a"), title)
    return files(o, "o_orderkey", "mp4", F.concat(atom(b"ftyp", b"isom", zeros(4)), atom(b"free", b"abc"), moov, atom(b"mdat", zeros(32))))


def avi(o: DataFrame) -> DataFrame:
    """A picture and a sound stream and INFO texts; an index for even keys."""
    key = C("o_orderkey")
    even = lambda b: F.when(F.length(b) % 2 == 1, zeros(1)).otherwise(F.lit(bytearray(b"")))
    chunk = lambda kind, *xs: join(kind, let(join(*xs), lambda b: F.concat(to_le(F.length(b), 4), b, even(b))))
    list_ = lambda kind, *xs: chunk(b"LIST", kind, *xs)
    strh = lambda kind, scale, rate, start, n: chunk(b"strh", kind, zeros(16), to_le(scale, 4), to_le(rate, 4), to_le(start, 4), to_le(n, 4), zeros(20))
    video = chunk(b"strf", to_le(40, 4), to_le(key % 1000 + 16, 4), to_le(key % 500 + 16, 4), zeros(4), b"XVID", zeros(20))
    sound = chunk(b"strf", to_le(0x55, 2), to_le(2, 2), to_le(44100, 4), zeros(4), to_le(1, 2), to_le(16, 2))
    hdrl = list_(b"hdrl", chunk(b"avih", to_le(40000, 4), zeros(52)), list_(b"strl", strh(b"vids", 1, 25, 0, key), video), list_(b"strl", strh(b"auds", 1, 10, 5, 100), sound))
    info = list_(b"INFO", chunk(b"INAM", C("o_orderpriority"), b"\0"), chunk(b"IART", F.concat(F.lit(" "), C("o_orderstatus"), F.lit(" ")), b"\0"), chunk(b"ICRD", F.date_format("o_orderdate", "yyyy-MM-dd"), b"\0"))
    vol = join(b"\0\0\1\x20", bytes([0b00000000, 0b10000000 | 0b001000, 0b10000000]), zeros(8))  # pixel aspect code 2
    body = all_of(raw("AVI "), hdrl, info, list_(b"movi", chunk(b"00dc", vol), chunk(b"01wb", zeros(7))), F.when(key % 2 == 0, chunk(b"idx1", zeros(16))).otherwise(F.lit(bytearray(b""))))
    return files(o, "o_orderkey", "avi", join(b"RIFF", lv(body, 4, to_le)))


def asf_object(guid: str, *xs) -> Column:
    body = join(*xs)
    return let(body, lambda b: join(bytes.fromhex(guid), to_le(F.length(b) + 24, 8), b))


def asf(o: DataFrame) -> DataFrame:
    """A picture stream (1) and a sound stream (2); the properties of the first come after it, those of the second before it."""
    key = C("o_orderkey")
    wide = lambda x: F.encode(F.concat(x if isinstance(x, Column) else F.lit(x), F.lit("\0")), "UTF-16LE")
    stream = lambda kind, n, body: asf_object(STREAM, bytes.fromhex(kind), zeros(16), zeros(8), zeros(8), to_le(n, 2), zeros(4), body)
    picture = stream(VIDEO, 1, join(zeros(11), to_le(40, 4), to_le(key % 1500 + 1, 4), to_le(key % 900 + 1, 4), to_le(1, 2), to_le(24, 2), b"WMV3", zeros(20)))
    sound = stream(AUDIO, 2, join(to_le(0x161, 2), to_le(2, 2), to_le(44100, 4), to_le(key % 5000, 4), to_le(4, 2), to_le(16, 2)))
    more = lambda n, rate, lang, time: asf_object(EXTENDED, zeros(16), to_le(rate, 4), zeros(28), to_le(n, 2), to_le(lang, 2), to_le(time, 8), zeros(4))
    text = [wide(C("o_orderpriority")), wide(C("o_orderstatus")), wide("(c)"), wide("about"), wide("")]
    content = asf_object(CONTENT, *[to_le(F.length(t), 2) for t in text], *text)
    value = wide(C("o_orderpriority"))
    description = asf_object(DESCRIPTION, to_le(2, 2), lv(wide("WM/Genre"), 2, to_le), to_le(0, 2), lv(value, 2, to_le), lv(wide("WM/Track"), 2, to_le), to_le(3, 2), lv(to_le(key, 4), 2, to_le))
    meta = asf_object(METADATA, to_le(1, 2), zeros(2), to_le(2, 2), to_le(F.length(wide("Key")), 2), to_le(3, 2), to_le(4, 4), wide("Key"), to_le(key, 4))
    tongues = asf_object(LANGUAGES, to_le(2, 2), lv(wide("en-us"), 1), lv(wide("de"), 1))
    extension = asf_object(EXTENSION, zeros(18), lv(all_of(more(2, key * 8, 1, 0), tongues, meta), 4, to_le))
    props = asf_object(FILE, zeros(40), to_le(key * 10_000_000, 8), zeros(32))
    body = all_of(props, extension, picture, sound, more(1, key * 100, 0, 400_000), content, description)
    head = let(body, lambda b: join(bytes.fromhex(ASF), to_le(F.length(b) + 30, 8), to_le(7, 4), b"\x01\x02", b))
    return files(o, "o_orderkey", "wmv", F.concat(head, zeros(16)))


def double(x: Column) -> Column:
    """Bytes of whole numbers from 1 below 2^31 as IEEE doubles, high byte first."""
    e = F.floor(F.log2(x.cast("double"))).cast("long")
    return to_be((e + 1023) * F.lit(1 << 52) + ((x.cast("double") / F.pow(F.lit(2.0), e) - 1) * F.lit(2.0**52)).cast("long"), 8)


def flv(o: DataFrame) -> DataFrame:
    key = C("o_orderkey")
    tag = lambda kind, body: let(body, lambda b: join(bytes([kind]), to_be(F.length(b), 3), zeros(7), b, to_be(F.length(b) + 11, 4)))
    entry = lambda name, value: join(lv(name, 2), value)
    meta = join(b"\x02", lv("onMetaData", 2), b"\x08", to_be(3, 4), entry("width", join(b"\0", double(key % 1900 + 1))), entry("duration", join(b"\0", double(key + 1))), entry("creator", join(b"\x02", lv(raw(C("o_orderpriority")), 2))), b"\0\0\x09")
    sound = join(to_be(2 * 16 + key % 4 * 4 + key % 2, 1), zeros(3))
    return files(o, "o_orderkey", "flv", join(b"FLV\x01\x05", to_be(9, 4), zeros(4), tag(18, meta), tag(8, sound), tag(9, join(b"\x12", zeros(3)))))


def real(o: DataFrame) -> DataFrame:
    key = C("o_orderkey")
    chunk = lambda kind, body: let(body, lambda b: join(kind, to_be(F.length(b) + 10, 4), zeros(2), b))
    stream = lambda n, mime: chunk(b"MDPR", join(to_be(n, 2), to_be(9, 4), to_be(key * 8, 4), zeros(16), to_be(key * 10, 4), lv("s", 1), lv(mime, 1)))
    cont = chunk(b"CONT", join(lv(raw(C("o_orderpriority")), 2), lv(raw(C("o_orderstatus")), 2), lv("(c)", 2), lv("", 2)))
    return files(o, "o_orderkey", "rm", join(chunk(b".RMF", zeros(8)), stream(0, "audio/x-pn-realaudio"), stream(1, "video/x-pn-realvideo"), cont, chunk(b"DATA", zeros(20))))


def ogm(o: DataFrame) -> DataFrame:
    key = C("o_orderkey")
    video = join(b"\x01video\0\0\0", b"XVID", to_le(52, 4), to_le(400_000, 8), to_le(1, 8), zeros(8), to_le(24, 2), zeros(2), to_le(key % 700 + 1, 4), to_le(key % 500 + 1, 4))
    chapters = [F.lit("CHAPTER01=00:00:00.000"), F.lit("CHAPTER01NAME=one"), F.concat(F.lit("CHAPTER02=00:01:"), F.lpad((key % 60).cast("string"), 2, "0"), F.lit(".5")), F.concat(F.lit("CHAPTER02NAME="), C("o_orderpriority")), F.lit("CHAPTER04=00:09:00"), F.lit("CHAPTER04NAME=lost")]
    comments = join(b"\x03vorbis", vorbis_comments(F.concat(F.lit("TITLE="), C("o_orderstatus")), *chapters))
    pages = [ogg_page(F.lit(0), 0, 0, [video]), ogg_page(F.lit(0), 1, 0, [vorbis_head(2, 48000, 64000)]), ogg_page(F.lit(0), 0, 1, [comments]), ogg_page(key * 48, 1, 1, [zeros(9)]), ogg_page(key * 25, 0, 2, [zeros(9)])]
    return files(o, "o_orderkey", "ogm", all_of(*pages))


def clock2(seconds: Column) -> Column:
    """Six bytes of an MPEG-2 pack's clock."""
    t = seconds * 90_000
    hi, mid, lo = F.shiftright(t, 30).bitwiseAND(7), F.shiftright(t, 15).bitwiseAND(0x7FFF), t.bitwiseAND(0x7FFF)
    word = F.lit(1 << 46) + hi * F.lit(1 << 43) + F.lit(1 << 42) + mid * F.lit(1 << 27) + F.lit(1 << 26) + lo * F.lit(1 << 11) + F.lit(1 << 10) + F.lit(1)
    return to_be(word, 6)


def stamp(seconds: Column) -> Column:
    """Five bytes of a packet's time."""
    t = seconds * 90_000
    return to_be(F.lit(0x21 << 32) + F.shiftright(t, 30).bitwiseAND(7) * F.lit(1 << 33) + F.shiftright(t, 15).bitwiseAND(0x7FFF) * F.lit(1 << 17) + F.lit(1 << 16) + t.bitwiseAND(0x7FFF) * 2 + 1, 5)


def sequence(key: Column) -> Column:
    return join(b"\0\0\1\xb3", to_be((key % 1900 + 1) * F.lit(1 << 20) + (key % 1000 + 1) * 256 + (key % 4 + 1) * 16 + key % 8 + 1, 4), to_be(F.lit(5000 * 64), 3), zeros(9))


def mpeg(o: DataFrame) -> DataFrame:
    """Elementary, program and transport streams by turns."""
    key = C("o_orderkey")
    es = F.concat(sequence(key), zeros(20))
    pack = lambda s: join(b"\0\0\1\xba", clock2(s), b"\0\0\3\xf8")
    ps = join(pack(F.lit(1)), b"\0\0\1\xe0\0\x30\x80\0\0", sequence(key), b"\0\0\1\xb5\x14\x8a\0\1\0\0", b"\0\0\1\xc0\0\x08\x80\0\0", zeros(5), pack(1 + key % 80_000), b"\0\0\1\xb9")
    packet = lambda pid, stream, s: F.substring(join(b"\x47", to_be(0x4000 + pid, 2), b"\x10", b"\0\0\1", bytes([stream]), zeros(2), b"\x80\x80\x05", stamp(s), F.lit(bytearray(b"\xff" * 188))), 1, 188)
    ts = all_of(packet(256, 0xE0, F.lit(2)), packet(257, 0xC0, F.lit(2)), packet(256, 0xE0, 2 + key % 80_000))
    return files(o, "o_orderkey", F.when(key % 3 == 2, "ts").otherwise("mpg"), F.when(key % 3 == 0, es).when(key % 3 == 1, ps).otherwise(ts))


# --------------------------------------------------------------------------- games, discs, documents
def games(p: DataFrame) -> DataFrame:
    """Game Boy, its colour and advance kinds, and SNES by turns."""
    kind = C("p_partkey") % 4
    title = lambda n: F.substring(F.concat(F.upper("p_name").cast("binary"), zeros(n)), 1, n)
    gb = join(zeros(260), LOGO_GB, title(15), F.when(kind == 1, F.lit(bytearray(b"\x80"))).otherwise(zeros(1)), zeros(20))
    gba = join(zeros(4), LOGO_GBA, title(12), b"CODEMK\x96", zeros(20))
    snes = join(zeros(32704), F.rpad(F.regexp_replace(F.upper("p_name"), "[^A-Z0-9 ]", " "), 21, " "), b"\0\2", zeros(40))
    suffix = F.when(kind == 0, "gb").when(kind == 1, "gbc").when(kind == 2, "gba").otherwise("smc")
    return files(p, "p_partkey", suffix, F.when(kind < 2, gb).when(kind == 2, gba).otherwise(snes))


def markup(pages: DataFrame) -> DataFrame:
    """Pages as HTML for even keys, else XML with one of four first elements or none."""
    key = C("page_id")
    root = F.array(F.lit("image"), F.lit("album"), F.lit("library"), F.lit("other"))[(F.floor(key / 2) % 4).cast("int")]
    xml = F.when(key % 10 == 9, F.lit("no markup")).otherwise(F.concat(F.lit('<?xml version="1.0"?>\n<!-- <x> -->\n<'), root, F.lit(' a="b">text</'), root, F.lit(">")))
    return files(pages, "page_id", F.when(key % 2 == 0, "html").otherwise("xml"), raw(F.when(key % 2 == 0, F.coalesce("html", F.lit(""))).otherwise(xml)))


def discs(p: DataFrame) -> DataFrame:
    """Disc images with the markers of a DVD, a VCD, an SVCD or none, each with a cue sheet."""
    key = C("p_partkey")
    mark = F.array(F.lit("UDF  VIDEO_TS"), F.lit("INFO.VCD ENTRIES.VCD"), F.lit("SVCD TRACKS.SVD ENTRIES.SVD"), F.lit("plain"))[(key % 4).cast("int")]
    image = files(p, "p_partkey", "iso", join(zeros(32768), mark, zeros(70_000)))
    track = F.array_join(F.transform(F.sequence(F.lit(1), (key % 5 + 1).cast("int")), lambda i: F.concat(F.lit("  TRACK "), F.lpad(i.cast("string"), 2, "0"), F.lit(" MODE2/2352\n"))), "")
    sheet = files(p, "p_partkey", "cue", raw(F.concat(F.lit('FILE "'), key.cast("string"), F.lit('.iso" BINARY\n'), track)))
    return image.unionByName(sheet)


def title_sets(p: DataFrame) -> DataFrame:
    """DVD title sets: one programme chain with as many cells as the part's size, of the key's seconds each; two sounds and a subtitle."""
    key = C("p_partkey")
    bcd = lambda x: F.floor(x / 10) * 16 + x % 10
    pal = key % 2
    attributes = join(to_be(0x4000 + pal * 0x1000 + F.when(pal == 1, 0x0C00).otherwise(0), 2), to_be(2, 2), b"\0\x05en\0\0\0\0", b"\xc0\x01de\0\0\0\0", zeros(64), to_be(1, 2), b"\0\0fr\0\0", zeros(186))
    time = join(b"\0\0", to_be(bcd(key % 60), 1), to_be(F.when(pal == 1, 0x40).otherwise(0xC0), 1))
    cells = glued(F.transform(F.sequence(F.lit(1), C("p_size")), lambda _: join(zeros(4), time, zeros(16))))
    pgc = join(b"\0\0", to_be(C("p_size") % 20 + 1, 1), to_be(C("p_size"), 1), time, zeros(224), to_be(236, 2), zeros(2), cells)
    table_ = join(to_be(1, 2), zeros(6), zeros(4), to_be(16, 4), pgc)
    head = join(b"DVDVIDEO-VTS", zeros(192), to_be(1, 4), zeros(304), attributes)
    return files(p, "p_partkey", "x", F.concat(F.substring(F.concat(head, zeros(2048)), 1, 2048), table_)).withColumn("path", F.regexp_replace("path", r"([0-9]+)\.x$", "$1/VTS_01_0.IFO"))
