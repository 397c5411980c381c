"""ID3 tags, all versions: frames from elements, friendly names, the fixed record of version 1, and writing tags back to bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binary import be, join, let, part, raw, to_be, to_syncsafe, zeros
from ..functions.codes import GENRES_V1, lookup, pick
from ..functions.text import friendly_number
from .pick import body_, built, n_

# Attributes from text frames (version 2.3/2.4 names, then 2.2's).
ATTRIBUTES = {
    "album": ("TALB", "TAL"), "composer": ("TCOM", "TCM"), "copyright": ("TCOP", "TCR"), "release": ("TDOR",), "text": ("TEXT", "TXT"), "title": ("TIT2", "TT2"), "language_raw": ("TLAN", "TLA"),
    "length": ("TLEN", "TLE"), "media_type": ("TMED", "TMT"), "trackno": ("TRCK", "TRK"), "discs": ("TPOS", "TPA"), "publisher": ("TPUB", "TPB"),
}
# Names of tags from frames.
TAGS = {
    "COMM": "comment", "TALB": "album", "TYER": "date_recorded", "TDRC": "date_recorded", "TDRL": "date_released", "TDEN": "date_encoded", "TENC": "encoded_by", "TMOO": "mood", "WXXX": "url", "TIT2": "title",
    "TOPE": "artist", "TCOM": "composer", "TEXT": "lyricist", "TPE1": "lead_performer", "TPE2": "accompaniment", "TPE3": "conductor", "TRCK": "part_number", "TPOS": "total_parts", "TCOP": "copyright",
    "TPUB": "publisher", "TCON": "genre",
}
# Version 2.2's three-letter frames and what they became.
OLD = dict(x.split(":") for x in (
    "UFI:UFID TT1:TIT1 TT2:TIT2 TT3:TIT3 TP1:TPE1 TP2:TPE2 TP3:TPE3 TP4:TPE4 TCM:TCOM TXT:TEXT TLA:TLAN TCO:TCON TAL:TALB TPA:TPOS TRK:TRCK TRC:TSRC TYE:TYER TDA:TDAT TIM:TIME TRD:TRDA TMT:TMED TFT:TFLT TBP:TBPM TCR:TCOP "
    "TPB:TPUB TEN:TENC TSS:TSSE TOF:TOFN TLE:TLEN TSI:TSIZ TDY:TDLY TKE:TKEY TOT:TOAL TOA:TOPE TOL:TOLY TOR:TORY TXX:TXXX WAF:WOAF WAR:WOAR WAS:WOAS WCM:WCOM WCP:WCOP WPB:WPUB WXX:WXXX IPL:IPLS MCI:MCDI ETC:ETCO "
    "MLL:MLLT STC:SYTC ULT:USLT SLT:SYLT COM:COMM RVA:RVAD EQU:EQUA REV:RVRB GEO:GEOB CNT:PCNT POP:POPM BUF:RBUF CRA:AENC TCP:TCMP TDS:TDES TID:TGID WFD:WFED TCT:TCAT TKW:TKWD PCS:PCST TSA:TSOA TSP:TSOP TST:TSOT TS2:TSO2 TSC:TSOC"
).split())
# Frames whose body isn't text or a link, by shape.
SHAPES = {
    "TXXX": "described", "TXX": "described", "WXXX": "described_url", "WXX": "described_url", "COMM": "comment", "COM": "comment", "USLT": "comment", "ULT": "comment", "USER": "terms", "APIC": "picture", "PIC": "old_picture",
    "GEOB": "object", "GEO": "object", "UFID": "owned", "UFI": "owned", "PRIV": "owned", "ENCR": "owned", "GRID": "owned", "AENC": "owned", "CRA": "owned", "PCNT": "count", "CNT": "count", "PCST": "count", "SEEK": "count",
    "POPM": "rating", "POP": "rating", "LINK": "link", "LNK": "old_link", "IPLS": "text", "IPL": "text", "XSOP": "text",
}
#: Order in which a tag's frames are written; frames of equal rank keep their order.
ORDER = {name: k for k, name in enumerate("TIT1 TIT2 TIT3 TPE1 TPE2 TPE3 TPE4 TALB TOAL TRCK TPOS TCON TYER TDAT TIME TDRC TDOR COMM TXXX".split())}


def decoded(b: Column, encoding: Column) -> Column:
    """Text in the encoding that a frame names: 0 Latin-1, 1 UTF-16 with a mark, 2 UTF-16 big-endian, 3 UTF-8."""
    even = part(b, 0, F.length(b) - F.length(b) % 2)
    return F.when(encoding == 0, F.decode(b, "ISO-8859-1")).when(encoding == 1, F.decode(even, "UTF-16")).when(encoding == 2, F.decode(even, "UTF-16BE")).when(encoding == 3, F.decode(b, "UTF-8"))


def listed(t: Column) -> Column:
    """Values between NULs without marks and without empty ones at the end."""
    return F.split(F.regexp_replace(F.replace(t, F.lit("﻿"), F.lit("")), "\0+$", ""), "\0")


def texts(b: Column) -> Column:
    """array<string> of a text frame's body; null where there is no text."""
    return let(listed(decoded(part(b, 1), be(b, 0, 1))), lambda xs: F.when(~((F.size(xs) == 1) & (xs[0] == "")), xs))


def joined(b: Column) -> Column:
    return F.array_join(texts(b), "")


def first_text(*names: str) -> Column:
    """The text, values joined, of a file's first frame of the first of these names that it has."""
    one = lambda name: F.min_by(F.when(F.col("id") == name, built(joined)), F.when(F.col("id") == name, n_()))
    return F.coalesce(*[one(x) for x in names])


def fields(ident: Column, b: Column) -> Column:
    """struct of what a frame of any kind holds; ``texts`` has text values, links go to ``url``, bytes without a shape to ``data``."""
    code = be(b, 0, 1)
    shape = F.coalesce(lookup(SHAPES, ident), F.when(ident.startswith("T"), "text").when(ident.startswith("W"), "url").otherwise("binary"))
    after = lambda n: listed(decoded(part(b, n), code))
    latin = F.decode(b, "ISO-8859-1")
    # description and value are apart by a NUL of the encoding's width
    two = after(1)
    after_lang = after(4)
    owner = F.substring_index(latin, "\0", 1)
    mime = F.substring_index(F.decode(part(b, 1), "ISO-8859-1"), "\0", 1)
    wide = code.isin(1, 2)

    def past(from_: Column) -> Column:
        """Where the value begins whose description begins at from_."""
        rest = F.hex(part(b, from_))
        narrow = F.length(F.regexp_extract(rest, "^(?:..)*?00", 0)) / 2
        broad = F.length(F.regexp_extract(rest, "^(?:....)*?0000", 0)) / 2
        return from_ + F.when(wide, broad).otherwise(narrow).cast("int")

    pic = F.length(mime) + 3
    linked = lambda at: F.substring_index(F.decode(part(b, at), "ISO-8859-1"), "\0", 1)
    is_ = lambda *names: shape.isin(*names)
    desc_at = F.when(is_("picture"), pic).when(is_("old_picture"), 5)
    values = {
        "shape": shape,
        "texts": F.when(is_("text"), texts(b)).when(is_("described"), F.slice(two, 2, 1)).when(is_("comment"), F.slice(after_lang, 2, 1)).when(is_("terms"), after_lang),
        "description": F.when(is_("described", "described_url"), two[0]).when(is_("comment"), after_lang[0]).when(is_("picture", "old_picture"), F.get(listed(decoded(part(b, desc_at, past(desc_at) - desc_at), code)), F.lit(0))),
        "language": F.when(is_("comment", "terms"), F.decode(part(b, 1, 3), "ISO-8859-1")),
        "url": F.when(is_("url"), owner).when(is_("described_url"), F.substring_index(F.decode(part(b, past(F.lit(1))), "ISO-8859-1"), "\0", 1)).when(is_("link"), linked(4)).when(is_("old_link"), linked(3)),
        "owner": F.when(is_("owned", "rating"), owner).when(is_("link"), F.decode(part(b, 0, 4), "ISO-8859-1")).when(is_("old_link"), F.decode(part(b, 0, 3), "ISO-8859-1")),
        "mime": F.when(is_("picture", "object"), mime).when(is_("old_picture"), F.decode(part(b, 1, 3), "ISO-8859-1")),
        "picture_type": F.when(is_("picture"), be(b, pic - 1, 1)).when(is_("old_picture"), be(b, 4, 1)).cast("int"),
        "number": F.when(is_("count"), be(b, 0, 4)).when(is_("rating"), be(b, F.length(owner) + 1, 1)),
        "data": F.when(is_("picture", "old_picture"), part(b, past(desc_at))).when(is_("owned"), part(b, F.length(owner) + 1)).when(is_("rating"), part(b, F.length(owner) + 2))
        .when(is_("link"), part(b, F.length(linked(4)) + 5)).when(is_("old_link"), part(b, F.length(linked(3)) + 4)).when(is_("binary", "object"), b),
    }
    return F.struct(*[c.alias(k) for k, c in values.items()])


def own_fields(b: Column) -> Column:
    return fields(F.col("id"), b)


def frames(e: DataFrame) -> DataFrame:
    """(path, version, n, frameid, flags, shape, texts, description, language, url, owner, mime, picture_type, number, data)."""
    mine = e.where(F.col("place").rlike("^ID3v2\\.[234]/"))
    version = F.regexp_extract("place", "^ID3v(2\\.[234])/", 1)
    return mine.select("path", version.alias("version"), "n", F.col("id").alias("frameid"), F.col("at").alias("flags"), built(own_fields).alias("f")).select("path", "version", "n", "frameid", "flags", "f.*")


def first_picture() -> Column:
    mine = F.col("id").isin("APIC", "PIC")
    return F.min_by(F.when(mine, built(own_fields)["data"]), F.when(mine, n_()))


def modern(frames: DataFrame) -> DataFrame:
    """Version 2.2's frames under their later names."""
    return frames.withColumn("frameid", F.coalesce(lookup(OLD, F.col("frameid")), F.col("frameid")))


def merged(frames: DataFrame) -> DataFrame:
    """Repeated text frames as one that has all their texts, in order."""
    rows = F.array_sort(F.collect_list(F.struct("n", "texts")))
    return frames.where(F.col("texts").isNotNull() & (F.col("shape") == "text")).groupBy("path", "frameid").agg(F.flatten(F.transform(rows, lambda x: x["texts"])).alias("texts"))


def ordered(frames: DataFrame) -> DataFrame:
    """Add ``rank``: a frame's place in the canonical order, from 1."""
    w = Window.partitionBy("path").orderBy(F.coalesce(lookup(ORDER, F.col("frameid")), F.lit(len(ORDER))), "frameid", "n")
    return frames.withColumn("rank", F.row_number().over(w))


def friendly(frames: DataFrame) -> DataFrame:
    """(path, title, artist, ..., track, track_total, disc, disc_total, comment): frames under everyday names, values joined."""
    f = modern(frames)
    text = lambda *names: F.array_join(F.coalesce(*[F.min_by(F.when(F.col("frameid") == x, F.col("texts")), F.when(F.col("frameid") == x, n_())) for x in names]), " / ")
    plain = F.coalesce(F.col("description"), F.lit("")) == ""
    rank = F.when((F.col("frameid") == "COMM") & plain, F.when(F.lower("language") == "eng", 0).otherwise(1))
    m = f.groupBy("path").agg(
        text("TIT2").alias("title"), text("TPE1").alias("artist"), text("TPE2").alias("album_artist"), text("TALB").alias("album"), text("TCOM").alias("composer"), text("TCON").alias("genre"), text("TIT1").alias("grouping"),
        text("TRCK").alias("tr"), text("TPOS").alias("di"), text("TSOT").alias("sort_title"), text("TSOP").alias("sort_artist"), text("TSOA").alias("sort_album"), text("TDRC", "TYER").alias("date"),
        F.min_by(F.when(rank.isNotNull(), F.array_join("texts", " / ")), F.when(rank.isNotNull(), F.struct(rank, n_()))).alias("comment"),
    )
    return m.select("*", friendly_number(F.col("tr")).alias("track"), friendly_number(F.col("tr"), True).alias("track_total"), friendly_number(F.col("di")).alias("disc"), friendly_number(F.col("di"), True).alias("disc_total")).drop("tr", "di")


def tags(e: DataFrame) -> DataFrame:
    """(path, n, name, value, is_binary) of the frames that have a tag name; described texts are named after their description."""
    f = modern(frames(e))
    name = F.when(F.col("frameid") == "TXXX", F.concat(F.lit("_"), F.replace("description", F.lit(" "), F.lit("_")))).otherwise(lookup(TAGS, F.col("frameid")))
    value = F.coalesce(F.array_join("texts", ""), F.col("url"))
    value = F.when(name.isin("part_number", "total_parts"), F.substring_index(value, "/", 1)).otherwise(value)
    return f.select("path", "n", name.alias("name"), value.alias("value")).where("name is not null and value is not null")


# --------------------------------------------------------------------------- version 1
def id3v1(last128: Column) -> Column:
    """struct<title, artist, album, year, comment, track, genre> of a file's last 128 bytes; null without a tag."""
    cut = lambda at, n: F.trim(F.substring_index(F.decode(part(last128, at, n), "ISO-8859-1"), "\0", 1))
    track = F.when((be(last128, 125, 1) == 0) & (be(last128, 126, 1) > 0), be(last128, 126, 1)).cast("int")
    out = {
        "title": cut(3, 30), "artist": cut(33, 30), "album": cut(63, 30), "year": cut(93, 4), "comment": F.when(track.isNotNull(), cut(97, 28)).otherwise(cut(97, 30)),
        "track": F.coalesce(track, F.lit(0)), "genre": F.coalesce(pick(GENRES_V1, be(last128, 127, 1)), F.lit("Unknown")),
    }
    return F.when((F.length(last128) == 128) & (part(last128, 0, 3) == raw(b"TAG")), F.struct(*[c.alias(k) for k, c in out.items()]))


def id3v1_encode(title: Column, artist: Column, album: Column, year: Column, comment: Column, track: Column, genre: Column) -> Column:
    """The 128 bytes of a version 1.1 tag; texts are cut to their fields."""
    fit = lambda c, n: F.substring(F.concat(F.encode(F.coalesce(c, F.lit("")), "ISO-8859-1"), zeros(n)), 1, n)
    return join(b"TAG", fit(title, 30), fit(artist, 30), fit(album, 30), fit(year, 4), fit(comment, 28), b"\0", to_be(F.coalesce(track, F.lit(0)), 1), to_be(genre, 1))


# --------------------------------------------------------------------------- writing version 2
def text_body(value: Column, encoding: int = 3) -> Column:
    charset, mark = {0: ("ISO-8859-1", b""), 1: ("UTF-16LE", b"\xff\xfe"), 2: ("UTF-16BE", b""), 3: ("UTF-8", b"")}[encoding]
    return join(bytes([encoding]) + mark, F.encode(value, charset))


def comment_body(value: Column, language: str = "eng") -> Column:
    return join(b"\3" + language.encode() + b"\0", F.encode(value, "UTF-8"))


def described_body(description: Column, value: Column) -> Column:
    """TXXX: a text under a description."""
    return join(b"\3", F.encode(description, "UTF-8"), b"\0", F.encode(value, "UTF-8"))


def url_body(url: Column) -> Column:
    return F.encode(url, "ISO-8859-1")


def described_url_body(description: Column, url: Column) -> Column:
    """WXXX: a link under a description."""
    return join(b"\3", F.encode(description, "UTF-8"), b"\0", url_body(url))


def picture_body(data: Column, mime: Column, description: Column, kind: int = 3) -> Column:
    """APIC; kind 3 is the front cover."""
    return join(b"\3", F.encode(mime, "ISO-8859-1"), b"\0" + bytes([kind]), F.encode(description, "UTF-8"), b"\0", data)


def frame(name: str, body: Column, major: int) -> Column:
    """A frame's bytes; none for a null body."""
    size = {2: lambda n: to_be(n, 3), 3: lambda n: to_be(n, 4), 4: to_syncsafe}[major]
    return let(body, lambda b: F.coalesce(join(name.encode(), size(F.length(b)), *([b"\0\0"] if major > 2 else []), b), F.lit(bytearray(b""))))


def id3v2_encode(bodies: dict[str, Column], major: int = 4, unsync: bool = False, padding: int = 128) -> Column:
    """A whole tag. Frames come in canonical order; ``unsync`` (2.2 and 2.3) puts a zero behind each 255."""
    names = sorted(bodies, key=lambda n: (ORDER.get(OLD.get(n, n), len(ORDER)), n))
    data = reduce(lambda a, b: F.concat(a, b), [frame(n, bodies[n], major) for n in names])
    if unsync:
        data = F.unhex(F.regexp_replace(F.hex(data), "((?:^|\\G)(?:(?!FF)..)*)FF", "$1FF00"))
    return let(F.concat(data, zeros(padding)), lambda b: join(b"ID3" + bytes([major, 0, 128 * unsync]), to_syncsafe(F.length(b)), b))


def without_tag(content: Column) -> Column:
    """The bytes behind a version 2 tag, or all."""
    from ..functions.binary import syncsafe

    return F.when(part(content, 0, 3) == raw(b"ID3"), part(content, syncsafe(content, 6) + 10 + F.when((be(content, 3, 1) == 4) & (be(content, 5, 1).bitwiseAND(16) > 0), 10).otherwise(0))).otherwise(content)


def with_tag(content: Column, tag: Column) -> Column:
    """The bytes with this tag in place of the one they had."""
    return F.concat(tag, without_tag(content))
