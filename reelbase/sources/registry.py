"""The file parsers, in the order in which they are tried, and the native routing of files to them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import be, bits, le, part, starts
from ..operators.walk import Grammar

#: Bytes that routing needs of a file.
HEAD = 66_100


@dataclass(frozen=True)
class Parser:
    """``takes`` says from the suffix, head and length whether the bytes are of this kind; ``grammar`` cuts files of a kind of one's own."""

    name: str
    mime: str
    suffixes: tuple[str, ...]
    takes: Callable[[Column, Column, Column], Column]
    media: str | None
    grammar: Grammar | None = None


def sync(head: Column, at: int = 0) -> Column:
    """An MPEG audio frame's header, with a version, layer, rate and bit rate that exist."""
    return F.hex(part(head, at, 4096)).rlike("^(?:..)*?FF(?:E[2-7]|F[2-7A-F])[1-9A-E][0-9A-B]")


def snes_header(head: Column) -> Column:
    """The first of the four places that holds a 32-byte header with a plausible title and kind, else null."""
    tries = [part(head, at, 32) for at in (33216, 32704, 65472, 65984)]
    fine = lambda h: (F.length(h) == 32) & F.decode(part(h, 0, 21), "ISO-8859-1").rlike("^[A-Za-z0-9 ]{21}$") & be(h, 22, 1).isin(0, 1, 2, 3, 4, 5, 19, 227, 246)
    return F.coalesce(*[F.when(fine(h), h) for h in tries])


# The logos that every Game Boy and every Game Boy Advance cartridge carries.
LOGO_GB = bytes.fromhex("ceed6666cc0d000b03730083000c000d0008111f8889000edccc6ee6ddddd999bbbb67636e0eecccdddc999fbbb9333e")
LOGO_GBA = bytes.fromhex(
    "24ffae51699aa2213d84820a84e409ad11248b98c0817f21a352be199309ce2010464a4af82731ec58c7e83382e3cebf85f4df94ce4b09c194568ac01372a7fc9f844d73a3ca9a61"
    "5897a327fc039876231dc7610304ae56bf38840040a70efdff52fe036f9530f197fbc08560d68025a963be03014e38e2f9a234ffbb3e0344780090cb88113a9465c07c6387f03caf"
    "d625e48b380aac7221d4f807"
)

REGISTRY = (
    Parser("mp3", "audio/mpeg", ("mp3",), lambda s, h, n: starts(h, b"ID3") & be(h, 3, 1).isin(2, 3, 4), "audio"),
    Parser("ac3", "audio/ac3", ("ac3",), lambda s, h, n: starts(h, b"\x0b\x77") | ((s == "ac3") & F.hex(part(h, 0, 2000)).rlike("^(?:....)*?0B77")), "audio"),
    Parser("adts", "application/adts", ("aac",), lambda s, h, n: (s == "aac") & (be(h, 0, 1) == 255) & (bits(be(h, 1, 1), 4, 4) == 15) & (F.length(h) >= 7), "audio"),
    Parser("m4a", "audio/m4a", ("m4a",), lambda s, h, n: starts(h, b"ftypM4A ", 4), "audio"),
    Parser("ogg", "application/ogg", ("ogg",), lambda s, h, n: starts(h, b"OggS\0") & starts(part(h, 27 + be(h, 26, 1), 7), b"\x01vorbis") & ~_ogm(h), "audio"),
    Parser("pcm", "application/pcm", ("aif", "voc", "au"), lambda s, h, n: (starts(h, b"FORM") & part(h, 8, 4).isin(*[F.lit(bytearray(x)) for x in (b"AIFF", b"AIFC")])) | starts(h, b".snd") | starts(h, b"Creative Voice File"), "audio"),
    Parser("asf", "video/asf", ("asf", "wmv", "wma"), lambda s, h, n: (F.hex(part(h, 0, 16)) == "3026B2758E66CF11A6D900AA0062CE6C") & (be(h, 28, 2) == 0x0102), "av"),
    Parser("flv", "video/flv", ("flv",), lambda s, h, n: starts(h, b"FLV") & (F.length(h) >= 13), "av"),
    Parser("mkv", "application/mkv", ("mkv", "mka", "webm"), lambda s, h, n: be(h, 0, 4) == 0x1A45DFA3, "av"),
    Parser("mp4", "video/quicktime", ("mov", "qt", "mp4", "mp4a", "3gp", "3gp2", "mk2"), lambda s, h, n: F.decode(part(h, 4, 4), "ISO-8859-1").isin("ftyp", "moov", "wide", "free", "mdat", "skip", "pnot", "PICT"), "av"),
    Parser("mpeg", "video/mpeg", ("mpeg", "mpg", "mp4", "ts"), lambda s, h, n: be(h, 0, 4).isin(0x1BA, 0x1B3) | (starts(h, b"G") & starts(h, b"G", 188) & (starts(h, b"G", 376) | (n <= 376))) | (s.isin("mpg", "mpeg") & F.hex(h).rlike("^(?:..)*?000001B[3A]")) | ((be(h, 0, 3) == 1) & F.hex(part(h, 3, 1)).rlike("^(BD|[CDE].)")), "av"),
    Parser("ogm", "application/ogg", ("ogm", "ogg"), lambda s, h, n: starts(h, b"OggS\0") & _ogm(h), "av"),
    Parser("real", "video/real", ("rm", "ra", "ram"), lambda s, h, n: starts(h, b".RMF"), "av"),
    Parser("riff", "video/avi", ("wav", "avi"), lambda s, h, n: (starts(h, b"RIFF") | starts(h, b"SDSS")) & F.decode(part(h, 8, 4), "ISO-8859-1").isin("AVI ", "WAVE"), "av"),
    Parser("cue", "video/vcd", ("cue",), lambda s, h, n: F.decode(part(h, 0, 300), "ISO-8859-1").rlike('^FILE "[^"]+"'), "disc"),
    Parser("iso", "video/dvd", ("iso",), lambda s, h, n: (s == "iso") & (n > 92_768), "disc"),
    Parser("bmp", "image/bmp", ("bmp",), lambda s, h, n: starts(h, b"BM") & (le(h, 2, 4) == n) & (n >= 26), "image"),
    Parser("gif", "image/gif", ("gif",), lambda s, h, n: starts(h, b"GIF") & (n >= 10), "image"),
    Parser("jpeg", "image/jpeg", ("jpg", "jpeg"), lambda s, h, n: starts(h, b"\xff\xd8\xff"), "image"),
    Parser("png", "image/png", ("png",), lambda s, h, n: starts(h, b"\x89PNG\r\n\x1a\n"), "image"),
    Parser("tiff", "image/tiff", ("tif", "tiff"), lambda s, h, n: starts(h, b"MM\0*") | starts(h, b"II*\0"), "image"),
    Parser("gameboy", "games/gameboy", ("gba", "gb", "gbc"), lambda s, h, n: (starts(h, LOGO_GBA, 4) & starts(h, b"\x96", 178)) | starts(h, LOGO_GB, 260), "game"),
    Parser("snes", "games/snes", ("smc", "sfc", "fig"), lambda s, h, n: snes_header(h).isNotNull(), "game"),
    Parser("xml", "text/xml", ("xml", "fxd", "html", "htm"), lambda s, h, n: s.isin("html", "htm") | (s.isin("xml", "fxd") & root_element(h).isNotNull()), None),
    Parser("flac", "application/flac", ("flac",), lambda s, h, n: starts(h, b"fLaC"), "audio"),
)


def _ogm(h: Column) -> Column:
    """A first stream that is a picture, or a second page that starts one: video makes an Ogg file OGM's."""
    return F.hex(part(h, 0, 512)).rlike("^(?:..)*?(?:0[1]766964656F0{6}|807468656F7261|01446972656374)")


def root_element(head: Column) -> Column:
    """Name of the first element behind declarations and comments; null if there is none."""
    text = F.decode(part(head, 0, 65_536), "ISO-8859-1")
    name = F.regexp_extract(text, r"(?s)^(?:\xEF\xBB\xBF)?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>\s*)*<([A-Za-z_][\w.:-]*)[\s/>]", 1)
    return F.when(name != "", name)


def suffix(path: Column) -> Column:
    """Lower-case suffix without its dot, '' if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def registry(spark: SparkSession, more: Sequence[Parser] = ()) -> DataFrame:
    """(place, parser, mime, suffix, media): a row for each suffix; ``more`` as in route."""
    rows = [(i, p.name, p.mime, s, p.media) for i, p in enumerate((*REGISTRY, *more)) for s in p.suffixes]
    return spark.createDataFrame(rows, "place int, parser string, mime string, suffix string, media string")


def parser_by_suffix(suffix: Column) -> Column:
    """The first parser registered for a suffix."""
    first = {}
    for p in REGISTRY:
        for s in p.suffixes:
            first.setdefault(s, p.name)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), suffix)


def route(files: DataFrame, force: bool = True, more: Sequence[Parser] = ()) -> DataFrame:
    """Add ``parser``: the suffix's parsers are tried in order, then what the magic number says (no more, if that fails), then all.

    Needs path and head (the first HEAD bytes) or content, and length. Unknown files get null. ``more`` adds parsers of one's own behind
    the built-in ones: their files have the element of the head (512 bytes), the hash, and what their grammar cuts, for decoders in column
    expressions.
    """
    parsers = (*REGISTRY, *more)
    own = files.columns
    head = F.col("head") if "head" in own else part(F.col("content"), 0, HEAD)
    length = F.col("length") if "length" in own else F.length("content")
    files = files.withColumns({"h__": head, "s__": suffix(F.col("path")), "n__": length.cast("long")})
    h, s, n = F.col("h__"), F.col("s__"), F.col("n__")
    # one flag for each parser, each worked out once
    files = files.withColumns({f"t__{p.name}": F.coalesce(p.takes(s, h, n), F.lit(False)) for p in parsers} | {"t__magic": F.coalesce(starts(h, b"OggS\0"), F.lit(False))})
    takes, magic = {p.name: F.col(f"t__{p.name}") for p in parsers}, F.col("t__magic")
    found = F.when(F.lit(False), "")
    for p in parsers:
        found = found.when(s.isin(*p.suffixes) & takes[p.name], p.name)
    found = found.when(magic & takes["ogg"], "ogg").when(magic & takes["ogm"], "ogm")
    if force:
        for p in parsers:
            found = found.when(~magic & takes[p.name], p.name)
    return files.select(*own, found.alias("parser"))
