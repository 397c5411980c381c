"""Video containers: media, tracks, chapters and tags, in column expressions over elements.

Tracks come as (path, part, kind, ordinal, id, ...) rows, gathered from the elements below each track's box. What refers from
one part of a file to another (tags to tracks, properties to streams) is an equi-join on the path and the number referred to.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binary import be, be_any, bits, float_be, le, le64, let, part, starts, utf8_or_latin1
from ..functions.codes import MATROSKA_CODECS, MPEG_ASPECTS, MPEG_RATES, QT_LANGUAGES, STEREO_MODES, lookup, pick
from ..functions.text import bits_per_second, chapter_seconds, matroska_epoch, quicktime_epoch, riff_time
from .audio import comments, last_granule, page_granule
from .pick import body_, n_, place_, at, by_file, by_part, comment, first, has, head, last, numbered, utf16, words

# --------------------------------------------------------------------------- Matroska
SEG = "18538067"
# Attributes from Matroska tags.
MKV_TAGS = {
    "album": "album", "title": "title", "subtitle": "caption", "comment": "comment", "comments": "comment", "url": "url", "artist": "artist", "keywords": "keywords", "composer_nationality": "country",
    "date_released": "datetime", "date_recorded": "datetime", "date_written": "datetime", "encoder": "encoder", "bps": "bitrate", "part_number": "trackno", "total_parts": "trackof", "copyright": "copyright",
    "genre": "genre", "actor": "actors", "written_by": "writer", "producer": "producer", "production_studio": "studio", "law_rating": "rating", "summary": "summary", "synopsis": "synopsis",
}
KINDS = {1: "video", 2: "audio", 17: "subtitle"}


def mkv_codec(codec: Column, private: Column) -> Column:
    """A codec id as a code: its own, that of the id before the slash, the code in the private data, or the id's end."""
    family = F.concat(F.substring_index(codec, "/", 1), F.lit("/"))
    named = F.coalesce(lookup(MATROSKA_CODECS, codec), lookup({"A_AAC/": "0xff"}, family))
    return (
        F.when(named.isNotNull(), named)
        .when(codec.endswith("FOURCC") & (F.length(private) == 40), F.decode(part(private, 16, 4), "ISO-8859-1"))
        .when(codec.startswith("V_REAL/"), F.substring(codec, 8, 99))
        .when(codec.rlike("^[VA]_"), F.substring(codec, 3, 99))
        .otherwise(codec)
    )


def mkv_tracks(e: DataFrame) -> DataFrame:
    p = f"{SEG}/1654AE6B/AE"
    number = lambda place: at(f"{p}/{place}", be_any)
    text = lambda place: at(f"{p}/{place}", words)
    t = by_part(
        e, p, type=number("83"), trackno=number("D7"), uid=number("73C5"), enabled=number("B9"), is_default=number("88"), frame_ns=number("23E383"), title=text("536E"), language_raw=text("22B59C"),
        codec_id=text("86"), private=at(f"{p}/63A2"), width=number("E0/B0").cast("int"), height=number("E0/BA").cast("int"), dw=number("E0/54B0"), dh=number("E0/54BA"), interlaced=number("E0/9A"), stereo=number("E0/53B8"),
        samplerate=at(f"{p}/E1/B5", float_be), channels=number("E1/9F").cast("int"),
    )
    kind = lookup(KINDS, F.col("type").cast("int"))
    t = t.select(
        "path", "part", kind.alias("kind"), F.col("trackno").cast("string").alias("trackno"), "uid", (F.coalesce("enabled", F.lit(1)) == 1).alias("enabled"), (F.coalesce("is_default", F.lit(1)) == 1).alias("is_default"),
        "title", F.coalesce("language_raw", F.lit("eng")).alias("language_raw"), mkv_codec(F.coalesce("codec_id", F.lit("Unknown")), F.col("private")).alias("codec_raw"), "private", "width", "height", "samplerate", "channels",
        F.when(kind == "video", F.when(F.col("frame_ns") > 0, 1e9 / F.col("frame_ns")).otherwise(0.0)).alias("fps"), F.when(F.col("dh") > 0, F.col("dw") / F.col("dh")).alias("aspect"),
        (F.col("interlaced") > 0).alias("interlaced"), lookup(STEREO_MODES, F.col("stereo").cast("int")).alias("stereo"),
    ).where(F.col("kind").isNotNull())
    return numbered(t)


def mkv_chapters(e: DataFrame) -> DataFrame:
    p = f"{SEG}/1043A770/45B9/B6"
    c = by_part(e, p, uid=at(f"{p}/73C4", be_any), ns=at(f"{p}/91", be_any), on=at(f"{p}/4598", be_any), title=last(f"{p}/80/85", words))
    return numbered(c.select("path", "part", F.lit("chapter").alias("kind"), "uid", (F.col("ns") / 1e9).alias("pos"), (F.coalesce("on", F.lit(1)) == 1).alias("enabled"), "title"))


def mkv_tags(e: DataFrame) -> DataFrame:
    """(path, tag, n, depth, name, tag_path, value, binary_value, langcode, uid): a row for each simple tag and target; no target: the file's.

    Names are lower-case. ``tag_path`` leads through the tags that a tag is nested in.
    """
    p = f"{SEG}/1254C367/7373"
    inner = e.where(place_().rlike(f"^{p}(/67C8)+/(45A3|447A|4487|4485)$"))
    owner, tag = F.element_at("up", -1), F.get("up", F.lit(3))
    s = inner.groupBy("path", tag.alias("tag"), owner.alias("n"), F.slice("up", 5, F.size("up")).alias("chain")).agg(
        F.max(F.when(F.col("id") == "45A3", F.lower(words(body_())))).alias("name"), F.max(F.when(F.col("id") == "4487", words(body_()))).alias("value"), F.max(F.when(F.col("id") == "4485", body_())).alias("binary_value"),
        F.max(F.when(F.col("id") == "447A", words(body_()))).alias("langcode"),
    )
    names = s.select("path", F.col("n").alias("link"), F.col("name").alias("link_name"))
    way = s.select("path", "n", F.posexplode("chain").alias("k", "link")).join(names, ["path", "link"]).groupBy("path", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "link_name"))), lambda x: x["link_name"]).alias("tag_path"))
    targets = e.where(place_().rlike(f"^{p}/63C0/(63C5|63C9|63C4|63C6)$") & (be_any(body_()) > 0)).select("path", tag.alias("tag"), be_any(body_()).alias("uid"))
    return s.join(way, ["path", "n"]).join(targets, ["path", "tag"], "left").select("path", "tag", "n", (F.size("chain") - 1).alias("depth"), "name", "tag_path", "value", "binary_value", F.coalesce("langcode", F.lit("und")).alias("langcode"), "uid")


def mkv_scoped_tags(e: DataFrame) -> DataFrame:
    """Tags with what they are about: scope file, or a track's or chapter's kind and ordinal; tags of unknown targets are left out."""
    things = mkv_tracks(e).select("path", "uid", "kind", "ordinal").unionByName(mkv_chapters(e).select("path", "uid", "kind", "ordinal"))
    t = mkv_tags(e)
    mine = t.join(things, ["path", "uid"], "left")
    return mine.where(F.col("uid").isNull() | F.col("kind").isNotNull()).withColumn("scope", F.coalesce("kind", F.lit("file"))).withColumnRenamed("ordinal", "scope_ordinal").drop("kind")


def tag_attributes(tags: DataFrame) -> DataFrame:
    """(path, attribute, value, earlier): of the file's tags the first value of each name in each tag; of several tags the last, and the one before it."""
    w = Window.partitionBy("path", "tag", "tag_path").orderBy("n")
    mine = tags.where(F.col("uid").isNull()).withColumn("attribute", lookup(MKV_TAGS, F.col("name"))).where("attribute is not null and value is not null")
    firsts = mine.withColumn("k", F.row_number().over(w)).where("k = 1")
    value = F.when(F.col("attribute") == "bitrate", bits_per_second(F.col("value")).cast("string")).when(F.col("attribute").isin("trackno", "trackof"), F.col("value").try_cast("int").cast("string")).otherwise(F.col("value"))
    g = firsts.groupBy("path", "attribute").agg(F.array_sort(F.collect_list(F.struct("n", value.alias("value")))).alias("v"))
    return g.select("path", "attribute", F.element_at("v", -1)["value"].alias("value"), F.when(F.size("v") > 1, F.element_at("v", -2)["value"]).alias("earlier"))


def mkv(e: DataFrame) -> DataFrame:
    """Media of Matroska files. A second title makes the first the series, a second part number the first the season."""
    info = f"{SEG}/1549A966"
    signed = lambda b: F.conv(F.hex(part(b, 0, 8)), 16, -10).cast("long")
    name = words(F.when(place_() == f"{SEG}/1941A469/61A7/466E", body_()))
    m = by_file(
        e, scale=at(f"{info}/2AD7B1", be_any), duration=at(f"{info}/4489", float_be), own_title=at(f"{info}/7BA9", words), ns=at(f"{info}/4461", signed), indexed=has(f"{SEG}/1C53BB6B"),
        n_video=F.sum(F.when((place_() == f"{SEG}/1654AE6B/AE/83") & (be_any(body_()) == 1), 1)), attached=F.max(name),
    )
    pivoted = tag_attributes(mkv_tags(e)).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "value"))).alias("a"), F.map_from_entries(F.collect_list(F.struct("attribute", "earlier"))).alias("b"))
    m = m.join(pivoted, "path", "left")
    tagged = lambda k: F.col("a")[k]
    season = F.col("b")["trackno"]
    return m.select(
        "path", "parser", "size", "hash", "error", F.coalesce(tagged("title"), "own_title").alias("title"), F.when(tagged("title").isNotNull(), F.coalesce(F.col("b")["title"], "own_title")).alias("series"),
        season.try_cast("int").alias("season"), F.when(season.isNotNull(), tagged("trackno").try_cast("int")).alias("episode"), F.when(season.isNull(), tagged("trackno")).alias("trackno"),
        (F.coalesce("duration", F.lit(0.0)) * F.coalesce("scale", F.lit(1_000_000)) / 1e9).alias("length"), F.floor(matroska_epoch(F.col("ns"))).alias("timestamp"), (~F.col("indexed")).alias("corrupt"),
        F.when(F.col("n_video") > 0, "av").otherwise("audio").alias("media"), tagged("bitrate").try_cast("double").alias("bitrate"), F.transform(F.split(tagged("keywords"), ","), lambda x: F.trim(x)).alias("keywords"),
        *[tagged(k).alias(k) for k in ("album", "caption", "comment", "url", "artist", "country", "datetime", "encoder", "trackof", "copyright", "genre", "actors", "writer", "producer", "studio", "rating", "summary", "synopsis")],
        F.lit("application/mkv").alias("mime"), F.lit("Matroska").alias("type"),
    )


def mkv_attachments(e: DataFrame) -> DataFrame:
    """(path, n, name, description, mime, data, is_cover)."""
    p = f"{SEG}/1941A469/61A7"
    a = by_part(e, p, name=at(f"{p}/466E", words), description=at(f"{p}/467E", words), mime=at(f"{p}/4660", words), data=at(f"{p}/465C"))
    said = F.lower(F.concat_ws("", "name", "description"))
    return a.select("path", F.col("part").alias("n"), "name", "description", "mime", "data", (F.col("mime").startswith("image/") & said.contains("cover") & (F.length("data") > 0)).alias("is_cover"))


# --------------------------------------------------------------------------- QuickTime and MPEG-4
def mp4_tracks(e: DataFrame) -> DataFrame:
    p = "moov/trak"
    v1 = lambda b: be(b, 0, 1) == 1
    two = lambda place, a, b, n=4: at(f"{p}/{place}", lambda x: F.when(v1(x), be(x, b, min(n + 3, 7) if n > 4 else n)).otherwise(be(x, a, 4 if n > 2 else n)))
    kind = at(f"{p}/mdia/hdlr", lambda b: F.when(starts(b, b"vide", 8), "video").when(starts(b, b"soun", 8), "audio").when(part(b, 8, 4).isin(*[F.lit(bytearray(x)) for x in (b"subt", b"sbtl", b"text")]), "subtitle"))
    t = by_part(
        e, p, id=two("tkhd", 12, 20), ctime=at(f"{p}/tkhd", lambda b: F.when(v1(b), be(b, 5, 7)).otherwise(be(b, 4, 4))), width=two("tkhd", 76, 88), height=two("tkhd", 80, 92),
        scale=two("mdia/mdhd", 12, 20), units=at(f"{p}/mdia/mdhd", lambda b: F.when(v1(b), be(b, 25, 7)).otherwise(be(b, 16, 4))), tongue=at(f"{p}/mdia/mdhd", lambda b: F.when(v1(b), be(b, 32, 2)).otherwise(be(b, 20, 2))),
        handler=kind, vmhd=has(f"{p}/mdia/minf/vmhd"), smhd=has(f"{p}/mdia/minf/smhd"), codec_raw=at(f"{p}/mdia/minf/stbl/stsd", lambda b: F.when(be(b, 4, 4) > 0, F.decode(part(b, 12, 4), "ISO-8859-1"))),
    )
    # codes of 0x400 and more pack three letters of five bits
    letter = lambda shift: F.char(bits(F.col("tongue"), shift, 5) + 96)
    packed = F.concat(letter(10), letter(5), letter(0))
    language = F.when(F.col("tongue") >= 0x400, F.when(F.col("tongue") != 0x7FFF, packed)).otherwise(lookup(QT_LANGUAGES, F.col("tongue").cast("int")))
    t = t.select(
        "path", "part", F.coalesce("handler", F.when(F.col("vmhd"), "video").when(F.col("smhd"), "audio")).alias("kind"), F.col("id").cast("string").alias("id"), "codec_raw", language.alias("language_raw"),
        F.when(F.col("scale") > 0, F.col("units") / F.col("scale")).alias("length"), F.shiftright("width", 16).cast("int").alias("width"), F.shiftright("height", 16).cast("int").alias("height"), quicktime_epoch(F.col("ctime")).alias("timestamp"),
    )
    return numbered(t.where(F.col("kind").isNotNull() & ~F.coalesce(F.col("codec_raw") == "jpeg", F.lit(False))))


def mp4(e: DataFrame) -> DataFrame:
    v1 = lambda b: be(b, 0, 1) == 1
    seconds = lambda b: F.when(v1(b), be(b, 25, 7) / F.nullif(be(b, 20, 4), F.lit(0))).otherwise(be(b, 16, 4) / F.nullif(be(b, 12, 4), F.lit(0)))
    units = lambda place: at(place, seconds)
    english = lambda name: F.coalesce(F.max(F.when((place_() == f"moov/udta/{name}/text") & F.col("at").isin(0, 0x15C7), words(body_()))), last(f"moov/udta/meta/ilst/{name}", lambda b: words(part(b, 16))))
    m = by_file(
        e, brand=at("ftyp", lambda b: part(b, 0, 4)), a=units("moov/mvhd"), b=units("moov/trak/mdia/mdhd"), timestamp=last("moov/trak/tkhd", lambda b: quicktime_epoch(F.when(v1(b), be(b, 5, 7)).otherwise(be(b, 4, 4)))),
        volume=at("moov/mvhd", lambda b: F.when(v1(b), be(b, 36, 2)).otherwise(be(b, 24, 2))), title=english("©nam"), artist=english("©aut"), copyright=english("©cpy"),
        compressed=has("moov/cmov/cmvd/moov/mvhd"), packed=units("moov/cmov/cmvd/moov/mvhd"),
    )
    qt = F.col("brand").isNull() | (F.col("brand") == F.lit(bytearray(b"qt  ")))
    return m.select("*", F.greatest("a", "b", "packed").alias("length"), F.create_map(F.lit("volume"), F.col("volume").cast("string")).alias("extras"), F.when(qt, "video/quicktime").otherwise("video/mp4").alias("mime"), F.when(qt, "Quicktime Video").otherwise("MPEG-4 Video").alias("type")).drop("brand", "a", "b", "packed", "compressed", "volume")


def mp4_references(e: DataFrame) -> DataFrame:
    """(path, n, url, quality, datarate) of reference movies."""
    p = "moov/rmra/rmda"
    return by_part(e, p, url=at(f"{p}/rdrf", lambda b: F.when(starts(b, b"url ", 4), words(part(b, 12, be(b, 8, 4))))), quality=at(f"{p}/rmqu", lambda b: be(b, 0, 4)), datarate=at(f"{p}/rmdr", lambda b: be(b, 4, 4))).withColumnRenamed("part", "n").drop("parser").where("url is not null")


# --------------------------------------------------------------------------- RIFF
# Attributes from INFO chunks.
INFO = {
    "title": "INAM", "artist": "IART", "product": "IPRD", "software": "ISFT", "comment": "ICMT", "language_raw": "ILNG", "keywords_raw": "IKEY", "trackno": "IPRT", "trackof": "IFRM", "producer": "IPRO", "writer": "IWRI",
    "genre": "IGNR", "copyright": "ICOP",
}
# Pixel aspects of MPEG-4 visual streams.
PIXEL_ASPECT = {1: 1.0, 2: 12 / 11, 3: 10 / 11, 4: 16 / 11, 5: 40 / 33}


def vol_aspect(b: Column) -> Column:
    """Pixel aspect from the first video object layer header (00 00 01 2x) in a picture; null without one."""
    h = F.regexp_extract(F.hex(b), "^(?:..)*?0000012[0-9A-F](.{14})", 1)
    return let(F.conv(F.nullif(h, F.lit("")), 16, 10).cast("long"), _vol_fields)


def _vol_fields(x: Column) -> Column:
    """Of the first 56 bits behind the start code: the aspect's place depends on the tenth."""
    field = lambda offset, n: F.shiftright(x, 56 - offset - n).bitwiseAND((1 << n) - 1)
    far = field(9, 1) == 1
    kind = F.when(far, field(17, 4)).otherwise(field(10, 4))
    own = F.when(far, field(21, 8) / F.nullif(field(29, 8), F.lit(0))).otherwise(field(14, 8) / F.nullif(field(22, 8), F.lit(0)))
    return F.when(kind == 15, own).otherwise(lookup(PIXEL_ASPECT, kind.cast("int")))


def avi_tracks(e: DataFrame) -> DataFrame:
    p = "AVI /hdrl/strl"
    t = by_part(
        e, p, fcc=at(f"{p}/strh", lambda b: F.decode(part(b, 0, 4), "ISO-8859-1")), scale=at(f"{p}/strh", lambda b: le(b, 20, 4)), rate=at(f"{p}/strh", lambda b: le(b, 24, 4)), start=at(f"{p}/strh", lambda b: le(b, 28, 4)),
        frames=at(f"{p}/strh", lambda b: le(b, 32, 4)), strf=at(f"{p}/strf"), ratio=at(f"{p}/vprp", lambda b: le(b, 20, 4)),
    )
    sound, b = F.col("fcc") == "auds", F.col("strf")
    video = F.col("fcc") == "vids"
    fps = F.when(video & (F.col("scale") > 0), F.col("rate") / F.col("scale"))
    tag = F.concat(F.lit("0x"), F.lower(F.hex(le(b, 0, 2))))
    t = t.select(
        "path", "part", F.when(sound, "audio").when(video, "video").when(F.col("fcc") == "txts", "subtitle").alias("kind"), F.when(sound, tag).otherwise(F.decode(part(b, 16, 4), "ISO-8859-1")).alias("codec_raw"),
        F.when(sound, le(b, 4, 4)).cast("double").alias("samplerate"), F.when(sound, le(b, 2, 2)).cast("int").alias("channels"), F.when(video, le(b, 4, 4)).cast("int").alias("width"), F.when(video, le(b, 8, 4)).cast("int").alias("height"),
        fps.alias("fps"), F.when(fps > 0, F.col("frames") / fps).alias("length"), F.when(F.col("ratio").bitwiseAND(0xFFFF) > 0, F.shiftright("ratio", 16) / F.col("ratio").bitwiseAND(0xFFFF)).alias("vprp"),
        F.when(sound & (F.col("scale") > 0) & (F.col("rate") > 0), F.col("start") / (F.col("rate") / F.col("scale"))).alias("delay"),
    ).where(F.col("kind").isNotNull())
    vol = e.where(place_().rlike("^AVI /movi/..dc$")).groupBy("path").agg(F.min_by(vol_aspect(body_()), F.when(vol_aspect(body_()).isNotNull(), n_())).alias("pixel"))
    j = numbered(t).join(vol, "path", "left")
    searched = (F.col("kind") == "video") & F.upper("codec_raw").isin("DIVX", "XVID", "FMP4")
    return j.withColumn("aspect", F.coalesce(F.when(F.col("kind") == "video", F.col("vprp")), F.when(searched, F.col("pixel") * F.col("width") / F.col("height")))).drop("vprp", "pixel")


def riff(e: DataFrame) -> DataFrame:
    """Media of AVI and WAV files; an AVI without an index is marked corrupt."""
    info = {k: F.coalesce(last(f"AVI /INFO/{v}", words), last(f"WAVE/INFO/{v}", words)) for k, v in INFO.items()}
    m = by_file(
        e, wav=has("WAVE"), indexed=has("AVI /idx1"), day=F.coalesce(at("AVI /INFO/IDIT", words), at("AVI /hdrl/IDIT", words), at("AVI /INFO/ICRD", words)), fmt=at("WAVE/fmt "), data=F.max(F.when(place_() == "WAVE/data", F.col("size"))), **info,
    )
    byterate = le(F.col("fmt"), 8, 4)
    return m.select(
        *[c for c in m.columns if c not in ("wav", "indexed", "day", "fmt", "data", "keywords_raw")], F.when(F.col("wav"), F.concat(F.lit("0x"), F.lower(F.hex(le(F.col("fmt"), 0, 2))))).alias("codec_raw"),
        le(F.col("fmt"), 4, 4).cast("int").alias("samplerate"), le(F.col("fmt"), 2, 2).cast("int").alias("channels"), le(F.col("fmt"), 14, 2).cast("int").alias("samplebits"), (byterate / 125).alias("bitrate"),
        F.when(byterate > 0, F.col("data") / byterate.cast("double")).alias("length"), riff_time(F.col("day")).alias("timestamp"), F.when(~F.col("wav"), ~F.col("indexed")).alias("corrupt"),
        F.transform(F.split("keywords_raw", "[,;]"), lambda x: F.trim(x)).alias("keywords"), F.when(F.col("wav"), "audio").otherwise("av").alias("media"), F.when(F.col("wav"), "audio/wav").otherwise("video/avi").alias("mime"),
    )


# --------------------------------------------------------------------------- ASF
def stored(guid: str) -> str:
    return uuid.UUID(guid).bytes_le.hex()


ASF = "3026b2758e66cf11a6d900aa0062ce6c"
FILE, STREAM, EXTENDED = stored("8CABDCA1-A947-11CF-8EE4-00C00C205365"), stored("B7DC0791-A9B7-11CF-8EE6-00C00C205365"), stored("14E6A5CB-C672-4332-8399-A96952065B5A")
EXTENSION, CONTENT, DESCRIPTION = stored("5FBF03B5-A92E-11CF-8EE3-00C00C205365"), stored("75B22633-668E-11CF-A6D9-00AA0062CE6C"), stored("D2D0A440-E307-11D2-97F0-00A0C95EA850")
METADATA, LANGUAGES = stored("C5F8CBEA-5BAF-4877-8467-AA8C44FA4CCA"), stored("7C4346A9-EFE0-4BFC-B229-393EDE415C85")
ENCRYPTED = (stored("2211B3FB-BD23-11D2-B4B7-00A0C955FC6E"), stored("298AE614-2622-4C17-B935-DAE07EE9289C"))
VIDEO, AUDIO = stored("BC19EFC0-5B4D-11CF-A8FD-00805F5C442B"), stored("F8699E40-5B4D-11CF-A8FD-00805F5C442B")


def asf_value(kind: Column, b: Column) -> Column:
    return F.when(kind == 0, utf16(b)).when(kind == 1, F.lower(F.hex(b))).when(kind == 2, F.when(F.conv(F.hex(b), 16, 10) == "0", "false").otherwise("true")).when(kind == 3, le(b, 0, 4).cast("string")).when(kind == 4, le64(b, 0).cast("string")).when(kind == 5, le(b, 0, 2).cast("string"))


def asf_tracks(e: DataFrame) -> DataFrame:
    """Streams with the properties and languages that refer to them by number, in whatever order they stand.

    A file has at most 127 streams: they, the properties and the languages are gathered by one aggregate on the path and matched as arrays, so the
    elements are shuffled once, decoded, and no join or window follows.
    """
    b = F.col("body")
    kind = F.lower(F.hex(part(b, 0, 16)))
    is_video, is_audio = kind == VIDEO, kind == AUDIO
    stream = F.struct(
        n_().alias("part"), F.when(is_video, "video").otherwise("audio").alias("kind"), le(b, 48, 2).bitwiseAND(0x7F).alias("stream"), (F.shiftright(le(b, 48, 2), 15) == 1).alias("encrypted"),
        F.when(is_video, le(b, 69, 4)).cast("int").alias("width"), F.when(is_video, le(b, 73, 4)).cast("int").alias("height"),
        F.when(is_video, F.decode(part(b, 81, 4), "ISO-8859-1")).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(le(b, 54, 2))))).alias("codec_raw"),
        F.when(is_audio, le(b, 56, 2)).cast("int").alias("channels"), F.when(is_audio, le(b, 58, 4)).cast("double").alias("samplerate"), F.when(is_audio, le(b, 62, 4) * 8).cast("double").alias("own_rate"), F.when(is_audio, le(b, 68, 2)).cast("int").alias("samplebits"),
    )
    extended = F.struct(n_(), le(b, 48, 2).alias("stream"), le(b, 16, 4).alias("rate"), le(b, 50, 2).alias("lang"), le64(b, 52).alias("time"))
    spoken = place_().endswith(f"{LANGUAGES}/language")
    mine = e.where((F.col("parser") == "asf") & (F.col("id").isin(STREAM, EXTENDED) | spoken))
    files = mine.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when((F.col("id") == STREAM) & (is_video | is_audio), stream))).alias("s"), F.collect_list(F.when(F.col("id") == EXTENDED, extended)).alias("x"),
        F.collect_list(F.when(spoken, F.struct(F.col("at").alias("lang"), b.cast("string").alias("name")))).alias("l"),
    )
    each = files.select("path", "s", "x", "l", F.posexplode("s").alias("k", "t"))
    # of repeated properties the last counts, which is the largest by its number
    each = each.withColumn("x", F.array_max(F.filter("x", lambda y: y["stream"] == F.col("t.stream"))))
    language = F.get(F.filter("l", lambda y: y["lang"] == F.col("x.lang")), F.lit(0))["name"]
    ordinal = F.size(F.filter(F.slice("s", F.lit(1), F.col("k")), lambda y: y["kind"] == F.col("t.kind")))
    time = F.when(F.col("x.time") == 0, 10_000).otherwise(F.col("x.time"))
    same = [F.col(f"t.{c}") for c in ("encrypted", "width", "height", "codec_raw", "channels", "samplerate", "samplebits")]
    return each.select("path", "t.part", "t.kind", F.col("t.stream").cast("string").alias("id"), *same, F.coalesce(F.col("x.rate").cast("double"), F.col("t.own_rate")).alias("bitrate"), (1e7 / time).alias("fps"), language.alias("language_raw"), ordinal.alias("ordinal"))


def asf_tables(e: DataFrame) -> DataFrame:
    """(path, table_name, stream, key, value) of extended descriptions and of streams' metadata."""
    mine = e.where(place_().rlike(f"({DESCRIPTION}|{METADATA})/[^/]*$") & (F.col("parser") == "asf"))
    return mine.select("path", "n", F.when(place_().contains(f"{DESCRIPTION}/"), "ASFDESCRIPTOR").otherwise("ASFMETADATA").alias("table_name"), F.col("at").alias("stream"), F.col("id").alias("key"), asf_value(F.col("size"), body_()).alias("value"))


def asf(e: DataFrame) -> DataFrame:
    sizes = lambda b, k: le(b, 2 * k, 2)

    def text(k: int):
        return lambda b: utf16(part(b, reduce(lambda a, i: a + sizes(b, i), range(k), F.lit(10)), sizes(b, k)))

    c = f"{ASF}/{CONTENT}"
    kinds = lambda guid: F.coalesce(F.bool_or((F.col("id") == STREAM) & (F.lower(F.hex(part(body_(), 0, 16))) == guid)), F.lit(False))
    hidden = F.bool_or(F.col("id").isin(*ENCRYPTED) | ((F.col("id") == STREAM) & (F.shiftright(le(body_(), 48, 2), 15) == 1)))
    m = by_file(e, length=at(f"{ASF}/{FILE}", lambda b: le64(b, 40) / 1e7), title=at(c, text(0)), artist=at(c, text(1)), copyright=at(c, text(2)), caption=at(c, text(3)), encrypted=F.coalesce(hidden, F.lit(False)), v=kinds(VIDEO), a=kinds(AUDIO))
    sound = F.col("a") & ~F.col("v")
    return m.select("*", F.when(sound, "audio").otherwise("av").alias("media"), F.when(sound, "audio/x-ms-asf").otherwise("video/x-ms-asf").alias("mime"), F.lit("asf format").alias("type")).drop("v", "a")


# --------------------------------------------------------------------------- Flash, Real
def amf_number(b: Column) -> Column:
    return F.when(be(b, 0, 1) == 0, float_be(part(b, 1, 8)))


def amf_text(b: Column) -> Column:
    """A script value as text."""
    return F.when(be(b, 0, 1) == 0, amf_number(b).cast("string")).when(be(b, 0, 1) == 1, F.when(be(b, 1, 1) > 0, "true").otherwise("false")).when(be(b, 0, 1) == 2, F.decode(part(b, 3), "UTF-8"))


def flv(e: DataFrame) -> DataFrame:
    number = lambda k: first(f"meta/{k}", amf_number)
    m = by_file(e, copyright=first("meta/creator", amf_text), width=number("width").cast("int"), height=number("height").cast("int"), length=number("duration"))
    return m.select("*", F.lit("video/flv").alias("mime"), F.lit("Flash Video").alias("type"))


def flv_tracks(e: DataFrame) -> DataFrame:
    """The first sound and the first picture tag of a file."""
    b = F.min_by(body_(), n_())
    g = e.where(place_().isin("audio", "video") & (F.col("parser") == "flv") & (F.length(body_()) > 0)).groupBy("path", F.col("id").alias("kind")).agg(b.alias("b"), F.min("n").alias("part"))
    flags, sound = be(F.col("b"), 0, 1), F.col("kind") == "audio"
    codec = F.when(sound, pick(("0x1", "0x2", "0x55", "0x1"), F.shiftright(flags, 4))).otherwise(pick(("FLV1", "MSS1", "VP60"), flags.bitwiseAND(15) - 2))
    rate = pick((5512.0, 11025.0, 22050.0, 44100.0), bits(flags, 2, 2))
    return g.select("path", "part", "kind", F.lit(0).alias("ordinal"), codec.alias("codec_raw"), F.when(sound, flags.bitwiseAND(1) + 1).cast("int").alias("channels"), F.when(sound, rate).alias("samplerate"))


def real(e: DataFrame) -> DataFrame:
    def text(k: int):
        def take(b: Column) -> Column:
            start = F.lit(0)
            for _ in range(k):
                start = start + 2 + be(b, start, 2).cast("int")
            return words(part(b, start + 2, be(b, start, 2).cast("int")))

        return at("CONT", take)

    m = by_file(e, title=text(0), artist=text(1), copyright=text(2), comment=text(3), length=F.max(F.when(place_() == "MDPR", be(body_(), 26, 4) / 1000)))
    return m.select("*", F.lit("video/real").alias("mime"), F.lit("Real Video").alias("type"))


def real_tracks(e: DataFrame) -> DataFrame:
    b = body_()
    name = be(b, 30, 1).cast("int")
    mime = words(part(b, name + 32, be(b, name + 31, 1).cast("int")))
    kind = F.when(mime.startswith("audio/"), "audio").when(mime.startswith("video/"), "video")
    mine = e.where((place_() == "MDPR") & (F.col("parser") == "real")).select("path", F.col("n").alias("part"), kind.alias("kind"), be(b, 0, 2).cast("string").alias("id"), be(b, 6, 4).cast("double").alias("bitrate"), (be(b, 26, 4) / 1000).alias("length"), mime.alias("codec_raw"))
    return numbered(mine.where(F.col("kind").isNotNull()))


# --------------------------------------------------------------------------- Ogg with pictures
# Comments that become attributes of OGM files.
OGM = {"title": "TITLE", "album": "ALBUM", "artist": "ARTIST", "comment": "COMMENT", "encoder": "ENCODER", "trackno": "TRACKNUMBER", "language_raw": "LANGUAGE", "genre": "GENRE"}


def ogm(e: DataFrame) -> DataFrame:
    t = ogm_tracks(e).groupBy("path").agg(F.max(F.when(F.col("kind") == "video", F.col("length"))).alias("length"))
    m = by_file(e, **{k: comment("packet/comment", v) for k, v in OGM.items()}).join(t, "path", "left")
    return m.select("*", F.lit("application/ogm").alias("mime"), F.lit("OGG Media").alias("type"))


def ogm_tracks(e: DataFrame) -> DataFrame:
    """A track for each stream's first packet; its length is the last position of its own pages."""
    b = F.col("b")
    first_ = e.where((place_() == "packet") & (F.col("size") == 0) & (F.col("parser") == "ogm")).select("path", F.col("n").alias("part"), F.col("at").alias("serial"), body_().alias("b"))
    pages = e.where(place_().isin("page", "tail/page") & (F.col("parser") == "ogm") & (F.hex(F.substring(body_(), 7, 8)) != "FFFFFFFFFFFFFFFF")).groupBy("path", le(body_(), 14, 4).alias("serial")).agg(F.max(page_granule(body_())).alias("granule"))
    vorbis, theora, dshow = starts(b, b"\x01vorbis"), starts(b, b"\x80theora"), starts(b, b"\x01Direct Show Samples embedded in Ogg")
    video, sound, text = starts(b, b"\x01video"), starts(b, b"\x01audio"), starts(b, b"\x01text")
    fps = F.when(video, 1e7 / F.nullif(le64(b, 17), F.lit(0))).when(theora, be(b, 22, 4) / F.nullif(be(b, 26, 4), F.lit(0)))
    rate = F.when(vorbis, le(b, 12, 4)).when(sound, le64(b, 25)).cast("double")
    shift = bits(be(b, 40, 2), 5, 5).cast("int")
    pictures = F.when(theora, F.floor(F.col("granule") / F.pow(F.lit(2), shift)) + F.col("granule") % F.pow(F.lit(2), shift).cast("long")).otherwise(F.col("granule"))
    t = first_.join(pages, ["path", "serial"], "left").select(
        "path", "part", F.when(vorbis | sound, "audio").when(theora | dshow | video, "video").when(text, "subtitle").alias("kind"), F.col("serial").cast("string").alias("id"),
        F.when(vorbis, "Vorbis").when(theora, "theora").when(dshow, "dshow").when(video | sound, words(part(b, 9, 4))).alias("codec_raw"), F.when(vorbis, be(b, 11, 1)).when(sound, le(b, 45, 2)).cast("int").alias("channels"), rate.alias("samplerate"),
        F.when(video, le(b, 45, 4)).when(theora, be(b, 14, 3)).cast("int").alias("width"), F.when(video, le(b, 49, 4)).when(theora, be(b, 17, 3)).cast("int").alias("height"), fps.alias("fps"),
        F.when(rate > 0, F.col("granule") / rate).when(fps > 0, pictures / fps).alias("length"),
    )
    return numbered(t.where(F.col("kind").isNotNull()))


def ogm_chapters(e: DataFrame) -> DataFrame:
    """CHAPTERnn and CHAPTERnnNAME comments, as far as their numbers follow one another from 01."""
    c = comments(e.where(F.col("parser") == "ogm")).where(F.col("key").rlike("^CHAPTER[0-9]{2}(NAME)?$")).select("path", "n", F.substring("key", 8, 2).cast("int").alias("k"), F.col("key").endswith("NAME").alias("named"), "value")
    g = c.groupBy("path", "k").agg(F.max_by(F.when(~F.col("named"), F.col("value")), F.when(~F.col("named"), n_())).alias("pos"), F.max_by(F.when(F.col("named"), F.col("value")), F.when(F.col("named"), n_())).alias("title"))
    w = Window.partitionBy("path").orderBy("k")
    whole = g.where("pos is not null and title is not null").withColumn("r", F.row_number().over(w)).where("k = r")
    return whole.select("path", F.col("k").alias("part"), F.lit("chapter").alias("kind"), (F.col("k") - 1).alias("ordinal"), chapter_seconds(F.col("pos")).alias("pos"), "title", F.lit(True).alias("enabled"))


# --------------------------------------------------------------------------- MPEG
def scr(b: Column) -> Column:
    """Clock of a pack header in seconds, MPEG-1 or MPEG-2 by its first bits."""
    return let(b, _scr)


def _scr(b: Column) -> Column:
    x = [be(b, k, 1) for k in range(6)]
    one = bits(x[0], 1, 3) * F.lit(1 << 30) + x[1] * (1 << 22) + F.shiftright(x[2], 1) * (1 << 15) + x[3] * 128 + F.shiftright(x[4], 1)
    two = bits(x[0], 3, 3) * F.lit(1 << 30) + bits(x[0], 0, 2) * (1 << 28) + x[1] * (1 << 20) + bits(x[2], 3, 5) * (1 << 15) + bits(x[2], 0, 2) * (1 << 13) + x[3] * 32 + F.shiftright(x[4], 3)
    return F.when(F.shiftright(x[0], 4) == 2, one).when(F.shiftright(x[0], 6) == 1, two) / 90_000


def pts(b: Column, at_: int) -> Column:
    x = [be(b, at_ + k, 1) for k in range(5)]
    return (bits(x[0], 1, 3) * F.lit(1 << 30) + (x[1] * 128 + F.shiftright(x[2], 1)) * (1 << 15) + x[3] * 128 + F.shiftright(x[4], 1)) / 90_000


def sequence_header(b: Column) -> Column:
    """struct<width, height, aspect, fps, bitrate> of an MPEG sequence header."""
    x = be(b, 0, 4)
    return F.struct(F.shiftright(x, 20).cast("int").alias("width"), bits(x, 8, 12).cast("int").alias("height"), pick(MPEG_ASPECTS, bits(x, 4, 4)).alias("aspect"), pick(MPEG_RATES, bits(x, 0, 4)).alias("fps"), (F.shiftright(be(b, 4, 3), 6) * 400).cast("double").alias("bitrate"))


def mpeg(e: DataFrame) -> DataFrame:
    """Program, packet, transport and elementary streams. Length is the last clock less the first, which wraps at 2^33 ticks."""
    pes_time = F.when((F.col("id") == "pes") & (F.shiftright(be(body_(), 4, 1), 7) == 1), pts(body_(), 6))
    packet_time = F.when(F.col("id").rlike("^[CDE].$") & (F.shiftright(be(body_(), 3, 1), 7) == 1), pts(body_(), 5))
    clock = F.when(F.col("id") == "BA", scr(body_()))
    ends = lambda c: (F.min_by(c, F.when(c.isNotNull(), n_())), F.max_by(c, F.when(c.isNotNull(), n_())))
    (c0, c1), (p0, p1), (t0, t1) = ends(clock), ends(packet_time), ends(pes_time)
    ext = lambda take: first("head/B5", lambda b: F.when(be(b, 0, 1).bitwiseAND(0xF0) == 0x10, take(b)))
    m = by_file(
        e, start=F.coalesce(c0, t0, p0), end=F.coalesce(c1, t1, p1), ts=has("ts-head"), packs=has("head/BA"), mpeg1=F.bool_or((F.col("id") == "BA") & (F.shiftright(be(body_(), 0, 1), 4) == 2)),
        packets=F.bool_or(F.col("id").rlike("^(BD|[CDE].)$") & (place_() != "")), h=first("head/B3", sequence_header), progressive=ext(lambda b: bits(be(b, 1, 1), 3, 1) == 1),
    )
    span = F.col("end") - F.col("start")
    kind = F.when(F.col("ts"), "MPEG-TS").when(F.col("packs"), F.when(F.col("mpeg1"), "MPEG-1 Video").otherwise("MPEG-2 Video")).when(F.coalesce("packets", F.lit(False)), "MPEG-PES").otherwise("MPEG Video")
    return m.select(
        "path", "parser", "size", "hash", "error", F.when(span < 0, span + (1 << 33) / 90_000).otherwise(span).alias("length"), "h.width", "h.height", "progressive", (~F.col("progressive")).alias("interlaced"), kind.alias("type"),
        F.when(F.col("ts"), "video/mp2t").otherwise("video/mpeg").alias("mime"),
    )


def mpeg_tracks(e: DataFrame) -> DataFrame:
    """A track for each stream number seen; codecs by the MPEG version, AC-3 by its sync word in private streams."""
    mine = e.where(F.col("parser") == "mpeg")
    version = mine.groupBy("path").agg(F.bool_or((F.col("id") == "BA") & (F.shiftright(be(body_(), 0, 1), 4) == 2)).alias("one"), first("head/B3", sequence_header).alias("h"))
    number = F.when(F.col("id") == "pes", F.col("size")).otherwise(F.when(F.col("id").rlike("^[0-9A-F]{2}$"), F.conv("id", 16, 10).cast("long")))
    ident = F.when(F.col("id") == "pes", F.col("at")).otherwise(number)
    private = (number == 0xBD) & F.hex(body_()).contains("0B77")
    kind = F.when(number.between(0xC0, 0xDF) | private, "audio").when(number.between(0xE0, 0xEF), "video")
    g = mine.withColumn("kind", kind).withColumn("id_", ident).withColumn("ac3", private).where("kind is not null").groupBy("path", "kind", F.col("id_")).agg(F.min("n").alias("part"), F.bool_or("ac3").alias("ac3"))
    j = g.join(version, "path", "left")
    video = F.col("kind") == "video"
    t = j.select("path", "part", "kind", F.col("id_").cast("string").alias("id"), F.when(F.col("ac3"), "0x2000").when(video, F.when(F.col("one"), "MPG1").otherwise("MPG2")).otherwise("0x50").alias("codec_raw"), *[F.when(video, F.col(f"h.{c}")).alias(c) for c in ("width", "height", "aspect", "fps", "bitrate")])
    return numbered(t)


MEDIA = {"mkv": mkv, "mp4": mp4, "riff": riff, "asf": asf, "flv": flv, "real": real, "ogm": ogm, "mpeg": mpeg}
TRACKS = {"mkv": (mkv_tracks, mkv_chapters), "mp4": (mp4_tracks,), "riff": (avi_tracks,), "asf": (asf_tracks,), "flv": (flv_tracks,), "real": (real_tracks,), "ogm": (ogm_tracks, ogm_chapters), "mpeg": (mpeg_tracks,)}
