"""Audio files: what their elements say, in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import be, bits, le, le64, let, part, starts, utf8_or_latin1
from ..functions.codes import AC3_BITRATES, AC3_CHANNELS, AC3_RATES, MP3_BITRATES, MP3_MODES, MP3_RATES, PICTURE_TYPES, lookup, pick
from ..functions.text import genre, pad_track
from . import id3
from .pick import body_, n_, place_, at, by_file, comment, first, head, last, words


def mp3_header(window: Column) -> Column:
    """struct<version, layer, bitrate, samplerate, mode> of the first sound frame header in the bytes; bit rate in kbit/s."""
    word = F.regexp_extract(F.hex(window), "^(?:..)*?(FF(?:E[2-7]|F[2-7A-F])[1-9A-E][0-9A-B]..)", 1)
    return let(F.conv(F.nullif(word, F.lit("")), 16, 10).cast("long"), _mp3_fields)


def _mp3_fields(x: Column) -> Column:
    version, layer, rate = bits(x, 19, 2), 4 - bits(x, 17, 2), bits(x, 12, 4)
    bitrate = F.when(F.lit(False), 0)
    for (v, lay), values in MP3_BITRATES.items():
        bitrate = bitrate.when((F.when(version == 3, 1).otherwise(2) == v) & (layer == lay), pick(values, rate))
    samplerate = F.when(F.lit(False), 0)
    for v, values in MP3_RATES.items():
        samplerate = samplerate.when(version == v, pick(values, bits(x, 10, 2)))
    named = F.when(version == 0, 2.5).when(version == 2, 2.0).when(version == 3, 1.0)
    fields = {"version": named, "layer": layer.cast("int"), "bitrate": bitrate, "samplerate": samplerate, "mode": pick(MP3_MODES, bits(x, 6, 2))}
    return F.when(x.isNotNull(), F.struct(*[c.alias(k) for k, c in fields.items()]))


def ac3_header(content: Column) -> Column:
    """struct<samplerate, bitrate, channels> (bit/s) behind the first sync word at an even offset; null for codes that don't exist."""
    h = F.regexp_extract(F.hex(content), "^(?:....)*?0B77....(........)", 1)
    return let(F.unhex(F.nullif(h, F.lit(""))), _ac3_fields)


def _ac3_fields(x: Column) -> Column:
    rate, size, mode = bits(be(x, 0, 1), 6, 2), F.shiftright(bits(be(x, 0, 1), 0, 6), 1), bits(be(x, 2, 1), 5, 3)
    # what precedes the flag of the low-frequency channel depends on the mode
    before = F.when((mode.bitwiseAND(1) == 1) & (mode != 1), 2).otherwise(0) + F.when(mode.bitwiseAND(4) == 4, 2).otherwise(0) + F.when(mode == 2, 2).otherwise(0)
    low = F.floor(be(x, 2, 2).bitwiseAND(0x1FFF) / F.pow(F.lit(2), 12 - before)).cast("long").bitwiseAND(1)
    out = F.struct(pick(AC3_RATES, rate).alias("samplerate"), (pick(AC3_BITRATES, size) * 1000).alias("bitrate"), (pick(AC3_CHANNELS, mode) + low.cast("int")).alias("channels"))
    return let(out, lambda o: F.when(x.isNotNull() & o["samplerate"].isNotNull() & o["bitrate"].isNotNull(), o))


def streaminfo(b: Column) -> Column:
    """struct<samplerate, channels, samplebits, samples, length> of a FLAC STREAMINFO block."""
    x = be(b, 10, 4)
    samples = be(b, 13, 1).bitwiseAND(15) * F.lit(1 << 32) + be(b, 14, 4)
    rate = F.shiftright(x, 12)
    return F.struct(rate.cast("int").alias("samplerate"), (bits(x, 9, 3) + 1).cast("int").alias("channels"), (bits(x, 4, 5) + 1).cast("int").alias("samplebits"), samples.alias("samples"), F.when(rate > 0, samples / rate).alias("length"))


def flac_picture(b: Column) -> Column:
    """struct<type, mime, description, data> of a FLAC PICTURE block."""
    m = be(b, 4, 4)
    d = be(b, m + 8, 4)
    return F.struct(be(b, 0, 4).cast("int").alias("type"), words(part(b, 8, m)).alias("mime"), words(part(b, m + 12, d)).alias("description"), part(b, m + d + 32).alias("data"))


def kept_picture(place: str = "PICTURE") -> Column:
    """The last front cover (type 3), else the first picture of a file."""
    mine = place_() == place
    cover = mine & (be(body_(), 0, 4) == 3)
    return F.coalesce(F.max_by(F.when(cover, flac_picture(body_())["data"]), F.when(cover, n_())), F.min_by(F.when(mine, flac_picture(body_())["data"]), F.when(mine, n_())))


# Vorbis comments that become attributes.
FLAC_COMMENTS = {"title": "TITLE", "album": "ALBUM", "artist": "ARTIST", "comment": "COMMENT", "encoder": "ENCODER", "trackno": "TRACKNUMBER", "trackof": "TRACKTOTAL", "genre": "GENRE", "userdate": "DATE"}
OGG_COMMENTS = {"title": "TITLE", "album": "ALBUM", "artist": "ARTIST", "comment": "COMMENT", "userdate": "DATE", "encoder": "ENCODER", "trackno": "TRACKNUMBER"}


def flac(e: DataFrame) -> DataFrame:
    m = by_file(e, s=at("STREAMINFO", streaminfo), thumbnail=kept_picture(), **{k: comment("VORBIS_COMMENT/comment", v) for k, v in FLAC_COMMENTS.items()})
    return m.select("*", "s.samplerate", "s.channels", "s.samplebits", "s.length", F.lit("audio/flac").alias("mime"), F.lit("0xf1ac").alias("codec_raw")).withColumn("trackno", pad_track(F.col("trackno"), F.col("trackof"))).drop("s")


def page_granule(b: Column) -> Column:
    return F.when(F.length(b) >= 27, le64(b, 6))


def last_granule() -> Column:
    """Position that the file's last Ogg page has."""
    g = F.when(place_().isin("page", "tail/page") & (F.hex(F.substring(body_(), 7, 8)) != "FFFFFFFFFFFFFFFF"), page_granule(body_()))
    return F.max_by(g, F.when(g.isNotNull(), n_()))


def ogg(e: DataFrame) -> DataFrame:
    ident = lambda take: lambda b: F.when(starts(b, b"\x01vorbis"), take(b))
    signed = lambda x: F.when(x >= F.lit(1 << 31), x - F.lit(1 << 32)).otherwise(x)
    m = by_file(
        e, channels=at("packet", ident(lambda b: be(b, 11, 1))).cast("int"), samplerate=at("packet", ident(lambda b: le(b, 12, 4))).cast("int"), nominal=at("packet", ident(lambda b: signed(le(b, 20, 4)))),
        granule=last_granule(), cover=comment("packet/comment", "COVERART"), **{k: comment("packet/comment", v) for k, v in OGG_COMMENTS.items()},
    )
    return m.select(
        "*", (F.col("nominal") / 1000).alias("bitrate"), F.when(F.col("samplerate") > 0, F.col("granule") / F.col("samplerate")).alias("length"), F.try_to_binary("cover", F.lit("base64")).alias("thumbnail"),
        F.lit("audio/x-vorbis+ogg").alias("mime"), F.lit("Vorbis").alias("codec_raw"),
    ).drop("nominal", "granule", "cover")


def ac3(e: DataFrame) -> DataFrame:
    m = by_file(e, h=head(ac3_header))
    return m.select("*", "h.samplerate", F.col("h.bitrate").cast("double").alias("bitrate"), "h.channels", (F.col("size") * 8.0 / F.col("h.bitrate")).alias("length"), F.lit("audio/ac3").alias("mime"), F.lit("0x2000").alias("codec_raw")).drop("h")


def adts(e: DataFrame) -> DataFrame:
    return by_file(e).withColumn("mime", F.lit("audio/aac"))


def m4a(e: DataFrame) -> DataFrame:
    item = lambda name: last(f"moov/udta/meta/ilst/{name}", lambda b: words(part(b, 16)))
    v1 = lambda b: be(b, 0, 1) == 1
    m = by_file(
        e, artist=item("©ART"), title=item("©nam"), album=item("©alb"), userdate=item("©day"), genre=item("©gen"), comment=item("©cmt"), writer=item("©wrt"), encoder=item("©too"),
        trackno=last("moov/udta/meta/ilst/trkn", lambda b: be(b, 16, 4)).cast("string"),
        scale=first("moov/trak/mdia/mdhd", lambda b: F.when(v1(b), be(b, 20, 4)).otherwise(be(b, 12, 4))), units=first("moov/trak/mdia/mdhd", lambda b: F.when(v1(b), be(b, 25, 7)).otherwise(be(b, 16, 4))),
    )
    return m.select("*", F.col("scale").cast("int").alias("samplerate"), F.when(F.col("scale") > 0, F.col("units") / F.col("scale")).alias("length"), F.lit("audio/m4a").alias("mime")).drop("scale", "units")


def float80(b: Column) -> Column:
    """The integral part of an 80-bit float, as sample rates are stored in AIFF."""
    return F.when(F.length(b) == 10, be(b, 2, 4) * F.pow(F.lit(2.0), be(b, 0, 2) - 16383 - 31))


def pcm(e: DataFrame) -> DataFrame:
    """AIFF, AU and VOC: rate, channels, frames and sample bits; length and bit/s follow from them."""
    au = lambda take: head(lambda b: F.when(starts(b, b".snd"), take(b)))
    width = lambda b: lookup({1: 8, 2: 8, 3: 16, 4: 24, 5: 32, 6: 32, 7: 64, 27: 8}, be(b, 12, 4).cast("int"))
    m = by_file(
        e, kind=head(lambda b: F.when(starts(b, b".snd"), "au").when(starts(b, b"Creative"), "voc").when(starts(b, b"AIFC", 8), "aifc").otherwise("aiff")),
        rate=F.coalesce(at("COMM", lambda b: float80(part(b, 8, 10))), au(lambda b: be(b, 16, 4)), first("voc1", lambda b: 1_000_000 / (256 - be(b, 0, 1)))),
        channels=F.coalesce(at("COMM", lambda b: be(b, 0, 2)), au(lambda b: be(b, 20, 4)), first("voc1", lambda b: F.lit(1))).cast("int"),
        frames=F.coalesce(at("COMM", lambda b: be(b, 2, 4)), au(lambda b: F.when(be(b, 8, 4) < 0xFFFFFFFF, F.floor(be(b, 8, 4) / (be(b, 20, 4) * width(b) / 8)))), F.sum(F.when(place_() == "voc1", F.col("size") - 2))),
        samplebits=F.coalesce(at("COMM", lambda b: be(b, 6, 2)), au(width), first("voc1", lambda b: F.lit(8))).cast("int"),
    )
    rate = F.col("rate").cast("double")
    return m.select(
        "*", rate.cast("int").alias("samplerate"), F.when(rate > 0, F.col("frames") / rate).alias("length"), (rate * F.col("channels") * F.col("samplebits")).alias("bitrate"),
        F.concat(F.lit("audio/"), "kind").alias("mime"), F.col("kind").alias("type"), F.create_map(F.lit("nframes"), F.col("frames").cast("string")).alias("extras"),
    ).drop("rate", "frames", "kind")


def mp3(e: DataFrame) -> DataFrame:
    """Attributes of the tag's frames and the first sound frame; of repeated frames the first counts."""
    text = {k: id3.first_text(*names) for k, names in id3.ATTRIBUTES.items()}
    m = by_file(e, h=at("sync", mp3_header), thumbnail=id3.first_picture(), genre_raw=id3.first_text("TCON", "TCO"), day=id3.first_text("TDAT", "TDA"), year=id3.first_text("TDRC", "TYER", "TYE"), time=id3.first_text("TIME", "TIM"), lead=id3.first_text("TPE1", "TP1"), band=id3.first_text("TPE2", "TP2"), **text)
    track = F.col("trackno")
    from ..functions.text import friendly_date

    return m.select(
        *[c for c in m.columns if c not in ("h", "genre_raw", "day", "year", "time", "lead", "band", "trackno", "length")],
        F.coalesce("band", "lead").alias("artist"), F.substring_index(track, "/", 1).alias("trackno"), F.when(F.instr(track, "/") > 0, F.substring_index(track, "/", -1)).alias("trackof"),
        genre(F.col("genre_raw")).alias("genre"), friendly_date(F.col("year"), F.col("day"), F.col("time")).alias("userdate"), F.col("length").try_cast("double").alias("length"),
        F.col("h.bitrate").cast("double").alias("bitrate"), "h.samplerate", F.when(F.col("h").isNotNull(), F.create_map(F.lit("mode"), F.col("h.mode"), F.lit("version"), F.col("h.version").cast("string"))).alias("extras"),
        F.lit("audio/mpeg").alias("mime"), F.lit("0x55").alias("codec_raw"),
    )


MEDIA = {"mp3": mp3, "ac3": ac3, "adts": adts, "m4a": m4a, "ogg": ogg, "pcm": pcm, "flac": flac}


def comments(e: DataFrame) -> DataFrame:
    """Vorbis comments of FLAC and Ogg files as (path, n, key, value); entries without a sign are left out."""
    t = utf8_or_latin1(body_())
    mine = e.where((F.col("id") == "comment") & (F.instr(t, "=") > 0))
    return mine.select("path", "n", F.upper(F.substring_index(t, "=", 1)).alias("key"), F.regexp_replace(t, "(?s)^[^=]*=", "").alias("value"))


def pictures(e: DataFrame) -> DataFrame:
    """(path, n, type, type_name, mime, description, data) of FLAC's and ID3's embedded pictures."""
    f = e.where(place_() == "PICTURE").select("path", "n", flac_picture(body_()).alias("p")).select("path", "n", "p.*")
    i = id3.frames(e).where(F.col("picture_type").isNotNull()).select("path", "n", F.col("picture_type").alias("type"), "mime", "description", "data")
    return reduce(DataFrame.unionByName, [f, i]).withColumn("type_name", pick(PICTURE_TYPES, F.col("type")))
