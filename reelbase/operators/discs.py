"""Discs: images and cue sheets, tables of contents, titles and chapters, and the replies of disc databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binary import be, bits, part, utf8_or_latin1
from ..functions.codes import lookup, pick
from .pick import by_file, has, head
from .walk import elements


def iso(e: DataFrame) -> DataFrame:
    """Disc images by their markers; without any they are data discs."""
    dvd = has("UDF") & (has("VIDEO_TS") | has("OSTA UDF Compliant"))
    svcd, vcd = (has("SVCD") & has("TRACKS.SVD") & has("ENTRIES.SVD")) | has("SUPERVCD"), (has("INFO.VCD") & has("ENTRIES.VCD")) | has("VIDEO_CD")
    kind = F.when(dvd, "DVD").when(svcd, "SVCD").when(vcd, "VCD")
    m = by_file(e, type=F.coalesce(kind, F.lit("unknown")))
    return m.withColumn("mime", F.when(F.col("type") == "DVD", "video/dvd").when(F.col("type").isin("VCD", "SVCD"), "video/vcd").otherwise("unknown/unknown"))


def cue(e: DataFrame) -> DataFrame:
    """Cue sheets: the file that they name, and a video track for each track behind the first."""
    text = lambda f: head(lambda b: f(utf8_or_latin1(b)))
    tracks = text(lambda t: F.size(F.regexp_extract_all(t, F.lit(r"(?m)^\s*TRACK\s+([0-9]+)"), F.lit(1))))
    m = by_file(e, image=text(lambda t: F.regexp_extract(t, '^FILE "([^"]+)"', 1)), tracks=tracks)
    return m.select("*", F.create_map(F.lit("image"), "image", F.lit("tracks"), F.greatest(F.col("tracks") - 1, F.lit(0)).cast("string")).alias("extras"), F.lit("video/vcd").alias("mime"), F.lit("vcd video").alias("type")).drop("image", "tracks")


def cue_kind(cues: DataFrame, images: DataFrame) -> DataFrame:
    """Add ``subtype`` (VCD or SVCD) of the image that stands beside each cue sheet; null where it's missing or has no marker."""
    beside = images.select(F.col("path").alias("image_path"), F.col("type").alias("subtype_"))
    at = F.concat(F.regexp_extract("path", "^(.*/)?[^/]*$", 1), F.col("extras")["image"])
    return cues.join(beside, F.lower(at) == F.lower("image_path"), "left").withColumn("subtype", F.when(F.col("subtype_").isin("VCD", "SVCD"), F.col("subtype_"))).drop("subtype_", "image_path")


# --------------------------------------------------------------------------- tables of contents
def track_lengths(toc: DataFrame, disc: str = "disc", track: str = "track", start: str = "start") -> DataFrame:
    """Add ``length``: the next track's start less this one's; the last row of a disc is its lead-out and goes."""
    w = Window.partitionBy(disc).orderBy(track)
    return toc.withColumn("length", F.lead(start).over(w) - F.col(start)).where(F.col("length").isNotNull())


def disc_ids(toc: DataFrame, disc: str = "disc", track: str = "track", start: str = "start") -> DataFrame:
    """(disc, disc_id, n_tracks): digit sum of the starts in seconds, total time and number of tracks, in eight hexadecimal digits.

    The row with the largest track number is the lead-out. A number that eight digits don't hold, of times that no disc has, keeps all of its digits.
    """
    w = Window.partitionBy(disc).orderBy(F.desc(track))
    rows = toc.withColumn("k", F.row_number().over(w))
    digits = F.aggregate(F.split(F.col(start).cast("string"), ""), F.lit(0), lambda a, x: a + F.coalesce(x.try_cast("int"), F.lit(0)))
    g = rows.groupBy(disc).agg(F.sum(F.when(F.col("k") > 1, digits)).alias("digits"), F.max(F.when(F.col("k") == 1, F.col(start))).alias("out"), F.min(start).alias("first"), (F.count("*") - 1).alias("n_tracks"))
    total = F.col("out") - F.col("first")
    value = F.col("digits") % 255 * F.lit(1 << 24) + total * 256 + F.col("n_tracks")
    digits = F.hex(value.cast("long"))
    return g.where("n_tracks > 0").select(disc, F.lower(F.lpad(digits, F.greatest(F.length(digits), F.lit(8)), F.lit("0"))).alias("disc_id"), "n_tracks")


def clean_titles(tracks: DataFrame, disc: str = "disc") -> DataFrame:
    """Strip an artist's or title's prefix from track titles, if all tracks of the disc share it."""
    w = Window.partitionBy(disc)
    out = tracks
    for c in ("artist", "disc_title"):
        mark = F.concat(F.col(c), F.lit(" - "))
        shared = F.coalesce(F.bool_and(F.col("title").startswith(mark)).over(w), F.lit(False))
        out = out.withColumn("shared__", shared).withColumn("title", F.when(F.col("shared__"), F.substring(F.col("title"), F.length(mark) + 1, F.length("title"))).otherwise(F.col("title"))).drop("shared__")
    return out


# --------------------------------------------------------------------------- DVD titles
def chapter_positions(chapters: DataFrame, title: str = "title_id", ordinal: str = "chapter", length: str = "length") -> DataFrame:
    """Add ``pos``: the lengths of the chapters before it."""
    w = Window.partitionBy(title).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    return chapters.withColumn("pos", F.coalesce(F.sum(length).over(w), F.lit(0)))


def disc_lengths(titles: DataFrame, disc: str = "disc", ordinal: str = "title_no", length: str = "length") -> DataFrame:
    """(disc, length): all titles together; if their mean is the first's length, the disc repeats one title and has its length."""
    g = titles.groupBy(disc).agg(F.sum(length).alias("total"), F.avg(length).alias("mean"), F.min_by(length, ordinal).alias("one"))
    return g.select(disc, F.when(F.col("mean") == F.col("one"), F.col("one")).otherwise(F.col("total")).alias("length"))


def dvd_seconds(hour: Column, minute: Column, second: Column, frame: Column) -> Column:
    """Playing time of four BCD bytes; the top bits of the frame byte are the rate's code (1: 25, 3: 29.97 a second)."""
    two = lambda b: F.shiftright(b, 4) * 10 + b.bitwiseAND(15)
    frames = F.shiftright(frame.bitwiseAND(0x3F), 4) * 10 + frame.bitwiseAND(15)
    rate = lookup({1: 25.0, 3: 29.97}, F.shiftright(frame, 6).cast("int"))
    return two(hour) * 3600 + two(minute) * 60 + two(second) + F.coalesce(frames / rate, F.lit(0.0))


# Audio formats of DVD titles.
DVD_AUDIO = {0: "AC3", 2: "MPEG1", 3: "MPEG2EXT", 4: "LPCM", 6: "DTS"}


def ifo_elements(files: DataFrame) -> DataFrame:
    """Elements of a DVD folder's title set files (VTS_nn_0.IFO); other files are left out."""
    title = F.upper(F.regexp_extract("path", "(?i)VTS_[0-9]{2}_0\\.IFO$", 0)) != ""
    return elements(files.where(title).withColumn("parser", F.lit("ifo")))


def dvd_titles(e: DataFrame) -> DataFrame:
    """(path, title, chapters, length, width, height, aspect, fps, codec): one row for each programme chain of a title set."""
    b, a = F.col("body"), F.col("attributes")
    cells = e.where("place = 'pgc/cell'").groupBy("path", F.element_at("up", -1).alias("n")).agg(F.count("*").alias("cells"), F.sum(seconds_at(b, 4)).alias("length"))
    sets = e.where("place = 'attributes'").select("path", b.alias("attributes"))
    chains = e.where("place = 'pgc'").select("path", "n", be(b, 2, 1).cast("int").alias("chapters"), F.shiftright(be(b, 7, 1), 6).cast("int").alias("rate"))
    x = chains.join(cells, ["path", "n"], "left").join(sets, "path")
    number = F.row_number().over(Window.partitionBy("path").orderBy("n"))
    video = be(a, 0, 2)
    pal = bits(video, 12, 2) == 1
    size = bits(video, 3, 3).cast("int")
    tall = F.when(pal, 576).otherwise(480)
    return x.select(
        "path", number.alias("title"), "chapters", F.coalesce("length", F.lit(0.0)).alias("length"), pick((720, 704, 352, 352), size).alias("width"), F.when(size == 3, tall / 2).otherwise(tall).cast("int").alias("height"),
        lookup({0: 4 / 3, 3: 16 / 9}, bits(video, 10, 2).cast("int")).alias("aspect"), lookup({1: 25.0, 3: 29.97}, F.col("rate")).alias("fps"), pick(("MPEG1", "MPEG2"), bits(video, 14, 2)).alias("codec"),
    )


def seconds_at(b: Column, at: int) -> Column:
    return dvd_seconds(*[be(b, at + k, 1) for k in range(4)])


def dvd_streams(e: DataFrame) -> DataFrame:
    """(path, kind, ordinal, codec, language_raw, channels, samplerate): at most 8 sound and 32 subtitle streams of a title set."""
    b = F.col("body")
    a = e.where("place = 'attributes'")
    sound = a.select("path", F.explode(F.expr("sequence(0, 7)")).alias("ordinal"), b.alias("body")).where(F.col("ordinal") < be(b, 2, 2))
    at = F.col("ordinal") * 8 + 4
    sound = sound.select("path", F.lit("audio").alias("kind"), "ordinal", lookup(DVD_AUDIO, F.shiftright(be(b, at, 1), 5).cast("int")).alias("codec"), language(b, at + 2), (be(b, at + 1, 1).bitwiseAND(7) + 1).cast("int").alias("channels"), pick((48000.0, 96000.0), bits(be(b, at + 1, 1), 4, 2)).alias("samplerate"))
    text = a.select("path", F.explode(F.expr("sequence(0, 31)")).alias("ordinal"), b.alias("body")).where(F.col("ordinal") < be(b, 0x54, 2))
    text = text.select("path", F.lit("subtitle").alias("kind"), "ordinal", F.lit(None).cast("string").alias("codec"), language(b, F.col("ordinal") * 6 + 0x58), F.lit(None).cast("int").alias("channels"), F.lit(None).cast("double").alias("samplerate"))
    return sound.unionByName(text)


def language(b: Column, at: Column) -> Column:
    code = F.decode(part(b, at, 2), "ISO-8859-1")
    return F.when(code.rlike("^[a-z]{2}$"), code).alias("language_raw")


# --------------------------------------------------------------------------- disc databases
def parse_reply(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Replies as rows (..., key, value): values of repeated keys are joined, escapes undone; comments and what follows a lone dot go."""
    body = F.regexp_replace(F.concat(F.lit("\n"), F.replace(text, F.lit("\r"), F.lit(""))), "(?s)\n\\.(\n.*)?$", "")
    lines = replies.select(*[c for c in replies.columns if c != text], F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    lines = lines.where(F.col("line").rlike("^[^#=]+="))
    keys = [c for c in replies.columns if c != text]
    value = F.regexp_replace("line", "^[^=]*=", "")
    unescaped = F.replace(F.replace(F.regexp_replace(F.regexp_replace(F.replace(value, F.lit("\\\\"), F.lit("\1")), r"\\t", "\t"), r"\\n", "\n"), F.lit("\1"), F.lit("\\")), F.lit("\0"), F.lit(""))
    rows = lines.select(*keys, "line_no", F.substring_index("line", "=", 1).alias("key"), unescaped.alias("value"))
    return rows.groupBy(*keys, "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "").alias("value"))


def choose_title(found: DataFrame, query: str = "disc", ordinal: str = "n", title: str = "title") -> DataFrame:
    """Of a query's matches the first that isn't all capitals, else the first."""
    w = Window.partitionBy(query).orderBy((F.upper(title) == F.col(title)).cast("int"), ordinal)
    return found.withColumn("k__", F.row_number().over(w)).where("k__ = 1").drop("k__")


MEDIA = {"iso": iso, "cue": cue}
