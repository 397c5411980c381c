"""Scalar functions on attribute text: resolving codes, cleaning, dates, numbers. All are native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binary import let
from .codes import FOURCC, GENRES, PANORAMA, SPECIAL_MODES, TWOCC, codec_key, lookup, pick

SERIES = r"^(.+?)[\. _-]+[sS]?([0-9]|[0-9][0-9])[xeE]([0-9]|[0-9][0-9])[\. _-]+(.+)$"


def finalize(c: Column) -> Column:
    """Strip white space, then drop NULs."""
    return F.replace(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("\0"), F.lit(""))


def language_key(code: Column) -> Column:
    """Lower case, cut at the first character that isn't a letter, three letters at most; null for null and empty codes."""
    return F.when(F.length(code) > 0, F.substring(F.regexp_extract(F.lower(code), "^[a-z]*", 0), 1, 3))


def resolve_language(df: DataFrame, code_col: str, languages: DataFrame) -> DataFrame:
    """Add langcode and language. The table has a few hundred rows, so the join is broadcast by its size."""
    names = languages.select(F.col("code").alias("l__code"), F.col("language").alias("l__name"))
    x = df.withColumn("langcode", language_key(F.col(code_col))).join(names, F.col("langcode") == F.col("l__code"), "left")
    unknown = F.concat(F.lit("Unknown ("), "langcode", F.lit(")"))
    return x.withColumn("language", F.when(F.col("langcode").isNotNull(), F.coalesce("l__name", unknown))).drop("l__code", "l__name")


def hex_code(x: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(x.cast("long"))))


def resolve_codec(code: Column) -> Column:
    """struct<fourcc, codec> of a codec code as text: hexadecimal or decimal tag, two characters, four characters, or a name."""
    name = lambda n: F.coalesce(lookup(TWOCC, n.cast("int")), F.lit("Unknown"))
    give = lambda a, b: F.struct(a.cast("string").alias("fourcc"), b.cast("string").alias("codec"))
    tag = F.conv(F.substring(code, 3, 4), 16, 10)
    two = F.ascii(F.substring(code, 1, 1)) + 256 * F.ascii(F.substring(code, 2, 1))
    bare = F.when(code.startswith("MS") & F.upper(F.substring(code, 3, 99)).isin(*FOURCC), F.substring(code, 3, 99)).otherwise(code)
    plain = F.when((F.length(code) != 4) & ~code.rlike(r"[^\x20-\x7e\s]"), code).otherwise("Unknown")
    return (
        F.when(code.isNull(), give(F.lit(None), F.lit("Unknown")))
        .when(code.rlike("^0[xX][0-9a-fA-F]{1,4}$"), give(code, name(tag)))
        .when(code.rlike("^[0-9]+$") & (F.try_to_number(code, F.lit("9" * 18)) <= 255), give(hex_code(code.try_cast("long")), name(code.try_cast("int"))))
        .when(F.length(code) == 2, give(hex_code(two), name(two)))
        .when(F.upper(bare).isin(*FOURCC), give(F.upper(bare), lookup(FOURCC, F.upper(bare))))
        .otherwise(give(F.lit(None), plain))
    )


def with_codec(df: DataFrame, code_col: str, codecs: DataFrame | None = None) -> DataFrame:
    """Add fourcc and codec as ``resolve_codec`` does, and for codes that it doesn't know as the table (code, codec) has them.

    A registry has some hundreds of rows; it is broadcast if its size is below Spark's threshold. Of a code's rows the smallest name counts.
    """
    x = df.withColumn("c__", resolve_codec(F.col(code_col)))
    if codecs is None:
        return x.withColumns({"fourcc": F.col("c__.fourcc"), "codec": F.col("c__.codec")}).drop("c__")
    names = codecs.groupBy(codec_key(F.col("code")).alias("c__code")).agg(F.min("codec").alias("c__name"))
    own = F.coalesce(F.col("c__.fourcc"), F.when(F.length(code_col) == 4, F.col(code_col)))
    x = x.withColumn("c__key", F.when(F.col("c__.codec") == "Unknown", codec_key(own)).otherwise(F.when(F.col("c__.fourcc").isNull() & (F.length(code_col) == 4), codec_key(own))))
    x = x.join(names, F.col("c__key") == F.col("c__code"), "left")
    fourcc = F.coalesce("c__.fourcc", F.when(F.col("c__name").isNotNull(), F.col("c__key")))
    return x.withColumns({"fourcc": fourcc, "codec": F.coalesce("c__name", "c__.codec")}).drop("c__", "c__key", "c__code", "c__name")


def resolve_codec_by(df: DataFrame, code_col: str, codecs: DataFrame) -> DataFrame:
    """``with_codec`` with fourcc and codec in place of the code."""
    return with_codec(df, code_col, codecs).drop(code_col)


def genre(value: Column) -> Column:
    """A genre number, alone or in brackets at the start, as its name; other text as it is."""
    n = F.regexp_extract(value, r"^\(?([0-9]+)\)?$|^\(([0-9]+)\)", 0)
    number = F.regexp_replace(n, "[()]", "").try_cast("int")
    return F.when(number.isNotNull(), F.coalesce(pick(GENRES, number), F.lit("Unknown"))).otherwise(value)


def series(name: Column, pattern: str = SERIES) -> Column:
    """struct<series, season, episode, title> of a file name without suffix, null without exactly one match.

    A pattern of one's own has these four as its groups, in this order.
    """
    again = F.regexp_extract(name, pattern, 4).rlike(pattern)
    parts = F.struct(*[F.regexp_extract(name, pattern, i).alias(k) if i in (1, 4) else F.regexp_extract(name, pattern, i).try_cast("int").alias(k) for i, k in enumerate(("series", "season", "episode", "title"), 1)])
    return F.when(name.rlike(pattern) & ~again, parts)


def bits_per_second(text: Column) -> Column:
    """A bit rate from free text: kbit, kbyte, byte, bps or bit; bare numbers below 30000 are kilobits."""
    number = F.regexp_extract(text, r"([0-9.]+)\s*([^0-9].*)", 1).try_cast("double")
    unit = F.regexp_extract(text, r"([0-9.]+)\s*([^0-9].*)", 2)
    bare = text.try_cast("double")
    return (
        F.when(unit.contains("kbit"), number * 1024)
        .when(unit.contains("kbyte"), number * 8192)
        .when(unit.contains("byte"), number * 8)
        .when(unit.contains("bps") | unit.contains("bit"), number)
        .when(F.replace(text, F.lit("."), F.lit("")).rlike("^[0-9]+$"), F.when(bare < 30000, bare * 1024).otherwise(bare))
    )


def int_before_slash(v: Column) -> Column:
    return F.split(v, "/")[0].try_cast("int")


def split_track(v: Column) -> Column:
    """struct<trackno, trackof> of x/y; numbers below ten are padded when there is a total."""
    a, b = F.trim(F.split(v, "/")[0]), F.trim(F.get(F.split(v, "/"), F.lit(1)))
    return F.struct(pad_track(a, b).alias("trackno"), b.alias("trackof"))


def pad_track(trackno: Column, trackof: Column) -> Column:
    n = trackno.try_cast("int")
    return F.when((F.length(trackof) > 0) & (n < 10), F.concat(F.lit("0"), n.cast("string"))).otherwise(trackno)


def exif_time(s: Column) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(s, F.lit("yyyy:MM:dd HH:mm:ss")))


def riff_time(s: Column) -> Column:
    """Epoch of the date spellings in RIFF files."""
    forms = ("EEE MMM d HH:mm:ss yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")
    plain = F.regexp_replace(s, r"^[A-Za-z]{3} ", "")
    tries = [F.try_to_timestamp(F.regexp_replace(plain, " +", " "), F.lit(f.removeprefix("EEE "))) for f in forms]
    return F.unix_timestamp(F.coalesce(*tries))


def matroska_time(s: Column) -> Column:
    """Timestamp of a date that may lack its end; null if it isn't one."""
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH", "yyyy-MM-dd", "yyyy-MM", "yyyy")])


def quicktime_epoch(x: Column) -> Column:
    return x - F.lit(2082844800)


def matroska_epoch(ns: Column) -> Column:
    return ns / 1e9 + F.lit(978307200)


def rotation(orientation: Column) -> Column:
    """Degrees from an orientation's text."""
    return F.when(F.instr(orientation, "90 CW") > 1, 90).when(F.instr(orientation, "90") > 1, 270).when(F.instr(orientation, "180") > 1, 180).otherwise(0)


def chapter_seconds(s: Column) -> Column:
    """HH:MM:SS.s (or fewer parts) in seconds; null if a part is no number."""
    return F.aggregate(F.split(s, ":"), F.lit(0.0), lambda a, x: a * 60 + x.try_cast("double"))


def comment_pair(s: Column) -> Column:
    """struct<key, value> of KEY=value, key in upper case; null without a sign."""
    return F.when(F.instr(s, "=") > 0, F.struct(F.upper(F.substring_index(s, "=", 1)).alias("key"), F.regexp_replace(s, "^[^=]*=", "").alias("value")))


def frame_id_valid(s: Column) -> Column:
    return s.rlike("^[A-Z][A-Z0-9]{2}[A-Z0-9 ]?$")


def ratio(num: Column, den: Column) -> Column:
    """num/den in lowest terms, num alone for whole numbers."""
    pair = F.struct(F.abs(num).alias("a"), F.abs(den).alias("b"))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(64)), pair, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b"))), lambda s: F.greatest(s["a"], F.lit(1)))
    n, d = (lambda g: (num / g).cast("long")), (lambda g: (den / g).cast("long"))
    return let(gcd, lambda g: F.when(d(g) == 1, n(g).cast("string")).otherwise(F.concat(n(g).cast("string"), F.lit("/"), d(g).cast("string"))))


def friendly_date(year: Column, day_month: Column, time: Column) -> Column:
    """ID3v2.3's year, day-month and time frames as one date, as far as they go."""
    d = F.when(day_month.rlike("^[0-9]{4}$"), F.concat(F.lit("-"), F.substring(day_month, 3, 2), F.lit("-"), F.substring(day_month, 1, 2)))
    t = F.when(d.isNotNull() & time.rlike("^[0-9]{4}$"), F.concat(F.lit(" "), F.substring(time, 1, 2), F.lit(":"), F.substring(time, 3, 2)))
    return F.concat(year, F.coalesce(d, F.lit("")), F.coalesce(t, F.lit("")))


def friendly_number(v: Column, of: bool = False) -> Column:
    """Number before (or after) the slash, 0 if there is none."""
    return F.coalesce(F.get(F.split(v, "/"), F.lit(int(of))).try_cast("int"), F.lit(0))


def printable(s: Column) -> Column:
    """Characters from space to code 255."""
    return F.regexp_replace(s, r"[^\x20-\xff]", "")


def exposure_bias(values: Column) -> Column:
    """Four bytes [steps, ?, steps to an EV, ?] as text: whole EVs and a fraction in lowest terms; steps above 127 are negative."""
    first, per = values[0].cast("long"), values[2].cast("long")
    steps = F.when(first > 127, 256 - first).otherwise(first)
    sign = F.when(first > 127, "-").otherwise("+")
    whole, rest = F.floor(steps / per), steps % per
    text = F.concat(sign, F.when(whole > 0, F.concat(whole.cast("string"), F.lit(" "))).otherwise(""), F.when(rest == 0, "EV").otherwise(F.concat(ratio(rest, per), F.lit(" EV"))))
    return F.when(first == 0, "0 EV").when(per > 0, text)


def special_mode(values: Column) -> Column:
    """Three numbers [mode, sequence, direction] as text, null beyond the known ones."""
    return F.concat(pick(SPECIAL_MODES, values[0]), F.lit(" - sequence "), values[1].cast("string"), F.lit(" - "), pick(PANORAMA, values[2]))
