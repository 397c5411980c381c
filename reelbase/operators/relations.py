"""The relations of a collection: media, tracks, tags, tables and artifacts, from elements that were split once.

``collect`` writes the elements under the shared folder, partitioned by parser, so that each decoder reads its own files' elements only
and the files themselves are read once. The relations are plain DataFrames.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import languages
from ..functions.text import SERIES, finalize, pad_track, resolve_language, series as split_series, with_codec
from ..shared import shared_path
from . import audio, discs, documents, games, id3, id3_edit, image, video
from .pick import body_

DECODERS = audio.MEDIA | video.MEDIA | image.MEDIA | games.MEDIA | discs.MEDIA | documents.MEDIA
KIND = dict.fromkeys(audio.MEDIA, "audio") | dict.fromkeys(video.MEDIA, "av") | dict.fromkeys(image.MEDIA, "image") | dict.fromkeys(games.MEDIA, "game") | dict.fromkeys(discs.MEDIA, "disc")

# The columns of the relations, in the order of the data model.
MEDIA_COLUMNS = (
    "path string, parser string, url string, hash string, size long, media string, mime string, type string, subtype string, title string, caption string, comment string, timestamp long, keywords array<string>, country string, "
    "language_raw string, langcode string, language string, artist string, datetime string, length double, encoder string, codec_raw string, fourcc string, codec string, channels int, samplerate double, samplebits int, bitrate double, bitrate_bps double, "
    "trackno string, trackof string, album string, genre string, discs string, composer string, publisher string, userdate string, width int, height int, copyright string, product string, writer string, producer string, studio string, rating string, actors string, "
    "software string, summary string, synopsis string, series string, season int, episode int, description string, location string, city string, hardware string, rotation int, author string, corrupt boolean, encrypted boolean, interlaced boolean, "
    "progressive boolean, extras map<string,string>, status string, error string"
)
TRACK_COLUMNS = (
    "path string, kind string, ordinal int, id string, trackno string, codec_raw string, fourcc string, codec string, language_raw string, langcode string, language string, length double, width int, height int, fps double, aspect double, "
    "channels int, samplerate double, samplebits int, bitrate double, title string, enabled boolean, is_default boolean, pos double"
)
#: Parsers whose bit rates are in kbit/s.
KILOBITS = ("mp3", "ogg", "riff")


@dataclass(frozen=True)
class Features:
    """What readers of the relations may switch on; without names all is off."""

    series: str | None = None  #: pattern of four groups (series, season, episode, title) by which names of videos are split; SERIES is the usual one
    codecs: DataFrame | None = None  #: (code, codec): a registry for codes that the built-in tables don't know
    languages: DataFrame | None = None  #: (code, language): names that go before the Java runtime's

    def __post_init__(self):
        if self.series is not None and re.compile(self.series).groups != 4:
            raise ValueError(f"a pattern with four groups (series, season, episode, title) is needed: {self.series!r}")


def fit(df: DataFrame, columns: str) -> DataFrame:
    """These columns with these types, null where df has none."""
    has = set(df.columns)
    pairs = [x.strip().split(" ", 1) for x in columns.split(", ")]
    return df.selectExpr(*[f"CAST({f'`{n}`' if n in has else 'NULL'} AS {t}) AS `{n}`" for n, t in pairs])


def stage(spark: SparkSession, elements: DataFrame) -> DataFrame:
    """Elements written once to the shared folder (spark.checkpoint.dir), partitioned by parser."""
    path = shared_path(spark, "elements")
    key = "spark.sql.maxConcurrentOutputFileWriters"  # a file for each of at most 25 parsers is open at once: no sort before the write
    before = spark.conf.get(key)
    spark.conf.set(key, "32")
    try:
        elements.write.partitionBy("parser").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(elements.schema).parquet(path).select(*elements.columns)


def media(elements: DataFrame, kinds: tuple[str, ...] = (), split_names: bool = False, decoders: dict[str, Callable[[DataFrame], DataFrame]] | None = None, features: Features = Features()) -> DataFrame:
    """One row a file, finalised: codes resolved, texts stripped, lengths of containers filled from their tracks.

    ``split_names`` stands for Features(series=SERIES).

    ``decoders`` adds those of one's own parsers by name; each turns elements into rows of path and any columns of the relation.
    """
    spark, known = elements.sparkSession, DECODERS | (decoders or {})
    names = [k for k in known if not kinds or k in kinds] or ["adts"]
    parts = [fit(known[k](elements.where(F.col("parser") == k)).withColumn("media_", F.lit(KIND.get(k))), MEDIA_COLUMNS.replace("media string", "media string, media_ string")) for k in names]
    m = reduce(DataFrame.unionByName, parts).withColumn("media", F.coalesce("media", "media_")).drop("media_")
    if any(k in video.TRACKS for k in names):
        longest = tracks(elements, tuple(names), resolve=False).groupBy("path").agg(container_length(F.col("kind"), F.col("ordinal"), F.col("length")).alias("longest"))
        m = m.join(longest, "path", "left").withColumn("length", F.when(F.coalesce("length", F.lit(0.0)) == 0, F.coalesce("longest", "length")).otherwise(F.col("length"))).drop("longest")
    strings = [c for c, t in m.dtypes if t == "string" and c not in ("path", "url", "parser", "hash", "error")]
    m = m.withColumns({c: finalize(F.col(c)) for c in strings})
    m = with_codec(m.drop("fourcc", "codec"), "codec_raw", features.codecs).withColumn("codec", F.when(F.col("codec_raw").isNotNull(), F.col("codec")))
    m = m.withColumns({"trackno": pad_track(F.col("trackno"), F.col("trackof")), "status": F.when(F.col("error").isNull(), "ok").when(F.col("error").startswith("left out"), "partial").otherwise("error"), "url": F.col("path")})
    m = m.withColumn("bitrate_bps", F.col("bitrate") * F.when(F.col("parser").isin(*KILOBITS), 1000).otherwise(1))
    pattern = features.series or (SERIES if split_names else None)
    if pattern:
        stem = F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\.[^.]*$", "")
        found = F.when((F.col("media") == "av") & F.col("series").isNull(), split_series(stem, pattern))
        m = m.withColumn("s__", found).withColumns({c: F.coalesce(F.col(f"s__.{c}"), F.col(c)) for c in ("series", "season", "episode", "title")}).drop("s__")
    return fit(resolve_language(m, "language_raw", languages(spark, features.languages)), MEDIA_COLUMNS)


def container_length(kind: Column, ordinal: Column, length: Column) -> Column:
    """The longest track's length, if the first video track has one."""
    first_video = F.max(F.when((kind == "video") & (ordinal == 0), length))
    return F.when(first_video > 0, F.max(F.when(kind.isin("video", "audio"), length)))


def tracks(elements: DataFrame, kinds: tuple[str, ...] = (), resolve: bool = True, decoders: dict[str, Callable[[DataFrame], DataFrame]] | None = None, features: Features = Features()) -> DataFrame:
    """Video, audio and subtitle streams and chapters, numbered within their kind. ``decoders`` and ``features``: as for media."""
    own = {k: [f] for k, f in (decoders or {}).items()}
    parts = [fit(f(elements.where(F.col("parser") == k)), TRACK_COLUMNS) for k, fs in (video.TRACKS | own).items() if not kinds or k in kinds for f in fs]
    if not parts:
        return fit(elements.limit(0).withColumn("path", F.col("path")), TRACK_COLUMNS)
    t = reduce(DataFrame.unionByName, parts)
    if not resolve:
        return t
    t = with_codec(t.drop("fourcc", "codec"), "codec_raw", features.codecs).withColumns({"title": finalize(F.col("title")), "codec": F.when(F.col("kind") != "chapter", F.col("codec"))})
    return fit(resolve_language(t, "language_raw", languages(elements.sparkSession, features.languages)), TRACK_COLUMNS)


def tags(elements: DataFrame, decoders: dict[str, Callable[[DataFrame], DataFrame]] | None = None, features: Features = Features()) -> DataFrame:
    """(path, scope, scope_ordinal, tag_path, n, value, binary_value, langcode, language) of Matroska's and ID3's tags.

    ``decoders`` adds those of one's own parsers by name; each turns elements into (path, n, name, value).
    """
    of = lambda k: elements.where(F.col("parser") == k)
    m = video.mkv_scoped_tags(of("mkv")).select("path", "scope", "scope_ordinal", "tag_path", "n", "value", "binary_value", F.col("langcode").alias("language_raw"))
    flat = lambda df: df.select("path", F.lit("file").alias("scope"), F.lit(None).cast("int").alias("scope_ordinal"), F.array("name").alias("tag_path"), "n", "value", F.lit(None).cast("binary").alias("binary_value"), F.lit("und").alias("language_raw"))
    m = reduce(DataFrame.unionByName, [m, flat(id3.tags(of("mp3"))), *(flat(f(of(k))) for k, f in (decoders or {}).items())])
    return resolve_language(m, "language_raw", languages(elements.sparkSession, features.languages)).drop("language_raw")


def tables(elements: DataFrame, decoders: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """(path, table_name, key, value): raw entries of all formats; of repeated keys the last counts.

    ``decoders`` adds those of one's own parsers by name; each turns elements into (path, n, table_name, key, value).
    """
    of = lambda *k: elements.where(F.col("parser").isin(*k))
    put = lambda df, name, key="key", value="value": df.select("path", (name if isinstance(name, Column) else F.lit(name)).alias("table_name"), F.col(key).alias("key"), F.col(value).alias("value"), "n")
    parts = [
        put(audio.comments(of("flac", "ogg", "ogm")), "VORBISCOMMENT"), put(image.png_tables(of("png")), "PNGMETA"), put(image.iptc(of("jpeg", "tiff")), "IPTC", "name"), put(video.asf_tables(of("asf")), F.col("table_name")),
        put(image.exif(of("jpeg", "tiff")).withColumn("key", F.concat("directory", F.lit(" "), "name")), "EXIF"), put(id3.frames(of("mp3")).withColumn("value", F.coalesce(F.array_join("texts", ""), "url")), "id3v2", "frameid"),
        put(of("flv").where(F.col("place").startswith("meta/")).select("path", "n", F.col("id").alias("key"), video.amf_text(body_()).alias("value")), "FLVINFO"),
        put(of("riff").where(F.col("place").rlike("/INFO/[^/]*$")).select("path", "n", F.col("id").alias("key"), F.trim(F.replace(F.decode(body_(), "ISO-8859-1"), F.lit("\0"), F.lit(""))).alias("value")), "AVIINFO"),
    ]
    parts += [f(of(k)).select("path", "table_name", "key", "value", "n") for k, f in (decoders or {}).items()]
    return reduce(DataFrame.unionByName, parts).where("value is not null").groupBy("path", "table_name", "key").agg(F.max_by("value", "n").alias("value"))


def artifacts(elements: DataFrame) -> DataFrame:
    """(path, kind, n, mime, description, data): pictures, thumbnails, covers and codecs' private data."""
    of = lambda *k: elements.where(F.col("parser").isin(*k))
    out = lambda df, kind: df.select("path", F.lit(kind).alias("kind"), "n", "mime", "description", "data")
    exif = of("jpeg", "tiff").where(F.col("place").endswith("Thumbnail/jpeg")).select("path", "n", F.lit("image/jpeg").alias("mime"), F.lit(None).cast("string").alias("description"), body_().alias("data"))
    private = video.mkv_tracks(of("mkv")).select("path", F.col("part").alias("n"), F.lit(None).cast("string").alias("mime"), F.col("codec_raw").alias("description"), F.col("private").alias("data"))
    parts = [out(audio.pictures(of("flac", "mp3")), "picture"), out(video.mkv_attachments(of("mkv")).where("is_cover"), "thumbnail"), out(exif, "thumbnail"), out(private, "codec_private")]
    return reduce(DataFrame.unionByName, parts).where("data is not null")


def present(staged: DataFrame) -> tuple[str, ...]:
    """Parsers that staged elements have, from the folders' names: at most as many as there are parsers. Others need no decoder."""
    return tuple(sorted(r[0] for r in staged.select("parser").distinct().collect()))


def collect(spark: SparkSession, elements: DataFrame, features: Features = Features()) -> dict[str, DataFrame]:
    """All relations of the elements, registered as temporary views of the same names."""
    e = stage(spark, elements)
    kinds = present(e)
    out = {"media": media(e, kinds, features=features), "tracks": tracks(e, kinds, features=features), "tags": tags(e, features=features), "tables": tables(e), "artifacts": artifacts(e), "warnings": id3_edit.warnings(e.where(F.col("parser") == "mp3"))}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def as_json(media: DataFrame) -> DataFrame:
    """(path, json): the attributes that a record has."""
    return media.select("path", F.to_json(F.struct(*[c for c in media.columns if c != "path"])).alias("json"))


def rendered(media: DataFrame) -> DataFrame:
    """(path, text): attributes, one a line, without the url; values over a thousand characters show their size."""
    shown = lambda c: F.when(F.length(F.col(c).cast("string")) > 1000, F.concat(F.lit("<unprintable data, size="), F.length(F.col(c).cast("string")).cast("string"), F.lit(">"))).otherwise(F.col(c).cast("string"))
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c:>12}: "), shown(c))) for c, t in media.dtypes if c not in ("path", "url", "error") and not t.startswith("map") and not t.startswith("array")]
    return media.select("path", F.concat_ws("\n", *lines).alias("text"))
