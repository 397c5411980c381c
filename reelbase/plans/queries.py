"""Queries over media files made from the tables, and the SQL that gives the same rows from the tables alone."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.binary import join, le, let, starts, to_le, to_syncsafe, zeros
from ..functions.codes import GENRES, codec_table, languages
from ..functions.table_functions import table_functions
from ..operators import audio, discs as D, documents, id3, id3_edit, image, relations as R, video
from ..operators.pick import at, by_file, by_part, head, numbered
from ..operators.walk import Grammar, elements
from ..shared import discard, shared_path, staged
from ..sources.media_files import media_source
from ..sources.registry import Parser, parser_by_suffix, route, suffix
from ..streaming.ingest import decode_stream, run_to_end, with_late_sidecars
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
C = F.col


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def key(name: str):
    """The number in a fixture's path."""
    return F.regexp_extract("path", r"([0-9]+)\.[^.]*$", 1).cast("long").alias(name)


def split(files: DataFrame) -> DataFrame:
    return elements(route(files))


def once(files: DataFrame) -> DataFrame:
    """Elements that several relations are made from: split and written once."""
    return R.stage(files.sparkSession, split(files))


def media(files: DataFrame, *kinds: str) -> DataFrame:
    # the length of a container also needs its tracks
    return R.media((once if any(k in video.TRACKS for k in kinds) else split)(files), kinds)


def tracks(files: DataFrame, *kinds: str) -> DataFrame:
    return R.tracks((once if any(len(video.TRACKS[k]) > 1 or k in ("riff", "mpeg", "ogm") for k in kinds) else split)(files), kinds)


# --------------------------------------------------------------------------- images
@query("gif_dims", "SELECT p_partkey, CAST(p_partkey % 65536 AS INT) AS width, p_size AS height, 'image/gif' AS mime, 'gif89a' AS type FROM part")
def gif_dims(spark, d):
    return media(X.gif(X.table(spark, d, "part")), "gif").select(key("p_partkey"), "width", "height", "mime", "type")


@query("bmp_dims", "SELECT p_partkey, CAST(p_partkey AS INT) AS width, p_size AS height, 'image/bmp' AS mime FROM part")
def bmp_dims(spark, d):
    return media(X.bmp(X.table(spark, d, "part")), "bmp").select(key("p_partkey"), "width", "height", "mime")


@query("png_text", "SELECT p_partkey, CAST(p_partkey AS INT) AS width, p_size AS height, 8 AS samplebits, p_name AS comment, p_brand AS software FROM part")
def png_text(spark, d):
    return media(X.png(X.table(spark, d, "part")), "png").select(key("p_partkey"), "width", "height", "samplebits", "comment", "software")


@query("tiff_dims", "SELECT p_partkey, CAST(p_partkey % 65536 AS INT) AS width, p_size AS height, 'image/tiff' AS mime FROM part")
def tiff_dims(spark, d):
    return media(X.tiff(X.table(spark, d, "part")), "tiff").select(key("p_partkey"), "width", "height", "mime")


@query(
    "jpeg_exif",
    """SELECT o_orderkey, CAST(o_orderkey % 2000 + 1 AS INT) AS width, CAST(o_orderkey % 1000 + 1 AS INT) AS height, 'CAM-' || o_orderpriority AS hardware, o_orderstatus AS comment,
    CAST(CASE o_orderkey % 8 + 1 WHEN 3 THEN 180 WHEN 5 THEN 270 WHEN 6 THEN 90 WHEN 7 THEN 90 WHEN 8 THEN 270 ELSE 0 END AS INT) AS rotation, CAST(epoch(o_orderdate) AS BIGINT) AS timestamp FROM orders""",
)
def jpeg_exif(spark, d):
    # "then rotated 90 CCW" has no "90 CW" and counts as 270, as does "90 CCW"
    return media(X.jpeg_exif(X.table(spark, d, "orders")), "jpeg").select(key("o_orderkey"), "width", "height", "hardware", "comment", "rotation", "timestamp")


@query("exif_entries", "SELECT o_orderkey, 'Image Model' AS entry, 'CAM-' || o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey, 'EXIF ExposureTime', '1/2' FROM orders UNION ALL SELECT o_orderkey, 'EXIF DateTimeOriginal', strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') FROM orders")
def exif_entries(spark, d):
    e = image.exif(split(X.jpeg_exif(X.table(spark, d, "orders"))))
    return e.where(C("name").isin("Model", "ExposureTime", "DateTimeOriginal")).select(key("o_orderkey"), F.concat_ws(" ", "directory", "name").alias("entry"), "value")


def _listed(values: dict[int, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items()) + f" ELSE CAST({key} AS VARCHAR) END"


@query(
    "exif_meanings",
    " UNION ALL ".join(
        f"SELECT p_partkey, '{name}' AS entry, {value} AS value FROM part"
        for name, value in {
            "Image ResolutionUnit": _listed({1: "Not Absolute", 2: "Pixels/Inch", 3: "Pixels/Centimeter"}, "p_partkey % 4"),
            "EXIF ExposureProgram": "coalesce(list_extract(['Unidentified', 'Manual', 'Program Normal', 'Aperture Priority', 'Shutter Priority', 'Program Creative', 'Program Action', 'Portrait Mode', 'Landscape Mode'], CAST(p_partkey % 10 + 1 AS INT)), '9')",
            "EXIF ComponentsConfiguration": "'YCb' || list_extract(['', 'Y', 'Cb', 'Cr', 'Red', 'Green', 'Blue'], CAST(p_partkey % 7 + 1 AS INT))",
            "EXIF Flash": _listed({0: "No", 1: "Fired", 5: "Fired (?)", 7: "Fired (!)", 9: "Fill Fired", 13: "Fill Fired (?)", 15: "Fill Fired (!)", 16: "Off", 24: "Auto Off", 25: "Auto Fired", 29: "Auto Fired (?)", 31: "Auto Fired (!)", 32: "Not Available"}, "p_partkey % 34"),
            "EXIF UserComment": "p_brand", "EXIF FileSource": _listed({3: "Digital Camera"}, "p_partkey % 4"), "EXIF SubjectDistanceRange": "CAST(p_partkey % 4 AS VARCHAR)", "Interop RelatedImageWidth": "CAST(p_partkey AS VARCHAR)",
        }.items()
    ),
)
def exif_meanings(spark, d):
    e = image.exif(split(X.jpeg_meanings(X.table(spark, d, "part")))).where(~C("name").isin("ExifOffset", "InteroperabilityOffset"))
    return e.select(key("p_partkey"), F.concat_ws(" ", "directory", "name").alias("entry"), "value")


@query("jpeg_iptc", "SELECT c_custkey, c_name AS title, c_mktsegment AS city, lower(c_mktsegment) || '|' || c_nationkey AS keywords, CAST(NULL AS VARCHAR) AS author FROM customer")
def jpeg_iptc(spark, d):
    return media(X.jpeg_iptc(X.table(spark, d, "customer")), "jpeg").select(key("c_custkey"), "title", "city", F.array_join("keywords", "|").alias("keywords"), "author")


@query(
    "maker_notes",
    """WITH k AS (SELECT p_partkey, p_size, p_partkey % 3 AS kind, CAST(p_partkey % 12 AS INT) AS s FROM part)
    SELECT p_partkey, 'FlashCompensation' AS name, CASE WHEN s = 0 THEN '0 EV' ELSE '+' || CASE WHEN s >= 6 THEN '1 ' ELSE '' END || list_extract(['', '1/6 ', '1/3 ', '1/2 ', '2/3 ', '5/6 '], s % 6 + 1) || 'EV' END AS value FROM k WHERE kind = 0
    UNION ALL SELECT p_partkey, 'ISOSetting', '[0, ' || p_size || ']' FROM k WHERE kind = 0
    UNION ALL SELECT p_partkey, 'SpecialMode', list_extract(['Normal', 'Unknown', 'Fast', 'Panorama'], CAST(p_partkey % 4 + 1 AS INT)) || ' - sequence ' || p_size || ' - ' || list_extract(['Non-panoramic', 'Left to right', 'Right to left', 'Bottom to top', 'Top to bottom'], CAST(p_partkey % 5 + 1 AS INT)) FROM k WHERE kind = 1
    UNION ALL SELECT p_partkey, 'Macro', CAST(p_size AS VARCHAR) FROM k WHERE kind = 1 UNION ALL SELECT p_partkey, 'FlashStrength', CAST(p_size AS VARCHAR) FROM k WHERE kind = 2""",
)
def maker_notes(spark, d):
    return image.maker_notes(once(X.jpeg_maker(X.table(spark, d, "part")))).select(key("p_partkey"), "name", "value")


@query(
    "maker_arrays",
    """WITH k AS (SELECT p_partkey, p_partkey AS k, p_size AS s FROM part)
    SELECT p_partkey, 1 AS position, 'Macromode' AS name, CASE k % 3 WHEN 1 THEN 'Macro' WHEN 2 THEN 'Normal' ELSE 'Unknown' END AS value FROM k
    UNION ALL SELECT p_partkey, 2, 'SelfTimer', CAST(s AS VARCHAR) FROM k
    UNION ALL SELECT p_partkey, 4, 'FlashMode', list_extract(['Flash Not Fired', 'Auto', 'On', 'Red-Eye Reduction', 'Slow Synchro', 'Auto + Red-Eye Reduction', 'On + Red-Eye Reduction'], CAST(k % 7 + 1 AS INT)) FROM k
    UNION ALL SELECT p_partkey, 6, NULL, CAST(k % 5 AS VARCHAR) FROM k
    UNION ALL SELECT p_partkey, 13, 'Contrast', list_extract(['Low', 'Normal', 'High'], CAST(k % 3 + 1 AS INT)) FROM k
    UNION ALL SELECT p_partkey, 17, 'MeteringMode', list_extract(['Evaluative', 'Partial', 'Center-weighted', 'Unknown'], CAST(k % 4 + 1 AS INT)) FROM k
    UNION ALL SELECT p_partkey, 29, 'FlashDetails', 'External E-TTL' FROM k
    UNION ALL SELECT p_partkey, 32, 'FocusMode', list_extract(['Single', 'Continuous'], CAST(k % 2 + 1 AS INT)) FROM k
    UNION ALL SELECT p_partkey, 107, 'WhiteBalance', list_extract(['Auto', 'Sunny', 'Cloudy', 'Tungsten', 'Fluorescent', 'Flash', 'Custom'], CAST(k % 7 + 1 AS INT)) FROM k
    UNION ALL SELECT p_partkey, 109, 'SequenceNumber', CAST(s AS VARCHAR) FROM k
    UNION ALL SELECT p_partkey, 115, 'FlashBias', list_extract(['-1 EV', '0 EV', '0.33 EV'], CAST(k % 3 + 1 AS INT)) FROM k""",
)
def maker_arrays(spark, d):
    """Positions of Canon's arrays with their names and meanings; those of the second one counted from 100."""
    a = image.maker_arrays(once(X.jpeg_canon(X.table(spark, d, "part"))))
    a = a.withColumn("position", C("position") + F.when(C("tag") == "0004", 100).otherwise(0)).where(C("position").isin(1, 2, 4, 6, 13, 17, 29, 32, 107, 109, 115))
    return a.select(key("p_partkey"), "position", "name", "value")


# --------------------------------------------------------------------------- audio
RATE = "list_extract([8000, 11025, 16000, 22050, 44100, 48000], CAST({} % 6 + 1 AS INT))"


@query("wav_length", f"SELECT p_partkey, 'audio/wav' AS mime, '0x1' AS fourcc, 'PCM' AS codec, CAST(r AS DOUBLE) AS samplerate, r * 4 / 125.0 AS bitrate, p_size * 4 / (r * 4.0) AS length FROM (SELECT *, {RATE.format('p_partkey')} AS r FROM part)")
def wav_length(spark, d):
    return media(X.wav(X.table(spark, d, "part")), "riff").select(key("p_partkey"), "mime", "fourcc", "codec", "samplerate", "bitrate", "length")


@query("flac_streaminfo", f"SELECT o_orderkey, CAST(r AS DOUBLE) AS samplerate, CAST(o_orderkey % 8 + 1 AS INT) AS channels, 16 AS samplebits, o_orderkey * 1000.0 / r AS length, 'FLAC' AS codec FROM (SELECT *, {RATE.format('o_orderkey')} AS r FROM orders)")
def flac_streaminfo(spark, d):
    return media(X.flac(X.table(spark, d, "orders")), "flac").select(key("o_orderkey"), "samplerate", "channels", "samplebits", "length", "codec")


@query("flac_comments", "SELECT o_orderkey, 'a=b ' || o_orderkey AS title, o_orderpriority AS artist, lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') AS trackno, '12' AS trackof, o_orderstatus AS cover FROM orders")
def flac_comments(spark, d):
    e = once(X.flac(X.table(spark, d, "orders")))
    cover = e.where("parser = 'flac'").groupBy("path").agg(audio.kept_picture().cast("string").alias("cover"))
    return R.media(e, ("flac",)).join(cover, "path").select(key("o_orderkey"), "title", "artist", "trackno", "trackof", "cover")


@query("ogg_vorbis", f"SELECT c_custkey, c_name AS title, c_mktsegment AS album, CAST(c_custkey % 20 AS VARCHAR) AS trackno, CAST(c_custkey % 2 + 1 AS INT) AS channels, CAST(r AS DOUBLE) AS samplerate, 128.0::DOUBLE AS bitrate, (c_custkey * 100 + 5) / CAST(r AS DOUBLE) AS length FROM (SELECT *, {RATE.format('c_custkey')} AS r FROM customer)")
def ogg_vorbis(spark, d):
    return media(X.ogg(X.table(spark, d, "customer")), "ogg").select(key("c_custkey"), "title", "album", "trackno", "channels", "samplerate", "bitrate", "length")


GENRE_SQL = "list_extract([" + ", ".join("'" + g.replace("'", "''") + "'" for g in GENRES[:60]) + "], CAST({} % 60 + 1 AS INT))"
MP3_SQL = f"SELECT c_custkey, c_name AS title, c_mktsegment AS artist, CASE WHEN c_custkey % 15 < 10 THEN '0' ELSE '' END || (c_custkey % 15) AS trackno, '15' AS trackof, {GENRE_SQL.format('c_custkey')} AS genre, CAST(1970 + c_custkey % 50 AS VARCHAR) AS userdate, 'MPEG Layer-3' AS codec FROM customer"


def _mp3(major: int):
    def run(spark, d):
        return media(X.mp3(X.table(spark, d, "customer"), major), "mp3").select(key("c_custkey"), "title", "artist", "trackno", "trackof", "genre", "userdate", "codec")

    return run


for major in (2, 3, 4):
    query(f"mp3_id3v2{major}", MP3_SQL)(_mp3(major))


@query(
    "mp3_header",
    """WITH t AS (SELECT c_custkey AS k, list_extract([0, 2, 3], CAST(c_custkey % 3 + 1 AS INT)) AS v, 4 - list_extract([1, 2, 3], CAST((c_custkey // 3) % 3 + 1 AS INT)) AS layer, CAST(c_custkey % 14 + 2 AS INT) AS b FROM customer)
    SELECT k AS c_custkey, CAST(CASE v WHEN 0 THEN 2.5 WHEN 2 THEN 2 ELSE 1 END AS DOUBLE) AS version, CAST(layer AS INT) AS layer, CAST(list_extract(CASE WHEN v = 3 THEN CASE layer WHEN 1 THEN
    [0,32,64,96,128,160,192,224,256,288,320,352,384,416,448] WHEN 2 THEN [0,32,48,56,64,80,96,112,128,160,192,224,256,320,384] ELSE [0,32,40,48,56,64,80,96,112,128,160,192,224,256,320] END
    ELSE CASE layer WHEN 1 THEN [0,32,48,56,64,80,96,112,128,144,160,176,192,224,256] ELSE [0,8,16,24,32,40,48,56,64,80,96,112,128,144,160] END END, b) AS INT) AS bitrate,
    CAST(list_extract(CASE v WHEN 0 THEN [11025,12000,8000] WHEN 2 THEN [22050,24000,16000] ELSE [44100,48000,32000] END, CAST(k % 3 + 1 AS INT)) AS INT) AS samplerate,
    list_extract(['stereo','joint stereo','dual channel','mono'], CAST(k % 4 + 1 AS INT)) AS mode FROM t""",
)
def mp3_header(spark, d):
    files = X.mp3(X.table(spark, d, "customer"), 4).withColumn("content", F.concat(F.lit(bytearray(b"\xff\x00noise")), id3.without_tag(C("content"))))
    return files.select(key("c_custkey"), audio.mp3_header(C("content")).alias("h")).select("c_custkey", "h.*")


@query("id3_frames", "SELECT c_custkey, 'TIT2' AS frameid, c_name AS said, CAST(NULL AS VARCHAR) AS description FROM customer UNION ALL SELECT c_custkey, 'COMM', c_mktsegment, '' FROM customer UNION ALL SELECT c_custkey, 'TXXX', CAST(c_custkey AS VARCHAR), 'balance' FROM customer UNION ALL SELECT c_custkey, 'APIC', c_name, 'back' FROM customer")
def id3_frames(spark, d):
    f = id3.modern(id3.frames(split(X.mp3(X.table(spark, d, "customer"), 3))))
    said = F.coalesce(F.array_join("texts", "/"), F.decode("data", "UTF-8"))
    return f.where(C("frameid").isin("TIT2", "COMM", "TXXX", "APIC")).select(key("c_custkey"), "frameid", said.alias("said"), "description")


@query("id3_friendly", "SELECT c_custkey, c_name AS title, c_mktsegment AS artist, CAST(c_custkey % 15 AS INT) AS track, 15 AS track_total, 0 AS disc, c_mktsegment AS comment, CAST(1970 + c_custkey % 50 AS VARCHAR) AS date FROM customer")
def id3_friendly(spark, d):
    return id3.friendly(id3.frames(split(X.mp3(X.table(spark, d, "customer"), 2)))).select(key("c_custkey"), "title", "artist", "track", "track_total", "disc", "comment", "date")


@query("id3_rewrite", "SELECT c_custkey, c_mktsegment AS title, CAST(NULL AS VARCHAR) AS artist, 'v' || CAST(c_custkey % 3 + 2 AS VARCHAR) AS version FROM customer")
def id3_rewrite(spark, d):
    """Put a new tag of another version in place of the old one, then read it."""
    files = X.mp3(X.table(spark, d, "customer"), 4).join(X.table(spark, d, "customer").select(F.concat(F.lit("c_custkey/"), C("c_custkey").cast("string"), F.lit(".mp3")).alias("path"), "c_mktsegment", "c_custkey"), "path")
    tag = {m: id3.id3v2_encode({name: id3.text_body(C("c_mktsegment"), 0)}, m) for m, name in ((2, "TT2"), (3, "TIT2"), (4, "TIT2"))}
    new = F.when(C("c_custkey") % 3 == 0, tag[2]).when(C("c_custkey") % 3 == 1, tag[3]).otherwise(tag[4])
    e = once(files.select("path", id3.with_tag(C("content"), new).alias("content")))
    version = e.where(C("id").startswith("ID3v2.")).select("path", F.concat(F.lit("v"), F.substring("id", 7, 1)).alias("version"))
    return R.media(e, ("mp3",)).join(version, "path").select(key("c_custkey"), "title", "artist", "version")


SHAPE_IDS = sorted({k for k in id3.SHAPES if len(k) == 4} | {v for v in id3.OLD.values() if v[0] in "TW"})
SHAPE_SQL = "CASE list_extract([" + ", ".join(f"'{k}'" for k in SHAPE_IDS) + f"], CAST(c_custkey % {len(SHAPE_IDS)} + 1 AS INT))"


def _shape(name: str) -> str:
    return id3.SHAPES.get(name) or ("text" if name[0] == "T" else "url")


@query(
    "id3_every_frame",
    f"SELECT c_custkey, f AS frameid, shape, CASE WHEN shape IN ('text', 'described', 'comment', 'terms') THEN c_name END AS said, CASE WHEN shape IN ('url', 'described_url', 'link') THEN 'http://x/' || c_custkey END AS url, CASE WHEN shape = 'count' THEN c_custkey WHEN shape = 'rating' THEN c_custkey % 256 END AS number, TRUE AS same "
    f"FROM (SELECT c_custkey, c_name, {SHAPE_SQL} {' '.join(f"WHEN '{k}' THEN '{k}'" for k in SHAPE_IDS)} END AS f, {SHAPE_SQL} {' '.join(f"WHEN '{k}' THEN '{_shape(k)}'" for k in SHAPE_IDS)} END AS shape FROM customer)",
)
def id3_every_frame(spark, d):
    """A frame of each kind, in each version's encodings: from fields to bytes, to fields, and to the same bytes again."""
    c = X.table(spark, d, "customer").withColumn("name", F.array(*map(F.lit, SHAPE_IDS))[(C("c_custkey") % len(SHAPE_IDS)).cast("int")])
    shape = F.create_map(*[F.lit(x) for k in SHAPE_IDS for x in (k, _shape(k))])[C("name")]
    link = F.concat(F.lit("http://x/"), C("c_custkey").cast("string"))
    f = F.struct(
        shape.alias("shape"), F.array("c_name").alias("texts"), F.lit("what").alias("description"), F.lit("deu").alias("language"), link.alias("url"), F.when(shape == "link", "TIT2").otherwise("me").alias("owner"),
        F.lit("image/png").alias("mime"), F.lit(4).alias("picture_type"), F.when(shape == "rating", C("c_custkey") % 256).otherwise(C("c_custkey")).alias("number"), F.encode("c_mktsegment", "UTF-8").alias("data"),
    )
    code = C("c_custkey") % 3
    body = F.when(code == 0, id3_edit.encoded(f, 3)).when(code == 1, id3_edit.encoded(f, 1)).otherwise(id3_edit.encoded(f, 0))
    one = let(body, lambda b: join(C("name"), to_syncsafe(F.length(b)), b"\0\0", b))
    tagged = X.files(c.withColumn("one", one), "c_custkey", "mp3", let(C("one"), lambda b: join(b"ID3\4\0\0", to_syncsafe(F.length(b)), b)))
    e = split(tagged).where(C("place").rlike("^ID3v2[.]4/")).select("path", C("id").alias("frameid"), C("body"), id3.own_fields(C("body")).alias("f"))
    k = F.regexp_extract("path", "[0-9]+", 0).cast("long") % 3
    again = F.when(k == 0, id3_edit.encoded(C("f"), 3)).when(k == 1, id3_edit.encoded(C("f"), 1)).otherwise(id3_edit.encoded(C("f"), 0))
    return e.select(key("c_custkey"), "frameid", C("f.shape").alias("shape"), F.array_join("f.texts", "/").alias("said"), C("f.url").alias("url"), C("f.number").alias("number"), (again == C("body")).alias("same"))


@query("id3_set_frame", "SELECT c_custkey, 'v' || CAST(c_custkey % 3 + 2 AS VARCHAR) AS version, upper(c_mktsegment) AS title, CAST(7 AS BIGINT) AS frames, TRUE AS others_same, TRUE AS sound_same FROM customer")
def id3_set_frame(spark, d):
    """Set the title and take the comment away in tags of all versions; every other frame keeps its bytes, and so does what follows the tag."""
    c = X.table(spark, d, "customer")
    files = reduce(DataFrame.unionByName, [X.mp3(c.where(C("c_custkey") % 3 == m - 2), m) for m in (2, 3, 4)])
    files = files.join(c.select(F.concat(F.lit("c_custkey/"), C("c_custkey").cast("string"), F.lit(".mp3")).alias("path"), "c_mktsegment"), "path")
    before = once(files.select("path", "content"))
    after = id3_edit.changed(files, before, {"TIT2": id3.text_body(F.upper("c_mktsegment"), 1), "COMM": None}).select("path", "content")
    e = once(after)
    gone = ("TIT2", "TT2", "COMM", "COM")
    digest = lambda files, e: id3_edit.tag_parts(files, e).select("path", F.transform(F.filter("frames", lambda f: ~f["id"].isin(*gone)), lambda f: F.md5(f["raw"])).alias("digests"), F.md5(id3.without_tag(C("content"))).alias("sound"))
    a, b = digest(files.select("path", "content"), before), digest(after, e).toDF("path", "digests_", "sound_")
    tag = e.where(C("id").startswith("ID3v2.")).select("path", F.concat(F.lit("v"), F.substring("id", 7, 1)).alias("version"))
    f = id3.modern(id3.frames(e)).groupBy("path").agg(F.max(F.when(C("frameid") == "TIT2", F.array_join("texts", ""))).alias("title"), F.count("*").alias("frames"))
    return f.join(tag, "path").join(a, "path").join(b, "path").select(key("c_custkey"), "version", "title", "frames", (C("digests") == C("digests_")).alias("others_same"), (C("sound") == C("sound_")).alias("sound_same"))


def _named_mp3s(c: DataFrame) -> DataFrame:
    """Files with tags of all versions, and the customer's columns."""
    files = reduce(DataFrame.unionByName, [X.mp3(c.where(C("c_custkey") % 3 == m - 2), m) for m in (2, 3, 4)])
    return files.join(c.withColumn("path", F.concat(F.lit("c_custkey/"), C("c_custkey").cast("string"), F.lit(".mp3"))), "path")


@query(
    "id3_friendly_set",
    "SELECT c_custkey, 'v' || CAST(c_custkey % 3 + 2 AS VARCHAR) AS version, lower(c_mktsegment) AS title, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS artist, CASE WHEN c_custkey % 3 = 2 THEN '2001-05-0' || (c_custkey % 9 + 1) || 'T10:30' ELSE '2001' END AS date, CAST(c_custkey % 7 AS INT) AS track, 9 AS track_total, CAST(c_nationkey AS VARCHAR) AS comment, "
    "CASE WHEN c_custkey % 3 < 2 THEN '0' || (c_custkey % 9 + 1) || '05 1030' END AS day_and_time FROM customer",
)
def id3_friendly_set(spark, d):
    """Title, date, track and comment by everyday names in tags of all versions; the artist is taken away from odd customers."""
    k, files = C("c_custkey"), _named_mp3s(X.table(spark, d, "customer"))
    date = F.concat(F.lit("2001-05-0"), (k % 9 + 1).cast("string"), F.lit("T10:30"))
    values = {"title": F.lower("c_mktsegment"), "artist": F.when(k % 2 == 0, C("c_name")), "date": date, "track": k % 7, "track_total": F.lit(9), "comment": C("c_nationkey").cast("string"), "composer": None}
    e = once(id3_edit.renamed(files, once(files.select("path", "content")), values).select("path", "content"))
    f = id3.frames(e)
    tag = e.where(C("id").startswith("ID3v2.")).select("path", F.concat(F.lit("v"), F.substring("id", 7, 1)).alias("version"))
    one = lambda *names: F.max(F.when(C("frameid").isin(*names), C("texts")[0]))
    days = f.groupBy("path").agg(F.concat(one("TDAT", "TDA"), F.lit(" "), one("TIME", "TIM")).alias("day_and_time"))
    m = id3.friendly(f).withColumn("artist", F.coalesce("artist", F.lit("")))
    return m.join(tag, "path").join(days, "path").select(key("c_custkey"), "version", "title", "artist", "date", "track", "track_total", "comment", "day_and_time")


@query(
    "id3_dump_load",
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'v4' WHEN 2 THEN 'v2' END AS version, CASE c_custkey % 3 WHEN 1 THEN NULL ELSE c_name END AS title, CASE c_custkey % 3 WHEN 1 THEN NULL ELSE TRUE END AS tag_same, TRUE AS sound_same FROM customer",
)
def id3_dump_load(spark, d):
    """Tags taken from files of version 2.4 and put into those of 2.2: by turns the other's tag, none, and no row, which leaves the own one."""
    c = X.table(spark, d, "customer")
    two, four = X.mp3(c, 2), X.mp3(c, 4)
    turn = F.regexp_extract("path", "([0-9]+)[.]", 1).cast("long") % 3
    dumps = id3_edit.dumped(four).withColumn("tag", F.when(turn == 0, C("tag"))).where(turn != 2)
    after = id3_edit.loaded(two, dumps)
    e = once(after)
    version = e.where(C("id").startswith("ID3v2.")).select("path", F.concat(F.lit("v"), F.substring("id", 7, 1)).alias("version"))
    title = id3.modern(id3.frames(e)).where(C("frameid") == "TIT2").select("path", F.array_join("texts", "").alias("title"))
    digest = lambda df, name: id3_edit.dumped(df).join(df, "path").select("path", F.md5("tag").alias(name), F.md5(id3.without_tag(C("content"))).alias(f"{name}_sound"))
    x = digest(after, "new").join(digest(two, "two"), "path").join(digest(four, "four"), "path").join(version, "path", "left").join(title, "path", "left")
    wanted = F.when(turn == 0, C("four")).when(turn == 2, C("two"))
    return x.select(key("c_custkey"), "version", "title", (C("new") == wanted).alias("tag_same"), (C("new_sound") == C("two_sound")).alias("sound_same"))


STAMP_SQL = "(1970 + c_custkey % 50) || '-' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || 'T' || lpad(CAST(c_custkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0')"
YEAR_SQL, DAY_SQL, CLOCK_SQL = "CAST(1970 + c_custkey % 50 AS VARCHAR)", "lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0')", "lpad(CAST(c_custkey % 24 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0')"


def _fates(to: str, rows) -> str:
    quoted = lambda x: "CAST(NULL AS VARCHAR)" if x is None else f"'{x}'"
    return " UNION ALL ".join(f"SELECT c_custkey, '{v}' AS version, '{to}' AS to_version, '{was}' AS was, {quoted(new)} AS frameid, '{fate}' AS fate, {value} AS value FROM customer" for v, was, new, fate, value in rows)


@query(
    "id3_converted",
    _fates("2.4", [("2.2", "TT2", "TIT2", "renamed", "c_name"), ("2.2", "TYE", "TDRC", "joined", STAMP_SQL), ("2.2", "TSI", None, "dropped", "'9'"), ("2.3", "TIT2", "TIT2", "kept", "c_name"), ("2.3", "TYER", "TDRC", "joined", STAMP_SQL), ("2.3", "TORY", "TDOR", "renamed", YEAR_SQL), ("2.3", "TSIZ", None, "dropped", "'9'"), ("2.4", "TIT2", "TIT2", "kept", "c_name"), ("2.4", "TDRC", "TDRC", "kept", STAMP_SQL), ("2.4", "TDOR", "TDOR", "kept", STAMP_SQL), ("2.4", "TMOO", "TMOO", "kept", "c_mktsegment")])
    + " UNION ALL " + _fates("2.3", [("2.2", "TT2", "TIT2", "renamed", "c_name"), ("2.2", "TYE", "TYER", "renamed", YEAR_SQL), ("2.2", "TDA", "TDAT", "renamed", DAY_SQL), ("2.2", "TIM", "TIME", "renamed", CLOCK_SQL), ("2.2", "TSI", "TSIZ", "renamed", "'9'"), ("2.3", "TIT2", "TIT2", "kept", "c_name"), ("2.3", "TYER", "TYER", "kept", YEAR_SQL), ("2.3", "TDAT", "TDAT", "kept", DAY_SQL), ("2.3", "TIME", "TIME", "kept", CLOCK_SQL), ("2.3", "TORY", "TORY", "kept", YEAR_SQL), ("2.3", "TSIZ", "TSIZ", "kept", "'9'"), ("2.4", "TIT2", "TIT2", "kept", "c_name"), ("2.4", "TDRC", "TYER", "split", YEAR_SQL), ("2.4", "TDRC", "TDAT", "split", DAY_SQL), ("2.4", "TDRC", "TIME", "split", CLOCK_SQL), ("2.4", "TDOR", "TORY", "renamed", YEAR_SQL), ("2.4", "TMOO", None, "dropped", "c_mktsegment")])
    + " UNION ALL " + _fates("2.2", [("2.2", "TT2", "TT2", "kept", "c_name"), ("2.2", "TYE", "TYE", "kept", YEAR_SQL), ("2.2", "TDA", "TDA", "kept", DAY_SQL), ("2.2", "TIM", "TIM", "kept", CLOCK_SQL), ("2.2", "TSI", "TSI", "kept", "'9'"), ("2.3", "TIT2", "TT2", "renamed", "c_name"), ("2.3", "TYER", "TYE", "renamed", YEAR_SQL), ("2.3", "TDAT", "TDA", "renamed", DAY_SQL), ("2.3", "TIME", "TIM", "renamed", CLOCK_SQL), ("2.3", "TORY", "TOR", "renamed", YEAR_SQL), ("2.3", "TSIZ", "TSI", "renamed", "'9'"), ("2.4", "TIT2", "TT2", "renamed", "c_name"), ("2.4", "TDRC", "TYE", "split", YEAR_SQL), ("2.4", "TDRC", "TDA", "split", DAY_SQL), ("2.4", "TDRC", "TIM", "split", CLOCK_SQL), ("2.4", "TDOR", "TOR", "renamed", YEAR_SQL), ("2.4", "TMOO", None, "dropped", "c_mktsegment")]),
)
def id3_converted(spark, d):
    """Tags of each version with dates, as each version names and cuts them."""
    c = X.table(spark, d, "customer")
    two = lambda x, n, more=0: F.lpad((x % n + more).cast("string"), 2, "0")
    k = C("c_custkey")
    year, day, clock = (1970 + k % 50).cast("string"), F.concat(two(k, 28, 1), two(k, 12, 1)), F.concat(two(k, 24), two(k, 60))
    stamp = F.concat(year, F.lit("-"), two(k, 12, 1), F.lit("-"), two(k, 28, 1), F.lit("T"), two(k, 24), F.lit(":"), two(k, 60))
    t = lambda x: id3.text_body(x, 0)
    bodies = {
        2: {"TT2": t(C("c_name")), "TYE": t(year), "TDA": t(day), "TIM": t(clock), "TSI": t(F.lit("9"))}, 3: {"TIT2": t(C("c_name")), "TYER": t(year), "TDAT": t(day), "TIME": t(clock), "TORY": t(year), "TSIZ": t(F.lit("9"))},
        4: {"TIT2": t(C("c_name")), "TDRC": t(stamp), "TDOR": t(stamp), "TMOO": t(C("c_mktsegment"))},
    }
    files = reduce(DataFrame.unionByName, [X.files(c.withColumn("v", F.lit(m)), "c_custkey", "mp3", id3.id3v2_encode(b, m)).withColumn("path", F.concat(F.lit(f"v{m}/"), C("path"))) for m, b in bodies.items()])
    f = id3.frames(once(files))
    out = [id3_edit.converted(f, to).withColumn("to_version", F.lit(to)) for to in ("2.2", "2.3", "2.4")]
    number = F.regexp_extract("path", "/([0-9]+)[.]", 1).cast("long").alias("c_custkey")
    return reduce(DataFrame.unionByName, out).select(number, "version", "to_version", "was", "frameid", "fate", F.array_join("texts", "").alias("value"))


@query(
    "id3_warnings",
    "SELECT c_custkey, element, code FROM (SELECT c_custkey, 'TIT2' AS element, list_extract(['unknown_encoding', 'bad_utf8', 'odd_utf16', NULL], CAST(c_custkey % 4 + 1 AS INT)) AS code FROM customer UNION ALL SELECT c_custkey, 'COMM', list_extract(['unknown_language', 'short', NULL], CAST(c_custkey % 3 + 1 AS INT)) FROM customer UNION ALL SELECT c_custkey, 'QQQQ', 'unknown_frame' FROM customer) WHERE code IS NOT NULL",
)
def id3_warnings(spark, d):
    """Frames that are garbled in several ways, and some that aren't."""
    k = C("c_custkey")
    title = F.when(k % 4 == 0, join(b"\7", C("c_name"))).when(k % 4 == 1, F.lit(bytearray(b"\3\xff\xfe\xff"))).when(k % 4 == 2, F.lit(bytearray(b"\1\xff\xfeabc"))).otherwise(join(b"\3", C("c_name")))
    comment = F.when(k % 3 == 0, join(b"\3\1\2\3\0", C("c_name"))).when(k % 3 == 1, F.lit(bytearray(b"\3en"))).otherwise(join(b"\3eng\0", C("c_name")))
    files = X.files(X.table(spark, d, "customer"), "c_custkey", "mp3", id3.id3v2_encode({"TIT2": title, "COMM": comment, "QQQQ": join(C("c_name"))}, 4))
    return id3_edit.warnings(split(files)).select(key("c_custkey"), "element", "code")


@query("id3v1_fields", f"SELECT p_partkey, p_name AS title, p_brand AS artist, p_type AS album, '1999' AS year, 'note' AS comment, p_size AS track, {GENRE_SQL.format('p_size')} AS genre FROM part")
def id3v1_fields(spark, d):
    return X.id3v1(X.table(spark, d, "part")).select(key("p_partkey"), id3.id3v1(F.expr("right(content, 128)")).alias("t")).select("p_partkey", "t.*")


@query(
    "ac3_header",
    """SELECT p_partkey, CAST(list_extract([48000,44100,32000], CAST(p_partkey % 3 + 1 AS INT)) AS DOUBLE) AS samplerate, b AS bitrate, CAST(list_extract([2,1,2,3,3,4,4,5], CAST(p_partkey % 8 + 1 AS INT)) + p_partkey % 2 AS INT) AS channels,
    108 * 8 / b AS length, 'AC-3' AS codec FROM (SELECT *, CAST(list_extract([32,40,48,56,64,80,96,112,128,160,192,224,256,320,384,448,512,576,640], CAST(p_partkey % 19 + 1 AS INT)) * 1000 AS DOUBLE) AS b FROM part)""",
)
def ac3_header(spark, d):
    return media(X.ac3(X.table(spark, d, "part")), "ac3").select(key("p_partkey"), "samplerate", "bitrate", "channels", "length", "codec")


@query("m4a_tags", "SELECT c_custkey, c_name AS title, c_mktsegment AS artist, 'Album é' AS album, CAST(c_custkey % 30 AS VARCHAR) AS trackno, CAST(44100 AS DOUBLE) AS samplerate, c_custkey * 441 / 44100.0 AS length FROM customer")
def m4a_tags(spark, d):
    return media(X.m4a(X.table(spark, d, "customer")), "m4a").select(key("c_custkey"), "title", "artist", "album", "trackno", "samplerate", "length")


@query(
    "pcm_headers",
    f"""SELECT p_partkey, list_extract(['audio/aiff', 'audio/au', 'audio/voc'], CAST(p_partkey % 3 + 1 AS INT)) AS mime, CASE WHEN p_partkey % 3 = 2 THEN 8000.0 ELSE CAST(r AS DOUBLE) END AS samplerate, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS channels,
    CASE WHEN p_partkey % 3 = 2 THEN 8 ELSE 16 END AS samplebits, p_size / CASE WHEN p_partkey % 3 = 2 THEN 8000.0 ELSE CAST(r AS DOUBLE) END AS length FROM (SELECT *, {RATE.format("p_partkey")} AS r FROM part)""",
)
def pcm_headers(spark, d):
    return media(X.pcm(X.table(spark, d, "part")), "pcm").select(key("p_partkey"), "mime", "samplerate", "channels", "samplebits", "length")


# --------------------------------------------------------------------------- containers
@query(
    "mkv_media",
    """SELECT c_custkey, 'inner' AS title, c_name AS series, c_mktsegment AS artist, 'a|b' AS keywords, 90.0::DOUBLE AS length, 978307200 + c_custkey AS timestamp, c_custkey % 2 <> 0 AS corrupt, CASE WHEN v > 0 THEN 'av' ELSE 'audio' END AS media
    FROM customer JOIN (SELECT o_custkey, count(*) FILTER (o_orderkey % 3 = 0) AS v FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
)
def mkv_media(spark, d):
    # a title within another tag counts as the file's, which makes the file's own title the series
    return media(X.mkv(X.with_orders(spark, d)), "mkv").select(key("c_custkey"), "title", "series", "artist", F.array_join("keywords", "|").alias("keywords"), "length", "timestamp", "corrupt", "media")


@query(
    "mkv_tracks",
    """SELECT o_custkey AS c_custkey, kind, CAST(row_number() OVER (PARTITION BY o_custkey, kind ORDER BY o_orderkey) - 1 AS INT) AS ordinal, CAST(n AS VARCHAR) AS trackno, o_orderstatus AS title, 'German' AS language,
    CASE kind WHEN 'video' THEN 'H.264/AVC' WHEN 'audio' THEN 'AC-3' ELSE 'S_TEXT/UTF8' END AS codec, CASE kind WHEN 'video' THEN CAST(o_orderkey % 2000 + 1 AS INT) END AS width, CASE kind WHEN 'audio' THEN CAST(o_orderkey % 6 + 1 AS INT) END AS channels,
    CASE kind WHEN 'video' THEN 25.0::DOUBLE END AS fps, CASE kind WHEN 'audio' THEN 44100.0::DOUBLE END AS samplerate
    FROM (SELECT *, list_extract(['video', 'audio', 'subtitle'], CAST(o_orderkey % 3 + 1 AS INT)) AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) JOIN customer ON c_custkey = o_custkey""",
)
def mkv_tracks(spark, d):
    return tracks(X.mkv(X.with_orders(spark, d)), "mkv").where("kind <> 'chapter'").select(key("c_custkey"), "kind", "ordinal", "trackno", "title", "language", "codec", "width", "channels", "fps", "samplerate")


@query("mkv_chapters", "SELECT o_custkey AS c_custkey, CAST(n AS INT) AS ordinal, n * 1.5::DOUBLE AS pos, o_orderpriority AS title FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders) JOIN customer ON c_custkey = o_custkey")
def mkv_chapters(spark, d):
    return tracks(X.mkv(X.with_orders(spark, d)), "mkv").where("kind = 'chapter'").select(key("c_custkey"), "ordinal", "pos", "title")


@query(
    "mkv_tags_by_uid",
    """WITH f AS (SELECT c_custkey, c_name, c_mktsegment, min(o_orderkey) AS k FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
    SELECT c_custkey, 'file' AS scope, 'artist' AS tag, c_mktsegment AS value FROM f UNION ALL SELECT c_custkey, 'file', 'keywords', 'a, b' FROM f UNION ALL SELECT c_custkey, 'file', 'original', 'x' FROM f
    UNION ALL SELECT c_custkey, 'file', 'original/title', 'inner' FROM f UNION ALL SELECT c_custkey, list_extract(['video', 'audio', 'subtitle'], CAST(k % 3 + 1 AS INT)), 'comment', c_name FROM f UNION ALL SELECT c_custkey, 'chapter', 'artist', 'chapter''s' FROM f""",
)
def mkv_tags_by_uid(spark, d):
    e = once(X.mkv(X.with_orders(spark, d)))
    t = video.mkv_scoped_tags(e)
    return t.select(key("c_custkey"), "scope", F.array_join("tag_path", "/").alias("tag"), "value")


@query("mkv_covers", "SELECT DISTINCT c_custkey, 'image/png' AS mime, c_name AS data FROM customer JOIN orders ON c_custkey = o_custkey")
def mkv_covers(spark, d):
    a = video.mkv_attachments(split(X.mkv(X.with_orders(spark, d)))).where("is_cover")
    return a.select(key("c_custkey"), "mime", C("data").cast("string").alias("data"))


@query("mp4_media", "SELECT o_orderkey, 'video/mp4' AS mime, o_orderpriority AS title, greatest(o_orderkey / 1000.0, o_orderkey * 12 / 600.0) AS length, o_orderkey AS timestamp FROM orders")
def mp4_media(spark, d):
    return media(X.mp4(X.table(spark, d, "orders")), "mp4").select(key("o_orderkey"), "mime", "title", "length", "timestamp")


@query(
    "mp4_tracks",
    """SELECT o_orderkey, 'video' AS kind, '1' AS id, CAST(o_orderkey % 1900 + 1 AS INT) AS width, CAST(o_orderkey % 1000 + 1 AS INT) AS height, o_orderkey * 6 / 600.0 AS length, 'H.264/AVC' AS codec, CASE WHEN o_orderkey % 2 = 1 THEN 'English' ELSE 'German' END AS language FROM orders
    UNION ALL SELECT o_orderkey, 'audio', '2', 0, 0, o_orderkey * 12 / 600.0, 'MPEG-4 AAC', CASE WHEN o_orderkey % 2 = 1 THEN 'English' ELSE 'German' END FROM orders""",
)
def mp4_tracks(spark, d):
    return tracks(X.mp4(X.table(spark, d, "orders")), "mp4").select(key("o_orderkey"), "kind", "id", "width", "height", "length", "codec", "language")


@query("avi_media", "SELECT o_orderkey, 'video/avi' AS mime, o_orderpriority AS title, o_orderstatus AS artist, o_orderkey / 25.0 AS length, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS timestamp, o_orderkey % 2 = 1 AS corrupt FROM orders")
def avi_media(spark, d):
    m = media(X.avi(X.table(spark, d, "orders")), "riff")
    return m.select(key("o_orderkey"), "mime", "title", "artist", F.coalesce("length", F.lit(0.0)).alias("length"), "timestamp", "corrupt")


@query(
    "avi_tracks",
    """SELECT o_orderkey, 'video' AS kind, 'XviD' AS codec, CAST(o_orderkey % 1000 + 16 AS INT) AS width, CAST(o_orderkey % 500 + 16 AS INT) AS height, 25.0::DOUBLE AS fps, (12 / 11.0::DOUBLE) * (o_orderkey % 1000 + 16) / (o_orderkey % 500 + 16) AS aspect, CAST(NULL AS DOUBLE) AS samplerate FROM orders
    UNION ALL SELECT o_orderkey, 'audio', 'MPEG Layer-3', NULL, NULL, NULL, NULL, 44100.0 FROM orders""",
)
def avi_tracks(spark, d):
    return tracks(X.avi(X.table(spark, d, "orders")), "riff").select(key("o_orderkey"), "kind", "codec", "width", "height", "fps", "aspect", "samplerate")


@query("asf_media", "SELECT o_orderkey, 'video/x-ms-asf' AS mime, o_orderpriority AS title, o_orderstatus AS artist, '(c)' AS copyright, 'about' AS caption, CAST(o_orderkey AS DOUBLE) AS length FROM orders")
def asf_media(spark, d):
    return media(X.asf(X.table(spark, d, "orders")), "asf").select(key("o_orderkey"), "mime", "title", "artist", "copyright", "caption", "length")


@query(
    "asf_streams",
    """SELECT o_orderkey, 'video' AS kind, '1' AS id, 'Windows Media Video 9' AS codec, CAST(o_orderkey % 1500 + 1 AS INT) AS width, CAST(o_orderkey * 100 AS DOUBLE) AS bitrate, 25.0::DOUBLE AS fps, 'English' AS language FROM orders
    UNION ALL SELECT o_orderkey, 'audio', '2', 'Windows Media Audio 2', NULL, CAST(o_orderkey * 8 AS DOUBLE), 1000.0, 'German' FROM orders""",
)
def asf_streams(spark, d):
    t = tracks(X.asf(X.table(spark, d, "orders")), "asf")
    return t.select(key("o_orderkey"), "kind", "id", "codec", "width", "bitrate", "fps", "language")


@query("flv_info", "SELECT o_orderkey, kind, CAST(o_orderkey % 1900 + 1 AS INT) AS width, CAST(o_orderkey + 1 AS DOUBLE) AS length, o_orderpriority AS copyright, CASE kind WHEN 'audio' THEN 'MPEG Layer-3' ELSE 'Sorenson Spark' END AS codec, CASE kind WHEN 'audio' THEN list_extract([5512.0, 11025.0, 22050.0, 44100.0], CAST(o_orderkey % 4 + 1 AS INT))::DOUBLE END AS samplerate FROM orders, (SELECT unnest(['audio', 'video']) AS kind)")
def flv_info(spark, d):
    e = once(X.flv(X.table(spark, d, "orders")))
    t = R.tracks(e, ("flv",)).select("path", "kind", "codec", "samplerate")
    return R.media(e, ("flv",)).select("path", "width", "length", "copyright").join(t, "path").select(key("o_orderkey"), "kind", "width", "length", "copyright", "codec", "samplerate")


@query("real_tracks", "SELECT o_orderkey, kind, o_orderpriority AS title, o_orderstatus AS artist, CAST(o_orderkey * 8 AS DOUBLE) AS bitrate, o_orderkey / 100.0 AS length FROM orders, (SELECT unnest(['audio', 'video']) AS kind)")
def real_tracks(spark, d):
    e = once(X.real(X.table(spark, d, "orders")))
    return R.media(e, ("real",)).select("path", "title", "artist").join(R.tracks(e, ("real",)).select("path", "kind", "bitrate", "length"), "path").select(key("o_orderkey"), "kind", "title", "artist", "bitrate", "length")


@query(
    "ogm_tracks",
    """SELECT o_orderkey, 'video' AS kind, 0 AS ordinal, 'XviD' AS codec, CAST(o_orderkey % 700 + 1 AS INT) AS width, CAST(o_orderkey AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS title FROM orders UNION ALL SELECT o_orderkey, 'audio', 0, 'Vorbis', NULL, o_orderkey / 1000.0, NULL FROM orders
    UNION ALL SELECT o_orderkey, 'chapter', 0, NULL, NULL, 0.0, 'one' FROM orders UNION ALL SELECT o_orderkey, 'chapter', 1, NULL, NULL, 60.5 + o_orderkey % 60, o_orderpriority FROM orders""",
)
def ogm_tracks(spark, d):
    return tracks(X.ogm(X.table(spark, d, "orders")), "ogm").select(key("o_orderkey"), "kind", "ordinal", "codec", "width", F.coalesce("pos", "length").alias("value"), "title")


@query(
    "mpeg_media",
    """SELECT o_orderkey, list_extract(['MPEG Video', 'MPEG-2 Video', 'MPEG-TS'], CAST(o_orderkey % 3 + 1 AS INT)) AS type, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderkey % 1900 + 1 AS INT) END AS width, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderkey % 1000 + 1 AS INT) END AS height,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 80000 AS DOUBLE) END AS length, CASE WHEN o_orderkey % 3 = 1 THEN true END AS progressive FROM orders""",
)
def mpeg_media(spark, d):
    return media(X.mpeg(X.table(spark, d, "orders")), "mpeg").select(key("o_orderkey"), "type", "width", "height", "length", "progressive")


@query("mpeg_tracks", "SELECT o_orderkey, kind, CASE WHEN o_orderkey % 3 = 1 THEN CASE kind WHEN 'audio' THEN '192' ELSE '224' END ELSE CASE kind WHEN 'audio' THEN '257' ELSE '256' END END AS id, CASE kind WHEN 'audio' THEN 'MPEG Layer-2' ELSE 'MPEG-2 Video' END AS codec FROM orders, (SELECT unnest(['audio', 'video']) AS kind) WHERE o_orderkey % 3 > 0")
def mpeg_tracks(spark, d):
    return tracks(X.mpeg(X.table(spark, d, "orders")), "mpeg").select(key("o_orderkey"), "kind", "id", "codec")


# --------------------------------------------------------------------------- games, markup, sidecars, discs
@query("game_titles", "SELECT p_partkey, list_extract(['games/gb', 'games/gbc', 'games/gba', 'games/snes'], CAST(p_partkey % 4 + 1 AS INT)) AS mime, trim(CASE WHEN p_partkey % 4 = 3 THEN regexp_replace(upper(p_name), '[^A-Z0-9 ]', ' ', 'g') ELSE left(upper(p_name), CASE WHEN p_partkey % 4 = 2 THEN 12 ELSE 15 END) END) AS title FROM part")
def game_titles(spark, d):
    return media(X.games(X.table(spark, d, "part")), "gameboy", "snes").select(key("p_partkey"), "mime", "title")


@query(
    "markup_kinds",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'text/html' ELSE 'text/xml' END AS mime, CASE WHEN page_id % 2 = 0 THEN 'HTML file' ELSE list_extract(['image', 'album', 'text', 'text'], CAST((page_id // 2) % 4 + 1 AS INT)) END AS type FROM pages WHERE page_id % 2 = 0 OR page_id % 10 <> 9""",
)
def markup_kinds(spark, d):
    return media(X.markup(X.table(spark, d, "pages")), "xml").select(key("page_id"), "mime", "type")


@query("image_sidecars", "SELECT p_partkey, p_size AS height, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' & co' END AS title, CASE WHEN p_partkey % 2 = 0 THEN 'p' END AS city FROM part")
def image_sidecars(spark, d):
    p = X.table(spark, d, "part")
    text = F.concat(F.lit('<image><description><field name="title">'), C("p_name"), F.lit(' &amp; co</field>\n<field name="city"> p </field><field name="title">again</field></description></image>'))
    side = X.files(p.where("p_partkey % 2 = 0"), "p_partkey", "gif.xml", F.encode(text, "UTF-8"))
    m = documents.with_image_sidecars(media(X.gif(p), "gif"), side)
    return m.select(key("p_partkey"), "height", "title", "city")


@query("subtitle_sidecars", "SELECT o_orderkey, CAST(i AS INT) AS ordinal, CASE i WHEN 0 THEN 'en' ELSE 'de' END AS language_raw FROM orders, (SELECT unnest([0, 1]) AS i) WHERE o_orderkey % 3 = 0")
def subtitle_sidecars(spark, d):
    """Index files stand beside two of three videos, their data beside one of three."""
    o = X.table(spark, d, "orders")
    text = F.lit("# VobSub index file, v7\nsize: 720x576\nid: en, index: 0\ntimestamp: 0\nid: de, index: 1\n")
    idx = X.files(o.where("o_orderkey % 3 < 2"), "o_orderkey", "idx", F.encode(text, "UTF-8"))
    sub = X.files(o.where("o_orderkey % 3 <> 1"), "o_orderkey", "sub", F.lit(bytearray(b"x")))
    videos = X.files(o, "o_orderkey", "avi", F.lit(bytearray(b"")))
    return documents.subtitle_sidecars(videos, idx.unionByName(sub)).select(key("o_orderkey"), "ordinal", "language_raw")


@query("directory_info", "SELECT 'd/' || CAST(p_partkey % 10 AS VARCHAR) AS directory, max('N' || (p_partkey % 10)) AS title, 'd/' || CAST(p_partkey % 10 AS VARCHAR) || '/folder.jpg' AS image, count(*) + 2 AS n_files FROM part GROUP BY p_partkey % 10")
def directory_info(spark, d):
    p = X.table(spark, d, "part").select(F.concat(F.lit("d/"), (C("p_partkey") % 10).cast("string"), F.lit("/")).alias("dir"), F.concat(C("p_partkey").cast("string"), F.lit(".gif")).alias("name"), F.lit(bytearray(b"GIF89a")).alias("content"))
    dirs = p.select("dir").distinct()
    notes = dirs.select("dir", F.lit(".directory").alias("name"), F.encode(F.concat(F.lit("[Desktop Entry]\nName=N"), F.regexp_extract("dir", "([0-9]+)/$", 1), F.lit("\nIcon=./x.png\n")), "UTF-8").alias("content"))
    covers = dirs.select("dir", F.lit("folder.jpg").alias("name"), F.lit(bytearray(b"\xff\xd8")).alias("content"))
    files = p.unionByName(notes).unionByName(covers).select(F.concat("dir", "name").alias("path"), "content")
    return documents.directories(files).select("directory", "title", "image", "n_files")


@query("disc_images", "SELECT p_partkey, list_extract(['DVD', 'VCD', 'SVCD', 'unknown'], CAST(p_partkey % 4 + 1 AS INT)) AS type, CASE p_partkey % 4 WHEN 1 THEN 'VCD' WHEN 2 THEN 'SVCD' END AS subtype, CAST(p_partkey % 5 AS VARCHAR) AS tracks FROM part")
def disc_images(spark, d):
    m = media(X.discs(X.table(spark, d, "part").where("p_partkey >= 0")), "iso", "cue")
    images = m.where("parser = 'iso'")
    sheets = D.cue_kind(m.where("parser = 'cue'").drop("subtype"), images)
    return images.select(key("p_partkey"), "type").join(sheets.select(key("p_partkey"), "subtype", C("extras")["tracks"].alias("tracks")), "p_partkey")


ORDERS = "SELECT o_custkey AS disc, o_orderkey AS start, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS track FROM orders"


def _toc(spark, d):
    from pyspark.sql import Window

    o = X.table(spark, d, "orders")
    return o.select(C("o_custkey").alias("disc"), C("o_orderkey").alias("start"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("track"))


@query("cd_track_lengths", f"SELECT * FROM (SELECT disc, CAST(track AS INT) AS track, start, lead(start) OVER (PARTITION BY disc ORDER BY track) - start AS length FROM ({ORDERS})) WHERE length IS NOT NULL")
def cd_track_lengths(spark, d):
    return D.track_lengths(_toc(spark, d)).select("disc", "track", "start", "length")


@query(
    "cddb_disc_ids",
    f"""WITH t AS ({ORDERS}), n AS (SELECT *, max(track) OVER (PARTITION BY disc) AS last FROM t), g AS (SELECT disc, sum(CASE WHEN track < last THEN list_sum(list_transform(string_split(CAST(start AS VARCHAR), ''), lambda x: CAST(x AS INT))) END) AS digits,
    max(start) - min(start) AS total, count(*) - 1 AS n FROM n GROUP BY disc) SELECT disc, printf('%08x', CAST(digits % 255 * 16777216 + total * 256 + n AS BIGINT)) AS disc_id, n AS n_tracks FROM g WHERE n > 0""",
)
def cddb_disc_ids(spark, d):
    return D.disc_ids(_toc(spark, d))


@query("dvd_chapter_pos", "SELECT o_custkey AS title_id, o_orderkey AS chapter, o_orderkey % 600 AS length, CAST(coalesce(sum(o_orderkey % 600) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM orders")
def dvd_chapter_pos(spark, d):
    o = X.table(spark, d, "orders").select(C("o_custkey").alias("title_id"), C("o_orderkey").alias("chapter"), (C("o_orderkey") % 600).alias("length"))
    return D.chapter_positions(o)


@query("dvd_lengths", "SELECT o_custkey AS disc, CAST(CASE WHEN avg(o_orderkey % 3) = arg_min(o_orderkey % 3, o_orderkey) THEN arg_min(o_orderkey % 3, o_orderkey) ELSE sum(o_orderkey % 3) END AS BIGINT) AS length FROM orders GROUP BY o_custkey")
def dvd_lengths(spark, d):
    return D.disc_lengths(X.table(spark, d, "orders").select(C("o_custkey").alias("disc"), C("o_orderkey").alias("title_no"), (C("o_orderkey") % 3).alias("length")))


@query("dvd_times", "SELECT o_orderkey, (o_orderkey % 10) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 59 + (o_orderkey % 25) / 25.0::DOUBLE AS seconds FROM orders")
def dvd_times(spark, d):
    bcd = lambda x: F.floor(x / 10) * 16 + x % 10
    k = C("o_orderkey")
    return X.table(spark, d, "orders").select("o_orderkey", D.dvd_seconds(bcd(k % 10), bcd(k % 60), bcd(k % 59), bcd(k % 25) + 64).alias("seconds"))


@query(
    "dvd_title_sets",
    """SELECT p_partkey, 1 AS title, CAST(p_size % 20 + 1 AS INT) AS chapters, CAST(p_size * (p_partkey % 60) AS DOUBLE) AS length, 720 AS width, CASE WHEN p_partkey % 2 = 1 THEN 576 ELSE 480 END AS height, CASE WHEN p_partkey % 2 = 1 THEN 16 / 9.0::DOUBLE ELSE 4 / 3.0::DOUBLE END AS aspect,
    CASE WHEN p_partkey % 2 = 1 THEN 25.0::DOUBLE ELSE 29.97::DOUBLE END AS fps, 'MPEG2' AS codec, 'AC3:en:6|DTS:de:2|fr' AS streams FROM part""",
)
def dvd_title_sets(spark, d):
    e = D.ifo_elements(X.title_sets(X.table(spark, d, "part")))
    row = F.struct("kind", "ordinal", F.concat_ws(":", "codec", "language_raw", "channels").alias("s"))
    streams = D.dvd_streams(e).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["s"]), "|").alias("streams"))
    number = F.regexp_extract("path", "([0-9]+)/VTS", 1).cast("long").alias("p_partkey")
    return D.dvd_titles(e).join(streams, "path").select(number, "title", "chapters", "length", "width", "height", "aspect", "fps", "codec", "streams")


@query("cddb_replies", "SELECT c_custkey, 'DTITLE' AS key, c_name || ' / ' || c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'TTITLE0', 'tab' || chr(9) || 'end\\n' FROM customer")
def cddb_replies(spark, d):
    reply = F.concat(F.lit("# Disc length: 10\r\nDTITLE="), C("c_name"), F.lit(" / \r\nTTITLE0=tab\\tend\r\nDTITLE="), C("c_mktsegment"), F.lit("\r\nTTITLE0=\\\\n\r\n.\r\nLATE=1"))
    return D.parse_reply(X.table(spark, d, "customer").select("c_custkey", reply.alias("reply")))


@query("cddb_choice", "SELECT disc, n, title FROM (SELECT *, row_number() OVER (PARTITION BY disc ORDER BY CAST(upper(title) = title AS INT), n) AS k FROM (SELECT p_size AS disc, p_partkey AS n, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE upper(p_name) END AS title FROM part)) WHERE k = 1")
def cddb_choice(spark, d):
    return D.choose_title(X.table(spark, d, "part").select(C("p_size").alias("disc"), C("p_partkey").alias("n"), F.when(C("p_partkey") % 3 == 0, C("p_name")).otherwise(F.upper("p_name")).alias("title")))


@query("cd_clean_titles", "SELECT o_custkey AS disc, o_orderkey AS track, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE CASE WHEN bool_and(o_orderkey % 5 < 4) OVER (PARTITION BY o_custkey) THEN '' ELSE CASE WHEN o_orderkey % 5 < 4 THEN 'A - ' ELSE '' END END END || o_orderpriority AS title FROM orders")
def cd_clean_titles(spark, d):
    mark = F.when((C("o_custkey") % 2 == 0) | (C("o_orderkey") % 5 < 4), F.lit("A - ")).otherwise(F.lit(""))
    t = X.table(spark, d, "orders").select(C("o_custkey").alias("disc"), C("o_orderkey").alias("track"), F.lit("A").alias("artist"), F.lit("B").alias("disc_title"), F.concat(mark, C("o_orderpriority")).alias("title"))
    return D.clean_titles(t).select("disc", "track", "title")


@query("radio_headers", "SELECT c_custkey, c_name AS title, c_mktsegment AS genre, CAST(c_custkey % 320 * 1000 AS DOUBLE) AS bitrate, CAST(NULL AS VARCHAR) AS caption FROM customer")
def radio_headers(spark, d):
    lines = F.concat(F.lit("ICY 200 OK\r\nicy-name: "), C("c_name"), F.lit("\r\nIcy-Genre:"), C("c_mktsegment"), F.lit("\r\nicy-br: "), (C("c_custkey") % 320).cast("string"), F.lit("\r\na:1\r\na:2\r\na:3\r\na:4\r\na:5\r\na:6\r\na:7\r\nicy-url: late"))
    return documents.radio(X.table(spark, d, "customer").select("c_custkey", lines.alias("headers"))).select("c_custkey", "title", "genre", "bitrate", "caption")


# --------------------------------------------------------------------------- scalar functions
@query("lang_resolve", "SELECT doc_id, lang AS langcode, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE 'Unknown (' || lang || ')' END AS language FROM documents")
def lang_resolve(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", F.concat(F.upper("lang"), F.lit("-XX")).alias("code"))
    return T.resolve_language(docs, "code", languages(spark)).select("doc_id", "langcode", "language")


@query("codec_resolve", "SELECT p_partkey, f AS fourcc, c AS codec FROM part JOIN (VALUES (0, '0x55', 'MPEG Layer-3'), (1, '0x55', 'MPEG Layer-3'), (2, 'DIVX', 'DivX'), (3, 'MP43', 'MPEG-4 V3'), (4, NULL, 'V_UNKNOWN'), (5, NULL, 'Unknown'), (6, '0x5555', 'Unknown')) AS v(k, f, c) ON p_partkey % 7 = k")
def codec_resolve(spark, d):
    code = F.array(*[F.lit(x) for x in ("0x55", "85", "divx", "MSMP43", "V_UNKNOWN", "????", "0x5555")])[(C("p_partkey") % 7).cast("int")]
    return X.table(spark, d, "part").select("p_partkey", T.resolve_codec(code).alias("r")).select("p_partkey", "r.fourcc", "r.codec")


@query("codec_registry", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'DIVX' WHEN 1 THEN 'ZZ99' END AS fourcc, CASE p_partkey % 3 WHEN 0 THEN 'DivX' WHEN 1 THEN 'House codec' ELSE 'Unknown' END AS codec FROM part")
def codec_registry(spark, d):
    """Codes that a longer registry, given as a table, knows besides the built-in ones."""
    code = F.array(F.lit("divx"), F.lit("zz99"), F.lit("????"))[(C("p_partkey") % 3).cast("int")]
    more = codec_table(spark, spark.createDataFrame([("zz99", "House codec")], "code string, codec string"))
    return T.resolve_codec_by(X.table(spark, d, "part").select("p_partkey", code.alias("code")), "code", more)


@query(
    "registry_features",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Show' END AS series, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 9 + 1 AS INT) END AS season, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 20 AS INT) END AS episode, CASE WHEN o_orderkey % 2 = 0 THEN 'k' || o_orderkey ELSE o_orderpriority END AS title, "
    "CASE WHEN n_name IS NOT NULL THEN 'Q' || lpad(CAST(o_orderkey % 30 AS VARCHAR), 3, '0') END AS fourcc, coalesce(n_name, 'Unknown') AS codec FROM orders LEFT JOIN nation ON o_orderkey % 30 = n_nationkey",
)
def registry_features(spark, d):
    """Codes that a registry (here made of the nations) names in the relation of tracks, and names of files split by a pattern of one's own."""
    o = X.table(spark, d, "orders")
    k = F.regexp_extract("path", "([0-9]+)[.]", 1).cast("long")
    code = F.concat(F.lit("Q"), F.lpad((k % 30).cast("string"), 3, "0"))
    text = lambda x: x.cast("string")
    name = F.when(k % 2 == 0, F.concat(F.lit("tv/Show_"), text(k % 9 + 1), F.lit("-"), text(k % 20), F.lit("_k"), text(k), F.lit(".avi"))).otherwise(C("path"))
    files = X.avi(o).select(name.alias("path"), F.unhex(F.replace(F.hex("content"), F.lit(b"XVID".hex().upper()), F.hex(code))).alias("content"))
    known = X.table(spark, d, "nation").select(F.concat(F.lit("Q"), F.lpad(C("n_nationkey").cast("string"), 3, "0")).alias("code"), C("n_name").alias("codec"))
    features = R.Features(series="^([A-Za-z]+)_([0-9]+)-([0-9]+)_(.+)$", codecs=known)
    e = once(files)
    t = R.tracks(e, ("riff",), features=features).where("kind = 'video'").select("path", "fourcc", "codec")
    return R.media(e, ("riff",), features=features).drop("fourcc", "codec").join(t, "path").select(key("o_orderkey"), "series", "season", "episode", "title", "fourcc", "codec")


@query("genre_resolve", f"SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN p_name ELSE {GENRE_SQL.format('p_size')} END AS genre FROM part")
def genre_resolve(spark, d):
    n = C("p_size").cast("string")
    value = F.when(C("p_partkey") % 3 == 0, n).when(C("p_partkey") % 3 == 1, F.concat(F.lit("("), n, F.lit(")Remix"))).otherwise(C("p_name"))
    return X.table(spark, d, "part").select("p_partkey", T.genre(value).alias("genre"))


@query("series_split", "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'Show' END AS series, CASE WHEN c_custkey % 3 < 2 THEN CAST(c_custkey % 9 + 1 AS INT) END AS season, CASE WHEN c_custkey % 3 < 2 THEN CAST(c_custkey % 20 AS INT) END AS episode, CASE WHEN c_custkey % 3 < 2 THEN c_mktsegment END AS title FROM customer")
def series_split(spark, d):
    s, n = (C("c_custkey") % 9 + 1).cast("string"), F.lpad((C("c_custkey") % 20).cast("string"), 2, "0")
    name = F.when(C("c_custkey") % 3 == 0, F.concat(F.lit("Show.S0"), s, F.lit("E"), n, F.lit("."), C("c_mktsegment"))).when(C("c_custkey") % 3 == 1, F.concat(F.lit("Show "), s, F.lit("x"), n, F.lit(" "), C("c_mktsegment"))).otherwise(C("c_name"))
    return X.table(spark, d, "customer").select("c_custkey", T.series(name).alias("s")).select("c_custkey", "s.*")


@query("bit_rates", "SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN p_size * 1024 WHEN 1 THEN p_size * 8192 WHEN 2 THEN p_size * 8 WHEN 3 THEN p_size WHEN 4 THEN p_size * 1024 END AS DOUBLE) AS rate FROM part")
def bit_rates(spark, d):
    unit = F.array(F.lit(" kbit/s"), F.lit(" kbyte"), F.lit(" byte"), F.lit(" bps"), F.lit(""), F.lit(" x"))[(C("p_partkey") % 6).cast("int")]
    return X.table(spark, d, "part").select("p_partkey", T.bits_per_second(F.concat(C("p_size").cast("string"), unit)).alias("rate"))


@query("date_spellings", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS exif, CAST(epoch(o_orderdate) AS BIGINT) AS riff, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') AS matroska FROM orders")
def date_spellings(spark, d):
    o = X.table(spark, d, "orders")
    at = C("o_orderdate")
    riff = F.when(C("o_orderkey") % 2 == 0, F.date_format(at, "EEE MMM d HH:mm:ss yyyy")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    riff = F.when(F.date_format(at, "HH:mm:ss") == "00:00:00", F.date_format(at, "yyyy/MM/dd")).otherwise(riff)
    return o.select("o_orderkey", T.exif_time(F.date_format(at, "yyyy:MM:dd HH:mm:ss")).alias("exif"), T.riff_time(riff).alias("riff"), F.date_format(T.matroska_time(F.date_format(at, "yyyy-MM")), "yyyy-MM-dd HH:mm:ss").alias("matroska"))


@query("text_cleaning", "SELECT p_partkey, p_name AS clean, CASE WHEN p_size < 10 THEN '0' ELSE '' END || p_size AS track, CAST(p_size AS INT) AS number, CAST(p_size * 60.0 + 1.5 AS DOUBLE) AS seconds, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size AS VARCHAR) || '/2' END AS ratio_text FROM part")
def text_cleaning(spark, d):
    p, n = X.table(spark, d, "part"), C("p_size").cast("string")
    dirty = F.concat(F.lit("\t "), C("p_name"), F.lit("\0 \n"))
    return p.select("p_partkey", F.rtrim(T.finalize(dirty)).alias("clean"), T.pad_track(n, F.lit("50")).alias("track"), T.int_before_slash(F.concat(n, F.lit("/50"))).alias("number"), T.chapter_seconds(F.concat(n, F.lit(":01.5"))).alias("seconds"), T.ratio(C("p_size").cast("long") * 3, F.lit(6).cast("long")).alias("ratio_text"))


@query("file_hashes", """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS c FROM documents), h AS (SELECT doc_id, octet_length(c) AS n, hex(c) AS x FROM b),
z AS (SELECT doc_id, x[1:131072] AS x FROM h UNION ALL SELECT doc_id, x[greatest(n - 65536, 0) * 2 + 1:] FROM h),
w AS (SELECT doc_id, x, unnest(generate_series(0, len(x) // 16 - 1)) AS i FROM z WHERE len(x) >= 16),
v AS (SELECT doc_id, ('0x' || x[i*16+15:i*16+16] || x[i*16+13:i*16+14] || x[i*16+11:i*16+12] || x[i*16+9:i*16+10] || x[i*16+7:i*16+8] || x[i*16+5:i*16+6] || x[i*16+3:i*16+4] || x[i*16+1:i*16+2])::UBIGINT AS word FROM w),
s AS (SELECT doc_id, sum(word::HUGEINT) AS t FROM v GROUP BY doc_id)
SELECT h.doc_id, lower(lpad(to_hex(CAST((h.n + coalesce(t, 0)::HUGEINT) % 18446744073709551616 AS UBIGINT)), 16, '0')) AS hash FROM h LEFT JOIN s USING (doc_id)""")
def file_hashes(spark, d):
    """Hashes of all texts as HTML files, by size and both ends; a null text is an empty file."""
    docs = X.table(spark, d, "documents")
    return media(X.files(docs, "doc_id", "html", F.encode(F.coalesce("text", F.lit("")), "UTF-8")), "xml").select(key("doc_id"), "hash")


# --------------------------------------------------------------------------- routing and relations
@query("route_by_suffix", "SELECT page_id, CASE WHEN regexp_matches(lower(url), '[^/]\\.(html|htm)$') THEN 'xml' END AS parser FROM pages")
def route_by_suffix(spark, d):
    return X.table(spark, d, "pages").select("page_id", parser_by_suffix(suffix(C("url"))).alias("parser"))


def _mixed(spark, d):
    p, o, c = (X.table(spark, d, n) for n in ("part", "orders", "customer"))
    parts = [X.gif(p), X.bmp(p), X.png(p), X.tiff(p), X.wav(p), X.ac3(p), X.pcm(p), X.games(p), X.jpeg_iptc(c), X.mp3(c, 4), X.ogg(c), X.m4a(c), X.flac(o), X.mp4(o), X.avi(o), X.asf(o), X.flv(o), X.real(o), X.ogm(o), X.mpeg(o), X.mkv(X.with_orders(spark, d))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("route_by_content", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'gif' WHEN 1 THEN 'png' END AS parser FROM part")
def route_by_content(spark, d):
    """Files under a wrong suffix go to whoever takes their bytes; garbage goes to nobody."""
    p = X.table(spark, d, "part")
    gif, png = X.gif(p).where("cast(regexp_extract(path, '([0-9]+)', 1) as int) % 3 = 0"), X.png(p).where("cast(regexp_extract(path, '([0-9]+)', 1) as int) % 3 = 1")
    junk = X.files(p.where("p_partkey % 3 = 2"), "p_partkey", "gif", F.encode("p_name", "UTF-8"))
    return route(gif.unionByName(png).unionByName(junk).withColumn("path", F.regexp_replace("path", r"\.\w+$", ".mkv"))).select(key("p_partkey"), "parser")


@query(
    "media_by_kind",
    """WITH p AS (SELECT count(*) AS n FROM part), c AS (SELECT count(*) AS n FROM customer), f AS (SELECT count(*) AS n FROM orders), g AS (SELECT count(DISTINCT o_custkey) AS n, count(DISTINCT o_custkey) FILTER (o_orderkey % 3 = 0) AS v FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT 'image' AS media, p.n * 4 + c.n AS n FROM p, c UNION ALL SELECT 'game', n FROM p UNION ALL SELECT 'audio', p.n * 3 + c.n * 3 + f.n + g.n - g.v FROM p, c, f, g UNION ALL SELECT 'av', f.n * 7 + g.v FROM f, g""",
)
def media_by_kind(spark, d):
    files = staged(_mixed(spark, d), "files", 5_000)  # on disk, as files are: routing is planned and compiled once, not for each kind's fixture
    e = R.stage(spark, split(files))
    discard(files)
    return R.media(e, R.present(e)).groupBy("media").agg(F.count("*").alias("n"))


@query("container_lengths", "SELECT l_orderkey, max(l_quantity) AS length FROM lineitem GROUP BY l_orderkey HAVING max(CASE WHEN l_linenumber = 1 THEN l_quantity END) > 0")
def container_lengths(spark, d):
    t = X.table(spark, d, "lineitem").select("l_orderkey", F.when(C("l_linenumber") <= 3, "video").otherwise("audio").alias("kind"), (C("l_linenumber") - 1).alias("ordinal"), C("l_quantity").alias("length"))
    return t.groupBy("l_orderkey").agg(R.container_length(C("kind"), C("ordinal"), C("length")).alias("length")).where("length is not null")


@query("tables_relation", "SELECT table_name, count(*) AS n FROM (SELECT unnest(['TITLE', 'ARTIST', 'TRACKNUMBER', 'TRACKTOTAL']) AS key, 'VORBISCOMMENT' AS table_name FROM orders UNION ALL SELECT unnest(['title', 'city', 'keywords']), 'IPTC' FROM customer UNION ALL SELECT unnest(['a', 'b']), 'PNGMETA' FROM part) GROUP BY table_name")
def tables_relation(spark, d):
    p, o, c = (X.table(spark, d, n) for n in ("part", "orders", "customer"))
    e = R.stage(spark, split(X.flac(o).unionByName(X.jpeg_iptc(c)).unionByName(X.png(p))))
    return R.tables(e).groupBy("table_name").agg(F.count("*").alias("n"))


@query("tags_relation", "SELECT c_custkey, 'lead_performer' AS name, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, '_balance', CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'part_number', CAST(c_custkey % 15 AS VARCHAR) FROM customer")
def tags_relation(spark, d):
    t = R.tags(split(X.mp3(X.table(spark, d, "customer"), 4)))
    return t.select(key("c_custkey"), F.array_join("tag_path", "/").alias("name"), "value").where("name in ('lead_performer', '_balance', 'part_number')")


@query("artifacts_relation", "SELECT kind, count(*) AS n, CAST(sum(octet_length(encode(data))) AS BIGINT) AS bytes FROM (SELECT 'picture' AS kind, unnest(['other', o_orderstatus]) AS data FROM orders UNION ALL SELECT 'picture', c_name FROM customer) GROUP BY kind")
def artifacts_relation(spark, d):
    e = R.stage(spark, split(X.flac(X.table(spark, d, "orders")).unionByName(X.mp3(X.table(spark, d, "customer"), 4))))
    return R.artifacts(e).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("bytes"))


@query("media_json", """SELECT p_partkey, '"width":' || (p_partkey % 65536) || ',"height":' || p_size AS said FROM part""")
def media_json(spark, d):
    j = R.as_json(media(X.gif(X.table(spark, d, "part")), "gif"))
    return j.select(key("p_partkey"), F.regexp_extract("json", '("width":[0-9]+,"height":[0-9]+)', 1).alias("said"))


@query("media_text", "SELECT p_partkey, '       width: ' || (p_partkey % 65536) AS line FROM part")
def media_text(spark, d):
    t = R.rendered(media(X.gif(X.table(spark, d, "part")), "gif"))
    return t.select(key("p_partkey"), F.regexp_extract("text", "(?m)^( *width: [0-9]+)$", 1).alias("line"))


@query("sql_over_relations", "SELECT 'audio/flac' AS mime, count(*) AS n, max(o_orderkey) AS largest FROM orders WHERE o_orderpriority LIKE '1%'")
def sql_over_relations(spark, d):
    views = R.collect(spark, split(X.flac(X.table(spark, d, "orders"))))
    views["media"].createOrReplaceTempView("flac_media")
    return spark.sql("SELECT mime, count(*) AS n, max(CAST(regexp_extract(title, '([0-9]+)$', 1) AS BIGINT)) AS largest FROM flac_media WHERE artist LIKE '1%' GROUP BY mime")


@query("incremental_ingest", "SELECT p_partkey, CAST(p_partkey % 65536 AS INT) AS width, p_size AS height FROM part")
def incremental_ingest(spark, d):
    """The files as a stream: elements are split as they arrive and land in a table, which the batch decoders read."""
    p = X.table(spark, d, "part")
    arriving = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/part.parquet*")
    return image.gif(decode_stream(spark, X.gif(arriving))).select(key("p_partkey"), "width", "height")


@query(
    "late_sidecars",
    """WITH i AS (SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 1000) AS t FROM orders),
    s AS (SELECT o_orderkey, t + to_days(CASE o_orderkey % 3 WHEN 0 THEN 1 ELSE 9 END) AS t FROM i WHERE o_orderkey % 3 < 2),
    w AS (SELECT least((SELECT max(t) FROM i), (SELECT max(t) FROM s)) - to_days(1) AS w)
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'S' || o_orderkey ELSE o_orderpriority END AS title FROM orders JOIN i USING (o_orderkey), w WHERE o_orderkey % 3 = 0 OR t + to_days(3) < w""",
)
def late_sidecars(spark, d):
    """Images and their sidecars as two streams: of three sidecars one comes in time, one too late and one never. Images that may still get one are not given yet."""
    o = X.table(spark, d, "orders")
    arriving = lambda: spark.readStream.schema(o.schema).parquet(f"{d}/orders.parquet*").withColumn("modificationTime", F.timestamp_seconds(F.unix_timestamp("o_orderdate") + C("o_orderkey") % 1000))
    path = F.concat(F.lit("o/"), C("o_orderkey").cast("string"), F.lit(".gif"))
    images = arriving().select(path.alias("path"), "modificationTime", C("o_orderpriority").alias("title"))
    text = F.concat(F.lit('<image><field name="title">S'), C("o_orderkey").cast("string"), F.lit("</field></image>"))
    days = F.when(C("o_orderkey") % 3 == 0, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 9 DAYS"))
    sides = arriving().where("o_orderkey % 3 < 2").select(F.concat(path, F.lit(".xml")).alias("path"), (C("modificationTime") + days).alias("modificationTime"), F.encode(text, "UTF-8").alias("content"))
    paired = run_to_end(with_late_sidecars(images, sides, "3 days", "1 day"), shared_path(spark, "paired"), shared_path(spark, "pairing"))
    return paired.select(key("o_orderkey"), "title")


@query("source_files", f"SELECT p_partkey, 'audio/wav' AS mime, CAST(r AS DOUBLE) AS samplerate, p_size * 4 / (r * 4.0) AS length, 'ok' AS status FROM (SELECT *, {RATE.format('p_partkey')} AS r FROM part) WHERE p_size <= 25")
def source_files(spark, d):
    """Files written by the data source, then read through it in SQL: of all that were written, the filter leaves WAV files of up to 156 bytes."""
    p, folder = X.table(spark, d, "part"), shared_path(spark, "files")
    media_source(spark)
    spread = F.regexp_replace("path", "/([0-9]*?)([0-9]{1,3})[.]", "/d$1/$1$2.")  # a thousand keys a folder: who lists or removes one holds its names
    X.wav(p).unionByName(X.gif(p)).withColumn("path", spread).write.format("reel_files").mode("append").save(folder)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW source_files USING reel_files OPTIONS (path '{folder}')")
    files = spark.sql("SELECT path, length, head FROM source_files WHERE suffix = 'wav' AND length <= 156")
    return R.media(once(files), ("riff",)).select(key("p_partkey"), "mime", "samplerate", "length", "status")


@query("id3_lateral", "SELECT c_custkey, 'TIT2' AS frameid, CAST(NULL AS VARCHAR) AS description, c_name AS said FROM customer UNION ALL SELECT c_custkey, 'TPE1', NULL, c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'TXXX', 'balance', CAST(c_custkey AS VARCHAR) FROM customer")
def id3_lateral(spark, d):
    """Frames by a table function beside the files' contents, in SQL."""
    X.mp3(X.table(spark, d, "customer"), 3).createOrReplaceTempView("mp3_files")
    found = table_functions(spark).sql("SELECT path, f.frameid, f.description, array_join(f.texts, '') AS said FROM mp3_files, LATERAL id3_frames(content) AS f WHERE f.frameid IN ('TIT2', 'TPE1', 'TXXX')")
    return found.select(key("c_custkey"), "frameid", "description", "said")


# --------------------------------------------------------------------------- a format of one's own
#: Chunks with two bytes of id, then a flag and three bytes of size that count the head of six; each fills a multiple of four bytes.
OWN_GRAMMAR = Grammar(start=8, head=6, id_at=0, id_size=2, size_at=3, size_bytes=3, order="little", counted=6, align=4, inner=(("IN", 0), ("TR", 2)), skip=("XX",))
OWN_PARSER = Parser("reel", "video/reel", ("reel",), lambda s, h, n: starts(h, b"REEL"), "av", OWN_GRAMMAR)


def _own_files(orders: DataFrame) -> DataFrame:
    """A title and a clerk in IN, two tracks with rates and sizes, data that isn't read."""

    def chunk(ident: bytes, *xs):
        return let(join(*xs), lambda b: let(join(ident, b"\0", to_le(F.length(b) + 6, 3), b), lambda c: F.concat(c, F.substring(zeros(4), 1, (4 - F.length(c) % 4) % 4))))

    k = C("o_orderkey")
    info = chunk(b"IN", chunk(b"TI", C("o_orderpriority")), chunk(b"CL", C("o_orderstatus")))
    video_ = chunk(b"TR", b"\1\0", chunk(b"WH", to_le(k % 1000, 2), to_le(k % 700, 2)), chunk(b"CO", b"DIVX"))
    audio_ = chunk(b"TR", b"\2\0", chunk(b"RA", to_le(F.lit(8000) + k % 40_000, 4)))
    return X.files(orders, "o_orderkey", "reel", F.concat(join(b"REEL", to_le(k % 100_000, 4)), info, chunk(b"XX", zeros(50)), video_, audio_))


def _own_relations(e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    media_of = lambda e: by_file(e, title=at("IN/TI", lambda b: F.decode(b, "UTF-8")), length=head(lambda b: le(b, 4, 4) / 10)).withColumn("mime", F.lit("video/reel"))
    track = lambda e: by_part(
        e, "TR", codec_raw=at("TR/CO", lambda b: F.decode(b, "UTF-8")), width=at("TR/WH", lambda b: le(b, 0, 2)), height=at("TR/WH", lambda b: le(b, 2, 2)), samplerate=at("TR/RA", lambda b: le(b, 0, 4).cast("double"))
    ).withColumn("kind", F.when(C("width").isNotNull(), "video").otherwise("audio"))
    tags_of = lambda e: e.where("place = 'IN/CL'").select("path", "n", F.lit("author").alias("name"), F.decode("body", "UTF-8").alias("value"))
    return R.media(e, ("reel",), decoders={"reel": media_of}), R.tracks(e, ("reel",), decoders={"reel": lambda e: numbered(track(e))}), R.tags(e, decoders={"reel": tags_of})


@query(
    "own_format",
    "SELECT o_orderkey, 'video/reel' AS mime, o_orderpriority AS title, (o_orderkey % 100000) / 10::DOUBLE AS length, o_orderstatus AS author, CAST(o_orderkey % 1000 AS INT) AS width, CAST(o_orderkey % 700 AS INT) AS height, 'DivX' AS codec, CAST(8000 + o_orderkey % 40000 AS DOUBLE) AS samplerate, 'ok' AS status FROM orders",
)
def own_format(spark, d):
    """Media, tracks and tags of a chunked format that is given as a grammar."""
    files = route(_own_files(X.table(spark, d, "orders")), more=[OWN_PARSER])
    m, t, g = _own_relations(R.stage(spark, elements(files, grammars={"reel": OWN_GRAMMAR})))
    one = lambda kind, c: F.max(F.when((C("kind") == kind) & (C("ordinal") == 0), C(c))).alias(c)
    t = t.groupBy("path").agg(one("video", "width"), one("video", "height"), one("video", "codec"), one("audio", "samplerate"))
    m = m.select("path", key("o_orderkey"), "mime", "title", "length", "status")
    return m.join(t, "path").join(g.select("path", C("value").alias("author")), "path").drop("path")
