"""Markup, directories and radio: classification, sidecar files and captured stream headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import utf8_or_latin1
from ..sources.registry import root_element, suffix
from .pick import by_file, head


#: First elements of XML documents that have a type of their own.
ROOTS = ("image", "album")


def xml(e: DataFrame, roots: tuple[str, ...] = ROOTS) -> DataFrame:
    """HTML by its suffix; XML by its first element, which must be well-formed as far as it goes. ``roots`` are types of their own."""
    m = by_file(e, root=head(root_element)).withColumn("html", suffix(F.col("path")).isin("html", "htm"))
    kind = F.when(F.col("html"), "text/html").when(F.col("root").isin(*roots), F.concat("root", F.lit("/xml"))).otherwise("text/xml")
    return m.select("*", F.when(F.col("html"), "text/html").otherwise("text/xml").alias("mime"), F.when(F.col("html"), "HTML file").otherwise(F.regexp_replace(kind, "/xml$", "")).alias("type")).drop("root", "html")


def bins_fields(content: Column) -> Column:
    """map<name, text> of the fields of an image's or album's description; null for other documents."""
    text = utf8_or_latin1(content)
    names = F.transform(F.regexp_extract_all(text, F.lit(r"<field\s+name=[\"']([^\"']+)[\"'][^>]*>([^<]*)</field>"), F.lit(1)), lambda x: x)
    values = F.regexp_extract_all(text, F.lit(r"<field\s+name=[\"']([^\"']+)[\"'][^>]*>([^<]*)</field>"), F.lit(2))
    plain = lambda t: F.trim(F.replace(F.replace(F.replace(F.replace(t, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")))
    pairs = F.arrays_zip(names.alias("k"), F.transform(values, plain).alias("v"))
    one = F.filter(pairs, lambda x, i: (i == 0) | ~F.exists(F.slice(pairs, 1, i), lambda y: y["k"] == x["k"]))
    return F.when(root_element(content).isin("image", "album"), F.map_from_entries(one))


def image_sidecars(files: DataFrame, *more: str) -> DataFrame:
    """(image_path, fields) of ``<image>.xml`` files, and ``more`` of their columns."""
    return files.where(F.lower("path").endswith(".xml")).select(F.regexp_replace("path", r"(?i)\.xml$", "").alias("image_path"), bins_fields(F.col("content")).alias("fields"), *more)


def overridden(images: DataFrame, joined: DataFrame) -> DataFrame:
    """Images with the values that their sidecars' ``fields`` have; all of these are in ``sidecar``."""
    mine = [F.coalesce(F.col("fields")[c], images[c]).alias(c) if t == "string" and c != "path" else images[c] for c, t in images.dtypes]
    return joined.select(*mine, F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("sidecar"))


def with_image_sidecars(images: DataFrame, files: DataFrame) -> DataFrame:
    """Attributes of ``<image>.xml`` beside an image, which override its own; images without one stay as they are."""
    side = image_sidecars(files)
    return overridden(images, images.join(side, images["path"] == side["image_path"], "left"))


def subtitle_sidecars(videos: DataFrame, files: DataFrame) -> DataFrame:
    """Subtitle tracks (path, ordinal, language_raw, trackno) of ``<video>.idx`` files with a ``.sub`` or ``.rar`` beside them, a row for each language."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    idx = files.where(suffix(F.col("path")) == "idx").select(stem("path").alias("stem"), F.col("path").alias("trackno"), utf8_or_latin1(F.col("content")).alias("text"))
    data = files.where(suffix(F.col("path")).isin("sub", "rar")).select(stem("path").alias("stem"))
    lines = idx.where(F.substring_index("text", "\n", 1).contains("VobSub index file")).join(data, "stem", "left_semi")
    found = lines.select("stem", "trackno", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^id: ?(..)"), F.lit(1))).alias("ordinal", "language_raw"))
    return videos.select("path", stem("path").alias("stem")).join(found, "stem").select("path", "ordinal", "language_raw", "trackno")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def directories(files: DataFrame) -> DataFrame:
    """(directory, title, comment, image, n_files): what .directory, album.xml and folder.jpg say of each directory; the last wins."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    text = utf8_or_latin1(F.col("content"))
    entry = lambda key: F.nullif(F.trim(F.regexp_extract(text, f"(?m)^{key}=(.*)$", 1)), F.lit(""))
    mine = lambda what, c: F.max(F.when(name == what, c))
    album = bins_fields(F.col("content"))
    g = files.groupBy(parent(F.col("path")).alias("directory")).agg(
        F.coalesce(mine("album.xml", album["title"]), mine(".directory", entry("Name"))).alias("title"), F.coalesce(mine("album.xml", album["comment"]), mine(".directory", entry("Comment"))).alias("comment"),
        F.coalesce(mine("folder.jpg", F.col("path")), mine("album.xml", F.concat("path", F.lit("/../"), album["sampleimage"])), mine(".directory", F.when(entry("Icon").startswith("./"), F.concat(parent(F.col("path")), F.substring(entry("Icon"), 2, 999))).otherwise(entry("Icon")))).alias("image"),
        F.count("*").alias("n_files"),
    )
    return g


def radio(headers: DataFrame, text: str = "headers") -> DataFrame:
    """title, genre, bitrate (bit/s) and caption of a captured radio stream's first eleven header lines."""
    lines = F.slice(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), 1, 11)

    def value(key: str) -> Column:
        mine = F.filter(lines, lambda x: F.lower(x).startswith(key + ":"))
        return F.trim(F.regexp_replace(F.get(mine, F.lit(0)), "^[^:]*:", ""))

    return headers.select("*", value("icy-name").alias("title"), value("icy-genre").alias("genre"), (value("icy-br").try_cast("double") * 1000).alias("bitrate"), value("icy-url").alias("caption"))


MEDIA = {"xml": xml}
