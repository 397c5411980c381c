"""Images: dimensions, embedded text, EXIF and IPTC, in column expressions over elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import be, le, let, part, starts, utf8_or_latin1
from ..functions.codes import EXIF_MEANINGS, EXIF_NAMES, GPS_NAMES, INTEROP_NAMES, IPTC_ATTRIBUTES, IPTC_NAMES, MAKER_ARRAYS, MAKER_NAMES, ORIENTATIONS, lookup, pick
from ..functions.text import exif_time, exposure_bias, ratio, rotation, special_mode
from .pick import body_, built, n_, place_, at, by_file, first, head, last, words

# JPEG markers that start a frame.
FRAMES = ("C0", "C1", "C2", "C3", "C5", "C6", "C7", "C9", "CA", "CB", "CD", "CE", "CF")
# EXIF entries that become attributes.
EXIF_ATTRIBUTES = {"artist": "013B", "hardware": "0110", "software": "0131"}


def number(kind: Column, b: Column, k: Column) -> Column:
    """Value k of a directory entry as text; rationals in lowest terms."""
    w = pick((None, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8), kind)
    unsigned = F.conv(F.hex(F.substring(b, k * w + 1, F.least(w, F.lit(4)))), 16, 10).cast("long")
    top = F.pow(F.lit(2), 8 * F.least(w, F.lit(4))).cast("long")
    signed = lambda x: F.when(kind.isin(6, 8, 9, 10) & (x * 2 >= top), x - top).otherwise(x)
    den = signed(F.conv(F.hex(F.substring(b, k * 8 + 5, 4)), 16, 10).cast("long"))
    return F.when(kind.isin(5, 10), F.when(den == 0, F.concat(signed(unsigned).cast("string"), F.lit("/0"))).otherwise(ratio(signed(unsigned), den))).otherwise(signed(unsigned).cast("string"))


def exif_text(kind: Column, many: Column, b: Column) -> Column:
    """An entry's value as text: a string, a number, or a list of numbers in brackets."""
    listed = F.transform(F.sequence(F.lit(0), (F.least(many, F.lit(1000)) - 1).cast("int")), lambda k: number(kind, b, k))
    return F.when(kind == 2, words(b)).when(kind == 7, F.substring_index(F.decode(b, "ISO-8859-1"), "\0", 1)).when(many == 1, number(kind, b, F.lit(0))).when(many > 1, F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")))


def meanings(tag: Column, kind: Column, many: Column, b: Column) -> Column:
    """What an entry's numbers mean, one behind the other, numbers without a meaning as they are; null for tags whose numbers mean nothing else."""
    known = {f"{t}:{v}": text for t, values in EXIF_MEANINGS.items() for v, text in values.items()}
    numbers = F.transform(F.sequence(F.lit(0), F.least(many, F.lit(1000)).cast("int") - 1), lambda k: number(kind, b, k))
    named = F.transform(numbers, lambda v: F.coalesce(lookup(known, F.concat_ws(":", tag.cast("string"), v)), v))
    return F.when(tag.isin(*EXIF_MEANINGS) & (kind != 2) & (many > 0) & (F.length(b) > 0), F.array_join(named, ""))


def exif(e: DataFrame) -> DataFrame:
    """(path, directory, tag, name, value, data): the entries of all EXIF directories; MakerNote entries have no names.

    Numbers that stand for something are named (meanings); a user comment is what follows its eight bytes of character set.
    """
    where = F.regexp_extract("place", "(?:^|/)(Image|Thumbnail|EXIF|GPS|Interop|MakerNote)/[0-9A-F]{4}$", 1)
    tag = F.conv("id", 16, 10).cast("int")
    name = F.when(where == "GPS", lookup(GPS_NAMES, tag)).when(where.isin("Image", "Thumbnail", "EXIF"), lookup(EXIF_NAMES, tag)).when(where == "Interop", lookup(INTEROP_NAMES, tag))
    text = exif_text(F.col("at").cast("int"), F.col("size"), body_())
    main, said = where.isin("Image", "Thumbnail", "EXIF"), F.trim(F.substring_index(F.decode(part(body_(), 8), "ISO-8859-1"), "\0", 1))
    shown = F.when(name == "Orientation", pick(ORIENTATIONS, text.try_cast("int") - 1)).when(main & (tag == 0x9286), said)
    shown = shown.otherwise(F.coalesce(F.when(main, meanings(tag, F.col("at").cast("int"), F.col("size"), body_())), text))
    mine = e.where(F.col("parser").isin("jpeg", "tiff") & (where != ""))
    return mine.select("path", "n", where.alias("directory"), F.col("id").alias("tag"), F.coalesce(name, F.concat(F.lit("Tag 0x"), "id")).alias("name"), shown.alias("value"), body_().alias("data"))


def _made_notes(e: DataFrame) -> DataFrame:
    """Entries of makers' notes with the make that the file's first directory has."""
    x = exif(e)
    makes = x.where("directory = 'Image' and tag = '010F'").select("path", F.upper(F.regexp_extract("value", "^[A-Za-z]+", 0)).alias("make"))
    return x.where("directory = 'MakerNote'").join(makes, "path")


def maker_notes(e: DataFrame) -> DataFrame:
    """(path, make, tag, name, value) of makers' notes: entries are named by the make that the file's first directory has."""
    notes = _made_notes(e)
    tag = F.conv("tag", 16, 10).cast("int")
    name = F.lit(None).cast("string")
    for make, names in MAKER_NAMES.items():
        name = F.when(F.col("make") == make, lookup(names, tag)).otherwise(name)
    numbers = F.transform(F.sequence(F.lit(0), F.greatest(F.length("data") - 1, F.lit(0))), lambda k: be(F.col("data"), k, 1))
    words16 = F.transform(F.sequence(F.lit(0), F.greatest((F.length("data") / 4).cast("int") - 1, F.lit(0))), lambda k: be(F.col("data"), k * 4, 4))
    value = (
        F.when((F.col("make") == "NIKON") & tag.isin(0x0D, 0x0E, 0x12, 0x18) & (F.length("data") >= 4), exposure_bias(numbers))
        .when((F.col("make") == "OLYMPUS") & (tag == 0x200) & (F.length("data") >= 12), F.coalesce(special_mode(words16), F.col("value")))
        .otherwise(F.col("value"))
    )
    return notes.select("path", "n", "make", "tag", F.coalesce(name, F.concat(F.lit("Tag 0x"), "tag")).alias("name"), value.alias("value"))


def array_names(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(make, tag, position, name) and (make, tag, position, code, meaning): what makers' arrays hold; rows of one's own can be added to both."""
    names = [(make, f"{tag:04X}", place, name) for (make, tag), places in MAKER_ARRAYS.items() for place, (name, _) in places.items()]
    codes = [(make, f"{tag:04X}", place, code, text) for (make, tag), places in MAKER_ARRAYS.items() for place, (_, values) in places.items() for code, text in values.items()]
    return spark.createDataFrame(names, "make string, tag string, position int, name string"), spark.createDataFrame(codes, "make string, tag string, position int, code int, meaning string")


def maker_arrays(e: DataFrame, names: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """(path, make, tag, position, name, number, value): the 16-bit numbers of makers' arrays, each a row, position 0 (the length) left out.

    A position without a name has none, and its number is its value; a number without a meaning, where its position has some, is Unknown.
    The names and meanings are relations (``array_names``), joined on make, tag and position: small, so broadcast under Spark's threshold.
    """
    known = array_names(e.sparkSession)
    names, codes = names if names is not None else known[0], codes if codes is not None else known[1]
    arrays = _made_notes(e).join(names.select("make", "tag").distinct(), ["make", "tag"], "left_semi")
    many = (F.length("data") / 2).cast("int")
    numbers = F.transform(F.sequence(F.lit(1), many - 1), lambda k: F.struct(k.alias("position"), be(F.col("data"), k * 2, 2).cast("int").alias("number")))
    each = arrays.where(many > 1).select("path", "make", "tag", F.explode(numbers).alias("x")).select("path", "make", "tag", "x.*")
    coded = codes.select("make", "tag", "position").distinct().withColumn("coded", F.lit(True))
    key = ["make", "tag", "position"]
    found = each.join(names, key, "left").join(coded, key, "left").join(codes.withColumnRenamed("code", "number"), [*key, "number"], "left")
    value = F.coalesce("meaning", F.when(F.col("coded"), "Unknown"), F.col("number").cast("string"))
    return found.select("path", *key, "name", "number", value.alias("value"))


def iptc(e: DataFrame) -> DataFrame:
    """(path, n, name, value): IPTC datasets of record 2, empty ones left out."""
    dataset = F.split("id", ":")
    mine = e.where(F.col("place").rlike("(^|/)IPTC/2:[0-9]+$"))
    return mine.select("path", "n", F.coalesce(lookup(IPTC_NAMES, dataset[1].cast("int")), F.concat(F.lit("dataset "), dataset[1])).alias("name"), words(body_()).alias("value")).where(F.col("value").isNotNull())


def _iptc_picks(prefix: str) -> dict[str, Column]:
    """Attributes of IPTC: values of a dataset are joined by spaces, keywords are a list, the first of several datasets counts."""
    code = {name: k for k, name in IPTC_NAMES.items()}

    def listed(name: str) -> Column:
        mine = F.when((place_() == f"{prefix}IPTC/2:{code[name]}") & built(words).isNotNull(), F.struct(n_().alias("n"), built(words).alias("v")))
        return F.transform(F.array_sort(F.collect_list(mine)), lambda x: x["v"])

    joined = lambda xs: F.when(F.size(xs) > 0, F.array_join(xs, " "))
    out = {k: F.coalesce(*[let(listed(n), joined) for n in names]) for k, names in IPTC_ATTRIBUTES.items()}
    return out | {"keywords": let(listed("keywords"), lambda xs: F.when(F.size(xs) > 0, F.transform(xs, lambda x: F.trim(x))))}


def jpeg(e: DataFrame) -> DataFrame:
    sof = lambda take: F.max(F.when(place_().isin(*FRAMES), take(body_())))
    text = lambda p: at(p, words)
    m = by_file(
        e, height=sof(lambda b: be(b, 1, 2)).cast("int"), width=sof(lambda b: be(b, 3, 2)).cast("int"), comment=last("FE", words), turn=at("E1/Image/0112", lambda b: pick(ORIENTATIONS, be(b, 0, 2) - 1)),
        day=F.coalesce(text("E1/Image/9003"), text("E1/EXIF/9003"), text("E1/Image/0132")), thumbnail=F.coalesce(at("E1/Thumbnail/jpeg"), at("E7")),
        **{k: text(f"E1/Image/{tag}") for k, tag in EXIF_ATTRIBUTES.items()}, **_iptc_picks("ED/"),
    )
    return m.select("*", F.when(F.col("turn").isNotNull(), rotation(F.col("turn"))).alias("rotation"), exif_time(F.col("day")).alias("timestamp"), F.lit("image/jpeg").alias("mime"), F.lit("jpeg image").alias("type")).drop("turn", "day")


def png_text(b: Column) -> Column:
    """struct<key, value> of a text chunk; the value is null if it can't be unpacked."""
    t = utf8_or_latin1(b)
    return F.struct(F.substring_index(t, "\0", 1).alias("key"), F.when(F.instr(t, "\0") > 0, F.regexp_replace(t, "(?s)^[^\0]*\0", "")).alias("value"))


def png(e: DataFrame) -> DataFrame:
    mine = F.col("id").isin("tEXt", "zTXt", "iTXt")
    by_key = lambda key: F.max_by(F.when(mine & (png_text(body_())["key"] == key), png_text(body_())["value"]), F.when(mine & (png_text(body_())["key"] == key), n_()))
    m = by_file(e, width=at("IHDR", lambda b: be(b, 0, 4)).cast("int"), height=at("IHDR", lambda b: be(b, 4, 4)).cast("int"), samplebits=at("IHDR", lambda b: be(b, 8, 1)).cast("int"), comment=F.coalesce(by_key("comment"), by_key("Comment")), software=by_key("Software"))
    return m.select("*", F.lit("image/png").alias("mime"), F.lit("PNG image").alias("type"))


def gif(e: DataFrame) -> DataFrame:
    return by_file(e, width=head(lambda b: le(b, 6, 2)).cast("int"), height=head(lambda b: le(b, 8, 2)).cast("int"), type=head(lambda b: F.lower(F.decode(part(b, 0, 6), "ISO-8859-1")))).withColumn("mime", F.lit("image/gif"))


def bmp(e: DataFrame) -> DataFrame:
    return by_file(e, width=head(lambda b: le(b, 18, 4)).cast("int"), height=head(lambda b: le(b, 22, 4)).cast("int")).select("*", F.lit("image/bmp").alias("mime"), F.lit("windows bitmap image").alias("type"))


def tiff(e: DataFrame) -> DataFrame:
    size = lambda tag: first(f"Image/{tag}", lambda b: F.when(F.col("at").isin(3, 4), F.conv(F.hex(b), 16, 10).cast("long"))).cast("int")
    picks = {k: at(f"Image/{tag}", words) for k, tag in EXIF_ATTRIBUTES.items()} | _iptc_picks("")
    return by_file(e, width=size("0100"), height=size("0101"), day=F.coalesce(at("EXIF/9003", words), at("Image/0132", words)), **picks).select("*", exif_time(F.col("day")).alias("timestamp"), F.lit("image/tiff").alias("mime"), F.lit("TIFF image").alias("type")).drop("day")


def png_tables(e: DataFrame) -> DataFrame:
    return e.where(F.col("id").isin("tEXt", "zTXt", "iTXt") & (F.col("parser") == "png")).select("path", "n", png_text(body_()).alias("p")).select("path", "n", "p.*")


MEDIA = {"jpeg": jpeg, "png": png, "gif": gif, "bmp": bmp, "tiff": tiff}
