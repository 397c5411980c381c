"""Changing ID3 tags: frames of every kind back to bytes, single frames set or removed, versions converted, and what is wrong with a tag.

All of it is column expressions over the frames' relation or over files; a tag is rebuilt from its own frames' bytes, so frames that
are not changed stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import be, join, let, part, syncsafe, to_be, to_syncsafe, utf8_or_latin1, zeros
from ..functions.codes import lookup
from .id3 import OLD, SHAPES, frame, modern, without_tag
from .pick import body_

#: Version 2.2's names of later frames.
OLDER = {new: old for old, new in OLD.items()}
# Frames that only one of the versions 2.3 and 2.4 has, and those that go by another name in the other.
ONLY_23 = ("EQUA", "RVAD", "TSIZ", "TRDA")
ONLY_24 = ("ASPI", "EQU2", "RVA2", "SEEK", "SIGN", "TDEN", "TDRL", "TDTG", "TMOO", "TPRO", "TSST")
TO_24 = {"TORY": "TDOR", "IPLS": "TIPL"}
TO_23 = {"TDOR": "TORY", "TIPL": "IPLS", "TMCL": "IPLS"}
# Text encodings by number: charset, byte-order mark, end of a text.
ENCODINGS = {0: ("ISO-8859-1", b"", b"\0"), 1: ("UTF-16LE", b"\xff\xfe", b"\0\0"), 2: ("UTF-16BE", b"", b"\0\0"), 3: ("UTF-8", b"", b"\0")}


# --------------------------------------------------------------------------- frames back to bytes
def encoded(f: Column, encoding: int = 3) -> Column:
    """The body of a frame from its fields (id3.fields): the inverse of reading, for every shape. Null without what the shape needs."""
    charset, mark, end = ENCODINGS[encoding]
    code = bytes([encoding])
    text = lambda c: join(mark, F.encode(F.coalesce(c, F.lit("")), charset))
    latin = lambda c: F.encode(F.coalesce(c, F.lit("")), "ISO-8859-1")
    values, data = F.array_join(f["texts"], "\0"), F.coalesce(f["data"], F.lit(bytearray(b"")))
    language = F.encode(F.substring(F.rpad(F.coalesce(f["language"], F.lit("und")), 3, " "), 1, 3), "ISO-8859-1")
    body = {
        "text": join(code, text(values)), "described": join(code, text(f["description"]), end, text(values)), "comment": join(code, language, text(f["description"]), end, text(values)),
        "terms": join(code, language, text(values)), "url": latin(f["url"]), "described_url": join(code, text(f["description"]), end, latin(f["url"])),
        "picture": join(code, latin(f["mime"]), b"\0", to_be(F.coalesce(f["picture_type"], F.lit(3)), 1), text(f["description"]), end, data),
        "old_picture": join(code, latin(F.rpad(F.coalesce(f["mime"], F.lit("PNG")), 3, " ")), to_be(F.coalesce(f["picture_type"], F.lit(3)), 1), text(f["description"]), end, data),
        "owned": join(latin(f["owner"]), b"\0", data), "count": to_be(F.coalesce(f["number"], F.lit(0)), 4), "rating": join(latin(f["owner"]), b"\0", to_be(F.coalesce(f["number"], F.lit(0)), 1), data),
        "link": join(latin(f["owner"]), latin(f["url"]), b"\0", data), "old_link": join(latin(f["owner"]), latin(f["url"]), b"\0", data), "object": f["data"], "binary": f["data"],
    }
    out = F.when(F.lit(False), F.lit(bytearray(b"")))
    for shape, b in body.items():
        out = out.when(f["shape"] == shape, b)
    return out


# --------------------------------------------------------------------------- one frame of a tag
def tag_parts(files: DataFrame, e: DataFrame) -> DataFrame:
    """Files with ``major`` (null: no tag) and ``frames``: array of struct<id, raw>, each frame with its head as it stands in the tag.

    Offsets are the running sums of the frames' lengths. Where a tag was unsynchronised as a whole, frames are as they were before.
    """
    tags = e.where(F.col("place").rlike("^ID3v2\\.[234]$")).select("path", F.substring("id", 7, 1).cast("int").alias("major"), body_().alias("head__"))
    lists = e.where(F.col("place").rlike("^ID3v2\\.[234]/")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "id", F.col("size").cast("int").alias("size")))).alias("list__"))
    x = files.join(tags, "path", "left").join(lists, "path", "left")
    flags, major = be(F.col("head__"), 5, 1), F.col("major")
    whole = part(F.col("content"), 10, syncsafe(F.col("head__"), 6))
    data = F.when((flags.bitwiseAND(128) > 0) & (major < 4), F.unhex(F.regexp_replace(F.hex(whole), "((?:^|\\G)(?:(?!FF00)..)*)FF00", "$1FF"))).otherwise(whole)
    x = x.withColumn("data__", data)
    data = F.col("data__")
    start = F.when(flags.bitwiseAND(64) == 0, 0).when(major == 3, be(data, 0, 4) + 4).when(major == 4, syncsafe(data, 0)).otherwise(0).cast("int")
    head = F.when(major == 2, 6).otherwise(10)
    kind = "struct<at:int,out:array<struct<id:string,raw:binary>>>"
    cut = lambda acc, f: F.struct((acc["at"] + head + f["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct(f["id"].alias("id"), part(data, acc["at"], head + f["size"]).alias("raw")))).alias("out")).cast(kind)
    frames = F.aggregate("list__", F.struct(F.coalesce(start, F.lit(0)).alias("at"), F.array().alias("out")).cast(kind), cut)["out"]
    return x.withColumn("frames", F.coalesce(frames, F.array().cast("array<struct<id:string,raw:binary>>"))).drop("head__", "list__", "data__")


def changed(files: DataFrame, e: DataFrame, changes: dict[str, Column | None], padding: int = 128, older: dict[str, Column | None] | None = None) -> DataFrame:
    """Files with tags in which these frames (named as in 2.3 and 2.4) have these bodies; a null body, also that of single files, removes a frame.

    ``e`` has the files' elements. ``older`` has the changes to tags of 2.2 and 2.3 where they aren't the same. All other frames keep their bytes and their order; a frame that is set takes the place behind them.
    The tag keeps its version, files without one get a tag of version 2.4; its size and padding are worked out anew. An extended header and
    unsynchronisation of the whole tag, which later versions don't have, are left out.
    """
    x = tag_parts(files, e).withColumn("major", F.coalesce("major", F.lit(4)))
    major, none = F.col("major"), F.lit(bytearray(b""))
    named = [*changes, *(older or {})]
    names, new = [*named, *[OLDER[n] for n in named if n in OLDER]], []
    for name, b in changes.items():
        if b is not None:
            new.append(F.when(major == 4, frame(name, b, 4)).otherwise(none))
    for name, b in (changes if older is None else older).items():
        if b is not None:
            new.append(F.when(major == 3, frame(name, b, 3)).when(major == 2, frame(OLDER[name], b, 2) if name in OLDER else none).otherwise(none))
    kept = F.transform(F.filter("frames", lambda f: ~f["id"].isin(*names)), lambda f: f["raw"])
    data = F.aggregate(kept, F.lit(bytearray(b"")), lambda a, r: F.concat(a, r))
    tag = let(F.concat(data, *new, zeros(padding)), lambda b: join(b"ID3", to_be(major, 1), b"\0\0", to_syncsafe(F.length(b)), b))
    return x.withColumn("content", F.concat(tag, without_tag(F.col("content")))).drop("major", "frames")


# Everyday names of frames that hold one text.
FRIENDLY = {
    "title": "TIT2", "artist": "TPE1", "album_artist": "TPE2", "album": "TALB", "composer": "TCOM", "genre": "TCON", "grouping": "TIT1", "sort_title": "TSOT", "sort_artist": "TSOP", "sort_album": "TSOA",
}


def renamed(files: DataFrame, e: DataFrame, values: dict[str, Column | None], padding: int = 128) -> DataFrame:
    """``changed`` by everyday names (those of id3.friendly): texts of FRIENDLY, comment, date, track, track_total, disc and disc_total.

    A null value removes what holds it. A date is text as in 2.4 (year, year-month-day, or that with Thour:minute); tags of 2.2 and 2.3 get it as
    year, day and time. Of a number and its total the one that isn't named is taken away.
    """
    left = set(values) - {*FRIENDLY, "comment", "date", "track", "track_total", "disc", "disc_total"}
    if left:
        raise ValueError(f"no such names: {sorted(left)}")
    body = lambda c: None if c is None else F.when(c.isNotNull(), join(b"\1\xff\xfe", F.encode(c, "UTF-16LE")))  # noqa: E731 - every version reads this encoding
    changes = {FRIENDLY[k]: body(c) for k, c in values.items() if k in FRIENDLY}
    for name, one, all_ in (("TRCK", "track", "track_total"), ("TPOS", "disc", "disc_total")):
        if one in values or all_ in values:
            n, of = (F.lit(None) if values.get(k) is None else values[k].cast("string") for k in (one, all_))
            changes[name] = body(F.when(n.isNotNull() | of.isNotNull(), F.concat(F.coalesce(n, F.lit("0")), F.coalesce(F.concat(F.lit("/"), of), F.lit("")))))
    if "comment" in values:
        c = values["comment"]
        changes["COMM"] = None if c is None else F.when(c.isNotNull(), join(b"\1eng\xff\xfe\0\0\xff\xfe", F.encode(c, "UTF-16LE")))
    if "date" not in values:
        return changed(files, e, changes, padding)
    date = values["date"]
    old = dict.fromkeys(("TYER", "TDAT", "TIME"))
    if date is not None:
        at = lambda pattern, *pieces: F.when(date.rlike(pattern), F.concat(*[F.substring(date, k, 2) for k in pieces]))
        old = {"TYER": body(F.substring(date, 1, 4)), "TDAT": body(at("^[0-9]{4}-[0-9]{2}-[0-9]{2}", 9, 6)), "TIME": body(at("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}", 12, 15))}
    return changed(files, e, changes | {"TDRC": body(date)}, padding, changes | old)


# --------------------------------------------------------------------------- whole tags
def dumped(files: DataFrame) -> DataFrame:
    """(path, tag): each file's version 2 tag as it stands, byte for byte; null without one."""
    c = F.col("content")
    tag = part(c, 0, F.length(c) - F.length(without_tag(c)))
    return files.select("path", F.when(F.length(tag) > 0, tag).alias("tag"))


def loaded(files: DataFrame, dumps: DataFrame) -> DataFrame:
    """Files with the tags of ``dumps`` (path, tag) in place of their own; a null or empty tag takes the tag away, files without a row stay.

    Of a path's rows the largest tag counts. Only tags and keys are shuffled twice; the files' contents once.
    """
    one = dumps.groupBy("path").agg(F.max("tag").alias("tag__"))
    x = files.join(one.withColumn("has__", F.lit(True)), "path", "left")
    new = F.concat(F.coalesce("tag__", F.lit(bytearray(b""))), without_tag(F.col("content")))
    return x.withColumn("content", F.when(F.col("has__"), new).otherwise(F.col("content"))).drop("tag__", "has__")


# --------------------------------------------------------------------------- versions
def converted(frames: DataFrame, to: str) -> DataFrame:
    """Frames (id3.frames) as they are named in version ``to`` (2.2, 2.3 or 2.4), with ``was`` and ``fate``.

    fate: kept, renamed, joined (2.4's timestamp from year, day and time), split (the other way) or dropped, where the version has no
    counterpart (frameid is null then, the values stay). Frames of the version itself are kept.
    """
    f = modern(frames.withColumn("was", F.col("frameid")))
    columns = f.columns
    foreign = F.col("version") != to
    recent = F.col("version") == "2.4"
    if to == "2.4":
        dates = f.where(foreign & F.col("frameid").isin("TYER", "TDAT", "TIME"))
        one = lambda name: F.max(F.when(F.col("frameid") == name, F.col("texts")[0]))
        stamps = dates.groupBy("path", "version").agg(F.min("n").alias("n"), one("TYER").alias("y"), one("TDAT").alias("d"), one("TIME").alias("t"), F.max(F.when(F.col("frameid") == "TYER", F.col("was"))).alias("was")).where("y is not null")
        day = F.when(F.col("d").rlike("^[0-9]{4}$"), F.concat(F.lit("-"), F.substring("d", 3, 2), F.lit("-"), F.substring("d", 1, 2)))
        clock = F.when(day.isNotNull() & F.col("t").rlike("^[0-9]{4}$"), F.concat(F.lit("T"), F.substring("t", 1, 2), F.lit(":"), F.substring("t", 3, 2)))
        stamp = F.concat("y", F.coalesce(day, F.lit("")), F.coalesce(clock, F.lit("")))
        joined = stamps.select("path", "version", "n", F.lit("TDRC").alias("frameid"), F.lit("text").alias("shape"), F.array(stamp).alias("texts"), "was", F.lit("joined").alias("fate"))
        name = F.when(foreign & F.col("frameid").isin(*ONLY_23), None).otherwise(F.coalesce(F.when(foreign, lookup(TO_24, F.col("frameid"))), F.col("frameid")))
        rest = f.where(~(foreign & F.col("frameid").isin("TYER", "TDAT", "TIME")))
        out = rest.withColumn("frameid", name).withColumn("fate", _fate())
        return out.unionByName(joined, allowMissingColumns=True).select(*columns, "fate")
    stamp = F.col("texts")[0]
    day = F.when(stamp.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.concat(F.substring(stamp, 9, 2), F.substring(stamp, 6, 2)))
    clock = F.when(stamp.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}"), F.concat(F.substring(stamp, 12, 2), F.substring(stamp, 15, 2)))
    named = [F.struct(F.lit(name).alias("frameid"), c.alias("text")) for name, c in (("TYER", F.substring(stamp, 1, 4)), ("TDAT", day), ("TIME", clock))]
    pieces = F.filter(F.array(*named), lambda p: p["text"].isNotNull())
    is_stamp = recent & (F.col("frameid") == "TDRC") & stamp.isNotNull()
    split = f.where(is_stamp).withColumn("p__", F.explode(pieces)).withColumns({"frameid": F.col("p__.frameid"), "texts": F.array("p__.text"), "fate": F.lit("split")}).drop("p__")
    name = F.when(recent & F.col("frameid").isin(*ONLY_24), None).otherwise(F.coalesce(F.when(recent, lookup(TO_23, F.col("frameid"))), F.col("frameid")))
    texts = F.when(recent & (F.col("frameid") == "TDOR"), F.transform("texts", lambda t: F.substring(t, 1, 4))).otherwise(F.col("texts"))
    out = f.where(~F.coalesce(is_stamp, F.lit(False))).withColumns({"texts": texts, "frameid": name}).withColumn("fate", _fate()).unionByName(split)
    if to == "2.2":
        out = out.withColumn("frameid", lookup(OLDER, F.col("frameid"))).withColumn("fate", F.when(F.col("fate").isin("split") & F.col("frameid").isNotNull(), "split").otherwise(_fate()))
    return out.select(*columns, "fate")


def _fate() -> Column:
    return F.when(F.col("frameid").isNull(), "dropped").when(F.col("frameid") == F.col("was"), "kept").otherwise("renamed")


# --------------------------------------------------------------------------- what is wrong with a tag
def warnings(e: DataFrame) -> DataFrame:
    """(path, n, element, code, detail): frames that can't be read as their kind says, one row for each complaint.

    Codes: encrypted, empty, unknown_encoding, bad_utf8, odd_utf16, unknown_language, short, unknown_frame. The frames' other relations
    hold what can be read all the same.
    """
    f = e.where(F.col("place").rlike("^ID3v2\\.[234]/")).withColumn("shape", F.coalesce(lookup(SHAPES, F.col("id")), F.when(F.col("id").startswith("T"), "text").when(F.col("id").startswith("W"), "url").otherwise("binary")))
    code, shape, b = be(body_(), 0, 1), F.col("shape"), body_()
    coded = shape.isin("text", "described", "described_url", "comment", "terms", "picture", "old_picture", "object")
    words, told = shape.isin("text", "described"), shape.isin("comment", "terms")
    least = F.when(told, 4).when(shape.isin("count"), 4).when(shape.isin("link"), 4).when(shape.isin("picture", "old_picture"), 4).otherwise(1)
    known = F.col("id").isin(*{*OLD, *OLD.values(), *SHAPES, *ONLY_23, *ONLY_24, *TO_23, *TO_24, "TDRC", "TSOA", "TSOP", "TSOT", "OWNE", "COMR", "MCDI", "POSS", "RBUF", "WOAF", "WPUB"}) | F.col("id").rlike("^[XYZ]")
    say = lambda when, name, detail: F.when(when, F.struct(F.lit(name).alias("code"), detail.alias("detail")))
    nothing = F.lit(None).cast("string")
    found = F.array_compact(
        F.array(
            say(b.isNull(), "encrypted", nothing), say(F.length(b) == 0, "empty", nothing), say(coded & (code > 3), "unknown_encoding", code.cast("string")),
            say(words & (code == 3) & ~F.call_function("is_valid_utf8", part(b, 1).cast("string")), "bad_utf8", F.hex(part(b, 1, 16))),
            say(words & code.isin(1, 2) & (F.length(b) % 2 == 0), "odd_utf16", F.length(b).cast("string")),
            say(told & (F.length(b) >= 4) & ~F.decode(part(b, 1, 3), "ISO-8859-1").rlike("^([A-Za-z]{3}|\\x00{3}| {3})$"), "unknown_language", F.hex(part(b, 1, 3))),
            say((F.length(b) > 0) & (F.length(b) < least), "short", F.length(b).cast("string")), say(~known, "unknown_frame", let(b, lambda x: utf8_or_latin1(part(x, 0, 16)))),
        )
    )
    return f.select("path", "n", F.col("id").alias("element"), F.explode(found).alias("w")).select("path", "n", "element", "w.*")
