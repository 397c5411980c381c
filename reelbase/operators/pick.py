"""Aggregates that gather a file's, or a part's, values from its elements: one shuffle of decoded values, none of bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binary import let, utf8_or_latin1
from ..functions.text import finalize

Take = Callable[[Column], Column]


def body_() -> Column:
    return F.col("body")


def place_() -> Column:
    return F.col("place")


def n_() -> Column:
    return F.col("n")


def words(b: Column) -> Column:
    """Text up to the first NUL, stripped; null for empty text."""
    return let(finalize(F.substring_index(let(b, utf8_or_latin1), "\0", 1)), lambda t: F.when(t != "", t))


def utf16(b: Column) -> Column:
    return let(F.trim(F.replace(F.decode(b, "UTF-16LE"), F.lit("\0"), F.lit(""))), lambda t: F.when(t != "", t))


_BUILT: dict = {}


def built(take: Take) -> Column:
    """take(body). Of named functions the expression is built once for a JVM: a long one takes longer to build than to plan."""
    if take.__name__ == "<lambda>" or take.__closure__:
        return take(body_())
    key = (take, id(SparkContext._gateway))
    if key not in _BUILT:
        _BUILT[key] = take(body_())
    return _BUILT[key]


def at(place: str, take: Take = lambda b: b) -> Column:
    """What the element at ``place`` says (the largest value, where there are several)."""
    return F.max(F.when(place_() == place, built(take)))


def head(take: Take) -> Column:
    return at("", take)


def first(place: str, take: Take = lambda b: b) -> Column:
    value = F.when(place_() == place, built(take))
    return F.min_by(value, F.when(value.isNotNull(), n_()))


def last(place: str, take: Take = lambda b: b) -> Column:
    value = F.when(place_() == place, built(take))
    return F.max_by(value, F.when(value.isNotNull(), n_()))


def has(place: str) -> Column:
    return F.coalesce(F.bool_or(place_() == place), F.lit(False))


def comment(place: str, key: str) -> Column:
    """The last KEY=value comment of this key."""
    text = built(utf8_or_latin1)
    mine = (place_() == place) & (F.upper(F.substring_index(text, "=", 1)) == key) & (F.instr(text, "=") > 0)
    return F.max_by(F.when(mine, F.regexp_replace(text, "(?s)^[^=]*=", "")), F.when(mine, n_()))


def by_file(e: DataFrame, **picks: Column) -> DataFrame:
    """One row a file: its size, hash, what went wrong, and the picks."""
    return e.groupBy("path", "parser").agg(F.max(F.when(place_() == "", F.col("size"))).alias("size"), at("hash", lambda b: b.cast("string")).alias("hash"), at("error", lambda b: b.cast("string")).alias("error"), *[c.alias(k) for k, c in picks.items()])


def by_part(e: DataFrame, place: str, **picks: Column) -> DataFrame:
    """One row for each part at ``place`` (a track, a picture), gathered from it and from all below it; ``part`` is its number in the file."""
    depth = place.count("/") + 1
    mine = e.where((place_() == place) | place_().startswith(place + "/"))
    return mine.groupBy("path", "parser", F.coalesce(F.get("up", F.lit(depth)), n_()).alias("part")).agg(*[c.alias(k) for k, c in picks.items()])


def numbered(tracks: DataFrame) -> DataFrame:
    """Add ``ordinal``: a track's place among the file's tracks of its kind, from 0."""
    w = Window.partitionBy("path", "kind").orderBy("part")
    return tracks.withColumn("ordinal", F.row_number().over(w) - 1)
