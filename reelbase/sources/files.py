"""Files as a DataFrame: listing, heads and contents, and their elements."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.walk import LONGEST, Budget, elements, opened
from .registry import HEAD, REGISTRY, Parser, parser_by_suffix, route, suffix

#: Bytes up to which a file is read as a whole: where reading by offset is possible, and elsewhere.
SMALL, WHOLE = 256 << 10, 64 << 20
#: Bytes that a task should read by offset; what a file needs, by suffix, and any other: both ends, for the hash, and where its index may be.
TASK, NEED = 32 << 20, 256 << 10
NEEDS = {"iso": 900 << 10, "mpg": 800 << 10, "mpeg": 800 << 10, "ts": 800 << 10, "mp4": 512 << 10, "mov": 512 << 10, "mkv": 384 << 10, "avi": 384 << 10}
#: Columns of Spark's binaryFile source, for streams.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def configure(spark: SparkSession) -> SparkSession:
    """Small Arrow batches: a batch of file contents must fit a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def list_files(spark: SparkSession, paths: str | Sequence[str], suffixes: Sequence[str] = (), longest: int | None = None, content: bool = False) -> DataFrame:
    """Files below the paths; the filters come before any byte is read. Without ``content`` the scan's schema leaves it out.

    A file that goes between the listing and the scan is no longer listed; one that goes later, or can't be read, becomes an error element.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load([paths] if isinstance(paths, str) else list(paths))
    if suffixes:
        files = files.where(suffix(F.col("path")).isin(*suffixes))
    if longest is not None:
        files = files.where(F.col("length") <= longest)
    return files if content else files.drop("content")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = []
        for path in batch["path"].to_pylist():
            try:
                with opened(path) as read:
                    heads.append(read(0, HEAD))
            except (OSError, pa.ArrowException):  # splitting meets the same and says so
                heads.append(None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary())], names=[*batch.schema.names, "head"])


def reachable(path: str) -> bool:
    """Whether executors can read by offset there."""
    return "://" not in path or path.split(":", 1)[0] in ("file", "s3", "s3a", "gs", "hdfs")


def planned(files: DataFrame) -> DataFrame:
    """Files dealt for reading by offset: so many tasks that each has about TASK bytes to read, by what their kinds need, or 2,000 files."""
    need = F.least(F.col("length"), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NEEDS.items() for x in kv]), suffix(F.col("path"))), F.lit(NEED)))
    total, n = files.agg(F.sum(need), F.count("*")).first()
    return files.repartition(max(1, (total or 0) // TASK, n // 2000), "path")


def read_elements(spark: SparkSession, paths: str | Sequence[str], suffixes: Sequence[str] = (), force: bool = True, ranged: bool = False, kinds: Sequence[str] = (), whole: int | None = None, longest: int | None = LONGEST, more: Sequence[Parser] = (), budget: Budget = Budget()) -> DataFrame:
    """Elements of all files that a parser takes.

    Files of at most ``whole`` bytes come as they are through Spark's own reader. Larger ones, or all with ``ranged``, are read by offset
    (heads, indexes and tails only): on paths that are mounted on every executor, or in a store that Arrow knows. By default that is
    from SMALL bytes on where executors can read by offset, and from WHOLE bytes on elsewhere. ``kinds`` keeps the named parsers only, before
    decoding. ``budget`` says what a file may cost (``longest``: its limit for a body); EXACT has no limits. A file that can't be read
    has an ``error`` element, under the parser that its suffix names. ``more`` adds parsers of one's own (see route).
    """
    if whole is None:
        whole = SMALL if all(map(reachable, [paths] if isinstance(paths, str) else paths)) else WHOLE
    budget = replace(budget, body=longest) if longest != LONGEST else budget
    grammars = {p.name: p.grammar for p in more if p.grammar}
    far = list_files(spark, paths, suffixes).select("path", "length")
    far = far if ranged else far.where(F.col("length") > whole)
    heads = planned(far).mapInArrow(_heads, "path string, length bigint, head binary")
    routed = route(heads, force, more)
    found = elements(routed.withColumn("parser", F.when(F.col("head").isNull(), parser_by_suffix(suffix(F.col("path")))).otherwise(F.col("parser"))), kinds, budget, grammars)
    if ranged:
        return found
    return elements(route(list_files(spark, paths, suffixes, whole, content=True), force, more), kinds, budget, grammars).unionByName(found)


def bytes_read(elements: DataFrame) -> DataFrame:
    """(path, parser, size, bytes): what each file's splitting read of it."""
    at = lambda place, c: F.max(F.when(F.col("place") == place, F.col(c)))
    return elements.groupBy("path", "parser").agg(at("", "size").alias("size"), at("hash", "at").alias("bytes"))


def unidentified(spark: SparkSession, paths: str | Sequence[str], force: bool = True) -> DataFrame:
    """Paths that no parser takes."""
    return route(list_files(spark, paths, content=True), force).where(F.col("parser").isNull()).select("path", "length")


def names() -> list[str]:
    return [p.name for p in REGISTRY]
