"""Files as they arrive. Splitting and routing are stateless, so a stream lands the same elements as a batch would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import image_sidecars, overridden
from ..operators.walk import SCHEMA, elements
from ..shared import shared_path
from ..sources.files import BINARY_FILE
from ..sources.registry import route


def file_stream(spark: SparkSession, path: str, glob: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """New files below a path, with their contents."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def land(files: DataFrame, out: str, checkpoint: str, force: bool = True, keep_running: bool = False):
    """Write the elements of arriving files to a table partitioned by parser; without ``keep_running`` all that is there, then stop.

    A file that fails to split lands with an ``error`` element; the stream goes on.
    """
    writer = elements(route(files, force)).writeStream.format("parquet").partitionBy("parser").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer if keep_running else writer.trigger(availableNow=True)).start()


def landed(spark: SparkSession, out: str) -> DataFrame:
    """The elements of a landing table, for the decoders; a stream of files takes each path once."""
    return spark.read.schema(SCHEMA).parquet(out).select("path", "parser", "n", "up", "id", "place", "at", "size", "body")


def decode_stream(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Run a stream of files to its end and give its elements."""
    out, checkpoint = shared_path(spark, "landed"), shared_path(spark, "landing")
    land(files, out, checkpoint).awaitTermination()
    return landed(spark, out)


def arrivals(files: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, parser, n, bytes) of a stream of files by their modification time; later arrivals than ``late`` are left out."""
    return route(files).withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window), "parser").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def with_late_sidecars(images: DataFrame, files: DataFrame, within: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """A stream of images (path, modificationTime and attributes) joined with a stream of files among which their sidecars are.

    An image and its ``<image>.xml`` may come in any order and in different batches, if their times are at most ``within`` apart. The image's row
    comes once: with the sidecar's values as soon as both are there, else unchanged when the watermark (``late`` behind the latest times of both
    streams) says that none can come any more. State is kept until then: an image's attributes and a sidecar's fields, not their contents.
    """
    images = images.withWatermark("modificationTime", late)
    side = image_sidecars(files.withColumn("side_time", F.col("modificationTime")), "side_time").withWatermark("side_time", late)
    apart = F.expr(f"INTERVAL {within}")
    near = (side["side_time"] >= images["modificationTime"] - apart) & (side["side_time"] <= images["modificationTime"] + apart)
    return overridden(images, images.join(side, (images["path"] == side["image_path"]) & near, "leftOuter"))


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """All that a stream gives until what is there has been read, as a table; run again with the same folders, it goes on from there."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
