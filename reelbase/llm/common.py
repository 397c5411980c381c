"""Helpers shared by the training-data operators: staged tables, table paths, held-out rows, column hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbase.shared import discard, staged
from reelbase.shared import shared_path as new_path

__all__ = ["col", "discard", "held_out", "new_path", "staged", "table"]


def col(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the decimal doc_id leaves the given remainder; a null id is never held out."""
    return F.coalesce(F.crc32(col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
