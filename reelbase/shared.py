"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only in local mode, as in tests, may it be unset: a temporary folder of this machine takes its place. On a cluster
    that would lose rows, so it is an error there.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.reelbase.shared.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="reelbase-")
        spark.conf.set("spark.reelbase.shared.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver's process ends."""
    path = f"{shared_root(spark)}/reelbase/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; what is left are scratch files only
        pass


#: Spark's setting that an execution's shuffle files go when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """Cut the lineage: write to the shared folder (any executor can reread it) and return the table.

    What was shuffled for it isn't needed once it is written, so its shuffle files are removed at once. A file has at most ``rows`` rows
    (0: as many as a task makes), where the tasks that reread it would else be few or uneven.
    """
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "staged_path", None):
            remove(t.sparkSession, path)
