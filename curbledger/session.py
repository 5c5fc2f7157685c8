"""Session helpers: a local builder for tests and benches, and durable cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and benches; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("curbledger")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        # small test data: let small shuffles keep all cores busy
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for durable cuts: the cluster's own, else (local master only) a new one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="curbledger-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


# Aggregations and windows shuffle on all their keys, even after a join on some of them,
# so a hot join key is spread again; joins are split at hot keys even if that costs a shuffle.
SKEW_SETTINGS = {
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

BROADCAST_ROWS = 100_000  # rows of a few small columns: some megabytes


def tuned(spark: SparkSession) -> SparkSession:
    """The session with the skew settings, where it has none of its own."""
    have = spark.conf.getAll
    for key, value in SKEW_SETTINGS.items():
        if key not in have:
            spark.conf.set(key, value)
    return spark


def near(df: DataFrame, rows: int) -> DataFrame:
    """`df`, marked for broadcast if its counted `rows` are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def durable(df: DataFrame) -> DataFrame:
    """Materialize once in the shared checkpoint folder; survives lost executors."""
    ensure_checkpoint_dir(tuned(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, removed when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


# Shuffle files go with the query that wrote them, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """Write once as Parquet in the shared folder and read it back: later reads are pruned.

    The shuffle files of the write are removed when it is done: nothing else reads them.
    """
    spark = tuned(df.sparkSession)
    folder = shared_folder(spark)
    with _setting(spark, CLEANUP, "true"):
        df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    _FOLDERS[out] = folder
    return out


_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # of `stored` results


def discard(*frames: DataFrame) -> None:
    """Remove the files of `stored` results that nothing will read again; other frames are left alone."""
    for df in frames:
        if folder := _FOLDERS.pop(df, None):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            fs.delete(path, True)
            fs.cancelDeleteOnExit(path)
