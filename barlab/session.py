"""Sessions for local runs. On a cluster the submitted session is used as it is."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Generated loops above the JIT's method limit run interpreted, many times slower (measured: 64
# trees over 2 million rows, 14 s against 2 s). At this limit Spark splits them instead.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000", "65535")
# Shuffles are dealt in so many pieces, which adaptive execution joins up to its advisory size (compressed; rows in memory are up to some 20 times that): what one
# task sorts or groups then hangs on that size and not on the number of shuffle partitions of the session.
ADVISORY = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m", ("64MB", "64m", "67108864", "67108864b"))
# Files are read in splits of so many bytes: what a task groups or sorts before the shuffle hangs on it.
SPLIT = ("spark.sql.files.maxPartitionBytes", "16m", ("128MB", "128m", "134217728", "134217728b"))
PIECES = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "1024")


def tune(spark: SparkSession) -> SparkSession:
    """Set the method limit, the advisory size and the splits where the session still has Spark's defaults, the pieces where it names none or fewer."""
    key, wanted, default = METHOD_LIMIT
    if spark.conf.get(key) == default:
        spark.conf.set(key, wanted)
    for key, wanted, defaults in (ADVISORY, SPLIT):
        if spark.conf.get(key) in defaults:
            spark.conf.set(key, wanted)
    key, wanted = PIECES
    if int(spark.conf.get(key, None) or 0) < int(wanted):
        spark.conf.set(key, wanted)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all nodes share, as the session names it in ``spark.checkpoint.dir``; a local session gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet to the shared folder and read back from there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cores: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("barlab")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
