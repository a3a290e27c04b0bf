"""Small helpers that the operators share."""

from __future__ import annotations

import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.session import cut_lineage


# Rows that Spark hands to Python at a time. Texts of some kilobytes make 10,000 rows tens of megabytes, which the executor holds outside its
# heap and the worker once more.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1024", "10000")

REMEMBERED: list[list] = []     # what operators keep in a Python worker from one task to the next; a worker outlives a query


def forget() -> None:
    """Called in a task that needs its worker's memory for something else: drops what other operators left there."""
    if any(REMEMBERED):
        for kept in REMEMBERED:
            kept.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession) -> None:
    """Rows of texts go to Python in smaller batches, unless the session has a size of its own."""
    key, wanted, default = BATCH
    if spark.conf.get(key) == default:
        spark.conf.set(key, wanted)


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str) -> Column:
    """The text column with null read as empty."""
    return F.coalesce(quoted(name), F.lit(""))


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder and read back from there."""
    return cut_lineage(df)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that all nodes share."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if root is None:
        cut_lineage(spark.range(1))     # sets the folder of a local session, or refuses
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as compressed Parquet to a fresh shared folder and read back from there."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts; null reads as 'null'."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, v (array of double): the rows with an id and a vector of finite numbers."""
    v = quoted(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(quoted(vec_id).isNotNull() & v.isNotNull() & ~odd).select(
        quoted(vec_id).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
