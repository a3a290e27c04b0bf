"""Scans, stitched sources, source identity, fingerprints and sinks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions.scalars import finite_or_null
from barlab.operators.contracts import ContractError, equality_check, require
from barlab.session import cut_lineage


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
         first: str | None = None, end: str | None = None, date: str = "date") -> DataFrame:
    """Parquet scan with column list and optional date range (first inclusive, end exclusive).

    Both reach the reader: columns as the read schema, dates as pushed filters.
    """
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col(date) >= F.lit(first).cast(df.schema[date].dataType))
    if end is not None:
        df = df.where(F.col(date) < F.lit(end).cast(df.schema[date].dataType))
    return df.select(*columns) if columns else df


def sql_scan(spark: SparkSession, path: str, text: str, name: str = "source", **args) -> DataFrame:
    """SQL over one Parquet path, with named parameters bound by Spark."""
    return spark.sql(text, args=args or None, **{name: spark.read.parquet(path)})


def as_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def multi_period(spark: SparkSession, sources: Sequence[Mapping[str, str]], columns: Sequence[str],
                 date: str = "date") -> DataFrame:
    """Concatenate the declared date range of several files: items have file, first, end."""
    parts = [scan(spark, s["file"], columns, s["first"], s["end"], date=date) for s in sources]
    return reduce(DataFrame.unionByName, parts)


def overlap_check(older: DataFrame, newer: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    """Both extracts must agree row by row on [start, end)."""
    inside = (F.col(date) >= F.lit(start).cast("date")) & (F.col(date) < F.lit(end).cast("date"))
    return equality_check(older.where(inside), newer.select(*older.columns).where(inside), "overlap_equal")


def stitch(older: DataFrame, newer: DataFrame, start: str, end: str, date: str = "date",
           check: bool = True) -> DataFrame:
    """The older extract before ``start`` followed by the whole newer one.

    ``start`` to ``end`` is the range both hold; with ``check`` any difference there raises.
    """
    if check:
        require(overlap_check(older, newer, start, end, date))
    return older.where(F.col(date) < F.lit(start).cast("date")).unionByName(newer.select(*older.columns))


def case_distinct(spark: SparkSession, path: str, names: Mapping[str, str]) -> DataFrame:
    """Read columns that differ only by case, renamed apart.

    Names are resolved in a session of its own with case-sensitive names; the renamed
    columns are checkpointed, because any later plan would resolve the scan again under
    the caller's settings, which stay as they are.
    """
    strict = spark.newSession()
    strict.conf.set("spark.sql.caseSensitive", "true")
    df = strict.read.parquet(path)
    return cut_lineage(df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()]))


IDENTITY = r"/(SH|SZ)/(\d{6})\.parquet$"


def file_listing(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """Path and length of every file below a folder; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(root).select("path", "length"))


def with_identity(files: DataFrame, path: str = "path") -> DataFrame:
    """Security code from the exchange folder and the six-digit file name; NULL when malformed."""
    exchange = F.regexp_extract(path, IDENTITY, 1)
    digits = F.regexp_extract(path, IDENTITY, 2)
    code = F.concat_ws(".", F.lower(exchange), digits)
    return files.withColumn("code", F.when(exchange != "", code))


def identity_problems(files: DataFrame, path: str = "path") -> DataFrame:
    """Malformed paths, and codes that more than one path claims."""
    named = with_identity(files, path)
    return named.groupBy("code").agg(
        F.count_distinct(path).alias("paths"), F.min(path).alias("first_path")).where(
        F.col("code").isNull() | (F.col("paths") > 1))


def source_mapping(files: DataFrame, path: str = "path") -> DataFrame:
    """(code, path), refused as a whole when any identity is ambiguous or malformed."""
    bad = identity_problems(files, path).agg(
        F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_set("first_path")), 1, 5).alias("some")).first()
    if bad["n"]:
        raise ContractError(f"ambiguous source: {bad['n']} in all, as " + ", ".join(bad["some"]))
    return with_identity(files, path).select("code", path)


def entity_scan(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """All per-code files of a folder in one scan, with the code taken from each path."""
    df = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).parquet(root))
    return with_identity(df.withColumn("_path", F.col("_metadata.file_path")), "_path").drop("_path")


def fingerprints(files: DataFrame) -> DataFrame:
    """SHA-256 of each listed file, streamed in blocks so a file of any size fits a task."""
    block = 8 << 20

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        from pyarrow import fs

        for pdf in batches:
            out = []
            for uri in pdf["path"]:
                system, name = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1)
                                                      if uri.startswith("file:/") and not uri.startswith("file://")
                                                      else uri)
                h = hashlib.sha256()
                with system.open_input_stream(name) as stream:
                    while chunk := stream.read(block):
                        h.update(chunk)
                out.append(h.hexdigest())
            yield pd.DataFrame({"path": pdf["path"], "length": pdf["length"], "sha256": out})

    return files.mapInPandas(digest, "path string, length long, sha256 string")


def manifest_conflicts(manifests: DataFrame) -> DataFrame:
    """Files for which the manifests declare more than one digest."""
    return manifests.groupBy("path").agg(F.count_distinct("sha256").alias("digests")).where("digests > 1")


def fingerprint_check(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per declared file: present, and equal to its declared digest."""
    declared = manifest.select("path", F.col("sha256").alias("declared")).distinct()
    joined = declared.join(found.select("path", "sha256"), "path", "left")
    return joined.select("path", F.col("sha256").isNotNull().alias("present"),
                         F.coalesce(F.col("sha256") == F.col("declared"), F.lit(False)).alias("matches"))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Zstd Parquet; an existing result is never replaced."""
    writer = df.write.option("compression", "zstd").mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_partitioned(df: DataFrame, path: str, key: str) -> None:
    """One folder per value of ``key``. Rows gather by value before they are written, so a value has few files, and a
    value with a large part of the rows is split over several tasks and files."""
    write_table(df.hint("rebalance", key), path, [key])


def misplaced(key: str, content: Column) -> Column:
    """True for a row whose content names another value of ``key`` than the folder of its file does."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), f"/{key}=([^/]+)/[^/]+$", 1)
    return ~F.col(key).eqNullSafe(content) | (folder != content)


def write_report(df: DataFrame, path: str) -> None:
    """JSON rows; missing and non-finite numbers are written as null, never as text."""
    clean = df.select(*[
        finite_or_null(F.col(f.name)).alias(f.name)
        if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields])
    clean.write.option("ignoreNullFields", "false").mode("errorifexists").json(path)


def read_report(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", str(multi_line).lower())
    return (reader.schema(schema) if schema else reader).json(path)
