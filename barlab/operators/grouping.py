"""Group statistics and order statistics that never put one whole group in one task.

A single day, code or score may hold a large part of the data, so nothing here
sorts or collects a raw group: rows are reduced by partial aggregation first, and
where an order inside a group is needed it runs over pieces of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def small_by_day(table: DataFrame, day_keys: Sequence[str] = ("date",)) -> DataFrame:
    """Mark a table that has one row per DATE for broadcast.

    The bound is the calendar: a DATE has at most 3,652,059 values (years 1 to
    9999) and a century has 36,525, so the table cannot grow with the row count
    of the data. The proof needs the key to be a DATE; with any other key type
    the hint is left out and the join strategy is chosen at run time.
    """
    typed = all(isinstance(table.schema[k].dataType, T.DateType) for k in day_keys)
    return F.broadcast(table) if typed and len(day_keys) == 1 else table


def with_day_stats(rows: DataFrame, *aggregates: Column, day: str = "date") -> DataFrame:
    """Attach per-day aggregates to every row.

    Equal to aggregate functions over ``PARTITION BY date`` but without the sort
    and without one task per day: the day table is partially aggregated before
    its shuffle and joined back by broadcast.
    """
    stats = rows.groupBy(day).agg(*aggregates)
    return rows.join(small_by_day(stats, (day,)), day, "left")


def row_chunks(
    rows: DataFrame,
    key: str,
    period: str,
    order: Sequence[str],
    lookback: int,
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Cut each key's ordered rows into chunks for row-frame windows.

    Adds ``_seq`` (position within the key), ``_chunk`` and ``_own``. Every chunk
    is preceded by the ``lookback`` rows before it, marked ``_own = false``, so any
    frame reaching at most ``lookback`` rows back is exact on the own rows. Use
    ``Window.partitionBy(key, "_chunk").orderBy("_seq")`` and keep the own rows.

    ``period`` must split a key into groups of bounded size (a day of minute bars).
    """
    if lookback >= chunk_rows:
        raise ValueError("chunk_rows must exceed lookback")
    counts = rows.groupBy(key, period).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        key, period, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, period).orderBy(*order)
    numbered = rows.join(starts, [key, period]).withColumn(
        "_seq", F.col("_start") + F.row_number().over(inside) - 1)
    own = F.floor(F.col("_seq") / chunk_rows)
    near_end = F.pmod(F.col("_seq"), F.lit(chunk_rows)) >= chunk_rows - lookback
    copies = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return (numbered.withColumn("_chunk", F.explode(copies))
            .withColumn("_own", F.col("_chunk") == own)
            .drop("_start"))


def chunk_window(key: str) -> Window:
    return Window.partitionBy(key, "_chunk").orderBy("_seq")


def own_rows(rows: DataFrame) -> DataFrame:
    return rows.where("_own").drop("_own", "_chunk", "_seq")


BANDS = 64          # pieces of a group
PER_BAND = 15       # sampled values per piece


def with_bands(cells: DataFrame, group: str, value: str, bands: int = BANDS) -> DataFrame:
    """Add ``_band``: which of up to ``bands`` about equal, ordered pieces of its group a value lies in.

    ``cells`` has one row per (group, value). Cut points come from the values with the smallest hashes, a fixed
    number per group, so they are a fair sample of the distinct values, the same whenever the plan runs, and
    part of the plan itself. They affect balance only, never a result.
    """
    fewest = Window.partitionBy(group).orderBy(F.xxhash64(value), value)
    sample = (cells.select(group, value, F.row_number().over(fewest).alias("_i")).where(F.col("_i") <= bands * PER_BAND)
              .groupBy(group).agg(F.sort_array(F.collect_list(value)).alias("_sample")))      # a fixed number of values
    points = sample.select(F.col(group).alias("_group"), F.expr(
        f"transform(filter(sequence(1, {bands - 1}), i -> i * size(_sample) >= {bands}), "
        f"i -> element_at(_sample, cast(i * size(_sample) div {bands} as int)))").alias("_cuts")) if bands > 1 else None
    if points is None:
        return cells.withColumn("_band", F.lit(0))
    step = max(2, math.isqrt(bands))
    v = F.col(value)
    block = F.size(F.expr(f"filter(_cuts, (c, i) -> i % {step} = {step - 1} and c < `{value}`)"))
    inside = F.size(F.filter(F.slice("_cuts", F.col("_block") * step + 1, F.lit(step)), lambda c: c < v))
    return (cells.join(points, F.col(group).eqNullSafe(F.col("_group")), "left").withColumn("_block", block)
            .withColumn("_band", F.coalesce(F.col("_block") * step + inside, F.lit(0))).drop("_group", "_cuts", "_block"))


def running_counts(
    cells: DataFrame,
    group: str,
    value: str,
    counts: Sequence[str],
    bands: int = BANDS,
) -> DataFrame:
    """Add ``<count>_below`` for each count: its sum over smaller values of the group.

    A prefix sum: ``cells`` has one row per (group, value); the sum is taken inside (group, band) pieces, and
    totals of the lower bands, at most ``bands`` rows per group, are added.
    """
    banded = with_bands(cells, group, value, bands)
    inside = (Window.partitionBy(group, "_band").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = banded.select("*", *[
        F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_below") for c in counts])
    lower = Window.partitionBy(group).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    totals = banded.groupBy(group, "_band").agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    offsets = totals.select(F.col(group).alias("_group"), F.col("_band").alias("_at"), *[
        F.coalesce(F.sum(f"_{c}").over(lower), F.lit(0)).alias(f"_{c}") for c in counts])
    joined = local.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_band") == F.col("_at")))
    return joined.select(*cells.columns, *[
        (F.col(f"{c}_below") + F.col(f"_{c}")).alias(f"{c}_below") for c in counts])


def exact_quantiles(
    rows: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: str,
    bands: int = BANDS,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group: ``(by, probability, threshold)``.

    Equal values collapse first and are cut into bands: band totals locate the one or two bands that
    hold each wanted rank, and only those bands are ordered. One lazy plan at every size.
    """
    ps = F.array(*[F.lit(float(p)) for p in probabilities])
    cells = (rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("_v"))
             .agg(F.count(F.lit(1)).alias("_c")))
    banded = with_bands(cells, by, "_v", bands)
    all_bands = Window.partitionBy(by)
    totals = banded.groupBy(by, "_band").agg(F.sum("_c").alias("_n"))
    spans = totals.select(
        by, "_band", F.sum("_n").over(all_bands.orderBy("_band")).alias("_upto"), "_n",
        F.sum("_n").over(all_bands).alias("_total"))
    rank = F.floor("_h")
    wanted = (spans.withColumn("probability", F.explode(ps))
              .withColumn("_h", (F.col("_total") - 1) * F.col("probability"))
              .withColumn("_first", F.col("_upto") - F.col("_n"))
              .where((F.col("_upto") > rank) & (F.col("_first") <= rank + 1))
              .select(F.col(by).alias("_group"), F.col("_band").alias("_at"), "probability", "_h", "_first"))
    keys = [by, "probability", "_band", "_first", "_h"]
    met = banded.join(wanted, F.col(by).eqNullSafe(F.col("_group")) & (F.col("_band") == F.col("_at"))).select(*keys, "_v", "_c")
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v"))
    last = F.col("_first") + F.col("_upto") - 1                 # rank of the last copy of a value
    out = met.withColumn("_upto", upto).groupBy(by, "probability", "_h").agg(
        F.min(F.when(last >= rank, F.col("_v"))).alias("_a"),
        F.min(F.when(last >= rank + 1, F.col("_v"))).alias("_b"))
    step = F.coalesce(F.col("_b") - F.col("_a"), F.lit(0.0)) * (F.col("_h") - rank)
    return out.select(by, "probability", (F.col("_a") + step).alias("threshold"))


def frame_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs, with ``surplus`` (copies in a minus copies in b).

    One shuffle with map-side combine; NULLs compare equal; copies collapse before
    they move.
    """
    cols = a.columns
    both = (a.withColumn("_w", F.lit(1)).unionByName(b.select(*cols).withColumn("_w", F.lit(-1))))
    return (both.groupBy(*cols).agg(F.sum("_w").alias("surplus")).where("surplus <> 0"))
