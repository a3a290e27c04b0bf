"""Weekly block bootstrap intervals for many groups and metrics at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlab.functions.scalars import week_of

DRAWS = 10_000
TAILS = (0.025, 0.975)
ROWS = 2_000            # draws of many weeks multiplied at a time
SMALL = 1 << 20         # draws times weeks whose counts a task keeps


@lru_cache(maxsize=2)
def counter_numbers(first: int, draws: int, slots: int) -> np.ndarray:
    """A number below 2^32 for each draw, from ``first``, and slot, both counted from 1.

    It depends only on (draw, slot): a lost task rebuilds the same numbers, and all metrics and groups with
    equally many blocks resample the same positions.
    """
    text = (md5(b"%d:%d" % (d, s)).digest()[:4] for d in range(first, first + draws) for s in range(1, slots + 1))
    return np.frombuffer(b"".join(text), ">u4").reshape(draws, slots).astype(np.int64)


def draw_counts(picks: np.ndarray, n: int) -> np.ndarray:
    """How often each draw takes each block."""
    places = picks + np.arange(len(picks))[:, None] * n
    return np.bincount(places.ravel(), minlength=len(picks) * n).reshape(len(picks), n).astype(float)


@lru_cache(maxsize=32)
def counter_counts(draws: int, n: int) -> np.ndarray:
    """The counts of all draws for a number of blocks; the numbers are made for some more slots, to serve other numbers of blocks."""
    return draw_counts(counter_numbers(1, draws, -(-n // 64) * 64)[:, :n] % n, n)


def weekly_blocks(daily: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Sum of each metric and number of days per group and ISO week, weeks numbered from 0.

    Weeks are bounded by the calendar (5,218 in a century), so numbering a group is small.
    """
    weeks = daily.groupBy(*keys, week_of(F.col("date")).alias("week")).agg(
        F.count(F.lit(1)).alias("days"),
        *[F.sum(m).alias(f"sum_{m}") for m in metrics],
        *[F.count_if(F.col(m).isNull()).alias(f"gap_{m}") for m in metrics])
    group = Window.partitionBy(*keys)
    return weeks.withColumns({
        "block": F.row_number().over(group.orderBy("week")) - 1,
        "n_blocks": F.count(F.lit(1)).over(group),
    })


def group_weeks(daily: DataFrame, keys: Sequence[str], counts: Sequence[str] = (), metrics: Sequence[str] = (),
                resampled: Sequence[str] = ()) -> DataFrame:
    """One row per group in one pass: weeks, days, sums of counts, day-equal means, and the weeks of the resampled metrics.

    ``_gap_<metric>`` counts days without a value; ``_blocks`` is the array of weeks (5,218 in a century).
    """
    every = list(dict.fromkeys([*metrics, *resampled]))
    weeks = daily.groupBy(*keys, week_of(F.col("date")).alias("_week")).agg(
        F.count(F.lit(1)).alias("_days"), *[F.sum(c).alias(f"_c_{c}") for c in counts],
        *[F.sum(m).alias(f"_s_{m}") for m in every], *[F.count(m).alias(f"_n_{m}") for m in every])
    block = F.struct("_week", F.col("_days").cast("double").alias("_days"), *[F.col(f"_s_{m}").cast("double").alias(f"_s_{m}") for m in resampled])
    return weeks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("weeks"), F.sum("_days").alias("days"), *[F.sum(f"_c_{c}").alias(c) for c in counts],
        *[F.try_divide(F.sum(f"_s_{m}"), F.sum(f"_n_{m}")).alias(m) for m in metrics],
        *[F.sum(F.col("_days") - F.col(f"_n_{m}")).alias(f"_gap_{m}") for m in resampled],
        F.sort_array(F.collect_list(block)).alias("_blocks"))


def with_intervals(groups: DataFrame, metrics: Sequence[str], draws: int = DRAWS, draw_table: DataFrame | None = None) -> DataFrame:
    """Add ``<metric>_ci_low`` and ``_ci_high`` to the rows of ``group_weeks``: quantiles of resampled day-equal means.

    No interval when a daily value is missing, or with fewer than two weeks. The draws of a number of weeks are a
    matrix of how often each week is taken; it is made once per task and multiplied with the sums of all
    metrics of a group at once. ``draw_table`` replaces the counter draws with given (n_blocks, draw, pick) rows.
    """
    ends = [f"{m}_ci_{e}" for m in metrics for e in ("low", "high")]
    kept = [f for f in groups.schema if f.name != "_blocks" and not f.name.startswith("_gap_")]
    given: dict[int, np.ndarray] | None = None
    if draw_table is not None:
        given, rows = {}, sorted(draw_table.select("n_blocks", "draw", "pick").collect())       # given by the caller: draws x weeks
        for n in {r[0] for r in rows}:
            given[n] = np.array([r[2] for r in rows if r[0] == n], np.int64).reshape(-1, n)

    def counts_of(n: int) -> Iterator[np.ndarray]:
        if given is not None:
            yield draw_counts(given[n], n)
        elif draws * n <= SMALL:
            yield counter_counts(draws, n)
        else:
            for first in range(1, draws + 1, ROWS):
                yield draw_counts(counter_numbers(first, min(ROWS, draws + 1 - first), n) % n, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, found = batch.column(batch.schema.get_field_index("_blocks")), []
            for k in range(batch.num_rows):
                weeks = blocks[k].values
                whole = [m for m in metrics if batch.column(batch.schema.get_field_index(f"_gap_{m}"))[k].as_py() == 0]
                out = {}
                if len(weeks) >= 2 and whole:
                    sums = np.array([weeks.field("_days").to_numpy(), *[weeks.field(f"_s_{m}").to_numpy() for m in whole]])
                    totals = np.concatenate([c @ sums.T for c in counts_of(len(weeks))])
                    low, high = np.quantile(totals[:, 1:] / totals[:, :1], TAILS, axis=0)
                    out = {f"{m}_ci_{e}": float(x) for e, side in (("low", low), ("high", high)) for m, x in zip(whole, side)}
                found.append([out.get(e) for e in ends])
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            columns += [pa.array([x[i] for x in found], pa.float64()) for i in range(len(ends))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ends)

    schema = T.StructType(list(kept))
    for e in ends:
        schema = schema.add(e, "double")
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartition(parts, *[f.name for f in kept]).mapInArrow(run, schema)      # few small rows, much work each


def block_intervals(
    daily: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str],
    draws: int = DRAWS,
    draw_table: DataFrame | None = None,
) -> DataFrame:
    """weeks and the interval of each metric per group."""
    groups = group_weeks(daily, keys, resampled=metrics)
    return with_intervals(groups, metrics, draws, draw_table).drop("days")
