"""Comparisons of two selection lists on the days both have signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.functions.scalars import flag, half_of
from barlab.operators.evaluation import VIEWS, bit, known_flag, period_summary, signature
from barlab.operators.grouping import small_by_day


def union_lists(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("date", "code", "half")) -> DataFrame:
    """Full outer union of two lists with side flags; a missing side is false."""
    a = left.select(*keys, F.lit(True).alias("left"))
    b = right.select(*keys, F.lit(True).alias("right"))
    joined = a.join(b, list(keys), "full_outer")
    return joined.select(*keys, flag(F.col("left")).alias("left"), flag(F.col("right")).alias("right"))


def missing_labels(labels: DataFrame, *lists: DataFrame, keys: Sequence[str] = ("date", "code")) -> DataFrame:
    """List keys that have no label; a complete comparison has none."""
    keys = list(keys)
    wanted = lists[0].select(*keys)
    for other in lists[1:]:
        wanted = wanted.unionByName(other.select(*keys))
    return wanted.distinct().join(labels.select(*keys), keys, "left_anti")


def signal_days(rows: DataFrame) -> DataFrame:
    """Row counts of both lists per day: one row per date."""
    return rows.groupBy("date").agg(
        F.count_if("left").alias("left_rows"), F.count_if("right").alias("right_rows"))


def day_coverage(rows: DataFrame) -> DataFrame:
    """Every signal day with its status: common, left_only or right_only."""
    days = signal_days(rows).where("left_rows + right_rows > 0")
    status = (F.when((F.col("left_rows") > 0) & (F.col("right_rows") > 0), "common")
              .when(F.col("left_rows") > 0, "left_only").otherwise("right_only"))
    return days.select("date", status.alias("coverage"))


def coupled_outcomes(targets: Mapping[str, str] | None = None) -> list[tuple[int, bool, str, str]]:
    """(bps, sensitive, target, column stem) for each view; stems name 0/1 outcomes per cost."""
    targets = targets or {"opportunity": "opportunity"}
    return [(b, s, name, stem) for b, s in VIEWS for name, stem in targets.items()]


def coupled_bounds(rows: DataFrame, outcomes=None) -> DataFrame:
    """Bounds of the difference in success share when both lists share unknown outcomes.

    Each stock-day has one 0/1 outcome, so it enters with the weight
    left/left_rows - right/right_rows. That weight takes three values per day (left
    only, right only, both), so counts per day are enough: rows collapse to
    (day, signature) cells and no per-day window is needed. Days without rows on
    both sides are dropped; ``day_coverage`` lists them. A known row without an outcome is refused
    when it is read, as it is neither a success nor a failure.
    """
    outcomes = outcomes or coupled_outcomes()
    facts = {"left": flag(F.col("left")), "right": flag(F.col("right")), "unfilled": flag(F.col("known_unfilled"))}
    for bps, sens, target, stem in outcomes:
        facts[f"known{bps}{int(sens)}"] = known_flag(bps, sens)
        gap = known_flag(bps, sens) & F.col(f"{stem}{bps}").isNull()
        facts[f"{target}{bps}"] = F.when(gap, F.raise_error(F.lit(f"a known row lacks {stem}{bps}")).cast("boolean")).otherwise(
            F.col(f"{stem}{bps}") == 1)
    cells = rows.select("date", signature(list(facts.values())).alias("_sig")).groupBy("date", "_sig").agg(
        F.count(F.lit(1)).alias("_n"))
    at = {name: bit("_sig", i) for i, name in enumerate(facts)}
    records = F.array(*[
        F.struct(F.lit(bps).alias("bps"), F.lit(sens).alias("sensitive"), F.lit(target).alias("target"),
                 (at[f"known{bps}{int(sens)}"] & at[f"{target}{bps}"]).alias("_y"),
                 (~at[f"known{bps}{int(sens)}"] & ~at["unfilled"]).alias("_open"))
        for bps, sens, target, _ in outcomes])
    n = F.col("_n")
    both = cells.select("date", "_n", at["left"].alias("_l"), at["right"].alias("_r"), F.inline(records))
    sides = {"l": F.col("_l") & ~F.col("_r"), "r": F.col("_r") & ~F.col("_l"), "b": F.col("_l") & F.col("_r")}
    count = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0).cast("long"))
    days = both.groupBy("date", "bps", "sensitive", "target").agg(
        count(F.col("_l")).alias("left_rows"), count(F.col("_r")).alias("right_rows"),
        *[count(inside & F.col("_y")).alias(f"_y_{s}") for s, inside in sides.items()],
        *[count(inside & F.col("_open")).alias(f"_u_{s}") for s, inside in sides.items()],
    ).where("left_rows > 0 and right_rows > 0")

    nl, nr = F.col("left_rows").cast("double"), F.col("right_rows").cast("double")
    weight = {"l": 1 / nl, "r": -1 / nr, "b": 1 / nl - 1 / nr}
    zero = F.lit(0.0)
    seen = sum((weight[s] * F.col(f"_y_{s}") for s in sides), zero)
    low = sum((F.least(weight[s], zero) * F.col(f"_u_{s}") for s in sides), zero)
    high = sum((F.greatest(weight[s], zero) * F.col(f"_u_{s}") for s in sides), zero)
    return days.select(
        "date", half_of(F.col("date")).alias("half"), "bps", "sensitive", "target", "left_rows", "right_rows",
        (seen + low).alias("lower"), (seen + high).alias("upper"),
        (high - low).alias("unknown_weight"), F.col("_u_b").alias("shared_unknown"))


def coupled_periods(daily: DataFrame, kinds=("half", "year"), spine: DataFrame | None = None) -> DataFrame:
    metrics = ("lower", "upper", "unknown_weight")
    return period_summary(daily, ("bps", "sensitive", "target"), ("shared_unknown",), metrics, kinds, metrics, spine)


PAIRED_METRICS = ("rate", "one_percent_rate", "mean_reference", "negative_reference", "bad3")


def paired_delta(left: DataFrame, right: DataFrame, metrics: Sequence[str] = PAIRED_METRICS) -> DataFrame:
    """Left minus right daily metrics on common days; keys are (bps, sensitive, date, half)."""
    keys = ["bps", "sensitive", "date", "half"]
    cols = [*metrics, "lower", "upper"]
    a = left.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = right.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols])
    both = a.join(b, keys)
    return both.select(
        *keys, *[(F.col(f"a_{m}") - F.col(f"b_{m}")).alias(f"{m}_delta") for m in metrics],
        (F.col("a_lower") - F.col("b_upper")).alias("lower_delta"),
        (F.col("a_upper") - F.col("b_lower")).alias("upper_delta"))


def on_common_days(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both lists reduced to the days on which each has a row."""
    common = left.select("date").distinct().intersect(right.select("date").distinct())
    keep = lambda f: f.join(small_by_day(common), "date", "left_semi")
    return keep(left), keep(right)


def only_days(left: DataFrame, right: DataFrame) -> DataFrame:
    """Days of the left list without any row in the right list."""
    return (left.select("date").distinct()
            .join(small_by_day(right.select("date").distinct()), "date", "left_anti"))
