"""Audit of earlier reference-price changes in daily bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.scalars import finite, flag, half_of, nan_to_null, on_cent_grid, ratio
from barlab.operators.grouping import frame_difference

# Fixed values of the audit.
HISTORY = 20
CHANGE = 0.005
EDGE = 1e-4
MATCH = 2e-10
UNADJUSTED = 3


def good_prices() -> Column:
    """Finite, positive, unadjusted, traded, bracketed and on the cent grid."""
    o, h, l, c = (F.col(n) for n in ("open", "high", "low", "close"))
    good = (F.col("adjustflag") == UNADJUSTED) & (F.col("volume") > 0)
    for p in (o, h, l, c):
        good = good & finite(p) & (p > 0) & on_cent_grid(p, EDGE)
    return flag(good & (h + EDGE >= F.greatest(o, h, l, c)) & (l - EDGE <= F.least(o, h, l, c)))


def true_range(base: Column) -> Column:
    """Largest of the day's range and the distances of its ends from ``base``; NULLs are skipped."""
    h, l = F.col("high"), F.col("low")
    return F.greatest(h - l, F.abs(h - base), F.abs(l - base))


def reference_states(daily: DataFrame) -> DataFrame:
    """State of the earlier active days at each active day of a code.

    Suspended days leave the sequence; bad active days keep their place in it. Only
    earlier days enter. A date that stands twice in a code's active days is refused when
    its states are read, so a code has at most one row per calendar day; all windows share one
    shuffle and one sort.
    """
    code = Window.partitionBy("code").orderBy("date")
    prior = code.rowsBetween(-HISTORY, -1)
    longer = code.rowsBetween(-(HISTORY + 1), -1)
    active = nan_to_null(daily).where("tradestatus = 1").withColumn("_good", good_prices())
    base = active.withColumns({
        "prior_close": F.lag("close").over(code),
        "_prior_good": F.lag("_good", 1, False).over(code),
        "_again": flag(F.lag("date").over(code) == F.col("date")),
    })
    preclose = F.col("preclose")
    once = lambda c: F.when(F.col("_again"), F.raise_error(F.lit("a date stands twice"))).otherwise(c)
    usable = flag(finite(preclose) & (preclose > 0)) & F.col("_good") & F.col("_prior_good")
    marked = base.withColumns({
        "reference_good": usable,
        "reset": F.when(usable, F.abs(preclose - F.col("prior_close")) > CHANGE),
        "_tr": true_range(F.col("prior_close")),
        "_tr_ref": F.when(usable, true_range(preclose)),
    })
    full = lambda x, value: F.when(F.count(x).over(prior) == HISTORY, value)
    return marked.select(
        once(F.col("date").cast("string")).cast("date").alias("date"), "code", "close", "preclose", "prior_close", "reference_good", "reset",
        F.count("reset").over(prior).alias("prior_reference_count"),
        full("reset", F.sum(F.col("reset").cast("int")).over(prior)).alias("prior_reset_count"),
        full("_tr", F.avg("_tr").over(prior)).alias("atr_raw"),
        full("_tr_ref", F.avg("_tr_ref").over(prior)).alias("atr_reference"),
        ((F.count(F.lit(1)).over(longer) == HISTORY + 1)
         & (F.count_if("_good").over(longer) == HISTORY + 1)).alias("history_price_good"))


def look_ahead(daily: DataFrame, states_of, cut: str, keys: Sequence[str] = ("date", "code")) -> DataFrame:
    """compared, changed: states up to ``cut`` computed twice, once with every later price, volume and status altered.

    ``states_of`` maps daily rows to states. States that only look back do not change; both versions are
    compared as multisets, so a state that appears, goes or differs counts, once per key.
    """
    later = F.col("date") > F.lit(cut).cast("date")
    moved = {c: F.when(later, F.col(c) * 1.5 + 1).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "preclose")}
    altered = daily.withColumns({
        **moved, "volume": F.when(later, F.col("volume") + 1).otherwise(F.col("volume")),
        "tradestatus": F.when(later, 1).otherwise(F.col("tradestatus"))})
    early = lambda rows: states_of(rows).where(F.col("date") <= F.lit(cut).cast("date"))
    changed = frame_difference(early(daily), early(altered)).select(*keys).distinct().agg(F.count(F.lit(1)).alias("changed"))
    return early(daily).agg(F.count(F.lit(1)).alias("compared")).withColumn("changed", changed.scalar())


def volatility_rebuild(keys: DataFrame, states: DataFrame) -> DataFrame:
    """Rebuild the volatility input of each feature key and flag its agreement.

    ``keys`` has date, code, formula_input_valid, V01 and the official preclose; keys
    without a state stay, as unknown.
    """
    names = ("prior_close", "prior_reference_count", "prior_reset_count", "atr_raw", "atr_reference",
             "history_price_good")
    joined = keys.join(states.select("date", "code", *names), ["date", "code"], "left")
    raw = ratio(100 * F.col("atr_raw"), F.col("preclose"))
    reference = ratio(100 * F.col("atr_reference"), F.col("preclose"))
    known = flag(F.col("history_price_good")) & flag(F.col("prior_reference_count") == HISTORY)
    return joined.withColumns({
        "v01_raw_rebuilt": raw, "v01_reference": reference, "reference_window_known": known,
    }).withColumns({
        "v01_match": flag(F.abs(F.col("v01_raw_rebuilt") - F.col("V01")) <= MATCH),
        "reset_in_prior": F.when(known, F.col("prior_reset_count") > 0),
    })


def exposure_by_half(rebuilt: DataFrame) -> DataFrame:
    """Counts of valid keys by what their reference history shows."""
    known = F.col("reference_window_known")
    gap = F.col("v01_raw_rebuilt") - F.col("v01_reference")
    return rebuilt.where("formula_input_valid").groupBy(half_of(F.col("date")).alias("half")).agg(
        F.count(F.lit(1)).alias("original_valid"),
        F.count_if(~known).alias("reference_unknown"),
        F.count_if(known & (F.col("prior_reset_count") > 0)).alias("prior_reset_exposed"),
        F.count_if(known & (F.abs(gap) > MATCH)).alias("volatility_changed"),
        F.count_if(known & (gap > MATCH)).alias("reference_volatility_lower"),
        F.count_if(~F.col("v01_match")).alias("v01_mismatch"))
