"""Queries over daily and intraday bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlab.operators import audit, bars, contracts, costs, evaluation, labels
from barlab.operators.grouping import small_by_day
from barlab.plans.output import tidied
from barlab.plans.views import HOURLY, MONTHLY, daily, index_bars, monthly_bars, shares
from barlab.plans.views import bars as bar_table

ENTRY_BPS = 15.0


def price_reference_states(spark, sf):
    return tidied(audit.reference_states(daily(spark, sf)), 7)


LOOK_AHEAD_CUT = "1997-06-30"


def leaking_states(rows):
    """States with a planted leak: the close of the next active day."""
    ahead = F.lead("close").over(Window.partitionBy("code").orderBy("date"))
    return audit.reference_states(rows).withColumn("next_close", ahead)


def look_ahead_check(spark, sf):
    """Reference states up to a day under two versions of all later rows, and the same with a planted leak."""
    d = daily(spark, sf)
    own = audit.look_ahead(d, audit.reference_states, LOOK_AHEAD_CUT).withColumn("states", F.lit("reference"))
    return own.unionByName(audit.look_ahead(d, leaking_states, LOOK_AHEAD_CUT).withColumn("states", F.lit("planted")))


def _feature_keys(spark, sf):
    """Feature keys with a stored volatility; a tenth of the stored values is off."""
    d = daily(spark, sf)
    states = audit.reference_states(d)
    off = F.when((F.dayofmonth("date") + F.col("code")) % 10 == 0, 0.001).otherwise(0.0)
    keys = d.where((F.col("code") + F.dayofmonth("date")) % 5 != 0).select(
        "date", "code", "preclose", ((F.col("code") + F.dayofmonth("date")) % 4 != 0).alias("formula_input_valid"))
    stored = states.select("date", "code", ((100 * F.col("atr_raw")) / F.nullif(F.col("preclose"), F.lit(0.0)) + off).alias("V01"))
    return keys.join(stored, ["date", "code"], "left"), states


def volatility_rebuild(spark, sf):
    keys, states = _feature_keys(spark, sf)
    out = audit.volatility_rebuild(keys, states)
    return tidied(out.select("date", "code", "formula_input_valid", "v01_raw_rebuilt", "v01_reference",
                             "reference_window_known", "v01_match", "reset_in_prior"), 7)


def reset_exposure_by_half(spark, sf):
    keys, states = _feature_keys(spark, sf)
    return audit.exposure_by_half(audit.volatility_rebuild(keys, states))


def bar_functions(spark, sf):
    return tidied(bars.bar_functions(bar_table(spark, sf), n=5))


def bar_day_context(spark, sf):
    return tidied(bars.day_context(bars.day_bars(bar_table(spark, sf), HOURLY)), 7)


def official_closes(days):
    """A table of official prior closes for days with context: some reset, some missing."""
    dom = F.dayofmonth("date")
    return days.where(dom % 11 != 5).select(
        "code", "date", F.when(dom % 7 == 3, F.col("dcp1") * 0.9).otherwise(F.col("dcp1")).alias("preclose"))


def _featured_days(b):
    days = bars.day_context(bars.day_bars(b, HOURLY))
    return bars.day_features(bars.with_official_close(days, official_closes(days)), HOURLY)


def bar_features_daily(spark, sf):
    days = _featured_days(bar_table(spark, sf))
    return tidied(days.select("date", "code", *bars.DAY_FEATURES), 7)


def bar_features_intraday(spark, sf):
    b = bar_table(spark, sf)
    days = _featured_days(b)
    tail = bars.scale_tail(bars.tail_features(b, HOURLY).join(days, ["code", "date"]))
    return tidied(tail.select("date", "code", *bars.TAIL_FEATURES), 7)


def index_relative_features(spark, sf):
    days = _featured_days(bar_table(spark, sf))
    out = bars.relative_features(bars.index_features(days, bars.index_days(index_bars(spark, sf), HOURLY)))
    return tidied(out.select("date", "code", *bars.INDEX_FEATURES, *bars.RELATIVE_FEATURES), 6)


def turnover_features(spark, sf):
    b = bar_table(spark, sf)
    days = bars.day_bars(b, HOURLY).join(
        bars.tail_features(b, HOURLY).select("code", "date", "tail_volume"), ["code", "date"], "left")
    out = bars.turnover_features(days, shares(spark, sf), HOURLY)
    return tidied(out.select("date", "code", "psh", *bars.TURNOVER_FEATURES), 7)


def morning_range(spark, sf):
    b = bar_table(spark, sf)
    days = bars.day_context(bars.day_bars(b, HOURLY))
    out = bars.morning_features(days, bars.morning_range(b, HOURLY))
    return tidied(out.select("date", "code", "morning_high", "morning_low", "morning_complete",
                             *bars.MORNING_FEATURES), 7)


def clock_guard(spark, sf):
    return bars.clock_guard(bar_table(spark, sf), HOURLY)


def _flawed(spark, sf):
    """Bars with some broken brackets and off-grid closes, so the guards have work."""
    mark = F.col("slot") + F.dayofmonth("date")
    return bar_table(spark, sf).withColumns({
        "high": F.when(mark % 11 == 0, F.col("low") / 2).otherwise(F.col("high")),
        "close": F.when(mark % 23 == 0, F.col("close") + 0.003).otherwise(F.col("close"))})


def bar_quality(spark, sf):
    return bars.day_quality(_flawed(spark, sf))


def price_path(spark, sf):
    return bars.price_path(_flawed(spark, sf), HOURLY, bars.day_context(bars.day_bars(bar_table(spark, sf), HOURLY)))


def feature_table(spark, sf):
    b = bar_table(spark, sf)
    official = official_closes(bars.day_context(bars.day_bars(b, HOURLY)))
    out = bars.feature_table(b, index_bars(spark, sf), shares(spark, sf), official, HOURLY)
    return tidied(out, 6)


def entry_vwap(spark, sf):
    return tidied(labels.entry_prices(bar_table(spark, sf), HOURLY, ENTRY_BPS, HOURLY.volume_unit))


def _watched(spark, sf):
    b = bar_table(spark, sf)
    entries = labels.entry_prices(b, HOURLY, ENTRY_BPS, HOURLY.volume_unit).where("entry_price is not null")
    return labels.watch_window(b, entries, HOURLY)


def order_labels(spark, sf):
    out = labels.order_labels(_watched(spark, sf), HOURLY.watch_last - HOURLY.watch_first + 1)
    return tidied(out.drop("mark_return", "adverse_return"))


def window_marks(spark, sf):
    out = labels.order_labels(_watched(spark, sf), HOURLY.watch_last - HOURLY.watch_first + 1)
    return tidied(out.select("date", "code", "known", "mark_return", "adverse_return"), 8)


FEES = (costs.Fee("sh", "1992-01-01", 0.0008, 0.0018, 5.0), costs.Fee("sh", "1996-04-01", 0.0003, 0.0013, 5.0),
        costs.Fee("sz", "1992-01-01", 0.0006, 0.0016, 1.0), costs.Fee("sz", "1997-11-15", 0.0003, 0.0008, 5.0))


def _charged(spark, sf):
    b = monthly_bars(spark, sf)
    entries = labels.entry_prices(b, MONTHLY, ENTRY_BPS).drop("entry_cost", "fits_capacity")
    market = F.when(F.col("code") % 2 == 0, "sh").otherwise("sz")
    calendar = small_by_day(labels.market_calendar(b))
    due = entries.withColumn("market", market).join(calendar, "date").where("next_date is not null")
    return b, costs.round_trip(due, FEES)


def round_trip_costs(spark, sf):
    """Entries with fees of both sides as they held on their days, and the quote at which they break even."""
    out = _charged(spark, sf)[1]
    return tidied(out.select("code", "date", "next_date", "market", "entry_state", "decision_shares", "capacity", "entry_price",
                             "cost5", "break_even5", "cost15", "break_even15"), 6)


def _cost_labels(spark, sf):
    b, charged = _charged(spark, sf)
    return costs.labels_at_costs(labels.watched_bars(b, charged, MONTHLY, "left"), MONTHLY.watch_last - MONTHLY.watch_first + 1)


def cost_labels(spark, sf):
    return tidied(_cost_labels(spark, sf), 8)


def cost_label_days(spark, sf):
    """Daily statistics straight from the bars: prices, fees, labels at both costs, counts and bounds."""
    return tidied(evaluation.daily_opportunity(_cost_labels(spark, sf)), 8)


def daily_contracts(spark, sf):
    d = daily(spark, sf)
    active = F.col("tradestatus") == 1
    rows = contracts.row_checks(d, {
        "status_domain": contracts.in_domain("tradestatus", [0, 1]),
        "unadjusted": contracts.in_domain("adjustflag", [3]),
        "finite_preclose_when_active": contracts.finite_when("preclose", active),
        "dates_in_range": contracts.within_dates("1995-01-01", "2002-06-01"),
        "range_identity": (F.col("high") >= F.col("close")) & (F.col("low") <= F.col("close")),
    })
    return contracts.key_check(d).unionByName(rows)


QUERIES = {f.__name__: f for f in (
    price_reference_states, look_ahead_check, volatility_rebuild, reset_exposure_by_half, bar_functions, bar_day_context,
    bar_features_daily, bar_features_intraday, index_relative_features, turnover_features, morning_range,
    clock_guard, bar_quality, price_path, feature_table, round_trip_costs, cost_labels, cost_label_days, entry_vwap, order_labels, window_marks,
    daily_contracts)}
