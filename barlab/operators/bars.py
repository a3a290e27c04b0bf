"""Bar functions and the fifty bar features, on tables of (code, date, slot) bars.

Day quantities come from one partially aggregated ``groupBy(code, date)``. Row-frame
quantities run over bounded chunks of each code's bars (see ``grouping.row_chunks``),
so a code with very many bars is spread over many tasks. Windows over code-days need
no chunks: after the day aggregation a code has at most one row per calendar day.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.scalars import flag, ratio
from barlab.operators.grouping import chunk_window, own_rows, row_chunks, small_by_day


def minute_clocks(first: int, last: int) -> tuple[int, ...]:
    """Every hhmm label from first to last."""
    minutes = range(first // 100 * 60 + first % 100, last // 100 * 60 + last % 100 + 1)
    return tuple(m // 60 * 100 + m % 60 for m in minutes)


@dataclass(frozen=True)
class Clocks:
    """Clock labels and frame lengths (in bars) of the feature definitions."""

    decision: int = 1449
    back_long: int = 1301
    back_mid: int = 1420
    back_short: int = 1435
    index_decision: int = 1448
    tail: int = 29
    half_tail: int = 14
    burst: int = 4
    afternoon: int = 109
    path: int = 30
    morning_first: int = 930
    morning_last: int = 1130
    morning_bars: int = 121
    session_first: int = 931
    session: tuple[int, ...] = field(
        default_factory=lambda: minute_clocks(931, 1130) + minute_clocks(1301, 1448))
    entry_slots: tuple[int, ...] = (1452, 1453, 1454, 1455)
    watch_first: int = 931
    watch_last: int = 959
    volume_unit: int = 100
    money_unit: float = 1e8


# --- bar functions -----------------------------------------------------------------

def ref(x: Column, n: int, window: Window) -> Column:
    """Value n bars ago."""
    return F.lag(x, n).over(window)


def frame(window: Window, n: int, skip: int = 0) -> Window:
    """The last n rows, ending ``skip`` rows back."""
    return window.rowsBetween(-(n - 1) - skip, -skip)


def rolling(fn, x: Column, n: int, window: Window, skip: int = 0) -> Column:
    """``fn`` over n rows ending ``skip`` rows back; NULL until n rows exist."""
    f = frame(window, n, skip)
    return F.when(F.count(F.lit(1)).over(f) == n, fn(x).over(f))


def rolling_sum(x, n, window, skip=0):
    return rolling(F.sum, x, n, window, skip)


def highest(x, n, window, skip=0):
    return rolling(F.max, x, n, window, skip)


def lowest(x, n, window, skip=0):
    return rolling(F.min, x, n, window, skip)


def count_when(condition: Column, n: int, window: Window, skip: int = 0) -> Column:
    return rolling(F.count_if, condition, n, window, skip)


def value_when(condition: Column, x: Column, day_window: Window) -> Column:
    """x at the latest bar of the day so far where the condition held."""
    return F.last(F.when(condition, x), ignorenulls=True).over(
        day_window.rowsBetween(Window.unboundedPreceding, 0))


def bars_today(day_window: Window) -> Column:
    return F.row_number().over(day_window)


def bars_since(condition: Column, day_window: Window) -> Column:
    """Bars since the condition last held today; NULL before it first did."""
    n = F.row_number().over(day_window)
    hit = F.max(F.when(condition, F.col("_bar"))).over(day_window.rowsBetween(Window.unboundedPreceding, 0))
    return n - hit


def whole(x: Column) -> Column:
    """Truncation towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def day_window() -> Window:
    return Window.partitionBy("code", "date").orderBy("slot")


def bar_functions(bars: DataFrame, n: int, chunk_rows: int = 100_000) -> DataFrame:
    """Each bar function once, on every bar."""
    w, today = chunk_window("code"), day_window()
    c, v = F.col("close"), F.col("volume")
    chunks = row_chunks(bars, "code", "date", ["slot"], n, chunk_rows)
    rolled = own_rows(chunks.select(
        "code", "date", "slot", "open", "close", "volume", "_seq", "_chunk", "_own",
        ref(c, 1, w).alias("ref_close"),
        rolling_sum(v, n, w).alias("sum_volume"),
        highest(F.col("high"), n, w).alias("highest_high"),
        lowest(F.col("low"), n, w).alias("lowest_low"),
        F.when(F.count(F.lit(1)).over(frame(w, n)) == n,
               F.count_if(F.col("close") > F.col("open")).over(frame(w, n))).alias("rising_bars")))
    numbered = rolled.withColumn("_bar", bars_today(today))
    up = c > F.col("open")
    return numbered.select(
        "code", "date", "slot", "ref_close", "sum_volume", "highest_high", "lowest_low", "rising_bars",
        F.col("_bar").alias("bars_today"),
        F.sum("volume").over(today.rowsBetween(Window.unboundedPreceding, 0)).alias("volume_today"),
        value_when(up, c, today).alias("last_rising_close"),
        bars_since(up, today).alias("bars_since_rise"),
        F.when(up & (v > 1), F.greatest(c, F.col("open"))).otherwise(F.least(c, F.lit(50.0))).alias("chosen"),
        F.when(v > 1, F.abs(F.log(c / F.col("open")))).alias("log_move"),
        whole(c * 100).alias("close_cents"))


# --- guards ------------------------------------------------------------------------

def on_grid(price: Column) -> Column:
    """Price is a whole number of cents within a hundredth of a cent."""
    return F.abs(price * 100 - F.round(price * 100)) <= 0.01


def bar_quality(tolerance: float = 1e-4, grid: bool = True) -> Column:
    o, h, l, c, v = (F.col(n) for n in ("open", "high", "low", "close", "volume"))
    good = ((o > 0) & (h > 0) & (l > 0) & (c > 0) & (v >= 0)
            & (h + tolerance >= F.greatest(o, c, l)) & (l - tolerance <= F.least(o, c)))
    if grid:
        for p in (o, h, l, c):
            good = good & on_grid(p)
    return flag(good)


def day_quality(bars: DataFrame) -> DataFrame:
    good = bar_quality()
    return bars.groupBy("code", "date").agg(
        F.count(F.lit(1)).alias("bars"), F.count_if(~good).alias("bad_bars"),
        F.bool_and(good).alias("all_good"), F.bool_or(F.col("volume") > 1).alias("any_busy_bar"))


def clock_guard(bars: DataFrame, clocks: Clocks) -> DataFrame:
    """Whether the bars before the decision bar are exactly the expected clocks.

    Slots are unique within a code and day, so equal counts mean equal sequences.
    """
    before = F.col("slot").between(clocks.session_first, clocks.decision) & (F.col("slot") != clocks.decision)
    n = len(clocks.session)
    return bars.groupBy("code", "date").agg(
        F.count_if(F.col("slot").isin(*clocks.session)).alias("matched_clocks"),
        F.count_if(before).alias("bars_before"),
        F.bool_or(F.col("slot") == clocks.decision).alias("has_decision"),
    ).withColumn("clock_ok", F.col("has_decision") & (F.col("matched_clocks") == n) & (F.col("bars_before") == n))


def price_path(bars: DataFrame, clocks: Clocks, context: DataFrame, chunk_rows: int = 100_000) -> DataFrame:
    """Closes of the last bars in cents, relative to the decision close, with a validity flag.

    Slots rise strictly within a day, so the clocks in between are complete when the
    oldest bar of the path carries the clock that many minutes earlier. ``context`` has each
    code-day's ``vp20``, which must be positive for a path to count.
    """
    n = clocks.path
    w = chunk_window("code")
    cents = F.round(F.col("close") * 100).cast("long")
    good = (F.col("close") > 0) & on_grid(F.col("close"))
    chunks = row_chunks(bars.select("code", "date", "slot", "close"), "code", "date", ["slot"], n, chunk_rows)
    rolled = own_rows(chunks.select(
        "code", "date", "slot", "close", "_seq", "_chunk", "_own", cents.alias("close_cents"),
        F.lag("slot", n - 1).over(w).alias("_slot0"), F.lag("date", n - 1).over(w).alias("_date0"),
        F.count_if(good).over(frame(w, n)).alias("good_bars"),
        *[F.lag(cents, k).over(w).alias(f"_c{k}") for k in range(1, n)]))
    at = rolled.where(F.col("slot") == clocks.decision)
    in_order = flag((F.col("_slot0") == clocks.decision - (n - 1)) & (F.col("_date0") == F.col("date")))
    return at.select(
        "code", "date", "close_cents", F.lit(0).cast("long").alias("path_00"),
        *[(F.col(f"_c{k}") - F.col("close_cents")).alias(f"path_{k:02d}") for k in range(1, n)],
        "good_bars", (in_order & (F.col("good_bars") == n) & (F.col("close_cents") > 0)).alias("_bars_ok")).join(
        context.select("code", "date", "vp20"), ["code", "date"], "left").select(
        "code", "date", "close_cents", *[f"path_{k:02d}" for k in range(n)], "good_bars",
        (F.col("_bars_ok") & flag(F.col("vp20") > 0)).alias("path_ok"))


# --- day quantities ----------------------------------------------------------------

def day_bars(bars: DataFrame, clocks: Clocks) -> DataFrame:
    """One row per code and day: whole-day bar, clock picks and values up to the decision bar."""
    slot = F.col("slot")
    at = lambda s: F.max(F.when(slot == s, F.col("close")))
    so_far = slot <= clocks.decision
    day = bars.groupBy("code", "date").agg(
        F.min_by("open", "slot").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "slot").alias("close"), F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("bars"),
        at(clocks.decision).alias("q"), at(clocks.back_mid).alias("p_mid"),
        at(clocks.back_short).alias("p_short"), at(clocks.back_long).alias("p_long"),
        F.max(F.when(so_far, F.col("high"))).alias("dh"), F.min(F.when(so_far, F.col("low"))).alias("dl"),
        F.sum(F.when(so_far, F.col("volume"))).alias("dv"),
        F.sum(F.when(so_far, F.col("amount"))).alias("da"))
    decided = F.col("q").isNotNull()
    return day.withColumns({c: F.when(decided, F.col(c)) for c in ("dh", "dl", "dv", "da")})


def code_days() -> Window:
    """A code's days in order. Bounded: one row per calendar day."""
    return Window.partitionBy("code").orderBy("date")


def day_context(day: DataFrame) -> DataFrame:
    """Previous closes, range, volume and volatility of each code's earlier days."""
    w = code_days()
    prior = lambda n: w.rowsBetween(-n, -1)
    full = lambda n, x: F.when(F.count(x).over(prior(n)) == n, x)
    over = lambda fn, x, n: F.when(F.count(x).over(prior(n)) == n, fn(x).over(prior(n)))
    previous = F.lag("close", 1).over(w)
    h, l = F.col("high"), F.col("low")
    with_range = day.withColumns({
        "dcp1": previous, "dcp2": F.lag("close", 2).over(w), "dcp6": F.lag("close", 6).over(w),
        "dcp21": F.lag("close", 21).over(w),
        "true_range": F.when(previous.isNotNull(),
                             F.greatest(h - l, F.abs(h - previous), F.abs(l - previous))),
    })
    return with_range.withColumns({
        "mean_close5": over(F.avg, F.col("close"), 5), "mean_close20": over(F.avg, F.col("close"), 20),
        "pv5": over(F.avg, F.col("volume"), 5),
        "ph20": over(F.max, h, 20), "pl20": over(F.min, l, 20),
        "vp20": ratio(100 * over(F.avg, F.col("true_range"), 20), F.col("dcp1")),
    })


def with_official_close(days: DataFrame, official: DataFrame) -> DataFrame:
    """Adds the official prior close of a (date, code, preclose) table, which on days with a reset is not the last
    close; NULL where the table has none."""
    return days.join(official.select("code", "date", "preclose"), ["code", "date"], "left")


def change(a: Column, b: Column) -> Column:
    """Percent move from b to a."""
    return 100 * (ratio(a, b) - 1)


def day_features(context: DataFrame, clocks: Clocks) -> DataFrame:
    """Features that need only day quantities; ``preclose`` is the day's official prior close."""
    c = F.col
    scaled = lambda x: ratio(x, c("vp20"))
    out = {
        "NA01": scaled(change(c("q"), c("preclose"))),
        "NA02": scaled(change(c("open"), c("preclose"))),
        "NA03": scaled(change(c("q"), c("open"))),
        "A04": c("q"),
        "NA05": scaled(change(c("q"), c("p_mid"))),
        "NA06": scaled(change(c("q"), c("p_short"))),
        "NA07": scaled(change(c("p_mid"), c("p_long"))),
        "ND01": scaled(change(c("dcp1"), c("dcp6"))),
        "ND02": scaled(change(c("dcp1"), c("dcp21"))),
        "ND03": scaled(change(c("q"), c("mean_close5"))),
        "ND04": scaled(change(c("q"), c("mean_close20"))),
        "C01": ratio(100 * (c("q") - c("dl")), F.greatest(c("dh") - c("dl"), F.lit(0.01))),
        "NC02": scaled(ratio(100 * (c("dh") - c("dl")), c("dcp1"))),
        "NC03": scaled(ratio(100 * (c("dh") - c("q")), c("dcp1"))),
        "NC04": scaled(ratio(100 * (F.when(c("q").isNotNull(), F.least(c("open"), c("q"))) - c("dl")), c("dcp1"))),
        "C05": ratio(c("dv"), c("pv5")),
        "C06": c("da") / clocks.money_unit,
        "NC07": scaled(change(c("q"), c("ph20"))),
        "NC08": scaled(change(c("q"), c("pl20"))),
        "V01": c("vp20"),
    }
    return context.withColumns(out)


DAY_FEATURES = ("NA01", "NA02", "NA03", "A04", "NA05", "NA06", "NA07", "ND01", "ND02", "ND03", "ND04",
                "C01", "NC02", "NC03", "NC04", "C05", "C06", "NC07", "NC08", "V01")


def tail_features(bars: DataFrame, clocks: Clocks, chunk_rows: int = 100_000) -> DataFrame:
    """Row-frame quantities read on the decision bar, one row per code and decided day."""
    t, half, burst, noon = clocks.tail, clocks.half_tail, clocks.burst, clocks.afternoon
    w = chunk_window("code")
    lookback = max(2 * t, 2 * half, noon) + 1
    c, h, l, v = (F.col(n) for n in ("close", "high", "low", "volume"))
    chunks = row_chunks(bars.select("code", "date", "slot", "high", "low", "close", "volume", "amount"),
                        "code", "date", ["slot"], lookback, chunk_rows)
    previous = F.lag("close", 1).over(w)
    moved = chunks.withColumns({
        "_up": flag(c > previous),
        "_signed": F.when(c > previous, v).when(c < previous, -v).otherwise(0),
        "_log": F.abs(F.log(ratio(c, previous))),
    })
    vol = rolling_sum(v, t, w)
    money = lambda n: F.sum("amount").over(frame(w, n))
    vwap = lambda n: ratio(money(n), rolling_sum(v, n, w) * clocks.volume_unit)
    low_t, high_t = lowest(l, t, w), highest(h, t, w)
    pairs = F.count("_log").over(frame(w, t)) == t
    rolled = moved.select(
        "code", "date", "slot", "_seq", "_chunk", "_own",
        ratio(vol, rolling_sum(v, t, w, skip=t)).alias("A08"),
        ratio(rolling_sum(v, half, w), rolling_sum(v, half, w, skip=half)).alias("A09"),
        ratio(rolling_sum(v, burst, w) / burst,
              (vol - rolling_sum(v, burst, w)) / (t - burst)).alias("A10"),
        ratio(100 * (c - low_t), F.greatest(high_t - low_t, F.lit(0.01))).alias("A11"),
        (rolling_sum(F.col("amount"), t, w) / clocks.money_unit).alias("A12"),
        change(c, vwap(t)).alias("A13"), change(c, vwap(burst)).alias("A14"),
        ratio(100 * F.when(pairs, F.sum("_signed").over(frame(w, t))), vol).alias("A15"),
        F.when(pairs, 100 * F.count_if(F.col("_up")).over(frame(w, t)) / t).alias("A16"),
        ratio(100 * highest(v, t, w), vol).alias("A17"),
        change(c, highest(h, noon, w)).alias("A18"),
        (100 * (highest(h, noon, w) - lowest(l, noon, w))).alias("_noon_range"),
        F.when(pairs, ratio(100 * F.abs(F.log(ratio(c, F.lag("close", t).over(w)))),
                            F.greatest(F.sum("_log").over(frame(w, t)), F.lit(1e-6)))).alias("A20"),
        vol.alias("tail_volume"))
    return own_rows(rolled).where(F.col("slot") == clocks.decision).drop("slot")


TAIL_FEATURES = ("A08", "A09", "A10", "A11", "A12", "NA13", "NA14", "A15", "A16", "A17", "NA18", "NA19", "A20")


def scale_tail(joined: DataFrame) -> DataFrame:
    """Volatility-scaled forms of the tail features; needs ``vp20`` and ``preclose``."""
    c = F.col
    return joined.withColumns({
        "NA13": ratio(c("A13"), c("vp20")), "NA14": ratio(c("A14"), c("vp20")),
        "NA18": ratio(c("A18"), c("vp20")),
        "NA19": ratio(ratio(c("_noon_range"), c("preclose")), c("vp20")),
    })


def index_days(index_bars: DataFrame, clocks: Clocks) -> DataFrame:
    """One row per date: index close and its value at the four clocks."""
    at = lambda s: F.max(F.when(F.col("slot") == s, F.col("index_close")))
    return index_bars.groupBy("date").agg(
        F.max_by("index_close", "slot").alias("index_day_close"),
        at(clocks.index_decision).alias("ix_decision"), at(clocks.back_mid).alias("ix_mid"),
        at(clocks.back_short).alias("ix_short"), at(clocks.back_long).alias("ix_long"))


INDEX_FEATURES = ("I01", "I02", "I03", "I04", "J01", "J02", "J03", "J04")
RELATIVE_FEATURES = ("R01", "R02", "R03", "R04")


def index_features(days: DataFrame, index_day: DataFrame) -> DataFrame:
    """Index moves aligned with each code's own days, so a suspended code skips the same days."""
    w = code_days()
    joined = days.join(small_by_day(index_day), "date", "left")
    back = lambda k: F.lag("index_day_close", k).over(w)
    before = w.rowsBetween(-20, -1)
    mean20 = F.when(F.count("index_day_close").over(before) == 20, F.avg("index_day_close").over(before))
    c = F.col
    return joined.withColumns({"icp1": back(1), "icp2": back(2), "icp6": back(6), "icp21": back(21),
                               "im20": mean20}).withColumns({
        "I01": change(c("icp1"), c("icp2")), "I02": change(c("icp1"), c("icp6")),
        "I03": change(c("icp1"), c("icp21")), "I04": change(c("icp1"), c("im20")),
        "J01": change(c("ix_decision"), c("icp1")), "J02": change(c("ix_decision"), c("ix_mid")),
        "J03": change(c("ix_decision"), c("ix_short")), "J04": change(c("ix_mid"), c("ix_long")),
    })


def relative_features(days: DataFrame) -> DataFrame:
    """Stock move minus index move over the volatility; needs day and index features."""
    c = F.col
    moves = {"R01": (change(c("q"), c("preclose")), "J01"), "R02": (change(c("q"), c("p_mid")), "J02"),
             "R03": (change(c("q"), c("p_short")), "J03"), "R04": (change(c("p_mid"), c("p_long")), "J04")}
    return days.withColumns({n: ratio(move - c(j), c("V01")) for n, (move, j) in moves.items()})


TURNOVER_FEATURES = ("S01", "S02", "S03")


def turnover_features(days: DataFrame, shares: DataFrame, clocks: Clocks) -> DataFrame:
    """Float value and turnover from the share count of the code's previous day.

    ``days`` must hold every day of a code, so that the lag is the previous day.
    """
    c = F.col
    joined = days.join(shares, ["code", "date"], "left")
    lagged = joined.withColumn("psh", F.lag("float_shares", 1).over(code_days()))
    return lagged.withColumns({
        "S01": F.log(1 + c("psh") * c("q") / clocks.money_unit),
        "S02": ratio(10000 * c("dv"), c("psh")),
        "S03": ratio(10000 * c("tail_volume"), c("psh")),
    })


MORNING_FEATURES = ("AMHD", "AMLD")


def morning_range(bars: DataFrame, clocks: Clocks) -> DataFrame:
    """High and low of the traded morning bars in cents, and whether the morning is complete."""
    slot = F.col("slot")
    inside = slot <= clocks.morning_last
    traded = inside & (F.col("volume") > 0)
    cents = lambda n: F.round(F.col(n) * 100)
    n = clocks.morning_bars
    m = bars.groupBy("code", "date").agg(
        F.count_if(inside).alias("_bars"), F.count_if(inside & (slot >= clocks.morning_first)).alias("_clocks"),
        F.bool_or(slot == clocks.morning_last).alias("_ended"),
        F.count_if(inside & bar_quality()).alias("_good"),
        F.sum(F.when(inside, F.col("volume"))).alias("morning_volume"),
        F.max(F.when(traded, cents("high"))).cast("long").alias("morning_high"),
        F.min(F.when(traded, cents("low"))).cast("long").alias("morning_low"))
    ready = (F.col("_ended") & (F.col("_bars") == n) & (F.col("_clocks") == n) & (F.col("_good") == n)
             & (F.col("morning_volume") > 0) & (F.col("morning_high") > 0) & (F.col("morning_low") > 0))
    return m.select("code", "date", "morning_high", "morning_low", flag(ready).alias("morning_complete"))


def morning_features(days: DataFrame, morning: DataFrame) -> DataFrame:
    c = F.col
    cents = F.round(c("q") * 100)
    joined = days.join(morning, ["code", "date"], "left")
    ready = flag(c("morning_complete") & (cents > 0) & (c("vp20") > 0))
    value = lambda edge: F.when(ready, ratio(change(cents, c(edge)), c("vp20")))
    return joined.withColumns({"AMHD": value("morning_high"), "AMLD": value("morning_low")})


ALL_FEATURES = (DAY_FEATURES + TAIL_FEATURES + INDEX_FEATURES + RELATIVE_FEATURES
                + TURNOVER_FEATURES + MORNING_FEATURES)


def feature_table(bars: DataFrame, index_bars: DataFrame, shares: DataFrame, official: DataFrame, clocks: Clocks) -> DataFrame:
    """All fifty features on every decided code-day, with the clock guard. ``official``: date, code, preclose."""
    days = day_features(with_official_close(day_context(day_bars(bars, clocks)), official), clocks)
    days = days.join(tail_features(bars, clocks), ["code", "date"], "left")
    days = scale_tail(days)
    days = relative_features(index_features(days, index_days(index_bars, clocks)))
    days = turnover_features(days, shares, clocks)
    days = morning_features(days, morning_range(bars, clocks))
    days = days.join(clock_guard(bars, clocks).select("code", "date", "clock_ok"), ["code", "date"], "left")
    complete = F.lit(True)
    for name in ALL_FEATURES:
        complete = complete & F.col(name).isNotNull()
    return days.where(F.col("q").isNotNull()).select(
        "date", "code", *ALL_FEATURES, "clock_ok", (F.col("clock_ok") & complete).alias("formula_input_valid"))


# --- candidate universe ------------------------------------------------------------

def candidates(stocks: DataFrame, excluded_prefixes: Sequence[str], marker: str,
               growth_members: DataFrame | None = None) -> DataFrame:
    """Drop marked names, excluded code prefixes, growth-board members and codes without volume.

    ``stocks`` carries ``name``, ``code``, ``day_open`` and ``day_volume``.
    """
    keep = ~F.col("name").contains(marker) & (F.col("day_open") > 0) & (F.col("day_volume") > 0)
    for prefix in excluded_prefixes:
        keep = keep & ~F.col("code").startswith(prefix)
    out = stocks.where(keep)
    return out if growth_members is None else out.join(growth_members, "code", "left_anti")
