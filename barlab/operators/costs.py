"""Round-trip costs with dated fee schedules, and labels at several cost levels in one pass over the watch window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.functions.scalars import finite, flag, ratio
from barlab.operators.labels import ADVERSE_MOVE, MIN_SLIPPAGE, RUN_LENGTH, SPACE_MOVE, first_run, strictly_before

COSTS = (5, 15)


@dataclass(frozen=True)
class Fee:
    """What a market charges from a day on: a share of the money on each side, and a least amount per side."""

    market: str
    valid_from: str
    buy_rate: float
    sell_rate: float
    minimum: float


def fee_table(spark: SparkSession, fees: Sequence[Fee]) -> DataFrame:
    """(market, valid_from, valid_to, rates): periods end where the next one of their market starts."""
    rows = spark.createDataFrame([astuple(f) for f in fees], "market string, valid_from string, buy_rate double, sell_rate double, minimum double")
    after = Window.partitionBy("market").orderBy("valid_from")
    return rows.withColumn("valid_from", F.col("valid_from").cast("date")).withColumn("valid_to", F.lead("valid_from").over(after))


def with_fees(trades: DataFrame, fees: Sequence[Fee], day: str, side: str) -> DataFrame:
    """Add ``<side>_rate`` and ``<side>_minimum`` as they held on ``day``, NULL before a market's first schedule.

    An as-of join on (market, valid_from). The schedule is part of the configuration, a few rows given as a list, so
    it is sent to every task and markets of any size stay where they are.
    """
    table = fee_table(trades.sparkSession, fees).select(
        F.col("market").alias("_market"), "valid_from", "valid_to", F.col(f"{side}_rate"), F.col("minimum").alias(f"{side}_minimum"))
    valid = (F.col("market") == F.col("_market")) & (F.col(day) >= F.col("valid_from")) & (
        F.col("valid_to").isNull() | (F.col(day) < F.col("valid_to")))
    return trades.join(F.broadcast(table), valid, "left").drop("_market", "valid_from", "valid_to")


def stress(price: Column, bps: float) -> Column:
    return F.greatest(price * (bps / 10_000), F.lit(MIN_SLIPPAGE))


def round_trip(entries: DataFrame, fees: Sequence[Fee], costs: Sequence[int] = COSTS) -> DataFrame:
    """Add ``entry_state`` and, per cost level, ``cost<b>`` (money paid) and ``break_even<b>``.

    ``entries``: market, date, next_date, entry_price, decision_shares, capacity. Buying pays the price with stress and
    the fee of the entry day; selling at a quote yields the quote less stress and the fee of the exit day. ``break_even``
    is the quote at which both sides cancel. An entry without shares or price is ``none``; one beyond the capacity
    is ``unfilled``: known not to trade. Neither has costs.
    """
    out = with_fees(with_fees(entries, fees, "date", "buy"), fees, "next_date", "sell")
    shares = F.col("decision_shares")
    some = flag(finite(F.col("entry_price")) & (F.col("entry_price") > 0) & (shares > 0))
    state = F.when(~some, "none").when(~flag(shares <= F.col("capacity")), "unfilled").otherwise("filled")
    out = out.withColumn("entry_state", state)
    for b in costs:
        money = shares * (F.col("entry_price") + stress(F.col("entry_price"), b))
        cost = money + F.greatest(F.col("buy_rate") * money, F.col("buy_minimum"))
        # Selling yields shares * x - max(rate * shares * x, minimum): x must cover the cost in both cases.
        needed = F.greatest(ratio(F.col(f"cost{b}") + F.col("sell_minimum"), shares), ratio(F.col(f"cost{b}"), shares * (1 - F.col("sell_rate"))))
        quote = F.greatest(needed + MIN_SLIPPAGE, needed / (1 - b / 10_000))
        charged = flag(F.col("entry_state") == "filled") & F.col("buy_rate").isNotNull() & F.col("sell_rate").isNotNull()
        out = out.withColumn(f"cost{b}", F.when(charged, cost)).withColumn(f"break_even{b}", F.when(charged, quote))
    return out.drop("buy_rate", "sell_rate", "buy_minimum", "sell_minimum")


def labels_at_costs(watched: DataFrame, expected_bars: int, costs: Sequence[int] = COSTS) -> DataFrame:
    """One row per entry in the form the daily statistics read, every cost level from one pass over the window.

    ``watched``: the bars of the window with what ``round_trip`` added, one row without offset for an entry that has none. A filled entry is known when the whole window was
    seen and its costs are known, and known in the sensitive view when every bar of it also traded. An unfilled
    entry is known not to trade. Run states of all levels share one sort.
    """
    w = Window.partitionBy("code", "date").orderBy("offset")
    active = F.col("volume") > 0
    adverse = F.col("low") <= F.col("entry_price") * (1 - ADVERSE_MOVE)
    states = [F.when(adverse, F.col("offset")).alias("_bad")]
    for b in costs:
        good = active & flag(F.col("close") > F.col(f"break_even{b}"))
        space = active & flag(F.col("close") > F.col(f"break_even{b}") * (1 + SPACE_MOVE))
        states += [first_run(w, good, F.col("offset"), RUN_LENGTH).alias(f"_pos{b}"), first_run(w, space, F.col("offset"), RUN_LENGTH).alias(f"_space{b}"),
                   F.when(good, 1).otherwise(0).alias(f"_any{b}")]
    keep = ["date", "code", "next_date", "market", "entry_state", "decision_shares"]
    fixed = ["entry_price", *[f"break_even{b}" for b in costs]]
    marked = watched.select(*keep, *fixed, "offset", "low", "close", "volume", *states)
    never = lambda c: F.coalesce(F.min(c), F.lit(-1)).cast("int")
    out = marked.groupBy(*keep).agg(
        F.count("offset").alias("seen_bars"), F.count_if(active).alias("_active"), F.count_if(finite(F.col("low"))).alias("_lows"),
        never("_bad").alias("_bad"), F.max_by("close", "offset").alias("_last"), F.min("low").alias("_low"), *[F.max(c).alias(c) for c in fixed],
        *[f(c).alias(c) for b in costs for f, c in ((never, f"_pos{b}"), (never, f"_space{b}"), (F.max, f"_any{b}"))])
    columns = []
    for b in costs:
        known = (F.col("seen_bars") == expected_bars) & (F.col("entry_state") == "filled") & F.col(f"break_even{b}").isNotNull()
        pos, space, bad = F.col(f"_pos{b}"), F.col(f"_space{b}"), F.col("_bad")
        told = lambda c, known=known: F.when(known, F.when(c, 1.0).otherwise(0.0))
        columns += [
            known.alias(f"known{b}"), (known & (F.col("_active") == expected_bars)).alias(f"sensitive_known{b}"),
            told(pos >= 0).alias(f"opportunity{b}"), told(space >= 0).alias(f"one_percent{b}"), told(F.col(f"_any{b}") == 1).alias(f"any_opportunity{b}"),
            told(F.col("_lows") == expected_bars).alias(f"risk_observed{b}"),
            F.when(known, pos).alias(f"first_positive_end{b}"), F.when(known, bad).alias(f"first_bad3{b}"),
            told(strictly_before(pos, bad)).alias(f"positive_before_bad3{b}"), told(strictly_before(space, bad)).alias(f"space_before_bad3{b}"),
            F.when(known, ratio(F.col("_last"), F.col(f"break_even{b}")) - 1).alias(f"mark_0959_return{b}"),
            F.when(known, ratio(F.col("_low"), F.col("entry_price")) - 1).alias(f"adverse_return{b}")]
    return out.select("date", "code", "next_date", "market", "decision_shares", "seen_bars", (F.col("entry_state") == "unfilled").alias("known_unfilled"), *columns)
