"""Driver tables reshaped to the tables of the research pipeline."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.functions.scalars import half_of
from barlab.operators.bars import Clocks
from barlab.operators.compare import union_lists
from barlab.operators.labels import strictly_before
from barlab.session import tune


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stock_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, shaped like a labelled stock-day: keys, flags and outcomes at two costs."""
    o = table(spark, sf_dir, "orders").withColumn("date", F.to_date("o_orderdate"))
    k, price, pending = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderstatus") == "P"
    known15 = ~pending
    known5 = known15 | (pending & (k % 6 == 1))
    first_pos = (k % 30 - 1).cast("int")
    first_bad = (F.floor(price).cast("long") % 30 - 1).cast("int")

    def outcome(known, hit):
        return F.when(known, F.when(hit, 1.0).otherwise(0.0))

    o = o.select(
        "date", k.alias("code"), half_of(F.col("date")).alias("half"),
        F.when(F.col("o_custkey") % 4 == 0, "growth").otherwise("main").alias("board"),
        ((k % 9 + 1) * 100).alias("decision_shares"),
        (k % 9 != 0).alias("formula_input_valid"),
        F.date_add("date", (k % 5 + 1).cast("int")).alias("next_date"),
        known5.alias("known5"), known15.alias("known15"),
        (known5 & (k % 7 != 0)).alias("sensitive_known5"),
        (known15 & (k % 7 != 0)).alias("sensitive_known15"),
        (pending & (k % 3 == 0)).alias("known_unfilled"),
        outcome(known5, price > 200000).alias("opportunity5"),
        outcome(known15, price > 250000).alias("opportunity15"),
        outcome(known5, price > 300000).alias("one_percent5"),
        outcome(known15, price > 350000).alias("one_percent15"),
        outcome(known5, price > 180000).alias("any_opportunity5"),
        outcome(known15, price > 220000).alias("any_opportunity15"),
        F.when(known5 & (k % 11 != 0), (k % 41 - 18) / 1000).alias("mark_0959_return5"),
        F.when(known15 & (k % 11 != 0), (k % 41 - 20) / 1000).alias("mark_0959_return15"),
        F.when(known5, -(k % 53) / 1000).alias("adverse_return5"),
        F.when(known15, -(k % 53) / 1000).alias("adverse_return15"),
        F.when(known5, F.when(first_pos > 0, first_pos - 1).otherwise(first_pos)).alias("first_positive_end5"),
        F.when(known15, first_pos).alias("first_positive_end15"),
        F.when(known5, first_bad).alias("first_bad35"),
        F.when(known15, first_bad).alias("first_bad315"),
        outcome(known5, k % 13 != 0).alias("risk_observed5"),
        outcome(known15, k % 13 != 0).alias("risk_observed15"),
        F.floor(price / 10000).cast("int").alias("score"), price.alias("strength"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("left"),
        (k % 2 == 0).alias("right"),
    )
    return o


def ordered_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock-days with the outcome of each event against the first adverse quote."""
    rows = stock_days(spark, sf_dir)
    out = {}
    for bps in (5, 15):
        known, end, bad = F.col(f"known{bps}"), F.col(f"first_positive_end{bps}"), F.col(f"first_bad3{bps}")
        space_end = F.when((F.col(f"one_percent{bps}") == 1) & (end >= 0), F.least(end + 2, F.lit(28))).otherwise(-1)
        out[f"positive_before_bad3{bps}"] = F.when(known, strictly_before(end, bad).cast("double"))
        out[f"space_before_bad3{bps}"] = F.when(known, strictly_before(space_end, bad).cast("double"))
    return rows.withColumns(out)


LEFT_LIST = "`left` and decision_shares >= 700"
RIGHT_LIST = "`right` and decision_shares >= 700"


def two_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two selection lists with their ordered labels."""
    rows = ordered_days(spark, sf_dir)
    lists = union_lists(rows.where(LEFT_LIST), rows.where(RIGHT_LIST), ("date", "code"))
    return lists.join(rows.drop("left", "right"), ["date", "code"])


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price bars per supplier, with suspensions, gaps and reference resets."""
    li = table(spark, sf_dir, "lineitem")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    cents = lambda x: F.floor(x * 100 + 0.5) / 100
    money = lambda c: F.sum(F.col(c).cast("decimal(14,2)")).cast("double")
    bars = li.groupBy(F.to_date("l_shipdate").alias("date"), F.col("l_suppkey").alias("code")).agg(
        cents(money("l_extendedprice") / money("l_quantity")).alias("close"),
        cents(F.max(unit)).alias("high"), cents(F.min(unit)).alias("low"),
        money("l_quantity").cast("long").alias("volume"))
    dom = F.dayofmonth("date")
    previous = F.lag("close").over(Window.partitionBy("code").orderBy("date"))
    return bars.select(
        "date", "code", cents((F.col("high") + F.col("low")) / 2).alias("open"),
        "high", "low", "close", "volume",
        F.when((F.col("code") % 13 == 0) & (dom == 7), None)
        .when((F.col("code") + dom) % 29 == 0, previous * 0.9).otherwise(previous).alias("preclose"),
        F.when((dom + F.col("code")) % 17 == 0, 0).otherwise(1).alias("tradestatus"),
        F.lit(3).alias("adjustflag"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday bars per event type, one bar per hour that has events."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(
        F.col("event_type").alias("code"), F.to_date("ts").alias("date"), F.hour("ts").alias("slot"),
    ).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"),
        F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
        F.count(F.lit(1)).alias("volume"),
        F.sum(F.col("value").cast("decimal(14,2)")).cast("double").alias("amount"))


# Hourly stand-ins for the minute clocks: slot 14 is the decision bar.
HOURLY = Clocks(
    decision=14, back_long=9, back_mid=11, back_short=12,
    tail=5, half_tail=3, burst=2, afternoon=8, path=6,
    index_decision=13, morning_first=0, morning_last=5, morning_bars=6,
    session_first=8, session=(8, 9, 10, 11, 12, 13), entry_slots=(15, 16, 17, 18),
    watch_first=9, watch_last=20, volume_unit=1, money_unit=1000.0,
)


def monthly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that grow with the data: a supplier is a code, a month a day, five days of it a bar."""
    li = table(spark, sf_dir, "lineitem")
    day, unit = F.to_date("l_shipdate"), F.floor(F.col("l_extendedprice") / F.col("l_quantity") + 0.5) / 100
    order = F.struct(day, "l_orderkey", "l_linenumber")
    return li.groupBy(
        F.col("l_suppkey").alias("code"), F.trunc(day, "month").alias("date"),
        F.least(F.floor((F.dayofmonth(day) - 1) / 5), F.lit(5)).cast("int").alias("slot"),
    ).agg(
        F.min_by(unit, order).alias("open"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.max_by(unit, order).alias("close"),
        (F.sum(F.col("l_quantity").cast("long")) * 1000).alias("volume"),
        (F.sum((unit * F.col("l_quantity")).cast("decimal(18,2)")) * 1000).cast("double").alias("amount"))


# A month as a trading day: decided on the fifth bar, bought on the last, watched over the next month's first four.
MONTHLY = replace(HOURLY, decision=4, entry_slots=(5,), watch_first=0, watch_last=3)


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index close per bar: amount-weighted price over all codes."""
    b = bars(spark, sf_dir)
    return b.groupBy("date", "slot").agg((F.sum("amount") / F.sum("volume")).alias("index_close"))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share count per code and day, derived from the day number and the length of the code."""
    days = bars(spark, sf_dir).select("code", "date").distinct()
    return days.withColumn(
        "float_shares",
        (F.lit(100000) + F.dayofmonth("date") * 100 + F.length("code") * 7).cast("double"))


FEATURES = ("F1", "F2", "F3", "F4", "F5", "F6")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model inputs per supplier-day on a scale of about -1 to 1, some rows invalid."""
    li = table(spark, sf_dir, "lineitem")
    total = lambda c: F.sum(F.col(c).cast("decimal(14,2)")).cast("double")
    n = F.count(F.lit(1))
    g = li.groupBy(F.to_date("l_shipdate").alias("date"), F.col("l_suppkey").alias("code")).agg(
        (total("l_quantity") / n / 25 - 1).alias("F1"),
        (total("l_extendedprice") / n / 50000 - 1).alias("F2"),
        (total("l_discount") / n * 20 - 1).alias("F3"),
        (total("l_tax") / n * 25 - 1).alias("F4"),
        (F.count_if(F.col("l_returnflag") == "R") / n).alias("F5"),
        (F.sum("l_linenumber") / n / 4 - 1).alias("F6"),
        F.count_if(F.col("l_linestatus") == "F").alias("_f"), n.alias("_n"),
        F.sum("l_orderkey").alias("_k"))
    valid = (F.col("_k") % 10) != 0
    return g.select(
        "date", "code", half_of(F.col("date")).alias("half"), valid.alias("formula_input_valid"),
        *[F.when(valid | (F.lit(i) % 2 == 0), F.col(c)).alias(c) for i, c in enumerate(FEATURES)],
        F.date_add("date", (F.col("_k") % 4 + 1).cast("int")).alias("next_date"),
        ((F.col("_k") % 11) != 0).alias("known15"),
        F.when((F.col("_k") % 11) != 0, F.when(F.col("F1") + F.col("F3") > 0, 1.0).otherwise(0.0))
        .alias("opportunity15"))
