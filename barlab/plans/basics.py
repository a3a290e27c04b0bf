"""Queries for scans, filters, joins, aggregates, windows, scalars and contracts."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from barlab.functions import scalars as s
from barlab.operators import contracts
from barlab.operators.bars import candidates
from barlab.operators.grouping import frame_difference, small_by_day, with_day_stats
from barlab.plans.output import tidied
from barlab.plans.views import stock_days, table
from barlab.session import shared_path
from barlab.sources import tables as src


def scan_columns(spark, sf):
    """Named columns, a computed one, a renamed one and a dropped one."""
    li = src.scan(spark, f"{sf}/lineitem.parquet",
                  ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    priced = li.withColumn("gross", F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long"))
    return priced.withColumnRenamed("l_quantity", "quantity").drop("l_extendedprice")


def date_range_scan(spark, sf):
    """Row filter on dates that reaches the reader, then comparisons and a year filter."""
    o = src.scan(spark, f"{sf}/orders.parquet", None, "1996-03-01", "1998-09-01", date="o_orderdate")
    d = F.to_date("o_orderdate")
    keep = (F.year(d) == 1997) & F.month(d).between(2, 11) & (F.col("o_totalprice") >= 1000)
    return o.where(keep & ~(F.col("o_orderstatus") == "P")).select("o_orderkey", d.alias("date"), "o_totalprice")


def sql_scan(spark, sf):
    """Parameterised SQL over a Parquet path with a chain of common table expressions."""
    return tidied(src.sql_scan(spark, f"{sf}/orders.parquet", """
        WITH picked AS (
          SELECT o_custkey, o_totalprice FROM {source}
          WHERE o_orderdate >= CAST(:first AS TIMESTAMP_NTZ) AND o_orderdate < CAST(:end AS TIMESTAMP_NTZ)),
        per_customer AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM picked GROUP BY o_custkey)
        SELECT n, count(*) AS customers, max(top) AS top FROM per_customer GROUP BY n
        """, first="1997-01-01", end="1999-01-01"))


def view_chain(spark, sf):
    """A file view, a frame view, and a view over a query, read back by SQL."""
    src.as_view(table(spark, sf, "orders"), "barlab_orders")
    src.as_view(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "barlab_customers")
    src.as_view(spark.sql("""SELECT c_mktsegment, year(o_orderdate) AS year, o_totalprice
                             FROM barlab_orders JOIN barlab_customers ON o_custkey = c_custkey"""), "barlab_sales")
    return spark.sql("""SELECT c_mktsegment, year, count(*) AS orders, max(o_totalprice) AS top,
                        count(*) FILTER (WHERE o_totalprice > 250000) AS large
                        FROM barlab_sales GROUP BY c_mktsegment, year""")


PERIOD_SOURCES = (("1990-01-01", "1997-01-01"), ("1997-01-01", "1998-07-01"), ("1998-07-01", "2020-01-01"))


def multi_period_scan(spark, sf):
    parts = [{"file": f"{sf}/lineitem.parquet", "first": a, "end": b} for a, b in PERIOD_SOURCES]
    rows = src.multi_period(spark, parts, ["l_suppkey", "l_shipdate", "l_quantity"], date="l_shipdate")
    return rows.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("decimal(14,2)")).cast("double").alias("quantity"))


def _month(day):
    return F.date_format(day, "'m'yyyyMM")


def months_on_disk(spark, sf):
    """The lines, written with one folder per month of shipping and read back."""
    rows = table(spark, sf, "lineitem").select(
        _month(F.col("l_shipdate")).alias("month"), F.to_date("l_shipdate").alias("shipped"), "l_orderkey", "l_linenumber",
        F.col("l_quantity").cast("decimal(14,2)").alias("quantity"))
    path = shared_path(spark, "months")
    src.write_partitioned(rows, path, "month")
    return src.scan(spark, path)


def busy_months(spark, sf):
    """Months with at least 17 percent urgent orders, as a table that is known only when the query runs."""
    by_month = table(spark, sf, "orders").groupBy(_month(F.to_date("o_orderdate")).alias("month")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("_u"))
    return by_month.where("_u * 100 >= _n * 17").select("month")


def partitioned_round_trip(spark, sf):
    """Lines of the busy months, read from their folders only, each file's folder checked against what it holds."""
    lines = months_on_disk(spark, sf).withColumn("_off", src.misplaced("month", _month(F.col("shipped"))))
    return lines.join(busy_months(spark, sf), "month").groupBy("month").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").cast("double").alias("quantity"), F.count_if("_off").alias("misplaced"))


def _extracts(spark, sf):
    rows = stock_days(spark, sf).select("date", "code", "half", "known15", "opportunity15")
    return rows.where("date < date'1998-01-01'"), rows.where("date >= date'1996-01-01'")


def stitch_sources(spark, sf):
    older, newer = _extracts(spark, sf)
    return src.stitch(older, newer, "1996-01-01", "1998-01-01")


def overlap_check(spark, sf):
    older, newer = _extracts(spark, sf)
    changed = newer.withColumn("opportunity15", F.when(F.col("code") % 100 == 7, 0.5).otherwise(F.col("opportunity15")))
    a = src.overlap_check(older, newer, "1996-01-01", "1998-01-01")
    b = src.overlap_check(older, changed, "1996-01-01", "1998-01-01")
    return a.unionByName(b.withColumn("check", F.lit("overlap_changed")))


def frame_surplus(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus")
    a = li.where("l_returnflag <> 'N'")
    b = li.where("l_linestatus = 'F'")
    return frame_difference(a, b)


def membership_filter(spark, sf):
    """A short list as isin, a large set as a semi join on its days."""
    rows = stock_days(spark, sf)
    busy = rows.where("score >= 49").select("date").distinct()
    return rows.where(F.col("board").isin("main", "star")).join(
        small_by_day(busy), "date", "left_semi").select("date", "code", "board")


def null_handling(spark, sf):
    """Masked values, finite tests and NaN turned into NULL."""
    o = table(spark, sf, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    raw = o.select(k, (F.when(k % 5 == 0, F.lit(float("nan"))).when(k % 7 == 0, F.lit(float("inf")))
                       .when(k % 3 != 0, price)).alias("value"),
                   F.when(price > 250000, price).alias("masked"))
    seen = raw.withColumns({"is_finite": s.finite(F.col("value")), "is_missing": F.col("value").isNull()})
    clean = s.nan_to_null(seen)
    return clean.select("o_orderkey", "is_finite", "is_missing",
                        F.when(s.finite(F.col("value")), F.col("value")).alias("clean_value"),
                        F.coalesce(F.when(F.col("is_finite"), F.col("value")), F.lit(-1.0)).alias("filled"), "masked")


def candidate_filter(spark, sf):
    """Name, prefix, board-membership and inactivity exclusions over customers with their order volume."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    traded = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("day_volume"), F.max("o_totalprice").alias("day_open"))
    stocks = c.join(traded, "c_custkey", "left").select(
        F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("code"),
        F.concat_ws(" ", "c_mktsegment", "c_name").alias("name"),
        F.coalesce("day_open", F.lit(0.0)).alias("day_open"), F.coalesce("day_volume", F.lit(0)).alias("day_volume"))
    growth = c.where("c_nationkey = 3").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("code"))
    return candidates(stocks, ["00009", "0001", "013"], "BUILD", growth)


def left_join_lines(spark, sf):
    """Orders keep their row when they have no lines; order lines are unique per key after grouping."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.max("l_quantity").alias("largest"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").select(
        "o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), "largest")


def one_to_one_join(spark, sf):
    """Inner join that refuses repeated keys, and its carried-attribute check."""
    rows = stock_days(spark, sf)
    a = rows.select("date", "code", "half", F.col("decision_shares").alias("left_shares"))
    b = rows.where("known15").select("date", "code", F.col("decision_shares").alias("right_shares"))
    joined = contracts.one_to_one(a, b, ["date", "code"])
    return joined.groupBy("half").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("left_shares") == F.col("right_shares")).alias("carried_equal"))


def keyed_lookup(spark, sf):
    """Per-day lookup with a default for days without a value."""
    rows = stock_days(spark, sf)
    hits = rows.where("score >= 48").groupBy("date").agg(F.count(F.lit(1)).alias("hits"))
    days = rows.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))
    return days.join(small_by_day(hits), "date", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def filtered_counts(spark, sf):
    """Counts, filtered counts and means, safe rates and distinct days per half."""
    rows = stock_days(spark, sf)
    out = rows.groupBy("half").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("known15").alias("known"),
        F.count_if(F.col("known15") & (F.col("opportunity15") == 1)).alias("success"),
        F.avg(F.when(F.col("known15"), F.col("mark_0959_return15"))).alias("mean_mark"),
        F.countDistinct("date").alias("days"),
        F.count_if(F.col("score") > 1000).alias("never"))
    return tidied(out.withColumns({"rate": s.ratio(F.col("success"), F.col("known")),
                                   "undefined_rate": s.ratio(F.col("success"), F.col("never"))}))


def table_extent(spark, sf):
    return stock_days(spark, sf).agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min("code").alias("first_code"), F.count_if("formula_input_valid").alias("valid"))


def flag_aggregates(spark, sf):
    return stock_days(spark, sf).groupBy("date").agg(
        F.bool_or("known_unfilled").alias("any_unfilled"), F.bool_and("known15").alias("all_known"),
        F.bool_and(F.col("opportunity15") == 1).alias("all_success"))


def extreme_rows(spark, sf):
    """Keys of the smallest and largest value per half, ties settled by key."""
    low = F.struct("strength", "code")
    return stock_days(spark, sf).groupBy("half").agg(
        F.min_by("code", low).alias("lowest_code"), F.max_by("code", low).alias("highest_code"),
        F.min("strength").alias("lowest"), F.max("strength").alias("highest"))


def list_sizes(spark, sf):
    """Daily sizes of a list with their median and maximum per year."""
    sizes = stock_days(spark, sf).where("`left`").groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return tidied(sizes.groupBy(F.year("date").alias("year")).agg(
        F.median("n").alias("median_daily"), F.max("n").alias("max_daily"), F.sum("n").alias("rows")))


def centred_values(spark, sf):
    """Value minus its day mean, the day weight and the share of the day total."""
    rows = stock_days(spark, sf).select("date", "code", "score")
    out = with_day_stats(rows, F.avg("score").alias("_mean"), F.count(F.lit(1)).alias("_n"), F.sum("score").alias("_sum"))
    return tidied(out.select(
        "date", "code", (F.col("score") - F.col("_mean")).alias("centred"),
        (1 / F.col("_n")).alias("weight"), s.ratio(F.col("score"), F.col("_sum")).alias("share")))


def lagged_rows(spark, sf):
    """Previous value, previous flag with a default, and rolling statistics of the rows before.

    Days are the rows here, one per supplier and date, so a supplier's window is bounded.
    """
    d = table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date")).agg(
        F.sum(F.col("l_quantity").cast("decimal(14,2)")).cast("double").alias("quantity"),
        F.bool_or(F.col("l_returnflag") != "R").alias("returned"))
    w = Window.partitionBy("code").orderBy("date")
    prior = w.rowsBetween(-20, -1)
    full = F.count("quantity").over(prior) == 20
    return tidied(d.select(
        "code", "date", F.lag("quantity").over(w).alias("previous"),
        F.lag("returned", 1, False).over(w).alias("previous_returned"),
        F.count("quantity").over(prior).alias("prior_count"),
        F.when(full, F.sum("quantity").over(prior)).alias("prior_sum"),
        F.when(full, F.avg("quantity").over(prior)).alias("prior_mean"),
        ((F.count(F.lit(1)).over(w.rowsBetween(-21, -1)) == 21)
         & (F.count_if("returned").over(w.rowsBetween(-21, -1)) == 21)).alias("all_returned")))


def scalar_functions(spark, sf):
    """Every scalar function of the pipeline on each order."""
    o = table(spark, sf, "orders")
    d, p, k = F.to_date("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey")
    signed = (k % 200 - 100) / 8
    text = F.when(k % 10 == 0, F.concat(F.year(d).cast("string"), F.lit("-02-30"))).when(
        k % 10 == 1, F.date_format(d, "yyyy/MM/dd")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    code = F.concat(F.when(k % 2 == 0, "sh").otherwise("sz"), F.lit("."), F.lpad(k.cast("string"), 8, "0"))
    return tidied(o.select(
        k.alias("k"), F.floor(p / 1000).cast("int").alias("thousands"),
        F.greatest(F.least(signed, F.lit(5.0)), F.lit(-5.0)).alias("clipped"),
        F.abs(signed).alias("magnitude"), s.on_cent_grid(p).alias("on_grid"),
        s.row_max(signed, F.lit(0.0), F.when(k % 3 == 0, F.lit(9.0))).alias("row_max"),
        s.finite(s.ratio(p, signed)).alias("finite_ratio"),
        F.when(signed > 0, "up").when(signed < 0, "down").otherwise("flat").alias("direction"),
        F.coalesce(F.nullif(k % 4, F.lit(0).cast("long")), F.lit(-1).cast("long")).alias("nonzero"),
        (signed > 0).cast("int").alias("is_up"), (F.lit(1e-6) + F.lit(0.05) * signed).alias("linear"),
        F.year(d).alias("year"), F.month(d).alias("month"), s.half_of(d).alias("half"), s.quarter_of(d).alias("quarter"),
        s.week_of(d).alias("week"), F.weekofyear(d).alias("iso_week"), F.extract(F.lit("YEAROFWEEK"), d).alias("iso_year"),
        s.valid_iso_date(text).alias("iso_text"), F.lower("o_orderpriority").alias("folded"),
        F.replace(code, F.lit("."), F.lit("_")).alias("file_code"), code.startswith("sh.0000").alias("prefixed"),
        F.col("o_orderpriority").contains("IGH").alias("contained"), F.log(1 + p).alias("log_price")), 8)


def dense_codes(spark, sf):
    """Values replaced by their position among the distinct ones."""
    days = stock_days(spark, sf).select("date").distinct()
    coded = days.withColumn("day_code", F.dense_rank().over(Window.orderBy("date")) - 1)
    rows = stock_days(spark, sf).select("date", "code")
    return rows.join(small_by_day(coded), "date").select("code", "day_code")


def key_gate(spark, sf):
    """Contracts of stock-days and of order lines, one row per check."""
    rows = stock_days(spark, sf)
    checks = contracts.row_checks(rows, {
        "domain_binary": contracts.in_domain("opportunity15", [0.0, 1.0], F.col("known15")),
        "domain_board": contracts.in_domain("board", ["main"]),
        "date_bounds": contracts.within_dates("1995-01-01", "1998-01-01"),
        "finite_when_known": contracts.finite_when("mark_0959_return15", F.col("known15")),
        "states_exclusive": ~(F.col("known15") & F.col("known_unfilled")),
    })
    lines = table(spark, sf, "lineitem")
    counts = contracts.count_check(rows, {
        "declared_valid": (F.col("formula_input_valid"), 13000), "declared_rows": (F.lit(True), 15000)})
    return (checks.unionByName(contracts.key_check(rows, name="stock_day_key"))
            .unionByName(contracts.key_check(lines, ["l_orderkey", "l_linenumber"], "line_key"))
            .unionByName(counts))


def count_identity(spark, sf):
    """known = available + missing on every day."""
    from barlab.operators.evaluation import daily_coverage

    daily = daily_coverage(stock_days(spark, sf))
    return contracts.row_checks(daily, {
        "known_is_available_plus_missing": F.col("known") == F.col("reference_available") + F.col("reference_missing"),
        "known_within_rows": F.col("known") <= F.col("rows")})


def frame_equality(spark, sf):
    """Exact and tolerant frame comparison, with and without a changed value."""
    a = stock_days(spark, sf).select("date", "code", "mark_0959_return15")
    b = a.withColumn("mark_0959_return15", F.col("mark_0959_return15") + 1e-13)
    c = a.withColumn("mark_0959_return15", F.when(F.col("code") % 500 == 3, 1.0).otherwise(F.col("mark_0959_return15")))
    keys, value = ["date", "code"], ["mark_0959_return15"]
    return (contracts.equality_check(a, a, "exact_same")
            .unionByName(contracts.equality_check(a, c, "exact_changed"))
            .unionByName(contracts.tolerance_check(a, b, keys, value, 2e-12, "close_same"))
            .unionByName(contracts.tolerance_check(a, c, keys, value, 2e-12, "close_changed")))


def ordered_output(spark, sf):
    """Canonical output order by day and key."""
    return stock_days(spark, sf).select("date", "code", "half").orderBy("date", "code")


QUERIES = {f.__name__: f for f in (
    scan_columns, date_range_scan, sql_scan, view_chain, multi_period_scan, partitioned_round_trip, stitch_sources, overlap_check,
    frame_surplus, membership_filter, null_handling, candidate_filter, left_join_lines, one_to_one_join,
    keyed_lookup, filtered_counts, table_extent, flag_aggregates, extreme_rows, list_sizes, centred_values,
    lagged_rows, scalar_functions, dense_codes, key_gate, count_identity, frame_equality, ordered_output)}
