"""Queries over labelled stock-days: labels, lists, statistics and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions.scalars import explode_periods, in_period, year_of
from barlab.operators import compare, evaluation, labels, ranking, selection
from barlab.operators.bootstrap import block_intervals
from barlab.operators.grouping import exact_quantiles
from barlab.plans.output import tidied
from barlab.plans.views import LEFT_LIST, RIGHT_LIST, ordered_days, stock_days, two_lists

SELECTED = "`left` and decision_shares >= 800"
FOLDS = labels.half_year_folds(1997, 1998)


def selected_days(spark, sf):
    return ordered_days(spark, sf).withColumn("selected", F.expr(SELECTED))


STUDY = ("1995-01-01", "1999-07-01")


def _spine(spark, kinds=("half", "year"), keys=None):
    return evaluation.period_spine(spark, *STUDY, keys, kinds)


def daily_opportunity(spark: SparkSession, sf: str) -> DataFrame:
    return tidied(evaluation.daily_opportunity(stock_days(spark, sf)))


def period_opportunity(spark, sf):
    daily = evaluation.daily_opportunity(stock_days(spark, sf))
    kinds = ("half", "quarter", "year")
    return tidied(evaluation.opportunity_periods(daily, kinds=kinds, spine=_spine(spark, kinds)))


def ordered_summary(spark, sf):
    return tidied(evaluation.daily_ordered(ordered_days(spark, sf)))


def ordered_periods(spark, sf):
    return tidied(evaluation.ordered_periods(evaluation.daily_ordered(ordered_days(spark, sf)), spine=_spine(spark)))


def arm_summary(spark, sf):
    return tidied(evaluation.daily_arms(selected_days(spark, sf)))


def arm_ordered_summary(spark, sf):
    return tidied(evaluation.daily_arms(selected_days(spark, sf), ordered=True))


def base_arm_delta(spark, sf):
    return tidied(evaluation.base_arm_delta(evaluation.daily_arms(selected_days(spark, sf))))


def base_arm_delta_periods(spark, sf):
    delta = evaluation.base_arm_delta(evaluation.daily_arms(selected_days(spark, sf)))
    return tidied(evaluation.base_arm_delta_periods(delta, spine=_spine(spark)))


def _list_dailies(spark, sf):
    rows = stock_days(spark, sf)
    return (evaluation.daily_opportunity(rows.where(LEFT_LIST)),
            evaluation.daily_opportunity(rows.where(RIGHT_LIST)))


def paired_delta(spark, sf):
    return tidied(compare.paired_delta(*_list_dailies(spark, sf)))


def paired_delta_periods(spark, sf):
    delta = compare.paired_delta(*_list_dailies(spark, sf))
    metrics = [c for c in delta.columns if c.endswith("_delta")]
    return tidied(evaluation.period_summary(delta, ("bps", "sensitive"), (), metrics, intervals=metrics, spine=_spine(spark)))


def day_coverage(spark, sf):
    return compare.day_coverage(two_lists(spark, sf))


def common_days(spark, sf):
    rows = stock_days(spark, sf).select("date", "code", "left", "right", "decision_shares")
    left, right = compare.on_common_days(rows.where(LEFT_LIST), rows.where(RIGHT_LIST))
    return left.select("date", "code", F.lit("left").alias("side")).unionByName(
        right.select("date", "code", F.lit("right").alias("side")))


def unmatched_days(spark, sf):
    rows = stock_days(spark, sf).select("date", "left", "right", "decision_shares")
    a, b = rows.where(LEFT_LIST), rows.where(RIGHT_LIST)
    return (compare.only_days(a, b).withColumn("side", F.lit("left_only"))
            .unionByName(compare.only_days(b, a).withColumn("side", F.lit("right_only"))))


def union_of_lists(spark, sf):
    rows = stock_days(spark, sf)
    return compare.union_lists(rows.where(LEFT_LIST), rows.where(RIGHT_LIST)).select(
        "date", "code", "half", F.col("left").alias("in_left"), F.col("right").alias("in_right"))


def missing_labels(spark, sf):
    """List rows without a mature label, per list."""
    rows = stock_days(spark, sf)
    known = rows.where("known15")
    return (compare.missing_labels(known, rows.where(LEFT_LIST)).withColumn("side", F.lit("left"))
            .unionByName(compare.missing_labels(known, rows.where(RIGHT_LIST)).withColumn("side", F.lit("right"))))


def coupled_bounds(spark, sf):
    return tidied(compare.coupled_bounds(two_lists(spark, sf)))


ORDER_TARGETS = {"positive_before": "positive_before_bad3", "space_before": "space_before_bad3"}


def _coupled_orders(spark, sf):
    return compare.coupled_bounds(two_lists(spark, sf), compare.coupled_outcomes(ORDER_TARGETS))


def coupled_periods(spark, sf):
    keys = spark.createDataFrame([(*v, t) for v in evaluation.VIEWS for t in ORDER_TARGETS], "bps int, sensitive boolean, target string")
    return tidied(compare.coupled_periods(_coupled_orders(spark, sf), spine=_spine(spark, keys=keys)))


def _by_year(daily):
    return daily.withColumn("period", year_of(F.col("date")))


def weekly_block_interval(spark, sf):
    daily = evaluation.daily_opportunity(stock_days(spark, sf))
    keys = ("bps", "sensitive", "period")
    return tidied(block_intervals(explode_periods(daily), keys, ("rate", "lower", "upper")))


def coupled_intervals(spark, sf):
    daily = explode_periods(_coupled_orders(spark, sf))
    return tidied(block_intervals(daily, ("bps", "sensitive", "target", "period"), ("lower", "upper", "unknown_weight")))


def weekly_sums(spark, sf):
    from barlab.operators.bootstrap import weekly_blocks

    daily = explode_periods(evaluation.daily_opportunity(stock_days(spark, sf)))
    blocks = weekly_blocks(daily, ("bps", "sensitive", "period"), ("lower", "upper"))
    return tidied(blocks.select("bps", "sensitive", "period", "week", "days", "sum_lower", "sum_upper", "block", "n_blocks"))


def _rank_rows(spark, sf):
    rows = ordered_days(spark, sf).where("known15")
    before, bad = F.col("positive_before_bad315"), F.col("first_bad315")
    return rows.select(
        "date", "score", before.cast("int").alias("positive_before"),
        F.col("space_before_bad315").cast("int").alias("space_before"),
        F.when(before == 1, 1).when(bad >= 0, -3).otherwise(0).alias("utility"))


def daily_auc(spark, sf):
    return tidied(ranking.daily_auc(_rank_rows(spark, sf), ("positive_before", "space_before")))


def ordinal_auc(spark, sf):
    return tidied(ranking.ordinal_auc(_rank_rows(spark, sf)))


def average_ranks(spark, sf):
    rows = stock_days(spark, sf).select("date", "code", "score")
    return ranking.average_ranks(rows)


def _with_broken_marks(rows):
    """Some marks are NaN, as in a frame that came from pandas."""
    nan = F.lit(float("nan"))
    return rows.withColumns({f"mark_0959_return{b}": F.when(F.col("code") % 17 == 0, nan).otherwise(
        F.col(f"mark_0959_return{b}")) for b in (5, 15) if f"mark_0959_return{b}" in rows.columns})


def coverage_audit(spark, sf):
    rows = _with_broken_marks(stock_days(spark, sf)).where(SELECTED)
    return tidied(evaluation.daily_coverage(rows))


def coverage_periods(spark, sf):
    rows = _with_broken_marks(stock_days(spark, sf)).where(SELECTED)
    return tidied(evaluation.coverage_periods(evaluation.daily_coverage(rows)))


def coverage_missing(spark, sf):
    return evaluation.coverage_missing(_with_broken_marks(stock_days(spark, sf)).where(SELECTED))


def acceptance(spark, sf):
    """Gates of the left list against the right list as control and as risk control."""
    rows = ordered_days(spark, sf)
    view = "bps = 15 and not sensitive"
    lists = {"left": rows.where(LEFT_LIST), "right": rows.where(RIGHT_LIST)}
    tagged = [r.withColumn("group", F.lit(g)) for g, r in lists.items()]
    both = tagged[0].unionByName(tagged[1])
    daily = evaluation.finish_ordered(
        evaluation.tally(both, ("group", "date"), evaluation.ORDERED, ((15, False),)))
    summaries = evaluation.ordered_periods(daily, keys=("group",), intervals=())
    coupled = compare.coupled_bounds(
        two_lists(spark, sf), [o for o in compare.coupled_outcomes(ORDER_TARGETS)
                               if o[:3] == (15, False, "positive_before")])
    ends = block_intervals(_by_year(coupled.where(view)), ("period",), ("lower",))
    sizes = selection.list_concentration(
        both.select("group", "date", F.lit(True).alias("selected"), year_of(F.col("date")).alias("year")),
        ("group", "year"))
    return evaluation.acceptance(summaries, ends, sizes, "left", ["right"], ["right"])


def _fold_cuts(rows):
    train = labels.in_folds(rows.where("formula_input_valid and known15"), FOLDS, "training")
    return exact_quantiles(train, "strength", [selection.CUT_QUANTILE], "fold").select("fold", "threshold")


def selection_list(spark, sf):
    rows = stock_days(spark, sf)
    scores = rows.select("date", "code", "half", "board", "decision_shares",
                         F.when(F.col("formula_input_valid"), F.col("strength")).alias("score"))
    return tidied(selection.select_by_fold(scores, FOLDS, _fold_cuts(rows)), 6)


def selection_with_minimum(spark, sf):
    rows = stock_days(spark, sf)
    scores = rows.select("date", "code", F.when(F.col("formula_input_valid"), F.col("strength")).alias("score"))
    chosen = selection.select_by_fold(scores, FOLDS, _fold_cuts(rows), minimum=498000.0)
    return chosen.where("selected").select("fold", "date", "code")


def fixed_cut_selection(spark, sf):
    rows = stock_days(spark, sf)
    scored = rows.select("date", "code", F.when(F.col("formula_input_valid"), F.col("score")).alias("score"))
    return selection.select_fixed(scored, 47.0).where("selected")


def list_concentration(spark, sf):
    rows = stock_days(spark, sf).withColumn("selected", F.expr(SELECTED))
    return tidied(selection.list_concentration(rows.withColumn("year", F.year("date")), ("year",)))


def half_counts(spark, sf):
    return selection.half_counts(stock_days(spark, sf).withColumn("selected", F.expr(SELECTED)))


def _lists(spark, sf):
    """Five lists: B repeats A and E repeats C, each under another wording of its rule."""
    rows = stock_days(spark, sf)
    conditions = {
        "A": SELECTED, "B": "code % 9 > 6 and `left`", "C": "`right` and decision_shares >= 800",
        "D": "not `left` and decision_shares >= 800", "E": "code % 9 in (7, 8) and code % 2 = 0"}
    ids = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in conditions.items()]))
    return rows.select("date", "code", "half", "board", "decision_shares", F.explode(ids).alias("list_id"))


LIST_COLUMNS = ("date", "code", "half", "board", "decision_shares")


def duplicate_lists(spark, sf):
    return selection.duplicate_lists(_lists(spark, sf), LIST_COLUMNS)


def reused_summaries(spark, sf):
    lists = _lists(spark, sf)
    stored = lists.where("list_id in ('A', 'C')").groupBy("list_id", "half").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("days"))
    return selection.reuse_summaries(selection.duplicate_lists(lists, LIST_COLUMNS), stored)


def summary_lookup(spark, sf):
    daily = evaluation.daily_ordered(ordered_days(spark, sf))
    found = selection.summary_lookup(evaluation.ordered_periods(daily, intervals=()), bps=15, sensitive=False, period="1997H1")
    return tidied(found.select("period", "days", "known", "positive_before_rate", "lower", "upper"))


def period_filter(spark, sf):
    rows = stock_days(spark, sf)
    return rows.agg(*[F.count_if(in_period(F.col("date"), p)).alias(f"n_{p}")
                      for p in ("1997", "1997H1", "1997H2", "1998Q1", "1998Q3")])


def primary_target(spark, sf):
    return labels.primary_target(stock_days(spark, sf)).select(
        "date", "code", "known15", F.col("opportunity15").alias("primary_opportunity"))


def utility_domain(spark, sf):
    ranks = ordered_days(spark, sf).withColumn(
        "utility", F.when(F.col("known15"), F.when(F.col("positive_before_bad315") == 1, 1.0)
                          .when(F.col("first_bad315") >= 0, -3.0).otherwise(0.0)))
    out = None
    for name, allowed in (("binary", (0, 1)), ("risk", (-3, 0, 1)), ("signed", (-1, 0, 1))):
        bad = labels.utility_violations(ranks, "utility", "known15", allowed).agg(
            F.lit(name).alias("utility_set"), F.count(F.lit(1)).alias("violations"))
        out = bad if out is None else out.unionByName(bad)
    return out


def _labels(spark, sf):
    return stock_days(spark, sf).select("date", "code", "next_date", "known15", "opportunity15",
                                        "mark_0959_return15")


def relative_target(spark, sf):
    mature = labels.mature_labels(_labels(spark, sf), "1996-01-01", "1998-01-01")
    return tidied(labels.relative_target(mature))


def training_set(spark, sf):
    keys = stock_days(spark, sf).select("date", "code", "formula_input_valid", "score")
    out = labels.training_set(keys, _labels(spark, sf), "1996-01-01", "1998-01-01")
    return tidied(out.select("date", "code", "score", "target", "weight"))


def training_filter(spark, sf):
    """Training keys with a purge at an inner boundary and a required finite reference."""
    rows = labels.mature_labels(_with_broken_marks(_labels(spark, sf)), "1996-01-01", "1998-01-01",
                                split="1997-01-01", required="mark_0959_return15")
    return rows.select("date", "code", "next_date")


def walk_forward_folds(spark, sf):
    rows = stock_days(spark, sf).select("date", "code", "next_date", "known15", "formula_input_valid")
    train = labels.in_folds(rows.where("known15 and formula_input_valid"), FOLDS, "training")
    judged = labels.in_folds(rows, FOLDS, "evaluation")
    a = train.groupBy("fold").agg(
        F.count(F.lit(1)).alias("training_rows"), F.countDistinct("date").alias("training_days"),
        F.max("next_date").alias("last_observation"))
    b = judged.groupBy("fold").agg(F.count(F.lit(1)).alias("evaluation_rows"),
                                   F.min("date").alias("first_evaluation"))
    return a.join(b, "fold").withColumn("closed_before", F.col("last_observation") < F.col("first_evaluation"))


def affine_check(spark, sf):
    base = _labels(spark, sf).where("known15").select("date", "code", F.col("opportunity15").alias("target"))
    scaled = base.withColumn("target", 4 * F.col("target") - 3)
    bent = base.withColumn("target", F.when(F.col("code") % 19 == 0, 0.5).otherwise(F.col("target")))
    pairs = (("same", base), ("scaled", scaled), ("bent", bent))
    out = None
    for name, other in pairs:
        r = labels.affine_relation(base, other).select(
            F.lit(name).alias("pair"), "n", "unmatched", "same_keys", "equal", "affine")
        out = r if out is None else out.unionByName(r)
    return out


QUERIES = {f.__name__: f for f in (
    daily_opportunity, period_opportunity, ordered_summary, ordered_periods, arm_summary,
    arm_ordered_summary, base_arm_delta, base_arm_delta_periods, paired_delta, paired_delta_periods,
    day_coverage, common_days, unmatched_days, union_of_lists, missing_labels, coupled_bounds, coupled_periods,
    weekly_block_interval, coupled_intervals, weekly_sums, daily_auc, ordinal_auc, average_ranks,
    coverage_audit, coverage_periods, coverage_missing, acceptance, selection_list,
    selection_with_minimum, fixed_cut_selection, list_concentration, half_counts, duplicate_lists,
    reused_summaries, summary_lookup, period_filter, primary_target, utility_domain, relative_target,
    training_set, training_filter, walk_forward_folds, affine_check)}
