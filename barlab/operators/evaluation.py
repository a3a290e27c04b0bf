"""Daily and period statistics of a selection list.

Rows are reduced once, to one row per day with a counter per statistic and view
(cost level, sensitivity); everything after that runs on the day table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.functions.scalars import PERIOD_KINDS, explode_periods, finite, finite_or_null, flag, half_of, ratio
from barlab.operators.bootstrap import group_weeks, with_intervals

VIEWS = ((5, False), (5, True), (15, False), (15, True))

ADVERSE_LIMIT = -0.03


def known_flag(bps: int, sensitive: bool) -> Column:
    return flag(F.col(f"sensitive_known{bps}" if sensitive else f"known{bps}"))


@dataclass(frozen=True)
class Study:
    """What a daily table counts.

    ``facts`` and ``sums`` give, per cost level, row-level booleans and values that do
    not depend on whether the outcome is known; ``counts`` turns the facts of one view
    into the conditions to count. Sums run over known rows only.
    """

    facts: Callable[[int], Mapping[str, Column]]
    sums: Callable[[int], Mapping[str, Column]]
    counts: Callable[[Column, Column, Callable[[str], Column]], Mapping[str, Column]]


def _opportunity_counts(known, unfilled, fact):
    return {
        "known": known, "success": known & fact("opportunity"), "unknown": ~known & ~unfilled,
        "unfilled": unfilled, "one_percent": known & fact("one_percent"), "any_success": known & fact("any"),
        "mark_n": known & fact("mark"), "negative_n": known & fact("negative"),
        "adverse_n": known & fact("adverse"), "bad_n": known & fact("bad"),
    }


OPPORTUNITY = Study(
    facts=lambda b: {
        "opportunity": F.col(f"opportunity{b}") == 1, "one_percent": F.col(f"one_percent{b}") == 1,
        "any": F.col(f"any_opportunity{b}") == 1,
        "mark": F.col(f"mark_0959_return{b}").isNotNull(), "negative": F.col(f"mark_0959_return{b}") < 0,
        "adverse": F.col(f"adverse_return{b}").isNotNull(), "bad": F.col(f"adverse_return{b}") <= ADVERSE_LIMIT},
    sums=lambda b: {"mark_sum": F.col(f"mark_0959_return{b}"), "adverse_sum": F.col(f"adverse_return{b}")},
    counts=_opportunity_counts)


def _ordered_facts(b):
    positive, bad = F.col(f"first_positive_end{b}"), F.col(f"first_bad3{b}")
    return {
        "positive": F.col(f"opportunity{b}") == 1, "space": F.col(f"one_percent{b}") == 1,
        "positive_before": F.col(f"positive_before_bad3{b}") == 1,
        "space_before": F.col(f"space_before_bad3{b}") == 1,
        "observed": F.col(f"risk_observed{b}") == 1,
        # On a tie the adverse quote counts as first.
        "bad_first": (bad >= 0) & ((positive < 0) | (bad <= positive)),
        "bad": bad >= 0, "mark": F.col(f"mark_0959_return{b}").isNotNull()}


def _ordered_counts(known, unfilled, fact):
    risk = known & fact("observed")
    named = {n: known & fact(n) for n in ("positive", "space", "positive_before", "space_before")}
    return {
        "known": known, "unknown": ~known & ~unfilled, "unfilled": unfilled, **named, "risk_known": risk,
        "bad_first": risk & fact("bad_first"), "bad3": risk & fact("bad"), "mark_n": known & fact("mark"),
    }


ORDERED = Study(
    facts=_ordered_facts, sums=lambda b: {"mark_sum": F.col(f"mark_0959_return{b}")}, counts=_ordered_counts)

COVERAGE = Study(
    facts=lambda b: {"usable": finite(F.col(f"mark_0959_return{b}")),
                     "positive": finite(F.col(f"mark_0959_return{b}")) & (F.col(f"mark_0959_return{b}") > 0)},
    sums=lambda b: {"mark_sum": finite_or_null(F.col(f"mark_0959_return{b}"))},
    counts=lambda known, unfilled, fact: {
        "known": known, "reference_available": known & fact("usable"),
        "reference_missing": known & ~fact("usable"), "positive_reference": known & fact("positive")})


def signature(conditions: Sequence[Column]) -> Column:
    """One BIGINT with a bit per condition that is true."""
    if len(conditions) > 62:
        raise ValueError("at most 62 conditions fit one signature")
    total = F.lit(0).cast("long")
    for i, condition in enumerate(conditions):
        total = total + F.when(condition, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return total


def bit(signature_column: str, i: int) -> Column:
    return F.getbit(signature_column, F.lit(i)) == 1


def tally(
    rows: DataFrame,
    keys: Sequence[str],
    study: Study,
    views: Sequence[tuple[int, bool]] = VIEWS,
) -> DataFrame:
    """Counts and sums per key and view.

    The facts of a row are packed into one signature and rows collapse to
    (key, signature) cells, so the pass over the rows keeps one count and a few sums
    whatever the number of statistics and views; both are unfolded from the cells.
    The generated loop over the rows stays small enough for the JIT.
    """
    costs = sorted({b for b, _ in views})
    flags = {"unfilled": flag(F.col("known_unfilled")),
             **{f"known{b}{int(s)}": known_flag(b, s) for b, s in views},
             **{f"{n}{b}": c for b in costs for n, c in study.facts(b).items()}}
    sums = {f"{n}{b}": c for b in costs for n, c in study.sums(b).items()}
    cells = rows.select(*keys, signature(list(flags.values())).alias("_sig"),
                        *[c.alias(n) for n, c in sums.items()]).groupBy(*keys, "_sig").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(n).alias(n) for n in sums])
    at = {n: i for i, n in enumerate(flags)}
    facts, summed = list(study.facts(costs[0])), list(study.sums(costs[0]))
    records = F.array(*[
        F.struct(F.lit(b).alias("bps"), F.lit(s).alias("sensitive"),
                 bit("_sig", at[f"known{b}{int(s)}"]).alias("_known"),
                 *[bit("_sig", at[f"{n}{b}"]).alias(f"_{n}") for n in facts],
                 *[F.col(f"{n}{b}").alias(f"_{n}") for n in summed])
        for b, s in views])
    unfolded = cells.select(*keys, "_n", bit("_sig", at["unfilled"]).alias("_unfilled"), F.inline(records))
    known, n = F.col("_known"), F.col("_n")
    counts = study.counts(known, F.col("_unfilled"), lambda name: F.col(f"_{name}"))
    return unfolded.groupBy(*keys, "bps", "sensitive").agg(
        F.sum(n).alias("rows"),
        *[F.sum(F.when(c, n).otherwise(0)).alias(name) for name, c in counts.items()],
        *[F.sum(F.when(known, F.col(f"_{name}"))).alias(name) for name in summed])


def with_half(daily: DataFrame) -> DataFrame:
    """The half-year is a function of the date, so it is added after the reduction."""
    return daily.withColumn("half", half_of(F.col("date")))


def arms(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Split tallies by ``selected`` into the selection and all candidates of the same days.

    Every tally is additive, so the candidate arm is the sum of both parts and the
    rows themselves are read once.
    """
    values = [c for c in cells.columns if c not in (*keys, "selected")]
    summed = cells.groupBy(*keys).agg(
        F.sum(F.when(F.col("selected"), F.col("rows"))).alias("_chosen"),
        *[F.sum(F.when(F.col("selected"), F.col(v))).alias(f"_f_{v}") for v in values],
        *[F.sum(v).alias(f"_b_{v}") for v in values]).where("_chosen > 0")
    records = F.array(*[
        F.struct(F.lit(arm).alias("arm"), *[F.col(f"{p}{v}").alias(v) for v in values])
        for arm, p in (("formula", "_f_"), ("base_same_dates", "_b_"))])
    return summed.select(*keys, F.inline(records))


def bounds(success: Column, unknown: Column, rows: Column) -> tuple[Column, Column]:
    """Range of the success share when every unknown could be a failure or a success."""
    return ratio(success, rows), ratio(success + unknown, rows)


def finish_opportunity(cells: DataFrame) -> DataFrame:
    c = F.col
    lower, upper = bounds(c("success"), c("unknown"), c("rows"))
    parts = ("mark_sum", "mark_n", "negative_n", "adverse_sum", "adverse_n", "bad_n")
    return cells.withColumns({
        "rate": ratio(c("success"), c("known")),
        "one_percent_rate": ratio(c("one_percent"), c("known")),
        "any_rate": ratio(c("any_success"), c("known")),
        "lower": lower, "upper": upper,
        "mean_reference": ratio(c("mark_sum"), c("mark_n")),
        "negative_reference": ratio(c("negative_n"), c("mark_n")),
        "adverse_mean": ratio(c("adverse_sum"), c("adverse_n")),
        "bad3": ratio(c("bad_n"), c("adverse_n")),
    }).drop(*parts)


def finish_ordered(cells: DataFrame) -> DataFrame:
    c = F.col
    lower, upper = bounds(c("positive_before"), c("unknown"), c("rows"))
    rates = {f"{n}_rate": ratio(c(n), c("known"))
             for n in ("positive", "space", "positive_before", "space_before")}
    risks = {f"{n}_rate": ratio(c(n), c("risk_known")) for n in ("bad_first", "bad3")}
    return cells.withColumns({
        **rates, **risks, "lower": lower, "upper": upper,
        "mean_reference": ratio(c("mark_sum"), c("mark_n"))}).drop("mark_sum", "mark_n")


def finish_coverage(cells: DataFrame) -> DataFrame:
    c = F.col
    return cells.withColumns({
        "mean_reference": ratio(c("mark_sum"), c("reference_available")),
        "positive_reference_rate": ratio(c("positive_reference"), c("reference_available")),
    }).drop("mark_sum")


OPPORTUNITY_COUNTS = ("rows", "known", "success", "unknown", "unfilled")
OPPORTUNITY_METRICS = ("rate", "lower", "upper", "one_percent_rate", "any_rate", "mean_reference",
                       "negative_reference", "adverse_mean", "bad3")
ORDERED_COUNTS = ("rows", "known", "unknown", "unfilled", "positive", "space", "positive_before",
                  "space_before", "risk_known", "bad_first", "bad3")
ORDERED_METRICS = ("positive_rate", "space_rate", "positive_before_rate", "space_before_rate",
                   "bad_first_rate", "bad3_rate", "lower", "upper", "mean_reference")


def daily_opportunity(rows: DataFrame) -> DataFrame:
    return with_half(finish_opportunity(tally(rows, ("date",), OPPORTUNITY)))


def daily_ordered(rows: DataFrame) -> DataFrame:
    return with_half(finish_ordered(tally(rows, ("date",), ORDERED)))


def daily_coverage(rows: DataFrame) -> DataFrame:
    return with_half(finish_coverage(tally(rows, ("date",), COVERAGE)))


def daily_arms(rows: DataFrame, ordered: bool = False) -> DataFrame:
    """Selection and same-date candidate arms of the daily table; rows carry ``selected``."""
    study, finish = (ORDERED, finish_ordered) if ordered else (OPPORTUNITY, finish_opportunity)
    cells = tally(rows.withColumn("selected", flag(F.col("selected"))),
                  ("date", "selected"), study)
    return with_half(finish(arms(cells, ("date", "bps", "sensitive"))))


def period_spine(spark, first: str, end: str, keys: DataFrame | None = None, kinds: tuple[str, ...] = ("half", "year")) -> DataFrame:
    """Every period of the kinds that meets [first, end), per view or per row of ``keys``; bounded by the calendar."""
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.date_sub(F.lit(end).cast("date"), 1)))
    named = F.array_distinct(F.flatten(F.collect_list(F.array(*[PERIOD_KINDS[k](F.col("date")) for k in kinds]))))
    periods = spark.range(1).select(days.alias("date")).agg(named.alias("p"))
    if keys is None:
        keys = spark.createDataFrame(list(VIEWS), "bps int, sensitive boolean")
    return keys.withColumn("period", F.explode(periods.scalar()))


def period_summary(
    daily: DataFrame,
    keys: Sequence[str],
    counts: Sequence[str],
    metrics: Sequence[str],
    kinds: tuple[str, ...] = ("half", "year"),
    intervals: Sequence[str] = (),
    spine: DataFrame | None = None,
) -> DataFrame:
    """Sums of counts and day-equal means of metrics for every period of every group, in one pass over the days.

    ``intervals`` names metrics that also get weekly block-bootstrap ends. ``spine`` has rows (keys, period) that are to be
    there in any case: without days they show 0 days, counts of 0, and no means or intervals.
    """
    groups = group_weeks(explode_periods(daily, kinds), (*keys, "period"), counts, metrics, intervals)
    out = with_intervals(groups, intervals) if intervals else groups
    ends = [f"{m}_ci_{e}" for m in intervals for e in ("low", "high")]
    if spine is not None:
        out = spine.join(out, [*keys, "period"], "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(*keys, "period", zero("days"), *[zero(c) for c in counts], *metrics, *ends)


OPPORTUNITY_INTERVALS = ("rate", "lower", "upper")
ORDERED_INTERVALS = ("positive_before_rate", "space_before_rate", "lower", "upper")
DELTA_INTERVALS = ("rate_delta", "lower_delta", "upper_delta")


def opportunity_periods(daily: DataFrame, keys=("bps", "sensitive"), kinds=("half", "year"), intervals=OPPORTUNITY_INTERVALS,
                        spine: DataFrame | None = None) -> DataFrame:
    out = period_summary(daily, keys, OPPORTUNITY_COUNTS, OPPORTUNITY_METRICS, kinds, intervals, spine)
    return out.withColumn("pooled_rate", ratio(F.col("success"), F.col("known")))


def ordered_periods(daily: DataFrame, keys=("bps", "sensitive"), kinds=("half", "year"), intervals=ORDERED_INTERVALS,
                    spine: DataFrame | None = None) -> DataFrame:
    # bad3 is both a count and the stem of a rate; counts keep the plain name.
    return period_summary(daily, keys, ORDERED_COUNTS, ORDERED_METRICS, kinds, intervals, spine)


def coverage_periods(daily: DataFrame, keys=("bps", "sensitive"), kinds=("half", "year")) -> DataFrame:
    return explode_periods(daily, kinds).groupBy(*keys, "period").agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(F.col("reference_available") > 0).alias("reference_available_days"),
        F.sum("rows").alias("selected"), F.sum("known").alias("known"),
        F.sum("reference_available").alias("reference_available"),
        F.sum("reference_missing").alias("reference_missing"),
        F.sum("positive_reference").alias("positive_reference"),
        F.avg("positive_reference_rate").alias("date_equal_positive_reference_rate"),
        F.avg("mean_reference").alias("date_equal_mean_reference"))


def coverage_missing(rows: DataFrame) -> DataFrame:
    """Keys whose outcome is known but whose reference mark is not finite, per view."""
    missing = [F.when(known_flag(b, s) & ~finite(F.col(f"mark_0959_return{b}")),
                      F.struct(F.lit(b).alias("bps"), F.lit(s).alias("sensitive")))
               for b, s in VIEWS]
    return rows.select("date", "code", F.inline(F.array_compact(F.array(*missing))))


def base_arm_delta(daily_by_arm: DataFrame) -> DataFrame:
    """Selection minus same-date candidates, one row per day and view.

    The lower delta pairs the selection's lower bound with the candidates' upper
    bound and the upper delta does the reverse.
    """
    keys = ("bps", "sensitive", "date", "half")
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    a = lambda c: pick("formula", c)
    b = lambda c: pick("base_same_dates", c)
    return daily_by_arm.groupBy(*keys).agg(
        (a("rate") - b("rate")).alias("rate_delta"),
        (a("lower") - b("upper")).alias("lower_delta"),
        (a("upper") - b("lower")).alias("upper_delta"),
        (a("mean_reference") - b("mean_reference")).alias("reference_delta"))


def base_arm_delta_periods(delta: DataFrame, kinds=("half", "year"), spine: DataFrame | None = None) -> DataFrame:
    return period_summary(delta, ("bps", "sensitive"), (),
                          ("rate_delta", "lower_delta", "upper_delta", "reference_delta"), kinds, DELTA_INTERVALS, spine)


def acceptance(
    summaries: DataFrame,
    intervals: DataFrame,
    list_sizes: DataFrame,
    group: str,
    controls: Sequence[str],
    risk_controls: Sequence[str],
    min_days: int = 20,
    min_known: int = 100,
    max_median: float = 5,
) -> DataFrame:
    """Yearly gates over the ordered period summaries at 15 bps, plain view.

    ``summaries`` has one row per (group, period), ``intervals`` the coupled lower
    interval end per (right, period) of this group against each control, and
    ``list_sizes`` the median list size per (group, year). A gate whose evidence is
    missing fails.
    """
    year = F.substring("period", 1, 4)
    is_year = F.length("period") == 4
    names = ("positive_before_rate", "space_before_rate", "bad_first_rate")
    own = F.col("group") == group
    by_year = summaries.where(is_year).groupBy(year.alias("year")).agg(
        *[F.max(F.when(own, F.col(n))).alias(n) for n in names],
        *[F.max(F.when(F.col("group").isin(*controls), F.col(n))).alias(f"control_{n}") for n in names[:2]],
        *[F.count(F.when(F.col("group").isin(*controls), F.col(n))).alias(f"n_{n}") for n in names[:2]],
        F.min(F.when(F.col("group").isin(*risk_controls), F.col("bad_first_rate"))).alias("control_risk"),
        F.count(F.when(F.col("group").isin(*risk_controls), F.col("bad_first_rate"))).alias("n_risk"))
    halves = summaries.where(own & ~is_year).groupBy(year.alias("year")).agg(
        (F.count_if((F.col("days") >= min_days) & (F.col("known") >= min_known)) == 2).alias("half_coverage"))
    ends = intervals.where(is_year).groupBy(year.alias("year")).agg(
        (F.count_if(F.col("lower_ci_low") > 0) == len(controls)).alias("intervals_positive"))
    median_ok = list_sizes.where(own).select(
        F.col("year"), flag(F.col("median_daily") <= max_median).alias("median_at_most_limit"))
    better = F.lit(True)
    for n in names[:2]:
        better = better & flag((F.col(f"n_{n}") == len(controls)) & (F.col(n) > F.col(f"control_{n}")))
    risk_ok = flag((F.col("n_risk") == len(risk_controls)) & (F.col("bad_first_rate") <= F.col("control_risk")))
    out = by_year.join(halves, "year", "left").join(ends, "year", "left").join(median_ok, "year", "left")
    out = out.select(
        "year", flag(F.col("half_coverage")).alias("half_coverage"), better.alias("rates_improved"),
        flag(F.col("intervals_positive")).alias("intervals_positive"), risk_ok.alias("risk_not_worse"),
        flag(F.col("median_at_most_limit")).alias("median_at_most_limit"))
    gates = out.columns[1:]
    passed = F.lit(True)
    for g in gates:
        passed = passed & F.col(g)
    return out.withColumn("all_passed", passed)
