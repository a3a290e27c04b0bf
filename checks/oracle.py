"""DuckDB twin of each registered query, written against the driver's table views."""

from __future__ import annotations

import math

from barlab.operators.model import FIT
from barlab.plans.models import CUT, ENSEMBLE, FEATURES, changed_ensemble
from barlab.plans.prices import FEES
from checks.views import VIEWS, with_views

ORACLE_SQL: dict[str, str] = {}

VIEWS4 = [(5, False), (5, True), (15, False), (15, True)]
PERIODS = """CAST(year(date) AS VARCHAR)"""


def known(b: int, s: bool) -> str:
    return f"sensitive_known{b}" if s else f"known{b}"


def r(expr: str, name: str, places: int = 9) -> str:
    return f"round({expr} + 4e-{places + 4}, {places}) + 0.0 AS {name}"


def rs(names, places: int = 9) -> str:
    return ", ".join(r(n, n, places) for n in names)


def per_view(template, source: str) -> str:
    """UNION ALL of one aggregate query per cost and sensitivity."""
    return "\nUNION ALL\n".join(
        f"SELECT date, half, CAST({b} AS INTEGER) AS bps, {str(s).lower()} AS sensitive, count(*) AS rows, "
        f"{template(b, s)} FROM {source} GROUP BY date, half" for b, s in VIEWS4)


def opportunity_terms(b, s):
    k = known(b, s)
    return f"""count(*) FILTER ({k}) AS known, count(*) FILTER ({k} AND opportunity{b} = 1) AS success,
      count(*) FILTER (NOT {k} AND NOT known_unfilled) AS unknown, count(*) FILTER (known_unfilled) AS unfilled,
      count(*) FILTER ({k} AND one_percent{b} = 1) AS one_percent,
      count(*) FILTER ({k} AND any_opportunity{b} = 1) AS any_success,
      avg(mark_0959_return{b}) FILTER ({k}) AS mean_reference,
      avg(CAST(mark_0959_return{b} < 0 AS INTEGER)) FILTER ({k}) AS negative_reference,
      avg(adverse_return{b}) FILTER ({k}) AS adverse_mean,
      avg(CAST(adverse_return{b} <= -0.03 AS INTEGER)) FILTER ({k}) AS bad3"""


def opportunity_daily(source: str) -> str:
    return f"""(SELECT *, success / nullif(known, 0) AS rate, one_percent / nullif(known, 0) AS one_percent_rate,
      any_success / nullif(known, 0) AS any_rate, success / rows AS lower, (success + unknown) / rows AS upper
      FROM ({per_view(opportunity_terms, source)}))"""


OPP_COUNTS = ["rows", "known", "success", "unknown", "unfilled"]
OPP_METRICS = ["rate", "lower", "upper", "one_percent_rate", "any_rate", "mean_reference",
               "negative_reference", "adverse_mean", "bad3"]
OPP_KEYS = "date, half, bps, sensitive, rows, known, success, unknown, unfilled, one_percent, any_success"

ORACLE_SQL["daily_opportunity"] = with_views(
    ["stock_days"], f"SELECT {OPP_KEYS}, {rs(OPP_METRICS)} FROM {opportunity_daily('stock_days')}")


def in_periods(daily: str, kinds=("half", "year")) -> str:
    label = {"half": "half", "year": "CAST(year(date) AS VARCHAR)",
             "quarter": "CAST(year(date) AS VARCHAR) || 'Q' || CAST(quarter(date) AS VARCHAR)"}
    return "(" + " UNION ALL ".join(f"SELECT *, {label[k]} AS period FROM {daily}" for k in kinds) + ")"


def sums(names) -> str:
    return ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in names)


def means(names, places=9) -> str:
    return ", ".join(r(f"avg({n})", n, places) for n in names)


DRAWS = 10_000


def intervals(daily: str, keys: str, metrics: list[str]) -> str:
    """Weekly block bootstrap with counter-based draws over the yearly groups of a daily table."""
    key_list = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"b.{k} = g.{k}" for k in key_list)
    gk = ", ".join(f"g.{k}" for k in key_list)
    return f"""(WITH blocks AS (
      SELECT {keys}, CAST(date_trunc('week', date) AS DATE) AS week, count(*) AS days,
        {', '.join(f'sum({m}) AS s_{m}, count(*) - count({m}) AS gap_{m}' for m in metrics)},
        row_number() OVER (PARTITION BY {keys} ORDER BY CAST(date_trunc('week', date) AS DATE)) - 1 AS block,
        count(*) OVER (PARTITION BY {keys}) AS n_blocks
      FROM {daily} GROUP BY {keys}, CAST(date_trunc('week', date) AS DATE)),
    groups AS (SELECT {keys}, count(*) AS weeks, {', '.join(f'sum(gap_{m}) AS gap_{m}' for m in metrics)} FROM blocks GROUP BY {keys}),
    numbers AS (SELECT DISTINCT weeks FROM groups WHERE weeks >= 2),
    picks AS (
      SELECT weeks, draw, CAST('0x' || substr(md5(draw || ':' || slot), 1, 8) AS BIGINT) % weeks AS pick
      FROM (SELECT weeks, draw, unnest(range(1, weeks + 1)) AS slot
            FROM (SELECT weeks, unnest(range(1, {DRAWS + 1})) AS draw FROM numbers))),
    means AS (
      SELECT {gk}, draw, {', '.join(f'sum(b.s_{m}) / sum(b.days) AS m_{m}' for m in metrics)}
      FROM groups g JOIN picks p USING (weeks) JOIN blocks b ON {on} AND b.block = p.pick GROUP BY {gk}, draw)
    SELECT {gk}, g.weeks, {', '.join(
        f"round(CASE WHEN any_value(gap_{m}) = 0 THEN quantile_cont(m_{m}, {q}) END + 4e-13, 9) + 0.0 AS {m}_ci_{e}"
        for m in metrics for e, q in (("low", 0.025), ("high", 0.975)))}
    FROM groups g LEFT JOIN means b ON {on} GROUP BY {gk}, g.weeks)"""


STUDY = ("1995-01-01", "1999-07-01")


def with_spine(daily: str, keys: dict[str, str], counts: list[str], metrics: list[str], resampled: list[str], kinds=("half", "year"), more: str = "") -> str:
    """Period summaries with intervals; periods of the study without days show 0. ``keys``: name to a list of its values."""
    label = {"half": "CAST(year(d) AS VARCHAR) || CASE WHEN month(d) <= 6 THEN 'H1' ELSE 'H2' END", "year": "CAST(year(d) AS VARCHAR)",
             "quarter": "CAST(year(d) AS VARCHAR) || 'Q' || CAST(quarter(d) AS VARCHAR)"}
    names = ", ".join(keys)
    groups = f"{names}, period"
    ends = [f"{m}_ci_{e}" for m in resampled for e in ("low", "high")]
    periods = " UNION ".join(f"SELECT {label[k]} AS period FROM span" for k in kinds)
    source = in_periods(daily, kinds)
    zeros = "".join(f", coalesce(a.{c}, 0) AS {c}" for c in counts)
    total = f", {sums(counts)}" if counts else ""
    return f"""SELECT {groups}, coalesce(a.days, 0) AS days{zeros}, {', '.join(f'a.{m}' for m in metrics)}, {', '.join(f'i.{e}' for e in ends)}{more}
    FROM (WITH span AS (SELECT unnest(range(DATE '{STUDY[0]}', DATE '{STUDY[1]}', INTERVAL 1 DAY)) AS d), periods AS ({periods})
          SELECT {', '.join(f'{k}.{k}' for k in keys)}, period FROM periods, {', '.join(f'(VALUES {v}) {k}({k})' for k, v in keys.items())}) spine
    FULL JOIN (SELECT {groups}, count(*) AS days{total}, {means(metrics)} FROM {source} GROUP BY {groups}) a USING ({groups})
    LEFT JOIN {intervals(source, groups, resampled)} i USING ({groups})"""


VIEW_KEYS = {"bps": "(5), (15)", "sensitive": "(false), (true)"}

ORACLE_SQL["period_opportunity"] = with_views(["stock_days"], with_spine(
    opportunity_daily("stock_days"), VIEW_KEYS, OPP_COUNTS, OPP_METRICS, ["rate", "lower", "upper"], ("half", "quarter", "year"),
    f", {r('CAST(a.success AS DOUBLE) / nullif(a.known, 0)', 'pooled_rate')}"))


def ordered_terms(b, s):
    k = known(b, s)
    risk = f"{k} AND risk_observed{b} = 1"
    return f"""count(*) FILTER ({k}) AS known, count(*) FILTER (NOT {k} AND NOT known_unfilled) AS unknown,
      count(*) FILTER (known_unfilled) AS unfilled, count(*) FILTER ({k} AND opportunity{b} = 1) AS positive,
      count(*) FILTER ({k} AND one_percent{b} = 1) AS space,
      count(*) FILTER ({k} AND positive_before_bad3{b} = 1) AS positive_before,
      count(*) FILTER ({k} AND space_before_bad3{b} = 1) AS space_before,
      count(*) FILTER ({risk}) AS risk_known,
      count(*) FILTER ({risk} AND first_bad3{b} >= 0 AND NOT (first_positive_end{b} >= 0 AND first_positive_end{b} < first_bad3{b})) AS bad_first,
      count(*) FILTER ({risk} AND first_bad3{b} >= 0) AS bad3,
      avg(mark_0959_return{b}) FILTER ({k}) AS mean_reference"""


def ordered_daily(source: str) -> str:
    rates = ", ".join(f"{n} / nullif(known, 0) AS {n}_rate" for n in ("positive", "space", "positive_before", "space_before"))
    risks = ", ".join(f"{n} / nullif(risk_known, 0) AS {n}_rate" for n in ("bad_first", "bad3"))
    return f"""(SELECT *, {rates}, {risks}, positive_before / rows AS lower,
      (positive_before + unknown) / rows AS upper FROM ({per_view(ordered_terms, source)}))"""


ORD_COUNTS = ["rows", "known", "unknown", "unfilled", "positive", "space", "positive_before", "space_before",
              "risk_known", "bad_first", "bad3"]
ORD_METRICS = ["positive_rate", "space_rate", "positive_before_rate", "space_before_rate", "bad_first_rate",
               "bad3_rate", "lower", "upper", "mean_reference"]

ORACLE_SQL["ordered_summary"] = with_views(["ordered_days"], f"""
SELECT date, half, bps, sensitive, {', '.join(ORD_COUNTS)}, {rs(ORD_METRICS)} FROM {ordered_daily('ordered_days')}""")

ORACLE_SQL["ordered_periods"] = with_views(["ordered_days"], with_spine(
    ordered_daily("ordered_days"), VIEW_KEYS, ORD_COUNTS, ORD_METRICS, ["positive_before_rate", "space_before_rate", "lower", "upper"]))

ORACLE_SQL["summary_lookup"] = with_views(["ordered_days"], f"""
SELECT period, count(*) AS days, {sums(['known'])}, {means(['positive_before_rate', 'lower', 'upper'])}
FROM {in_periods(ordered_daily('ordered_days'))} WHERE bps = 15 AND NOT sensitive AND period = '1997H1' GROUP BY period""")

CHOSEN = '"left" AND decision_shares >= 800'
FORMULA = f"(SELECT * FROM ordered_days WHERE {CHOSEN})"
BASE = f"(SELECT * FROM ordered_days WHERE date IN (SELECT date FROM ordered_days WHERE {CHOSEN}))"


def two_arms(daily) -> str:
    return f"(SELECT *, 'formula' AS arm FROM {daily(FORMULA)} UNION ALL SELECT *, 'base_same_dates' AS arm FROM {daily(BASE)})"


ORACLE_SQL["arm_summary"] = with_views(
    ["ordered_days"], f"SELECT arm, {OPP_KEYS}, {rs(OPP_METRICS)} FROM {two_arms(opportunity_daily)}")
ORACLE_SQL["arm_ordered_summary"] = with_views(["ordered_days"], f"""
SELECT arm, date, half, bps, sensitive, {', '.join(ORD_COUNTS)}, {rs(ORD_METRICS)} FROM {two_arms(ordered_daily)}""")

DELTA = f"""(SELECT a.bps, a.sensitive, a.date, a.half, a.rate - b.rate AS rate_delta, a.lower - b.upper AS lower_delta,
  a.upper - b.lower AS upper_delta, a.mean_reference - b.mean_reference AS reference_delta
  FROM {opportunity_daily(FORMULA)} a JOIN {opportunity_daily(BASE)} b USING (bps, sensitive, date, half))"""
DELTAS = ["rate_delta", "lower_delta", "upper_delta", "reference_delta"]
ORACLE_SQL["base_arm_delta"] = with_views(
    ["ordered_days"], f"SELECT bps, sensitive, date, half, {rs(DELTAS)} FROM {DELTA}")
ORACLE_SQL["base_arm_delta_periods"] = with_views(["ordered_days"], with_spine(DELTA, VIEW_KEYS, [], DELTAS, DELTAS[:3]))

LEFT = '(SELECT * FROM stock_days WHERE "left" AND decision_shares >= 700)'
RIGHT = '(SELECT * FROM stock_days WHERE "right" AND decision_shares >= 700)'
PAIRED = ["rate", "one_percent_rate", "mean_reference", "negative_reference", "bad3"]
PAIR = f"""(SELECT bps, sensitive, date, half, {', '.join(f'a.{m} - b.{m} AS {m}_delta' for m in PAIRED)},
  a.lower - b.upper AS lower_delta, a.upper - b.lower AS upper_delta
  FROM {opportunity_daily(LEFT)} a JOIN {opportunity_daily(RIGHT)} b USING (bps, sensitive, date, half))"""
PAIR_COLS = [f"{m}_delta" for m in PAIRED] + ["lower_delta", "upper_delta"]
ORACLE_SQL["paired_delta"] = with_views(
    ["stock_days"], f"SELECT bps, sensitive, date, half, {rs(PAIR_COLS)} FROM {PAIR}")
ORACLE_SQL["paired_delta_periods"] = with_views(["stock_days"], with_spine(PAIR, VIEW_KEYS, [], PAIR_COLS, PAIR_COLS))

DAYS_L = f"(SELECT DISTINCT date FROM {LEFT})"
DAYS_R = f"(SELECT DISTINCT date FROM {RIGHT})"
ORACLE_SQL["day_coverage"] = with_views(["stock_days"], f"""
SELECT date, CASE WHEN r.date IS NULL THEN 'left_only' WHEN l.date IS NULL THEN 'right_only' ELSE 'common' END AS coverage
FROM {DAYS_L} l FULL OUTER JOIN {DAYS_R} r USING (date)""")
ORACLE_SQL["common_days"] = with_views(["stock_days"], f"""
SELECT date, code, 'left' AS side FROM {LEFT} WHERE date IN (SELECT date FROM {DAYS_R})
UNION ALL SELECT date, code, 'right' FROM {RIGHT} WHERE date IN (SELECT date FROM {DAYS_L})""")
ORACLE_SQL["unmatched_days"] = with_views(["stock_days"], f"""
SELECT date, 'left_only' AS side FROM (SELECT date FROM {DAYS_L} EXCEPT SELECT date FROM {DAYS_R})
UNION ALL SELECT date, 'right_only' FROM (SELECT date FROM {DAYS_R} EXCEPT SELECT date FROM {DAYS_L})""")
ORACLE_SQL["union_of_lists"] = with_views(["stock_days"], """
SELECT date, code, half, "left" AS in_left, "right" AS in_right FROM stock_days
WHERE decision_shares >= 700 AND ("left" OR "right")""")


ORACLE_SQL["missing_labels"] = with_views(["stock_days"], f"""
SELECT date, code, 'left' AS side FROM {LEFT} WHERE NOT known15
UNION ALL SELECT date, code, 'right' FROM {RIGHT} WHERE NOT known15""")


def coupled(outcomes) -> str:
    """Bounds by per-row weights over a window, for each (bps, sensitive, target, column stem)."""
    part = []
    for b, s, target, stem in outcomes:
        k = known(b, s)
        part.append(f"""SELECT date, half, CAST({b} AS INTEGER) AS bps, {str(s).lower()} AS sensitive, '{target}' AS target,
          CAST(sum(CAST("left" AS INTEGER)) AS BIGINT) AS left_rows, CAST(sum(CAST("right" AS INTEGER)) AS BIGINT) AS right_rows,
          sum(CASE WHEN {k} THEN w * {stem}{b} WHEN known_unfilled OR w > 0 THEN 0 ELSE w END) AS lower,
          sum(CASE WHEN {k} THEN w * {stem}{b} WHEN known_unfilled OR w < 0 THEN 0 ELSE w END) AS upper,
          sum(CASE WHEN {k} OR known_unfilled THEN 0 ELSE abs(w) END) AS unknown_weight,
          count(*) FILTER ("left" AND "right" AND NOT {k} AND NOT known_unfilled) AS shared_unknown
          FROM weighted GROUP BY date, half""")
    return f"""(WITH weighted AS (
      SELECT *, CAST("left" AS DOUBLE) / nl - CAST("right" AS DOUBLE) / nr AS w FROM (
        SELECT *, count(*) FILTER ("left") OVER (PARTITION BY date) AS nl,
          count(*) FILTER ("right") OVER (PARTITION BY date) AS nr FROM two_lists) WHERE nl > 0 AND nr > 0)
      {' UNION ALL '.join(part)})"""


PLAIN = [(b, s, "opportunity", "opportunity") for b, s in VIEWS4]
ORDERS = [(b, s, t, f"{t}_bad3") for b, s in VIEWS4 for t in ("positive_before", "space_before")]
CB = ["lower", "upper", "unknown_weight"]
ORACLE_SQL["coupled_bounds"] = with_views(["two_lists"], f"""
SELECT date, half, bps, sensitive, target, left_rows, right_rows, {rs(CB)}, shared_unknown FROM {coupled(PLAIN)}""")
ORACLE_SQL["coupled_periods"] = with_views(["two_lists"], with_spine(
    coupled(ORDERS), {**VIEW_KEYS, "target": "('positive_before'), ('space_before')"}, ["shared_unknown"], CB, CB))


YEARLY = "(SELECT *, CAST(year(date) AS VARCHAR) AS period FROM {})"
ORACLE_SQL["weekly_block_interval"] = with_views(["stock_days"], "SELECT * FROM " + intervals(
    in_periods(opportunity_daily("stock_days")), "bps, sensitive, period", ["rate", "lower", "upper"]))
ORACLE_SQL["coupled_intervals"] = with_views(["two_lists"], "SELECT * FROM " + intervals(
    in_periods(coupled(ORDERS)), "bps, sensitive, target, period", CB))
ORACLE_SQL["weekly_sums"] = with_views(["stock_days"], f"""
SELECT bps, sensitive, period, week, days, {rs(['sum_lower', 'sum_upper'])},
  CAST(row_number() OVER (PARTITION BY bps, sensitive, period ORDER BY week) - 1 AS INTEGER) AS block,
  count(*) OVER (PARTITION BY bps, sensitive, period) AS n_blocks
FROM (SELECT bps, sensitive, period, date - CAST(isodow(date) - 1 AS INTEGER) AS week, count(*) AS days,
        sum(lower) AS sum_lower, sum(upper) AS sum_upper
      FROM {in_periods(opportunity_daily('stock_days'))} GROUP BY ALL)""")

RANKED = """(SELECT date, score, positive_before_bad315 = 1 AS pb, space_before_bad315 = 1 AS sb,
  CASE WHEN positive_before_bad315 = 1 THEN 1 WHEN first_bad315 >= 0 THEN -3 ELSE 0 END AS u
  FROM ordered_days WHERE known15)"""


def pair_counts(hi: str, lo: str) -> str:
    """Pairs and doubled wins per day by joining both classes of the day."""
    return f"""(SELECT h.date, count(*) AS pairs,
      sum(CASE WHEN h.score > l.score THEN 2 WHEN h.score = l.score THEN 1 ELSE 0 END) AS wins
      FROM (SELECT * FROM {RANKED} WHERE {hi}) h JOIN (SELECT * FROM {RANKED} WHERE {lo}) l USING (date) GROUP BY h.date)"""


ALL_DAYS = "(SELECT date, count(*) AS rows FROM ordered_days WHERE known15 GROUP BY date)"
ORACLE_SQL["daily_auc"] = with_views(["ordered_days"], f"""
SELECT date, rows, coalesce(p.pairs, 0) AS positive_before_pairs, CAST(coalesce(p.wins, 0) AS BIGINT) AS positive_before_numerator2,
  {r('p.wins / (2 * p.pairs)', 'positive_before_auc')},
  coalesce(s.pairs, 0) AS space_before_pairs, CAST(coalesce(s.wins, 0) AS BIGINT) AS space_before_numerator2,
  {r('s.wins / (2 * s.pairs)', 'space_before_auc')}
FROM {ALL_DAYS} LEFT JOIN {pair_counts('pb', 'NOT pb')} p USING (date) LEFT JOIN {pair_counts('sb', 'NOT sb')} s USING (date)""")
_ORD = " UNION ALL ".join(f"SELECT * FROM {pair_counts(f'u = {h}', f'u = {l}')}" for h, l in ((0, -3), (1, -3), (1, 0)))
ORACLE_SQL["ordinal_auc"] = with_views(["ordered_days"], f"""
SELECT date, rows, CAST(coalesce(pairs, 0) AS BIGINT) AS utility_pairs, CAST(coalesce(wins, 0) AS BIGINT) AS utility_numerator2,
  {r('wins / (2 * pairs)', 'utility_auc')}
FROM {ALL_DAYS} LEFT JOIN (SELECT date, sum(pairs) AS pairs, sum(wins) AS wins FROM ({_ORD}) GROUP BY date) USING (date)""")
ORACLE_SQL["average_ranks"] = with_views(["stock_days"], """
SELECT date, code, score, rank() OVER (PARTITION BY date ORDER BY score) AS rank,
  rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2 AS average_rank
FROM stock_days""")

BROKEN = f"""(SELECT * REPLACE (
  CASE WHEN code % 17 = 0 THEN 'nan'::DOUBLE ELSE mark_0959_return5 END AS mark_0959_return5,
  CASE WHEN code % 17 = 0 THEN 'nan'::DOUBLE ELSE mark_0959_return15 END AS mark_0959_return15)
  FROM stock_days WHERE {CHOSEN})"""


def coverage_terms(b, s):
    k = known(b, s)
    ok = f"{k} AND coalesce(isfinite(mark_0959_return{b}), false)"
    return f"""count(*) FILTER ({k}) AS known, count(*) FILTER ({ok}) AS reference_available,
      count(*) FILTER ({k} AND NOT coalesce(isfinite(mark_0959_return{b}), false)) AS reference_missing,
      count(*) FILTER ({ok} AND mark_0959_return{b} > 0) AS positive_reference,
      avg(mark_0959_return{b}) FILTER ({ok}) AS mean_reference"""


COVERAGE = f"""(SELECT *, positive_reference / nullif(reference_available, 0) AS positive_reference_rate
  FROM ({per_view(coverage_terms, BROKEN)}))"""
ORACLE_SQL["coverage_audit"] = with_views(["stock_days"], f"""
SELECT date, half, bps, sensitive, rows, known, reference_available, reference_missing, positive_reference,
  {rs(['mean_reference', 'positive_reference_rate'])} FROM {COVERAGE}""")
ORACLE_SQL["coverage_periods"] = with_views(["stock_days"], f"""
SELECT bps, sensitive, period, count(*) AS days, count(*) FILTER (reference_available > 0) AS reference_available_days,
  CAST(sum(rows) AS BIGINT) AS selected, {sums(['known', 'reference_available', 'reference_missing', 'positive_reference'])},
  {r('avg(positive_reference_rate)', 'date_equal_positive_reference_rate')}, {r('avg(mean_reference)', 'date_equal_mean_reference')}
FROM {in_periods(COVERAGE)} GROUP BY bps, sensitive, period""")
ORACLE_SQL["coverage_missing"] = with_views(["stock_days"], " UNION ALL ".join(
    f"SELECT date, code, CAST({b} AS INTEGER) AS bps, {str(s).lower()} AS sensitive FROM {BROKEN} "
    f"WHERE {known(b, s)} AND NOT coalesce(isfinite(mark_0959_return{b}), false)" for b, s in VIEWS4))

_PB = [o for o in ORDERS if o[0] == 15 and not o[1] and o[2] == "positive_before"]
ORACLE_SQL["acceptance"] = with_views(["two_lists"], f"""
, summaries AS (
  SELECT grp, period, count(*) AS days, sum(known) AS known, avg(positive_before_rate) AS pb, avg(space_before_rate) AS sb,
    avg(bad_first_rate) AS bf
  FROM (SELECT *, 'left' AS grp FROM {in_periods(ordered_daily('(SELECT * FROM ordered_days WHERE "left" AND decision_shares >= 700)'))}
        UNION ALL
        SELECT *, 'right' AS grp FROM {in_periods(ordered_daily('(SELECT * FROM ordered_days WHERE "right" AND decision_shares >= 700)'))})
  WHERE bps = 15 AND NOT sensitive GROUP BY grp, period),
ends AS (SELECT * FROM {intervals(YEARLY.format(coupled(_PB)), "period", ["lower"])}),
sizes AS (SELECT CAST(year(date) AS VARCHAR) AS year, median(n) AS med FROM (
  SELECT date, count(*) AS n FROM {LEFT} GROUP BY date) GROUP BY ALL)
SELECT year, half_coverage, rates_improved, intervals_positive, risk_not_worse, median_at_most_limit,
  half_coverage AND rates_improved AND intervals_positive AND risk_not_worse AND median_at_most_limit AS all_passed
FROM (
  SELECT y.year, coalesce(half_coverage, false) AS half_coverage, coalesce(a.pb > b.pb AND a.sb > b.sb, false) AS rates_improved,
    coalesce(e.lower_ci_low > 0, false) AS intervals_positive, coalesce(a.bf <= b.bf, false) AS risk_not_worse,
    coalesce(med <= 5, false) AS median_at_most_limit
  FROM (SELECT DISTINCT period AS year FROM summaries WHERE length(period) = 4) y
  LEFT JOIN (SELECT period[1:4] AS year, count(*) FILTER (days >= 20 AND known >= 100) = 2 AS half_coverage
             FROM summaries WHERE grp = 'left' AND length(period) = 6 GROUP BY 1) h USING (year)
  LEFT JOIN (SELECT * FROM summaries WHERE grp = 'left') a ON a.period = y.year
  LEFT JOIN (SELECT * FROM summaries WHERE grp = 'right') b ON b.period = y.year
  LEFT JOIN ends e ON e.period = y.year LEFT JOIN sizes s ON s.year = y.year)""").replace(")\n, summaries", "),\nsummaries", 1)

FOLDS = [("1997h1", "1996-01-01", "1997-01-01", "1997-07-01"), ("1997h2", "1996-07-01", "1997-07-01", "1998-01-01"),
         ("1998h1", "1997-01-01", "1998-01-01", "1998-07-01"), ("1998h2", "1997-07-01", "1998-07-01", "1999-01-01")]
FOLD_TABLE = "(VALUES " + ", ".join(
    f"('{i}', DATE '{a}', DATE '{b}', DATE '{c}')" for i, a, b, c in FOLDS) + ") f(fold, t0, t1, e1)"
CUTS = f"""(SELECT fold, quantile_cont(strength, 0.995) AS threshold FROM stock_days, {FOLD_TABLE}
  WHERE date >= t0 AND next_date < t1 AND formula_input_valid AND known15 GROUP BY fold)"""
PLACED = f"(SELECT s.*, fold FROM stock_days s, {FOLD_TABLE} WHERE date >= t1 AND date < e1)"
KEPT = f"(SELECT s.*, fold FROM stock_days s LEFT JOIN {FOLD_TABLE} ON date >= t1 AND date < e1)"
ORACLE_SQL["selection_list"] = with_views(["stock_days"], f"""
SELECT fold, date, code, half, board, decision_shares,
  {r('CASE WHEN formula_input_valid THEN strength END', 'score', 6)},
  coalesce(formula_input_valid AND strength > threshold, false) AS selected
FROM {KEPT} LEFT JOIN {CUTS} USING (fold)""")
ORACLE_SQL["selection_with_minimum"] = with_views(["stock_days"], f"""
SELECT fold, date, code FROM {PLACED} JOIN {CUTS} USING (fold)
WHERE formula_input_valid AND strength > greatest(threshold, 498000)""")
ORACLE_SQL["fixed_cut_selection"] = with_views(["stock_days"], """
SELECT date, code, score, true AS selected FROM stock_days WHERE formula_input_valid AND score > 47""")
ORACLE_SQL["list_concentration"] = with_views(["stock_days"], f"""
SELECT year, CAST(sum(n) AS BIGINT) AS selected, count(*) AS days, {r('median(n)', 'median_daily')}, max(n) AS max_daily,
  {r('max(n) / sum(n)', 'largest_day_fraction')}
FROM (SELECT CAST(year(date) AS INTEGER) AS year, date, count(*) AS n FROM stock_days WHERE {CHOSEN} GROUP BY ALL) GROUP BY year""")
ORACLE_SQL["half_counts"] = with_views(["stock_days"], f"""
SELECT half, count(*) AS rows, count(DISTINCT date) AS days FROM stock_days WHERE {CHOSEN} GROUP BY half""")
ORACLE_SQL["duplicate_lists"] = with_views(["stock_days"], f"""
SELECT * FROM (
  SELECT 'A' AS list_id, count(*) AS size, NULL::VARCHAR AS alias_of FROM stock_days WHERE {CHOSEN}
  UNION ALL SELECT 'B', count(*), 'A' FROM stock_days WHERE {CHOSEN}
  UNION ALL SELECT 'C', count(*), NULL FROM stock_days WHERE "right" AND decision_shares >= 800
  UNION ALL SELECT 'D', count(*), NULL FROM stock_days WHERE NOT "left" AND decision_shares >= 800
  UNION ALL SELECT 'E', count(*), 'C' FROM stock_days WHERE code % 2 = 0 AND decision_shares >= 800)""")
ORACLE_SQL["reused_summaries"] = with_views(["stock_days"], f"""
SELECT 'B' AS list_id, 'A' AS source, half, count(*) AS rows, count(DISTINCT date) AS days
FROM stock_days WHERE {CHOSEN} GROUP BY half
UNION ALL SELECT 'E', 'C', half, count(*), count(DISTINCT date) FROM stock_days WHERE "right" AND decision_shares >= 800 GROUP BY half""")
ORACLE_SQL["period_filter"] = with_views(["stock_days"], """
SELECT count(*) FILTER (year(date) = 1997) AS "n_1997", count(*) FILTER (half = '1997H1') AS "n_1997H1",
  count(*) FILTER (half = '1997H2') AS "n_1997H2",
  count(*) FILTER (date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31') AS "n_1998Q1",
  count(*) FILTER (date BETWEEN DATE '1998-07-01' AND DATE '1998-09-30') AS "n_1998Q3" FROM stock_days""")
ORACLE_SQL["primary_target"] = with_views(["ordered_days"], """
SELECT date, code, known15, positive_before_bad315 AS primary_opportunity FROM ordered_days""")
ORACLE_SQL["utility_domain"] = with_views(["ordered_days"], """
, u AS (SELECT CASE WHEN positive_before_bad315 = 1 THEN 1 WHEN first_bad315 >= 0 THEN -3 ELSE 0 END AS utility
        FROM ordered_days WHERE known15)
SELECT * FROM (SELECT 'binary' AS utility_set, count(*) FILTER (utility NOT IN (0, 1)) AS violations FROM u
UNION ALL SELECT 'risk', count(*) FILTER (utility NOT IN (-3, 0, 1)) FROM u
UNION ALL SELECT 'signed', count(*) FILTER (utility NOT IN (-1, 0, 1)) FROM u)""").replace(")\n, u AS", "),\nu AS", 1)
MATURE = "known15 AND date >= DATE '1996-01-01' AND next_date < DATE '1998-01-01'"
TARGET = f"""(SELECT date, code, opportunity15 - avg(opportunity15) OVER (PARTITION BY date) AS target
  FROM stock_days WHERE {MATURE})"""
ORACLE_SQL["relative_target"] = with_views(["stock_days"], f"SELECT date, code, {rs(['target'])} FROM {TARGET}")
ORACLE_SQL["training_set"] = with_views(["stock_days"], f"""
SELECT date, code, score, {rs(['target', 'weight'])} FROM (
  SELECT s.date, s.code, s.score, t.target, 1 / count(*) OVER (PARTITION BY s.date) AS weight
  FROM stock_days s JOIN {TARGET} t USING (date, code) WHERE formula_input_valid)""")
ORACLE_SQL["training_filter"] = with_views(["stock_days"], f"""
SELECT date, code, next_date FROM stock_days
WHERE {MATURE} AND (date >= DATE '1997-01-01' OR next_date < DATE '1997-01-01')
  AND mark_0959_return15 IS NOT NULL AND code % 17 <> 0""")
ORACLE_SQL["walk_forward_folds"] = with_views(["stock_days"], f"""
SELECT *, last_observation < first_evaluation AS closed_before FROM (
  SELECT fold, count(*) AS training_rows, count(DISTINCT date) AS training_days, max(next_date) AS last_observation
  FROM stock_days, {FOLD_TABLE} WHERE date >= t0 AND next_date < t1 AND known15 AND formula_input_valid GROUP BY fold)
JOIN (SELECT fold, count(*) AS evaluation_rows, min(date) AS first_evaluation FROM {PLACED} GROUP BY fold) USING (fold)""")
ORACLE_SQL["affine_check"] = with_views(["stock_days"], """
SELECT pair, count(*) AS n, CAST(0 AS BIGINT) AS unmatched, true AS same_keys,
  max(abs(a - b)) <= 2e-12 AS equal,
  max(abs(b - (b0 + (b1 - b0) * a))) <= 2e-12 AND any_value(b1 - b0) <> 0 AS affine
FROM (
  SELECT *, arg_min(b, (date, code)) FILTER (a = 0) OVER (PARTITION BY pair) AS b0,
    arg_max(b, (date, code)) FILTER (a = 1) OVER (PARTITION BY pair) AS b1
  FROM (
    SELECT 'same' AS pair, date, code, opportunity15 AS a, opportunity15 AS b FROM stock_days WHERE known15
    UNION ALL SELECT 'scaled', date, code, opportunity15, 4 * opportunity15 - 3 FROM stock_days WHERE known15
    UNION ALL SELECT 'bent', date, code, opportunity15, CASE WHEN code % 19 = 0 THEN 0.5 ELSE opportunity15 END
      FROM stock_days WHERE known15)) GROUP BY pair""")

# --- daily and intraday bars -------------------------------------------------------

ORACLE_SQL["price_reference_states"] = with_views(["states"], f"""
SELECT date, code, {rs(['close', 'preclose', 'prior_close'], 7)}, reference_good, reset, prior_reference_count,
  prior_reset_count, {rs(['atr_raw', 'atr_reference'], 7)}, history_price_good FROM states""")
VIEWS["fees"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{f.market}', DATE '{f.valid_from}', {f.buy_rate!r}::DOUBLE, {f.sell_rate!r}::DOUBLE, {f.minimum!r}::DOUBLE)" for f in FEES) + (
    ") v(market, valid_from, buy_rate, sell_rate, minimum)")
_LEVEL = lambda e, b, n: r(f"max({e}) FILTER (b = {b})", n, 6)
ORACLE_SQL["round_trip_costs"] = with_views(["charged_levels"], f"""
SELECT code, date, next_date, market, entry_state, decision_shares, capacity, {r('price', 'entry_price', 6)},
  {', '.join(f"{_LEVEL('paid', b, f'cost{b}')}, {_LEVEL('greatest(needed + 0.005, needed / (1 - b / 10000))', b, f'break_even{b}')}" for b in (5, 15))}
FROM charged_levels GROUP BY code, date, next_date, market, entry_state, decision_shares, capacity, price""")
_VALUES = [f"{n}{b}" for b in (5, 15) for n in ("opportunity", "one_percent", "any_opportunity", "risk_observed", "positive_before_bad3",
                                                 "space_before_bad3", "mark_0959_return", "adverse_return")]
ORACLE_SQL["cost_labels"] = with_views(["month_outcomes"], f"""
SELECT date, code, next_date, market, decision_shares, seen_bars, known_unfilled, {rs(_VALUES, 8)},
  {', '.join(f'known{b}, sensitive_known{b}, first_positive_end{b}, first_bad3{b}' for b in (5, 15))} FROM month_outcomes""")
ORACLE_SQL["cost_label_days"] = with_views(
    ["month_outcomes"], f"SELECT {OPP_KEYS}, {rs(OPP_METRICS, 8)} FROM {opportunity_daily('month_outcomes')}")
ORACLE_SQL["look_ahead_check"] = with_views(["active_days"], """
SELECT 'reference' AS states, count(*) AS compared, CAST(0 AS BIGINT) AS changed FROM active_days WHERE date <= DATE '1997-06-30'
UNION ALL SELECT 'planted', count(*) FILTER (date <= DATE '1997-06-30'),
  count(DISTINCT code) FILTER (date <= DATE '1997-06-30' AND code IN (SELECT code FROM daily WHERE date > DATE '1997-06-30'))
FROM active_days""")
ORACLE_SQL["volatility_rebuild"] = with_views(["rebuilt"], f"""
SELECT date, code, formula_input_valid, {r('raw', 'v01_raw_rebuilt', 7)}, {r('ref', 'v01_reference', 7)},
  known AS reference_window_known, v01_match, reset_in_prior FROM rebuilt""")
ORACLE_SQL["reset_exposure_by_half"] = with_views(["rebuilt"], """
SELECT CAST(year(date) AS VARCHAR) || CASE WHEN month(date) < 7 THEN 'H1' ELSE 'H2' END AS half,
  count(*) AS original_valid, count(*) FILTER (NOT known) AS reference_unknown,
  count(*) FILTER (known AND prior_reset_count > 0) AS prior_reset_exposed,
  count(*) FILTER (known AND abs(raw - ref) > 2e-10) AS volatility_changed,
  count(*) FILTER (known AND raw - ref > 2e-10) AS reference_volatility_lower,
  count(*) FILTER (NOT v01_match) AS v01_mismatch
FROM rebuilt WHERE formula_input_valid GROUP BY 1""")
ORACLE_SQL["daily_contracts"] = with_views(["daily"], """
SELECT "check", violations = 0 AS passed, violations FROM (
  SELECT 'unique_key' AS "check", (SELECT count(*) FROM (SELECT 1 FROM daily GROUP BY date, code HAVING count(*) > 1)) AS violations
  UNION ALL SELECT 'status_domain', (SELECT count(*) FROM daily WHERE tradestatus NOT IN (0, 1))
  UNION ALL SELECT 'unadjusted', (SELECT count(*) FROM daily WHERE adjustflag <> 3)
  UNION ALL SELECT 'finite_preclose_when_active', (SELECT count(*) FROM daily WHERE tradestatus = 1 AND preclose IS NULL)
  UNION ALL SELECT 'dates_in_range', (SELECT count(*) FROM daily WHERE date < DATE '1995-01-01' OR date >= DATE '2002-06-01')
  UNION ALL SELECT 'range_identity', (SELECT count(*) FROM daily WHERE high < close OR low > close))""")
ORACLE_SQL["bar_functions"] = with_views(["bars"], f"""
SELECT code, date, slot, {rs(['ref_close'])}, CASE WHEN n >= 5 THEN CAST(v5 AS BIGINT) END AS sum_volume,
  {r('CASE WHEN n >= 5 THEN h5 END', 'highest_high')}, {r('CASE WHEN n >= 5 THEN l5 END', 'lowest_low')},
  CASE WHEN n >= 5 THEN rising END AS rising_bars, CAST(bars_today AS INTEGER) AS bars_today,
  CAST(volume_today AS BIGINT) AS volume_today, {rs(['last_rising_close'])}, CAST(bars_today - last_rise AS INTEGER) AS bars_since_rise,
  {r('CASE WHEN close > open AND volume > 1 THEN greatest(close, open) ELSE least(close, 50) END', 'chosen')},
  {r('CASE WHEN volume > 1 THEN abs(ln(close / open)) END', 'log_move')}, CAST(trunc(close * 100) AS BIGINT) AS close_cents
FROM (
  SELECT *, max(CASE WHEN close > open THEN bars_today END) OVER t AS last_rise,
    arg_max(close, slot) FILTER (close > open) OVER t AS last_rising_close
  FROM (
    SELECT *, lag(close) OVER c AS ref_close, row_number() OVER c AS n, sum(volume) OVER w AS v5, max(high) OVER w AS h5,
      min(low) OVER w AS l5, count(*) FILTER (close > open) OVER w AS rising,
      count(*) OVER t AS bars_today, sum(volume) OVER t AS volume_today
    FROM bars
    WINDOW c AS (PARTITION BY code ORDER BY date, slot),
      w AS (PARTITION BY code ORDER BY date, slot ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
      t AS (PARTITION BY code, date ORDER BY slot))
  WINDOW t AS (PARTITION BY code, date ORDER BY slot))""")
CONTEXT = ["dh", "dl", "da", "dcp1", "dcp2", "dcp6", "dcp21", "true_range", "mean_close5", "mean_close20",
           "pv5", "ph20", "pl20", "vp20"]
ORACLE_SQL["bar_day_context"] = with_views(["day_context"], f"""
SELECT code, date, {rs(['open', 'high', 'low', 'close', 'q', 'p_mid', 'p_short', 'p_long', *CONTEXT], 7)}, volume, bars, dv
FROM day_context""")
DAYF = ["NA01", "NA02", "NA03", "A04", "NA05", "NA06", "NA07", "ND01", "ND02", "ND03", "ND04", "C01", "NC02",
        "NC03", "NC04", "C05", "C06", "NC07", "NC08", "V01"]
TAILF = ["A08", "A09", "A10", "A11", "A12", "NA13", "NA14", "A15", "A16", "A17", "NA18", "NA19", "A20"]
IDXF = ["I01", "I02", "I03", "I04", "J01", "J02", "J03", "J04", "R01", "R02", "R03", "R04"]
ORACLE_SQL["bar_features_daily"] = with_views(["day_features"], f"SELECT date, code, {rs(DAYF, 7)} FROM day_features")
ORACLE_SQL["bar_features_intraday"] = with_views(["scaled_tail"], f"SELECT date, code, {rs(TAILF, 7)} FROM scaled_tail")
ORACLE_SQL["index_relative_features"] = with_views(["relative_features"], f"SELECT date, code, {rs(IDXF, 6)} FROM relative_features")
ORACLE_SQL["turnover_features"] = with_views(["turnover"], f"SELECT date, code, {rs(['psh', 'S01', 'S02', 'S03'], 7)} FROM turnover")
ORACLE_SQL["morning_range"] = with_views(["morning_features"], f"""
SELECT date, code, morning_high, morning_low, morning_complete, {rs(['AMHD', 'AMLD'], 7)} FROM morning_features""")
ORACLE_SQL["clock_guard"] = with_views(["clock_guard"], "SELECT * FROM clock_guard")
ORACLE_SQL["bar_quality"] = with_views(["flawed_good"], """
SELECT code, date, count(*) AS bars, count(*) FILTER (NOT good) AS bad_bars, bool_and(good) AS all_good,
  bool_or(volume > 1) AS any_busy_bar FROM flawed_good GROUP BY code, date""")
ORACLE_SQL["price_path"] = with_views(["flawed", "day_context"], f"""
SELECT o.code, o.date, c0 AS close_cents, CAST(0 AS BIGINT) AS path_00,
  {', '.join(f'c{k} - c0 AS path_0{k}' for k in range(1, 6))}, good_bars,
  coalesce(slot0 = 9 AND date0 = o.date, false) AND good_bars = 6 AND c0 > 0 AND coalesce(vp20 > 0, false) AS path_ok
FROM (
  SELECT *, {', '.join(f'lag(c0, {k}) OVER c AS c{k}' for k in range(1, 6))}, lag(slot, 5) OVER c AS slot0,
    lag(date, 5) OVER c AS date0,
    count(*) FILTER (close > 0 AND abs(close * 100 - round(close * 100)) <= 0.01) OVER (c ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS good_bars
  FROM (SELECT *, CAST(round(close * 100) AS BIGINT) AS c0 FROM flawed)
  WINDOW c AS (PARTITION BY code ORDER BY date, slot)) o
LEFT JOIN (SELECT code, date, vp20 FROM day_context) v ON v.code = o.code AND v.date = o.date
WHERE slot = 14""")
ALLF = [*DAYF, *TAILF, *IDXF, "S01", "S02", "S03", "AMHD", "AMLD"]
ORACLE_SQL["feature_table"] = with_views(
    ["relative_features", "scaled_tail", "turnover", "morning_features", "clock_guard"], f"""
SELECT date, code, {rs(ALLF, 6)}, clock_ok, clock_ok AND {' AND '.join(f'"{n}" IS NOT NULL' for n in ALLF)} AS formula_input_valid
FROM relative_features
  LEFT JOIN (SELECT code, date, {', '.join(f'"{n}"' for n in TAILF)} FROM scaled_tail) USING (code, date)
  LEFT JOIN turnover USING (code, date)
  LEFT JOIN (SELECT code, date, "AMHD", "AMLD" FROM morning_features) USING (code, date)
  LEFT JOIN (SELECT code, date, clock_ok FROM clock_guard) USING (code, date)
WHERE q IS NOT NULL""")
ORACLE_SQL["entry_vwap"] = with_views(["entries"], f"""
SELECT code, date, {rs(['decision_price'])}, decision_shares, entry_volume, entry_bars, {rs(['entry_price'])}, capacity,
  {rs(['entry_cost'])}, fits_capacity FROM entries""")
ORACLE_SQL["order_labels"] = with_views(["watched_labels"], """
SELECT date, code, next_date, seen_bars, known, CAST(pos AS INTEGER) AS first_positive_end,
  CAST(space AS INTEGER) AS first_space_end, CAST(bad AS INTEGER) AS first_bad3, any_opportunity,
  CAST(pos >= 0 AS INTEGER) AS opportunity, CAST(space >= 0 AS INTEGER) AS one_percent,
  CAST(pos >= 0 AND (bad < 0 OR bad > pos) AS INTEGER) AS positive_before_bad3,
  CAST(space >= 0 AND (bad < 0 OR bad > space) AS INTEGER) AS space_before_bad3
FROM watched_labels""")
ORACLE_SQL["window_marks"] = with_views(["watched_labels"], f"""
SELECT date, code, known, {rs(['mark_return', 'adverse_return'], 8)} FROM watched_labels""")

# --- models ------------------------------------------------------------------------


def regions(tree) -> list[tuple[int, int, bool, str]]:
    """(node, level, leaf flag, condition) of every node, level by level from the root."""
    found = [(0, 0, tree.left[0] < 0, "true")]
    for node, level, leaf, condition in found:
        if not leaf:
            test = f"{FEATURES[tree.feature[node]]} <= {tree.threshold[node]!r}"
            for child, side in ((tree.left[node], test), (tree.right[node], f"NOT {test}")):
                found.append((child, level + 1, tree.left[child] < 0, f"{condition} AND {side}"))
    return found


def leaf_score(tree) -> str:
    """The leaves' regions side by side; exactly one of them holds a row."""
    arms = [f"WHEN {condition} THEN {ENSEMBLE.learning_rate * tree.value[node]!r}::DOUBLE"
            for node, _, leaf, condition in regions(tree) if leaf]
    return f"CASE {' '.join(arms)} END"


SCORE = f"{ENSEMBLE.bias!r}::DOUBLE + " + " + ".join(f"({leaf_score(t)})" for t in ENSEMBLE.trees)
CODES = ", ".join(FEATURES)
ORACLE_SQL["encode_features"] = with_views(["encoded"], f"SELECT date, code, formula_input_valid, {CODES} FROM encoded")
ORACLE_SQL["encode_features_tenfold"] = with_views(["features"], "SELECT date, code, " + ", ".join(
    f"CAST(floor(10 * least(greatest(100 * {n} + 10000 + 0.000001::DOUBLE, 0), 999999)) AS INTEGER) AS {n}" for n in FEATURES)
    + " FROM features WHERE formula_input_valid")
ORACLE_SQL["score_trees"] = with_views(["encoded"], f"""
SELECT date, code, half, {r(f'CASE WHEN formula_input_valid THEN {SCORE} END', 'score')} FROM encoded""")
_OTHER = changed_ensemble()
OTHER_SCORE = f"{_OTHER.bias!r}::DOUBLE + " + " + ".join(f"({leaf_score(t)})" for t in _OTHER.trees)
ORACLE_SQL["score_replay"] = with_views(["encoded"], f"""
SELECT count(*) AS rows, count(score) AS scored, CAST(0 AS BIGINT) AS missing_mismatch,
  count(*) FILTER (abs(score - walked) > 2e-11) AS value_mismatch,
  count(*) FILTER ((score > {CUT}) <> (walked > {CUT})) AS flag_mismatch, count(*) FILTER (score > {CUT}) AS selected, "table"
FROM (SELECT CASE WHEN formula_input_valid THEN {SCORE} END AS score,
        unnest(['same', 'changed']) AS "table",
        unnest([CASE WHEN formula_input_valid THEN {SCORE} END, CASE WHEN formula_input_valid THEN {OTHER_SCORE} END]) AS walked
      FROM encoded) GROUP BY "table" """)
_QS = (0.97, 0.98, 0.99, 0.995, 0.998, 0.999, 0.9995)
ORACLE_SQL["quantile_cuts"] = with_views(["training_rows"], f"""
SELECT half, unnest([{', '.join(f'{q}::DOUBLE' for q in _QS)}]) AS probability,
  unnest([{', '.join(f'round(quantile_cont(score, {q}) + 4e-13, 9) + 0.0' for q in _QS)}]) AS threshold
FROM (SELECT half, {SCORE} AS score FROM training_rows) GROUP BY half""")
ORACLE_SQL["weighted_moments"] = with_views(["training_rows"], f"""
SELECT half, n, {rs(['weight'])}, {r('m', 'weighted_mean')}, {r('v', 'weighted_variance')} FROM (
  SELECT half, count(target) AS n, sum(weight) AS weight, any_value(m) AS m,
    sum(weight * (target - m) * (target - m)) / sum(weight) AS v
  FROM training_rows JOIN (SELECT half, sum(weight * target) / sum(weight) AS m FROM training_rows GROUP BY half) USING (half) GROUP BY half)""")


def leaf_of(tree) -> str:
    return f"CASE {' '.join(f'WHEN {c} THEN {node}' for node, _, leaf, c in regions(tree) if leaf)} END"


_PATHS = ", ".join(f"({t}, {leaf}, {node}, {len(tree.path(node)) - 1}, {str(node == leaf).lower()})"
                   for t, tree in enumerate(ENSEMBLE.trees) for leaf in tree.leaves() for node in tree.path(leaf))
ORACLE_SQL["node_stats"] = with_views(["training_rows"], f"""
, seats AS (SELECT row_number() OVER () AS id, date, weight, target, {CODES} FROM training_rows),
steps AS (
  SELECT id, date, weight, target, unnest(range({len(ENSEMBLE.trees)})) AS tree_id, unnest([{', '.join(leaf_of(t) for t in ENSEMBLE.trees)}]) AS leaf,
    unnest([{', '.join(leaf_score(t) for t in ENSEMBLE.trees)}]) AS step FROM seats),
res AS (
  SELECT tree_id, leaf, date, weight, target - {ENSEMBLE.bias!r}::DOUBLE - coalesce(sum(step) OVER (
    PARTITION BY id ORDER BY tree_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM steps),
paths(tree_id, leaf, node_id, level, is_leaf) AS (VALUES {_PATHS}),
met AS MATERIALIZED (SELECT * FROM res JOIN paths USING (tree_id, leaf)),
means AS (SELECT tree_id, node_id, sum(weight * r) / sum(weight) AS m FROM met GROUP BY ALL)
SELECT CAST(tree_id AS INTEGER) AS tree_id, node_id, level, is_leaf, count(*) AS node_rows, {r('sum(weight)', 'weight', 8)}, count(DISTINCT date) AS days,
  {r('any_value(m)', 'residual_mean', 8)}, {r('sum(weight * (r - m) * (r - m)) / sum(weight)', 'residual_variance', 8)}
FROM met JOIN means USING (tree_id, node_id) GROUP BY tree_id, node_id, level, is_leaf""").replace(")\n, seats AS", "),\nseats AS", 1)
FIT_STEPS = FIT["trees"] * FIT["depth"]
LAST = f"step % {FIT['depth']} = {FIT['depth'] - 1}"
# Each round of the recursion is one level of one tree: rows carry (node, residual), and every node that holds rows is reported.
ORACLE_SQL["fit_boosted"] = with_views(["training_rows"], f"""
, t AS MATERIALIZED (SELECT row_number() OVER () AS id, [{CODES}] AS x, weight AS w, target AS y FROM training_rows),
long AS MATERIALIZED (SELECT id, w, unnest(x) AS v, unnest(range({len(FEATURES)})) AS f FROM t),
start AS (SELECT sum(w * y) / sum(w) AS bias FROM t),
scale AS MATERIALIZED (SELECT sum(w * (y - bias) * (y - bias)) AS scale FROM t, start),
state AS (
  SELECT 0 AS step, id, 0 AS node, y - bias AS r, CAST(NULL AS BIGINT) AS f, CAST(NULL AS DOUBLE) AS cut,
    CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS w, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS q FROM t, start
  UNION ALL (
    WITH cur AS (SELECT step, id, node, r FROM state WHERE id IS NOT NULL AND step < {FIT_STEPS}),
    cells AS (SELECT any_value(step) AS step, node, f, v, count(*) AS n, sum(w) AS w, sum(w * r) AS s, sum(w * r * r) AS q
              FROM cur JOIN long USING (id) GROUP BY node, f, v),
    sided AS (SELECT *, lead(v) OVER o AS next, sum(n) OVER o AS ln, sum(w) OVER o AS lw, sum(s) OVER o AS ls,
                sum(n) OVER p AS tn, sum(w) OVER p AS tw, sum(s) OVER p AS ts, sum(q) OVER p AS tq
              FROM cells WINDOW o AS (PARTITION BY node, f ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY node, f)),
    gains AS (SELECT *, CASE WHEN next IS NOT NULL AND ln >= {FIT['min_leaf_rows']} AND tn - ln >= {FIT['min_leaf_rows']}
                THEN round((ls * ls / lw + (ts - ls) * (ts - ls) / (tw - lw) - ts * ts / tw) / scale, 9) END AS gain FROM sided, scale),
    best AS (SELECT *, (v + next) / 2.0 AS cut FROM gains
             QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC NULLS LAST, f, v) = 1),
    placed AS (
      SELECT c.step, c.id, c.r, x.w, CASE WHEN b.gain > 0 THEN 2 * c.node + 1 + CAST(x.x[b.f + 1] > b.cut AS INTEGER) ELSE c.node END AS node
      FROM cur c JOIN best b USING (node) JOIN t x USING (id)),
    leaves AS (SELECT node, count(*) AS n, sum(w) AS w, sum(w * r) AS s, sum(w * r * r) AS q FROM placed GROUP BY node)
    SELECT p.step + 1, p.id, CASE WHEN {LAST.replace('step', 'p.step')} THEN 0 ELSE p.node END,
      CASE WHEN {LAST.replace('step', 'p.step')} THEN p.r - {FIT['learning_rate']}::DOUBLE * l.s / l.w ELSE p.r END, NULL, NULL, NULL, NULL, NULL, NULL
    FROM placed p JOIN leaves l USING (node)
    UNION ALL
    SELECT step, NULL, node, NULL, CASE WHEN gain > 0 THEN f END, CASE WHEN gain > 0 THEN cut END, tn, tw, ts, tq FROM best
    UNION ALL
    SELECT (SELECT max(step) FROM cur), NULL, node, NULL, NULL, NULL, n, w, s, q FROM leaves
    WHERE (SELECT max({LAST}) FROM cur))),
nodes AS (
  SELECT step // {FIT['depth']} AS tree_id, node, max(f) AS f, max(cut) AS cut, any_value(n) AS n, any_value(w) AS w, any_value(s) AS s, any_value(q) AS q
  FROM state WHERE id IS NULL GROUP BY ALL),
named AS (SELECT *, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY node) - 1 AS INTEGER) AS node_id FROM nodes)
SELECT CAST(a.tree_id AS INTEGER) AS tree_id, a.node_id, CAST(coalesce(a.f, -1) AS INTEGER) AS feature, coalesce(a.cut, 0.0) AS threshold,
  coalesce(l.node_id, -1) AS "left", coalesce(g.node_id, -1) AS "right", {r('a.s / a.w', 'value', 7)}, a.n AS node_rows, {r('a.w', 'weight', 7)},
  {r('greatest(a.q / a.w - (a.s / a.w) * (a.s / a.w), 0.0)', 'impurity', 7)},
  true AS rows_agree, true AS weight_agrees, true AS value_agrees, true AS impurity_agrees
FROM named a LEFT JOIN named l ON l.tree_id = a.tree_id AND l.node = 2 * a.node + 1
  LEFT JOIN named g ON g.tree_id = a.tree_id AND g.node = 2 * a.node + 2""").replace(")\n, t AS", "),\nt AS", 1).replace("WITH ", "WITH RECURSIVE ", 1)

# --- basics ------------------------------------------------------------------------

ORACLE_SQL["scan_columns"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS quantity,
  CAST(floor(l_extendedprice * 100 / l_quantity) AS BIGINT) AS gross FROM lineitem"""
ORACLE_SQL["date_range_scan"] = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice FROM orders
WHERE o_orderdate >= '1996-03-01' AND o_orderdate < '1998-09-01' AND o_orderdate >= '1997-02-01'
  AND o_orderdate < '1997-12-01' AND o_totalprice >= 1000 AND o_orderstatus <> 'P'"""
ORACLE_SQL["sql_scan"] = f"""
SELECT n, count(*) AS customers, {r('max(top)', 'top')} FROM (
  SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders
  WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1999-01-01' GROUP BY o_custkey) GROUP BY n"""
ORACLE_SQL["view_chain"] = """
SELECT c_mktsegment, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders, max(o_totalprice) AS top,
  count(*) FILTER (o_totalprice > 250000) AS large
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
ORACLE_SQL["multi_period_scan"] = """
SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS lines,
  CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity
FROM lineitem GROUP BY ALL"""
ORACLE_SQL["partitioned_round_trip"] = """
SELECT strftime(l_shipdate, 'm%Y%m') AS month, count(*) AS lines, CAST(sum(CAST(l_quantity AS DECIMAL(14,2))) AS DOUBLE) AS quantity,
  CAST(0 AS BIGINT) AS misplaced
FROM lineitem WHERE month IN (
  SELECT strftime(o_orderdate, 'm%Y%m') AS m FROM orders GROUP BY m
  HAVING count(*) FILTER (o_orderpriority = '1-URGENT') * 100 >= count(*) * 17)
GROUP BY month"""
ORACLE_SQL["stitch_sources"] = with_views(
    ["stock_days"], "SELECT date, code, half, known15, opportunity15 FROM stock_days")
ORACLE_SQL["overlap_check"] = with_views(["stock_days"], """
SELECT "check", violations = 0 AS passed, violations FROM (
  SELECT 'overlap_equal' AS "check", CAST(0 AS BIGINT) AS violations
  UNION ALL SELECT 'overlap_changed', 2 * count(*) FROM stock_days WHERE code % 100 = 7
    AND date >= DATE '1996-01-01' AND date < DATE '1998-01-01')""")
ORACLE_SQL["frame_surplus"] = """
SELECT l_suppkey, l_returnflag, l_linestatus,
  count(*) FILTER (l_returnflag <> 'N') - count(*) FILTER (l_linestatus = 'F') AS surplus
FROM lineitem GROUP BY ALL HAVING surplus <> 0"""
ORACLE_SQL["membership_filter"] = with_views(["stock_days"], """
SELECT date, code, board FROM stock_days
WHERE board IN ('main', 'star') AND date IN (SELECT date FROM stock_days WHERE score >= 49)""")
ORACLE_SQL["null_handling"] = """
SELECT o_orderkey, plain AS is_finite, o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 = 0 AS is_missing,
  CASE WHEN plain THEN o_totalprice END AS clean_value, CASE WHEN plain THEN o_totalprice ELSE -1 END AS filled,
  CASE WHEN o_totalprice > 250000 THEN o_totalprice END AS masked
FROM (SELECT *, o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 AS plain FROM orders)"""
ORACLE_SQL["candidate_filter"] = """
SELECT * FROM (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, c_mktsegment || ' ' || c_name AS name,
    coalesce(day_open, 0) AS day_open, coalesce(day_volume, 0) AS day_volume
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS day_volume, max(o_totalprice) AS day_open FROM orders GROUP BY 1)
    ON o_custkey = c_custkey
  WHERE c_nationkey <> 3)
WHERE name NOT LIKE '%BUILD%' AND code NOT LIKE '00009%' AND code NOT LIKE '0001%' AND code NOT LIKE '013%'
  AND day_open > 0 AND day_volume > 0"""
ORACLE_SQL["left_join_lines"] = """
SELECT o_orderkey, count(l_orderkey) AS lines, max(l_quantity) AS largest
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"""
ORACLE_SQL["one_to_one_join"] = with_views(["stock_days"], """
SELECT half, count(*) AS rows, true AS carried_equal FROM stock_days WHERE known15 GROUP BY half""")
ORACLE_SQL["keyed_lookup"] = with_views(["stock_days"], """
SELECT date, count(*) AS rows, count(*) FILTER (score >= 48) AS hits FROM stock_days GROUP BY date""")
ORACLE_SQL["filtered_counts"] = with_views(["stock_days"], f"""
SELECT half, count(*) AS rows, count(*) FILTER (known15) AS known, count(*) FILTER (opportunity15 = 1) AS success,
  {r('avg(mark_0959_return15) FILTER (known15)', 'mean_mark')}, count(DISTINCT date) AS days, CAST(0 AS BIGINT) AS never,
  {r('count(*) FILTER (opportunity15 = 1) / nullif(count(*) FILTER (known15), 0)', 'rate')}, NULL::DOUBLE AS undefined_rate
FROM stock_days GROUP BY half""")
ORACLE_SQL["table_extent"] = with_views(["stock_days"], """
SELECT count(*) AS rows, min(date) AS first_date, max(date) AS last_date, min(code) AS first_code,
  count(*) FILTER (formula_input_valid) AS valid FROM stock_days""")
ORACLE_SQL["flag_aggregates"] = with_views(["stock_days"], """
SELECT date, bool_or(known_unfilled) AS any_unfilled, bool_and(known15) AS all_known,
  bool_and(opportunity15 = 1) AS all_success FROM stock_days GROUP BY date""")
ORACLE_SQL["extreme_rows"] = with_views(["stock_days"], """
SELECT half, arg_min(code, (strength, code)) AS lowest_code, arg_max(code, (strength, code)) AS highest_code,
  min(strength) AS lowest, max(strength) AS highest FROM stock_days GROUP BY half""")
ORACLE_SQL["list_sizes"] = with_views(["stock_days"], f"""
SELECT year, {r('median(n)', 'median_daily')}, max(n) AS max_daily, CAST(sum(n) AS BIGINT) AS rows
FROM (SELECT CAST(year(date) AS INTEGER) AS year, date, count(*) AS n FROM stock_days WHERE "left" GROUP BY ALL) GROUP BY year""")
ORACLE_SQL["centred_values"] = with_views(["stock_days"], f"""
SELECT date, code, {r('score - avg(score) OVER (PARTITION BY date)', 'centred')},
  {r('1 / count(*) OVER (PARTITION BY date)', 'weight')},
  {r('score / nullif(sum(score) OVER (PARTITION BY date), 0)', 'share')} FROM stock_days""")
ORACLE_SQL["lagged_rows"] = f"""
SELECT code, date, {r('lag(quantity) OVER w', 'previous')}, lag(returned, 1, false) OVER w AS previous_returned,
  count(quantity) OVER p AS prior_count, {r('CASE WHEN count(quantity) OVER p = 20 THEN sum(quantity) OVER p END', 'prior_sum')},
  {r('CASE WHEN count(quantity) OVER p = 20 THEN avg(quantity) OVER p END', 'prior_mean')},
  count(*) FILTER (returned) OVER q = 21 AS all_returned
FROM (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date,
        CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity, bool_or(l_returnflag <> 'R') AS returned
      FROM lineitem GROUP BY ALL)
WINDOW w AS (PARTITION BY code ORDER BY date),
  p AS (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
  q AS (PARTITION BY code ORDER BY date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)"""
ORACLE_SQL["scalar_functions"] = f"""
SELECT k, CAST(floor(p / 1000) AS INTEGER) AS thousands,
  {r('greatest(least(signed, 5), -5)', 'clipped', 8)}, {r('abs(signed)', 'magnitude', 8)}, abs(p - round(p, 2)) <= 0.0001 AS on_grid,
  {r('greatest(signed, 0, CASE WHEN k % 3 = 0 THEN 9 END)', 'row_max', 8)}, signed <> 0 AS finite_ratio,
  CASE WHEN signed > 0 THEN 'up' WHEN signed < 0 THEN 'down' ELSE 'flat' END AS direction,
  coalesce(nullif(k % 4, 0), -1) AS nonzero, CAST(signed > 0 AS INTEGER) AS is_up, {r('1e-6 + 5e-2 * signed', 'linear', 8)},
  CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
  year(d) || CASE WHEN month(d) > 6 THEN 'H2' ELSE 'H1' END AS half, year(d) || 'Q' || quarter(d) AS quarter,
  d - CAST(isodow(d) - 1 AS INTEGER) AS week, CAST(weekofyear(d) AS INTEGER) AS iso_week, CAST(isoyear(d) AS INTEGER) AS iso_year,
  k % 10 > 1 AS iso_text, lower(o_orderpriority) AS folded,
  CASE WHEN k % 2 = 0 THEN 'sh' ELSE 'sz' END || '_' || lpad(CAST(k AS VARCHAR), 8, '0') AS file_code,
  k % 2 = 0 AND k < 10000 AS prefixed, o_orderpriority LIKE '%IGH%' AS contained, {r('ln(1 + p)', 'log_price', 8)}
FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, o_totalprice AS p, o_orderkey AS k, (o_orderkey % 200 - 100) / 8 AS signed FROM orders)"""
ORACLE_SQL["dense_codes"] = with_views(["stock_days"], """
SELECT code, CAST(dense_rank() OVER (ORDER BY date) - 1 AS INTEGER) AS day_code FROM stock_days""")
ORACLE_SQL["key_gate"] = with_views(["stock_days"], """
SELECT "check", violations = 0 AS passed, violations FROM (
  SELECT 'domain_binary' AS "check", (SELECT count(*) FROM stock_days WHERE known15 AND opportunity15 NOT IN (0, 1)) AS violations
  UNION ALL SELECT 'domain_board', (SELECT count(*) FROM stock_days WHERE board <> 'main')
  UNION ALL SELECT 'date_bounds', (SELECT count(*) FROM stock_days WHERE date < DATE '1995-01-01' OR date >= DATE '1998-01-01')
  UNION ALL SELECT 'finite_when_known', (SELECT count(*) FROM stock_days WHERE known15 AND mark_0959_return15 IS NULL)
  UNION ALL SELECT 'states_exclusive', (SELECT count(*) FROM stock_days WHERE known15 AND known_unfilled)
  UNION ALL SELECT 'stock_day_key', (SELECT count(*) FROM (SELECT 1 FROM stock_days GROUP BY date, code HAVING count(*) > 1))
  UNION ALL SELECT 'line_key', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
  UNION ALL SELECT 'declared_valid', (SELECT abs(count(*) - 13000) FROM stock_days WHERE formula_input_valid)
  UNION ALL SELECT 'declared_rows', (SELECT abs(count(*) - 15000) FROM stock_days))""")
ORACLE_SQL["count_identity"] = """
SELECT "check", true AS passed, CAST(0 AS BIGINT) AS violations
FROM (SELECT unnest(['known_is_available_plus_missing', 'known_within_rows']) AS "check" FROM (SELECT min(o_orderkey) FROM orders))"""
ORACLE_SQL["frame_equality"] = with_views(["stock_days"], """
SELECT "check", violations = 0 AS passed, violations FROM (
  SELECT 'exact_same' AS "check", CAST(0 AS BIGINT) AS violations
  UNION ALL SELECT 'exact_changed', 2 * count(*) FROM stock_days WHERE code % 500 = 3
  UNION ALL SELECT 'close_same', 0
  UNION ALL SELECT 'close_changed', count(*) FROM stock_days WHERE code % 500 = 3)""")
ORACLE_SQL["ordered_output"] = with_views(
    ["stock_days"], "SELECT date, code, half FROM stock_days ORDER BY date, code")
