"""Lists, bounds, ranks and intervals against hand values and brute force."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.operators import bootstrap, compare, evaluation, ranking, selection
from barlab.operators.grouping import exact_quantiles, frame_difference, with_bands, with_day_stats

DAY = dt.date(2025, 1, 2)


def bounds_of(spark, rows):
    """rows: (left, right, known, outcome) of one day."""
    df = spark.createDataFrame(
        [(DAY, f"s{i}", *r, False) for i, r in enumerate(rows)],
        "date date, code string, left boolean, right boolean, known15 boolean, opportunity15 double, known_unfilled boolean")
    out = compare.coupled_bounds(df, [(15, False, "opportunity", "opportunity")]).collect()
    assert len(out) == 1
    return out[0]


def every_difference(rows):
    """Difference of the two lists' rates under every way to settle the unknown rows."""
    unknown = [i for i, r in enumerate(rows) if not r[2]]
    for bits in itertools.product((0.0, 1.0), repeat=len(unknown)):
        settled = dict(zip(unknown, bits))
        value = lambda i: rows[i][3] if rows[i][2] else settled[i]
        rate = lambda side: np.mean([value(i) for i, r in enumerate(rows) if r[side]])
        yield rate(0) - rate(1)


@pytest.mark.parametrize("seed", range(8))
def test_bounds_are_the_extremes_over_all_completions(spark, seed):
    g, rows = np.random.default_rng(seed), [(True, True, False, None), (False, True, True, 1.0)]
    for _ in range(9):
        known = bool(g.random() < 0.5)
        rows.append((bool(g.random() < 0.6), bool(g.random() < 0.6), known, float(g.random() < 0.4) if known else None))
    got, want = bounds_of(spark, rows), list(every_difference(rows))
    assert got["lower"] == pytest.approx(min(want)) and got["upper"] == pytest.approx(max(want))
    assert got["left_rows"] == sum(r[0] for r in rows) and got["right_rows"] == sum(r[1] for r in rows)
    assert got["shared_unknown"] == sum(r[0] and r[1] and not r[2] for r in rows)


def test_a_known_row_without_outcome_is_refused(spark):
    with pytest.raises(Exception, match="lacks opportunity15"):
        bounds_of(spark, [(True, True, True, None), (True, True, True, 1.0)])


def test_day_without_one_side_is_listed_not_bounded(spark):
    df = spark.createDataFrame(
        [(DAY, "a", True, False, True, 1.0, False)],
        "date date, code string, left boolean, right boolean, known15 boolean, opportunity15 double, known_unfilled boolean")
    assert compare.coupled_bounds(df, [(15, False, "opportunity", "opportunity")]).count() == 0
    assert compare.day_coverage(df).first()["coverage"] == "left_only"


def label_rows(spark, n=400, days=7, seed=3):
    g = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        known = bool(g.random() < 0.7)
        unfilled = bool(not known and g.random() < 0.5)
        v = lambda p: float(g.random() < p) if known else None
        # One day holds half of the rows.
        day = DAY + dt.timedelta(days=0 if g.random() < 0.5 else int(g.integers(1, days)))
        mark = float(g.normal(0, 0.02)) if known and g.random() < 0.9 else None
        rows.append((day, i, known, bool(known and g.random() < 0.8), unfilled, v(0.5), v(0.3), v(0.6), mark,
                     float(-abs(g.normal(0, 0.03))) if known else None, bool(g.random() < 0.3)))
    names = ("date code known15 sensitive_known15 known_unfilled opportunity15 one_percent15 any_opportunity15 "
             "mark_0959_return15 adverse_return15 selected").split()
    types = "date date, code long, known15 boolean, sensitive_known15 boolean, known_unfilled boolean, " + \
        ", ".join(f"{c} double" for c in names[5:10]) + ", selected boolean"
    return spark.createDataFrame(rows, types), pd.DataFrame(rows, columns=names)


@pytest.mark.parametrize("sensitive", [False, True])
def test_daily_counts_match_a_row_by_row_count(spark, sensitive):
    df, pdf = label_rows(spark)
    got = evaluation.finish_opportunity(
        evaluation.tally(df, ("date",), evaluation.OPPORTUNITY, ((15, sensitive),))).toPandas().set_index("date")
    assert got.rows.sum() == len(pdf)
    for day, g in pdf.groupby("date"):
        k = g.sensitive_known15 if sensitive else g.known15
        row = got.loc[day]
        unknown = (~k & ~g.known_unfilled).sum()
        assert (row.rows, row.known, row.unknown, row.unfilled) == (len(g), k.sum(), unknown, g.known_unfilled.sum())
        success = (k & (g.opportunity15 == 1)).sum()
        assert row.success == success and row.lower == success / len(g) and row.upper == (success + unknown) / len(g)
        if k.sum():
            assert row.rate == pytest.approx(success / k.sum())
            assert row.mean_reference == pytest.approx(g.mark_0959_return15[k].astype(float).mean())
            assert row.bad3 == pytest.approx((g.adverse_return15[k].astype(float) <= -0.03).mean())


def test_candidate_arm_covers_all_rows_of_signal_days(spark):
    df, pdf = label_rows(spark)
    cells = evaluation.tally(df, ("date", "selected"), evaluation.OPPORTUNITY, ((15, False),))
    out = evaluation.arms(cells, ("date", "bps", "sensitive")).toPandas()
    signal = set(pdf[pdf.selected].date)
    base = out[out.arm == "base_same_dates"].set_index("date").rows
    assert set(base.index) == signal
    assert all(base[d] == (pdf.date == d).sum() for d in signal)


def brute_auc(rows, label):
    hi = [s for s, y in zip(rows["score"], rows[label]) if y == 1]
    lo = [s for s, y in zip(rows["score"], rows[label]) if y == 0]
    wins = sum(2 if a > b else 1 if a == b else 0 for a in hi for b in lo)
    return len(hi) * len(lo), wins


@pytest.mark.parametrize("bands", [1, 6])
def test_auc_matches_all_pairs_with_ties(spark, bands):
    g = np.random.default_rng(5)
    pdf = pd.DataFrame({"date": [DAY + dt.timedelta(days=int(g.random() > 0.6)) for _ in range(300)],
                        "score": g.integers(0, 40, 300) / 4, "y": g.integers(0, 2, 300)})
    out = ranking.daily_auc(spark.createDataFrame(pdf), ["y"], bands=bands).toPandas().set_index("date")
    for day, rows in pdf.groupby("date"):
        pairs, wins = brute_auc(rows, "y")
        assert (out.y_pairs[day], out.y_numerator2[day]) == (pairs, wins)
        assert out.y_auc[day] == pytest.approx(wins / (2 * pairs))


@pytest.mark.parametrize("seed", [13, 14, 15])
def test_ordinal_auc_of_random_utilities(spark, seed):
    g = np.random.default_rng(seed)
    utility, score = g.choice([-3, 0, 1], 45), g.integers(0, 9, 45) / 2
    better = [(i, j) for i in range(45) for j in range(45) if utility[i] > utility[j]]
    wins = sum(1 + np.sign(score[i] - score[j]) for i, j in better)
    r = ranking.ordinal_auc(spark.createDataFrame(pd.DataFrame({"date": [DAY] * 45, "score": score, "utility": utility}))).first()
    assert (r["utility_pairs"], r["utility_numerator2"]) == (len(better), wins)


def test_ordinal_auc_of_a_day_with_one_utility(spark):
    flat = pd.DataFrame({"date": [DAY] * 4, "score": [4.5, 4.5, 7.0, -2.0], "utility": [-3] * 4})
    r = ranking.ordinal_auc(spark.createDataFrame(flat)).first()
    assert (r["rows"], r["utility_pairs"], r["utility_auc"]) == (4, 0, None)


@pytest.mark.parametrize("bands", [1, 7, 64])
def test_average_ranks(spark, bands):
    g = np.random.default_rng(8)
    pdf = pd.DataFrame({"date": [DAY] * 200 + [DAY + dt.timedelta(days=1)] * 30, "code": range(230),
                        "score": g.integers(0, 50, 230).astype(float)})
    out = ranking.average_ranks(spark.createDataFrame(pdf), bands=bands).toPandas().set_index("code")
    want = pdf.groupby("date").score.rank(method="average")
    assert np.allclose(out.average_rank.sort_index().to_numpy(), want.to_numpy())


def test_a_score_of_half_the_rows_is_spread_and_null_scores_have_no_rank(spark):
    n = 40000
    rows = spark.range(n).select(F.lit(DAY).alias("date"), F.col("id").alias("code"), F.expr(
        "case when id % 2 = 0 then 7.0 when id % 100 = 1 then null else cast(id as double) end").alias("score"))
    out = ranking.average_ranks(rows)
    got = {r["score"]: r for r in out.dropDuplicates(["score"]).collect()}
    below = sum(1 for i in range(1, 7, 2) if i % 100 != 1)
    assert out.count() == n and got[7.0]["rank"] == below + 1 and got[None]["average_rank"] is None
    same = n // 2 + 1
    assert got[7.0]["average_rank"] == below + (same + 1) / 2
    sizes = (rows.where("score is not null").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(ranking.SALTS)))
             .repartition(16, "date", "score", "_salt").groupBy(F.spark_partition_id()).count().toPandas()["count"])
    assert len(sizes) == 16 and sizes.max() <= 2 * sizes.median()


def test_bands_are_balanced_and_the_same_each_time(spark):
    cells = spark.range(20000).select((F.col("id") % 2).alias("g"), F.exp(F.col("id") / 900.0).alias("v"), F.lit(1).alias("c"))
    banded = with_bands(cells, "g", "v", 16)
    sizes = banded.groupBy("g", "_band").count().toPandas()
    assert len(sizes) == 32 and sizes["count"].max() < 3 * sizes["count"].median()
    ends = banded.groupBy("g", "_band").agg(F.min("v").alias("a"), F.max("v").alias("b")).toPandas().sort_values(["g", "_band"])
    for _, x in ends.groupby("g"):
        assert (x.a.to_numpy()[1:] > x.b.to_numpy()[:-1]).all()
    assert frame_difference(banded, with_bands(cells.repartition(5), "g", "v", 16)).count() == 0
    plan = exact_quantiles(cells, "v", [0.5], "g")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("bands", [1, 2, 7, 64])
def test_exact_quantiles_in_any_bands(spark, bands):
    g = np.random.default_rng(2)
    pdf = pd.DataFrame({"fold": ["hot"] * 3000 + ["small"] * 7 + ["one"],
                        "v": np.concatenate([np.round(g.normal(0, 1, 3000), 2), g.normal(5, 1, 7), [3.0]])})
    qs = [0.0, 0.25, 0.97, 0.995, 0.9995, 1.0]
    out = exact_quantiles(spark.createDataFrame(pdf), "v", qs, "fold", bands=bands).toPandas()
    assert len(out) == 3 * len(qs)
    for _, r in out.iterrows():
        assert r.threshold == pytest.approx(np.quantile(pdf.v[pdf.fold == r.fold], r.probability), abs=1e-12)


def weekly_formula(series, draws, seed):
    """Ratio of resampled sums over ISO weeks, with NumPy's draws."""
    frame = series.to_frame("value")
    iso = pd.to_datetime(pd.Series(frame.index)).dt.isocalendar()
    blocks = frame.groupby([iso.year.to_numpy(), iso.week.to_numpy()]).value.agg(["sum", "count"])
    picks = np.random.default_rng(seed).integers(len(blocks), size=(draws, len(blocks)))
    means = blocks["sum"].to_numpy()[picks].sum(1) / blocks["count"].to_numpy()[picks].sum(1)
    return np.quantile(means, [0.025, 0.975]), picks


def test_interval_equals_the_formula_with_given_draws(spark):
    g = np.random.default_rng(4)
    days = [dt.date(2024, 12, 20) + dt.timedelta(days=i) for i in range(60) if i % 7 not in (1, 2)]
    series = pd.Series(g.random(len(days)), index=days)
    want, picks = weekly_formula(series, 500, 20260926)
    n = picks.shape[1]
    table = spark.createDataFrame(
        [(n, d, int(p)) for d, row in enumerate(picks) for p in row], "n_blocks long, draw int, pick int")
    daily = spark.createDataFrame([("x", d, float(v)) for d, v in series.items()], "grp string, date date, value double")
    r = bootstrap.block_intervals(daily, ("grp",), ("value",), 500, table).first()
    assert np.allclose([r["value_ci_low"], r["value_ci_high"]], want, atol=2e-12, rtol=0)


def test_counter_draws_are_uniform_and_intervals_close_to_numpy(spark):
    g = np.random.default_rng(6)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(364)]
    series = pd.Series(g.random(364), index=days)
    want, _ = weekly_formula(series, 4000, 1)
    daily = spark.createDataFrame([("x", d, float(v)) for d, v in series.items()], "grp string, date date, value double")
    r = bootstrap.block_intervals(daily, ("grp",), ("value",), 4000).first()
    assert r["weeks"] == 52
    assert np.allclose([r["value_ci_low"], r["value_ci_high"]], want, atol=0.003)


def test_no_interval_for_gaps_or_a_single_week(spark):
    rows = [("gap", DAY, 1.0), ("gap", DAY + dt.timedelta(days=7), None), ("one", DAY, 1.0),
            ("ok", DAY, 1.0), ("ok", DAY + dt.timedelta(days=7), 2.0)]
    out = bootstrap.block_intervals(
        spark.createDataFrame(rows, "grp string, date date, value double"), ("grp",), ("value",), 50).collect()
    low = {r["grp"]: r["value_ci_low"] for r in out}
    assert low["gap"] is None and low["one"] is None and low["ok"] is not None


def test_duplicate_lists_point_at_the_first_and_need_equal_content(spark):
    rows = [(i, DAY, c, 1) for i in ("b", "a", "c") for c in ("x", "y", None)]
    rows += [("d", DAY, c, 1) for c in ("x", "y", "z")] + [("e", DAY, c, 1) for c in ("x", "x", "y")]
    df = spark.createDataFrame(rows, "list_id string, date date, code string, n int")
    out = {r["list_id"]: r["alias_of"] for r in selection.duplicate_lists(df, ("date", "code", "n")).collect()}
    assert out == {"a": None, "b": "a", "c": "a", "d": None, "e": None}


def test_frame_difference_counts_copies_and_nulls(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    assert {(r["k"], r["surplus"]) for r in frame_difference(a, b).collect()} == {(1, 1), (3, -1)}


def test_day_statistics_keep_every_row(spark):
    df = spark.createDataFrame([(DAY, 1.0), (DAY, 3.0), (DAY + dt.timedelta(days=1), 5.0)], "date date, v double")
    out = with_day_stats(df, F.avg("v").alias("m")).collect()
    assert sorted((r["v"], r["m"]) for r in out) == [(1, 2), (3, 2), (5, 5)]


def test_counter_draws_follow_their_rule():
    from hashlib import md5

    table = bootstrap.counter_numbers(3, 4, 5)
    assert table.tolist() == [[int(md5(f"{d}:{s}".encode()).hexdigest()[:8], 16) for s in range(1, 6)] for d in range(3, 7)]
    assert (bootstrap.counter_numbers(1, 6, 64)[2:, :5] == table).all()
    counts = bootstrap.draw_counts(table % 3, 3)
    assert counts.sum(1).tolist() == [5] * 4 and counts[0].tolist() == [int((table[0] % 3 == k).sum()) for k in range(3)]


def test_many_weeks_give_the_same_interval_in_pieces(spark, monkeypatch):
    days = [dt.date(2000, 1, 3) + dt.timedelta(days=7 * i) for i in range(450)]
    df = spark.createDataFrame([(d, "g", float(i % 13)) for i, d in enumerate(days)], "date date, k string, v double")
    got = bootstrap.block_intervals(df, ["k"], ["v"], draws=3000).first()
    picks = bootstrap.counter_numbers(1, 3000, 450) % 450
    means = (np.arange(450) % 13).astype(float)[picks].mean(1)
    assert [got["v_ci_low"], got["v_ci_high"]] == pytest.approx(np.quantile(means, [0.025, 0.975]).tolist()) and got["weeks"] == 450
    assert 60 * 450 <= bootstrap.SMALL < 3000 * 450
    few = bootstrap.block_intervals(df, ["k"], ["v"], draws=60).first()         # kept as a whole; the others go in pieces
    assert few["v_ci_high"] == pytest.approx(np.quantile(means[:60], 0.975))
    again = bootstrap.block_intervals(df, ["k"], ["v"]).first()
    picks = np.concatenate([bootstrap.counter_numbers(1 + ROW, 2000, 450) for ROW in range(0, 10_000, 2000)]) % 450
    assert again["v_ci_low"] == pytest.approx(np.quantile((np.arange(450) % 13).astype(float)[picks].mean(1), 0.025))


def test_periods_without_days_show_zero_and_days_beyond_the_study_stay(spark):
    daily = spark.createDataFrame([(DAY + dt.timedelta(days=i), 5, False, 2, float(i)) for i in range(0, 30, 3)] + [
        (dt.date(2030, 1, 1), 5, False, 1, None)], "date date, bps int, sensitive boolean, rows long, rate double")
    spine = evaluation.period_spine(spark, "2024-12-01", "2025-07-02")
    out = evaluation.period_summary(daily, ("bps", "sensitive"), ("rows",), ("rate",), intervals=("rate",), spine=spine)
    got = {(r["bps"], r["sensitive"], r["period"]): r for r in out.collect()}
    assert {p for _, _, p in got} == {"2024", "2024H2", "2025", "2025H1", "2025H2", "2030", "2030H1"} and len(got) == 4 * 5 + 2
    hit, empty, later = got[(5, False, "2025H1")], got[(15, True, "2025H1")], got[(5, False, "2030")]
    assert (hit["days"], hit["rows"], hit["rate"]) == (10, 20, 13.5) and hit["rate_ci_low"] < 13.5 < hit["rate_ci_high"]
    assert (empty["days"], empty["rows"], empty["rate"], empty["rate_ci_low"]) == (0, 0, None, None)
    assert (later["days"], later["rate"], later["rate_ci_low"]) == (1, None, None)
