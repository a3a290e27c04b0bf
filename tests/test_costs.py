"""Dated fees, break-even quotes and labels at two costs against plain walks."""

import datetime as dt

import numpy as np
import pytest

from barlab.operators import costs, evaluation

D = dt.date
FEES = (costs.Fee("sh", "2020-01-01", 0.001, 0.002, 5.0), costs.Fee("sh", "2021-01-01", 0.0, 0.001, 0.0), costs.Fee("sz", "2020-06-01", 0.0005, 0.0005, 1.0))
ENTRY = "code int, market string, date date, next_date date, entry_price double, decision_shares long, capacity long"


def charged(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ENTRY)
    return [r for _, r in sorted((r["code"], r) for r in costs.round_trip(df, FEES).collect())]


def side(price, shares, rate, minimum, bps, sign):
    """Money paid (sign 1) or received (-1) for the shares at a quote."""
    money = shares * (price + sign * max(price * bps / 10_000, 0.005))
    return money + sign * max(rate * money, minimum)


def test_fees_hold_from_their_day_on_each_side(spark):
    rows = [("sh", D(2020, 5, 4), D(2020, 5, 5), 10.0, 1000, 1000), ("sh", D(2020, 12, 31), D(2021, 1, 4), 10.0, 1000, 5000),
            ("sh", D(2021, 1, 1), D(2021, 1, 4), 10.0, 1000, 5000), ("sz", D(2020, 5, 31), D(2020, 6, 1), 10.0, 1000, 5000), ("bj", D(2022, 1, 1), D(2022, 1, 2), 10.0, 100, 500)]
    got = charged(spark, rows)
    assert [r["cost15"] for r in got[:3]] == pytest.approx([side(10.0, 1000, 0.001, 5, 15, 1)] * 2 + [side(10.0, 1000, 0.0, 0, 15, 1)])
    sells = [(0.002, 5), (0.001, 0), (0.001, 0)]
    for r, (rate, minimum) in zip(got, sells):
        for b in (5, 15):
            assert side(r[f"break_even{b}"], 1000, rate, minimum, b, -1) == pytest.approx(r[f"cost{b}"], abs=1e-6)
    assert [(r["entry_state"], r["cost5"]) for r in got[3:]] == [("filled", None)] * 2      # no schedule yet: unknown, not free


@pytest.mark.parametrize("seed", range(4))
def test_both_sides_cancel_at_the_break_even_quote(spark, seed):
    g = np.random.default_rng(seed)
    rows = [("sh", D(2020, 5, 4), D(2020, 5, 5), float(np.round(g.uniform(0.5, 60), 2)), int(g.integers(1, 90)) * 100, 10 ** 6) for _ in range(40)]
    for (_, _, _, price, shares, _), r in zip(rows, charged(spark, rows)):
        for b in (5, 15):
            assert r[f"cost{b}"] == pytest.approx(side(price, shares, 0.001, 5, b, 1))
            assert side(r[f"break_even{b}"], shares, 0.002, 5, b, -1) == pytest.approx(r[f"cost{b}"], abs=1e-6)


def test_capacity_leads_to_the_unfilled_state(spark):
    day = (D(2020, 5, 4), D(2020, 5, 5))
    got = charged(spark, [("sh", *day, 10.0, 1000, 999), ("sh", *day, 10.0, 0, 999), ("sh", *day, None, 100, 999), ("sh", *day, 10.0, 100, None)])
    assert [r["entry_state"] for r in got] == ["unfilled", "none", "none", "unfilled"] and all(r["cost5"] is None and r["break_even15"] is None for r in got)


def walk(bars, even, entry, expected):
    """(known, sensitive, positive end, space end, first adverse, any) of one entry at one cost."""
    run, space, pos, wide, bad, touched = 0, 0, -1, -1, -1, 0
    for k, low, close, volume in sorted(bars):
        good = volume > 0 and close > even
        run, space = (run + 1 if good else 0), (space + 1 if volume > 0 and close > even * 1.01 else 0)
        pos, wide = (k if run >= 3 and pos < 0 else pos), (k if space >= 3 and wide < 0 else wide)
        bad = k if low <= entry * 0.97 and bad < 0 else bad
        touched |= good
    known = len(bars) == expected
    return known, known and all(v > 0 for *_, v in bars), pos, wide, bad, touched


def test_labels_of_two_costs_equal_a_plain_walk_and_feed_the_daily_statistics(spark):
    g = np.random.default_rng(5)
    rows, held = [], {}
    for code in range(120):
        even = (round(10 + float(g.uniform(0, 0.1)), 3), round(10.1 + float(g.uniform(0, 0.1)), 3))
        state = ("filled", "filled", "filled", "unfilled", "none")[code % 5]
        if state != "filled":
            even = (None, None)
        count = 8 if g.random() < 0.8 else int(g.integers(0, 8))
        bars = [(k, float(np.round(g.normal(10.0, 0.25), 2)), float(np.round(g.normal(10.15, 0.15), 2)), int(g.random() < 0.95) * 7) for k in range(count)]
        held[code] = (state, even, bars)
        for k, low, close, volume in bars or [(None,) * 4]:
            rows.append((D(2020, 5, 4), code, D(2020, 5, 5), "sh", state, 100, 10.0, *even, k, low, close, volume))
    df = spark.createDataFrame(rows, "date date, code int, next_date date, market string, entry_state string, decision_shares long, entry_price double, "
                                     "break_even5 double, break_even15 double, offset int, low double, close double, volume long")
    labels = costs.labels_at_costs(df, 8)
    got = {r["code"]: r for r in labels.collect()}
    assert set(got) == set(held)
    for code, (state, even, bars) in held.items():
        r = got[code]
        assert r["known_unfilled"] == (state == "unfilled") and r["seen_bars"] == len(bars)
        for b, e in zip((5, 15), even):
            if state != "filled" or len(bars) < 8:
                assert not r[f"known{b}"] and not r[f"sensitive_known{b}"] and r[f"opportunity{b}"] is None and r[f"first_bad3{b}"] is None
                continue
            known, sensitive, pos, wide, bad, touched = walk(bars, e, 10.0, 8)
            assert (r[f"known{b}"], r[f"sensitive_known{b}"]) == (known, sensitive)
            assert (r[f"first_positive_end{b}"], r[f"first_bad3{b}"], r[f"opportunity{b}"], r[f"one_percent{b}"]) == (pos, bad, float(pos >= 0), float(wide >= 0))
            assert r[f"any_opportunity{b}"] == float(touched) and r[f"positive_before_bad3{b}"] == float(pos >= 0 and (bad < 0 or pos < bad))
            assert r[f"mark_0959_return{b}"] == pytest.approx(bars[-1][2] / e - 1)
    day = evaluation.daily_opportunity(labels).where("bps = 15 and not sensitive").first()
    assert day["rows"] == 120 and day["unfilled"] == 24 and day["known"] == sum(s == "filled" and len(b) == 8 for s, _, b in held.values())
