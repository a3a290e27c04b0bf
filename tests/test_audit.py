"""Reference-price states against a plain walk over random days."""

import datetime as dt
import math

import numpy as np
import pytest

from barlab.operators.audit import look_ahead, reference_states
from barlab.plans.prices import leaking_states

FIELDS = "date code open high low close preclose volume tradestatus adjustflag".split()
TYPES = ("date date, code string, open double, high double, low double, close double, preclose double, volume long, "
         "tradestatus int, adjustflag int")


def walk_prices(seed, days=140):
    """A code's days on the cent grid: some suspended, some flawed, some with an official close of their own."""
    g, rows, close = np.random.default_rng(seed), [], 20.0
    for i in range(days):
        official = close if g.random() < 0.9 else round(close * 0.93, 2)
        opened, close = (round(official + float(x), 2) for x in g.normal(0, 0.2, 2))
        high, low = round(max(opened, close) + 0.07, 2), round(min(opened, close) - 0.04, 2)
        volume, flag = 500, 3
        flaw = g.integers(0, 160)
        if flaw == 0:
            high = round(low - 1, 2)
        elif flaw == 1:
            volume = 0
        elif flaw == 2:
            flag = 1
        elif flaw == 3:
            official = math.nan
        elif flaw == 4:
            close = close + 0.004
        rows.append((dt.date(2021, 3, 1) + dt.timedelta(days=i), f"c{seed}", opened, high, low, close, official, volume,
                     int(g.random() < 0.95), flag))
    return rows


def sound(r):
    prices = [r["open"], r["high"], r["low"], r["close"]]
    return (r["adjustflag"] == 3 and r["volume"] > 0 and all(p > 0 and abs(p - round(p, 2)) <= 1e-4 for p in prices)
            and max(prices) <= r["high"] + 1e-4 and min(prices) >= r["low"] - 1e-4)


def expected(rows):
    days = [dict(zip(FIELDS, r)) for r in rows]
    days = [d for d in days if d["tradestatus"] == 1]
    spread = lambda d, base: max(d["high"] - d["low"], abs(d["high"] - base), abs(d["low"] - base))
    for i, d in enumerate(days):
        before = days[i - 1] if i else None
        d["sound"] = sound(d)
        d["usable"] = bool(before) and d["sound"] and before["sound"] and d["preclose"] > 0
        d["reset"] = abs(d["preclose"] - before["close"]) > 0.005 if d["usable"] else None
        d["raw"] = spread(d, before["close"]) if before else d["high"] - d["low"]
        d["official"] = spread(d, d["preclose"]) if d["usable"] else None
    out = {}
    for i, d in enumerate(days):
        window, longer = days[max(0, i - 20):i], days[max(0, i - 21):i]
        usable = [w for w in window if w["usable"]]
        out[d["date"]] = (
            d["usable"], d["reset"], len(usable), sum(w["reset"] for w in usable) if len(usable) == 20 else None,
            sum(w["raw"] for w in window) / 20 if len(window) == 20 else None,
            sum(w["official"] for w in usable) / 20 if len(usable) == 20 else None,
            len(longer) == 21 and all(w["sound"] for w in longer))
    return out


NAMES = "reference_good reset prior_reference_count prior_reset_count atr_raw atr_reference history_price_good".split()


@pytest.fixture(scope="module")
def both(spark):
    rows = {s: walk_prices(s) for s in range(6)}
    df = spark.createDataFrame([r for part in rows.values() for r in part], TYPES)
    got = {}
    for r in reference_states(df).collect():
        got.setdefault(int(r["code"][1:]), {})[r["date"]] = tuple(r[n] for n in NAMES)
    return rows, got


@pytest.mark.parametrize("seed", range(6))
def test_states_equal_a_plain_walk(both, seed):
    rows, got = both
    want = expected(rows[seed])
    assert set(got[seed]) == set(want)
    for day, values in want.items():
        assert got[seed][day][:4] == values[:4] and got[seed][day][6] == values[6]
        for a, b in zip(got[seed][day][4:6], values[4:6]):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-12))


def test_the_walks_reach_every_state(both):
    rows, _ = both
    found = [v for part in rows.values() for v in expected(part).values()]
    assert {v[1] for v in found} == {True, False, None} and {v[6] for v in found} == {True, False}
    assert any(v[3] for v in found) and any(v[3] is None and v[4] is not None for v in found)


def test_states_do_not_depend_on_later_days(spark, both):
    rows, got = both
    cut = 70
    early = {r["date"]: tuple(r[n] for n in NAMES) for r in reference_states(spark.createDataFrame(rows[2][:cut], TYPES)).collect()}
    assert early == {day: got[2][day] for day in early}


def test_a_repeated_date_is_refused_and_a_leak_is_found(spark):
    rows = walk_prices(3)
    df = spark.createDataFrame(rows, TYPES)
    active = [r for r in rows if r[FIELDS.index("tradestatus")] == 1]
    with pytest.raises(Exception, match="stands twice"):
        reference_states(spark.createDataFrame([*rows, active[5]], TYPES)).select("date").collect()
    cut = active[60][0].isoformat()
    own, leak = look_ahead(df, reference_states, cut).first(), look_ahead(df, leaking_states, cut).first()
    assert (own["compared"], own["changed"]) == (61, 0) and (leak["compared"], leak["changed"]) == (61, 1)


def test_queries_bound_what_one_task_reads_and_merges(spark):
    from barlab.plans.views import daily
    daily(spark, "/root/testdata/sf0.001")
    size = lambda key: {"16m": 16 << 20}.get(spark.conf.get(key), 1 << 40)
    assert size("spark.sql.adaptive.advisoryPartitionSizeInBytes") <= 16 << 20 and size("spark.sql.files.maxPartitionBytes") <= 16 << 20
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 1024
