"""Bar features on minute bars with the real clocks, against plain pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.operators import bars as B
from barlab.operators.grouping import chunk_window, own_rows, row_chunks

CLOCKS = B.Clocks()
SLOTS = [930] + list(B.minute_clocks(931, 1130)) + list(B.minute_clocks(1301, 1457)) + [1500]
DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(24)]


def minute_bars(seed=1):
    g = np.random.default_rng(seed)
    rows = []
    for code in ("sh.600000", "sz.000001"):
        price = 10.0
        for day in DAYS:
            for slot in SLOTS:
                o = price
                price = max(1.0, round(price + g.integers(-3, 4) / 100, 2))
                v = int(g.integers(1, 500))
                rows.append((code, day, slot, o, max(o, price) + 0.01, min(o, price) - 0.01, price, v, price * v * 100))
    return pd.DataFrame(rows, columns="code date slot open high low close volume amount".split())


@pytest.fixture(scope="module")
def minute():
    return minute_bars()


@pytest.fixture(scope="module")
def table(spark, minute):
    df = spark.createDataFrame(minute)
    index = df.groupBy("date", "slot").agg((F.avg("close") * 300).alias("index_close"))
    shares = df.select("code", "date").distinct().withColumn("float_shares", F.lit(5e8) + F.dayofmonth("date") * 1e6)
    # The official prior close differs from the last close on the last day, as after a reset.
    days = B.day_context(B.day_bars(df, CLOCKS)).select("code", "date", "dcp1")
    official = days.select("code", "date", F.when(F.col("date") == F.lit(DAYS[-1]), F.col("dcp1") * 0.8).otherwise(F.col("dcp1")).alias("preclose"))
    return B.feature_table(df, index, shares, official, CLOCKS).toPandas()


def test_fifty_features_and_the_clock_list(table):
    assert len(B.ALL_FEATURES) == len(set(B.ALL_FEATURES)) == 50
    assert len(CLOCKS.session) == 228 and CLOCKS.session[0] == 931 and CLOCKS.session[-1] == 1448
    last = table[table.date == DAYS[-1]]
    assert len(last) == 2 and last.formula_input_valid.all() and last.clock_ok.all()
    assert not table[table.date == DAYS[3]].formula_input_valid.any()


def test_feature_values(table, minute):
    code, day = "sz.000001", DAYS[-1]
    own = minute[minute.code == code].sort_values(["date", "slot"]).reset_index(drop=True)
    i = own.index[(own.date == day) & (own.slot == 1449)][0]
    back = lambda n, skip=0: own.iloc[i - n - skip + 1:i - skip + 1]
    days = own.groupby("date").agg(close=("close", "last"), high=("high", "max"), low=("low", "min"),
                                   volume=("volume", "sum"), open=("open", "first"))
    prev = days.close.shift()
    tr = pd.concat([days.high - days.low, (days.high - prev).abs(), (days.low - prev).abs()], axis=1).max(axis=1)
    earlier = days.iloc[:-1]
    q, c1 = own.close[i], earlier.close.iloc[-1]
    vp20 = 100 * tr.iloc[-21:-1].mean() / c1
    official = c1 * 0.8
    today = own[(own.date == day) & (own.slot <= 1449)]
    at = lambda s: own.close[(own.date == day) & (own.slot == s)].iloc[0]
    t = back(29)
    diff = own.close.diff()
    up = diff.iloc[i - 28:i + 1]
    signed = (np.sign(up) * t.volume).sum()
    logs = np.abs(np.log(own.close / own.close.shift())).iloc[i - 28:i + 1].sum()
    morning = own[(own.date == day) & (own.slot <= 1130)]
    index = minute.groupby(["date", "slot"]).close.mean() * 300
    iclose = index.groupby("date").last()
    want = {
        "NA01": 100 * (q / official - 1) / vp20, "NA03": 100 * (q / days.open.iloc[-1] - 1) / vp20,
        "NA05": 100 * (q / at(1420) - 1) / vp20, "NA07": 100 * (at(1420) / at(1301) - 1) / vp20,
        "A08": t.volume.sum() / back(29, 29).volume.sum(), "A09": back(14).volume.sum() / back(14, 14).volume.sum(),
        "A10": (back(4).volume.sum() / 4) / ((t.volume.sum() - back(4).volume.sum()) / 25),
        "A11": 100 * (q - t.low.min()) / max(t.high.max() - t.low.min(), 0.01), "A12": t.amount.sum() / 1e8,
        "NA13": 100 * (q / (t.amount.sum() / (100 * t.volume.sum())) - 1) / vp20,
        "NA14": 100 * (q / (back(4).amount.sum() / (100 * back(4).volume.sum())) - 1) / vp20,
        "A15": 100 * signed / t.volume.sum(), "A16": 100 * (up > 0).sum() / 29,
        "A17": 100 * t.volume.max() / t.volume.sum(), "NA18": 100 * (q / back(109).high.max() - 1) / vp20,
        "NA19": 100 * (back(109).high.max() - back(109).low.min()) / official / vp20,
        "A20": 100 * abs(np.log(q / own.close[i - 29])) / max(logs, 1e-6),
        "ND02": 100 * (c1 / earlier.close.iloc[-21] - 1) / vp20, "ND03": 100 * (q / earlier.close.iloc[-5:].mean() - 1) / vp20,
        "C01": 100 * (q - today.low.min()) / max(today.high.max() - today.low.min(), 0.01),
        "NC04": 100 * (min(days.open.iloc[-1], q) - today.low.min()) / c1 / vp20,
        "C05": today.volume.sum() / earlier.volume.iloc[-5:].mean(), "C06": today.amount.sum() / 1e8,
        "NC07": 100 * (q / earlier.high.iloc[-20:].max() - 1) / vp20, "V01": vp20,
        "I02": 100 * (iclose.iloc[-2] / iclose.iloc[-7] - 1), "I04": 100 * (iclose.iloc[-2] / iclose.iloc[-21:-1].mean() - 1),
        "J01": 100 * (index[(day, 1448)] / iclose.iloc[-2] - 1), "J04": 100 * (index[(day, 1420)] / index[(day, 1301)] - 1),
        "S02": 10000 * today.volume.sum() / (5e8 + 23e6), "S01": np.log(1 + (5e8 + 23e6) * q / 1e8),
        "S03": 10000 * t.volume.sum() / (5e8 + 23e6),
        "AMHD": 100 * (q / morning.high.max() - 1) / vp20, "AMLD": 100 * (q / morning.low.min() - 1) / vp20,
    }
    want["R01"] = (100 * (q / official - 1) - want["J01"]) / vp20
    got = table[(table.code == code) & (table.date == day)].iloc[0]
    for name, value in want.items():
        assert got[name] == pytest.approx(value, rel=1e-9, abs=1e-9), name


def test_missing_clock_fails_the_guard(spark, minute):
    day = DAYS[-1]
    cut = minute[~((minute.date == day) & (minute.slot == 1000))]
    guard = B.clock_guard(spark.createDataFrame(cut), CLOCKS).where(F.col("date") == F.lit(day)).collect()
    assert all(not r["clock_ok"] and r["matched_clocks"] == 227 for r in guard)


def test_price_path(spark, minute):
    bars = spark.createDataFrame(minute)
    r = B.price_path(bars, CLOCKS, B.day_context(B.day_bars(bars, CLOCKS))).where(
        (F.col("code") == "sh.600000") & (F.col("date") == F.lit(DAYS[-1]))).first()
    own = minute[(minute.code == "sh.600000")].sort_values(["date", "slot"]).reset_index(drop=True)
    i = own.index[(own.date == DAYS[-1]) & (own.slot == 1449)][0]
    cents = (own.close * 100).round().astype(int)
    assert r["path_ok"] and [r[f"path_{k:02d}"] for k in range(30)] == [cents[i - k] - cents[i] for k in range(30)]


@pytest.mark.parametrize("chunk_rows", [7, 50, 10**6])
def test_chunked_frames_equal_whole_frames(spark, chunk_rows):
    g = np.random.default_rng(9)
    rows = []
    for code, n in (("hot", 400), ("cold", 9), ("one", 1)):     # one code holds nearly everything
        for k in range(n):
            rows.append((code, dt.date(2024, 1, 1) + dt.timedelta(days=k // 5), k % 5 + int(k % 5 > 2), float(g.integers(0, 99))))
    pdf = pd.DataFrame(rows, columns=["code", "date", "slot", "x"])
    w = chunk_window("code")
    chunks = row_chunks(spark.createDataFrame(pdf), "code", "date", ["slot"], 5, chunk_rows)
    out = own_rows(chunks.select(
        "code", "date", "slot", "_own", "_chunk", "_seq", B.rolling_sum(F.col("x"), 5, w).alias("s"),
        B.ref(F.col("x"), 5, w).alias("r"))).toPandas().sort_values(["code", "date", "slot"])
    pdf = pdf.sort_values(["code", "date", "slot"])
    grouped = pdf.groupby("code").x
    assert len(out) == len(pdf)
    np.testing.assert_allclose(out.s, grouped.transform(lambda v: v.rolling(5).sum()), equal_nan=True)
    np.testing.assert_allclose(out.r, grouped.shift(5), equal_nan=True)


def test_candidates(spark):
    rows = [("600000", "GOOD", 1.0, 5), ("600001", "*ST BAD", 1.0, 5), ("688001", "STAR", 1.0, 5),
            ("300001", "GROWTH", 1.0, 5), ("920001", "NORTH", 1.0, 5), ("600002", "HALTED", 0.0, 0), ("600003", "MEMBER", 1.0, 5)]
    df = spark.createDataFrame(rows, "code string, name string, day_open double, day_volume long")
    growth = spark.createDataFrame([("600003",)], "code string")
    assert [r["code"] for r in B.candidates(df, ["92", "688", "30"], "ST", growth).collect()] == ["600000"]
