"""Readers, identity, fingerprints, contracts and sinks."""

import datetime as dt
import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.operators import contracts
from barlab.sources import tables as src


def test_columns_that_differ_by_case_keep_their_own_values(spark, tmp_path):
    names = ["load", "Load", "LOAD", "other"]
    pd.DataFrame([[i * 10 + k for k in range(4)] for i in range(5)], columns=names).to_parquet(tmp_path / "cases.parquet")
    wanted = {"Load": "b", "LOAD": "c", "load": "a", "other": "d"}
    df = src.case_distinct(spark, str(tmp_path / "cases.parquet"), wanted)
    rows = df.join(spark.createDataFrame([(21,), (41,)], "b long"), "b").orderBy("a").collect()
    assert [(r["a"], r["b"], r["c"], r["d"]) for r in rows] == [(20, 21, 22, 23), (40, 41, 42, 43)]
    assert spark.conf.get("spark.sql.caseSensitive") == "false"
    assert contracts.case_collisions(names) == ["LOAD", "Load", "load"]


@pytest.mark.parametrize(("paths", "codes"), [
    (["x/y/SZ/300999.parquet", "q/SH/688123.parquet"], {"sz.300999", "sh.688123"}), (["w/SH/601111.parquet"], {"sh.601111"})])
def test_identity_is_folder_and_file(spark, paths, codes):
    found = src.source_mapping(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert {r["code"] for r in found.collect()} == codes


@pytest.mark.parametrize("paths", [["u/SZ/002222.parquet", "v/SZ/002222.parquet"], ["u/NY/002222.parquet"], ["u/SH/readme.parquet"]])
def test_identity_refuses_twice_named_and_unknown(spark, paths):
    with pytest.raises(contracts.ContractError):
        src.source_mapping(spark.createDataFrame([(p,) for p in paths], "path string"))


def test_entity_scan_reads_all_codes_at_once(spark, tmp_path):
    for ex, code in (("SH", "600000"), ("SZ", "000001")):
        (tmp_path / ex).mkdir()
        pd.DataFrame({"close": [1.0, 2.0]}).to_parquet(tmp_path / ex / f"{code}.parquet")
    out = src.entity_scan(spark, str(tmp_path)).groupBy("code").count().collect()
    assert {(r["code"], r["count"]) for r in out} == {("sh.600000", 2), ("sz.000001", 2)}


def test_fingerprints_detect_tampering_and_conflicts(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.bin").write_bytes(n.encode() * 100_000)
    found = src.fingerprints(src.file_listing(spark, str(tmp_path), "*.bin"))
    digests = {r["path"]: r["sha256"] for r in found.collect()}
    assert set(digests.values()) == {hashlib.sha256(n.encode() * 100_000).hexdigest() for n in ("a", "b")}
    manifest = spark.createDataFrame([(p, d) for p, d in digests.items()], "path string, sha256 string")
    (tmp_path / "b.bin").write_bytes(b"changed")
    again = src.fingerprints(src.file_listing(spark, str(tmp_path), "*.bin"))
    out = {r["path"][-5:]: r["matches"] for r in src.fingerprint_check(again, manifest).collect()}
    assert out == {"a.bin": True, "b.bin": False}
    twice = manifest.unionByName(manifest.withColumn("sha256", F.lit("0")).limit(1))
    assert src.manifest_conflicts(twice).count() == 1


def test_results_are_never_replaced(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "k int, v double")
    src.write_table(df, str(tmp_path / "t"))
    assert any(f.name.endswith(".zstd.parquet") for f in (tmp_path / "t").iterdir())
    with pytest.raises(Exception, match="(?i)already exists"):
        src.write_table(df, str(tmp_path / "t"))


def test_report_writes_null_for_missing_and_nan(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None), ("c", float("nan")), ("d", float("inf"))], "k string, v double")
    src.write_report(df, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("*.json"))
    assert "NaN" not in text and "Infinity" not in text and text.count('"v":null') == 3
    back = {r["k"]: r["v"] for r in src.read_report(spark, str(tmp_path / "r"), "k string, v double").collect()}
    assert back == {"a": 1.5, "b": None, "c": None, "d": None}


def test_stitch_refuses_a_changed_overlap(spark):
    day = lambda m: dt.date(2024, m, 1)
    older = spark.createDataFrame([(day(1), 1.0), (day(2), 2.0)], "date date, v double")
    newer = spark.createDataFrame([(day(2), 2.0), (day(3), 3.0)], "date date, v double")
    assert src.stitch(older, newer, "2024-02-01", "2024-03-01").count() == 3
    with pytest.raises(contracts.ContractError):
        src.stitch(older, newer.withColumn("v", F.col("v") + 1), "2024-02-01", "2024-03-01")


def test_multi_period_scan(spark, tmp_path):
    rows = [(dt.date(2024, m, 1), m, 0) for m in range(1, 7)]
    spark.createDataFrame(rows, "date date, k int, unused int").write.parquet(str(tmp_path / "p"))
    parts = [{"file": str(tmp_path / "p"), "first": a, "end": b} for a, b in (("2024-01-01", "2024-03-01"), ("2024-05-01", "2024-06-01"))]
    assert sorted(r["k"] for r in src.multi_period(spark, parts, ["date", "k"]).collect()) == [1, 2, 5]


def test_one_to_one_join_refuses_repeated_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, 0.5)], "k int, b double")
    assert contracts.one_to_one(a, b, ["k"], "left").count() == 2
    with pytest.raises(contracts.ContractError, match="right_key"):
        contracts.one_to_one(a, b.unionByName(b), ["k"])


def test_tolerance_treats_missing_pairs_as_equal(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-13), (2, None)], "k int, v double")
    assert contracts.tolerance_check(a, b, ["k"], ["v"], 2e-12).first()["passed"]
    assert not contracts.tolerance_check(a, b.fillna(0.0), ["k"], ["v"], 2e-12).first()["passed"]


def test_folders_that_no_busy_month_needs_are_not_read_and_a_moved_file_is_seen(spark, tmp_path):
    from barlab.plans import basics

    out = basics.partitioned_round_trip(spark, "/root/testdata/sf0.001")
    found = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and sum(r["misplaced"] for r in found) == 0
    read = int(out.agg(F.sum("lines")).first()[0])
    assert 0 < read < spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "code string, v int").withColumn("holds", F.col("code"))
    path = str(tmp_path / "codes")
    src.write_partitioned(rows, path, "code")
    with pytest.raises(Exception, match="already exists"):
        src.write_partitioned(rows, path, "code")
    (tmp_path / "codes" / "code=b").rename(tmp_path / "codes" / "code=c")
    off = src.scan(spark, path).withColumn("off", src.misplaced("code", F.col("holds")))
    assert sorted((r["holds"], r["code"], r["off"]) for r in off.collect()) == [("a", "a", False), ("b", "c", True), ("b", "c", True)]
