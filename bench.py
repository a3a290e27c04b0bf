"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from barlab.plans import ALL_QUERIES
from barlab.session import local_session

HEADLINE = (
    "daily_opportunity", "period_opportunity", "ordered_summary", "ordered_periods", "arm_summary",
    "base_arm_delta_periods", "paired_delta", "coupled_bounds", "coupled_periods", "weekly_block_interval",
    "daily_auc", "ordinal_auc", "coverage_audit", "selection_list", "duplicate_lists", "training_set",
    "price_reference_states", "reset_exposure_by_half", "bar_features_daily", "bar_features_intraday",
    "index_relative_features", "feature_table", "order_labels", "encode_features", "score_trees",
    "quantile_cuts", "node_stats", "stitch_sources", "candidate_filter", "key_gate")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()   # warm up the JVM
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        ALL_QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
