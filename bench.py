"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""
from __future__ import annotations

import json
import os
import sys
import time

HEADLINES = (
    "c16_clean",
    "c11_iqr_outliers",
    "c6_interpolate",
    "d8_business_day",
    "l1_lags",
    "w2_ema",
    "w9_price_position",
    "w11_indicators",
    "w12_derived",
    "n4_robust",
    "n8_sequences_horizon",
    "n10_split_by_time",
    "n13_walk_forward",
    "a1_describe",
    "a6_corr_matrix",
    "a14_histogram",
    "m15_all_metrics",
    "m16_bootstrap",
    "r11_r12_evaluation_report",
    "f2_batch_forecast",
    "f5_forecast_linear",
    "f9_apply_scenarios",
    "e9_expired_runs",
    "t1_request_rate",
    "t3_latency_quantiles",
    "t8_hold_alerts",
    "s12_t17_stream_windows",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tickloom.plans import QUERIES
    from tickloom.sources.session import local_session

    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()
