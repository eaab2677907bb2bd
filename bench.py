"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with the median seconds of warm runs."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
#: name of the bench: registered query
QUERIES = {
    "bd_rate": "rd10_bd_rate_report", "totals_cube": "rd3_totals_cube", "display_map": "fr8_display_map", "locate": "st1_locate_samples", "decode_times": "st2_decode_times",
    "block_diff": "df14_diff_blocks", "robust_fit": "mv10_fit_robust", "inliers": "mv11_inliers", "stencil": "gr7_stencil", "box": "gr8_box", "block_stats": "gr1_block_stats",
    "accumulate": "tr1_accumulate", "gaussian": "tr3_gaussian_smooth", "kalman": "tr4_kalman_causal",
}


def main() -> None:
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.checkpoint.dir", f"file://{scratch}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from framelake import registry

    found = {}
    for name, query in QUERIES.items():
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            registry.QUERIES[query](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        found[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "median_seconds_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
