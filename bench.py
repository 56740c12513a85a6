"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from lodestone.plans.queries import queries  # noqa: E402

HEADLINE = ["symbol_keys", "resolve_calls", "externals_agg", "called_by", "scc", "rank_levels", "trace_forward_d2", "trace_forward_d3", "find_symbols_all", "extract_go"]
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every, times = queries(), {}
    for name in HEADLINE:
        taken = []
        for _ in range(RUNS + 1):  # the first warms up
            began = time.perf_counter()
            every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(median(taken[1:]), 3)
    print(json.dumps({"metric": "sum of medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
