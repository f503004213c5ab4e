"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the number of threads.
Each query runs three times and its best time counts; results go nowhere.
After BENCH_SECONDS (1500) no further run starts; what was measured is printed.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tierflow.plans.catalog import QUERIES
from tierflow.runtime import stored_steps

HEADLINE = (
    "compare_routers",
    "combined_summary",
    "run_summary",
    "tail_latency",
    "latency_percentiles",
    "per_backend_metrics",
    "paired_delta",
    "trace",
    "tier_counts",
    "tier_content_addressed",
    "sample_balanced",
    "sensitive_flag",
    "pattern_hits",
    "cbr_scores",
    "route_cbr",
    "asof_system_state",
    "host_energy",
    "energy_between",
    "q_fit",
    "regret",
    "lambda_sweep",
    "embed",
    "stream_trace",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tierflow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    budget = float(os.environ.get("BENCH_SECONDS", "1500"))
    begun = time.perf_counter()
    seconds, left_out = {}, []
    for name in names:
        times = []
        for _ in range(3):
            # A slow query costs its own repeats, not the report of the others.
            if times and time.perf_counter() - begun + times[0] > budget:
                break
            if not times and time.perf_counter() - begun > budget:
                left_out.append(name)
                break
            with stored_steps(spark):
                start = time.perf_counter()
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                times.append(time.perf_counter() - start)
        if times:
            seconds[name] = round(min(times), 3)
            print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of headline queries, best of three runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "left_out": left_out,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
