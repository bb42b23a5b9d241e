"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local
cores, BENCH_RUNS the timed runs after one warm-up (the median is reported).
Each run builds its plan anew and forces the whole result with a noop write.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from surcos.checks.all import QUERIES  # noqa: E402
from surcos.session import session  # noqa: E402

HEADLINE = [
    "account_summary",
    "minable_table",
    "minable_clean",
    "candidate_balance",
    "client_summary_fanout",
    "profile",
    "describe_long",
    "quartiles_exact",
    "daily_resample",
    "decompose_7",
    "lag_windows_30",
    "ar1_forecast",
    "mape",
    "string_index",
    "roc_curve",
    "silhouette",
    "ar_7_forecast",
]
# Fitting is seconds to minutes of many small jobs; one timed run each.
FITS = ["logreg", "tree", "kmeans", "model_comparison"]


def run(spark, sf: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE + FITS
    spark = session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="6g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        if name in FITS:
            seconds[name] = round(run(spark, sf, name), 3)
        else:
            run(spark, sf, name)
            seconds[name] = round(statistics.median(run(spark, sf, name) for _ in range(runs)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
