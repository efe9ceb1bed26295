"""Times the headline queries and prints one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Each query runs twice and is written
to a sink that takes all rows and all columns and keeps nothing; the better time counts. Other queries can
be named on the command line.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from alertfold_checks.queries import registered

HEADLINE = [
    "assign_boxes",
    "apply_mutes",
    "similarity_pairs",
    "similarity_pairs_notes",
    "group_sizes",
    "group_sizes_wide",
    "fold_groups",
    "compact",
    "recent_history",
    "match_templates",
    "open_problems",
    "groups_with_problems",
    "apply_maintenance_log",
    "audit_log",
    "pair_replies",
    "paginate",
    "compact_stream",
]
RUNS = 2


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("alertfold-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    runnable = registered()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        best = float("inf")
        for _ in range(RUNS):
            start = time.perf_counter()
            runnable[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    result = {"metric": "total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
