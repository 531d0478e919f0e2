"""Benchmark: every registered query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query is executed in full into Spark's ``noop`` sink (no driver collect), once
as a warm-up and then ``$BENCH_REPEAT`` times; the median is reported.  Prints one
JSON line: {"metric", "value" (sum of medians), "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from purchaseflow.plans.registry import QUERIES  # noqa: E402
from purchaseflow.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus * 2, app_name="purchaseflow-bench")
    timings: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        runs = []
        for i in range(repeat + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:  # the first run warms the JVM and file caches
                runs.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(runs), 3)
        rows[name] = fn(spark, sf_dir).count()
        # Untimed: let the JVM collect finished queries so Spark's context cleaner
        # drops their shuffle files and broadcasts before the next query.
        spark.catalog.clearCache()
        spark.sparkContext._jvm.System.gc()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_of_query_medians", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "rows": rows, "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus, "repeat": repeat, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
