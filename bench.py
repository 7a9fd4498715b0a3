"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores. Each query runs once
to warm up and then ``BENCH_RUNS`` times; the best time counts. Results go to
Spark's ``noop`` sink, so every row and column is computed and none collected.
``no_broadcast`` times the joins with the sort-merge plans that large tables get; the
total leaves it out.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from trackspark.plans import catalog  # noqa: E402


HEADLINE = [
    "clean_fixes", "clean_waterfall", "dedupe_fixes", "filter_radius", "proximity_pairs", "proximity_pairs_exact",
    "find_candidates", "closest_approach", "closest_event", "resolve_names", "trajectories", "trajectory_polyline",
]
SORT_MERGE = ["proximity_pairs", "proximity_pairs_exact", "candidates_of_transient_pairs", "trajectories"]


def best_of(build: Callable[[SparkSession, str], DataFrame], spark: SparkSession, sf_dir: str, runs: int) -> float:
    times = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return round(min(times), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trackspark-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        # Spark's own advice for HotSpot, whose JIT leaves larger methods alone.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog.operators()
    seconds = {name: best_of(known[name], spark, sf_dir, runs) for name in HEADLINE}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    merged = {name: best_of(known[name], spark, sf_dir, runs) for name in SORT_MERGE}
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_total", "value": total, "unit": "sec", "queries": seconds,
        "no_broadcast": merged,
        "sf": pathlib.Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
