"""``spark-submit``/``python -m trackspark --data DIR --output DIR``."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from trackspark.params import CleanParams, EventParams
from trackspark.plans.job import JobParams, run


def main() -> None:
    env = os.environ
    parser = argparse.ArgumentParser(description="Closest one-time encounters in position reports")
    parser.add_argument("--data", default=env.get("DATA_PATH"), required="DATA_PATH" not in env)
    parser.add_argument("--output", default=env.get("OUTPUT_PATH"), required="OUTPUT_PATH" not in env)
    parser.add_argument("--year", type=int, default=int(env.get("TARGET_YEAR", "0")))
    parser.add_argument("--month", type=int, default=int(env.get("TARGET_MONTH", "12")))
    parser.add_argument("--events", type=int, default=1, help="how many events to report")
    parser.add_argument("--days", nargs="+", metavar="yyyy-MM-dd", help="make only these days anew")
    args = parser.parse_args()

    spark = SparkSession.builder.appName("trackspark").getOrCreate()
    result = run(spark, args.data, args.output, JobParams(
        clean=CleanParams(year=args.year, month=args.month),
        events=EventParams(k=args.events),
    ), days=args.days)
    print(f"{result.n_fixes} fixes, {result.n_candidates} candidates")
    result.events.orderBy("min_distance_m").show(args.events, truncate=False)


if __name__ == "__main__":
    main()
