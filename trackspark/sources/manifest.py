"""What times each report file holds, so that a run for some days opens only files that can hold them.

The manifest is a table that only grows: a row for each state of a file (name, size, time of change) that was ever read. A file is
known if its present state has a row; one that was changed since has none and is read again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.schemas import MANIFEST_SCHEMA
from trackspark.sources import files, reports

STATE = ["file", "size", "modified"]


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the manifest; a missing one is empty. Runs at the same time may have written a state twice."""
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).parquet(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return rows.groupBy(*STATE).agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max("n_reports").alias("n_reports"))


def update_manifest(spark: SparkSession, path: str, root: str) -> DataFrame | None:
    """Reads the times of new and changed files of ``path`` and returns the rows of its present files.

    None where the files can't be listed outside of Spark's readers. Only names of files reach the driver.
    """
    present = files.list_files(spark, path)
    if present is None:
        return None
    present = present.select(*STATE)
    new = present.join(read_manifest(spark, root), STATE, "left_anti")
    names = [r["file"] for r in new.select("file").collect()]
    if names:
        found = reports.file_headers(spark, path, names).select("file").collect()
        told = _times(spark, path, [r["file"] for r in found]) if found else None
        rows = new.join(told, "file", "left") if told is not None else new
        filled = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(MANIFEST_SCHEMA[c].dataType).alias(c) for c in MANIFEST_SCHEMA.names])
        filled.coalesce(1 + len(names) // 100_000).write.mode("append").parquet(root)
    return present.join(read_manifest(spark, root), STATE)


def _times(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    typed = reports.read_reports(spark, path, only=names, with_file=True)
    return typed.groupBy("file").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_reports"))


def files_of(manifest: DataFrame, days: Sequence[str]) -> list[str]:
    """Names of the files whose times reach into any of ``days`` (``yyyy-MM-dd``)."""
    def meets(day: str):
        after = str(dt.date.fromisoformat(day) + dt.timedelta(days=1))
        return (F.col("first_ts") < F.lit(after).cast("timestamp")) & (F.col("last_ts") >= F.lit(day).cast("timestamp"))

    some = reduce(lambda a, b: a | b, map(meets, days))
    return sorted(r["file"] for r in manifest.where(some).select("file").collect())
