"""CSV reports.

The header names the columns; the scan then parses them to their types, so a
token is parsed once, dirty tokens become NULL, and filters reach the reader.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackspark.operators.clean import coerce_types, header_name, header_names
from trackspark.params import TIMESTAMP_PATTERN
from trackspark.schemas import REPORT_TYPES, REQUIRED_REPORT_COLUMNS
from trackspark.sources import files

#: With up to this many files, their headers go to all tasks; beyond, they are joined by shuffle.
BROADCAST_FILES = 100_000
#: Different headers that one call reads.
MOST_HEADERS = 100


Paths = str | list[str]


def _reader(spark: SparkSession) -> DataFrameReader:
    return spark.read.option("pathGlobFilter", "*.csv")


def _columns(header: str) -> list[str]:
    columns = next(csv.reader([header]))
    named = header_names(columns)
    missing = [c for c in REQUIRED_REPORT_COLUMNS if c not in named]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in the header {header}")
    return columns


def file_headers(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """Rows ``file`` (name), ``header``: the first line of each file that names a timestamp and an MMSI.

    One small read a file; where only Spark's readers open the storage, one scan of the text.
    """
    heads = files.list_files(spark, path, heads=True, only=only)
    if heads is None:
        lines = _reader(spark).text(_chosen(path, only)).select(F.col("value").alias("head"), _file().alias("file"), "_metadata.file_block_start")
        # The scan numbers lines as it reads them, so the least number in the first block is the first line.
        first = lines.filter("file_block_start = 0").groupBy("file")
        heads = first.agg(F.min_by("head", F.monotonically_increasing_id()).alias("head"))
    named = F.col("head").contains("Timestamp") & F.col("head").contains("MMSI")
    return heads.filter(named).select("file", F.col("head").alias("header"))


def _chosen(path: str, only: list[str] | None) -> Paths:
    """The path, or those of its files that are named."""
    if only is None or path.endswith(".csv"):
        return path
    return [f"{path.rstrip('/')}/" + re.sub(r"([\\*?{}\[\]])", r"\\\1", name) for name in only]


def _file() -> Column:
    """The name of a row's file; Spark gives it encoded as in a URI, where a plus is a plus."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def _typed_scan(spark: SparkSession, path: Paths, columns: list[str]) -> DataFrame:
    schema = T.StructType([
        T.StructField(c, REPORT_TYPES.get(header_name(c), T.StringType())) for c in columns
    ])
    rows = (
        _reader(spark).schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("timestampFormat", TIMESTAMP_PATTERN)
        .option("enableDateTimeParsingFallback", False)
        # Stop at a file whose header differs, instead of reading it askew.
        .option("enforceSchema", False)
        .csv(path)
    )
    return rows.select(*[F.col(f"`{c}`").alias(header_name(c)) for c in columns], _file().alias("file"))


def _mapped_scan(spark: SparkSession, path: Paths, found: DataFrame, headers: list[str], small: bool) -> DataFrame:
    """Text columns by place, named by the header of their file; a file without one stops the query."""
    places = [{header_name(c): i for i, c in enumerate(_columns(h))} for h in headers]
    width = max(len(_columns(h)) for h in headers)
    schema = T.StructType([T.StructField(f"at{i}", T.StringType()) for i in range(width)])
    rows = _reader(spark).schema(schema).csv(path).select("*", _file().alias("file"))
    kinds = F.create_map(*[F.lit(x) for i, h in enumerate(headers) for x in (h, i)])
    found = found.select("file", kinds[F.col("header")].alias("kind"))
    rows = rows.join(F.broadcast(found) if small else found, "file", "left")
    kind = F.coalesce("kind", F.raise_error(F.concat(F.lit("no header in "), "file")).cast("int"))

    def value(name: str) -> Column:
        found = F.lit(None).cast("string")
        for i, at in enumerate(places):
            if name in at:
                found = F.when(F.col("kind") == i, F.col(f"at{at[name]}")).otherwise(found)
        return found

    names = list(dict.fromkeys(n for at in places for n in at))
    rows = rows.withColumn("kind", kind).select(*[value(n).alias(n) for n in names], "file")
    return rows.filter(~F.col("MMSI").eqNullSafe("MMSI"))


def read_reports(
    spark: SparkSession, path: str, header: str | None = None, only: list[str] | None = None, with_file: bool = False
) -> DataFrame:
    """Reports of one CSV file or of all ``*.csv`` in a directory, typed, with ``ts``.

    Files may have different headers: columns are matched by name, absent ones are NULL.
    The headers are found by a small read of each file; only the different ones reach the driver.
    Where all files share one, the reader parses and filters the columns itself. Whoever knows
    that ``header`` can give it and save these reads; a file with another one then stops the query.
    ``only`` names the files to open; ``with_file`` adds the name of a report's ``file``.
    """
    def shown(rows: DataFrame) -> DataFrame:
        return coerce_types(rows if with_file else rows.drop("file"))

    if header is not None:
        return shown(_typed_scan(spark, _chosen(path, only), _columns(header)))
    heads = file_headers(spark, path, only)
    found = heads.groupBy("header").count().orderBy("header").limit(MOST_HEADERS + 1).collect()
    if not 1 <= len(found) <= MOST_HEADERS:
        raise ValueError(f"{'no header' if not found else f'over {MOST_HEADERS} headers'} in {path}")
    headers = [r["header"] for r in found]
    if len(headers) == 1:
        return shown(_typed_scan(spark, _chosen(path, only), _columns(headers[0])))
    small = sum(r["count"] for r in found) <= BROADCAST_FILES
    return shown(_mapped_scan(spark, _chosen(path, only), heads, headers, small))
