"""Tables between the steps: Parquet by day, along a curve or in buckets of the join key, and the JSON result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackspark.functions import geo
from trackspark.operators.events import json_fields
from trackspark.operators.proximity import CELL_KEY
from trackspark.schemas import CANDIDATE_SCHEMA, EVENT_SCHEMA, FIX_SCHEMA, PAIR_DAY_SCHEMA, TRAJECTORY_SCHEMA


def write_by_day(df: DataFrame, root: str, ts: str = "ts", replace: str = "all", counted: Observation | None = None) -> None:
    """Writes a table partitioned by the day of ``ts``; ``counted`` observes the number of rows, ``n``.

    ``replace="all"`` overwrites the store, ``"days"`` only the days in ``df``.
    The rebalance hint gives each day files of about the advisory size: small
    days are not scattered over tasks, a day that holds much of the data is split.
    """
    _write_days(df.withColumn("day", F.to_date(ts)), root, replace, counted)


def _write_days(df: DataFrame, root: str, replace: str, counted: Observation | None = None) -> None:
    if replace not in ("all", "days"):
        raise ValueError(f"replace must be 'all' or 'days', not {replace!r}")
    dealt = df.hint("rebalance", F.col("day"))
    if counted is not None:
        # Above the last shuffle, where a task that is run again counts once.
        dealt = dealt.observe(counted, F.count("*").alias("n"))
    (
        dealt.write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if replace == "all" else "dynamic")
        .partitionBy("day")
        .parquet(root)
    )


def clear_days(spark: SparkSession, root: str, schema: T.StructType, days: Sequence[str]) -> None:
    """Empties days of a store, since a write of ``"days"`` leaves a day alone for which it has no rows."""
    nothing = spark.createDataFrame([], schema)
    for day in days:
        nothing.write.mode("overwrite").parquet(f"{root}/day={day}")


def _read_by_day(spark: SparkSession, root: str, schema: T.StructType, days: Sequence[str] | None) -> DataFrame:
    with_day = T.StructType([*schema.fields, T.StructField("day", T.DateType())])
    df = spark.read.schema(with_day).parquet(root)
    if days is not None:
        df = df.filter(F.col("day").isin(*[F.lit(d).cast("date") for d in days]))
    return df


def read_fixes(spark: SparkSession, root: str, days: Sequence[str] | None = None) -> DataFrame:
    """Stored fixes; ``days`` (``yyyy-MM-dd``) prunes partitions."""
    return _read_by_day(spark, root, FIX_SCHEMA, days)


def read_candidates(spark: SparkSession, root: str, days: Sequence[str] | None = None) -> DataFrame:
    """Stored candidates; ``days`` prunes by the day of the encounter."""
    return _read_by_day(spark, root, CANDIDATE_SCHEMA, days)


def write_clustered(fixes: DataFrame, root: str, group_bytes: int = 16 << 20) -> None:
    """Writes fixes by day, in each day along a curve through their positions, in row groups of about ``group_bytes``.

    A row group then covers a small area, so a box reads few of them. Ranges end on time and vessel too,
    so that a position that holds much of the data is split over tasks. Overwrites the store.
    """
    (
        fixes.withColumns({"day": F.to_date("ts"), "curve": geo.curve_key(F.col("lat"), F.col("lon"))})
        .repartitionByRange("day", "curve", "ts", "mmsi")
        .sortWithinPartitions("day", "curve", "ts", "mmsi")
        .drop("curve")
        .write.mode("overwrite")
        .option("parquet.block.size", group_bytes)
        .partitionBy("day")
        .parquet(root)
    )


def read_box(
    spark: SparkSession, root: str, south: float, west: float, north: float, east: float, days: Sequence[str] | None = None
) -> DataFrame:
    """Stored fixes in a box, its edges included; ``west`` above ``east`` is a box across +-180 degrees."""
    lon = F.col("lon")
    wide = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return read_fixes(spark, root, days).filter(F.col("lat").between(south, north) & wide)


def write_cells(keyed: DataFrame, table: str, root: str, buckets: int) -> None:
    """Writes rows of ``proximity.join_cells`` as the catalog's ``table`` at ``root``, in buckets of the join key."""
    (
        keyed.repartition(buckets, *CELL_KEY)  # One file a bucket.
        .write.mode("overwrite").format("parquet").bucketBy(buckets, *CELL_KEY).option("path", root).saveAsTable(table)
    )


def attach_cells(spark: SparkSession, table: str, root: str, buckets: int) -> DataFrame:
    """The stored cells; a catalog that does not know them (another session's) is told, as only it knows of buckets."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(root).schema)
        place = root.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({', '.join(CELL_KEY)}) INTO {int(buckets)} BUCKETS LOCATION '{place}'")
    return spark.table(table)


def write_pair_days(pairs: DataFrame, root: str, replace: str = "all") -> None:
    """Writes rows of ``PAIR_DAY_SCHEMA`` with their ``day``; ``replace`` as for :func:`write_by_day`."""
    _write_days(pairs, root, replace)


def read_pair_days(spark: SparkSession, root: str, days: Sequence[str] | None = None) -> DataFrame:
    """Stored days of pairs, one row for each pair and day."""
    return _read_by_day(spark, root, PAIR_DAY_SCHEMA, days)


def read_events(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(root)


def read_tracks(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(TRAJECTORY_SCHEMA).parquet(root)


def write_event_json(events: DataFrame, path: str) -> None:
    """One JSON object per event and line, times as ISO UTC."""
    json_fields(events).write.mode("overwrite").json(path)
