"""Tracks derived from the driver's ``events`` table.

Both engines build them from the same expressions; only the slots differ.

* ``fixes``   - typed and clean, for geometry, joins and aggregates
* ``reports`` - noisy text columns, as the CSV source would deliver them

Users sail in fleets of ten. A fleet keeps to an area of 0.004 x 0.006 degrees,
on its own place and day, so the number of close pairs grows with the table and
not with its square. Thirty days are compressed 300:1 into 144 minutes, which
brings vessels within seconds of each other. All ``%`` below spread values or
plant noise; none leaves rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.operators.dedupe import dedupe_fixes

SPARK_SLOTS = {
    "EPOCH": "unix_timestamp(ts)",
    "AS_TS": "timestamp_seconds(tsec)",
    "TS_TEXT": "date_format(timestamp_seconds(tsec), 'dd/MM/yyyy HH:mm:ss')",
}
DUCKDB_SLOTS = {
    "EPOCH": "CAST(floor(epoch(ts)) AS BIGINT)",
    "AS_TS": "make_timestamp(tsec * 1000000)",
    "TS_TEXT": "strftime(make_timestamp(tsec * 1000000), '%d/%m/%Y %H:%M:%S')",
}

_EVENTS = [
    "event_id", "user_id", "event_type",
    "CAST(floor(value * 100) AS BIGINT) AS vc",
    "CAST(floor(user_id / 10e0) AS BIGINT) AS fleet",
    "{EPOCH} AS epoch",
]
_PLACED = [
    "event_id", "user_id", "event_type", "vc", "user_id % 40 AS v", "user_id % 40 + 40 * (event_id % 2) AS w",
    # 31 days x 15,694 places x 10 times of day before two fleets meet.
    "1638316800 + (fleet % 31) * 86400 + (CAST(floor(fleet / 486514e0) AS BIGINT) % 10) * 8640"
    " + CAST(floor((epoch - 1704067200) / 300e0) AS BIGINT) AS tsec",
    "54750000 + (fleet % 118) * 8000 + (vc * 7919 + user_id * 31 + event_id * 613) % 4000 AS lat_u",
    "13450000 + (CAST(floor((fleet % 15694) / 118e0) AS BIGINT)) * 12000"
    " + (vc * 104729 + user_id * 17 + event_id * 7351) % 6000 AS lon_u",
]
# Vessel 3 of each 40 has no name at all, others have one in their odd reports; two reports in
# three carry none, so the closest encounter needs its names looked up.
_NAME = (
    "CASE WHEN vc % 3 <> 0 THEN NULL ELSE CASE w WHEN 0 THEN 'Pilot 213 SE' WHEN 1 THEN 'KBV 302' WHEN 2 THEN 'CAESAR'"
    " WHEN 3 THEN NULL WHEN 43 THEN 'Unknown' WHEN 4 THEN 'Unknown' WHEN 6 THEN ''"
    " WHEN 9 THEN ' None ' ELSE concat('VESSEL ', CAST(user_id AS STRING)) END END"
)
_SHIP_TYPE = (
    "CASE v WHEN 7 THEN 'Tug' WHEN 8 THEN 'Port tender' WHEN 12 THEN 'tug' WHEN 15 THEN NULL ELSE 'Cargo' END"
)
_FIXES = [
    "event_id", "219000000 + user_id AS mmsi", "{AS_TS} AS ts",
    "lat_u / 1000000e0 AS lat", "lon_u / 1000000e0 AS lon",
    "(vc % 250) / 10e0 AS sog", "(vc % 3600) / 10e0 AS cog",
    f"{_NAME} AS name", f"{_SHIP_TYPE} AS ship_type",
]
_REPORTS = [
    "event_id",
    "CASE WHEN event_id % 101 = 0 THEN 'bad' ELSE {TS_TEXT} END AS Timestamp",
    "CASE WHEN event_id % 7 = 3 THEN 'Base Station' WHEN event_id % 2 = 0 THEN 'Class A'"
    " ELSE 'Class B' END AS Type_of_mobile",
    "CASE WHEN event_id % 61 = 0 THEN '111219512' WHEN event_id % 103 = 0 THEN 'x219'"
    " ELSE CAST(219000000 + user_id AS STRING) END AS MMSI",
    # 56.0573/14.245 lies in the circle but not in the box, 55.95/15.6 the other way round.
    "CASE WHEN event_id % 97 = 0 THEN 'abc' WHEN event_id % 89 = 0 THEN '0.0' WHEN event_id % 83 = 0 THEN '95.0'"
    " WHEN event_id % 13 = 5 THEN '56.0573' WHEN event_id % 11 = 4 THEN '57.5' WHEN event_id % 17 = 6 THEN '55.95'"
    " ELSE CAST(lat_u / 1000000e0 AS STRING) END AS Latitude",
    "CASE WHEN event_id % 89 = 0 THEN '0.0' WHEN event_id % 13 = 5 THEN '14.245' WHEN event_id % 17 = 6 THEN '15.6'"
    " ELSE CAST(lon_u / 1000000e0 AS STRING) END AS Longitude",
    "CASE WHEN event_id % 79 = 0 THEN NULL WHEN event_id % 73 = 0 THEN '102.3'"
    " ELSE CAST((vc % 250) / 10e0 AS STRING) END AS SOG",
    "CAST((vc % 3600) / 10e0 AS STRING) AS COG",
    "CASE WHEN event_id % 3 = 0 THEN 'Unknown' ELSE CAST(vc % 360 AS STRING) END AS Heading",
    "CASE event_id % 67 WHEN 0 THEN NULL WHEN 1 THEN 'Restricted maneuverability'"
    " WHEN 2 THEN 'At anchor' ELSE CASE event_type WHEN 'error' THEN 'Moored' ELSE 'Under way using engine' END END"
    " AS Navigational_status",
    f"{_NAME} AS Name", f"{_SHIP_TYPE} AS Ship_type",
]
REPORT_COLUMNS = (
    "event_id", "Timestamp", "Type_of_mobile", "MMSI", "Latitude", "Longitude",
    "SOG", "COG", "Heading", "Navigational_status", "Name", "Ship_type",
)


_COPIES = "CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END"


def _fill(columns: list[str], slots: dict[str, str]) -> list[str]:
    return [c.format(**slots) for c in columns]


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(*_fill(_EVENTS, SPARK_SLOTS)).selectExpr(*_fill(_PLACED, SPARK_SLOTS))


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fixes with ``event_id``; (mmsi, ts) may repeat."""
    return _placed(spark, sf_dir).selectExpr(*_fill(_FIXES, SPARK_SLOTS))


def unique_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fixes, one per (mmsi, ts)."""
    return dedupe_fixes(fixes(spark, sf_dir), ["event_id"]).drop("event_id")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy text reports with ``event_id``; every fifth one comes twice.

    The generator emits whole rows, so filters above it read finished columns
    instead of repeating the expressions that build them.
    """
    report = F.struct(*[F.expr(c) for c in _fill(_REPORTS, SPARK_SLOTS)])
    return _placed(spark, sf_dir).select(F.inline(F.array_repeat(report, F.expr(_COPIES))))


def _select(columns: list[str], source: str) -> str:
    return "SELECT " + ",\n  ".join(_fill(columns, DUCKDB_SLOTS)) + f"\nFROM {source}"


def duckdb_ctes() -> dict[str, str]:
    """The same tables as CTE bodies for DuckDB."""
    return {
        "ev": _select(_EVENTS, "events"),
        "placed": _select(_PLACED, "ev"),
        "fixes": _select(_FIXES, "placed"),
        "noisy": _select(_REPORTS, "placed"),
        "copied": f"SELECT *, unnest(generate_series(1, {_COPIES})) AS copy FROM noisy",
        "reports": f"SELECT {', '.join(REPORT_COLUMNS)} FROM copied",
    }
