"""Schemas of the tables that pass between the steps."""

from __future__ import annotations

from pyspark.sql import types as T

# CSV columns after header normalisation, with the type a report carries them in.
# MMSI stays text: the aircraft rule looks at its characters.
REPORT_TYPES: dict[str, T.DataType] = {
    "Timestamp": T.TimestampType(),
    "Latitude": T.DoubleType(),
    "Longitude": T.DoubleType(),
    "SOG": T.DoubleType(),
    "COG": T.DoubleType(),
    "Heading": T.DoubleType(),
}

#: The report columns that anything here reads, as they are named after header normalisation.
REPORT_COLUMNS = (
    "Timestamp", "Type_of_mobile", "MMSI", "Latitude", "Longitude", "Navigational_status",
    "SOG", "COG", "Heading", "Name", "Ship_type",
)
REQUIRED_REPORT_COLUMNS = ("Timestamp", "Latitude", "Longitude", "MMSI", "SOG", "COG")

FIX_SCHEMA = T.StructType([
    T.StructField("mmsi", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("sog", T.DoubleType()),
    T.StructField("cog", T.DoubleType()),
    T.StructField("heading", T.DoubleType()),
    T.StructField("nav_status", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("ship_type", T.StringType()),
])

CANDIDATE_SCHEMA = T.StructType([
    T.StructField("mmsi1", T.LongType()),
    T.StructField("mmsi2", T.LongType()),
    T.StructField("ts1", T.TimestampType()),
    T.StructField("ts2", T.TimestampType()),
    T.StructField("lat1", T.DoubleType()),
    T.StructField("lon1", T.DoubleType()),
    T.StructField("lat2", T.DoubleType()),
    T.StructField("lon2", T.DoubleType()),
    T.StructField("name1", T.StringType()),
    T.StructField("name2", T.StringType()),
    T.StructField("sog1", T.DoubleType()),
    T.StructField("sog2", T.DoubleType()),
    T.StructField("dt_sec", T.LongType()),
    T.StructField("dist_m", T.DoubleType()),
    T.StructField("collision_lat", T.DoubleType()),
    T.StructField("collision_lon", T.DoubleType()),
    T.StructField("collision_ts", T.TimestampType()),
])

#: What one day's candidates say of a pair: how many there are, and the closest of them.
PAIR_DAY_SCHEMA = T.StructType([
    T.StructField("mmsi1", T.LongType()),
    T.StructField("mmsi2", T.LongType()),
    T.StructField("n_obs", T.LongType()),
    T.StructField("closest", T.StructType([CANDIDATE_SCHEMA[c] for c in ("dist_m", "ts1", "ts2")] + [
        f for f in CANDIDATE_SCHEMA if f.name not in ("mmsi1", "mmsi2", "dist_m", "ts1", "ts2")
    ])),
])

MANIFEST_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("modified", T.TimestampType()),
    T.StructField("first_ts", T.TimestampType()),
    T.StructField("last_ts", T.TimestampType()),
    T.StructField("n_reports", T.LongType()),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("mmsi1", T.LongType()),
    T.StructField("mmsi2", T.LongType()),
    T.StructField("name1", T.StringType()),
    T.StructField("name2", T.StringType()),
    T.StructField("collision_ts", T.TimestampType()),
    T.StructField("collision_lat", T.DoubleType()),
    T.StructField("collision_lon", T.DoubleType()),
    T.StructField("min_distance_m", T.DoubleType()),
])

TRAJECTORY_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("mmsi", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("sog", T.DoubleType()),
    T.StructField("cog", T.DoubleType()),
])
