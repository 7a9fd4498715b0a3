"""Tracks around events, and the tables a map or chart draws from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import text, timegrid
from trackspark.operators.events import event_id
from trackspark.params import TrackParams
from trackspark.schemas import TRAJECTORY_SCHEMA

TRACK = ["event_id", "role", "mmsi"]


def trajectories(fixes: DataFrame, events: DataFrame, p: TrackParams = TrackParams()) -> DataFrame:
    """Fixes of both vessels within the half window around each event, ends included.

    All events run in one job. The time range is cut into slots as long as the
    window, which makes it an equi-join on (vessel, slot): a window meets two
    slots at most, and a vessel's many fixes spread over its slots. For a ranked
    handful of events Spark broadcasts the event side from its size estimate;
    larger event tables shuffle.
    """
    slot_s = max(2 * p.half_window_s, 1)
    if "event_id" not in events.columns:
        events = events.withColumn("event_id", event_id())
    at = timegrid.epoch_s(F.col("collision_ts"))
    wanted = events.select(
        "event_id",
        (at - p.half_window_s).alias("from_s"),
        (at + p.half_window_s).alias("to_s"),
        F.inline(F.array(*[
            F.struct(F.lit(f"vessel{i}").alias("role"), F.col(f"mmsi{i}").alias("vessel")) for i in (1, 2)
        ])),
    ).withColumn(
        "wanted_slot",
        F.explode(F.sequence(
            timegrid.time_bucket(F.col("from_s"), slot_s), timegrid.time_bucket(F.col("to_s"), slot_s)
        )),
    )
    sec = timegrid.known_epoch_s(F.col("ts"))
    slotted = fixes.filter(F.col("ts").isNotNull()).select(
        "mmsi", "ts", "lat", "lon", "sog", "cog", timegrid.known_time_bucket(sec, slot_s).alias("slot")
    )
    return slotted.join(
        wanted,
        (F.col("mmsi") == F.col("vessel"))
        & (F.col("slot") == F.col("wanted_slot"))
        & sec.between(F.col("from_s"), F.col("to_s")),
        "inner",
    ).select(*TRAJECTORY_SCHEMA.names)


def track_counts(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy(*TRACK).agg(F.count("*").alias("n_fixes"))


def _along_track() -> Window:
    # One vessel and one window: at most one fix per second of it.
    return Window.partitionBy(*TRACK).orderBy("ts")


def age_ramp(tracks: DataFrame) -> DataFrame:
    """Opacity of each fix along its track: 0.3 at the oldest, 1.0 at the newest."""
    return tracks.withColumn("alpha", 0.3 + 0.7 * F.percent_rank().over(_along_track()))


def segments(tracks: DataFrame) -> DataFrame:
    """Straight pieces between consecutive fixes, with the opacity of their start."""
    w = _along_track()
    return (
        tracks.select(
            *TRACK, F.col("ts").alias("from_ts"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"),
            F.lead("ts").over(w).alias("to_ts"),
            F.lead("lat").over(w).alias("to_lat"),
            F.lead("lon").over(w).alias("to_lon"),
            (0.3 + 0.7 * F.percent_rank().over(w)).alias("alpha"),
        )
        .filter(F.col("to_ts").isNotNull())
    )


def endpoints(tracks: DataFrame) -> DataFrame:
    """First and last fix of each track."""
    fix = F.struct("ts", "lat", "lon")
    return tracks.groupBy(*TRACK).agg(F.min(fix).alias("a"), F.max(fix).alias("z")).select(
        *TRACK,
        *[F.col(f"{s}.{c}").alias(f"{end}_{c}") for s, end in (("a", "start"), ("z", "end")) for c in ("ts", "lat", "lon")],
    )


def polylines(tracks: DataFrame) -> DataFrame:
    """One line per track: points in time order and their GeoJSON geometry.

    A track has at most one fix per second of its window, which bounds the list.
    """
    points = F.sort_array(F.collect_list(F.struct("ts", "lat", "lon")))
    return tracks.groupBy(*TRACK).agg(points.alias("points")).select(
        *TRACK,
        F.transform("points", lambda q: F.struct(q["lat"].alias("lat"), q["lon"].alias("lon"))).alias("line"),
        F.to_json(F.struct(
            F.lit("LineString").alias("type"),
            F.transform("points", lambda q: F.array(q["lon"], q["lat"])).alias("coordinates"),
        )).alias("geojson"),
    )


def speed_series(tracks: DataFrame) -> DataFrame:
    return tracks.select(*TRACK, "ts", "sog")


def popup_fields(tracks: DataFrame) -> DataFrame:
    """What a marker shows: time of day, speed and course with one decimal."""
    return tracks.select(
        *TRACK, "ts", "lat", "lon",
        text.clock(F.col("ts")).alias("time_text"),
        text.fixed_decimals(F.col("sog"), 1).alias("sog_text"),
        text.fixed_decimals(F.col("cog"), 1).alias("cog_text"),
    )
