"""The registered queries: one per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trackspark.functions import geo, text, timegrid
from trackspark.operators import clean, dedupe, events, names, proximity, tracks, voyages
from trackspark.params import CleanParams, EventParams, ProximityParams, VoyageParams
from trackspark.plans import derived
from trackspark.plans.job import pin_utc
from trackspark.sources import folders, reports, stores

Query = Callable[[SparkSession, str], DataFrame]

PERIOD = CleanParams(year=2021)
ENCLOSING = CleanParams(year=2021, bbox="enclosing")
EXACT = ProximityParams(time_mode="exact")
SLOW = VoyageParams(max_kn=25.0)
NEAR = VoyageParams(repeat_s=20, repeat_m=200.0)
# Few enough observations that both kinds of pairs occur in the test tables.
TRANSIENT = EventParams(max_obs=5)
PAIR_KEY = ["mmsi1", "mmsi2", "ts1", "ts2"]

_DIGITS = {"dist_m": 3, "min_distance_m": 3, "dist_km": 6}

_QUERIES: dict[str, Query] = {}


def _presentable(df: DataFrame) -> DataFrame:
    """Times as text and doubles rounded, so two engines can be compared."""
    def show(name: str, kind: str):
        column = F.col(name)
        if kind.startswith("timestamp"):
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name)
        if kind == "date":
            return column.cast("string").alias(name)
        if kind == "double":
            return F.round(column, _DIGITS.get(name, 8)).alias(name)
        return column
    return df.select(*[show(n, k) for n, k in df.dtypes])


def query(build: Query) -> Query:
    _QUERIES[build.__name__] = build
    return build


def _with_utc(build: Query, finish: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pin_utc(spark)
        return finish(build(spark, sf_dir))

    return run


def queries() -> dict[str, Query]:
    """The queries as registered, in comparable form."""
    return {name: _with_utc(build, _presentable) for name, build in _QUERIES.items()}


def operators() -> dict[str, Query]:
    """The same, as the operators return them."""
    return {name: _with_utc(build, lambda df: df) for name, build in _QUERIES.items()}


# --- inputs -----------------------------------------------------------------

def typed_reports(spark: SparkSession, d: str) -> DataFrame:
    return clean.coerce_types(derived.reports(spark, d))


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_fixes(derived.reports(spark, d), PERIOD, keep=["event_id"])


def cleaned_unique(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.dedupe_fixes(cleaned(spark, d), ["event_id"]).drop("event_id")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return proximity.find_candidates(cleaned_unique(spark, d))


def transient_events(spark: SparkSession, d: str) -> DataFrame:
    return events.to_events(events.closest_approach(candidates(spark, d), TRANSIENT))


def all_tracks(spark: SparkSession, d: str) -> DataFrame:
    return tracks.trajectories(cleaned_unique(spark, d), transient_events(spark, d))


# --- reading and cleaning ---------------------------------------------------

@query
def normalise_headers(spark, d):
    raw = {"Timestamp": "# Timestamp", "Type_of_mobile": "Type of mobile", "Navigational_status": "Navigational status", "Ship_type": "Ship type "}
    return clean.normalise_headers(derived.reports(spark, d).withColumnsRenamed(raw))


@query
def coerce_fix_types(spark, d):
    return typed_reports(spark, d).select("event_id", "Latitude", "Longitude", "SOG", "COG", "Heading")


@query
def parse_fix_timestamp(spark, d):
    return clean.parse_timestamp(derived.reports(spark, d)).select("event_id", "Timestamp", "ts")


@query
def canonical_fixes(spark, d):
    return clean.canonical_fixes(typed_reports(spark, d), keep=["event_id"])


@query
def fixes_per_day(spark, d):
    return clean.fixes_per_day(cleaned_unique(spark, d))


@query
def filter_mobile_class(spark, d):
    return clean.filter_mobile_class(derived.reports(spark, d), PERIOD).select("event_id", "Type_of_mobile")


def _orders_as_reports(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("timestamp").alias("ts"))


@query
def filter_month(spark, d):
    return clean.filter_period(_orders_as_reports(spark, d), CleanParams(month=12))


@query
def filter_year_month(spark, d):
    return clean.filter_period(_orders_as_reports(spark, d), CleanParams(year=1997, month=12))


@query
def filter_valid_coordinates(spark, d):
    return clean.filter_valid_coordinates(typed_reports(spark, d)).select("event_id", "Latitude", "Longitude")


@query
def filter_sar_aircraft(spark, d):
    return clean.filter_sar_aircraft(derived.reports(spark, d)).select("event_id", "MMSI")


@query
def filter_bbox(spark, d):
    return clean.filter_bbox(typed_reports(spark, d), PERIOD).select("event_id", "Latitude", "Longitude")


@query
def filter_radius(spark, d):
    return clean.filter_radius(typed_reports(spark, d), PERIOD).select("event_id", "Latitude", "Longitude")


@query
def filter_radius_enclosing(spark, d):
    return clean.filter_radius(typed_reports(spark, d), ENCLOSING).select("event_id", "Latitude", "Longitude")


@query
def filter_moving(spark, d):
    return clean.filter_moving(typed_reports(spark, d), PERIOD).select("event_id", "SOG")


@query
def filter_nav_status(spark, d):
    return clean.filter_nav_status(derived.reports(spark, d), PERIOD).select("event_id", "Navigational_status")


@query
def filter_sog_anomaly(spark, d):
    return clean.filter_sog_anomaly(typed_reports(spark, d), PERIOD).select("event_id", "SOG")


@query
def filter_service_names(spark, d):
    return clean.filter_service_names(derived.fixes(spark, d)).select("event_id", "name")


@query
def filter_service_names_word(spark, d):
    words = ProximityParams(keyword_match="word")
    return clean.filter_service_names(derived.fixes(spark, d), words).select("event_id", "name")


@query
def filter_ship_types(spark, d):
    return clean.filter_ship_types(derived.fixes(spark, d)).select("event_id", "ship_type")


@query
def clean_fixes(spark, d):
    return cleaned(spark, d)


@query
def clean_waterfall(spark, d):
    return clean.clean_waterfall(derived.reports(spark, d), PERIOD)


@query
def dedupe_fixes(spark, d):
    return dedupe.dedupe_fixes(cleaned(spark, d), ["event_id"])


# --- expressions ------------------------------------------------------------

@query
def trig_functions(spark, d):
    phi = F.radians("lat")
    return derived.fixes(spark, d).select(
        "event_id", phi.alias("rad"), F.sin(phi).alias("sine"), F.cos(phi).alias("cosine"),
        F.asin(F.sin(phi)).alias("arcsine"), F.sqrt("lat").alias("root"), F.pow(F.sin(phi), 2).alias("square"),
    )


@query
def haversine_to_point(spark, d):
    km = geo.haversine_km_to(F.col("lat"), F.col("lon"), PERIOD.centre_lat, PERIOD.centre_lon)
    return derived.fixes(spark, d).select("event_id", km.alias("dist_km"))


@query
def haversine_pair(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    m = geo.haversine_m(lat, lon, lat + F.col("sog") / 1000, lon - F.col("cog") / 1000)
    return derived.fixes(spark, d).select("event_id", m.alias("dist_m"))


@query
def time_bucket(spark, d):
    bucket = timegrid.time_bucket(timegrid.epoch_s(F.col("ts")), 60)
    return derived.fixes(spark, d).select("event_id", bucket.alias("time_bucket"))


@query
def grid_cell(spark, d):
    return proximity.with_cells(derived.fixes(spark, d)).select("event_id", "grid_x", "grid_y")


@query
def neighbour_cells(spark, d):
    return proximity.neighbour_cells(derived.fixes(spark, d)).select("event_id", "join_gx", "join_gy")


# --- pairs ------------------------------------------------------------------

@query
def proximity_pairs(spark, d):
    return proximity.proximity_pairs(derived.unique_fixes(spark, d))


@query
def proximity_pairs_exact(spark, d):
    return proximity.proximity_pairs(derived.unique_fixes(spark, d), EXACT)


@query
def pair_time_gap(spark, d):
    gap = timegrid.time_gap_s(F.col("ts1"), F.col("ts2")).alias("gap_s")
    return proximity.proximity_pairs(derived.unique_fixes(spark, d)).select(*PAIR_KEY, gap)


@query
def pair_midpoint(spark, d):
    return proximity.proximity_pairs(derived.unique_fixes(spark, d)).select(
        *PAIR_KEY,
        geo.midpoint(F.col("lat1"), F.col("lat2")).alias("mid_lat"),
        geo.mid_longitude(F.col("lon1"), F.col("lon2")).alias("mid_lon"),
    )


@query
def pair_first_ts(spark, d):
    return proximity.proximity_pairs(derived.unique_fixes(spark, d)).select(
        *PAIR_KEY, F.least("ts1", "ts2").alias("first_ts")
    )


@query
def find_candidates(spark, d):
    return candidates(spark, d)


@query
def find_candidates_exact(spark, d):
    return proximity.find_candidates(cleaned_unique(spark, d), EXACT)


@query
def dedupe_candidates(spark, d):
    # What both time modes find comes twice.
    fixes = derived.unique_fixes(spark, d)
    return dedupe.dedupe_candidates(proximity.proximity_pairs(fixes).unionByName(proximity.proximity_pairs(fixes, EXACT)))


@query
def union_daily_candidates(spark, d):
    # Conditions on what the de-duplication returns stay above it, so its shuffle serves both parts.
    found = dedupe.dedupe_candidates(candidates(spark, d))
    odd = F.dayofmonth("collision_ts") % 2 == 1
    return proximity.union_candidates(found.filter(odd), found.filter(~odd))


# --- events -----------------------------------------------------------------

@query
def pair_observation_counts(spark, d):
    return events.pair_observation_counts(candidates(spark, d))


@query
def transient_pairs(spark, d):
    return events.transient_pairs(candidates(spark, d), TRANSIENT)


@query
def persistent_pairs(spark, d):
    return events.persistent_pairs(candidates(spark, d), TRANSIENT)


@query
def candidates_of_transient_pairs(spark, d):
    return events.candidates_of_transient_pairs(candidates(spark, d), TRANSIENT)


@query
def closest_approach(spark, d):
    return events.closest_approach(candidates(spark, d), TRANSIENT)


@query
def closest_event(spark, d):
    return names.resolve_names(events.closest_events(candidates(spark, d)), cleaned_unique(spark, d))


@query
def top_k_events(spark, d):
    return events.closest_events(candidates(spark, d), EventParams(max_obs=5, k=20))


@query
def modal_name(spark, d):
    return names.modal_names(cleaned_unique(spark, d))


@query
def resolve_names(spark, d):
    return names.resolve_names(transient_events(spark, d), cleaned_unique(spark, d))


@query
def event_json_fields(spark, d):
    return events.json_fields(transient_events(spark, d))


@query
def event_display_fields(spark, d):
    return events.display_fields(transient_events(spark, d))


def _pair_days(found):
    return events.pair_days(found, "day")


@query
def pair_days(spark, d):
    days = _pair_days(candidates(spark, d).withColumn("day", F.to_date("collision_ts")))
    return days.select(*events.PAIR, "day", "n_obs", "closest.dist_m", "closest.ts1", "closest.ts2")


# --- tables that were written and read back ---------------------------------

@query
def stored_reports(spark, d):
    """CSV files, two with unlike headers, found and read by name."""
    root = folders.new_folder(spark, "reports")
    rows = derived.reports(spark, d).drop("event_id")
    names = {"Timestamp": "# Timestamp", "Type_of_mobile": "Type of mobile", "Navigational_status": "Navigational status", "Ship_type": "Ship type"}
    text = rows.withColumnsRenamed(names)
    text.filter(F.col("MMSI").endswith("0")).select(*reversed(text.columns)).write.option("header", True).csv(f"{root}/first")
    text.filter(~F.col("MMSI").endswith("0")).write.option("header", True).csv(f"{root}/second")
    read = [reports.read_reports(spark, f"{root}/{part}") for part in ("first", "second")]
    return read[0].unionByName(read[1]).select("ts", "MMSI", "Latitude", "Longitude", "SOG", "COG", "Heading", "Type_of_mobile")


def _stored_fixes(spark, d):
    root = folders.new_folder(spark, "fixes")
    stores.write_by_day(cleaned_unique(spark, d), root)
    return root


@query
def stored_fixes(spark, d):
    return stores.read_fixes(spark, _stored_fixes(spark, d))


@query
def stored_fixes_of_days(spark, d):
    return stores.read_fixes(spark, _stored_fixes(spark, d), days=["2021-12-01", "2021-12-02"])


#: South, west, north, east of a box that holds a part of the test tracks.
BOX = (54.753, 13.4515, 54.8, 13.454)


@query
def clustered_box(spark, d):
    root = folders.new_folder(spark, "clustered")
    stores.write_clustered(cleaned_unique(spark, d), root)
    return stores.read_box(spark, root, *BOX)


@query
def pairs_of_stored_cells(spark, d):
    root = folders.new_folder(spark, "cells")
    table = root.rsplit("/", 1)[-1].replace("-", "_")
    stores.write_cells(proximity.join_cells(derived.unique_fixes(spark, d)), table, root, 16)
    return proximity.pairs_of_cells(stores.attach_cells(spark, table, root, 16))


@query
def replaced_days(spark, d):
    """A store whose days are written again one after another, once with less."""
    root = _stored_fixes(spark, d)
    fixes = cleaned_unique(spark, d)
    stores.write_by_day(fixes.filter((F.dayofmonth("ts") == 1) & (F.col("sog") > 10)), root, replace="days")
    return stores.read_fixes(spark, root)


@query
def stored_candidates(spark, d):
    root = folders.new_folder(spark, "candidates")
    stores.write_by_day(candidates(spark, d), root, ts="collision_ts")
    return stores.read_candidates(spark, root)


@query
def written_rows(spark, d):
    """Counts that the writing jobs observe."""
    told = []
    for name, df, ts in (("fixes", cleaned_unique(spark, d), "ts"), ("candidates", candidates(spark, d), "collision_ts")):
        counted = Observation()
        stores.write_by_day(df, folders.new_folder(spark, name), ts, counted=counted)
        told.append((name, counted.get["n"]))
    return spark.createDataFrame(told, "name string, n long")


@query
def approaches_of_stored_days(spark, d):
    """The closest approaches, from days of pairs written one by one and one of them twice."""
    root = folders.new_folder(spark, "pair_days")
    found = candidates(spark, d).withColumn("day", F.to_date("collision_ts"))
    half = F.dayofmonth("collision_ts") % 2 == 0
    for part in (half, ~half, half):
        stores.write_pair_days(_pair_days(found.filter(part)), root, replace="days")
    return events.approaches_of(events.merge_pair_days(stores.read_pair_days(spark, root).drop("day")), TRANSIENT)


# --- voyages ----------------------------------------------------------------

@query
def flag_jumps(spark, d):
    return voyages.flag_jumps(derived.unique_fixes(spark, d).select("mmsi", "ts", "lat", "lon"), SLOW)


@query
def collapse_repeats(spark, d):
    return voyages.collapse_repeats(derived.unique_fixes(spark, d).select("mmsi", "ts", "lat", "lon", "sog", "name"), NEAR)


def _lying_too(spark, d):
    fixes = clean.clean_fixes(derived.reports(spark, d), PERIOD, keep=["event_id"], without=["moving", "nav_status"])
    return dedupe.dedupe_fixes(fixes, ["event_id"]).drop("event_id")


@query
def movement_states(spark, d):
    return voyages.movement_states(_lying_too(spark, d))


@query
def track_endings(spark, d):
    return voyages.track_endings(transient_events(spark, d), voyages.movement_states(_lying_too(spark, d)))


# --- tracks -----------------------------------------------------------------

@query
def trajectories(spark, d):
    return all_tracks(spark, d)


@query
def trajectory_counts(spark, d):
    return tracks.track_counts(all_tracks(spark, d))


@query
def trajectory_segments(spark, d):
    return tracks.segments(all_tracks(spark, d))


@query
def trajectory_age_ramp(spark, d):
    return tracks.age_ramp(all_tracks(spark, d)).select(*tracks.TRACK, "ts", "alpha")


@query
def trajectory_endpoints(spark, d):
    return tracks.endpoints(all_tracks(spark, d))


@query
def trajectory_polyline(spark, d):
    def point(q):
        return F.concat_ws(" ", text.fixed_decimals(q["lat"], 6), text.fixed_decimals(q["lon"], 6))
    return tracks.polylines(all_tracks(spark, d)).select(
        *tracks.TRACK,
        F.size("line").cast("long").alias("n_points"),
        F.array_join(F.transform("line", point), ",").alias("line_text"),
    )


@query
def trajectory_popup_fields(spark, d):
    return tracks.popup_fields(all_tracks(spark, d))


@query
def speed_series(spark, d):
    return tracks.speed_series(all_tracks(spark, d))
