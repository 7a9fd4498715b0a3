"""CSV reports to ranked events and their tracks, with a table after each step.

Each step reads what the one before wrote, so losing executors costs the running
step at most, and no step repeats the join or the cleaning.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trackspark.operators import clean, dedupe, events, names, proximity, tracks
from trackspark.params import CleanParams, EventParams, ProximityParams, TrackParams
from trackspark.schemas import CANDIDATE_SCHEMA, FIX_SCHEMA, PAIR_DAY_SCHEMA, REPORT_COLUMNS
from trackspark.sources import manifest, reports, stores


@dataclass(frozen=True)
class JobParams:
    clean: CleanParams = field(default_factory=CleanParams)
    proximity: ProximityParams = field(default_factory=ProximityParams)
    events: EventParams = field(default_factory=EventParams)
    tracks: TrackParams = field(default_factory=TrackParams)


@dataclass(frozen=True)
class JobResult:
    events: DataFrame
    tracks: DataFrame
    n_fixes: int
    n_candidates: int
    #: Rows that this run wrote.
    written_fixes: int
    written_candidates: int


def pin_utc(spark: SparkSession) -> None:
    """Times in the reports and in all outputs are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def fixes_from_reports(typed: DataFrame, p: CleanParams = CleanParams()) -> DataFrame:
    """Typed or text reports to unique fixes."""
    return dedupe.dedupe_fixes(clean.clean_fixes(typed, p))


def _shifted(days: Sequence[str], *by: int) -> list[str]:
    found = {dt.date.fromisoformat(d) + dt.timedelta(days=n) for d in days for n in by}
    return sorted(map(str, found))


def _of_days(df: DataFrame, ts: str, days: Sequence[str]) -> DataFrame:
    """Rows of some days; the range from first to last also reaches the reader."""
    first, after = (F.lit(d).cast("timestamp") for d in (min(days), _shifted([max(days)], 1)[0]))
    return df.filter((F.col(ts) >= first) & (F.col(ts) < after) & F.to_date(ts).cast("string").isin(*days))


def _chosen(typed: DataFrame, days: Sequence[str] | None) -> DataFrame:
    return typed if days is None else _of_days(typed, "ts", days)


def _write(df: DataFrame, root: str, days: Sequence[str] | None, ts: str = "ts") -> int:
    """Writes the store, or its ``days``, and returns the number of rows written, counted by the job that writes."""
    counted = Observation()
    if days is None:
        stores.write_by_day(df, root, ts, counted=counted)
    else:
        stores.clear_days(df.sparkSession, root, FIX_SCHEMA if ts == "ts" else CANDIDATE_SCHEMA, days)
        stores.write_by_day(_of_days(df, ts, days), root, ts, replace="days", counted=counted)
    return counted.get["n"]


def _reports(spark: SparkSession, data: str, output: str, days: Sequence[str] | None) -> DataFrame:
    """The reports; with ``days`` those of files that can hold such, which the manifest in ``output`` tells."""
    if days is None:
        return reports.read_reports(spark, data)
    known = manifest.update_manifest(spark, data, f"{output}/manifest")
    if known is None:
        return reports.read_reports(spark, data)
    only = manifest.files_of(known, days)
    if not only:
        return clean.coerce_types(spark.createDataFrame([], ", ".join(f"{c} string" for c in REPORT_COLUMNS)))
    return reports.read_reports(spark, data, only=only)


def _write_pair_days(spark: SparkSession, candidates_root: str, pairs_root: str, days: Sequence[str] | None) -> None:
    """Makes the days of pairs anew from the candidates of these days alone."""
    found = stores.read_candidates(spark, candidates_root, days)
    # A day may have lost all its candidates.
    if days is not None:
        stores.clear_days(spark, pairs_root, PAIR_DAY_SCHEMA, days)
    by_day = events.pair_days(found, "day").select(*PAIR_DAY_SCHEMA.names, "day")
    stores.write_pair_days(by_day, pairs_root, "all" if days is None else "days")


def run(
    spark: SparkSession, data: str, output: str, p: JobParams = JobParams(), days: Sequence[str] | None = None
) -> JobResult:
    """Runs the whole pipeline; ``output`` is a folder all executors can reach.

    Writes ``fixes/``, ``candidates/``, ``pair_days/``, ``events/``, ``events_json/`` and
    ``tracks/`` below it. No data gives empty tables, a missing path an error.

    With ``days`` (``yyyy-MM-dd``) only the fixes of these days and the candidates they take
    part in are made anew, an encounter that began before midnight among them. Of the reports only files that can hold
    these days are opened (``manifest/``), of the candidates only these days are read: events rank what
    ``pair_days/`` has of all days, a row for each pair and day. Names and tracks come from the whole store of fixes.
    """
    pin_utc(spark)
    output = output.rstrip("/")
    fixes_root, candidates_root, pairs_root, events_root, tracks_root = (
        f"{output}/{t}" for t in ("fixes", "candidates", "pair_days", "events", "tracks")
    )

    if days is not None:
        days = _shifted(days, 0)
        if not days:
            raise ValueError("days must name a day")
    typed = _reports(spark, data, output, days)
    written_fixes = _write(fixes_from_reports(_chosen(typed, days), p.clean), fixes_root, days)
    fixes = stores.read_fixes(spark, fixes_root)

    touched, needed = days, fixes
    if days is not None:
        # As far as a pair may reach across midnight.
        over = p.proximity.time_mode == "exact" or 86_400 % p.proximity.bucket_s
        reach = -(-p.proximity.max_dt_s // 86_400) if over else 0
        touched = _shifted(days, *range(-reach, 1))
        needed = stores.read_fixes(spark, fixes_root, days=_shifted(touched, *range(reach + 1)))
    written_candidates = _write(proximity.find_candidates(needed, p.proximity), candidates_root, touched, ts="collision_ts")

    _write_pair_days(spark, candidates_root, pairs_root, touched)
    pairs = stores.read_pair_days(spark, pairs_root)
    approaches = events.approaches_of(events.merge_pair_days(pairs.drop("day")), p.events)
    closest = events.to_events(events.top_k_events(approaches, p.events.k))
    named = names.resolve_names(closest, fixes)
    named.write.mode("overwrite").parquet(events_root)
    ranked = stores.read_events(spark, events_root)
    stores.write_event_json(ranked, f"{output}/events_json")

    tracks.trajectories(fixes, ranked, p.tracks).write.mode("overwrite").parquet(tracks_root)
    return JobResult(
        events=ranked,
        tracks=stores.read_tracks(spark, tracks_root),
        # Whole stores: without days, what was just written; else the footers of the files, and the days of pairs.
        n_fixes=written_fixes if days is None else fixes.count(),
        n_candidates=written_candidates if days is None else pairs.agg(F.coalesce(F.sum("n_obs"), F.lit(0))).first()[0],
        written_fixes=written_fixes,
        written_candidates=written_candidates,
    )
