"""Whole voyages of a vessel: impossible jumps, repeated reports, and whether it sails, lies still or is silent.

Fixes of one vessel are read in order of time. A vessel has one fix a second at most once they are unique, so what
one task reads in order is bounded by the period; all of it streams through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackspark.functions import geo, timegrid
from trackspark.operators.events import event_id
from trackspark.params import EARTH_RADIUS_M, STATIONARY_STATUSES, VoyageParams

SAILING, STOPPED, SILENT = "under way", "stopped", "silent"


def flag_jumps(fixes: DataFrame, p: VoyageParams = VoyageParams()) -> DataFrame:
    """Adds ``plausible``: whether the vessel can have come here from its last plausible fix at up to ``max_kn``.

    Positions are compared, not reported speeds. A vessel's first fix is plausible. After ``patience`` fixes
    in a row that are not, the next starts anew, so a lone bad fix at the start does not condemn the voyage. Two fixes of
    one second are compared as if a second lay between. Expects unique fixes; those without time or position are left out.
    """
    metres_per_s, patience, diameter = p.max_kn * 1852.0 / 3600.0, p.patience, 2 * EARTH_RADIUS_M
    known = fixes.filter(F.col("mmsi").isNotNull() & F.col("ts").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    names = known.columns
    order = ["mmsi", "ts", *[c for c in names if c not in ("mmsi", "ts")]]
    at = [names.index(c) for c in ("mmsi", "lat", "lon")]
    schema = T.StructType([*known.schema.fields, T.StructField("plausible", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Nothing here comes from the package, so workers need not have it.
        import numpy as np

        def metres(lat1, lon1, lat2, lon2):
            h = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
            return diameter * np.arcsin(np.sqrt(np.minimum(h, 1.0)))

        vessel = last = None  # last: second, latitude and longitude of the last plausible fix
        refused = 0
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(at[0]).to_numpy()
            lat, lon = (b.column(k).to_numpy() for k in at[1:])
            sec = b.column(len(names)).to_numpy()
            good = np.ones(len(ids), bool)
            # Where all steps of a vessel are possible the last plausible fix is the one before; only the rest needs the state.
            step = np.zeros(len(ids), bool)
            step[1:] = (ids[1:] == ids[:-1]) & (metres(lat[:-1], lon[:-1], lat[1:], lon[1:]) > metres_per_s * np.maximum(sec[1:] - sec[:-1], 1))
            heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])).tolist()
            for a, z in zip(heads, [*heads[1:], len(ids)]):
                own = ids[a] == vessel
                if not own:
                    last, refused = None, 0
                k = a
                while k < z:
                    # From a plausible fix on, all up to the next impossible step are plausible.
                    if last is None or refused >= patience or metres(last[1], last[2], lat[k], lon[k]) <= metres_per_s * max(sec[k] - last[0], 1):
                        ahead = np.flatnonzero(step[k + 1 : z])
                        k = k + 1 + int(ahead[0]) if len(ahead) else z
                        last, refused = (sec[k - 1], lat[k - 1], lon[k - 1]), 0
                    else:
                        good[k] = False
                        refused += 1
                        k += 1
                vessel = ids[a]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(good)], [*names, "plausible"])

    ordered = known.withColumn("sec_", timegrid.known_epoch_s(F.col("ts"))).repartition("mmsi").sortWithinPartitions(*order)
    return ordered.mapInArrow(run, schema)


def drop_jumps(fixes: DataFrame, p: VoyageParams = VoyageParams()) -> DataFrame:
    """The plausible fixes."""
    return flag_jumps(fixes, p).filter("plausible").drop("plausible")


def _in_time(rest: list[str]) -> Window:
    return Window.partitionBy("mmsi").orderBy("ts", *rest)


def collapse_repeats(fixes: DataFrame, p: VoyageParams = VoyageParams()) -> DataFrame:
    """One fix for each run of near-equal reports, with ``n_reports``: the first of a vessel's fixes that follow each other
    within ``repeat_s`` seconds and ``repeat_m`` metres.

    Receivers pass on one message with slightly different times. Runs have no fixed ends, so midnight does not cut them; of fixes of one
    second the lowest by the other columns comes first.
    """
    rest = [c for c in fixes.columns if c not in ("mmsi", "ts")]
    w = _in_time(rest)
    gap = timegrid.epoch_s(F.col("ts")) - F.lag(timegrid.epoch_s(F.col("ts"))).over(w)
    away = geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    begins = ~F.coalesce((gap <= p.repeat_s) & (away <= p.repeat_m), F.lit(False))
    known = fixes.filter(F.col("mmsi").isNotNull() & F.col("ts").isNotNull())
    runs = known.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # By vessel already, so this needs no shuffle.
    first = F.min(F.struct("ts", *rest)).alias("first")
    return runs.groupBy("mmsi", "run").agg(first, F.count("*").alias("n_reports")).select(
        *[F.col(c) if c == "mmsi" else F.col(f"first.{c}") for c in fixes.columns], "n_reports"
    )


def _state(p: VoyageParams) -> Column:
    """Stopped by status or by speed; where one is missing the other decides, where both are, the vessel counts as under way."""
    lies = F.col("nav_status").isin(*STATIONARY_STATUSES) | (F.col("sog") < p.still_kn)
    return F.when(F.coalesce(lies, F.lit(False)), STOPPED).otherwise(SAILING)


def movement_states(fixes: DataFrame, p: VoyageParams = VoyageParams()) -> DataFrame:
    """Rows ``mmsi``, ``state``, ``from_ts``, ``to_ts``, ``n_fixes``: stretches of a voyage in one state.

    ``fixes`` has to hold those of lying vessels, too. Two fixes over ``silence_s`` apart have a stretch of silence
    between them, with no fix, from one to the other.
    """
    known = fixes.filter(F.col("mmsi").isNotNull() & F.col("ts").isNotNull()).withColumn("state", _state(p))
    w = _in_time(["state", *[c for c in fixes.columns if c not in ("mmsi", "ts")]])
    silent = timegrid.epoch_s(F.col("ts")) - F.lag(timegrid.epoch_s(F.col("ts"))).over(w) > p.silence_s
    told = known.select("mmsi", "state", "ts", F.lag("ts").over(w).alias("before"), F.coalesce(silent, F.lit(False)).alias("silent"), F.lag("state").over(w).alias("was"), *[
        c for c in fixes.columns if c not in ("mmsi", "ts")
    ])
    begins = F.col("silent") | ~F.col("was").eqNullSafe(F.col("state"))
    told = told.withColumn("begins", begins.cast("int")).withColumn("stretch", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    here = F.struct(F.col("state"), F.col("ts").alias("from_ts"), F.col("ts").alias("to_ts"), F.lit(1).alias("n"))
    gap = F.struct(F.lit(SILENT).alias("state"), F.col("before").alias("from_ts"), F.col("ts").alias("to_ts"), F.lit(0).alias("n"))
    rows = told.select("mmsi", "stretch", F.inline(F.when(F.col("silent"), F.array(gap, here)).otherwise(F.array(here))))
    return rows.groupBy("mmsi", "stretch", "state").agg(
        F.min("from_ts").alias("from_ts"), F.max("to_ts").alias("to_ts"), F.sum("n").alias("n_fixes")
    ).drop("stretch")


def track_endings(events: DataFrame, states: DataFrame, half_window_s: int = 600, p: VoyageParams = VoyageParams()) -> DataFrame:
    """Rows ``event_id``, ``role``, ``mmsi``, ``ending``: the vessel's state where its track around an event ends.

    That is the stretch which holds the end of the window (of two that meet there, the later); a vessel last heard of before it, even if by less than
    ``silence_s``, is in the state it was last heard in, and silent if that was longer ago.
    """
    if "event_id" not in events.columns:
        events = events.withColumn("event_id", event_id())
    ends = F.timestamp_seconds(timegrid.epoch_s(F.col("collision_ts")) + half_window_s)
    wanted = events.select("event_id", ends.alias("end_ts"), F.inline(F.array(*[
        F.struct(F.lit(f"vessel{i}").alias("role"), F.col(f"mmsi{i}").alias("mmsi")) for i in (1, 2)
    ])))
    # Spark has no as-of join. A row for each event among the vessel's stretches takes the last stretch before it along.
    begun = states.select("mmsi", F.col("from_ts").alias("at"), F.lit(0).alias("kind"), F.struct("state", "to_ts", "from_ts").alias("s"), F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("string").alias("role"))
    asked = wanted.select("mmsi", F.col("end_ts").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(begun.schema["s"].dataType).alias("s"), "event_id", "role")
    w = Window.partitionBy("mmsi").orderBy("at", "kind", "s.to_ts").rowsBetween(Window.unboundedPreceding, 0)
    last = begun.unionByName(asked).withColumn("last", F.last("s", ignorenulls=True).over(w)).filter("kind = 1")
    quiet = timegrid.epoch_s(F.col("at")) - timegrid.epoch_s(F.col("last.to_ts")) > p.silence_s
    return last.select("event_id", "role", "mmsi", F.when(F.coalesce(quiet, F.lit(True)), SILENT).otherwise(F.col("last.state")).alias("ending"))
