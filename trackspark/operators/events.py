"""Candidates to events: observation counts, closest approach, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import text
from trackspark.params import EventParams
from trackspark.schemas import CANDIDATE_SCHEMA, EVENT_SCHEMA, PAIR_DAY_SCHEMA

PAIR = ["mmsi1", "mmsi2"]
_CLOSEST_FIRST = ["dist_m", "ts1", "ts2"]
_RANKED = ["dist_m", *PAIR, "ts1", "ts2"]


def pair_observation_counts(candidates: DataFrame) -> DataFrame:
    """How often each pair was seen close, over the whole period given."""
    return candidates.groupBy(*PAIR).agg(F.count("*").alias("n_obs"))


def transient_pairs(candidates: DataFrame, p: EventParams = EventParams()) -> DataFrame:
    """Pairs seen at most ``max_obs`` times: encounters."""
    return pair_observation_counts(candidates).filter(F.col("n_obs") <= p.max_obs)


def persistent_pairs(candidates: DataFrame, p: EventParams = EventParams()) -> DataFrame:
    """Pairs seen more often: vessels that work side by side."""
    return pair_observation_counts(candidates).filter(F.col("n_obs") > p.max_obs)


def candidates_of_transient_pairs(candidates: DataFrame, p: EventParams = EventParams()) -> DataFrame:
    """All candidates of the transient pairs, from one shuffle of ``candidates``.

    The rows of a pair are counted where they lie; a busy pair spills to disk there.
    :func:`closest_approach` does not need this step.
    """
    counted = candidates.withColumn("n_obs", F.count("*").over(Window.partitionBy(*PAIR)))
    return counted.filter(F.col("n_obs") <= p.max_obs).drop("n_obs")


def closest_approach(candidates: DataFrame, p: EventParams = EventParams()) -> DataFrame:
    """The closest candidate of each transient pair, with ``n_obs``.

    Count and minimum come from one aggregation that is partial before its only
    shuffle: a pair with any number of candidates leaves a map task as one row.
    """
    rest = [c for c in candidates.columns if c not in (*PAIR, *_CLOSEST_FIRST)]
    per_pair = candidates.groupBy(*PAIR).agg(
        F.count("*").alias("n_obs"),
        F.min(F.struct(*_CLOSEST_FIRST, *rest)).alias("closest"),
    )
    return per_pair.filter(F.col("n_obs") <= p.max_obs).select(
        *[F.col(c) if c in PAIR else F.col(f"closest.{c}") for c in candidates.columns], "n_obs"
    )


def pair_days(candidates: DataFrame, *by: str) -> DataFrame:
    """What the candidates say of each pair, and of each ``by`` (``PAIR_DAY_SCHEMA``): their number, and the closest.

    Of several days, or any other parts without a common candidate, :func:`approaches_of` makes what
    :func:`closest_approach` makes of all candidates: counts add up, and the least of the least is the least.
    """
    closest = F.struct(*PAIR_DAY_SCHEMA["closest"].dataType.names)
    return candidates.groupBy(*PAIR, *by).agg(F.count("*").alias("n_obs"), F.min(closest).alias("closest"))


def merge_pair_days(*parts: DataFrame) -> DataFrame:
    """One row a pair from the rows of several parts, in any order and grouping."""
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy(*PAIR).agg(F.sum("n_obs").alias("n_obs"), F.min("closest").alias("closest"))


def approaches_of(merged: DataFrame, p: EventParams = EventParams()) -> DataFrame:
    """The closest approach of each transient pair, from its merged days."""
    few = merged.filter(F.col("n_obs") <= p.max_obs)
    return few.select(*[F.col(c) if c in PAIR else F.col(f"closest.{c}") for c in CANDIDATE_SCHEMA.names], "n_obs")


def top_k_events(approaches: DataFrame, k: int) -> DataFrame:
    """The ``k`` closest approaches; ties go to the lower ids, then times."""
    return approaches.orderBy(*_RANKED).limit(k)


def to_events(approaches: DataFrame) -> DataFrame:
    """Projects closest approaches to ``EVENT_SCHEMA``."""
    return approaches.withColumnRenamed("dist_m", "min_distance_m").select(*EVENT_SCHEMA.names)


def closest_events(candidates: DataFrame, p: EventParams = EventParams()) -> DataFrame:
    """The ``k`` closest one-time encounters; empty if there is none."""
    return to_events(top_k_events(closest_approach(candidates, p), p.k))


def json_fields(events: DataFrame) -> DataFrame:
    """Event fields as the JSON result carries them."""
    return events.withColumn("collision_ts", text.iso_utc(F.col("collision_ts")))


def display_fields(events: DataFrame) -> DataFrame:
    """Event fields as text for people: time, position, distance."""
    return events.select(
        *PAIR, "name1", "name2",
        text.stamp_utc(F.col("collision_ts")).alias("time_text"),
        text.fixed_decimals(F.col("collision_lat"), 6).alias("lat_text"),
        text.fixed_decimals(F.col("collision_lon"), 6).alias("lon_text"),
        text.fixed_decimals(F.col("min_distance_m"), 1).alias("distance_text"),
    )


def event_id() -> Column:
    """A pair has one event, so its ids name it."""
    return F.concat_ws("-", F.col("mmsi1"), F.col("mmsi2"))
