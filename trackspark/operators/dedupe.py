"""De-duplication with a fixed survivor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lowest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """One row per key: the lowest by ``order_by``, then by all other columns.

    ``min`` over a struct aggregates partially before the shuffle, so a key with
    any number of copies leaves each map task as one row.
    """
    lead = [c for c in order_by if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in lead]
    if not lead and not rest:
        return df.dropDuplicates(list(keys))
    lowest = df.groupBy(*keys).agg(F.min(F.struct(*lead, *rest)).alias("lowest"))
    return lowest.select(*[F.col(c) if c in keys else F.col(f"lowest.{c}") for c in df.columns])


def dedupe_fixes(fixes: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """One fix per vessel and second."""
    return lowest_per_key(fixes, ["mmsi", "ts"], order_by)


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """One candidate per pair of fixes, for candidate tables brought from outside.

    :func:`trackspark.operators.proximity.proximity_pairs` emits each once.
    """
    return lowest_per_key(candidates, ["mmsi1", "mmsi2", "ts1", "ts2"], ["dist_m"])
