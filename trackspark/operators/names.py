"""Names for the vessels of an event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.functions import text


def modal_names(fixes: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The most frequent usable name of each vessel; ties go to the first in order.

    Counts per (vessel, name) come first, so a vessel with very many fixes is a
    handful of rows when it reaches the second aggregation. ``only`` (``mmsi``)
    restricts the vessels; the semi-join meets counts, not fixes, unless the ids
    are few enough for Spark to broadcast them below the aggregation.
    """
    counted = (
        fixes.filter(text.usable_lookup_name(F.col("name")))
        .groupBy("mmsi", "name")
        .agg(F.count("*").alias("n"))
    )
    if only is not None:
        counted = counted.join(only, "mmsi", "left_semi")
    return counted.groupBy("mmsi").agg(
        F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("modal_name")
    )


def resolve_names(events: DataFrame, fixes: DataFrame) -> DataFrame:
    """Fills in names: the event's own, else the modal one, else ``MMSI <id>``.

    Names are looked up only for vessels that lack one in some event.
    """
    unnamed = events.select(
        F.explode(F.array(*[
            F.when(~text.usable_row_name(F.col(f"name{i}")), F.col(f"mmsi{i}")) for i in (1, 2)
        ])).alias("mmsi")
    ).filter(F.col("mmsi").isNotNull()).distinct()
    known = modal_names(fixes, unnamed)
    named = events
    for i in (1, 2):
        lookup = known.select(F.col("mmsi").alias(f"mmsi{i}"), F.col("modal_name").alias(f"modal{i}"))
        named = named.join(lookup, f"mmsi{i}", "left")
    final = {
        f"name{i}": F.when(text.usable_row_name(F.col(f"name{i}")), F.col(f"name{i}")).otherwise(
            F.coalesce(F.col(f"modal{i}"), F.concat(F.lit("MMSI "), F.col(f"mmsi{i}").cast("string")))
        )
        for i in (1, 2)
    }
    return named.withColumns(final).select(*events.columns)
