"""Whole-second time arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_s(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def known_epoch_s(ts: Column) -> Column:
    """Epoch seconds of a ``ts`` that is known not to be NULL.

    The result is never NULL, so Spark derives no NULL checks from join keys built
    on it. Pushed below a de-duplication, such checks would make the steps that
    read the same fixes differ, and their shuffles could not be shared.
    """
    return F.coalesce(F.unix_timestamp(ts), F.lit(0))


def time_bucket(seconds: Column, width_s: int) -> Column:
    """Number of the time bucket that holds an epoch second."""
    return F.floor(seconds / width_s)


def known_time_bucket(seconds: Column, width_s: int) -> Column:
    """The same for seconds that are never NULL."""
    return F.coalesce(time_bucket(seconds, width_s), F.lit(0))


def time_gap_s(ts1: Column, ts2: Column) -> Column:
    return F.abs(epoch_s(ts1) - epoch_s(ts2))
