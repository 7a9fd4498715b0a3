"""Text rules: dirty numbers, vessel names, output formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackspark.params import UNUSABLE_LOOKUP_NAMES, UNUSABLE_ROW_NAMES

ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"
STAMP_UTC = "yyyy-MM-dd HH:mm:ss 'UTC'"
CLOCK = "HH:mm:ss"

_WHITESPACE = " \t\n\r\x0b\x0c"


def tolerant_long(text: Column) -> Column:
    """Text to long; NULL if it is no number, fraction cut off if it has one."""
    whole = F.when(
        text.rlike(r"^\s*[+-]?\d+\.\d*\s*$"), F.substring_index(text, ".", 1)
    ).try_cast("long")
    return F.coalesce(text.try_cast("long"), whole)


def usable_row_name(name: Column) -> Column:
    stripped = F.btrim(name, F.lit(_WHITESPACE))
    return name.isNotNull() & ~stripped.isin(*UNUSABLE_ROW_NAMES)


def usable_lookup_name(name: Column) -> Column:
    return name.isNotNull() & ~name.isin(*UNUSABLE_LOOKUP_NAMES)


def fixed_decimals(value: Column, digits: int) -> Column:
    """Fixed-point text, rounded from the exact binary value, half to even."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, ISO_UTC)


def stamp_utc(ts: Column) -> Column:
    return F.date_format(ts, STAMP_UTC)


def clock(ts: Column) -> Column:
    return F.date_format(ts, CLOCK)
