"""Geometry as Spark column expressions: everything stays inside codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackspark.params import EARTH_RADIUS_KM, EARTH_RADIUS_M


def _arc(h: Column, radius: float) -> Column:
    # Rounding may push h a hair above 1 for antipodal points.
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * F.lit(2.0 * radius)


def half_chord2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared half chord of two points on the unit sphere; grows with their distance."""
    north = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
    east = F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return north + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * east


def half_chord2_of(dist_m: float) -> float:
    """The same for a distance; half the globe round is the farthest."""
    return math.sin(min(dist_m / (2 * EARTH_RADIUS_M), math.pi / 2)) ** 2


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of two points in metres; symmetric to the last bit."""
    return _arc(half_chord2(lat1, lon1, lat2, lon2), EARTH_RADIUS_M)


def haversine_km_to(lat: Column, lon: Column, point_lat: float, point_lon: float) -> Column:
    """Great-circle distance to one fixed point in kilometres."""
    phi, lam = math.radians(point_lat), math.radians(point_lon)
    north = F.pow(F.sin((F.radians(lat) - phi) / 2), 2)
    east = F.pow(F.sin((F.radians(lon) - lam) / 2), 2)
    return _arc(north + math.cos(phi) * F.cos(F.radians(lat)) * east, EARTH_RADIUS_KM)


def grid_cell(deg: Column, size_deg: float) -> Column:
    """Index of the grid cell that holds a coordinate."""
    return F.floor(deg / size_deg).cast("int")


def lat_reach_deg(dist_m: float) -> float:
    """Largest difference in latitude of two points ``dist_m`` apart."""
    return math.degrees(dist_m / EARTH_RADIUS_M) * (1 + 1e-9) + 1e-12


def lon_reach_deg(lat: Column, dist_m: float) -> Column:
    """Largest difference in longitude of a point at ``lat`` and one ``dist_m`` away; 180 round a pole."""
    ratio = F.lit(math.sin(dist_m / EARTH_RADIUS_M)) / F.cos(F.radians(lat))
    reach = F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9) + 1e-12
    return F.when((ratio >= 0) & (ratio < 1), reach).otherwise(180.0)


def band_column(lon: Column, band: Column, size_deg: float) -> Column:
    """Index of a longitude inside a latitude band.

    Columns widen towards the poles, so that cells have about the same width in
    metres everywhere and a search circle meets equally many of them.
    """
    mid = F.radians((band + 0.5) * size_deg)
    return F.floor(lon * F.cos(mid) / size_deg).cast("int")


def midpoint(a: Column, b: Column) -> Column:
    """Mean of two latitudes."""
    return (a + b) / 2


def mid_longitude(a: Column, b: Column) -> Column:
    """The longitude midway between two, the short way round."""
    mean = (a + b) / 2
    return F.when(F.abs(a - b) <= 180, mean).otherwise(F.when(mean < 0, mean + 180).otherwise(mean - 180))


def curve_key(lat: Column, lon: Column) -> Column:
    """Place of a coordinate on a Z-order curve over the globe, in 2^16 steps either way: near points have mostly near keys."""
    def spread(deg: Column, span: float) -> Column:
        # The step's bits, with a free place after each.
        bits = F.greatest(F.lit(0), F.least(F.lit(65535), F.floor((deg + span / 2) * (65536 / span)))).cast("long")
        for shift, kept in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(kept).cast("long"))
        return bits

    # Each side is null for a missing coordinate, which least and greatest would skip.
    key = F.shiftleft(spread(lat, 180.0), 1).bitwiseOR(spread(lon, 360.0))
    return F.when(lat.isNotNull() & lon.isNotNull(), key)
