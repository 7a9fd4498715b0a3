"""Close pairs of fixes: a self-join on time bucket and grid cell.

One side of the join stays as it is, one row per fix in its own cell. The other
is copied only into the cells its search circle really meets, and only forward:
into its own cell and those after it in (bucket, band, column) order. Of two
fixes in different cells exactly one reaches forward to the other, so each pair
is found once. With the default cells that is about 1.7 copies per fix.

The join key is equality on integers; gap, distance and identity are the residual
condition of the same join, so no candidate that fails them leaves it.

Crowded cells are found by one count and taken out of that join. In them positions meet
before fixes do, and the cell is split: its positions are dealt out, and what reaches the
cell goes to each part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.functions import geo
from trackspark.operators.clean import filter_service_vessels
from trackspark.params import EARTH_RADIUS_M, ProximityParams
from trackspark.schemas import CANDIDATE_SCHEMA

_CARRIED = ("mmsi", "ts", "lat", "lon", "sog", "name")
#: The join key: equal in a fix and in the copies that reach its cell.
CELL_KEY = ("bucket", "band", "col")
#: Up to this many crowded cells go to all tasks; more of them are joined by shuffle.
BROADCAST_CELLS = 100_000


def with_cells(df: DataFrame, cell_deg: float = 0.01) -> DataFrame:
    """Adds the plain grid cell of a fix: ``grid_x`` (latitude), ``grid_y``."""
    return df.withColumns({
        "grid_x": geo.grid_cell(F.col("lat"), cell_deg),
        "grid_y": geo.grid_cell(F.col("lon"), cell_deg),
    })


def neighbour_cells(df: DataFrame, cell_deg: float = 0.01, radius: int = 1) -> DataFrame:
    """Copies each fix to its grid cell and those around it: ``join_gx``, ``join_gy``."""
    def around(value: str) -> Column:
        own = geo.grid_cell(F.col(value), cell_deg)
        return F.explode(F.sequence(own - radius, own + radius))

    return df.withColumn("join_gx", around("lat")).withColumn("join_gy", around("lon"))


# The join's expressions are SQL text: a plan of this size takes longer to build from single columns than small tables take to join.

def _number(x: float) -> str:
    return f"{float(x)!r}D"


def _band(lat: str, p: ProximityParams) -> str:
    return f"cast(floor({lat} / {_number(p.cell_deg)}) AS int)"


def _column(lon: str, band: str, p: ProximityParams) -> str:
    """As :func:`trackspark.functions.geo.band_column`."""
    size = _number(p.cell_deg)
    return f"cast(floor({lon} * cos(radians(({band} + 0.5D) * {size})) / {size}) AS int)"


def _bucket(sec: str, p: ProximityParams) -> str:
    return f"coalesce(floor({sec} / {p.bucket_s}), 0L)"


def join_cells(fixes: DataFrame, p: ProximityParams = ProximityParams()) -> DataFrame:
    """The fixes that may be in a pair, with the join key: what :func:`pairs_of_cells` reads."""
    # All conditions that joins would infer stand here, so that what reads it keeps one plan.
    moving = fixes.filter(f"sog >= {_number(p.min_sog)} AND ts IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    keyed = moving.selectExpr(*_CARRIED, "coalesce(unix_timestamp(ts), 0L) AS sec", f"{_band('lat', p)} AS band")
    return keyed.selectExpr("*", f"{_bucket('sec', p)} AS bucket", f"{_column('lon', 'band', p)} AS col")


#: The name it had before.
_keyed = join_cells


def _reaching(keyed: DataFrame, p: ProximityParams) -> DataFrame:
    """The forward copies; ``home`` marks the one in the fix's own cell.

    A circle across +-180 degrees also reaches from the other side of that line: ``seen_lon``
    is the longitude it reaches from. Inside one band only rows from the east do so, since
    two rows would else meet twice.
    """
    high = _number(geo.lat_reach_deg(p.max_dist_m))
    ratio = f"({_number(math.sin(p.max_dist_m / EARTH_RADIUS_M))} / cos(radians(lat)))"
    reach = f"degrees(asin(least({ratio}, 1D))) * {_number(1 + 1e-9)} + {_number(1e-12)}"
    copies = keyed.selectExpr(
        "* EXCEPT (bucket, band, col)", "bucket AS own_bucket", "band AS own_band", "col AS own_col",
        # Half the globe round a pole.
        f"CASE WHEN {ratio} >= 0 AND {ratio} < 1 THEN {reach} ELSE 180D END AS lon_reach",
        f"explode(sequence(bucket, {_bucket(f'(sec + {p.max_dt_s})', p)})) AS bucket" if p.time_mode == "exact" else "bucket",
    )
    first_band = f"CASE WHEN bucket = own_bucket THEN own_band ELSE {_band(f'(lat - {high})', p)} END"
    copies = copies.selectExpr("*", f"explode(sequence({first_band}, {_band(f'(lat + {high})', p)})) AS band")
    same_band = "(bucket = own_bucket AND band = own_band)"
    east, west = "lon + lon_reach > 180", f"(lon - lon_reach < -180 AND NOT {same_band})"
    copies = copies.selectExpr("*", f"""explode(CASE WHEN {east} AND {west} THEN array(lon, lon - 360, lon + 360)
        WHEN {east} THEN array(lon, lon - 360) WHEN {west} THEN array(lon, lon + 360) ELSE array(lon) END) AS seen_lon""")
    own_side = f"{same_band} AND seen_lon = lon"
    first = f"CASE WHEN {own_side} THEN own_col ELSE {_column('greatest(seen_lon - lon_reach, -180D)', 'band', p)} END"
    copies = copies.selectExpr("*", f"explode(sequence({first}, {_column('least(seen_lon + lon_reach, 180D)', 'band', p)})) AS col")
    return copies.selectExpr("* EXCEPT (own_bucket, own_band, own_col)", f"{own_side} AND col = own_col AS home")


def _crowded(keyed: DataFrame, fixes: DataFrame, p: ProximityParams) -> DataFrame:
    """Cells of more than ``crowd`` fixes, with the number of parts they are split into.

    A table with fewer fixes than ``crowd * BROADCAST_CELLS`` has no more such cells than go to all
    tasks, which the limit tells Spark. Where the size estimate leaves that open they are counted first.
    """
    # Counting a column of the rows keeps their plan, so that its shuffle is reused.
    cells = keyed.groupBy(*CELL_KEY).agg(F.expr("count(sec) AS n")).filter(f"n > {p.crowd}")
    cells = cells.selectExpr(*CELL_KEY, f"cast(ceil(n / {p.crowd}) AS int) AS parts")
    # A fix takes a byte at least, however the table is stored.
    bytes_ = int(str(fixes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if bytes_ >= p.crowd * BROADCAST_CELLS and cells.limit(BROADCAST_CELLS + 1).count() > BROADCAST_CELLS:
        return cells
    # In a fixed order, so that both uses agree even if the estimate was wrong.
    return F.broadcast(cells.orderBy(F.desc("parts"), *CELL_KEY).limit(BROADCAST_CELLS))


def _within(p: ProximityParams) -> str:
    """Rows ``a_*`` in a cell and ``b_*`` that reach it lie within the distance limits."""
    east = "abs(a_lon - b_seen_lon)"
    # Grows with the distance, so the limits are two constants.
    chord = (
        "(pow(sin(radians(b_lat - a_lat) / 2), 2)"
        " + cos(radians(a_lat)) * cos(radians(b_lat)) * pow(sin(radians(b_lon - a_lon) / 2), 2))"
    )
    # Plain comparisons first: they settle most rows before the trigonometry.
    # Just half the globe apart, rows meet on their own side of the line only.
    return (
        f"abs(a_lat - b_lat) <= {_number(geo.lat_reach_deg(p.max_dist_m))} AND {east} <= b_lon_reach"
        f" AND (b_seen_lon = b_lon OR {east} < 180)"
        f" AND {chord} > {_number(geo.half_chord2_of(p.min_dist_m))} AND {chord} <= {_number(geo.half_chord2_of(p.max_dist_m))}"
    )


def _sides(here: DataFrame, there: DataFrame, cell: Sequence[str], carried: Sequence[str]) -> tuple[DataFrame, DataFrame, str]:
    """The rows of cells as ``a_*``, those that reach them as ``b_*``, and that they meet in a cell."""
    here = here.selectExpr(*cell, *[f"{c} AS a_{c}" for c in carried])
    way = ["home", "seen_lon AS b_seen_lon", "lon_reach AS b_lon_reach"]
    there = there.selectExpr(*[f"{k} AS to_{k}" for k in cell], *way, *[f"{c} AS b_{c}" for c in carried])
    return here, there, " AND ".join(f"{k} = to_{k}" for k in cell)


def _meet_directly(keyed: DataFrame, crowded: DataFrame, p: ProximityParams) -> DataFrame:
    """Pairs of fixes that meet in the cells that are not crowded."""
    here, there, same = _sides(
        keyed.join(crowded, [*CELL_KEY], "left_anti"), _reaching(keyed, p).join(crowded, [*CELL_KEY], "left_anti"), CELL_KEY, (*_CARRIED, "sec")
    )
    # In its own cell two rows meet twice, elsewhere once and in either order.
    other = "CASE WHEN home THEN a_mmsi < b_mmsi ELSE a_mmsi <> b_mmsi END"
    return here.join(there, F.expr(f"{same} AND abs(a_sec - b_sec) <= {p.max_dt_s} AND {_within(p)} AND {other}"), "inner")


_PLACE = ("at_bucket", "lat", "lon")
# What tells the rows apart that reach a cell from one place.
_WAY = ("home", "seen_lon")


def _in_crowded(keyed: DataFrame, crowded: DataFrame, p: ProximityParams) -> tuple[DataFrame, DataFrame]:
    """The fixes in crowded cells, and the copies of fixes that reach them."""
    at = keyed.selectExpr("*", "bucket AS at_bucket")
    return at.join(crowded, [*CELL_KEY]), _reaching(at, p).join(crowded, [*CELL_KEY])


def _near_positions(here: DataFrame, there: DataFrame, p: ProximityParams) -> DataFrame:
    """Pairs of positions that meet in crowded cells: ``a_near_*``, ``b_near_*``, the cell and the way to it.

    A position is one row per time bucket and cell however many vessels report it.
    """
    here = here.groupBy(*CELL_KEY, *_PLACE).agg(F.expr("max(parts) AS parts"))
    here = here.selectExpr("*", "cast(pmod(xxhash64(lat, lon), parts) AS int) AS part")
    there = there.groupBy(*CELL_KEY, *_PLACE, *_WAY, "lon_reach").agg(F.expr("max(parts) AS parts"))
    there = there.selectExpr("*", "explode(sequence(0, parts - 1)) AS part")
    here, there, same = _sides(here, there, (*CELL_KEY, "part"), _PLACE)
    once = "(NOT home OR struct(a_lat AS lat, a_lon AS lon) < struct(b_lat AS lat, b_lon AS lon))"
    near = here.join(there, F.expr(f"{same} AND {once} AND {_within(p)}"), "inner")
    places = [f"{side}_{c} AS {side}_near_{c}" for side in "ab" for c in _PLACE]
    return near.selectExpr(*[f"{k} AS near_{k}" for k in CELL_KEY], "home AS near_home", "b_seen_lon AS near_seen_lon", *places)


def _meet_by_position(keyed: DataFrame, crowded: DataFrame, p: ProximityParams) -> DataFrame:
    """Pairs of fixes that meet in crowded cells, by way of pairs of positions.

    Vessels that share a position are never compared with each other. Every input
    goes through the table of crowded cells first, so where that is empty nothing else runs.
    """
    here, there = _in_crowded(keyed, crowded, p)
    near = _near_positions(here, there, p)

    def members(rows: DataFrame, side: str, more: Sequence[str]) -> tuple[DataFrame, str]:
        named = {**{k: f"near_{k}" for k in (*CELL_KEY, *more)}, **{c: f"{side}_near_{c}" for c in _PLACE}}
        rows = rows.selectExpr(*[f"{c} AS {side}_{c}" for c in (*_CARRIED, "sec")], *[f"{c} AS {side}_by_{c}" for c in named])
        return rows, " AND ".join(f"{side}_by_{c} = {n}" for c, n in named.items())

    (a, at_a), (b, at_b) = members(here, "a", ()), members(there, "b", _WAY)
    apart = f"a_mmsi <> b_mmsi AND abs(a_sec - b_sec) <= {p.max_dt_s}"
    met = near.join(a, F.expr(at_a), "inner").join(b, F.expr(f"{at_b} AND {apart}"), "inner")
    return met.select(*_MET)


_MET = [f"{side}_{c}" for side in "ab" for c in (*_CARRIED, "sec")]


def _as_candidates(met: DataFrame) -> DataFrame:
    found = {
        **{f"{c}{i}": f"if(a_mmsi > b_mmsi, {other}_{c}, {side}_{c})" for c in _CARRIED for i, side, other in ((1, "a", "b"), (2, "b", "a"))},
        "dt_sec": "abs(a_sec - b_sec)",
        "collision_ts": "least(a_ts, b_ts)",
    }
    columns = {
        "dist_m": geo.haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")),
        "collision_lat": geo.midpoint(F.col("a_lat"), F.col("b_lat")),
        "collision_lon": geo.mid_longitude(F.col("a_lon"), F.col("b_lon")),
    }
    return met.select(*[F.expr(f"{found[n]} AS {n}") if n in found else columns[n].alias(n) for n in CANDIDATE_SCHEMA.names])


def proximity_pairs(fixes: DataFrame, p: ProximityParams = ProximityParams()) -> DataFrame:
    """Pairs of fixes of two vessels close in space and time (``CANDIDATE_SCHEMA``).

    Expects one fix per (mmsi, ts), as :func:`~trackspark.operators.dedupe.dedupe_fixes`
    gives; then no vessel has more than ``bucket_s`` rows under one join key, and
    each pair of fixes appears once, across +-180 degrees and the poles too. Longitudes
    run from -180 to 180.

    Fixes meet in their cells; in cells of more than ``crowd`` fixes positions do first, so vessels
    piled up on one identical position are never compared with each other, and the cell is split among tasks.
    """
    return _pairs(join_cells(fixes, p), fixes, p)


def pairs_of_cells(keyed: DataFrame, p: ProximityParams = ProximityParams()) -> DataFrame:
    """As :func:`proximity_pairs`, from rows of :func:`join_cells` with the same parameters.

    Where these are stored in buckets of the join key (``stores.write_cells``), only the copies that
    reach cells are shuffled, and no shuffle is needed to count the cells.
    """
    return _pairs(keyed, keyed, p)


def _pairs(keyed: DataFrame, fixes: DataFrame, p: ProximityParams) -> DataFrame:
    crowded = _crowded(keyed, fixes, p)
    met = _meet_directly(keyed, crowded, p).select(*_MET)
    return _as_candidates(met.union(_meet_by_position(keyed, crowded, p)))


def find_candidates(fixes: DataFrame, p: ProximityParams = ProximityParams()) -> DataFrame:
    """Close pairs among the vessels that do not come close as part of their work."""
    return proximity_pairs(filter_service_vessels(fixes, p), p)


def union_candidates(*parts: DataFrame) -> DataFrame:
    """Candidates of several sources in one table (UNION ALL by column name)."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
