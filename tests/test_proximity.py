from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from tests.conftest import BASE, at, fix, fixes, plus
from trackspark.operators.dedupe import dedupe_candidates, dedupe_fixes
from trackspark.operators.proximity import (
    find_candidates, neighbour_cells, proximity_pairs, union_candidates, with_cells,
)
from trackspark.params import ProximityParams
from trackspark.schemas import CANDIDATE_SCHEMA

EXACT = ProximityParams(time_mode="exact")
M_LAT = 1 / 111194.92664  # degrees of latitude per metre


def n_pairs(spark, a, b, p=ProximityParams()) -> int:
    return proximity_pairs(fixes(spark, a, b), p).count()


def test_golden_pair(spark):
    df = fixes(
        spark,
        fix(219021240, at("2021-12-13 02:27:29"), 55.223067, 14.243683, 6.0, name="KARIN HOEJ"),
        fix(232018267, at("2021-12-13 02:27:58"), 55.223092, 14.243730, 5.0, name="MV SCOT CARRIER"),
    )
    out = proximity_pairs(df)
    assert out.columns == CANDIDATE_SCHEMA.names
    got = out.first()
    assert (got.mmsi1, got.mmsi2, got.name1, got.name2) == (219021240, 232018267, "KARIN HOEJ", "MV SCOT CARRIER")
    assert got.dist_m == pytest.approx(4.075970264224345, abs=1e-6)
    assert got.collision_lat == pytest.approx(55.2230795) and got.collision_lon == pytest.approx(14.2437065)
    assert got.dt_sec == 29
    assert out.selectExpr("date_format(collision_ts, 'HH:mm:ss') AS t").first().t == "02:27:29"


@pytest.mark.parametrize("start, gap, bucket, exact", [
    (0, 30, 1, 1), (0, 31, 0, 0), (59, 1, 0, 1), (45, 30, 0, 1), (45, 31, 0, 0), (0, 0, 1, 1),
])
def test_time_gap(spark, start, gap, bucket, exact):
    a, b = fix(1, plus(start)), fix(2, plus(start + gap), lat=55.2 + 50 * M_LAT)
    assert n_pairs(spark, a, b) == bucket
    assert n_pairs(spark, a, b, EXACT) == exact


@pytest.mark.parametrize("metres, expected", [(0, 0), (0.9, 0), (1.1, 1), (299, 1), (301, 0)])
def test_distance_limits(spark, metres, expected):
    assert n_pairs(spark, fix(1), fix(2, lat=55.2 + metres * M_LAT)) == expected


@pytest.mark.parametrize("sog, expected", [(1.99, 0), (2.0, 1), (None, 0)])
def test_both_must_move(spark, sog, expected):
    assert n_pairs(spark, fix(1), fix(2, lat=55.2005, sog=sog)) == expected
    assert n_pairs(spark, fix(1, sog=sog), fix(2, lat=55.2005)) == expected


def test_a_vessel_does_not_meet_itself(spark):
    assert n_pairs(spark, fix(1), fix(1, plus(5), lat=55.2005)) == 0


def test_pair_is_ordered_by_id_whatever_cell_it_lies_in(spark):
    low, high = (55.1999, 14.1999), (55.2001, 14.2001)
    for one, two in ((low, high), (high, low)):
        out = proximity_pairs(fixes(
            spark, fix(7, BASE, *one, name="seven"), fix(3, plus(4), *two, name="three")
        )).collect()
        assert [(r.mmsi1, r.mmsi2, r.name1, r.name2, r.lat1, r.lat2) for r in out] == [
            (3, 7, "three", "seven", two[0], one[0])]


def haversine(a, b) -> float:
    p1, p2 = math.radians(a[2]), math.radians(b[2])
    h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(
        math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def brute_force(rows, p: ProximityParams) -> set:
    found = set()
    for a in rows:
        for b in rows:
            if a[0] >= b[0] or a[4] < p.min_sog or b[4] < p.min_sog:
                continue
            sa, sb = int(a[1].timestamp()), int(b[1].timestamp())
            if p.time_mode == "bucket" and sa // p.bucket_s != sb // p.bucket_s:
                continue
            if abs(sa - sb) <= p.max_dt_s and p.min_dist_m < haversine(a, b) <= p.max_dist_m:
                found.add((a[0], b[0], sa, sb))
    return found


def as_keys(df) -> list:
    return [
        (r.mmsi1, r.mmsi2, r.s1, r.s2)
        for r in df.selectExpr("mmsi1", "mmsi2", "unix_timestamp(ts1) s1", "unix_timestamp(ts2) s2").collect()
    ]


def cloud(lat, lon, spread_m, n, seed, vessels=12, seconds=150):
    rng = random.Random(seed)
    rows = {}
    for _ in range(n):
        mmsi, sec = rng.randrange(1, vessels + 1), rng.randrange(seconds)
        rows[mmsi, sec] = fix(
            mmsi, BASE + dt.timedelta(seconds=sec),
            lat + rng.uniform(-1, 1) * spread_m * M_LAT,
            lon + rng.uniform(-1, 1) * spread_m * M_LAT / math.cos(math.radians(lat)),
            rng.choice([1.0, 2.0, 5.0, 20.0]),
        )
    return list(rows.values())


@pytest.mark.parametrize("lat, lon, spread", [
    (55.2, 14.2, 900), (0.0, 0.0, 900), (-33.9, -151.2, 1500), (78.0, 15.0, 900), (88.9, -40.0, 900), (10.0, 179.9, 900),
])
@pytest.mark.parametrize("p", [
    ProximityParams(), EXACT, ProximityParams(time_mode="exact", bucket_s=10, max_dt_s=35),
    ProximityParams(cell_deg=0.0013), ProximityParams(max_dist_m=1200.0, time_mode="exact"),
])
def test_pairs_equal_brute_force(spark, lat, lon, spread, p):
    rows = cloud(lat, lon, spread, 220, seed=f"{lat}{p.time_mode}{p.cell_deg}")
    got = as_keys(proximity_pairs(fixes(spark, *rows), p))
    assert len(got) == len(set(got)), "a pair came twice"
    expected = brute_force(rows, p)
    assert expected and set(got) == expected


@pytest.mark.parametrize("time_mode", ["bucket", "exact"])
@pytest.mark.parametrize("places", [1, 3, 40])
def test_shared_positions_give_the_same_pairs(spark, time_mode, places):
    rng = random.Random(places)
    spots = [(55.2 + rng.uniform(-1, 1) * 400 * M_LAT, 14.2 + rng.uniform(-1, 1) * 700 * M_LAT) for _ in range(places)]
    rows = [(m, t, *rng.choice(spots), *rest) for m, t, _, _, *rest in cloud(55.2, 14.2, 1, 260, seed=places)]
    p = ProximityParams(time_mode=time_mode)
    df = fixes(spark, *rows)
    got = as_keys(proximity_pairs(df, p))
    assert len(got) == len(set(got)) and set(got) == brute_force(rows, p)


def test_bucket_pairs_are_among_the_exact_ones(spark):
    df = fixes(spark, *cloud(55.2, 14.2, 700, 300, seed=5))
    bucket, exact = set(as_keys(proximity_pairs(df))), set(as_keys(proximity_pairs(df, EXACT)))
    assert bucket < exact


def test_repeated_candidates_reduce_to_the_same_pairs(spark):
    df = fixes(spark, *cloud(55.2, 14.2, 900, 250, seed=6))
    exact = proximity_pairs(df, EXACT)
    both = proximity_pairs(df).unionByName(exact)
    assert both.count() > exact.count()
    assert sorted(dedupe_candidates(both).collect()) == sorted(exact.collect())


def test_row_order_does_not_matter(spark):
    rows = cloud(55.2, 14.2, 900, 200, seed=7)
    shuffled = random.Random(1).sample(rows, len(rows))
    assert sorted(proximity_pairs(fixes(spark, *rows)).collect()) == sorted(proximity_pairs(fixes(spark, *shuffled)).collect())


def test_no_fixes_no_pairs(spark):
    out = proximity_pairs(fixes(spark))
    assert out.count() == 0 and out.columns == CANDIDATE_SCHEMA.names


def test_rows_without_position_are_left_alone(spark):
    assert n_pairs(spark, fix(1, lat=None), fix(2)) == 0
    assert n_pairs(spark, fix(1, lat=float("nan")), fix(2)) == 0
    assert n_pairs(spark, fix(1, ts=None), fix(2, ts=None, lat=55.2005)) == 0


@pytest.mark.parametrize("name, ship_type, expected", [
    ("AMARANTH", "Cargo", 1), ("PILOT 213 SE", None, 0), ("KBV 302", "Cargo", 0), ("NEPTUNUS", "Pilot vessel", 0),
])
def test_service_vessels_make_no_candidates(spark, name, ship_type, expected):
    df = fixes(spark, fix(1, name="VESSEL"), fix(2, lat=55.2001, name=name, ship_type=ship_type))
    assert find_candidates(df).count() == expected


def test_neighbour_cells(spark):
    out = neighbour_cells(fixes(spark, fix(lat=55.2049, lon=-0.001))).select("join_gx", "join_gy").collect()
    assert sorted(map(tuple, out)) == [(x, y) for x in (5519, 5520, 5521) for y in (-2, -1, 0)]
    assert with_cells(fixes(spark, fix(lat=-0.001, lon=0.001))).select("grid_x", "grid_y").first() == (-1, 0)
    assert neighbour_cells(fixes(spark, fix()), radius=2).count() == 25


def test_union_keeps_all_rows(spark):
    a = proximity_pairs(fixes(spark, fix(1), fix(2, lat=55.2005)))
    assert union_candidates(a, a, a).count() == 3


def test_dedupe_fixes_keeps_the_lowest_row(spark):
    df = fixes(
        spark, fix(1, lat=55.3, name="b"), fix(1, lat=55.2, name="z"), fix(1, lat=55.2, name="a"),
        fix(1, plus(1), lat=55.9), fix(2, lat=None), fix(2, lat=55.1),
    )
    expected = [(1, 55.2, "a"), (1, 55.9, None), (2, None, None)]
    for order in (df, df.orderBy("name"), df.orderBy("lat")):
        out = dedupe_fixes(order)
        assert out.columns == df.columns
        assert [(r.mmsi, r.lat, r.name) for r in out.orderBy("mmsi", "ts").collect()] == expected
    named_first = dedupe_fixes(df.filter("mmsi = 1"), ["name"])
    assert [(r.lat, r.name) for r in named_first.orderBy("ts").collect()] == [(55.2, "a"), (55.9, None)]


@pytest.mark.parametrize("time_mode", ["bucket", "exact"])
@pytest.mark.parametrize("lat, lon", [(10.0, 179.9995), (55.0, 180.0), (0.0, -180.0), (89.9, 180.0), (89.998, 0.0), (-89.999, 120.0)])
def test_pairs_across_the_date_line_and_the_poles(spark, time_mode, lat, lon):
    rng = random.Random(f"{lat}{lon}")
    rows = {}
    for _ in range(220):
        mmsi, sec = rng.randrange(1, 13), rng.randrange(150)
        span = min(180.0, 700 * M_LAT / math.cos(math.radians(lat)))
        at_lat = max(-90.0, min(90.0, lat + rng.uniform(-1, 1) * 700 * M_LAT))
        at_lon = (lon + rng.uniform(-1, 1) * span + 540) % 360 - 180
        rows[mmsi, sec] = fix(mmsi, BASE + dt.timedelta(seconds=sec), at_lat, rng.choice([at_lon, at_lon, round(at_lon, 3)]))
    rows = list(rows.values())
    p = ProximityParams(time_mode=time_mode)
    got = as_keys(proximity_pairs(fixes(spark, *rows), p))
    assert len(got) == len(set(got)), "a pair came twice"
    expected = brute_force(rows, p)
    assert expected and set(got) == expected


def test_midpoint_across_the_date_line(spark):
    for east in (179.9995, 179.999):
        row = proximity_pairs(fixes(spark, fix(1, lat=10.0, lon=east), fix(2, lat=10.0, lon=-179.9993))).first()
        assert row.dist_m < 300
        assert row.collision_lon == pytest.approx((east - 179.9993) / 2 + (180 if east < 179.9993 else -180))


@pytest.mark.parametrize("time_mode", ["bucket", "exact"])
def test_split_cells_give_the_same_pairs(spark, time_mode):
    rows = cloud(55.2, 14.2, 900, 260, seed=11) + [fix(99, BASE, 55.2, 14.2)]
    p = ProximityParams(time_mode=time_mode, crowd=3)
    got = as_keys(proximity_pairs(fixes(spark, *rows), p))
    assert len(got) == len(set(got)) and set(got) == brute_force(rows, p)
