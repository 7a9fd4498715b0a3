from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import fix, fixes, report, reports
from trackspark.functions import text
from trackspark.operators import clean
from trackspark.params import CleanParams, ProximityParams

DEC_2021 = CleanParams(year=2021)


def kept(spark, p=DEC_2021, **changes) -> bool:
    return clean.clean_fixes(reports(spark, report(**changes)), p).count() == 1


@pytest.mark.parametrize("changes, expected", [
    ({}, True),
    ({"Type_of_mobile": "Class B"}, True),
    ({"Type_of_mobile": "Base Station"}, False),
    ({"Type_of_mobile": None}, False),
    ({"Timestamp": "bad"}, False),
    ({"Timestamp": "13/11/2021 02:27:29"}, False),
    ({"Timestamp": "13/12/2020 02:27:29"}, False),
    ({"Timestamp": "01/12/2021 00:00:00"}, True),
    ({"Timestamp": "31/12/2021 23:59:59"}, True),
    ({"Timestamp": "01/01/2022 00:00:00"}, False),
    ({"Latitude": "abc"}, False),
    ({"Latitude": None}, False),
    ({"Latitude": "95.0"}, False),
    ({"Latitude": "NaN"}, False),
    ({"Latitude": "0.0", "Longitude": "0.0"}, False),
    ({"Latitude": "56.0573", "Longitude": "14.245"}, False),
    ({"Latitude": "55.95", "Longitude": "15.6"}, False),
    ({"MMSI": "111219512"}, False),
    ({"MMSI": "1112195"}, True),
    ({"MMSI": "2111195120"}, True),
    ({"MMSI": "1111951200"}, True),
    ({"MMSI": "x"}, False),
    ({"MMSI": None}, False),
    ({"SOG": "0.49"}, False),
    ({"SOG": "0.5"}, True),
    ({"SOG": "102.0"}, True),
    ({"SOG": "102.1"}, False),
    ({"SOG": None}, False),
    ({"SOG": "NaN"}, False),
    ({"Navigational_status": None}, False),
    ({"Navigational_status": "At anchor"}, False),
    ({"Navigational_status": "Moored"}, False),
    ({"Navigational_status": "Reserved for future use"}, False),
    ({"Navigational_status": "Restricted maneuverability"}, False),
    ({"COG": "abc", "Heading": "Unknown", "Name": None, "Ship_type": None}, True),
])
def test_reports_kept(spark, changes, expected):
    assert kept(spark, **changes) is expected


def test_null_status_can_be_kept(spark):
    assert kept(spark, CleanParams(keep_null_status=True), Navigational_status=None)
    assert not kept(spark, CleanParams(keep_null_status=True), Navigational_status="Moored")


def test_any_year(spark):
    assert kept(spark, CleanParams(), Timestamp="13/12/1999 00:00:00")
    assert not kept(spark, CleanParams(), Timestamp="13/11/1999 00:00:00")


def test_enclosing_box_keeps_the_rim_of_the_circle(spark):
    rim = {"Latitude": "56.0573", "Longitude": "14.245"}
    assert kept(spark, CleanParams(bbox="enclosing"), **rim)
    assert not kept(spark, CleanParams(bbox="enclosing"), Latitude="55.95", Longitude="15.6")


def test_box_sizes():
    height, width = CleanParams().half_box()
    assert height == pytest.approx(0.831836, abs=1e-6) and width == pytest.approx(1.458453, abs=1e-6)
    height, width = CleanParams(bbox="enclosing").half_box()
    assert height == pytest.approx(0.832772, abs=1e-6) and width == pytest.approx(1.460200, abs=1e-6)


def test_valid_coordinates_still_checked_where_the_box_does_not_imply_it(spark):
    near_null_island = CleanParams(centre_lat=0.1, centre_lon=0.1)
    assert not near_null_island.box_holds_valid_coordinates_only()
    assert not kept(spark, near_null_island, Latitude="0.0", Longitude="0.0")
    assert kept(spark, near_null_island, Latitude="0.0", Longitude="0.1")


def test_optional_columns_may_be_absent(spark):
    row = report()
    for c in ("Type_of_mobile", "Navigational_status", "Heading", "Name", "Ship_type"):
        del row[c]
    out = clean.clean_fixes(reports(spark, row), DEC_2021)
    assert [f.name for f in out.schema] == [
        "mmsi", "ts", "lat", "lon", "sog", "cog", "heading", "nav_status", "name", "ship_type"]
    got = out.first()
    assert (got.heading, got.nav_status, got.name, got.ship_type) == (None, None, None, None)


def test_single_filters_skip_absent_columns(spark):
    row = report()
    del row["Type_of_mobile"], row["Navigational_status"]
    df = reports(spark, row)
    assert clean.filter_mobile_class(df).count() == 1
    assert clean.filter_nav_status(df).count() == 1


def test_canonical_types(spark):
    got = clean.clean_fixes(reports(spark, report(MMSI="219000001.0"))).first()
    assert got.mmsi == 219000001 and got.lat == 55.223067 and got.heading == 88.0


@pytest.mark.parametrize("raw, expected", [
    ("12", 12), (" 12 ", 12), ("12.9", 12), ("-3.5", -3), ("x", None), ("1e3", None), ("1.2.3", None),
    ("", None), (None, None), ("99999999999999999999", None),
])
def test_tolerant_long(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.tolerant_long(F.col("t")).alias("n")).first().n == expected


def test_waterfall_matches_filters_one_by_one(spark):
    df = reports(
        spark, report(), report(SOG=None), report(SOG="200"), report(MMSI="111219512"), report(MMSI="x"),
        report(Timestamp="bad"), report(Type_of_mobile="AtoN"), report(Latitude="57.5"),
        report(Latitude="55.95", Longitude="15.6"), report(Navigational_status=None),
    )
    rows = clean.clean_waterfall(df, DEC_2021).orderBy("stage_no").collect()
    typed = clean.coerce_types(df)
    expected = [("raw", typed.count())]
    for name, predicate in clean.stages(typed, DEC_2021):
        typed = typed.filter(predicate)
        expected.append((name, typed.count()))
    assert [(r.stage, r.n) for r in rows] == expected
    assert rows[-1].n == clean.clean_fixes(df, DEC_2021).count() == 1


@pytest.mark.parametrize("name, substring, word", [
    ("Caesar", False, True), ("Portugal", False, True), (None, True, True), ("Tug Boat", False, False),
    ("DANPILOT GOLF", False, True), ("kbv 302", False, False), ("RESCUE FAMOUS", False, False),
    ("KARIN HOEJ", True, True), ("", True, True),
])
def test_service_names(spark, name, substring, word):
    df = fixes(spark, fix(name=name))
    assert (clean.filter_service_names(df).count() == 1) is substring
    assert (clean.filter_service_names(df, ProximityParams(keyword_match="word")).count() == 1) is word


@pytest.mark.parametrize("ship_type, stays", [("Tug", False), ("tug", True), (None, True), ("SAR", False), ("Cargo", True)])
def test_ship_types(spark, ship_type, stays):
    assert (clean.filter_ship_types(fixes(spark, fix(ship_type=ship_type))).count() == 1) is stays


def test_fixes_per_day(spark):
    from tests.conftest import at
    df = fixes(spark, fix(ts=at("2021-12-01 23:59:59")), fix(ts=at("2021-12-02 00:00:00")), fix(2, at("2021-12-02 10:00:00")))
    assert {str(r.day): r.n for r in clean.fixes_per_day(df).collect()} == {"2021-12-01": 1, "2021-12-02": 2}


def test_haversine_to_point_against_python(spark):
    from trackspark.functions import geo
    df = spark.createDataFrame([(56.0, 15.0)], "lat double, lon double")
    got = df.select(geo.haversine_km_to(F.col("lat"), F.col("lon"), 55.225, 14.245).alias("d")).first().d
    p1, p2 = math.radians(55.225), math.radians(56.0)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(0.755) / 2) ** 2
    assert got == pytest.approx(2 * 6371 * math.asin(math.sqrt(a)), rel=1e-12)


def test_bad_params_are_refused():
    with pytest.raises(ValueError):
        CleanParams(bbox="round")
    with pytest.raises(ValueError):
        CleanParams(month=13)
    with pytest.raises(ValueError):
        ProximityParams(time_mode="sliding")
    with pytest.raises(ValueError):
        ProximityParams(cell_deg=0)
    with pytest.raises(ValueError):
        ProximityParams(min_dist_m=-1.0)
