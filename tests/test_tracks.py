from __future__ import annotations

import json

import pytest

from tests.conftest import BASE, candidate, candidates, fix, fixes, plus
from trackspark.operators import events, tracks
from trackspark.params import TrackParams
from trackspark.schemas import TRAJECTORY_SCHEMA


def event_table(spark, *pairs):
    return events.to_events(candidates(spark, *[candidate(a, b, ts, ts) for a, b, ts in pairs]))


def test_window_ends_are_inside(spark):
    df = fixes(spark, *[fix(m, plus(s)) for m in (1, 2, 3) for s in (-601, -600, 0, 600, 601)])
    got = tracks.trajectories(df, event_table(spark, (1, 2, BASE)))
    assert got.columns == TRAJECTORY_SCHEMA.names
    rows = sorted((r.event_id, r.role, r.mmsi, r.s) for r in got.selectExpr("*", "unix_timestamp(ts) s").collect())
    t0 = int(BASE.timestamp())
    assert rows == [("1-2", f"vessel{m}", m, t0 + s) for m in (1, 2) for s in (-600, 0, 600)]


@pytest.mark.parametrize("half_window", [0, 1, 37, 600, 5000])
def test_tracks_equal_brute_force(spark, half_window):
    rows = [fix(m, plus(s)) for m in range(1, 6) for s in range(-1500, 1500, 50 + m)]
    wanted = [(1, 2, plus(0)), (2, 3, plus(-777)), (1, 4, plus(1400)), (3, 5, plus(60))]
    got = tracks.trajectories(fixes(spark, *rows), event_table(spark, *wanted), TrackParams(half_window))
    keys = sorted((r.event_id, r.role, r.mmsi, r.s) for r in got.selectExpr("*", "unix_timestamp(ts) s").collect())
    expected = sorted(
        (f"{a}-{b}", role, m, int(r[1].timestamp()))
        for a, b, ts in wanted for role, m in (("vessel1", a), ("vessel2", b))
        for r in rows if r[0] == m and abs((r[1] - ts).total_seconds()) <= half_window
    )
    assert keys == expected


def test_own_event_id_is_kept(spark):
    from pyspark.sql import functions as F
    named = event_table(spark, (1, 2, BASE)).withColumn("event_id", F.lit("mine"))
    assert {r.event_id for r in tracks.trajectories(fixes(spark, fix(1)), named).collect()} == {"mine"}


@pytest.fixture
def track(spark):
    df = fixes(
        spark, fix(1, plus(0), 55.0, 14.0, 1.25, 90.0), fix(1, plus(20), 55.2, 14.2, 3.0, 91.06),
        fix(1, plus(10), 55.1, 14.1, 2.0, 90.5), fix(2, plus(5), 54.0, 13.0, 9.0, 10.0),
    )
    return tracks.trajectories(df, event_table(spark, (1, 2, BASE)))


def test_ramp_and_segments(track):
    ramp = tracks.age_ramp(track).orderBy("mmsi", "ts").collect()
    assert [round(r.alpha, 6) for r in ramp] == [0.3, 0.65, 1.0, 0.3]
    pieces = tracks.segments(track).orderBy("from_ts").collect()
    assert [(r.from_lat, r.to_lat, round(r.alpha, 6)) for r in pieces] == [(55.0, 55.1, 0.3), (55.1, 55.2, 0.65)]


def test_endpoints_counts_and_lines(track):
    ends = {r.mmsi: (r.start_lat, r.end_lat) for r in tracks.endpoints(track).collect()}
    assert ends == {1: (55.0, 55.2), 2: (54.0, 54.0)}
    assert {r.mmsi: r.n_fixes for r in tracks.track_counts(track).collect()} == {1: 3, 2: 1}
    lines = {r.mmsi: r for r in tracks.polylines(track).collect()}
    assert [tuple(q) for q in lines[1].line] == [(55.0, 14.0), (55.1, 14.1), (55.2, 14.2)]
    assert json.loads(lines[1].geojson) == {"type": "LineString", "coordinates": [[14.0, 55.0], [14.1, 55.1], [14.2, 55.2]]}


def test_popup_and_speed(track):
    popup = tracks.popup_fields(track).filter("mmsi = 1").orderBy("ts").collect()
    assert [(r.time_text, r.sog_text, r.cog_text) for r in popup] == [
        ("02:27:00", "1.2", "90.0"), ("02:27:10", "2.0", "90.5"), ("02:27:20", "3.0", "91.1")]
    assert sorted(r.sog for r in tracks.speed_series(track).collect()) == [1.25, 2.0, 3.0, 9.0]
