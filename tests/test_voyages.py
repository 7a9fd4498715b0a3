from __future__ import annotations

import random

import pytest

from tests.conftest import BASE, fix, fixes, plus
from trackspark.operators import voyages
from trackspark.params import VoyageParams
from trackspark.schemas import EVENT_SCHEMA

M_LAT = 1 / 111_195.0
P = VoyageParams(max_kn=40.0)  # 20.6 metres a second


def sail(mmsi, metres):
    """A fix each ten seconds, so many metres north of the start."""
    return [fix(mmsi, plus(10 * k), 55.0 + m * M_LAT, 14.0) for k, m in enumerate(metres)]


def plausible(spark, rows, p=P, parts=3):
    got = voyages.flag_jumps(fixes(spark, *rows).repartition(parts), p).orderBy("mmsi", "ts").collect()
    return [r.plausible for r in got]


@pytest.mark.parametrize("metres, expected", [
    ([0, 100, 200, 300], [1, 1, 1, 1]),
    ([0, 100, 5000, 300, 400], [1, 1, 0, 1, 1]),  # a spike
    ([0, 100, 5000, 9000, 400, 500], [1, 1, 0, 0, 1, 1]),
    ([9000, 0, 100, 200, 300], [1, 0, 0, 1, 1]),  # a lone bad fix at the start
    ([0, 5000, 5100, 5200, 5300], [1, 0, 0, 1, 1]),  # the vessel really is elsewhere
    ([0, 5000, 300, 9000, 500, 600], [1, 0, 1, 0, 1, 1]),
    ([0, 5000, 9000, 13000, 17000, 21000], [1, 0, 0, 1, 0, 0]),
])
def test_jumps(spark, metres, expected):
    assert plausible(spark, sail(1, metres)) == [bool(x) for x in expected]


def test_jumps_of_many_vessels_against_a_plain_loop(spark):
    rng = random.Random(4)
    rows, want = [], []
    for mmsi in range(1, 30):
        metres, m = [], 0.0
        for _ in range(rng.randrange(1, 60)):
            m += rng.uniform(-150, 150)
            metres.append(m + rng.choice([0, 0, 0, 0, 5000, -900]))
        rows += sail(mmsi, metres)
        last, refused = None, 0
        for k, x in enumerate(metres):
            good = last is None or refused >= P.patience or abs(x - last[1]) <= 40 * 1852 / 3600 * 10 * (k - last[0])
            last, refused = ((k, x), 0) if good else (last, refused + 1)
            want.append(good)
    with_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (10_000, 7):  # state goes on from batch to batch
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert plausible(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_batches)
    assert not all(want)
    assert voyages.drop_jumps(fixes(spark, *rows), P).count() == sum(want)


def test_jumps_leave_out_rows_without_a_place_and_keep_columns(spark):
    df = fixes(spark, fix(1), fix(1, plus(1), lat=None), fix(None), fix(1, None))
    out = voyages.flag_jumps(df)
    assert out.columns == [*df.columns, "plausible"] and out.count() == 1
    assert voyages.flag_jumps(df.limit(0)).count() == 0


def test_repeats_become_one(spark):
    day = 86_400
    midnight = plus(-(2 * 3600 + 27 * 60))
    rows = [
        fix(1, BASE, 55.0, 14.0, name="b"), fix(1, plus(1), 55.0 + 3 * M_LAT, 14.0), fix(1, plus(2), 55.0 + 6 * M_LAT, 14.0),
        fix(1, plus(4), 55.0, 14.0),  # two seconds later
        fix(1, plus(5), 55.0 + 50 * M_LAT, 14.0),  # too far away
        fix(2, BASE, 55.0, 14.0, name="z"), fix(2, BASE, 55.0, 14.0, name="a"),  # one second
        fix(3, midnight - (plus(1) - BASE), 55.0, 14.0), fix(3, midnight, 55.0, 14.0), fix(3, plus(day), 55.0, 14.0),
        fix(4, BASE, None, 14.0), fix(4, plus(1), None, 14.0),
    ]
    for order in (rows, rows[::-1]):
        got = voyages.collapse_repeats(fixes(spark, *order)).orderBy("mmsi", "ts").collect()
        assert [(r.mmsi, r.n_reports) for r in got] == [(1, 3), (1, 1), (1, 1), (2, 2), (3, 2), (3, 1), (4, 1), (4, 1)]
        assert got[0].name == "b" and got[3].name == "a" and got[0].lat == 55.0


def test_states_of_a_voyage(spark):
    rows = [
        fix(1, plus(0), sog=5.0), fix(1, plus(60), sog=4.0, nav_status=None), fix(1, plus(120), sog=0.1), fix(1, plus(180), sog=3.0, nav_status="Moored"),
        fix(1, plus(240), sog=None, nav_status="At anchor"), fix(1, plus(2000), sog=None, nav_status=None), fix(1, plus(2600), sog=6.0),
        fix(2, plus(0), sog=6.0),
    ]
    got = voyages.movement_states(fixes(spark, *rows)).orderBy("mmsi", "from_ts", "to_ts").collect()
    t = lambda r: (r.mmsi, r.state, int(r.from_ts.timestamp() - BASE.timestamp()), int(r.to_ts.timestamp() - BASE.timestamp()), r.n_fixes)
    assert [t(r) for r in got] == [
        (1, "under way", 0, 60, 2), (1, "stopped", 120, 240, 3), (1, "silent", 240, 2000, 0), (1, "under way", 2000, 2600, 2), (2, "under way", 0, 0, 1)]


def test_how_tracks_end(spark):
    states = voyages.movement_states(fixes(spark, *[fix(1, plus(t), sog=s) for t, s in ((0, 5.0), (300, 5.0), (500, 0.0), (700, 0.0), (2000, 5.0))], fix(2, plus(0), sog=5.0)))
    event = lambda a, b, t: (a, b, None, None, plus(t), 55.0, 14.0, 1.0)
    def endings(*events):
        df = voyages.track_endings(spark.createDataFrame(list(events), EVENT_SCHEMA), states)
        return {(r.event_id, r.role): r.ending for r in df.collect()}
    assert endings(event(1, 2, 0)) == {("1-2", "vessel1"): "stopped", ("1-2", "vessel2"): "under way"}
    assert endings(event(1, 2, -400)) == {("1-2", "vessel1"): "under way", ("1-2", "vessel2"): "under way"}
    assert endings(event(1, 2, 200)) == {("1-2", "vessel1"): "silent", ("1-2", "vessel2"): "silent"}  # 800 s: between 700 and 2000
    assert endings(event(1, 2, 1400)) == {("1-2", "vessel1"): "under way", ("1-2", "vessel2"): "silent"}
    assert endings(event(1, 3, 3000)) == {("1-3", "vessel1"): "silent", ("1-3", "vessel2"): "silent"}
