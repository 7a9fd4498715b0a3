from __future__ import annotations

import json
import random

import pytest

from tests.conftest import BASE, candidate, candidates, fix, fixes, plus
from trackspark.operators import events, names
from trackspark.params import EventParams
from trackspark.schemas import EVENT_SCHEMA


def repeated(n: int, mmsi1=1, mmsi2=2) -> list:
    return [candidate(mmsi1, mmsi2, plus(i), plus(i), dist_m=20.0 + i) for i in range(n)]


def test_two_hundred_observations_are_kept_one_more_is_not(spark):
    df = candidates(spark, *repeated(200, 1, 2), *repeated(201, 3, 4))
    assert [(r.mmsi1, r.n_obs) for r in events.transient_pairs(df).collect()] == [(1, 200)]
    assert [(r.mmsi1, r.n_obs) for r in events.persistent_pairs(df).collect()] == [(3, 201)]
    assert [(r.mmsi1, r.n_obs) for r in events.closest_approach(df).collect()] == [(1, 200)]
    kept = events.candidates_of_transient_pairs(df)
    assert kept.count() == 200 and {r.mmsi1 for r in kept.collect()} == {1}


def test_closest_approach_breaks_ties_by_time(spark):
    rows = [
        candidate(ts1=plus(9), ts2=plus(9), dist_m=5.0, name1="late"),
        candidate(ts1=plus(3), ts2=plus(8), dist_m=5.0, name1="early, second vessel later"),
        candidate(ts1=plus(3), ts2=plus(4), dist_m=5.0, name1="early"),
        candidate(ts1=plus(1), ts2=plus(1), dist_m=6.0, name1="farther"),
    ]
    for seed in range(3):
        got = events.closest_approach(candidates(spark, *random.Random(seed).sample(rows, 4))).collect()
        assert [(r.name1, r.n_obs) for r in got] == [("early", 4)]


def test_ranking_and_k(spark):
    df = candidates(
        spark, candidate(5, 6, dist_m=7.0), candidate(1, 9, dist_m=7.0), candidate(3, 4, dist_m=2.0), candidate(7, 8, dist_m=9.0)
    )
    top = events.closest_events(df, EventParams(k=3)).collect()
    assert [(r.mmsi1, r.min_distance_m) for r in top] == [(3, 2.0), (1, 7.0), (5, 7.0)]
    assert events.closest_events(df).columns == EVENT_SCHEMA.names


def test_no_surviving_pair_gives_no_event(spark):
    assert events.closest_events(candidates(spark)).collect() == []
    assert events.closest_events(candidates(spark, *repeated(5)), EventParams(max_obs=4)).collect() == []


@pytest.mark.parametrize("own, expected", [
    ("KARIN HOEJ", "KARIN HOEJ"), (" padded ", " padded "),
    (None, "MODAL"), ("", "MODAL"), ("  ", "MODAL"), ("\t", "MODAL"), ("Unknown", "MODAL"), ("None", "MODAL"), (" None ", "MODAL"),
])
def test_names_are_looked_up_where_missing(spark, own, expected):
    event = events.closest_events(candidates(spark, candidate(1, 2, name1=own, name2="OTHER")))
    known = fixes(
        spark, fix(1, plus(1), name="MODAL"), fix(1, plus(2), name="MODAL"), fix(1, plus(3), name="RARE"),
        *[fix(1, plus(4 + i), name=n) for i, n in enumerate([None, None, None, "", "", "", "Unknown", "Unknown", "Unknown"])],
        fix(2, name="NOT ASKED"),
    )
    got = names.resolve_names(event, known)
    assert got.columns == EVENT_SCHEMA.names
    assert [(r.name1, r.name2) for r in got.collect()] == [(expected, "OTHER")]


def test_vessel_without_any_name(spark):
    event = events.closest_events(candidates(spark, candidate(1, 2, name1="Unknown", name2=None)))
    got = names.resolve_names(event, fixes(spark, fix(1, name="Unknown"), fix(2, name=""))).first()
    assert (got.name1, got.name2) == ("MMSI 1", "MMSI 2")


def test_modal_name_ties_and_the_word_none(spark):
    df = fixes(
        spark, fix(1, plus(1), name="B"), fix(1, plus(2), name="A"), fix(1, plus(3), name="C"), fix(1, plus(4), name="C"),
        fix(2, plus(1), name="B"), fix(2, plus(2), name="A"), fix(3, name="None"), fix(4, name=None),
    )
    assert {r.mmsi: r.modal_name for r in names.modal_names(df).collect()} == {1: "C", 2: "A", 3: "None"}


def test_json_and_display_fields(spark):
    event = events.closest_events(candidates(spark, candidate(dist_m=4.075970264224345)))
    line = events.json_fields(event).toJSON().first()
    assert json.loads(line)["collision_ts"] == "2021-12-13T02:27:00Z"
    shown = events.display_fields(event).first()
    assert (shown.time_text, shown.lat_text, shown.distance_text) == ("2021-12-13 02:27:00 UTC", "55.000000", "4.1")


@pytest.mark.parametrize("value, digits", [(0.25, 1), (0.15, 1), (0.35, 1), (55.2230795, 6), (-0.25, 1), (12345.678, 1), (102.25, 1)])
def test_fixed_decimals_round_like_printf(spark, value, digits):
    from pyspark.sql import functions as F
    from trackspark.functions import text
    got = spark.range(1).select(text.fixed_decimals(F.lit(value), digits).alias("t")).first().t
    assert got == f"{value:.{digits}f}"
