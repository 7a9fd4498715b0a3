"""Plans that have to hold when one key carries much of the data."""

from __future__ import annotations

import contextlib

import pytest
from pyspark.sql import functions as F

from trackspark.operators import proximity
from trackspark.operators.dedupe import dedupe_fixes
from trackspark.operators.events import closest_approach, closest_events
from trackspark.operators.names import modal_names, resolve_names
from trackspark.operators.proximity import proximity_pairs
from trackspark.operators.tracks import trajectories
from trackspark.params import EventParams, ProximityParams
from trackspark.plans import catalog


@contextlib.contextmanager
def settings(spark, **values):
    before = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in values}
    for k, v in values.items():
        spark.conf.set(k.replace("__", "."), v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def no_broadcast(spark, **more):
    return settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", **more)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def crowd(spark, n: int):
    """``n`` fixes; a third of them lie in one cell and one minute, the rest apart."""
    hot = F.col("id") % 3 == 0
    return spark.range(0, n, 1, 8).select(
        F.col("id").alias("mmsi"),
        F.timestamp_seconds(F.when(hot, 1639353600 + F.col("id") % 60).otherwise(1639353600 + F.col("id") * 60)).alias("ts"),
        F.when(hot, 55.205 + (F.col("id") % 997) * 4e-6).otherwise(F.lit(55.3)).alias("lat"),
        F.when(hot, 14.205 + (F.col("id") % 1009) * 4e-6).otherwise(F.lit(14.3)).alias("lon"),
        F.lit(5.0).alias("sog"), F.lit(1.0).alias("cog"), F.lit("NAME").alias("name"),
    )


def test_a_crowded_cell_keeps_its_pairs(spark):
    df = crowd(spark, 9000)
    expected = (
        df.alias("a").join(df.alias("b"), F.expr(
            "a.mmsi < b.mmsi AND a.mmsi % 3 = 0 AND b.mmsi % 3 = 0"
            " AND abs(unix_timestamp(a.ts) - unix_timestamp(b.ts)) <= 30"))
        .selectExpr(
            "12742000 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)"
            " + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS d")
        .filter("d > 1 AND d <= 300").count()
    )
    with no_broadcast(spark):
        assert proximity_pairs(df).count() == expected > 0


def test_a_crowded_cell_meets_in_many_tasks_at_default_settings(spark):
    """30,000 positions in one cell and one minute: no task compares them all."""
    p = ProximityParams(max_dist_m=5.0)
    with no_broadcast(spark, spark__sql__shuffle__partitions="64"):
        df = crowd(spark, 90_000)
        keyed = proximity._keyed(df, p)
        near = proximity._near_positions(*proximity._in_crowded(keyed, proximity._crowded(keyed, df, p), p), p)
        met = near.groupBy(F.spark_partition_id().alias("task")).count()
        counts = [r["count"] for r in met.collect()]
    assert max(counts) < sum(counts) / 3


def test_a_crowded_cell_is_split_where_several_tasks_feed_it(spark):
    """Adaptive execution splits by the tasks that wrote a partition, and tiny positions else come from one."""
    df = crowd(spark, 9000)
    with no_broadcast(
        spark,
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20k",
        spark__sql__adaptive__coalescePartitions__minPartitionSize="1k",
        spark__sql__shuffle__partitions="16",
    ):
        counted = proximity_pairs(df).agg(F.count("*").alias("n"))
        counted.collect()
        assert "SortMergeJoin(skew=true)" in plan(counted)


def test_vessels_on_one_position_are_not_compared(spark):
    piled = spark.range(0, 30000, 1, 4).select(
        F.col("id").alias("mmsi"), F.timestamp_seconds(F.lit(1639353600)).alias("ts"),
        F.when(F.col("id") == 0, 55.2001).otherwise(F.lit(55.2)).alias("lat"), F.lit(14.2).alias("lon"),
        F.lit(5.0).alias("sog"), F.lit("NAME").alias("name"),
    )
    with no_broadcast(spark):
        pairs = proximity_pairs(piled)
        # All but one stand on one spot; that one meets each of them.
        assert pairs.agg(F.count("*"), F.countDistinct("mmsi2"), F.max("mmsi1")).collect()[0] == (29999, 29999, 0)


def shuffled_rows(spark, df) -> list[int]:
    """Rows written by each shuffle of an executed query."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_copies_collapse_before_the_shuffle(spark):
    copies = spark.range(0, 40000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("mmsi"),
        F.timestamp_seconds(F.lit(1639353600)).alias("ts"), F.lit(55.0).alias("lat"), F.col("id").alias("name"),
    )
    out = dedupe_fixes(copies)
    rows = shuffled_rows(spark, out)
    distinct = 40000 - 40002 // 3
    assert out.count() == distinct
    # The hot key leaves each of the four tasks once.
    assert len(rows) == 1 and rows[0] <= distinct + 4


def test_a_busy_pair_collapses_before_the_shuffle(spark):
    many = spark.range(0, 30000, 1, 4).select(
        F.lit(1).alias("mmsi1"), F.lit(2).alias("mmsi2"),
        F.timestamp_seconds(F.col("id")).alias("ts1"), F.timestamp_seconds(F.col("id")).alias("ts2"),
        (F.col("id") + 5.0).alias("dist_m"),
    )
    out = closest_approach(many, EventParams(max_obs=10**6))
    assert shuffled_rows(spark, out) == [4]
    assert [(r.dist_m, r.n_obs) for r in out.collect()] == [(5.0, 30000)]


def test_names_of_a_busy_vessel_collapse_before_the_shuffle(spark):
    busy = spark.range(0, 30000, 1, 4).select(F.lit(1).alias("mmsi"), F.concat(F.lit("N"), F.col("id") % 3).alias("name"))
    assert max(shuffled_rows(spark, modal_names(busy))) <= 12


def test_no_cross_join_and_no_python_in_any_query(spark):
    for name, build in catalog.queries().items():
        text = plan(build(spark, "/root/testdata/sf0.001"))
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
            assert word not in text, f"{word} in {name}"


def test_many_events_meet_their_tracks_without_broadcast(spark):
    with no_broadcast(spark):
        tracks = catalog.all_tracks(spark, "/root/testdata/sf0.001")
        text = plan(tracks)
    # All that is broadcast is the table of crowded cells, whose size is bounded.
    assert "SortMergeJoin [mmsi" in text and "Broadcast" not in "\n".join(x for x in text.split("\n") if "bucket" not in x and "input[0" not in x)


def test_a_ranked_handful_of_events_is_broadcast_by_its_limit(spark):
    d = "/root/testdata/sf0.001"
    few = closest_events(catalog.candidates(spark, d), EventParams(k=5))
    text = plan(trajectories(catalog.cleaned_unique(spark, d), few))
    assert "BroadcastHashJoin [mmsi" in text


def test_the_pipeline_computes_pairs_once(spark):
    d = "/root/testdata/sf0.001"
    with no_broadcast(spark):
        named = resolve_names(catalog.transient_events(spark, d), catalog.cleaned_unique(spark, d))
        named.collect()
        text = plan(named).split("Initial Plan")[0]
    assert text.count("[to_bucket") == 2, "one join and the exchange below it"


@pytest.mark.parametrize("name", ["candidates_of_transient_pairs", "union_daily_candidates"])
def test_both_uses_of_the_candidates_share_one_pair_join(spark, name):
    df = catalog.operators()[name](spark, "/root/testdata/sf0.01")
    with no_broadcast(spark):
        assert df.count() > 0
        df = catalog.operators()[name](spark, "/root/testdata/sf0.01")
        df.collect()
        text = plan(df).split("Initial Plan")[0]
    assert text.count("FileScan") == 1
    assert text.count("[to_bucket") == 2, "one join and the sort below it"


@pytest.mark.parametrize("name", ["closest_event", "resolve_names", "find_candidates_exact", "trajectories"])
def test_reports_are_scanned_cleaned_and_shuffled_once(spark, name):
    df = catalog.operators()[name](spark, "/root/testdata/sf0.001")
    df.collect()
    assert plan(df).split("Initial Plan")[0].count("FileScan") == 1


def test_columns_are_pruned_at_the_scan(spark, capsys):
    catalog.queries()["proximity_pairs"](spark, "/root/testdata/sf0.001").explain("formatted")
    schema = [x for x in capsys.readouterr().out.splitlines() if x.startswith("ReadSchema")]
    assert schema and all("props" not in s and "event_type" not in s for s in schema)


@pytest.mark.parametrize("name", ["filter_month", "filter_year_month"])
def test_period_filter(spark, capsys, name):
    catalog.queries()[name](spark, "/root/testdata/sf0.001").explain("formatted")
    pushed = [x for x in capsys.readouterr().out.splitlines() if x.startswith("PushedFilters")][0]
    assert ("o_orderdate" in pushed) or name == "filter_month"
