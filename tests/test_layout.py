"""Stored layouts: along a curve, and in buckets of the join key."""

from __future__ import annotations

import itertools
import random
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import fix, fixes, plus
from trackspark.functions import geo
from trackspark.operators import proximity
from trackspark.params import ProximityParams
from trackspark.sources import stores

BOX = (55.10, 14.10, 55.14, 14.16)


@pytest.fixture(scope="module")
def scattered(spark):
    """A third of the fixes lie on one spot outside the box."""
    rng = random.Random(3)
    rows = [fix(mmsi=k, ts=plus(k), lat=rng.uniform(54.4, 56.0), lon=rng.uniform(12.7, 15.7)) for k in range(20_000)]
    rows += [fix(mmsi=k, ts=plus(k), lat=54.5, lon=15.0) for k in range(20_000, 30_000)]
    odd = [fix(mmsi=40_000, lat=None), fix(mmsi=40_001, lon=None), fix(mmsi=40_002, lat=BOX[0], lon=BOX[1]), fix(mmsi=40_003, ts=None)]
    return fixes(spark, *rows, *odd).repartition(7)


def test_curve_key_interleaves_steps(spark):
    points = list(itertools.product((-90.0, -12.5, 0.0, 55.2, 90.0, None), (-180.0, -0.1, 14.2, 180.0, None)))

    def key(lat, lon):
        if lat is None or lon is None:
            return None
        y, x = (min(65535, int((v + span / 2) * (65536 / span))) for v, span in ((lat, 180.0), (lon, 360.0)))
        return sum((y >> b & 1) << (2 * b + 1) | (x >> b & 1) << (2 * b) for b in range(16))

    got = spark.createDataFrame(points, "lat double, lon double").select("lat", "lon", geo.curve_key(F.col("lat"), F.col("lon")).alias("k")).collect()
    assert all(r.k == key(r.lat, r.lon) for r in got)


def test_a_box_reads_few_row_groups(spark, scattered, tmp_path):
    stores.write_clustered(scattered, str(tmp_path), group_bytes=8_000)
    south, west, north, east = BOX
    found = stores.read_box(spark, str(tmp_path), *BOX)
    inside = scattered.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    assert sorted(map(str, found.drop("day").collect())) == sorted(map(str, inside.collect())) and inside.count() > 1
    total = met = 0
    for path in tmp_path.rglob("*.parquet"):
        footer = pq.ParquetFile(path).metadata
        at = {footer.schema.column(i).name: i for i in range(footer.num_columns)}
        for g in range(footer.num_row_groups):
            lat, lon = (footer.row_group(g).column(at[c]).statistics for c in ("lat", "lon"))
            total += 1
            met += bool(lat.has_min_max and lon.has_min_max and lat.max >= south and lat.min <= north and lon.max >= west and lon.min <= east)
    assert total >= 50 and met <= total / 10
    # Of the files that hold it, the scan hands on few rows before the filter.
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    found.collect()
    assert scan.metrics().apply("numOutputRows").value() <= scattered.count() / 10
    assert stores.read_fixes(spark, str(tmp_path)).count() == scattered.count()


def test_a_box_across_the_date_line(spark, tmp_path):
    rows = fixes(spark, *[fix(mmsi=k, lat=0.0, lon=x) for k, x in enumerate((179.9, -179.9, 0.0, 179.0, 180.0))])
    stores.write_clustered(rows, str(tmp_path))
    assert {r.mmsi for r in stores.read_box(spark, str(tmp_path), -1, 179.5, 1, -179.5).collect()} == {0, 1, 4}


@pytest.mark.parametrize("p", [ProximityParams(), ProximityParams(time_mode="exact"), ProximityParams(crowd=3)])
def test_pairs_of_stored_cells_need_no_shuffle_of_them(spark, tmp_path, capsys, p):
    rng = random.Random(4)
    rows = fixes(spark, *[fix(mmsi=k % 40, ts=plus(k // 40 * 7), lat=55 + rng.random() / 100, lon=14 + rng.random() / 100, name="N") for k in range(2_000)])
    table, root = f"cells_{uuid.uuid4().hex}", f"{tmp_path}/it's"
    stores.write_cells(proximity.join_cells(rows, p), table, root, 4)
    spark.sql(f"DROP TABLE {table}")  # its files stay, as they are at a path of their own
    met = proximity.pairs_of_cells(stores.attach_cells(spark, table, root, 4), p)
    assert sorted(map(str, met.collect())) == sorted(map(str, proximity.proximity_pairs(rows, p).collect())) and met.count()
    kept = spark.table(table).groupBy(*proximity.CELL_KEY).agg(F.expr("count(sec) AS n"))
    sides = proximity._sides(spark.table(table), proximity._reaching(spark.table(table), p), proximity.CELL_KEY, ("mmsi", "sec"))
    here, there, same = sides
    capsys.readouterr()
    kept.explain()
    assert "Exchange" not in capsys.readouterr().out
    here.join(there.hint("merge"), F.expr(same)).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "to_bucket" in plan[plan.index("Exchange"):].split("\n")[0]
    spark.sql(f"DROP TABLE {table}")
