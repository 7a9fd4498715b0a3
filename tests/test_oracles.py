"""Every registered query against DuckDB running its plain SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_points
from trackspark.plans import catalog, oracles

SF_DIR = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
ORACLES = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("events", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) >= 51


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    expected = duck.execute(ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    wanted = expected.fetchall()
    assert wanted, "an empty result checks nothing"
    assert sorted(map(repr, rows)) == sorted(map(repr, wanted))


def test_entry_is_lazy_and_has_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns[:2] == ["mmsi1", "mmsi2"] and df.count() == 1
