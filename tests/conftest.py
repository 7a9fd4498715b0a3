from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import DataFrame, SparkSession

from trackspark.schemas import CANDIDATE_SCHEMA, FIX_SCHEMA


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .appName("trackspark-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)


BASE = at("2021-12-13 02:27:00")


def plus(seconds: int) -> dt.datetime:
    return BASE + dt.timedelta(seconds=seconds)


def fix(mmsi=1, ts=BASE, lat=55.2, lon=14.2, sog=5.0, cog=90.0, heading=None, nav_status=None, name=None, ship_type=None):
    return (mmsi, ts, lat, lon, sog, cog, heading, nav_status, name, ship_type)


def fixes(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), FIX_SCHEMA)


def candidate(mmsi1=1, mmsi2=2, ts1=BASE, ts2=BASE, dist_m=10.0, name1=None, name2=None, lat1=55.0, lon1=14.0):
    return (mmsi1, mmsi2, ts1, ts2, lat1, lon1, 55.0, 14.0, name1, name2, 5.0, 5.0, 0, dist_m, 55.0, 14.0, min(ts1, ts2))


def candidates(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), CANDIDATE_SCHEMA)


def report(**changes) -> dict:
    row = {
        "Timestamp": "13/12/2021 02:27:29", "Type_of_mobile": "Class A", "MMSI": "219000001",
        "Latitude": "55.223067", "Longitude": "14.243683", "SOG": "6.0", "COG": "90.0", "Heading": "88",
        "Navigational_status": "Under way using engine", "Name": "VESSEL", "Ship_type": "Cargo",
    }
    row.update(changes)
    return row


def reports(spark: SparkSession, *rows: dict) -> DataFrame:
    columns = list(rows[0])
    return spark.createDataFrame(
        [tuple(r[c] for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns)
    )
