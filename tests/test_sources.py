from __future__ import annotations

import json

import pytest
from pyspark.errors import AnalysisException

from tests.conftest import BASE, candidate, candidates, fix, fixes, plus
from trackspark.operators import clean, events
from trackspark.params import CleanParams, EventParams, ProximityParams
from trackspark.plans import job
from trackspark.sources import reports, stores

HEADER = "# Timestamp,Type of mobile,MMSI,Latitude,Longitude,Navigational status,ROT,SOG,COG,Heading,IMO,Name,Ship type"
SHORT = "# Timestamp,MMSI,Longitude,Latitude,SOG,COG"
DEC_2021 = CleanParams(year=2021)


def line(ts="13/12/2021 02:27:29", mobile="Class A", mmsi="219021240", lat="55.223067", lon="14.243683",
         status="Under way using engine", sog="6.0", cog="200.1", heading="200", name="KARIN HOEJ", ship="Cargo"):
    return f"{ts},{mobile},{mmsi},{lat},{lon},{status},,{sog},{cog},{heading},Unknown,{name},{ship}"


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")


@pytest.fixture
def dirty(tmp_path):
    write(
        tmp_path / "day1.csv", HEADER, line(), line(ts="bad"), line(lat="abc"), line(lat=""), line(sog=""),
        line(mmsi="x"), line(heading="Unknown"), line(cog="-"), line(name='"A, B"', ts="13/12/2021 02:28:00"),
        line(ts="3/12/2021 02:27:29"),
    )
    write(tmp_path / "ignored.zip", "no csv")
    return tmp_path


def test_dirty_values_become_null(spark, dirty):
    df = reports.read_reports(spark, str(dirty))
    kinds = dict(df.dtypes)
    assert (kinds["Latitude"], kinds["ts"], kinds["MMSI"]) == ("double", "timestamp", "string")
    assert "Navigational_status" in df.columns and "Ship_type" in df.columns
    assert df.count() == 10
    assert df.filter("ts IS NULL").count() == 2
    assert df.filter("Latitude IS NULL").count() == 2
    assert df.filter("SOG IS NULL").count() == 1
    assert df.filter("COG IS NULL").count() == 1
    assert df.filter("Heading IS NULL").count() == 1


def test_cleaning_the_typed_scan_equals_cleaning_text(spark, dirty):
    typed = clean.clean_fixes(reports.read_reports(spark, str(dirty)), DEC_2021)
    raw = clean.normalise_headers(spark.read.option("header", True).csv(str(dirty / "*.csv")))
    text = clean.clean_fixes(raw, DEC_2021)
    assert typed.schema == text.schema
    assert sorted(map(str, typed.collect())) == sorted(map(str, text.collect()))
    assert typed.count() == 4


def test_filters_reach_the_csv_reader(spark, dirty, capsys):
    clean.clean_fixes(reports.read_reports(spark, str(dirty)), DEC_2021).explain("formatted")
    plan = capsys.readouterr().out
    pushed, read = (plan[plan.index(k):].split("\n")[0] for k in ("PushedFilters", "ReadSchema"))
    assert "GreaterThanOrEqual(Latitude" in pushed and "In(Type of mobile" in pushed
    assert "GreaterThanOrEqual(# Timestamp" in pushed
    assert "ROT" not in read and "IMO" not in read


def test_single_file_and_missing_path(spark, dirty):
    assert reports.read_reports(spark, str(dirty / "day1.csv")).count() == 10
    with pytest.raises(AnalysisException):
        reports.read_reports(spark, str(dirty / "nothing"))


def test_required_column(spark, tmp_path):
    write(tmp_path / "a.csv", "# Timestamp,MMSI,Latitude,Longitude,COG", "13/12/2021 02:27:29,1,55.2,14.2,0")
    with pytest.raises(ValueError, match="SOG"):
        reports.read_reports(spark, str(tmp_path))


def test_files_with_different_headers(spark, tmp_path):
    write(tmp_path / "day1.csv", HEADER, line())
    write(tmp_path / "day2.csv", SHORT, "14/12/2021 00:00:01,219000001,14.3,55.3,7.5,10")
    write(tmp_path / "day3.csv", HEADER, line(ts="15/12/2021 00:00:00"))
    got = reports.read_reports(spark, str(tmp_path))
    assert {(r.MMSI, r.Latitude, r.Longitude, r.SOG, r.Name) for r in got.collect()} == {
        ("219021240", 55.223067, 14.243683, 6.0, "KARIN HOEJ"), ("219000001", 55.3, 14.3, 7.5, None)}
    assert got.count() == 3
    with pytest.raises(Exception, match="(?i)header"):
        reports.read_reports(spark, str(tmp_path), header=HEADER).collect()
    write(tmp_path / "day4.csv", "13/12/2021 02:27:29,1,55.2,14.2,5,5")
    with pytest.raises(Exception, match="no header in"):
        reports.read_reports(spark, str(tmp_path)).collect()


def test_many_files_take_as_many_jobs_as_few(spark, tmp_path):
    def jobs(n):
        for i in range(n):
            write(tmp_path / f"day{i}.csv", HEADER if i % 2 else SHORT, line() if i % 2 else "14/12/2021 00:00:01,2,14.3,55.3,7.5,10")
        spark.sparkContext.setJobGroup(f"files{n}", "")
        df = reports.read_reports(spark, str(tmp_path))
        assert df.filter("Latitude IS NOT NULL AND ts IS NOT NULL").count() == n
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"files{n}"))

    assert jobs(4) == jobs(12)


def test_store_by_day(spark, tmp_path):
    root = str(tmp_path / "fixes")
    day2 = 86400
    stores.write_by_day(fixes(spark, fix(1), fix(2, plus(day2)), fix(3, plus(day2))), root)
    assert {str(r.day): r.n for r in clean.fixes_per_day(stores.read_fixes(spark, root)).collect()} == {
        "2021-12-13": 1, "2021-12-14": 2}
    one = stores.read_fixes(spark, root, days=["2021-12-14"])
    assert sorted(r.mmsi for r in one.collect()) == [2, 3]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan

    stores.write_by_day(fixes(spark, fix(9, plus(day2))), root, replace="days")
    assert sorted(r.mmsi for r in stores.read_fixes(spark, root).collect()) == [1, 9]
    stores.write_by_day(fixes(spark, fix(5)), root)
    assert [r.mmsi for r in stores.read_fixes(spark, root).collect()] == [5]
    with pytest.raises(ValueError):
        stores.write_by_day(fixes(spark), root, replace="some")


def test_candidate_store_and_json(spark, tmp_path):
    root = str(tmp_path / "candidates")
    stores.write_by_day(candidates(spark, candidate(1, 2, dist_m=4.5)), root, ts="collision_ts")
    stored = stores.read_candidates(spark, root).drop("day")
    assert stored.columns == candidates(spark).columns
    stores.write_event_json(events.closest_events(stored), str(tmp_path / "json"))
    lines = [x for f in (tmp_path / "json").glob("*.json") for x in f.read_text().splitlines()]
    assert json.loads(lines[0])["collision_ts"] == "2021-12-13T02:27:00Z" and len(lines) == 1


def test_pipeline_finds_the_collision(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    scot = dict(mmsi="232018267", lat="55.223092", lon="14.243730", sog="5.0", name="")
    write(
        data / "day13.csv", HEADER, line(), line(), line(ts="13/12/2021 02:27:58", **scot),
        line(ts="13/12/2021 02:20:00", **{**scot, "lat": "55.3", "name": "MV SCOT CARRIER"}),
        # Noise that would win without its guard.
        line(mmsi="111219512", lat="55.223066"), line(mmsi="219000302", lat="55.223066", name="KBV 302"),
        line(mmsi="219000303", lat="55.223066", status="Moored"),
    )
    # Two vessels that fish side by side for a long time, closer than the collision.
    write(data / "day12.csv", HEADER, *[
        line(ts=f"12/12/2021 {10 + i // 60}:{i % 60:02d}:00", mmsi=f"21900016{k}", lat=f"55.00000{k}", name=f"HG 16{k}")
        for i in range(201) for k in (2, 5)
    ])
    result = job.run(spark, str(data), str(tmp_path / "out"), job.JobParams(
        clean=DEC_2021, proximity=ProximityParams(min_dist_m=0.1)))
    got = result.events.collect()
    assert [(r.mmsi1, r.mmsi2, r.name1, r.name2) for r in got] == [
        (219021240, 232018267, "KARIN HOEJ", "MV SCOT CARRIER")]
    assert got[0].min_distance_m == pytest.approx(4.075970264224345, abs=1e-6)
    assert result.n_fixes == 2 * 201 + 4 and result.n_candidates == 201 + 1
    assert result.tracks.filter("role = 'vessel2'").count() == 2


@pytest.mark.parametrize("p", [ProximityParams(), ProximityParams(time_mode="exact"), ProximityParams(bucket_s=7000)])
def test_a_run_day_by_day_equals_one_run(spark, tmp_path, p):
    data = tmp_path / "data"
    data.mkdir()
    for day in (12, 13, 14):
        write(data / f"day{day}.csv", HEADER, *[
            line(ts=f"{day}/12/2021 {t}", mmsi=f"2190001{k:02d}", lat=f"55.20{k:02d}", name=f"V{k}")
            for k, t in enumerate(("00:00:05", "00:00:12", "12:00:00", "12:00:20", "23:59:50", "23:59:58", "00:00:01"))
        ])
    params = job.JobParams(clean=DEC_2021, proximity=p)
    whole = job.run(spark, str(data), str(tmp_path / "whole"), params)
    for days in (["2021-12-14"], ["2021-12-12"], ["2021-12-13"], ["2021-12-12", "2021-12-14"]):
        parts = job.run(spark, str(data), str(tmp_path / "parts"), params, days=days)
    assert (parts.n_fixes, parts.n_candidates) == (whole.n_fixes, whole.n_candidates) and whole.n_candidates > 6

    def stored(root):
        return sorted(map(str, stores.read_candidates(spark, str(tmp_path / root / "candidates")).collect()))

    assert stored("parts") == stored("whole")
    assert parts.events.collect() == whole.events.collect()
    # A day without data any more loses its rows.
    write(data / "day13.csv", HEADER)
    parts = job.run(spark, str(data), str(tmp_path / "parts"), params, days=["2021-12-13"])
    whole = job.run(spark, str(data), str(tmp_path / "again"), params)
    assert stored("parts") == stored("again") and parts.n_fixes == whole.n_fixes


def test_pipeline_without_data_gives_empty_tables(spark, tmp_path):
    write(tmp_path / "a.csv", HEADER)
    result = job.run(spark, str(tmp_path), str(tmp_path / "out"))
    assert (result.events.count(), result.tracks.count(), result.n_fixes, result.n_candidates) == (0, 0, 0, 0)


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from trackspark import __main__ as command
    write(tmp_path / "a.csv", HEADER, line(), line(mmsi="232018267", lat="55.223092", name="MV SCOT CARRIER"))
    monkeypatch.setattr("sys.argv", [
        "trackspark", "--data", str(tmp_path), "--output", str(tmp_path / "out"), "--year", "2021", "--events", "3"])
    command.main()
    shown = capsys.readouterr().out
    assert "2 fixes, 1 candidates" in shown and "MV SCOT CARRIER" in shown
