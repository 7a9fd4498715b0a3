from __future__ import annotations

import os

import pytest

from tests.test_sources import DEC_2021, HEADER, SHORT, line, write
from trackspark.operators import clean, events
from trackspark.params import EventParams
from trackspark.plans import job
from trackspark.sources import files, manifest, reports, stores
from tests.conftest import candidate, candidates, plus

DAY = 86_400


def test_heads_of_many_files_take_one_small_read_each(spark, tmp_path):
    body = "\n".join(line(ts=f"13/12/2021 02:{k % 60:02d}:00") for k in range(500))
    for k in range(1000):
        write(tmp_path / f"part{k:04d}.csv", HEADER if k % 2 else SHORT, body)
    (tmp_path / "_hidden.csv").write_text("x")
    (tmp_path / "note.txt").write_text("x")
    got = files.list_files(spark, str(tmp_path), heads=True).collect()
    assert len(got) == 1000 and {r.head for r in got} == {HEADER, SHORT}
    assert max(r.bytes_read for r in got) <= files.FIRST_READ < min(r.size for r in got) / 4
    assert reports.file_headers(spark, str(tmp_path)).count() == 1000
    assert files.list_files(spark, str(tmp_path)).agg({"bytes_read": "sum"}).first()[0] == 0


def test_heads_of_odd_files(spark, tmp_path):
    (tmp_path / "a b%20ö.csv").write_bytes("﻿# Timestamp,MMSI\r\n1,2\r\n".encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "one.csv").write_bytes(b"MMSI")
    (tmp_path / "long.csv").write_bytes(b"x" * 50_000 + b"\ny")
    got = {r.file: r for r in files.list_files(spark, str(tmp_path), heads=True).collect()}
    assert {n: r.head[:20] for n, r in got.items()} == {"a b%20ö.csv": "# Timestamp,MMSI", "empty.csv": "", "one.csv": "MMSI", "long.csv": "x" * 20}
    assert len(got["long.csv"].head) == 50_000
    assert files.list_files(spark, f"file://{tmp_path}/one.csv", heads=True).first().head == "MMSI"
    (tmp_path / "long.csv").write_bytes(b"x" * (files.LONGEST_LINE + 5))
    with pytest.raises(Exception, match="no line end"):
        files.list_files(spark, str(tmp_path), heads=True).collect()


def test_a_header_is_the_first_line_only(spark, tmp_path):
    write(tmp_path / "day1.csv", HEADER, line(name="Timestamp MMSI"), line())
    assert [r.header for r in reports.file_headers(spark, str(tmp_path)).collect()] == [HEADER]
    write(tmp_path / "day1.csv", "13/12/2021 02:27:29,1,55.2,14.2,5,5", HEADER)
    assert reports.file_headers(spark, str(tmp_path)).count() == 0


def test_names_with_blanks_and_marks_meet_their_files(spark, tmp_path):
    write(tmp_path / "day 1%20ö.csv", HEADER, line())
    write(tmp_path / "day2.csv", SHORT, "14/12/2021 00:00:01,219000001,14.3,55.3,7.5,10")
    got = reports.read_reports(spark, str(tmp_path), with_file=True).collect()
    assert {(r.file, r.MMSI) for r in got} == {("day 1%20ö.csv", "219021240"), ("day2.csv", "219000001")}
    write(tmp_path / "a+[b]{c}*.csv", HEADER, line(mmsi="7"))
    only = reports.read_reports(spark, str(tmp_path), only=["day 1%20ö.csv", "a+[b]{c}*.csv"], with_file=True)
    assert sorted((r.file, r.MMSI) for r in only.collect()) == [("a+[b]{c}*.csv", "7"), ("day 1%20ö.csv", "219021240")]


def test_headers_mean_known_columns(spark):
    assert clean.header_names(["# timestamp ", "SHIP TYPE", "type  of mobile", "mmsi", "ROT", "Data source type"]) == [
        "Timestamp", "Ship_type", "Type_of_mobile", "MMSI", "ROT", "Data_source_type"]
    with pytest.raises(ValueError, match="MMSI"):
        clean.header_names(["MMSI", "mmsi"])


@pytest.fixture
def month(tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    for day in range(10, 20):
        write(data / f"day{day}.csv", HEADER, line(ts=f"{day}/12/2021 00:00:01"), line(ts=f"{day}/12/2021 23:59:59", mmsi="219000002"))
    write(data / "both.csv", HEADER, line(ts="11/12/2021 12:00:00"), line(ts="14/12/2021 12:00:00"), line(ts="bad"))
    write(data / "none.csv", HEADER, line(ts="bad"))
    write(data / "nohead.csv", "13/12/2021 02:27:29,1,55.2,14.2,5,5")
    return data


def test_the_manifest_prunes_files_and_notices_changes(spark, month, tmp_path):
    root = str(tmp_path / "manifest")
    first = manifest.update_manifest(spark, str(month), root)
    assert first.count() == 13
    assert manifest.files_of(first, ["2021-12-13"]) == ["both.csv", "day13.csv"]
    assert manifest.files_of(first, ["2021-12-10", "2021-12-19"]) == ["day10.csv", "day19.csv"]
    assert manifest.files_of(first, ["2022-01-01"]) == []
    opened = reports.read_reports(spark, str(month), only=manifest.files_of(first, ["2021-12-13"])).inputFiles()
    assert sorted(f.rsplit("/", 1)[1] for f in opened) == ["both.csv", "day13.csv"]
    before = spark.read.parquet(root).count()
    manifest.update_manifest(spark, str(month), root)
    assert spark.read.parquet(root).count() == before
    write(month / "day10.csv", HEADER, line(ts="13/12/2021 00:00:01"))
    write(month / "new.csv", HEADER, line(ts="13/12/2021 00:00:02"))
    (month / "day13.csv").unlink()
    again = manifest.update_manifest(spark, str(month), root)
    assert manifest.files_of(again, ["2021-12-13"]) == ["both.csv", "day10.csv", "new.csv"] and again.count() == 13
    assert spark.read.parquet(root).count() == before + 2
    # The same size, another time of change.
    stat = (month / "new.csv").stat()
    write(month / "new.csv", HEADER, line(ts="14/12/2021 00:00:02"))
    os.utime(month / "new.csv", ns=(stat.st_atime_ns, stat.st_mtime_ns + 10_000_000))
    assert manifest.files_of(manifest.update_manifest(spark, str(month), root), ["2021-12-14"]) == ["both.csv", "day14.csv", "new.csv"]


def test_pair_days_merge_in_any_order(spark):
    rows = [candidate(a, b, plus(t), plus(t + 5), dist_m=10.0 + (t * 7 + a) % 13) for a in (1, 2) for b in (3, 4) for t in (*range(0, 60, 10), DAY, DAY + 7, 3 * DAY)]
    rows += [candidate(8, 9, plus(k), plus(k)) for k in range(12)]
    df = candidates(spark, *rows)
    want = sorted(map(str, events.closest_approach(df, EventParams(max_obs=9)).collect()))
    days = [events.pair_days(df.filter(f"dayofmonth(collision_ts) = {d}")) for d in (13, 14, 16)]
    for parts in (days, days[::-1], [events.merge_pair_days(days[0], days[2]), days[1]]):
        assert sorted(map(str, events.approaches_of(events.merge_pair_days(*parts), EventParams(max_obs=9)).collect())) == want
    assert len(want) == 4


def test_a_run_for_one_day_reads_one_day(spark, month, tmp_path, monkeypatch):
    (month / "nohead.csv").unlink()
    out = tmp_path / "out"
    params = job.JobParams(clean=DEC_2021)
    for day in range(10, 20):
        write(month / f"day{day}.csv", HEADER, *[
            line(ts=f"{day}/12/2021 10:00:0{k}", mmsi=f"21900000{k}", lat=f"55.2230{k}", name=f"V{k}") for k in range(1, 4)])
    whole = job.run(spark, str(month), str(out), params)
    stored = lambda t: sorted(str(sorted(r.asDict().items(), key=str)) for r in spark.read.parquet(str(out / t)).collect())
    tables = {t: stored(t) for t in ("fixes", "candidates", "pair_days", "events", "tracks")}
    opened, read = [], reports.read_reports
    monkeypatch.setattr(reports, "read_reports", lambda *a, **k: opened.append(k.get("only")) or read(*a, **k))
    seen, store = [], stores.read_candidates
    monkeypatch.setattr(stores, "read_candidates", lambda *a, **k: seen.append(store(*a, **k)) or seen[-1])
    for _ in range(2):  # the first of them makes the manifest
        opened.clear()
        seen.clear()
        parts = job.run(spark, str(month), str(out), params, days=["2021-12-14"])
        assert {t: stored(t) for t in tables} == tables
        assert (parts.n_fixes, parts.n_candidates) == (whole.n_fixes, whole.n_candidates) == (whole.written_fixes, whole.written_candidates)
        assert 0 < parts.written_candidates < whole.written_candidates
    assert opened == [["both.csv", "day14.csv"]]
    # Of the candidates only the partition of the day is in the scan.
    (only,) = seen
    assert {str(r.day) for r in only.select("day").distinct().collect()} == {"2021-12-14"}
    assert "PartitionFilters: [isnotnull(day" in only._jdf.queryExecution().executedPlan().toString()
