"""CSV files of several headers and the index of hour partitions."""

import gzip
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from transloom.sources import csv_files, hours, scans, sinks


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_columns_are_read_by_each_files_header(spark, tmp_path):
    write(tmp_path / "Flights_2019_1.csv", "Origin,Dest,CRSDepTime,ArrDelay", "AAA,BBB,800,5.0", "AAA,CCC,915,")
    write(tmp_path / "Flights_2019_2.csv", "Dest,ArrDelay,Origin,CRSDepTime", "DDD,7.0,CCC,1000")
    write(tmp_path / "Flights_2019_3.csv", "Dest,Origin", "FFF,EEE")
    with gzip.open(tmp_path / "Flights_2019_4.csv.gz", "wt") as f:
        f.write('﻿"Dest", Origin ,Extra\nHHH,GGG,"x, y"\n')
    (tmp_path / "Flights_2019_5.csv").write_text("")
    rows = scans.scan_csv(spark, f"{tmp_path}/Flights_2019_*")
    found = {(r["Origin"], r["Dest"], r["CRSDepTime"], r["ArrDelay"], r["Extra"]) for r in rows.collect()}
    assert found == {("AAA", "BBB", 800, 5.0, None), ("AAA", "CCC", 915, None, None), ("CCC", "DDD", 1000, 7.0, None), ("EEE", "FFF", None, None, None), ("GGG", "HHH", None, None, "x, y")}
    assert rows.schema["CRSDepTime"].dataType.simpleString() == "smallint"
    year = scans.scan_year(spark, str(tmp_path), 2019, ["Dest", "Origin", "Nothing"])
    assert year.columns == ["Dest", "Origin"]
    assert sorted(map(tuple, year.collect())) == [("BBB", "AAA"), ("CCC", "AAA"), ("DDD", "CCC"), ("FFF", "EEE")]  # the pattern is *.csv


def test_rows_that_do_not_parse_are_kept_apart(spark, tmp_path):
    a = write(tmp_path / "a.csv", "Origin,CRSDepTime", "AAA,800", "BBB,soon", "CCC,900", "BBB,soon", "DDD,1,2")
    write(tmp_path / "b.csv", "CRSDepTime,Origin", "700,EEE", "late,FFF")
    clean = scans.scan_csv(spark, f"{tmp_path}/*.csv")
    assert sorted((r["Origin"], r["CRSDepTime"]) for r in clean.collect()) == [("AAA", 800), ("CCC", 900), ("EEE", 700)]
    bad = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["record"]) for r in scans.scan_csv_quarantine(spark, f"{tmp_path}/*.csv").collect())
    assert bad == [("a.csv", 3, "BBB,soon"), ("a.csv", 5, "BBB,soon"), ("a.csv", 6, "DDD,1,2"), ("b.csv", 3, "late,FFF")]
    # the same rows whatever columns are asked for
    assert scans.scan_csv(spark, a, ["Origin"]).count() == 2
    write(tmp_path / "good.csv", "Origin", "AAA")
    assert scans.scan_csv_quarantine(spark, f"{tmp_path}/good.csv").count() == 0


def test_lines_are_counted_over_splits(spark, tmp_path):
    path = write(tmp_path / "long.csv", "Origin,CRSDepTime", *[f"A{i:04d},{'x' if i in (7, 1500, 2999) else i}" for i in range(3000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert sorted(r["line"] for r in scans.scan_csv_quarantine(spark, path).collect()) == [9, 1502, 3001]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_odd_csv(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scans.scan_csv(spark, f"{tmp_path}/none_*.csv")
    twice = write(tmp_path / "twice.csv", "Origin,origin", "a,b")
    with pytest.raises(ValueError, match="twice"):
        scans.scan_csv(spark, twice)
    only = write(tmp_path / "only.csv", "Origin,Dest")
    assert scans.scan_csv(spark, only).count() == 0
    assert list(csv_files.header_groups(spark, f"{tmp_path}/only.csv")) == [("Origin", "Dest")]


T0 = datetime(2019, 9, 30)


def test_ten_thousand_hours_without_reading(spark, tmp_path):
    """Hours are told by folder names: empty folders have no file that could be read."""
    start = T0 - timedelta(hours=10_000)
    for i in range(10_000):
        t = start + timedelta(hours=i)
        if i % 100 != 7:
            (tmp_path / f"y={t.year}/m={t.month}/d={t.day}/h={t.hour}").mkdir(parents=True)
    index = hours.HourIndex(spark, str(tmp_path))
    assert len(index.hours) == 9900 and index.hours == sorted(index.hours)
    assert index.missing(start, start + timedelta(hours=250)) == [start + timedelta(hours=h) for h in (7, 107, 207)]
    assert index.newest(T0 - timedelta(hours=24), T0) == T0 - timedelta(hours=1)
    assert index.newest(T0 + timedelta(hours=24), T0 + timedelta(hours=48)) is None
    now = F.lit(str(T0 - timedelta(hours=9_700))).cast("timestamp_ntz")
    assert sinks.trim_retention(spark, str(tmp_path), now, 168) == 130
    assert len(hours.HourIndex(spark, str(tmp_path)).hours) == 9900 - 130
    with pytest.raises(ValueError, match="of the last 24 hours"):
        hours.last_hours(index, T0 + timedelta(hours=20), 24, 6)


def test_hours_are_read_alone(spark, tmp_path):
    rows = spark.createDataFrame([(i, T0 + timedelta(hours=h)) for i, h in enumerate((0, 0, 1, 3, 5))], "id long, timestamp timestamp_ntz")
    sinks.write_hour_partition(rows, str(tmp_path))
    index = hours.HourIndex(spark, str(tmp_path))
    assert [r["part_ts"] for r in hours.missing_hours(index, T0 + timedelta(hours=6), 6).collect()] == [T0 + timedelta(hours=h) for h in (2, 4)]
    assert [r["id"] for r in hours.latest_hour(index, T0 + timedelta(hours=6)).collect()] == [4]
    found = hours.last_hours(index, T0 + timedelta(hours=4), 4, 1)
    assert sorted(r["id"] for r in found.collect()) == [0, 1, 2, 3] and len(found.inputFiles()) == 3
    assert hours.latest_hour(index, T0 + timedelta(hours=200), 24).count() == 0
    empty = hours.HourIndex(spark, f"{tmp_path}/nothing")
    assert empty.hours == [] and sinks.trim_retention(spark, f"{tmp_path}/nothing", T0) == 0
