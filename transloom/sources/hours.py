"""The hour partitions of a table, told by the names of its folders.

Which hours a table has, which are missing and which are too old is asked on every run. Folder names answer it: the index is the
sorted list of hours, searched by halves. No file is opened and no row read, so thousands of hours cost some listings of days.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom.sources.shared import file_system

HOUR = timedelta(hours=1)
_FOLDER = re.compile(r"/y=(\d+)/m=(\d+)/d=(\d+)/h=(\d+)$")


def literal(spark: SparkSession, when: Column | datetime) -> datetime:
    """The value of a time that depends on no row."""
    return when if isinstance(when, datetime) else spark.range(1).select(when.cast("timestamp_ntz").alias("t")).first()["t"]


class HourIndex:
    """The hours of the table at ``path``, sorted, as they were when the index was made."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        fs, pattern = file_system(spark, f"{path}/y=*/m=*/d=*/h=*")
        found = [_FOLDER.search(status.getPath().toString()) for status in fs.globStatus(pattern) or []]
        self.hours = sorted(datetime(*map(int, m.groups())) for m in found if m)

    def between(self, start: datetime, stop: datetime) -> list[datetime]:
        """Hours in [start, stop)."""
        return self.hours[bisect_left(self.hours, start) : bisect_left(self.hours, stop)]

    def older_than(self, when: datetime) -> list[datetime]:
        return self.hours[: bisect_left(self.hours, when)]

    def newest(self, start: datetime, stop: datetime) -> datetime | None:
        """The newest hour in [start, stop]."""
        found = self.between(start, stop + timedelta(microseconds=1))
        return found[-1] if found else None

    def missing(self, start: datetime, stop: datetime) -> list[datetime]:
        """Whole hours in [start, stop) that the table lacks."""
        have = set(self.between(start, stop))
        return [h for h in (start + i * HOUR for i in range(int((stop - start) / HOUR))) if h not in have]

    def folder(self, hour: datetime) -> str:
        return f"{self.path}/y={hour.year}/m={hour.month}/d={hour.day}/h={hour.hour}"

    def read(self, hours: list[datetime]) -> DataFrame:
        """The rows of some hours that the table has, with their hour as ``part_ts``; only these folders are listed."""
        if not self.hours:
            raise FileNotFoundError(f"no hours in {self.path}")
        # without an hour, the columns are still those of the table
        df = self.spark.read.option("basePath", self.path).parquet(*[self.folder(h) for h in hours or self.hours[-1:]])
        df = df.withColumn("part_ts", F.make_timestamp_ntz("y", "m", "d", "h", F.lit(0), F.lit(0)))
        return df if hours else df.limit(0)


def missing_table(spark: SparkSession, hours: list[datetime], part: str = "part_ts") -> DataFrame:
    return spark.createDataFrame([(h,) for h in hours], f"{part} timestamp_ntz")


def last_hours(index: HourIndex, now: Column | datetime, n: int = 24, least: int = 6) -> DataFrame:
    """The rows of the last ``n`` hours before ``now``; an error if the table has fewer than ``least`` of them."""
    t = literal(index.spark, now)
    have = index.between(t - n * HOUR, t)
    if len(have) < least:
        raise ValueError(f"only {len(have)} of the last {n} hours have rows; {least} are needed")
    return index.read(have)


def missing_hours(index: HourIndex, now: Column | datetime, n: int = 24) -> DataFrame:
    """(part_ts) of the last ``n`` hours that the table lacks."""
    t = literal(index.spark, now)
    return missing_table(index.spark, index.missing(t - n * HOUR, t))


def latest_hour(index: HourIndex, now: Column | datetime, hours: int = 24) -> DataFrame:
    """The rows of the newest hour within ``hours`` before ``now``."""
    t = literal(index.spark, now)
    newest = index.newest(t - hours * HOUR, t)
    return index.read([newest] if newest else [])
