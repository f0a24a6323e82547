"""Hours landed in two trees under a ledger, and backfills whose outcome is kept by hour.

An hour lands in a landing tree, which keeps everything, and in a buffer, which retention trims. Two trees cannot be written at
once, so what counts is the ledger: ``batch=<id>`` of it is written after both trees hold the same rows. Readers take each hour
from the last batch that the ledger completes and see nothing of a batch that failed between the writes; to run that batch again
replaces its files. A completed batch is never written again, a correction is a later batch. The ledger has a row for each batch
and hour: only hours reach the driver, never trips.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from transloom.sources.hours import HOUR, HourIndex, literal
from transloom.sources.shared import delete, file_system, new_folder
from transloom.sources.sinks import with_hour_partition

PARTS = ["y", "m", "d", "h"]
LEDGER = "hour timestamp_ntz, n long, checksum decimal(38,0)"
OUTCOMES = "hour timestamp_ntz, n long, status string, error string"
#: Characters of an error that the outcome of an hour keeps.
ERROR_CHARS = 300
_FOLDER = re.compile(r"/y=(\d+)/m=(\d+)/d=(\d+)/h=(\d+)/batch=(\d+)$")


def _numbers(spark: SparkSession, path: str, key: str) -> list[int]:
    """The completed ``key=<number>`` folders at ``path``."""
    fs, pattern = file_system(spark, f"{path}/{key}=*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in fs.globStatus(pattern) or [])


def _numbered(spark: SparkSession, path: str, key: str, schema: str, below: int | None = None) -> DataFrame:
    """The rows of the completed folders (of numbers under ``below``), with their number; none before the first one."""
    found = [n for n in _numbers(spark, path, key) if below is None or n < below]
    if not found:
        return spark.createDataFrame([], f"{schema}, {key} long")
    rows = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{key}={n}" for n in found])
    return rows.withColumn(key, F.col(key).cast("long"))


def read_ledger(spark: SparkSession, ledger: str, below: int | None = None) -> DataFrame:
    """(hour, n, checksum, batch) of all completed batches."""
    return _numbered(spark, ledger, "batch", LEDGER, below)


def _literals(hours: Iterable[datetime]) -> list[Column]:
    return [F.lit(h.isoformat(" ")).cast("timestamp_ntz") for h in hours]


def _hour() -> Column:
    return F.make_timestamp_ntz(*PARTS, F.lit(0), F.lit(0)).alias("hour")


def _checked(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(hour, n, checksum): the sum of the rows' hashes tells two hours apart in any order, repeated rows included."""
    checksum = F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("decimal(38,0)")
    return rows.groupBy(_hour()).agg(F.count("*").alias("n"), checksum.alias("checksum"))


def commit_hours(rows: DataFrame, landing: str, buffer: str, ledger: str, batch: int, ts: str = "timestamp") -> bool:
    """Land the rows' hours in both trees and complete ``batch``; False, and nothing is done, if it is complete already.

    The rows are evaluated once: the buffer is written from the landing tree's files. Both trees are read again and have to hold
    the same rows by count and checksum, else it is an error and the batch stays open. Rows without a time are an error too. An
    empty batch completes with no hour.
    """
    spark = rows.sparkSession
    if batch in _numbers(spark, ledger, "batch"):
        return False
    clash = {"batch", *PARTS} & set(rows.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are those of the trees")
    when = F.when(F.col(ts).isNull(), F.raise_error(F.lit(f"a row has no {ts}"))).otherwise(F.col(ts))
    dealt = with_hour_partition(rows.withColumn(ts, when), ts).withColumn("batch", F.lit(batch))
    # what an attempt left that failed is of no use: it may hold hours that this one has not
    for tree in (landing, buffer):
        for (_, b), folder in _folders(spark, tree).items():
            if b == batch:
                delete(spark, folder)
    _write(dealt.repartition(*PARTS), landing)
    landed = _batch(spark, landing, batch, rows.schema)
    if landed is not None:
        _write(landed, buffer)  # its files hold an hour each
        copied = _batch(spark, buffer, batch, rows.schema)
        if copied is None:
            raise OSError(f"batch {batch} is in {landing} but not in {buffer}")
        sides = _checked(landed, rows.columns).withColumn("side", F.lit(0)).unionByName(_checked(copied, rows.columns).withColumn("side", F.lit(1)))
        same = (F.count("*") == 2) & (F.count_distinct("n", "checksum") == 1)
        sums = sides.groupBy("hour").agg(F.max("n").alias("n"), F.max("checksum").alias("checksum"), same.alias("same")).collect()
        differ = sorted(r["hour"] for r in sums if not r["same"])
        if differ:
            raise OSError(f"batch {batch} differs between the trees in {len(differ)} hours, first {differ[0]}")
        entries = [(r["hour"], r["n"], r["checksum"]) for r in sums]
    else:
        entries = []
    spark.createDataFrame(entries, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/batch={batch}")
    return True


def _write(rows: DataFrame, tree: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS, "batch").parquet(tree)


def _folders(spark: SparkSession, tree: str) -> dict[tuple[datetime, int], str]:
    """The folder of each (hour, batch) of a tree, by listing."""
    fs, pattern = file_system(spark, f"{tree}/y=*/m=*/d=*/h=*/batch=*")
    found = [_FOLDER.search(f.getPath().toString()) for f in fs.globStatus(pattern) or []]
    return {(datetime(*map(int, m.groups()[:4])), int(m[5])): tree + m[0] for m in found if m}


def _batch(spark: SparkSession, tree: str, batch: int, schema: StructType) -> DataFrame | None:
    found = [folder for (_, b), folder in _folders(spark, tree).items() if b == batch]
    return spark.read.schema(schema).option("basePath", tree).parquet(*found) if found else None


def _last(spark: SparkSession, ledger: str, below: int | None = None) -> set[tuple[datetime, int]]:
    """(hour, last completed batch)."""
    return {(r["hour"], r["batch"]) for r in read_ledger(spark, ledger, below).groupBy("hour").agg(F.max("batch").alias("batch")).collect()}


def read_committed(spark: SparkSession, tree: str, ledger: str, start: datetime | None = None, stop: datetime | None = None, below: int | None = None) -> DataFrame:
    """The rows of a tree's hours in [start, stop), each hour from its last completed batch, with ``part_ts`` and ``batch``.

    Hours that retention deleted are left out. ``below`` reads the tree as it was before that batch. An error if the tree
    has no completed hour, since the columns are not known then.
    """
    last, folders = _last(spark, ledger, below), _folders(spark, tree)
    kept = sorted(key for key in last if key in folders)
    if not kept:
        raise FileNotFoundError(f"no completed hour of {ledger} is in {tree}")
    paths = [folders[key] for key in kept if (start or datetime.min) <= key[0] < (stop or datetime.max)]
    # without an hour, the columns are still those of the tree
    df = spark.read.option("basePath", tree).parquet(*paths or [folders[kept[-1]]]).withColumn("part_ts", _hour()).drop(*PARTS)
    return df if paths else df.limit(0)


def sweep(spark: SparkSession, tree: str, ledger: str) -> int:
    """Delete what no reader takes: hours of a completed batch that a later one replaces, and files of batches before the last
    completed one that never were completed. Returns how many hours; one batch may be open meanwhile."""
    last, newest = _last(spark, ledger), max(_numbers(spark, ledger, "batch"), default=-1)
    return sum(delete(spark, folder) for key, folder in _folders(spark, tree).items() if key[1] <= newest and key not in last)


# ---- backfill ------------------------------------------------------------------------------------------
def hour_source(spark: SparkSession, path: str, schema: StructType) -> Callable[[list[datetime]], DataFrame]:
    """A reader of some hours of a partitioned table; the schema is given, so that no file has to be sound to plan."""

    def read(hours: list[datetime]) -> DataFrame:
        index = HourIndex(spark, path)
        found = set(index.hours)
        paths = [index.folder(h) for h in hours if h in found]
        if not paths:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", path).parquet(*paths).select(*schema.names)

    return read


def _stage(read: Callable[[list[datetime]], DataFrame], hours: list[datetime], spark: SparkSession) -> tuple[list[str], dict[datetime, str]]:
    """(staged tables, error of each hour that cannot be read). All hours go in one job; where it fails, its halves are read, so
    k broken hours of n cost some 2 k log(n / k) jobs and all others are still read."""
    path = new_folder(spark, "backfill")
    try:
        read(hours).write.parquet(path)
    except (PySparkException, Py4JJavaError) as error:
        delete(spark, path)
        if len(hours) == 1:
            return [], {hours[0]: " ".join(str(error).split())[:ERROR_CHARS]}
        half = len(hours) // 2
        tables, errors = _stage(read, hours[:half], spark)
        more, further = _stage(read, hours[half:], spark)
        return tables + more, errors | further
    return [path], {}


def backfill(
    spark: SparkSession, read: Callable[[list[datetime]], DataFrame], schema: StructType, now: Column | datetime, outcomes: str, land: Callable[[DataFrame, int], object], hours: int = 168, ts: str = "timestamp"
) -> DataFrame:
    """Land the last ``hours`` hours before ``now`` that no run has landed yet, and keep each one's outcome.

    ``read(hours)`` gives the rows of some hours, ``land(rows, run)`` lands them (``commit_hours`` with the run as the batch, in a
    ledger whose batches are the backfill's runs) and gives False if that run is landed already.
    Hours whose outcome is ``ok`` in an earlier run are left alone: a second call tries what failed, and what was empty, again.
    An hour that cannot be read is ``failed`` with its error and keeps no other one back; an error of ``land`` is raised,
    and the run then has no outcome. Rows outside of the hours asked for do not land. Returns ``backfill_report``.
    """
    t = literal(spark, now).replace(minute=0, second=0, microsecond=0)
    todo = [r["hour"] for r in pending_hours(spark, outcomes, t, hours).orderBy("hour").collect()]
    run = max(_numbers(spark, outcomes, "run"), default=0) + 1
    if todo:
        tables, errors = _stage(read, todo, spark)
        hour = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")
        asked = [h for h in todo if h not in errors]
        rows = spark.read.schema(schema).parquet(*tables) if tables else spark.createDataFrame([], schema)
        rows = rows.where(hour.isin(_literals(asked))) if asked else rows.limit(0)
        counts = {r["hour"]: r["n"] for r in rows.groupBy(hour.alias("hour")).agg(F.count("*").alias("n")).collect()}
        # a run that landed and lost its outcome is landed again as the next one: its source may have changed since
        while land(rows, run) is False:
            run += 1
        result = [(h, counts.get(h, 0), "failed" if h in errors else "ok" if h in counts else "empty", errors.get(h)) for h in todo]
        spark.createDataFrame(result, OUTCOMES).coalesce(1).write.mode("overwrite").parquet(f"{outcomes}/run={run}")
        for table in tables:
            delete(spark, table)
    return backfill_report(spark, outcomes, t, hours)


def _wanted(spark: SparkSession, now: datetime, hours: int) -> DataFrame:
    return spark.createDataFrame([(now - i * HOUR,) for i in range(hours, 0, -1)], "hour timestamp_ntz")


def pending_hours(spark: SparkSession, outcomes: str, now: datetime, hours: int = 168) -> DataFrame:
    """(hour) of the last ``hours`` hours that no run has landed."""
    done = _numbered(spark, outcomes, "run", OUTCOMES).where("status = 'ok'").select("hour")
    return _wanted(spark, now, hours).join(done, "hour", "left_anti")


def backfill_report(spark: SparkSession, outcomes: str, now: datetime, hours: int = 168) -> DataFrame:
    """(hour, n, status, error, runs): the last outcome of each of the hours; ``untried`` without one."""
    every = _numbered(spark, outcomes, "run", OUTCOMES)
    w = Window.partitionBy("hour")
    last = every.withColumns({"runs": F.count("*").over(w), "__nth": F.row_number().over(w.orderBy(F.desc("run")))}).where("__nth = 1").drop("__nth", "run")
    out = _wanted(spark, now, hours).join(last, "hour", "left")
    return out.select("hour", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("status", F.lit("untried")).alias("status"), "error", F.coalesce("runs", F.lit(0)).alias("runs"))


# ---- stream --------------------------------------------------------------------------------------------
def merged(batch: DataFrame, old: DataFrame | None, key: Iterable[str]) -> DataFrame:
    """Old and new rows, one of each key: the new one, of several in a batch the one of the least hash."""
    rows = batch.withColumn("__old", F.lit(0))
    if old is not None:
        rows = rows.unionByName(old.select(batch.columns).withColumn("__old", F.lit(1)))
    first = Window.partitionBy(*key).orderBy("__old", F.xxhash64(*batch.columns), *batch.columns)
    return rows.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth", "__old")


def ingest_batch(batch: DataFrame, number: int, landing: str, buffer: str, ledger: str, key: Sequence[str], ts: str = "timestamp") -> bool:
    """One micro-batch into both trees: the hours that it touches are written anew with their old rows.

    Old rows are those before this batch, so that a replay gives the same hours. The touched hours reach the driver.
    """
    spark = batch.sparkSession
    if number in _numbers(spark, ledger, "batch"):
        return False
    touched = [r[0] for r in batch.select(F.date_trunc("hour", ts).cast("timestamp_ntz")).distinct().collect() if r[0] is not None]
    before = {r["hour"] for r in read_ledger(spark, ledger, number).select("hour").distinct().collect()} & set(touched)
    old = None
    if before:
        old = read_committed(spark, landing, ledger, min(before), max(before) + HOUR, number)
        old = old.where(F.col("part_ts").isin(_literals(sorted(before))))
    return commit_hours(merged(batch, old, key), landing, buffer, ledger, number, ts)
