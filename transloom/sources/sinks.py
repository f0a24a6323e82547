"""Sinks: hour partitions, reports, prediction tables, caches and artifacts."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transloom.functions import add_hours
from transloom.sources.hours import HOUR, HourIndex, literal
from transloom.sources.scans import exists, scan_csv, weather_cache_path
from transloom.sources.shared import delete, file_system

FEATURE_VERSION = 4
RETENTION_HOURS = 168


def convert_csv_to_parquet(spark: SparkSession, folder: str, years: Sequence[int]) -> list[str]:
    """Annual CSVs to Parquet; existing outputs stay. Returns the paths that hold data."""
    out = []
    for year in years:
        path = f"{folder}/Combined_Flights_{year}"
        if exists(spark, f"{path}.csv"):
            scan_csv(spark, f"{path}.csv").write.mode("ignore").parquet(f"{path}.parquet")
            out.append(f"{path}.parquet")
    return out


def with_hour_partition(rows: DataFrame, ts: str = "timestamp") -> DataFrame:
    c = F.col(ts)
    return rows.withColumns({"y": F.year(c), "m": F.month(c), "d": F.dayofmonth(c), "h": F.hour(c)})


def write_hour_partition(rows: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Replace the hour partitions that the rows touch; a replay gives the same table."""
    dealt = with_hour_partition(rows, ts).repartition("y", "m", "d", "h")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("y", "m", "d", "h").parquet(path)


def read_hour_partitions(spark: SparkSession, path: str) -> DataFrame:
    """The partitioned table with its hour as ``part_ts``."""
    df = spark.read.parquet(path)
    return df.withColumn("part_ts", F.make_timestamp_ntz("y", "m", "d", "h", F.lit(0), F.lit(0)))


def retained(rows: DataFrame, now: Column, hours: int = RETENTION_HOURS, part: str = "part_ts") -> DataFrame:
    """What retention leaves readable."""
    return rows.where(F.col(part) >= add_hours(now, -hours))


def trim_retention(spark: SparkSession, path: str, now: Column | datetime, hours: int = RETENTION_HOURS) -> int:
    """Delete hour partitions older than ``hours``, found by their folders' names; returns how many."""
    index = HourIndex(spark, path)
    return sum(delete(spark, index.folder(h)) for h in index.older_than(literal(spark, now) - hours * HOUR))


def backfill_hours(flights: DataFrame, path: str, now: Column, hours: int = RETENTION_HOURS) -> None:
    """Land the last ``hours`` hours in one job."""
    write_hour_partition(flights.where((F.col("timestamp") >= add_hours(now, -hours)) & (F.col("timestamp") < now)), path)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet and CSV side by side."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def write_predictions_latest(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").parquet(path)


def write_predictions_history(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("append").parquet(path)


def read_predictions_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


PREDICTIONS = "airport_code string, horizon_h int, predicted_arr_delay_min double, pct_arr_delayed_15 double, target_ts timestamp_ntz, prediction_ts timestamp_ntz"
PREDICTION_KEY = ["prediction_ts", "airport_code", "horizon_h"]


def write_predictions_batch(predictions: DataFrame, path: str, batch: int) -> None:
    """One micro-batch of the history, as a partition of its own: a replay replaces it."""
    rows = predictions.dropDuplicates(PREDICTION_KEY).withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_predictions_batches(spark: SparkSession, path: str) -> DataFrame:
    """The history of all micro-batches, one row of each key: that of its last batch. No rows before the first one."""
    if not exists(spark, f"{path}/batch=*"):
        return spark.createDataFrame([], PREDICTIONS)
    rows = spark.read.option("mergeSchema", True).parquet(path)
    last = Window.partitionBy(*PREDICTION_KEY).orderBy(F.desc("batch"))
    return rows.withColumn("__nth", F.row_number().over(last)).where("__nth = 1").drop("__nth", "batch")


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, pattern = file_system(spark, f"{path}/version=*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in fs.globStatus(pattern) or [])


def merge_predictions_latest(predictions: DataFrame, path: str, batch: int, keep: int = 2) -> None:
    """The newest prediction of each airport and horizon, of this micro-batch and all before it.

    Every batch writes a version of the (small) table from the last one before it, so a replay gives the same
    table, a short batch loses nothing and readers never see half a table. The last ``keep`` versions stay.
    """
    spark = predictions.sparkSession
    before = [v for v in _versions(spark, path) if v < batch]
    values = [c for c in predictions.columns if c not in PREDICTION_KEY]
    rows = predictions.select(*PREDICTION_KEY, *values).withColumn("__old", F.lit(0))
    if before:
        rows = rows.unionByName(spark.read.parquet(f"{path}/version={before[-1]}").withColumn("__old", F.lit(1)), allowMissingColumns=True)
    # of equal times the later batch's counts; inside a batch the largest values, so that a replay decides alike
    newest = Window.partitionBy("airport_code", "horizon_h").orderBy(F.desc("prediction_ts"), "__old", *[F.desc(c) for c in values])
    rows = rows.withColumn("__nth", F.row_number().over(newest)).where("__nth = 1").drop("__nth", "__old")
    rows.write.mode("overwrite").parquet(f"{path}/version={batch}")
    for v in before[: len(before) + 1 - keep]:
        delete(spark, f"{path}/version={v}")


def read_predictions_latest(spark: SparkSession, path: str) -> DataFrame:
    """The last version that ``merge_predictions_latest`` wrote; no rows before the first one."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={found[-1]}") if found else spark.createDataFrame([], PREDICTIONS)


def write_weather_cache(weather: DataFrame, folder: str, start: str, end: str) -> list[str]:
    """One file set ``{code}_{start}_{end}.parquet`` for each place (iata); returns the codes.

    All places are written in one job, each in a partition, and then given their names.
    """
    spark = weather.sparkSession
    weather.repartition("iata").write.mode("overwrite").partitionBy("iata").parquet(f"{folder}/_new")
    fs, pattern = file_system(spark, f"{folder}/_new/iata=*")
    codes = []
    for f in fs.globStatus(pattern) or []:
        code = f.getPath().getName().split("=")[1]
        target = weather_cache_path(folder, code, start, end)
        delete(spark, target)
        fs.rename(f.getPath(), file_system(spark, target)[1])
        codes.append(code)
    delete(spark, f"{folder}/_new")
    return sorted(codes)


def signature(flights: DataFrame, config: dict, nodes: Sequence[str]) -> str:
    """16 hex digits over the feature version, configuration, nodes and the table's shape and date range."""
    shape = flights.agg(F.count("*").alias("n"), F.min("FlightDate").cast("string").alias("lo"), F.max("FlightDate").cast("string").alias("hi"))
    text = json.dumps({"version": FEATURE_VERSION, "config": config, "nodes": sorted(nodes), "columns": sorted(flights.columns)}, sort_keys=True)
    return shape.select(F.substring(F.sha2(F.concat_ws("|", F.lit(text), "n", "lo", "hi"), 256), 1, 16)).first()[0]


def cached_table(spark: SparkSession, path: str, sig: str, build) -> DataFrame:
    """The table under ``sig=<signature>``: read if complete, else built and written."""
    where = f"{path}/sig={sig}"
    if not exists(spark, f"{where}/_SUCCESS"):
        build().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def write_artifacts(nodes: DataFrame, stats: DataFrame, metadata: DataFrame, path: str) -> None:
    for name, df in (("node_map", nodes), ("feature_stats", stats), ("run_metadata", metadata)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
