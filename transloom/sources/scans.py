"""Scans of trip, weather and prediction tables."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transloom.functions import add_hours, clean_code, wmo_category
from transloom.sources import csv_files
from transloom.sources.csv_files import union_all
from transloom.sources.schema import flight_schema
from transloom.sources.shared import file_system

log = logging.getLogger(__name__)

WEATHER_VALUES = ("wind_speed_10m", "wind_gusts_10m", "precipitation", "cloud_cover")


def exists(spark: SparkSession, pattern: str) -> bool:
    fs, path = file_system(spark, pattern)
    found = fs.globStatus(path)
    return found is not None and len(found) > 0


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """Pruned Parquet scan; wanted columns that the files lack are left out with a warning."""
    df = spark.read.parquet(path)
    if columns is not None:
        absent = [c for c in columns if c not in df.columns]
        if absent:
            log.warning("columns not in %s: %s", path, absent)
        df = df.select([c for c in columns if c in df.columns])
    return sample_rows(df, fraction, seed)


def sample_rows(df: DataFrame, fraction: float | None, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """Seeded sample, only for 0 < fraction < 1; with ``key`` the same rows at any partitioning (by a digest of the key)."""
    if fraction is None or not 0 < fraction < 1:
        return df
    if key:
        digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
        return df.where(F.substring(digest, 1, 8) < f"{int(fraction * (1 << 32)):08x}")
    return df.sample(False, fraction, seed)


def scan_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Typed CSV scan by the column names in each file's own header (``csv_files``); rows that do not parse are left out."""
    return csv_files.scan_csv(spark, path, columns, schema or flight_schema())


def scan_csv_quarantine(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """(file, line, record) of the rows that ``scan_csv`` leaves out."""
    return csv_files.quarantine(spark, path, schema or flight_schema())


def scan_year(spark: SparkSession, folder: str, year: int, columns: Sequence[str] | None = None) -> DataFrame:
    """A year's trips: the annual Parquet, else the annual CSV, else the monthly CSVs."""
    if exists(spark, f"{folder}/Combined_Flights_{year}.parquet"):
        return scan_parquet(spark, f"{folder}/Combined_Flights_{year}.parquet", columns)
    for pattern in (f"{folder}/Combined_Flights_{year}.csv", f"{folder}/Flights_{year}_*.csv"):
        if exists(spark, pattern):
            return scan_csv(spark, pattern, columns)
    raise FileNotFoundError(f"no trips of {year} in {folder}")


def scan_years(spark: SparkSession, folder: str, years: Sequence[int], columns: Sequence[str] | None = None, skip_missing: bool = True) -> DataFrame:
    found = []
    for year in years:
        try:
            found.append(scan_year(spark, folder, year, columns))
        except FileNotFoundError:
            if not skip_missing:
                raise
    if not found:
        raise FileNotFoundError(f"no trips of {list(years)} in {folder}")
    return union_all(found)


def scan_hour_slice(flights: DataFrame, month: int, day: int, hour: int) -> DataFrame:
    """Trips of one hour; the comparisons are on stored columns and reach the Parquet scan."""
    return flights.where((F.col("Month") == month) & (F.col("DayofMonth") == day) & (F.col("CRSDepTime") >= hour * 100) & (F.col("CRSDepTime") < (hour + 1) * 100))


def scan_forward_schedule(flights: DataFrame, start: Column, hours: int = 9) -> DataFrame:
    """Scheduled trips departing in [start, start + hours); crossing midnight needs no second slice."""
    return flights.where((F.col("timestamp") >= start) & (F.col("timestamp") < add_hours(start, hours)))


WEATHER_PAYLOAD = "struct<hourly: struct<time: array<string>, " + ", ".join(f"{c}: array<string>" for c in (*WEATHER_VALUES, "weather_code")) + ">>"


def scan_weather_json(payloads: DataFrame, key: str = "iata", payload: str = "payload") -> DataFrame:
    """(iata, timestamp, values, weather_code, weather_category) rows of hourly JSON payloads.

    Malformed and empty payloads give no rows; values that are no numbers become null.
    """
    hourly = payloads.select(key, F.from_json(payload, WEATHER_PAYLOAD)["hourly"].alias("h")).where("h.time is not null")
    names = ["time", *WEATHER_VALUES, "weather_code"]
    empty = F.array().cast("array<string>")
    zipped = F.arrays_zip(*[F.coalesce(F.col(f"h.{n}"), empty).alias(n) for n in names])
    row = hourly.select(key, F.explode(zipped).alias("r")).where("r.time is not null")
    code = F.expr("try_cast(r.weather_code AS DOUBLE)").cast("int")
    return row.select(
        key, F.to_timestamp_ntz("r.time", F.lit("yyyy-MM-dd'T'HH:mm")).alias("timestamp"),
        *[F.expr(f"try_cast(r.{c} AS DOUBLE)").alias(c) for c in WEATHER_VALUES], code.alias("weather_code"), wmo_category(code).alias("weather_category"),
    )


def weather_range(flights: DataFrame) -> tuple[str, str]:
    """Dates (as text) of the weather that trips need: from the first day to the day after the last one."""
    r = flights.agg(F.min(F.to_date("FlightDate")).alias("lo"), F.date_add(F.max(F.to_date("FlightDate")), 1).alias("hi")).first()
    return str(r["lo"]), str(r["hi"])


def weather_cache_path(folder: str, code: str, start: str, end: str) -> str:
    return f"{folder}/{code}_{start}_{end}.parquet"


def scan_weather_cache(spark: SparkSession, folder: str, codes: Sequence[str], start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(observations of the codes from ``start`` to the end of day ``end``, codes without a file).

    Only the files ``{code}_{start}_{end}.parquet`` of the wanted codes (a node list) are opened.
    """
    paths = {c: weather_cache_path(folder, c, start, end) for c in sorted(set(codes))}
    there = {c: p for c, p in paths.items() if exists(spark, p)}
    missing = spark.createDataFrame([(c,) for c in paths if c not in there], "iata string")
    kinds = ", ".join(f"{c} double" for c in WEATHER_VALUES)
    if not there:
        return spark.createDataFrame([], f"timestamp timestamp_ntz, {kinds}, weather_code int, weather_category int, iata string"), missing
    code = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/_]+)_{start}_{end}\.parquet", 1)
    rows = spark.read.parquet(*there.values()).withColumn("iata", code)
    day = F.to_date("timestamp")
    return rows.where((day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date"))), missing


def scan_airports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("iata string, name string, latitude double, longitude double, elevation_m int").csv(path)


def last_partitions(rows: DataFrame, now: Column, n: int = 24, part: str = "part_ts") -> DataFrame:
    """Rows of the ``n`` hourly partitions before ``now``."""
    return rows.where((F.col(part) >= add_hours(now, -n)) & (F.col(part) < now))


def missing_hours(rows: DataFrame, now: Column, n: int = 24, part: str = "part_ts") -> DataFrame:
    """(part_ts) of the last ``n`` hours that have no rows."""
    hours = rows.sparkSession.range(1).select(F.explode(F.sequence(add_hours(now, -n), add_hours(now, -1), F.expr("INTERVAL 1 HOUR"))).alias(part))
    return hours.join(rows.select(part).distinct(), part, "left_anti")


def require_hours(rows: DataFrame, now: Column, n: int = 24, least: int = 6, part: str = "part_ts") -> DataFrame:
    """The last ``n`` hours, or an error if fewer than ``least`` have rows."""
    recent = last_partitions(rows, now, n, part)
    have = recent.select(part).distinct().count()
    if have < least:
        raise ValueError(f"only {have} of the last {n} hours have rows; {least} are needed")
    return recent


def latest_schedule(rows: DataFrame, now: Column, hours: int = 24, part: str = "part_ts") -> DataFrame:
    """Rows of the newest partition within ``hours`` before ``now``."""
    recent = rows.where((F.col(part) >= add_hours(now, -hours)) & (F.col(part) <= now))
    newest = recent.agg(F.max(part).alias("newest"))
    return recent.join(F.broadcast(newest), F.col(part) == F.col("newest"), "left_semi")


def lookup_prediction(predictions: DataFrame, airport: str, horizon: int, horizons: Sequence[int] = (1, 2, 4, 6, 8)) -> DataFrame:
    """The latest prediction of an airport (any case) and horizon; an error for unknown horizons."""
    if horizon not in horizons:
        raise ValueError(f"horizon {horizon} is not one of {list(horizons)}")
    rows = predictions.where((F.col("airport_code") == clean_code(F.lit(airport))) & (F.col("horizon_h") == horizon))
    best = rows.orderBy(F.desc("prediction_ts")).limit(1)
    return best.withColumns({"predicted_arr_delay_min": F.round("predicted_arr_delay_min", 1), "pct_arr_delayed_15": F.round("pct_arr_delayed_15", 3)})
