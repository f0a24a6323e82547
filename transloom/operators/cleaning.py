"""Cleaning and event times of trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.functions import date_hour, hhmm_hour
from transloom.operators.network import collected, filter_network, top_n_airports
from transloom.sources.schema import CAUSES

FILLED = ["DepDelay", "ArrDelay", *CAUSES, "DepDel15", "ArrDel15"]


def clean_flights(flights: DataFrame) -> DataFrame:
    """Drop cancelled and diverted trips and those without an arrival delay; each rule where its column exists."""
    for flag in ("Cancelled", "Diverted"):
        if flag in flights.columns:
            flights = flights.where(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
    if "ArrDelay" in flights.columns:
        flights = flights.where(F.col("ArrDelay").isNotNull() & ~F.isnan("ArrDelay"))
    if "FlightDate" in flights.columns:
        flights = flights.withColumn("FlightDate", F.to_date("FlightDate"))
    return flights


def fill_delay_nulls(flights: DataFrame) -> DataFrame:
    return flights.na.fill(0.0, [c for c in FILLED if c in flights.columns])


def null_report(flights: DataFrame) -> DataFrame:
    """Nulls of each delay column."""
    return flights.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in FILLED if c in flights.columns])


def encode_time(flights: DataFrame) -> DataFrame:
    return flights.withColumn("Hour", hhmm_hour(F.col("CRSDepTime")))


def preprocess_pipeline(flights: DataFrame, top_n: int = 70) -> tuple[DataFrame, DataFrame]:
    """(cleaned trips between the busiest airports, those airports). The at most ``top_n`` codes reach the driver."""
    rows = encode_time(fill_delay_nulls(clean_flights(flights)))
    nodes = collected(top_n_airports(rows, top_n))
    return filter_network(rows, nodes), nodes


def derive_timestamps(flights: DataFrame, availability: str = "scheduled") -> DataFrame:
    """Add ``timestamp`` (scheduled departure hour) and ``arr_timestamp``.

    Arrivals scheduled before their departure are on the next day; without CRSArrTime the departure hour
    stands in. ``availability="actual"`` adds the arrival delay, so "completed" means landed.
    """
    flights = flights.withColumn("timestamp", date_hour(F.col("FlightDate"), hhmm_hour(F.col("CRSDepTime"))))
    if "CRSArrTime" not in flights.columns:
        return flights.withColumn("arr_timestamp", F.col("timestamp"))
    overnight = F.coalesce((F.col("CRSArrTime") < F.col("CRSDepTime")).cast("int"), F.lit(0))
    arrival = date_hour(F.date_add("FlightDate", overnight), hhmm_hour(F.col("CRSArrTime")))
    if availability == "actual":
        arrival = F.timestamp_add("MINUTE", F.coalesce(F.col("ArrDelay"), F.lit(0)).cast("int") + F.pmod(F.col("CRSArrTime"), F.lit(100)).cast("int"), arrival)
    return flights.withColumn("arr_timestamp", arrival)


def build_flight_frame(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reporting trips between ``nodes``: cancelled ones stay, null flags are false, rows without times go."""
    f = filter_network(raw, nodes)
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    f = f.withColumns({"FlightDate": F.to_date("FlightDate"), "Cancelled": flag("Cancelled"), "Diverted": flag("Diverted")})
    times = {c: F.expr(f"try_cast({c} AS DOUBLE)") for c in ("CRSDepTime", "CRSArrTime")}
    f = f.withColumns(times).where("CRSDepTime is not null and CRSArrTime is not null")
    f = derive_timestamps(f)
    return f.withColumnsRenamed({"timestamp": "dep_ts_hour", "arr_timestamp": "arr_ts_hour"})
