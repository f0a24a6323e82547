"""The trip table's contract: columns, types and which are known before the trip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_SCHEDULE = [
    ("FlightDate", T.DateType()), ("Airline", T.StringType()), ("Origin", T.StringType()), ("Dest", T.StringType()),
    ("CRSDepTime", T.ShortType()), ("CRSArrTime", T.ShortType()), ("CRSElapsedTime", T.FloatType()), ("Distance", T.FloatType()),
    ("Month", T.ByteType()), ("DayOfWeek", T.ByteType()), ("DayofMonth", T.ByteType()), ("Cancelled", T.BooleanType()), ("Diverted", T.BooleanType()),
]
_ACTUAL = [
    ("DepTime", T.FloatType()), ("ArrTime", T.FloatType()), ("DepDelay", T.FloatType()), ("ArrDelay", T.FloatType()),
    ("DepDel15", T.FloatType()), ("ArrDel15", T.FloatType()), ("WheelsOff", T.FloatType()), ("WheelsOn", T.FloatType()),
    ("TaxiOut", T.FloatType()), ("TaxiIn", T.FloatType()), ("AirTime", T.FloatType()), ("ActualElapsedTime", T.FloatType()),
    ("CarrierDelay", T.FloatType()), ("WeatherDelay", T.FloatType()), ("NASDelay", T.FloatType()), ("SecurityDelay", T.FloatType()), ("LateAircraftDelay", T.FloatType()),
]

SCHEDULE_COLUMNS = [n for n, _ in _SCHEDULE]
ACTUAL_COLUMNS = [n for n, _ in _ACTUAL]
CAUSES = ["CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay"]


def flight_schema() -> T.StructType:
    """All columns; field metadata ``availability`` tells schedule from actual ones."""
    fields = [T.StructField(n, t, True, {"availability": "schedule"}) for n, t in _SCHEDULE]
    return T.StructType(fields + [T.StructField(n, t, True, {"availability": "actual"}) for n, t in _ACTUAL])


def split_by_availability(flights: DataFrame, actual: bool) -> DataFrame:
    """Schedule columns only, or schedule and actual columns, of those that exist."""
    wanted = SCHEDULE_COLUMNS + (ACTUAL_COLUMNS if actual else [])
    return flights.select([c for c in wanted if c in flights.columns])


def schema_table(spark) -> DataFrame:
    """The contract as rows (name, type, availability)."""
    rows = [(f.name, f.dataType.simpleString(), f.metadata["availability"]) for f in flight_schema().fields]
    return spark.createDataFrame(rows, "name string, type string, availability string")
