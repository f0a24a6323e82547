"""Trips, weather and payloads derived from the generic star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom.functions import wmo_category
from transloom.sources.schema import CAUSES
from transloom.sources.shared import file_system, new_folder


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def flights_from_lineitem(spark: SparkSession, folder: str, self_routes: bool = False) -> DataFrame:
    """One trip per line item: supplier nation to customer nation, integer measures. Trips to the origin are left out by default."""
    line = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customer = read(spark, folder, "customer").select("c_custkey", "c_nationkey")
    supplier = read(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    # orders meet their customers first, so that line items, several an order, are not sorted by customer
    owned = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    j = line.join(owned, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    code = lambda c: F.concat(F.lit("A"), F.lpad(F.col(c).cast("string"), 2, "0"))
    j = j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", code("s_nationkey").alias("Origin"), code("c_nationkey").alias("Dest"),
        F.expr("date_add(DATE '2019-09-10', CAST(l_orderkey % 30 AS INT))").alias("FlightDate"),
        F.expr("CAST((l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 24 AS INT)").alias("hh"),
        F.expr("CAST(l_partkey % 60 AS INT)").alias("mi"),
        F.expr("(l_orderkey * 3 + l_linenumber) % 53 = 0").alias("Cancelled"),
        F.expr("(l_orderkey * 5 + l_linenumber) % 97 = 0").alias("Diverted"),
        F.concat("l_returnflag", "l_linestatus").alias("Airline"),
        F.expr("100 + abs(s_nationkey - c_nationkey) * 95").cast("double").alias("Distance"),
    )
    arr = F.expr("CASE WHEN Cancelled OR Diverted THEN NULL ELSE CAST((l_partkey * 31 + l_orderkey * 17 + l_linenumber * 7) % 120 - 20 AS DOUBLE) END")
    dep = F.expr("CASE WHEN Cancelled THEN NULL ELSE CAST((l_suppkey * 13 + l_orderkey * 11) % 90 - 10 AS DOUBLE) END")
    j = j.withColumns({"ArrDelay": arr, "DepDelay": dep})
    out = j.select(
        "l_orderkey", "l_linenumber", "FlightDate", "Airline", "Origin", "Dest",
        F.expr("hh * 100 + mi").alias("CRSDepTime"), F.expr("CAST(((hh + l_suppkey % 4) % 24) * 100 + mi AS INT)").alias("CRSArrTime"),
        F.month("FlightDate").alias("Month"), F.dayofmonth("FlightDate").alias("DayofMonth"), (F.weekday("FlightDate") + 1).alias("DayOfWeek"),
        "Cancelled", "Diverted", "ArrDelay", "DepDelay", "Distance", F.expr("30 + floor(Distance / 8)").cast("double").alias("AirTime"),
        F.expr("8 + l_linenumber").cast("double").alias("TaxiOut"), F.expr("3 + l_partkey % 7").cast("double").alias("TaxiIn"),
        (F.col("ArrDelay") >= 15).cast("double").alias("ArrDel15"), (F.col("DepDelay") >= 15).cast("double").alias("DepDel15"),
        *[F.expr(f"CASE WHEN ArrDelay >= 15 THEN CASE WHEN l_partkey % 5 = {i} THEN ArrDelay ELSE 0D END END").alias(c) for i, c in enumerate(CAUSES)],
    )
    return out if self_routes else out.where("Origin <> Dest")


_STAGED: dict[tuple, str] = {}


def _listing(spark: SparkSession, path: str) -> tuple:
    """(name, length, modification time) of all files below ``path``: another one whenever a file is rewritten in place."""
    fs, p = file_system(spark, path)
    files, found = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def staged_trips(spark: SparkSession, folder: str) -> DataFrame:
    """``flights_from_lineitem`` as a table in the shared folder, made once for a session and state of its inputs.

    A trip table is where the analytics start; deriving it takes a join of four tables. Kept as Parquet, each
    operator's own scan reads only the columns that it needs.
    """
    inputs = [f"{folder}/{name}.parquet" for name in ("lineitem", "orders", "customer", "supplier")]
    state = tuple(_listing(spark, i) for i in inputs)
    key = (spark.sparkContext.applicationId, folder, state)
    if key not in _STAGED:
        path = new_folder(spark, "trips")
        flights_from_lineitem(spark, folder).write.parquet(path)
        _STAGED[key] = path
    return spark.read.schema(flights_from_lineitem(spark, folder).schema).parquet(_STAGED[key])


def weather_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, iata, timestamp, values, weather_code, weather_category): several observations an hour."""
    e = read(spark, folder, "events")
    v = F.col("value").cast("int")
    code = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 45).when(F.col("event_type") == "purchase", 61).when(F.col("event_type") == "signup", 75).when(F.col("event_type") == "error", 95).otherwise(1)
    days = "datediff(DATE '2019-09-10', DATE '2024-01-01')"
    return e.select(
        "event_id", F.concat(F.lit("A"), F.lpad((F.col("user_id") % 25).cast("string"), 2, "0")).alias("iata"),
        F.expr(f"timestampadd(DAY, {days}, CAST(ts AS TIMESTAMP_NTZ))").alias("timestamp"),
        (v % 40).cast("double").alias("wind_speed_10m"), (v % 60 + 10).cast("double").alias("wind_gusts_10m"), (v % 5).cast("double").alias("precipitation"), (v % 101).cast("double").alias("cloud_cover"),
        code.alias("weather_code"), wmo_category(code).alias("weather_category"),
    )


def weather_payloads(weather: DataFrame) -> DataFrame:
    """(iata, payload): hourly JSON of each place and day, in time order."""
    names = ["wind_speed_10m", "wind_gusts_10m", "precipitation", "cloud_cover", "weather_code"]
    rows = weather.groupBy("iata", F.to_date("timestamp").alias("day")).agg(F.sort_array(F.collect_list(F.struct("timestamp", "event_id", *names))).alias("r"))
    time = F.transform("r", lambda x: F.date_format(x["timestamp"], "yyyy-MM-dd'T'HH:mm"))
    values = [F.col(f"r.{n}").alias(n) for n in names]  # a field of an array of structs is the array of its values
    return rows.select("iata", F.to_json(F.struct(F.struct(time.alias("time"), *values).alias("hourly"))).alias("payload"))
