"""Star schema, key figures and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom.functions import distance_band, part_of_day, season
from transloom.operators.selection import exact_quantiles, with_same_keys

DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
SEATS = 130


def _day_name(dow: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DAYS)), dow + 1)


def fact_departures(f: DataFrame) -> DataFrame:
    return f.groupBy(F.col("Origin").alias("airport_code"), F.col("dep_ts_hour").alias("ts_hour")).agg(
        F.count("*").alias("sched_dep"), F.count_if(~F.col("Cancelled")).alias("dep_operated"), F.count_if("Cancelled").alias("dep_cancelled"), F.avg("DepDelay").alias("dep_delay_mean"), F.coalesce(F.sum("DepDel15"), F.lit(0)).cast("long").alias("dep_del15")
    )


def fact_arrivals(f: DataFrame) -> DataFrame:
    keyed = f.withColumns({"airport_code": F.col("Dest"), "ts_hour": F.col("arr_ts_hour")})
    keys = ["airport_code", "ts_hour"]
    counts = keyed.groupBy(*keys).agg(
        F.count("*").alias("sched_arr"), F.count_if(~F.col("Cancelled")).alias("arr_operated"), F.count_if("Cancelled").alias("arr_cancelled"), F.avg("ArrDelay").alias("arr_delay_mean"), F.coalesce(F.sum("ArrDel15"), F.lit(0)).cast("long").alias("arr_del15")
    )
    median = exact_quantiles(keyed, keys, "ArrDelay", [0.5]).select(*keys, F.get("quantiles", F.lit(0)).alias("arr_delay_median"))
    return with_same_keys(counts, median, keys, "left")


def join_arr_dep(arr: DataFrame, dep: DataFrame) -> DataFrame:
    """Full outer join on (airport, hour); absent counts are 0, absent delays stay null."""
    counts = ["sched_arr", "arr_operated", "arr_cancelled", "arr_del15", "sched_dep", "dep_operated", "dep_cancelled", "dep_del15"]
    return arr.join(dep, ["airport_code", "ts_hour"], "full_outer").na.fill(0, counts)


def fact_airport_hour(f: DataFrame, seats: int | None = SEATS) -> DataFrame:
    fact = join_arr_dep(fact_arrivals(f), fact_departures(f))
    ts = F.col("ts_hour")
    fact = fact.withColumns({"date": F.to_date(ts), "hour": F.hour(ts), "day_of_week": F.weekday(ts), "month": F.month(ts), "year": F.year(ts)})
    return fact.withColumns({"est_arr_passengers": F.col("sched_arr") * seats, "est_dep_passengers": F.col("sched_dep") * seats}) if seats else fact


def order_fact(fact: DataFrame) -> DataFrame:
    return fact.orderBy("airport_code", "ts_hour")


def agg_baseline_volume(fact: DataFrame) -> DataFrame:
    """Usual volume by airport, weekday and hour, over the hours that exist."""
    out = fact.groupBy("airport_code", "day_of_week", "hour").agg(F.avg("sched_arr").alias("baseline_sched_arr"), F.avg("sched_dep").alias("baseline_sched_dep"), F.avg("arr_delay_mean").alias("baseline_arr_delay_mean"), F.count("*").alias("n_observations"))
    return out.withColumn("day_name", _day_name(F.col("day_of_week")))


def agg_airline(f: DataFrame) -> DataFrame:
    return f.where(~F.col("Cancelled")).groupBy("Airline", F.month("FlightDate").alias("month")).agg(F.count("*").alias("flights"), F.avg("ArrDelay").alias("arr_delay_mean"), F.avg("DepDelay").alias("dep_delay_mean"), F.avg("ArrDel15").alias("arr_del15_rate"))


def agg_route(f: DataFrame) -> DataFrame:
    return f.where(~F.col("Cancelled")).groupBy("Origin", "Dest").agg(F.count("*").alias("flights"), F.avg("ArrDelay").alias("arr_delay_mean"), F.avg("ArrDel15").alias("arr_del15_rate"), F.avg("Distance").alias("mean_distance"))


def order_route(routes: DataFrame) -> DataFrame:
    return routes.orderBy(F.desc("flights"), "Origin", "Dest")


def agg_distance_bucket(f: DataFrame) -> DataFrame:
    b = f.where(~F.col("Cancelled")).withColumn("distance_bucket", distance_band(F.col("Distance"))).where("distance_bucket is not null")
    return b.groupBy("distance_bucket").agg(F.count("*").alias("flights"), F.avg("ArrDelay").alias("arr_delay_mean"), F.avg("ArrDel15").alias("arr_del15_rate"))


def dim_airport(coords: DataFrame, nodes: DataFrame) -> DataFrame:
    return coords.join(F.broadcast(nodes.select("code")), F.col("iata") == F.col("code"), "left_semi").withColumnRenamed("iata", "airport_code").orderBy("airport_code")


def dim_date(span: DataFrame) -> DataFrame:
    """One row a day of a one-row table (d0, d1)."""
    d = F.col("date")
    days = span.select(F.explode(F.sequence("d0", "d1", F.expr("INTERVAL 1 DAY"))).alias("date"))
    return days.select(
        d, F.year(d).alias("year"), F.month(d).alias("month"), F.date_format(d, "MMM").alias("month_name"), F.dayofmonth(d).alias("day"), F.weekday(d).alias("day_of_week"), _day_name(F.weekday(d)).alias("day_name"),
        (F.weekday(d) >= 5).alias("is_weekend"), F.quarter(d).alias("quarter"), F.weekofyear(d).alias("week_of_year"), season(F.month(d)).alias("season"),
    )


def dim_hour(spark: SparkSession) -> DataFrame:
    h = F.col("id").cast("int")
    return spark.range(24).select(h.alias("hour"), F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":00")).alias("hour_label"), part_of_day(h).alias("part_of_day"))


def weighted_mean(x: str, w: str) -> Column:
    """Mean of hourly means, weighted; null over no weight."""
    return F.try_divide(F.sum(F.col(x) * F.col(w)), F.sum(w))


def kpi_measures(fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    late = F.try_divide(F.sum("arr_del15"), F.sum("arr_operated"))
    return fact.groupBy(*by).agg(
        F.sum("sched_arr").alias("total_flights"), F.sum("arr_operated").alias("operated"), F.sum("arr_cancelled").alias("cancelled"), F.try_divide(F.sum("arr_cancelled"), F.sum("sched_arr")).alias("cancellation_pct"),
        weighted_mean("arr_delay_mean", "arr_operated").alias("avg_arr_delay"), weighted_mean("dep_delay_mean", "dep_operated").alias("avg_dep_delay"),
        F.sum("arr_del15").alias("delayed_15"), late.alias("delayed_15_pct"), (1 - late).alias("on_time_pct"), F.sum("est_arr_passengers").alias("est_passengers"),
    )


def kpi_prediction_measures(enriched: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    cols = [F.avg("predicted_arr_delay_min").alias("predicted_avg_delay"), F.avg("pct_arr_delayed_15").alias("avg_p_delay_15"), F.sum("expected_delayed_flights").alias("expected_delayed_flights"), F.sum("sched_dep").alias("scheduled_departures"), F.avg("traffic_vs_usual").alias("traffic_vs_usual")]
    if "actual_arr_delay_min" in enriched.columns:
        cols.append(F.avg(F.abs(F.col("predicted_arr_delay_min") - F.col("actual_arr_delay_min"))).alias("prediction_mae"))
    return enriched.groupBy(*by).agg(*cols)


def delay_heatmap(fact: DataFrame) -> DataFrame:
    """Hour by weekday matrix of the weighted mean arrival delay."""
    rows = fact.withColumn("day_name", _day_name(F.col("day_of_week")))
    return rows.groupBy("hour").pivot("day_name", list(DAYS)).agg(weighted_mean("arr_delay_mean", "arr_operated"))


def delay_by_month_season(fact: DataFrame, dates: DataFrame) -> DataFrame:
    return fact.drop("month", "year").join(dates, "date").groupBy("year", "month", "season").agg(F.sum("sched_arr").alias("flights"), weighted_mean("arr_delay_mean", "arr_operated").alias("avg_arr_delay"))


def trend(fact: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    return fact.groupBy(*by).agg(F.sum("sched_arr").alias("flights"), weighted_mean("arr_delay_mean", "arr_operated").alias("avg_arr_delay"))


def airport_summary(fact: DataFrame, airports: DataFrame) -> DataFrame:
    s = fact.groupBy("airport_code").agg(F.sum("sched_arr").alias("total_flights"), weighted_mean("arr_delay_mean", "arr_operated").alias("avg_arr_delay"))
    return s.join(F.broadcast(airports.select("airport_code", "latitude", "longitude")), "airport_code", "left")


def top_airports_by_delay(summary: DataFrame, n: int = 10) -> DataFrame:
    return summary.orderBy(F.desc("avg_arr_delay"), "airport_code").limit(n)


def next_n_hours_summary(enriched: DataFrame, n: int) -> DataFrame:
    return enriched.where(F.col("horizon_h") <= n).groupBy("airport_code").agg(F.avg("predicted_arr_delay_min").alias("predicted_delay"), F.sum("expected_delayed_flights").alias("expected_delayed_flights"), F.sum("sched_dep").alias("scheduled_departures"), F.avg("traffic_vs_usual").alias("traffic_vs_usual"))


def airport_traffic(enriched: DataFrame, n: int, seats: int = SEATS) -> DataFrame:
    return enriched.where(F.col("horizon_h") <= n).groupBy("airport_code").agg(F.sum("sched_arr").alias("expected_flights"), (F.sum("sched_arr") * seats).alias("est_passengers"), F.avg("traffic_vs_usual").alias("traffic_vs_usual"))


def horizon_profile(predictions: DataFrame, horizons: Sequence[int], threshold: float = 15.0) -> DataFrame:
    """One column a horizon with the mean predicted delay, and whether any reaches the threshold."""
    wide = predictions.groupBy("airport_code").agg(*[F.avg(F.when(F.col("horizon_h") == h, F.col("predicted_arr_delay_min"))).alias(f"h{h}") for h in horizons])
    return wide.withColumn("any_late", F.greatest(*[F.coalesce(F.col(f"h{h}"), F.lit(float("-inf"))) for h in horizons]) >= threshold)


def history_trend(history: DataFrame) -> DataFrame:
    return history.groupBy("prediction_ts").agg(F.avg("predicted_arr_delay_min").alias("mean_predicted_delay"), F.count("*").alias("n"))
