"""Registrations: one query for each operator that yields a table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom import streaming
from transloom.functions import clean_code, cyclic, distance_band, floor_bucket, inf_to_zero, nan_to_zero, one_hot, parse_iso, season, sigmoid, two_digits, wmo_category, zero_if_missing
from transloom.operators import cleaning, history, metrics, network, predictions, selection, snapshots, star, tabular, trees, weather
from transloom.plans import pipelines as P
from transloom.plans.registry import register
from transloom.sources import adapters, clustered, hours, ledger, scans, schema, sinks
from transloom.sources.shared import delete, file_system, new_folder

H = P.HORIZONS


def _now():
    return F.lit("2019-10-01 00:00:00").cast("timestamp_ntz")


_folder = new_folder


def _f(spark, d):
    return P.prepared(spark, d)[0]


def _grid(spark, d):
    f, nodes, snaps = P.snapshot_base(spark, d)
    return f, snapshots.dense_grid(nodes, snaps)


FLIGHT_KEYS = ["l_orderkey", "l_linenumber"]

# ---- sources -------------------------------------------------------------------------------------------
register(
    "scan_parquet",
    lambda s, d: scans.scan_parquet(s, f"{d}/orders.parquet", ["o_orderkey", "o_custkey", "not_there"]),
    "SELECT o_orderkey, o_custkey FROM orders",
)
register(
    "sample_rows",
    lambda s, d: scans.sample_rows(adapters.read(s, d, "orders").select("o_orderkey"), 0.1, key=["o_orderkey"]),
    f"SELECT o_orderkey FROM orders WHERE substr(md5(o_orderkey || '|42'), 1, 8) < '{int(0.1 * (1 << 32)):08x}'",
)
register(
    "flight_schema",
    lambda s, d: adapters.flights_from_lineitem(s, d).select(*FLIGHT_KEYS, *[c for c in schema.SCHEDULE_COLUMNS + schema.ACTUAL_COLUMNS if c in ("Origin", "Dest", "CRSDepTime", "CRSArrTime", "ArrDelay", "DepDelay", "Distance", "AirTime")]),
    (
        "SELECT l_orderkey, l_linenumber, Origin, Dest, CRSDepTime, CRSArrTime, ArrDelay, DepDelay, Distance, AirTime "
        "FROM flights"
    ),
)


_CSV = ["FlightDate", "Origin", "Dest", "CRSDepTime", "ArrDelay", "Cancelled"]


def _csv_files(s, d):
    """Files of three headers: as it should be, in another order, and without a column; some rows do not parse."""
    path, f = _folder(s), P.flights(s, d)
    time = F.when(F.col("l_orderkey") % 41 == 0, F.concat(F.lit("at "), F.col("CRSDepTime").cast("string"))).otherwise(F.col("CRSDepTime").cast("string"))
    f = f.select("l_orderkey", *[time.alias(c) if c == "CRSDepTime" else c for c in _CSV])
    for i, columns in enumerate((_CSV, ["Dest", "Cancelled", "ArrDelay", "CRSDepTime", "Origin", "FlightDate"], ["Dest", "Origin", "CRSDepTime", "ArrDelay"])):
        f.where(F.col("l_orderkey") % 3 == i).select(columns).write.option("header", True).csv(f"{path}/Flights_2019_{i + 1}.csv")
    return path


def _scan_csv(s, d):
    rows = scans.scan_csv(s, f"{_csv_files(s, d)}/*.csv", ["Origin", "Dest", "CRSDepTime", "ArrDelay", "Cancelled"])
    return rows.groupBy("Origin", "Dest").agg(F.count("*").alias("n"), F.sum(F.col("ArrDelay").cast("double")).alias("delay"), F.count_if("Cancelled").alias("cancelled"), F.sum(F.col("CRSDepTime").cast("long")).alias("times"))


_BY_ROUTE = "SELECT Origin, Dest, count(*) AS n, sum(ArrDelay) AS delay, count(*) FILTER (Cancelled) AS cancelled FROM flights GROUP BY ALL"
register("scan_csv", _scan_csv, (
    "SELECT Origin, Dest, count(*) AS n, sum(ArrDelay) AS delay, count(*) FILTER (Cancelled AND l_orderkey % 3 < 2) AS cancelled, "
    "sum(CRSDepTime)::BIGINT AS times FROM flights WHERE l_orderkey % 41 <> 0 GROUP BY ALL"
))


def _scan_quarantine(s, d):
    """Each record that did not parse, how often, and whether all its lines lie behind a header."""
    found = scans.scan_csv_quarantine(s, f"{_csv_files(s, d)}/*.csv")
    lines = F.count_distinct("file", "line")
    return found.groupBy("record").agg(F.count("*").alias("n"), (lines == F.count("*")).alias("own_lines"), (F.min("line") > 1).alias("behind_header"))


_CELL = "coalesce(ArrDelay::VARCHAR, '')"
register("scan_csv_quarantine", _scan_quarantine, (
    f"SELECT CASE l_orderkey % 3 WHEN 0 THEN concat_ws(',', FlightDate, Origin, Dest, 'at ' || CRSDepTime, {_CELL}, Cancelled) "
    f"WHEN 1 THEN concat_ws(',', Dest, Cancelled, {_CELL}, 'at ' || CRSDepTime, Origin, FlightDate) "
    f"ELSE concat_ws(',', Dest, Origin, 'at ' || CRSDepTime, {_CELL}) END AS record, count(*) AS n, true AS own_lines, true AS behind_header "
    "FROM flights WHERE l_orderkey % 41 = 0 GROUP BY ALL"
))


def _months(s, d):
    """A year's monthly files, the second one in another order of columns."""
    folder, f = _folder(s), P.flights(s, d)
    for month, columns in ((9, _CSV), (10, _CSV[::-1])):
        f.where(F.month("FlightDate") == month).select(columns).write.option("header", True).csv(f"{folder}/Flights_2020_{month}.csv")
    return scans.scan_year(s, folder, 2020).groupBy("Origin", "Dest").agg(F.count("*").alias("n"), F.sum(F.col("ArrDelay").cast("double")).alias("delay"), F.count_if("Cancelled").alias("cancelled"))


register("scan_year_monthly", _months, _BY_ROUTE)


def _years(s, d, years):
    folder = _folder(s)
    f = P.flights(s, d).select("FlightDate", "Origin", "Dest", "CRSDepTime", "ArrDelay", "Cancelled")
    f.where("month(FlightDate) = 9").write.parquet(f"{folder}/Combined_Flights_2018.parquet")
    f.where("month(FlightDate) = 10").write.option("header", True).csv(f"{folder}/Combined_Flights_2019.csv")
    return folder, scans.scan_years(s, folder, years).groupBy("Origin", "Dest").agg(F.count("*").alias("n"), F.sum(F.col("ArrDelay").cast("double")).alias("delay"), F.count_if("Cancelled").alias("cancelled"))


register("scan_year", lambda s, d: _years(s, d, [2018])[1], _BY_ROUTE.replace("FROM flights", "FROM flights WHERE month(FlightDate) = 9"))
register("scan_years", lambda s, d: _years(s, d, [2017, 2018, 2019])[1], _BY_ROUTE)


def _convert(s, d):
    folder, _ = _years(s, d, [2019])
    path = sinks.convert_csv_to_parquet(s, folder, [2018, 2019])[0]
    return s.read.parquet(path).groupBy("Origin").agg(F.count("*").alias("n"))


register("convert_csv_to_parquet", _convert, "SELECT Origin, count(*) AS n FROM flights WHERE month(FlightDate) = 10 GROUP BY ALL")
register(
    "scan_hour_slice",
    lambda s, d: scans.scan_hour_slice(P.flights(s, d), 9, 20, 8).select(*FLIGHT_KEYS, "Origin", "Dest", "CRSDepTime"),
    "SELECT l_orderkey, l_linenumber, Origin, Dest, CRSDepTime FROM flights WHERE FlightDate = DATE '2019-09-20' AND hh = 8",
)
register(
    "scan_forward_schedule",
    lambda s, d: scans.scan_forward_schedule(cleaning.derive_timestamps(P.flights(s, d)), F.lit("2019-09-20 20:00:00").cast("timestamp_ntz")).select(*FLIGHT_KEYS, "timestamp"),
    (
        "SELECT l_orderkey, l_linenumber, ts::VARCHAR AS timestamp FROM timed WHERE ts >= TIMESTAMP '2019-09-20 20:00:00' "
        "AND ts < TIMESTAMP '2019-09-21 05:00:00'"
    ),
)
register(
    "split_class_ab",
    lambda s, d: schema.split_by_availability(P.flights(s, d), False).groupBy("Origin", "Dest", "Cancelled", "Diverted").agg(F.count("*").alias("n"), F.sum("Distance").alias("miles")),
    "SELECT Origin, Dest, Cancelled, Diverted, count(*) AS n, sum(Distance) AS miles FROM flights GROUP BY ALL",
)
register(
    "scan_weather_json",
    lambda s, d: scans.scan_weather_json(adapters.weather_payloads(adapters.weather_from_events(s, d))).groupBy("iata", "timestamp").agg(F.count("*").alias("n"), F.sum("wind_speed_10m").alias("wind"), F.sum("weather_category").alias("categories")),
    (
        "SELECT iata, date_trunc('minute', ts)::TIMESTAMP::VARCHAR AS timestamp, count(*) AS n, sum(wind) AS wind, "
        "sum(cat)::BIGINT AS categories FROM wx GROUP BY ALL"
    ),
)


def _weather_cache(s, d):
    """All places written by their names and read again, for the trips' range of days; A77 has no file."""
    folder, wx = _folder(s), adapters.weather_from_events(s, d)
    start, end = scans.weather_range(P.flights(s, d))
    codes = sinks.write_weather_cache(wx, folder, start, end)
    found, missing = scans.scan_weather_cache(s, folder, [*codes, "A77"], start, end)
    found = found.groupBy("iata").agg(F.count("*").alias("n"), F.sum("wind_speed_10m").alias("wind"), F.min("timestamp").alias("first"))
    return found.unionByName(missing.select("iata", F.lit(0).cast("long").alias("n")), allowMissingColumns=True)


register(
    "scan_weather_cache",
    _weather_cache,
    """
    SELECT iata, count(*) AS n, sum(wind) AS wind, min(ts)::VARCHAR AS first FROM wx
    WHERE ts::DATE BETWEEN (SELECT min(FlightDate) FROM flights) AND (SELECT max(FlightDate) FROM flights) + 1
    GROUP BY ALL UNION ALL SELECT 'A77', 0, NULL, NULL""",
)


def _airports_csv(s, d):
    path = f"{_folder(s)}/airports.csv"
    P.airports(s, d).write.option("header", True).csv(path)
    return scans.scan_airports(s, path).withColumnRenamed("iata", "airport_code")


register("scan_airports", _airports_csv, "SELECT airport_code, name, latitude, longitude, elevation_m FROM airports")


def _landed(s, d, keep=None):
    path = f"{_folder(s)}/buffer"
    rows = cleaning.derive_timestamps(P.flights(s, d)).select(*FLIGHT_KEYS, "Origin", "Dest", "timestamp", "arr_timestamp", "ArrDelay")
    sinks.write_hour_partition(rows if keep is None else rows.where(keep), path)
    return path, sinks.read_hour_partitions(s, path)


_HOURS = "SELECT ts::VARCHAR AS part_ts, count(*) AS n FROM timed {} GROUP BY ALL"
_per_hour = lambda df: df.groupBy("part_ts").agg(F.count("*").alias("n"))
register("write_hour_partition", lambda s, d: _per_hour(_landed(s, d)[1]), _HOURS.format(""))
register(
    "scan_last_n_partitions",
    lambda s, d: _per_hour(hours.last_hours(hours.HourIndex(s, _landed(s, d)[0]), _now())),
    _HOURS.format("WHERE ts >= TIMESTAMP '2019-09-30 00:00:00' AND ts < TIMESTAMP '2019-10-01 00:00:00'"),
)
register("missing_hours", lambda s, d: hours.missing_hours(hours.HourIndex(s, _landed(s, d, F.hour("timestamp") % 5 != 0)[0]), _now()), (
    "SELECT (TIMESTAMP '2019-09-30 00:00:00' + to_hours(x::INT))::VARCHAR AS part_ts FROM range(24) t(x) "
    "WHERE x % 5 = 0 OR NOT EXISTS (SELECT 1 FROM timed WHERE ts = TIMESTAMP '2019-09-30 00:00:00' + to_hours(x::INT))"
))
register("scan_latest_schedule", lambda s, d: hours.latest_hour(hours.HourIndex(s, _landed(s, d)[0]), _now()).select(*FLIGHT_KEYS, "part_ts"), (
    "SELECT l_orderkey, l_linenumber, ts::VARCHAR AS part_ts FROM timed WHERE ts = (SELECT max(ts) FROM timed "
    "WHERE ts <= TIMESTAMP '2019-10-01 00:00:00' AND ts >= TIMESTAMP '2019-09-30 00:00:00')"
))
_KEPT = "WHERE ts >= TIMESTAMP '2019-09-24 00:00:00'"


def _trim(s, d):
    path, _ = _landed(s, d)
    sinks.trim_retention(s, path, _now())
    return _per_hour(sinks.read_hour_partitions(s, path))


register("trim_retention", _trim, _HOURS.format(_KEPT))
register("retained", lambda s, d: _per_hour(sinks.retained(_landed(s, d)[1], _now())), _HOURS.format(_KEPT))


def _backfill(s, d):
    path = f"{_folder(s)}/buffer"
    sinks.backfill_hours(cleaning.derive_timestamps(P.flights(s, d)), path, _now())
    return _per_hour(sinks.read_hour_partitions(s, path))


register("backfill_hours", _backfill, _HOURS.format(_KEPT + " AND ts < TIMESTAMP '2019-10-01 00:00:00'"))


_BROKEN = datetime(2019, 9, 27, 6)


def _backfilled(s, d, repaired):
    """The report of a backfill from trips by hour, where every fifth hour of a day is empty and the file of one hour is not Parquet;
    or the report of the backfill after it, when that file is sound, which tries failed and empty hours again."""
    base, rows = _folder(s), cleaning.derive_timestamps(P.flights(s, d)).select(*FLIGHT_KEYS, "Origin", "Dest", "timestamp", "arr_timestamp", "ArrDelay")
    source, _ = _landed(s, d, F.hour("timestamp") % 5 != 0)
    folder = hours.HourIndex(s, source).folder(_BROKEN)
    delete(s, folder)
    fs, file = file_system(s, f"{folder}/part-0.parquet")
    out = fs.create(file)
    out.writeBytes("this is no Parquet file")
    out.close()
    land = lambda df, run: ledger.commit_hours(df, f"{base}/landing", f"{base}/buffer", f"{base}/ledger", run)
    run = lambda: ledger.backfill(s, ledger.hour_source(s, source, rows.schema), rows.schema, _now(), f"{base}/outcomes", land)
    report = run()
    if repaired:
        sinks.write_hour_partition(rows.where(F.col("timestamp") == F.lit(str(_BROKEN)).cast("timestamp_ntz")), source)
        report = run()
        found = ledger.read_committed(s, f"{base}/buffer", f"{base}/ledger").groupBy(F.col("part_ts").alias("hour")).agg(F.count("*").alias("in_buffer"))
        return report.join(found, "hour", "left").select("hour", "n", "status", "runs", F.coalesce("in_buffer", F.lit(0)).alias("in_buffer"))
    return report.select("hour", "n", "status", "runs", F.col("error").isNotNull().alias("has_error"))


_WANTED = (
    "SELECT w.hour::VARCHAR AS hour, CASE WHEN {failed} THEN 0 ELSE coalesce(n, 0) END AS n, CASE WHEN {failed} THEN 'failed' WHEN n > 0 THEN 'ok' "
    "ELSE 'empty' END AS status, {more} FROM (SELECT TIMESTAMP '2019-09-24 00:00:00' + to_hours(x::INT) AS hour FROM range(168) t(x)) w "
    "LEFT JOIN (SELECT ts AS hour, count(*) AS n FROM timed WHERE hour(ts) % 5 <> 0 GROUP BY ALL) k USING (hour)"
)
_FAILED = "w.hour = TIMESTAMP '2019-09-27 06:00:00'"
register("backfill_report", lambda s, d: _backfilled(s, d, False), _WANTED.format(failed=_FAILED, more=f"1 AS runs, {_FAILED} AS has_error"))
register("backfill_retry", lambda s, d: _backfilled(s, d, True), _WANTED.format(failed="false", more=f"CASE WHEN n > 0 AND NOT {_FAILED} THEN 1 ELSE 2 END AS runs, coalesce(n, 0) AS in_buffer"))


def _committed(s, d):
    """Two batches of two trees: all trips, then those of some hours again with other rows; a third one fails after the landing
    tree and is not seen. The landing tree is read; ``same`` tells whether the buffer agrees."""
    base, rows = _folder(s), cleaning.derive_timestamps(P.flights(s, d)).select(*FLIGHT_KEYS, "Origin", "Dest", "timestamp")
    trees = (f"{base}/landing", f"{base}/buffer", f"{base}/ledger")
    ledger.commit_hours(rows, *trees, 0)
    ledger.commit_hours(rows.where("hour(timestamp) % 4 = 1 AND l_linenumber <= 2"), *trees, 1)
    sinks.with_hour_partition(rows.where("l_linenumber = 1")).repartition(*ledger.PARTS).withColumn("batch", F.lit(2)).write.partitionBy(*ledger.PARTS, "batch").mode("append").parquet(trees[0])
    sides = [ledger.read_committed(s, tree, trees[2]).groupBy("part_ts", "batch").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("orders")) for tree in trees[:2]]
    other = sides[1].select("part_ts", "batch", F.col("n").alias("n2"), F.col("orders").alias("orders2"))
    return sides[0].join(other, ["part_ts", "batch"], "full").select("part_ts", "batch", "n", "orders", F.equal_null(F.struct("n", "orders"), F.struct(F.col("n2").alias("n"), F.col("orders2").alias("orders"))).alias("same"))


register("commit_hours", _committed, (
    "SELECT ts::VARCHAR AS part_ts, CASE WHEN hour(ts) % 4 = 1 AND bool_or(l_linenumber <= 2) THEN 1 ELSE 0 END AS batch, "
    "CASE WHEN hour(ts) % 4 = 1 AND bool_or(l_linenumber <= 2) THEN count(*) FILTER (l_linenumber <= 2) ELSE count(*) END AS n, "
    "CASE WHEN hour(ts) % 4 = 1 AND bool_or(l_linenumber <= 2) THEN sum(l_orderkey) FILTER (l_linenumber <= 2) ELSE sum(l_orderkey) END::BIGINT AS orders, "
    "true AS same FROM timed GROUP BY ts"
))


def _write_table(s, d):
    path = f"{_folder(s)}/agg_airline"
    sinks.write_table(star.agg_airline(P.report_frame(s, d)), path)
    return s.read.parquet(f"{path}.parquet").join(s.read.option("header", True).schema("Airline string, month int, n long").csv(f"{path}.csv").select("Airline", "month"), ["Airline", "month"])


_AIRLINE = (
    "SELECT Airline, month(FlightDate)::INT AS month, count(*) AS flights, round(avg(ArrDelay), 6) AS arr_delay_mean, "
    "round(avg(DepDelay), 6) AS dep_delay_mean, round(avg(ArrDel15), 6) AS arr_del15_rate FROM rf WHERE NOT Cancelled "
    "GROUP BY ALL"
)
register("write_table", _write_table, _AIRLINE)


def _prediction_sinks(s, d):
    base, p = _folder(s), P.predicted(s, d).select(*predictions.PREDICTION_COLUMNS)
    sinks.write_predictions_latest(p, f"{base}/latest")
    latest = s.read.parquet(f"{base}/latest")
    for _ in range(2):
        sinks.write_predictions_history(latest, f"{base}/history")
    return latest, sinks.read_predictions_history(s, f"{base}/history")


_PRED = (
    "airport_code, horizon_h, round(predicted_arr_delay_min, 6) + 0.0 AS predicted_arr_delay_min, "
    "round(pct_arr_delayed_15, 6) AS pct_arr_delayed_15, target_ts::VARCHAR AS target_ts, "
    "prediction_ts::VARCHAR AS prediction_ts"
)
register("write_predictions_latest", lambda s, d: _prediction_sinks(s, d)[0], f"SELECT {_PRED} FROM preds")
register(
    "write_predictions_history",
    lambda s, d: _prediction_sinks(s, d)[1].groupBy("prediction_ts").agg(F.count("*").alias("n")),
    "SELECT prediction_ts::VARCHAR AS prediction_ts, 2 * count(*) AS n FROM preds GROUP BY ALL",
)
register(
    "write_batch_predictions",
    lambda s, d: _prediction_sinks(s, d)[0].groupBy("horizon_h").agg(F.count("*").alias("n")),
    "SELECT horizon_h, count(*) AS n FROM preds GROUP BY ALL",
)


def _cache(s, d):
    f, path = P.flights(s, d), _folder(s)
    sig = sinks.signature(f, {"window": 1}, ["A00"])
    build = lambda: network.airport_activity(f)
    sinks.cached_table(s, path, sig, build)
    return sinks.cached_table(s, path, sig, build).select("code", "n")


register(
    "snapshot_cache",
    _cache,
    "SELECT code, count(*) AS n FROM (SELECT Origin AS code FROM flights UNION ALL SELECT Dest FROM flights) GROUP BY code",
)


def _artifacts(s, d):
    f, nodes = P.prepared(s, d)
    path = _folder(s)
    stats = snapshots.feature_stats(snapshots.node_features_basic(f), ["dep_mean"])
    sinks.write_artifacts(network.node_index(nodes), stats, s.createDataFrame([("window", "1")], "key string, value string"), path)
    return s.read.parquet(f"{path}/node_map").select("node_idx", "code")


_INDEX = "SELECT (row_number() OVER (ORDER BY code) - 1)::INT AS node_idx, code FROM nodes"
register("write_artifacts", _artifacts, _INDEX)

# ---- cleaning and network ------------------------------------------------------------------------------
register(
    "clean_flights",
    lambda s, d: cleaning.clean_flights(P.flights(s, d)).select(*FLIGHT_KEYS, "FlightDate", "ArrDelay"),
    "SELECT l_orderkey, l_linenumber, FlightDate::VARCHAR AS FlightDate, ArrDelay FROM clean",
)
register(
    "fill_delay_nulls",
    lambda s, d: cleaning.fill_delay_nulls(P.flights(s, d)).select(*FLIGHT_KEYS, "ArrDelay", "DepDelay", "CarrierDelay", "ArrDel15"),
    (
        "SELECT l_orderkey, l_linenumber, coalesce(ArrDelay, 0) AS ArrDelay, coalesce(DepDelay, 0) AS DepDelay, "
        "coalesce(CarrierDelay, 0) AS CarrierDelay, coalesce(ArrDel15, 0) AS ArrDel15 FROM flights"
    ),
)
register(
    "null_report",
    lambda s, d: cleaning.null_report(P.flights(s, d)),
    "SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in cleaning.FILLED) + " FROM flights",
)
register(
    "encode_time",
    lambda s, d: cleaning.encode_time(P.flights(s, d)).groupBy("Hour").agg(F.count("*").alias("n")),
    "SELECT hh AS Hour, count(*) AS n FROM flights GROUP BY ALL",
)
register(
    "filter_network",
    lambda s, d: network.filter_network(P.flights(s, d), network.top_n_airports(P.flights(s, d), 5)).select(*FLIGHT_KEYS, "Origin", "Dest"),
    (
        "SELECT l_orderkey, l_linenumber, Origin, Dest FROM (SELECT *, (SELECT list(code) FROM (SELECT code "
        "FROM (SELECT Origin AS code FROM flights UNION ALL SELECT Dest FROM flights) GROUP BY code ORDER BY count(*) DESC, "
        "code LIMIT 5)) AS top FROM flights) WHERE list_contains(top, Origin) AND list_contains(top, Dest)"
    ),
)
register(
    "preprocess_pipeline",
    lambda s, d: _f(s, d).select(*FLIGHT_KEYS, "Hour", "ArrDelay"),
    "SELECT l_orderkey, l_linenumber, hh AS Hour, ArrDelay FROM f",
)
register(
    "derive_timestamps",
    lambda s, d: cleaning.derive_timestamps(P.flights(s, d)).select(*FLIGHT_KEYS, "timestamp", "arr_timestamp"),
    "SELECT l_orderkey, l_linenumber, ts::VARCHAR AS timestamp, arr_ts::VARCHAR AS arr_timestamp FROM timed",
)
register(
    "build_flight_frame",
    lambda s, d: P.report_frame(s, d).select(*FLIGHT_KEYS, "Cancelled", "dep_ts_hour", "arr_ts_hour"),
    "SELECT l_orderkey, l_linenumber, Cancelled, ts::VARCHAR AS dep_ts_hour, arr_ts::VARCHAR AS arr_ts_hour FROM rf",
)
register(
    "window_slice",
    lambda s, d: snapshots.window_slice(_f(s, d), F.lit("2019-09-20 08:00:00").cast("timestamp_ntz"), 2).select(*FLIGHT_KEYS),
    (
        "SELECT l_orderkey, l_linenumber FROM f WHERE ts >= TIMESTAMP '2019-09-20 08:00:00' "
        "AND ts < TIMESTAMP '2019-09-20 10:00:00'"
    ),
)
register(
    "completed_only",
    lambda s, d: snapshots.completed_only(_f(s, d), _now()).groupBy("Dest").agg(F.count("*").alias("n")),
    "SELECT Dest, count(*) AS n FROM f WHERE arr_ts < TIMESTAMP '2019-10-01 00:00:00' GROUP BY ALL",
)
register(
    "select_feature_columns",
    lambda s, d: (lambda f: f.groupBy("Origin").agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in tabular.select_feature_columns(f.select("Origin", "CRSDepTime", "Distance", "ArrDelay", "DepDelay"), "ArrDelay")]))(_f(s, d)),
    "SELECT Origin, sum(CRSDepTime)::DOUBLE AS CRSDepTime, sum(Distance) AS Distance FROM f GROUP BY ALL",
)
register(
    "distance_bucket",
    lambda s, d: P.flights(s, d).groupBy(distance_band(F.col("Distance")).alias("distance_bucket")).agg(F.count("*").alias("n")),
    (
        "SELECT CASE WHEN Distance < 250 THEN '0-250' WHEN Distance < 500 THEN '250-500' WHEN Distance < 750 THEN '500-750' "
        "WHEN Distance < 1000 THEN '750-1000' WHEN Distance < 1500 THEN '1000-1500' WHEN Distance < 2000 THEN '1500-2000' "
        "ELSE '2000+' END AS distance_bucket, count(*) AS n FROM flights GROUP BY ALL"
    ),
)
register("guard_min_rows", lambda s, d: P.snapshot_base(s, d)[2], "SELECT snapshot_ts::VARCHAR AS snapshot_ts FROM snaps")
register("airport_activity", lambda s, d: network.airport_activity(cleaning.clean_flights(P.flights(s, d))), "SELECT code, n FROM activity")
register(
    "top_n_airports",
    lambda s, d: network.top_n_airports(cleaning.clean_flights(P.flights(s, d)), 20),
    "SELECT code, n FROM activity ORDER BY n DESC, code LIMIT 20",
)
register("top10_origins", lambda s, d: network.top10_origins(_f(s, d)), "SELECT code, n FROM top10")
register(
    "node_index_join",
    lambda s, d: network.with_node_index(_f(s, d).select(*FLIGHT_KEYS, "Origin"), network.node_index(P.prepared(s, d)[1]), "Origin", "origin_idx"),
    (
        "SELECT l_orderkey, l_linenumber, Origin, node_idx AS origin_idx FROM f "
        "JOIN (SELECT (row_number() OVER (ORDER BY code) - 1)::INT AS node_idx, code FROM nodes) ON code = Origin"
    ),
)
register("node_index", lambda s, d: network.node_index(P.prepared(s, d)[1]), _INDEX)
register(
    "semi_isin",
    lambda s, d: _f(s, d).join(network.top10_origins(_f(s, d)), F.col("Origin") == F.col("code"), "left_semi").groupBy("Origin").agg(F.count("*").alias("n")),
    "SELECT code AS Origin, n FROM top10",
)
register(
    "missing_dim_keys",
    lambda s, d: network.missing_dim_keys(P.prepared(s, d)[1], P.airports(s, d).where("elevation_m % 30 = 0").withColumnRenamed("iata", "airport_code")),
    "SELECT code FROM nodes WHERE code NOT IN (SELECT airport_code FROM airports WHERE elevation_m % 30 = 0)",
)
register(
    "except_nodes",
    lambda s, d: P.airports(s, d).select(F.col("iata").alias("code")).exceptAll(P.prepared(s, d)[1]),
    "SELECT airport_code AS code FROM airports EXCEPT SELECT code FROM nodes",
)
register(
    "distinct_codes",
    lambda s, d: adapters.weather_from_events(s, d).select("iata").distinct().orderBy("iata"),
    "SELECT DISTINCT iata FROM wx",
)
register(
    "union_all",
    lambda s, d: scans.union_all([P.flights(s, d).select("Origin", "Dest"), P.flights(s, d).select("Origin", "Airline")]).groupBy("Origin").agg(F.count("*").alias("n"), F.count("Airline").alias("airlines")),
    "SELECT Origin, 2 * count(*) AS n, count(*) AS airlines FROM flights GROUP BY ALL",
)
register("edge_static", lambda s, d: network.edge_static(_f(s, d)), (
    "SELECT edge_id, src, dst, round(count_norm, 6) AS count_norm, round(air_time_norm, 6) AS air_time_norm, "
    "round(distance_norm, 6) AS distance_norm FROM edges"
))
register(
    "global_max_norm",
    lambda s, d: network.edge_static(_f(s, d)).agg(F.max("count_norm").alias("c"), F.max("air_time_norm").alias("a"), F.max("distance_norm").alias("d"), F.count("*").alias("n")),
    "SELECT max(count_norm) AS c, max(air_time_norm) AS a, max(distance_norm) AS d, count(*) AS n FROM edges",
)


def _neighbors(s, d, hops=1):
    f, nodes, snaps = P.snapshot_base(s, d)
    rows = snapshots.node_features_basic(f).join(snaps, "snapshot_ts", "left_semi").select("snapshot_ts", "node", "dep_mean")
    return network.neighbor_aggregate(rows, network.edge_static(f), ["dep_mean"], hops)


register("neighbor_aggregate", _neighbors, (
    "SELECT snapshot_ts::VARCHAR AS snapshot_ts, dst AS node, round(sum(w / sqrt(ds * dt) * m), 6) + 0.0 AS dep_mean "
    "FROM (SELECT src, dst, sum(count_norm) AS w FROM edges GROUP BY ALL) e JOIN (SELECT src AS s, sum(count_norm) AS ds "
    "FROM edges GROUP BY ALL) a ON a.s = e.src JOIN (SELECT dst AS t, sum(count_norm) AS dt FROM edges "
    "GROUP BY ALL) b ON b.t = e.dst JOIN (SELECT snapshot_ts, node, coalesce(x.m, 0) AS m "
    "FROM (SELECT ts + INTERVAL 1 HOUR AS snapshot_ts, Origin AS node, avg(DepDelay) AS m FROM f GROUP BY ALL) x FULL "
    "JOIN (SELECT DISTINCT ts + INTERVAL 1 HOUR AS snapshot_ts, Dest AS node FROM f) y USING (snapshot_ts, "
    "node)) q ON q.node = e.src WHERE snapshot_ts IN (SELECT snapshot_ts FROM snaps) GROUP BY ALL"
))


def _hops(n):
    """The loop over hops, as nested queries."""
    out = "SELECT * FROM dm"
    for _ in range(n):
        out = f"SELECT snapshot_ts, dst AS node, sum(w * m) AS m FROM aw JOIN ({out}) q ON q.node = aw.src GROUP BY ALL"
    return f"SELECT snapshot_ts::VARCHAR AS snapshot_ts, node, round(m, 6) + 0.0 AS dep_mean FROM ({out})"


register("neighbor_aggregate_4hops", lambda s, d: _neighbors(s, d, 4), _hops(4))

# ---- history -------------------------------------------------------------------------------------------
register(
    "history_arr_delay",
    lambda s, d: history.history_arr_delay(_f(s, d)),
    "SELECT node, bucket::VARCHAR AS bucket, round(v, 6) AS arr_delay_mean FROM hist",
)
register(
    "sched_arr_count",
    lambda s, d: history.sched_arr(_f(s, d)).drop("sched_arr_mean_distance"),
    "SELECT node, bucket::VARCHAR AS bucket, n AS sched_arr_count FROM sarr",
)
register(
    "sched_arr_mean_distance",
    lambda s, d: history.sched_arr(_f(s, d)).drop("sched_arr_count"),
    "SELECT node, bucket::VARCHAR AS bucket, round(d, 6) AS sched_arr_mean_distance FROM sarr",
)
register(
    "sched_dep_count",
    lambda s, d: history.sched_dep_count(_f(s, d)),
    "SELECT node, bucket::VARCHAR AS bucket, n AS sched_dep_count FROM sdep",
)
register(
    "sched_arr_from_top10",
    lambda s, d: history.sched_arr_from_top10(_f(s, d)),
    "SELECT node, bucket::VARCHAR AS bucket, n AS sched_arr_from_top10 FROM s10",
)
register(
    "route_arr_delay",
    lambda s, d: history.route_arr_delay(_f(s, d)),
    "SELECT src, dst, bucket::VARCHAR AS bucket, round(v, 6) AS route_arr_delay FROM route",
)
register(
    "route_sched_count",
    lambda s, d: history.route_sched_count(_f(s, d)),
    "SELECT src, dst, bucket::VARCHAR AS bucket, n AS route_sched_count FROM rsched",
)
register(
    "rolling_mean_node",
    lambda s, d: history.rolling_node(history.history_arr_delay(_f(s, d))).select("node", "bucket", "rolling_mean"),
    "SELECT node, bucket::VARCHAR AS bucket, round(rm, 6) AS rolling_mean FROM roll",
)
register(
    "rolling_std_node",
    lambda s, d: history.rolling_node(history.history_arr_delay(_f(s, d))).select("node", "bucket", "rolling_std"),
    "SELECT node, bucket::VARCHAR AS bucket, round(rs, 6) AS rolling_std FROM roll",
)
register(
    "rolling_mean_route",
    lambda s, d: history.rolling_route(history.route_arr_delay(_f(s, d))).select("src", "dst", "bucket", "route_recent_arr_delay"),
    "SELECT src, dst, bucket::VARCHAR AS bucket, round(rm, 6) AS route_recent_arr_delay FROM rroll",
)
_COUNTS = ("sched_arr_count", "sched_dep_count", "sched_arr_from_top10")
register("history_lookups", lambda s, d: history.node_history(_f(s, d)).withColumns({c: F.col(c).cast("double") for c in _COUNTS}), (
    "SELECT node, bucket::VARCHAR AS bucket, round(v, 6) AS arr_delay_mean, round(rm, 6) AS rolling_mean, round(rs, "
    "6) AS rolling_std, a.n::DOUBLE AS sched_arr_count, round(a.d, 6) AS sched_arr_mean_distance, "
    "b.n::DOUBLE AS sched_dep_count, c.n::DOUBLE AS sched_arr_from_top10 FROM roll FULL JOIN sarr a USING (node, bucket) "
    "FULL JOIN sdep b USING (node, bucket) FULL JOIN s10 c USING (node, bucket)"
))
register(
    "series_lookup",
    lambda s, d: (lambda f, g: history.series_lookup(g, history.history_arr_delay(f), "arr_delay_mean", -1))(*_grid(s, d)),
    (
        "SELECT snapshot_ts::VARCHAR AS snapshot_ts, g.node, round(coalesce(v, 0), 6) AS arr_delay_mean FROM grid g LEFT "
        "JOIN hist h ON h.node = g.node AND h.bucket = snapshot_ts - INTERVAL 1 HOUR"
    ),
)
_TS = "* REPLACE (snapshot_ts::VARCHAR AS snapshot_ts)"
register(
    "lag_lookup",
    lambda s, d: (lambda f, g: history.lag_lookup(g, history.history_arr_delay(f)))(*_grid(s, d)),
    f"SELECT {_TS} FROM block_d",
)
register(
    "rolling_lookup",
    lambda s, d: (lambda f, g: history.rolling_lookup(g, history.rolling_node(history.history_arr_delay(f))))(*_grid(s, d)),
    f"SELECT {_TS} FROM block_e",
)
register(
    "horizon_lookup",
    lambda s, d: (lambda f, g: history.horizon_lookup(g, history.node_history(f), H))(*_grid(s, d)),
    f"SELECT {_TS} FROM block_g",
)


def _edge_dynamic(s, d):
    f, _, snaps = P.snapshot_base(s, d)
    return history.edge_dynamic(network.edge_static(f), snaps, history.route_history(f))


_EDGE_DYNAMIC = (
    "SELECT edge_id, e.src, e.dst, s.snapshot_ts::VARCHAR AS snapshot_ts, round(greatest(-1, least(1, coalesce(r.rm, "
    "0) / 60)), 6) + 0.0 AS recent_delay_norm, round(greatest(0, least(1, coalesce(q.n, 0) / 50)), 6) AS sched_next_norm "
    "FROM snaps s CROSS JOIN edges e LEFT JOIN rroll r ON r.src = e.src AND r.dst = e.dst "
    "AND r.bucket = s.snapshot_ts - INTERVAL 1 HOUR LEFT JOIN rsched q ON q.src = e.src AND q.dst = e.dst "
    "AND q.bucket = s.snapshot_ts"
)
register("edge_dynamic_join", _edge_dynamic, _EDGE_DYNAMIC)

# ---- snapshots, features, targets ----------------------------------------------------------------------
register("snapshot_times", lambda s, d: snapshots.snapshot_times(_f(s, d)), "SELECT snapshot_ts::VARCHAR AS snapshot_ts FROM times")
register(
    "dense_grid",
    lambda s, d: (lambda f, n, t: snapshots.dense_grid(n, t, H))(*P.snapshot_base(s, d)),
    "SELECT snapshot_ts::VARCHAR AS snapshot_ts, node, h AS horizon_h FROM grid, hz",
)
register("node_features_basic", lambda s, d: snapshots.node_features_basic(_f(s, d)), (
    "SELECT snapshot_ts::VARCHAR AS snapshot_ts, node, round(coalesce(m, 0), 6) AS dep_mean, round(coalesce(sd, 0), "
    "6) AS dep_std, round(coalesce(sh, 0), 6) AS dep_share, round(CASE WHEN max(coalesce(n, "
    "0)) OVER (PARTITION BY snapshot_ts) > 0 THEN coalesce(n, 0) / max(coalesce(n, 0)) OVER (PARTITION BY snapshot_ts) "
    "ELSE 0 END, 6) AS flights, round(coalesce(am, 0), 6) AS arr_mean, round(coalesce(asd, 0), 6) AS arr_std "
    "FROM (SELECT ts + INTERVAL 1 HOUR AS snapshot_ts, Origin AS node, avg(DepDelay) AS m, stddev_pop(DepDelay) AS sd, "
    "avg((DepDelay > 15)::INT) AS sh, count(*) AS n FROM f GROUP BY ALL) FULL "
    "JOIN (SELECT ts + INTERVAL 1 HOUR AS snapshot_ts, Dest AS node, avg(ArrDelay) AS am, stddev_pop(ArrDelay) AS asd "
    "FROM f GROUP BY ALL) USING (snapshot_ts, node)"
))
register("node_block_A", lambda s, d: snapshots.node_block_a(_f(s, d)), f"SELECT {_TS} FROM block_a")
register("node_block_B", lambda s, d: snapshots.node_block_b(_f(s, d)), f"SELECT {_TS} FROM block_b")
register("node_block_C", lambda s, d: snapshots.node_block_c(_f(s, d)), f"SELECT {_TS} FROM block_c")
register("node_block_F", lambda s, d: snapshots.with_block_f(_grid(s, d)[1]), f"SELECT {_TS} FROM block_f")
register(
    "target_hour_sin",
    lambda s, d: (lambda g: g.select("snapshot_ts", "node", *[snapshots.target_hour_sin(h).alias(f"g{h}_hour_sin") for h in H]))(_grid(s, d)[1]),
    "SELECT snapshot_ts::VARCHAR AS snapshot_ts, node, " + ", ".join(f"round(sin(2 * pi() * hour(snapshot_ts + INTERVAL {(h - 1) * 60 + 30} MINUTE) / 24), 6) + 0.0 AS g{h}_hour_sin" for h in H) + " FROM grid",
)
register(
    "snapshot_max_norm",
    lambda s, d: snapshots.snapshot_max_norm(_f(s, d).groupBy(F.col("timestamp").alias("snapshot_ts"), F.col("Origin").alias("node")).agg(F.count("*").cast("double").alias("n")), ["n"]),
    "SELECT bucket::VARCHAR AS snapshot_ts, node, round(n / max(n) OVER (PARTITION BY bucket), 6) AS n FROM sdep",
)
_FILL = "SELECT g.snapshot_ts::VARCHAR AS snapshot_ts, g.node, " + ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in [*(f"a_{x}" for x in ("arr_mean", "arr_std", "arr_p75", "arr_p90", "share_late", "share_60", "dep_mean", "dep_std", "taxi")), *(f"b_{x}" for x in ("arrivals", "departures", "cancelled", "diverted")), *(f"c_{x}" for x in schema.CAUSES)])
_FILL += (
    ", d.* EXCLUDE (snapshot_ts, node), e.* EXCLUDE (snapshot_ts, node), x.* EXCLUDE (snapshot_ts, node), "
    "y.* EXCLUDE (snapshot_ts, node), "
) + ", ".join(f"round(sin(2 * pi() * hour(g.snapshot_ts + INTERVAL {(h - 1) * 60 + 30} MINUTE) / 24), 6) + 0.0 AS g{h}_hour_sin" for h in H)
_FILL += (
    " FROM grid g LEFT JOIN block_a a USING (snapshot_ts, node) LEFT JOIN block_b b USING (snapshot_ts, node) LEFT "
    "JOIN block_c c USING (snapshot_ts, node) JOIN block_d d USING (snapshot_ts, node) JOIN block_e e USING (snapshot_ts, "
    "node) JOIN block_f x USING (snapshot_ts, node) JOIN block_g y USING (snapshot_ts, node)"
)


def _rich(s, d):
    return snapshots.node_features_rich(*P.snapshot_base(s, d))


register("node_features_rich", _rich, _FILL)


def _rich_weather(s, d):
    f, nodes, snaps = P.snapshot_base(s, d)
    block = weather.weather_block(adapters.weather_from_events(s, d), snapshots.dense_grid(nodes, snaps), H, tie="event_id")
    return snapshots.node_features_rich(f, nodes, snaps, weather_block=block)


def _weather_columns(t: str, prefix: str, names: tuple[str, str, str, str]) -> str:
    values = [f"coalesce({t}.{v}, 0.0) AS {prefix}{n}" for v, n in zip(("wind", "gust", "precip", "cloud"), names, strict=True)]
    return ", ".join(values + [f"coalesce(({t}.cat = {i})::INT, 0)::DOUBLE AS {prefix}cat_{i}" for i in range(5)])


_WX = _weather_columns("w", "h_", ("wind_mean", "gust_max", "precip_sum", "cloud_mean"))
_WX += "".join(", " + _weather_columns(f"z{h}", f"h{h}_wx_obs_", ("wind", "gust", "precip", "cloud")) for h in H)
_WX_JOINS = "LEFT JOIN wxh w ON w.iata = r.node AND w.ts = r.snapshot_ts::TIMESTAMP - INTERVAL 1 HOUR "
_WX_JOINS += " ".join(f"LEFT JOIN wxh z{h} ON z{h}.iata = r.node AND z{h}.ts = r.snapshot_ts::TIMESTAMP + INTERVAL {h - 1} HOUR" for h in H)
register("node_features_weather", _rich_weather, f"SELECT r.*, {_WX} FROM ({_FILL}) r {_WX_JOINS}")
register("target_interval_join", lambda s, d: (lambda f, n, t: snapshots.node_targets(f, n, t, (4,)))(*P.snapshot_base(s, d)), (
    "SELECT snapshot_ts::VARCHAR AS snapshot_ts, node, horizon_h, round(arr, 6) AS arr, round(dep, 6) AS dep, round(pct, "
    "6) AS pct FROM targets WHERE horizon_h = 4"
))
register(
    "node_targets",
    lambda s, d: (lambda f, n, t: snapshots.node_targets(f, n, t, (1,)).select("snapshot_ts", "node", "arr"))(*P.snapshot_base(s, d)),
    "SELECT snapshot_ts::VARCHAR AS snapshot_ts, node, round(arr, 6) AS arr FROM targets WHERE horizon_h = 1",
)
register("node_targets_multi", lambda s, d: (lambda f, n, t: snapshots.node_targets(f, n, t, (1,)))(*P.snapshot_base(s, d)), (
    "SELECT snapshot_ts::VARCHAR AS snapshot_ts, node, horizon_h, round(arr, 6) AS arr, round(dep, 6) AS dep, round(pct, "
    "6) AS pct FROM targets WHERE horizon_h = 1"
))
register("multi_horizon_targets", lambda s, d: (lambda f, n, t: snapshots.node_targets(f, n, t))(*P.snapshot_base(s, d)), (
    "SELECT snapshot_ts::VARCHAR AS snapshot_ts, node, horizon_h, round(arr, 6) AS arr, round(dep, 6) AS dep, round(pct, "
    "6) AS pct FROM targets"
))


def _create_snapshots(s, d):
    """Features and targets of all snapshots side by side, targets of each horizon as columns."""
    f, nodes = P.prepared(s, d)
    x, y, _ = snapshots.create_snapshots(f, nodes, min_rows=P.MIN_ROWS)
    wide = y.groupBy("snapshot_ts", "node").agg(*[F.max(F.when(F.col("horizon_h") == h, F.col(v))).alias(f"y{h}_{v}") for h in H for v in ("arr", "dep", "pct")])
    return x.join(wide, ["snapshot_ts", "node"])


def _snapshot_edges(s, d):
    return snapshots.create_snapshots(*P.prepared(s, d), min_rows=P.MIN_ROWS)[2]


_WIDE_Y = ", ".join(f"round(max({v}) FILTER (horizon_h = {h}), 6) AS y{h}_{v}" for h in H for v in ("arr", "dep", "pct"))
register("create_snapshots", _create_snapshots, f"""
    SELECT x.*, TRUE AS active, y.* EXCLUDE (snapshot_ts, node) FROM ({_FILL}) x
    JOIN (SELECT snapshot_ts::VARCHAR AS snapshot_ts, node, {_WIDE_Y} FROM targets GROUP BY ALL) y USING (snapshot_ts, node)""")
_EDGE_STATIC = "round(e.count_norm, 6) AS count_norm, round(e.air_time_norm, 6) AS air_time_norm, round(e.distance_norm, 6) AS distance_norm"
register("snapshot_edges", _snapshot_edges, _EDGE_DYNAMIC.replace(" FROM snaps s", f", {_EDGE_STATIC} FROM snaps s"))
_VALUES = ["dep_mean", "dep_share", "flights", "arr_mean"]
_BASIC = (
    "(SELECT snapshot_ts, node, coalesce(m, 0) AS dep_mean, coalesce(sh, 0) AS dep_share, coalesce(n, 0) / max(coalesce(n, "
    "0)) OVER (PARTITION BY snapshot_ts) AS flights, coalesce(am, 0) AS arr_mean "
    "FROM (SELECT ts + INTERVAL 1 HOUR AS snapshot_ts, Origin AS node, avg(DepDelay) AS m, "
    "avg((DepDelay > 15)::INT) AS sh, count(*) AS n FROM f GROUP BY ALL) FULL "
    "JOIN (SELECT ts + INTERVAL 1 HOUR AS snapshot_ts, Dest AS node, avg(ArrDelay) AS am FROM f "
    "GROUP BY ALL) USING (snapshot_ts, node))"
)
register(
    "active_mask",
    lambda s, d: snapshots.active_nodes(snapshots.node_features_basic(_f(s, d)), _VALUES).select("snapshot_ts", "node", "active"),
    (
        f"SELECT snapshot_ts::VARCHAR AS snapshot_ts, node, "
        f"abs(dep_mean) + abs(dep_share) + abs(flights) + abs(arr_mean) > 0 AS active FROM {_BASIC}"
    ),
)
register(
    "feature_stats",
    lambda s, d: snapshots.feature_stats(snapshots.node_features_basic(_f(s, d)), _VALUES),
    " UNION ALL ".join(f"SELECT '{v}' AS feature, round(avg({v}), 6) AS mean, round(greatest(stddev_samp({v}), 1e-6), 6) AS std FROM {_BASIC}" for v in _VALUES),
)


def _train_stats(s, d):
    """Statistics of the active rows of the first 70 % of the snapshots."""
    f, _, snaps = P.snapshot_base(s, d)
    x = snapshots.active_nodes(snapshots.node_features_basic(f), _VALUES).join(snapshots.split_by_ratio(snaps), "snapshot_ts")
    return snapshots.feature_stats(x, _VALUES, F.col("split") == "train")


register(
    "feature_stats_train",
    _train_stats,
    " UNION ALL ".join(
        f"SELECT '{v}' AS feature, round(avg({v}), 6) AS mean, round(greatest(stddev_samp({v}), 1e-6), 6) AS std FROM {_BASIC} b "
        "JOIN split s ON s.snapshot_ts = b.snapshot_ts AND s.split = 'train' WHERE abs(dep_mean) + abs(dep_share) + abs(flights) + abs(arr_mean) > 0"
        for v in _VALUES
    ),
)
register(
    "normalize_features",
    lambda s, d: (lambda x: snapshots.normalize_features(x, snapshots.feature_stats(x, _VALUES), _VALUES))(snapshots.node_features_basic(_f(s, d)).select("snapshot_ts", "node", *_VALUES)),
    "SELECT snapshot_ts::VARCHAR AS snapshot_ts, node, " + ", ".join(f"round(({v} - avg({v}) OVER ()) / greatest(stddev_samp({v}) OVER (), 1e-6), 6) + 0.0 AS {v}" for v in _VALUES) + f" FROM {_BASIC}",
)
register("split_by_ratio", lambda s, d: snapshots.split_by_ratio(P.snapshot_base(s, d)[2]), (
    "SELECT snapshot_ts::VARCHAR AS snapshot_ts, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' "
    "WHEN r <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM (SELECT snapshot_ts, "
    "row_number() OVER (ORDER BY snapshot_ts) AS r, count(*) OVER () AS n FROM snaps)"
))
register("split_by_date", lambda s, d: snapshots.split_by_date(P.snapshot_base(s, d)[2], "2019-09-25", "2019-10-01"), (
    "SELECT snapshot_ts::VARCHAR AS snapshot_ts, CASE WHEN snapshot_ts < '2019-09-25' THEN 'train' "
    "WHEN snapshot_ts < '2019-10-01' THEN 'val' ELSE 'test' END AS split FROM snaps"
))
register(
    "split_by_month",
    lambda s, d: snapshots.split_by_month(P.flights(s, d), [9], [10], []).groupBy("split", "Month").agg(F.count("*").alias("n")),
    "SELECT CASE Month WHEN 9 THEN 'train' ELSE 'val' END AS split, Month, count(*) AS n FROM flights GROUP BY ALL",
)
register(
    "sliding_sequences",
    lambda s, d: snapshots.sliding_sequences(P.snapshot_base(s, d)[2]).select("target_ts", F.col("members")[0].alias("first_ts"), F.size("members").alias("n")),
    (
        "SELECT snapshot_ts::VARCHAR AS target_ts, lo::VARCHAR AS first_ts, 6 AS n FROM (SELECT snapshot_ts, lag(snapshot_ts, "
        "5) OVER (ORDER BY snapshot_ts) AS lo FROM snaps) WHERE lo IS NOT NULL"
    ),
)
register(
    "last_n_snapshots",
    lambda s, d: snapshots.last_n_snapshots(P.snapshot_base(s, d)[2]),
    "SELECT snapshot_ts::VARCHAR AS snapshot_ts FROM snaps ORDER BY snaps.snapshot_ts DESC LIMIT 6",
)

# ---- weather -------------------------------------------------------------------------------------------
register(
    "dedup_first_per_hour",
    lambda s, d: P.weather_hourly(s, d).select("iata", "timestamp", "event_id", "weather_category"),
    "SELECT iata, ts::VARCHAR AS timestamp, event_id, cat AS weather_category FROM wxh",
)
register("weather_window_agg", lambda s, d: weather.weather_window_agg(adapters.weather_from_events(s, d), 2), (
    "SELECT b::VARCHAR AS snapshot_ts, iata AS node, round(w, 6) AS h_wind_mean, g AS h_gust_max, p AS h_precip_sum, "
    "round(c, 6) AS h_cloud_mean, "
) + ", ".join(f"(k = {i})::INT::DOUBLE AS h_cat_{i}" for i in range(5)) + (
    " FROM (SELECT b, iata, avg(wind) AS w, max(gust) AS g, sum(precip) AS p, avg(cloud) AS c FROM (SELECT *, "
    "time_bucket(INTERVAL 2 HOUR, ts) + INTERVAL 2 HOUR AS b FROM wx) GROUP BY ALL) JOIN (SELECT b, iata, arg_max(cat, "
    "n * 100 - cat) AS k FROM (SELECT time_bucket(INTERVAL 2 HOUR, ts) + INTERVAL 2 HOUR AS b, iata, cat, count(*) AS n "
    "FROM wx GROUP BY ALL) GROUP BY ALL) USING (b, iata)"
))
register(
    "weather_window_join",
    lambda s, d: _grid(s, d)[1].join(weather.weather_window_agg(P.weather_hourly(s, d)), ["snapshot_ts", "node"], "left").na.fill(0.0).select("snapshot_ts", "node", "h_wind_mean", "h_precip_sum"),
    (
        "SELECT snapshot_ts::VARCHAR AS snapshot_ts, node, coalesce(wind, 0.0) AS h_wind_mean, coalesce(precip, "
        "0.0) AS h_precip_sum FROM grid LEFT JOIN wxh ON iata = node AND ts = snapshot_ts - INTERVAL 1 HOUR"
    ),
)
register(
    "weather_point_join",
    lambda s, d: weather.weather_point(P.weather_hourly(s, d), _grid(s, d)[1], H).select("snapshot_ts", "node", "horizon_h", "wx_obs_wind", "wx_obs_cat_4"),
    (
        "SELECT snapshot_ts::VARCHAR AS snapshot_ts, node, h AS horizon_h, coalesce(wind, 0.0) AS wx_obs_wind, "
        "coalesce((cat = 4)::INT, 0)::DOUBLE AS wx_obs_cat_4 FROM (SELECT * FROM grid, hz) LEFT JOIN wxh ON iata = node "
        "AND ts = date_trunc('hour', snapshot_ts + to_hours(h - 1) + INTERVAL 30 MINUTE)"
    ),
)
register(
    "weather_toggle",
    lambda s, d: weather.weather_window_agg(P.weather_hourly(s, d), 1, ["wind_gust"]).select("snapshot_ts", "node", "h_wind_mean", "h_precip_sum", "h_cat_0"),
    (
        "SELECT (ts + INTERVAL 1 HOUR)::VARCHAR AS snapshot_ts, iata AS node, wind AS h_wind_mean, "
        "0.0::DOUBLE AS h_precip_sum, 0.0::DOUBLE AS h_cat_0 FROM wxh"
    ),
)
register(
    "wmo_bucket",
    lambda s, d: s.range(100).select(F.col("id").alias("code"), wmo_category(F.col("id")).alias("category")).join(adapters.weather_from_events(s, d).groupBy(F.col("weather_code").cast("long").alias("code")).agg(F.count("*").alias("n")), "code"),
    "SELECT code::BIGINT AS code, cat AS category, count(*) AS n FROM wx GROUP BY ALL",
)
register(
    "one_hot",
    lambda s, d: (lambda w: w.select("event_id", *[c.alias(f"k{i}") for i, c in enumerate(one_hot(F.col("weather_category")))]))(adapters.weather_from_events(s, d)),
    "SELECT event_id, " + ", ".join(f"(cat = {i})::INT::DOUBLE AS k{i}" for i in range(5)) + " FROM wx",
)

# ---- scalar functions ----------------------------------------------------------------------------------
register(
    "cyclic_encode",
    lambda s, d: P.flights(s, d).select(*FLIGHT_KEYS, *[c.alias(n) for n, c in zip(("s", "c"), cyclic(F.col("CRSDepTime"), 2400), strict=True)]),
    (
        "SELECT l_orderkey, l_linenumber, round(sin(2 * pi() * CRSDepTime / 2400), 6) + 0.0 AS s, "
        "round(cos(2 * pi() * CRSDepTime / 2400), 6) + 0.0 AS c FROM flights"
    ),
)
register(
    "floor_bucket",
    lambda s, d: adapters.read(s, d, "events").select("event_id", floor_bucket(F.col("ts").cast("timestamp_ntz"), 2).alias("b2")),
    "SELECT event_id, time_bucket(INTERVAL 2 HOUR, ts::TIMESTAMP)::VARCHAR AS b2 FROM events",
)
register(
    "sigmoid",
    lambda s, d: P.flights(s, d).select(*FLIGHT_KEYS, sigmoid((F.col("ArrDelay") - 15) / 10).alias("p")),
    "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(ArrDelay - 15) / 10)), 6) AS p FROM flights",
)
register(
    "clamp",
    lambda s, d: P.flights(s, d).select(*FLIGHT_KEYS, zero_if_missing(F.col("ArrDelay") / F.nullif(F.col("DepDelay"), F.lit(0))).alias("z"), F.when(F.col("ArrDelay").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(23.0), F.col("ArrDelay")))).alias("c")),
    (
        "SELECT l_orderkey, l_linenumber, round(coalesce(ArrDelay / nullif(DepDelay, 0), 0), 6) + 0.0 AS z, CASE "
        "WHEN ArrDelay IS NOT NULL THEN greatest(0, least(23, ArrDelay)) END AS c FROM flights"
    ),
)
_RATIO = "ArrDelay / DepDelay"
register(
    "nan_to_zero",
    lambda s, d: P.flights(s, d).select(*FLIGHT_KEYS, nan_to_zero(F.when(F.col("DepDelay") == 0, float("nan")).otherwise(F.expr(f"try_divide(ArrDelay, DepDelay)"))).alias("z")),
    f"SELECT l_orderkey, l_linenumber, round(CASE WHEN DepDelay = 0 THEN 0 ELSE {_RATIO} END, 6) + 0.0 AS z FROM flights",
)
register(
    "inf_to_zero",
    lambda s, d: P.flights(s, d).select(*FLIGHT_KEYS, inf_to_zero(F.when(F.col("DepDelay") == 0, float("-inf")).otherwise(F.expr(f"try_divide(ArrDelay, DepDelay)"))).alias("z")),
    f"SELECT l_orderkey, l_linenumber, round(CASE WHEN DepDelay = 0 THEN 0 ELSE {_RATIO} END, 6) + 0.0 AS z FROM flights",
)
register(
    "string_date_helpers",
    lambda s, d: adapters.read(s, d, "events").select(
        "event_id", clean_code(F.concat(F.lit(" a"), F.col("user_id").cast("string"), F.lit(" "))).alias("code"),
        parse_iso(F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).alias("at"), two_digits(F.hour(F.col("ts").cast("timestamp_ntz"))).alias("hh"),
    ),
(
        "SELECT event_id, 'A' || user_id AS code, date_trunc('second', ts::TIMESTAMP)::TIMESTAMP::VARCHAR AS at, "
        "lpad(hour(ts::TIMESTAMP)::VARCHAR, 2, '0') AS hh FROM events"
    ),
)
register(
    "temporal_features",
    lambda s, d: tabular.temporal_features(cleaning.encode_time(P.flights(s, d))).select(*FLIGHT_KEYS, "day_of_week", "is_weekend", "hour_sin", "dow_cos"),
    (
        "SELECT l_orderkey, l_linenumber, DayOfWeek AS day_of_week, (DayOfWeek >= 5)::INT AS is_weekend, "
        "round(sin(2 * pi() * hh / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * DayOfWeek / 7), 6) + 0.0 AS dow_cos "
        "FROM flights"
    ),
)
register(
    "label_encode",
    lambda s, d: (lambda f: tabular.label_encode(f.select(*FLIGHT_KEYS, "Origin", "Month"), "Origin", tabular.fit_label_encoder(f.where("Origin > 'A04'"), "Origin")).drop("Month"))(P.flights(s, d)),
    (
        "SELECT l_orderkey, l_linenumber, f1.Origin, coalesce(e.code, -1)::INT AS Origin_encoded FROM flights f1 LEFT "
        "JOIN (SELECT Origin, row_number() OVER (ORDER BY Origin) - 1 AS code FROM (SELECT DISTINCT Origin FROM flights "
        "WHERE Origin > 'A04')) e ON e.Origin = f1.Origin"
    ),
)
register(
    "standard_scale",
    lambda s, d: (lambda f: tabular.standard_scale(f, ["Distance", "TaxiOut"], tabular.fit_standard_scaler(f, ["Distance", "TaxiOut"])))(P.flights(s, d).select(*FLIGHT_KEYS, "Distance", "TaxiOut")),
    (
        "SELECT l_orderkey, l_linenumber, round((Distance - avg(Distance) OVER ()) / stddev_pop(Distance) OVER (), "
        "6) + 0.0 AS Distance, round((TaxiOut - avg(TaxiOut) OVER ()) / stddev_pop(TaxiOut) OVER (), 6) + 0.0 AS TaxiOut "
        "FROM flights"
    ),
)
register(
    "feature_matrix",
    lambda s, d: tabular.feature_matrix(cleaning.encode_time(P.flights(s, d)), ["Airline"], ["Distance"])[0].select(*FLIGHT_KEYS, "Airline_encoded", "Distance", "hour_cos"),
    (
        "SELECT l_orderkey, l_linenumber, (dense_rank() OVER (ORDER BY Airline) - 1)::INT AS Airline_encoded, "
        "round((Distance - avg(Distance) OVER ()) / stddev_pop(Distance) OVER (), 6) + 0.0 AS Distance, "
        "round(cos(2 * pi() * hh / 24), 6) + 0.0 AS hour_cos FROM flights"
    ),
)
register(
    "tabular_regressor",
    lambda s, d: tabular.tabular_regressor(tabular.temporal_features(cleaning.encode_time(cleaning.clean_flights(P.flights(s, d)))), ["Distance", "TaxiOut", "hour_sin", "hour_cos"], train=F.col("FlightDate") < "2019-10-01").select(*FLIGHT_KEYS, "ArrDelay", F.round("prediction", 3).alias("prediction")),
)



def _boosted(s, d):
    rows = tabular.temporal_features(cleaning.encode_time(cleaning.clean_flights(P.flights(s, d))))
    names = ["Distance", "TaxiOut", "hour_sin", "hour_cos", "TaxiIn", "DepDelay"]
    model = trees.fit_trees(rows.where(F.col("FlightDate") < "2019-10-01"), names, "ArrDelay")
    return model.predict(rows).select(*FLIGHT_KEYS, "ArrDelay", F.round("prediction", 3).alias("prediction"))


register("tabular_regressor_trees", _boosted)


def _stump(s, d):
    """One tree of one split without shrinkage: the best cut of a feature of seven values, which SQL can find by trying all."""
    rows = cleaning.clean_flights(P.flights(s, d))
    model = trees.fit_trees(rows, ["TaxiIn"], "ArrDelay", trees=1, depth=1, bins=64, rate=1.0, ridge=0.0, least=1)
    return model.predict(rows).select(*FLIGHT_KEYS, F.round("prediction", 3).alias("prediction"))


register("tabular_regressor_stump", _stump, """
    SELECT * FROM (WITH cut AS (SELECT a.TaxiIn AS edge, avg(b.ArrDelay) FILTER (b.TaxiIn <= a.TaxiIn) AS lo, avg(b.ArrDelay) FILTER (b.TaxiIn > a.TaxiIn) AS hi,
        sum(b.ArrDelay) FILTER (b.TaxiIn <= a.TaxiIn) ** 2 / count(*) FILTER (b.TaxiIn <= a.TaxiIn)
        + sum(b.ArrDelay) FILTER (b.TaxiIn > a.TaxiIn) ** 2 / count(*) FILTER (b.TaxiIn > a.TaxiIn) AS gain
      FROM (SELECT DISTINCT TaxiIn FROM clean) a, clean b GROUP BY 1 HAVING count(*) FILTER (b.TaxiIn > a.TaxiIn) > 0),
    best AS (SELECT * FROM cut ORDER BY gain DESC, edge LIMIT 1)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN TaxiIn <= edge THEN lo ELSE hi END, 3) + 0.0 AS prediction FROM clean, best)""")

_LINE = "regr_slope(ArrDelay, Distance) OVER () * Distance + regr_intercept(ArrDelay, Distance) OVER ()"
register(
    "tabular_regressor_line",
    lambda s, d: tabular.tabular_regressor(cleaning.clean_flights(P.flights(s, d)), ["Distance"], ridge=0.0).select(*FLIGHT_KEYS, F.round("prediction", 3).alias("prediction")),
    f"SELECT l_orderkey, l_linenumber, round({_LINE}, 3) AS prediction FROM clean",
)

# ---- star schema and reports ---------------------------------------------------------------------------
_FACT_COLS = "airport_code, ts_hour::VARCHAR AS ts_hour"
register("fact_departures", lambda s, d: star.fact_departures(P.report_frame(s, d)), (
    f"SELECT {_FACT_COLS}, sched_dep, dep_operated, dep_cancelled, round(dep_delay_mean, 6) AS dep_delay_mean, dep_del15 "
    f"FROM fdep"
))
register("fact_arrivals", lambda s, d: star.fact_arrivals(P.report_frame(s, d)), (
    f"SELECT {_FACT_COLS}, sched_arr, arr_operated, arr_cancelled, round(arr_delay_mean, 6) AS arr_delay_mean, "
    f"arr_delay_median, arr_del15 FROM farr"
))
register(
    "join_arr_dep",
    lambda s, d: (lambda f: star.join_arr_dep(star.fact_arrivals(f), star.fact_departures(f)).select("airport_code", "ts_hour", "sched_arr", "sched_dep"))(P.report_frame(s, d)),
    f"SELECT {_FACT_COLS}, sched_arr, sched_dep FROM fad",
)
_FACT = (
    f"SELECT {_FACT_COLS}, sched_arr, arr_operated, arr_cancelled, round(arr_delay_mean, 6) AS arr_delay_mean, "
    f"arr_delay_median, arr_del15, sched_dep, dep_operated, dep_cancelled, round(dep_delay_mean, 6) AS dep_delay_mean, "
    f"dep_del15, date::VARCHAR AS date, hour, day_of_week, month, year, est_arr_passengers, est_dep_passengers FROM fact"
)
register("fact_airport_hour", P.fact, _FACT)
register(
    "order_fact",
    lambda s, d: star.order_fact(P.fact(s, d)).select("airport_code", "ts_hour", "sched_arr"),
    f"SELECT {_FACT_COLS}, sched_arr FROM fact ORDER BY fact.airport_code, fact.ts_hour",
)
register("agg_baseline_volume", lambda s, d: star.agg_baseline_volume(P.fact(s, d)), (
    "SELECT airport_code, day_of_week, hour, round(baseline_sched_arr, 6) AS baseline_sched_arr, round(baseline_sched_dep, "
    "6) AS baseline_sched_dep, round(baseline_arr_delay_mean, 6) AS baseline_arr_delay_mean, n_observations, ['Mon', "
    "'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][day_of_week + 1] AS day_name FROM baseline"
))
register("agg_airline", lambda s, d: star.agg_airline(P.report_frame(s, d)), _AIRLINE)
_ROUTE = (
    "SELECT Origin, Dest, count(*) AS flights, round(avg(ArrDelay), 6) AS arr_delay_mean, round(avg(ArrDel15), "
    "6) AS arr_del15_rate, round(avg(Distance), 6) AS mean_distance FROM rf WHERE NOT Cancelled GROUP BY ALL"
)
register("agg_route", lambda s, d: star.agg_route(P.report_frame(s, d)), _ROUTE)
register(
    "order_route",
    lambda s, d: star.order_route(star.agg_route(P.report_frame(s, d))),
    _ROUTE + " ORDER BY flights DESC, Origin, Dest",
)
register("agg_distance_bucket", lambda s, d: star.agg_distance_bucket(P.report_frame(s, d)), (
    "SELECT CASE WHEN Distance < 250 THEN '0-250' WHEN Distance < 500 THEN '250-500' WHEN Distance < 750 THEN '500-750' "
    "WHEN Distance < 1000 THEN '750-1000' WHEN Distance < 1500 THEN '1000-1500' WHEN Distance < 2000 THEN '1500-2000' "
    "ELSE '2000+' END AS distance_bucket, count(*) AS flights, round(avg(ArrDelay), 6) AS arr_delay_mean, "
    "round(avg(ArrDel15), 6) AS arr_del15_rate FROM rf WHERE NOT Cancelled GROUP BY ALL"
))
register("dim_airport", lambda s, d: star.dim_airport(P.airports(s, d), P.prepared(s, d)[1]), (
    "SELECT airport_code, name, latitude, longitude, elevation_m FROM airports WHERE airport_code IN (SELECT code "
    "FROM nodes)"
))
register("dim_date", lambda s, d: star.dim_date(P.flights(s, d).agg(F.min("FlightDate").alias("d0"), F.max("FlightDate").alias("d1"))), (
    "SELECT date::DATE::VARCHAR AS date, year(date)::INT AS year, month(date)::INT AS month, strftime(date, "
    "'%b') AS month_name, day(date)::INT AS day, (isodow(date) - 1)::INT AS day_of_week, ['Mon', 'Tue', 'Wed', 'Thu', "
    "'Fri', 'Sat', 'Sun'][isodow(date)] AS day_name, isodow(date) >= 6 AS is_weekend, quarter(date)::INT AS quarter, "
    "weekofyear(date)::INT AS week_of_year, CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' "
    "WHEN month(date) <= 5 THEN 'Spring' WHEN month(date) <= 8 THEN 'Summer' ELSE 'Fall' END AS season "
    "FROM (SELECT unnest(generate_series((SELECT min(FlightDate) FROM flights)::TIMESTAMP, (SELECT max(FlightDate) "
    "FROM flights)::TIMESTAMP, INTERVAL 1 DAY)) AS date)"
))
register(
    "dim_hour",
    lambda s, d: star.dim_hour(s).join(P.fact(s, d).groupBy("hour").agg(F.sum("sched_arr").alias("flights")), "hour", "left"),
    (
        "SELECT x::INT AS hour, lpad(x::VARCHAR, 2, '0') || ':00' AS hour_label, CASE WHEN x < 6 THEN 'Night' "
        "WHEN x < 12 THEN 'Morning' WHEN x < 18 THEN 'Afternoon' ELSE 'Evening' END AS part_of_day, s.flights "
        "FROM range(24) t(x) LEFT JOIN (SELECT hour, sum(sched_arr)::BIGINT AS flights FROM fact GROUP BY ALL) s ON s.hour = x"
    ),
)
_W = "round(sum(arr_delay_mean * arr_operated) / nullif(sum(arr_operated), 0), 6) AS avg_arr_delay"
register("kpi_measures", lambda s, d: star.kpi_measures(P.fact(s, d), ["month"]), (
    f"SELECT month, sum(sched_arr)::BIGINT AS total_flights, sum(arr_operated)::BIGINT AS operated, "
    f"sum(arr_cancelled)::BIGINT AS cancelled, round(sum(arr_cancelled) / sum(sched_arr), 6) AS cancellation_pct, {_W}, "
    f"round(sum(dep_delay_mean * dep_operated) / nullif(sum(dep_operated), 0), 6) AS avg_dep_delay, "
    f"sum(arr_del15)::BIGINT AS delayed_15, round(sum(arr_del15) / sum(arr_operated), 6) AS delayed_15_pct, round(1 - "
    f"sum(arr_del15) / sum(arr_operated), 6) AS on_time_pct, sum(est_arr_passengers)::BIGINT AS est_passengers FROM fact "
    f"GROUP BY ALL"
))
register("delay_heatmap", lambda s, d: star.delay_heatmap(P.fact(s, d)), "SELECT hour, " + ", ".join((
    f"round(sum(arr_delay_mean * arr_operated) FILTER (day_of_week = {i}) / nullif(sum(arr_operated) FILTER (day_of_week = {i}), "
    f"0), 6) AS {n}"
) for i, n in enumerate(star.DAYS)) + " FROM fact GROUP BY ALL")
_SEASON = "CASE WHEN {0} IN (12, 1, 2) THEN 'Winter' WHEN {0} <= 5 THEN 'Spring' WHEN {0} <= 8 THEN 'Summer' ELSE 'Fall' END"
register(
    "delay_by_month_season",
    lambda s, d: star.delay_by_month_season(P.fact(s, d), star.dim_date(P.fact(s, d).agg(F.min("date").alias("d0"), F.max("date").alias("d1")))),
    (
        f"SELECT year, month, {_SEASON.format('month')} AS season, sum(sched_arr)::BIGINT AS flights, {_W} FROM fact "
        f"GROUP BY ALL"
    ),
)
register(
    "season",
    lambda s, d: P.flights(s, d).groupBy(season(F.col("Month")).alias("season")).agg(F.count("*").alias("n")),
    f"SELECT {_SEASON.format('Month')} AS season, count(*) AS n FROM flights GROUP BY ALL",
)
register(
    "monthly_trend",
    lambda s, d: star.trend(P.fact(s, d)),
    f"SELECT date::VARCHAR AS date, sum(sched_arr)::BIGINT AS flights, {_W} FROM fact GROUP BY fact.date",
)
_SUMMARY = (
    f"SELECT airport_code, total_flights, avg_arr_delay, latitude, longitude FROM (SELECT airport_code, "
    f"sum(sched_arr)::BIGINT AS total_flights, {_W} FROM fact GROUP BY ALL) LEFT JOIN airports USING (airport_code)"
)
_dim = lambda s, d: P.airports(s, d).withColumnRenamed("iata", "airport_code")
register("airport_summary", lambda s, d: star.airport_summary(P.fact(s, d), _dim(s, d)), _SUMMARY)
register(
    "top_airports_by_delay",
    lambda s, d: star.top_airports_by_delay(star.airport_summary(P.fact(s, d), _dim(s, d)), 10),
    _SUMMARY + " ORDER BY avg_arr_delay DESC, airport_code LIMIT 10",
)

# ---- predictions ---------------------------------------------------------------------------------------
_ACT = "round(actual_arr_delay_min, 6) AS actual_arr_delay_min, actual_arr_del15, round(pct_target, 6) AS pct_target"
register(
    "persistence_scorer",
    lambda s, d: P.predicted(s, d).select("airport_code", "prediction_ts", "horizon_h", "predicted_arr_delay_min"),
    (
        "SELECT airport_code, prediction_ts::VARCHAR AS prediction_ts, horizon_h, round(predicted_arr_delay_min, "
        "6) + 0.0 AS predicted_arr_delay_min FROM preds"
    ),
)
register("assemble_predictions", lambda s, d: P.predicted(s, d).select(*predictions.PREDICTION_COLUMNS), f"SELECT {_PRED} FROM preds")
register("target_ts", lambda s, d: P.predicted(s, d).select("airport_code", "prediction_ts", "horizon_h", "target_ts"), (
    "SELECT airport_code, prediction_ts::VARCHAR AS prediction_ts, horizon_h, "
    "(prediction_ts + to_hours(horizon_h))::VARCHAR AS target_ts FROM preds"
))
register("align_actuals", P.predicted, f"SELECT {_PRED}, {_ACT} FROM preds")


def _score(s, d):
    f, nodes, snaps = P.snapshot_base(s, d)
    x = history.series_lookup(snapshots.dense_grid(nodes, snaps), history.history_arr_delay(f), "arr_delay_mean", -1, "x")
    return predictions.score_sequences(snapshots.sliding_sequences(snaps), x, predictions.mean_scorer).drop("logit")


register("score_sequences", _score, (
    "SELECT snapshot_ts::VARCHAR AS snapshot_ts, node, 1 AS horizon_h, round(delay, 6) + 0.0 AS delay "
    "FROM (SELECT g.snapshot_ts, g.node, avg(coalesce(v, 0)) OVER w AS delay, count(*) OVER w AS n FROM grid g LEFT "
    "JOIN hist h ON h.node = g.node AND h.bucket = g.snapshot_ts - INTERVAL 1 HOUR WINDOW w AS (PARTITION BY g.node "
    "ORDER BY g.snapshot_ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) WHERE n = 6"
))
_ENR = "airport_code, prediction_ts::VARCHAR AS prediction_ts, horizon_h"
register(
    "join_pred_schedule",
    lambda s, d: predictions.join_pred_schedule(P.predicted(s, d), P.fact(s, d)).select("airport_code", "prediction_ts", "horizon_h", "sched_arr", "sched_dep"),
    f"SELECT {_ENR}, sched_arr, sched_dep FROM enr",
)
register(
    "join_pred_baseline",
    lambda s, d: predictions.join_pred_baseline(P.predicted(s, d), star.agg_baseline_volume(P.fact(s, d))).select("airport_code", "prediction_ts", "horizon_h", "dow", "hour", "baseline_sched_arr"),
    f"SELECT {_ENR}, dow, hour, round(baseline_sched_arr, 6) AS baseline_sched_arr FROM enr",
)
register(
    "expected_delayed_flights",
    lambda s, d: P.enriched(s, d).select("airport_code", "prediction_ts", "horizon_h", "expected_delayed_flights"),
    f"SELECT {_ENR}, round(expected_delayed_flights, 6) AS expected_delayed_flights FROM enr",
)
register(
    "traffic_vs_usual",
    lambda s, d: P.enriched(s, d).select("airport_code", "prediction_ts", "horizon_h", "traffic_vs_usual"),
    f"SELECT {_ENR}, round(traffic_vs_usual, 6) + 0.0 AS traffic_vs_usual FROM enr",
)
register(
    "enrich_predictions",
    lambda s, d: P.enriched(s, d).select("airport_code", "prediction_ts", "horizon_h", "sched_arr", "sched_dep", "baseline_sched_arr", "expected_delayed_flights", "traffic_vs_usual"),
    (
        f"SELECT {_ENR}, sched_arr, sched_dep, round(baseline_sched_arr, 6) AS baseline_sched_arr, "
        f"round(expected_delayed_flights, 6) AS expected_delayed_flights, round(traffic_vs_usual, 6) + 0.0 AS traffic_vs_usual "
        f"FROM enr"
    ),
)
register(
    "hourly_schedule_counts",
    lambda s, d: predictions.hourly_schedule_counts(_f(s, d), "Dest", "arr_timestamp"),
    "SELECT node AS airport_code, bucket::VARCHAR AS ts_hour, n FROM sarr",
)
register(
    "join_pred_live_counts",
    lambda s, d: predictions.join_pred_live_counts(P.predicted(s, d), _f(s, d)).select("airport_code", "prediction_ts", "horizon_h", "sched_arr_count", "sched_dep_count"),
    (
        "SELECT airport_code, prediction_ts::VARCHAR AS prediction_ts, horizon_h, coalesce(a.n, 0) AS sched_arr_count, "
        "coalesce(b.n, 0) AS sched_dep_count FROM preds LEFT JOIN sarr a ON a.node = airport_code AND a.bucket = target_ts "
        "LEFT JOIN sdep b ON b.node = airport_code AND b.bucket = target_ts"
    ),
)
register("latest_per_key", lambda s, d: predictions.latest_per_key(P.predicted(s, d)).select(*predictions.PREDICTION_COLUMNS), (
    f"SELECT {_PRED} FROM preds p WHERE p.prediction_ts = (SELECT max(q.prediction_ts) FROM preds q "
    f"WHERE q.airport_code = p.airport_code AND q.horizon_h = p.horizon_h)"
))
_LOOKUP = (
    "SELECT airport_code, horizon_h, round(predicted_arr_delay_min, 1) AS predicted_arr_delay_min, "
    "round(pct_arr_delayed_15, 3) AS pct_arr_delayed_15, target_ts::VARCHAR AS target_ts, "
    "prediction_ts::VARCHAR AS prediction_ts FROM preds WHERE airport_code = 'A03' AND horizon_h = 4 "
    "ORDER BY preds.prediction_ts DESC LIMIT 1"
)
register("lookup_prediction", lambda s, d: scans.lookup_prediction(P.predicted(s, d), " a03", 4).select(*predictions.PREDICTION_COLUMNS), _LOOKUP)


def _lookup_clustered(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s, "clustered")
    clustered.write_clustered(P.predicted(s, d).select(*predictions.PREDICTION_COLUMNS), path, file_rows=100_000)
    return clustered.lookup_clustered(s, path, " a03", 4).select(*predictions.PREDICTION_COLUMNS)


register("lookup_prediction_clustered", _lookup_clustered, _LOOKUP)
register("prediction_summary", lambda s, d: predictions.prediction_summary(P.predicted(s, d)), (
    "SELECT horizon_h, round(avg(predicted_arr_delay_min), 6) AS mean_delay, round(min(predicted_arr_delay_min), "
    "6) AS min_delay, round(max(predicted_arr_delay_min), 6) AS max_delay, count(DISTINCT airport_code) AS airports "
    "FROM preds GROUP BY ALL"
))
register(
    "order_predictions",
    lambda s, d: predictions.order_predictions(P.predicted(s, d)).select(*predictions.PREDICTION_COLUMNS),
    f"SELECT {_PRED} FROM preds ORDER BY preds.prediction_ts, airport_code, horizon_h",
)
register("kpi_prediction_measures", lambda s, d: star.kpi_prediction_measures(P.enriched(s, d)), (
    "SELECT round(avg(predicted_arr_delay_min), 6) AS predicted_avg_delay, round(avg(pct_arr_delayed_15), "
    "6) AS avg_p_delay_15, round(sum(expected_delayed_flights), 6) AS expected_delayed_flights, "
    "sum(sched_dep)::BIGINT AS scheduled_departures, round(avg(traffic_vs_usual), 6) + 0.0 AS traffic_vs_usual, "
    "round(avg(abs(predicted_arr_delay_min - actual_arr_delay_min)), 6) AS prediction_mae FROM enr"
))
register("next_n_hours_summary", lambda s, d: star.next_n_hours_summary(P.enriched(s, d), 4), (
    "SELECT airport_code, round(avg(predicted_arr_delay_min), 6) AS predicted_delay, round(sum(expected_delayed_flights), "
    "6) AS expected_delayed_flights, sum(sched_dep)::BIGINT AS scheduled_departures, round(avg(traffic_vs_usual), "
    "6) + 0.0 AS traffic_vs_usual FROM enr WHERE horizon_h <= 4 GROUP BY ALL"
))
register("airport_traffic", lambda s, d: star.airport_traffic(P.enriched(s, d), 6), (
    "SELECT airport_code, sum(sched_arr)::BIGINT AS expected_flights, (sum(sched_arr) * 130)::BIGINT AS est_passengers, "
    "round(avg(traffic_vs_usual), 6) + 0.0 AS traffic_vs_usual FROM enr WHERE horizon_h <= 6 GROUP BY ALL"
))
register("status_badge", lambda s, d: predictions.status_badge(P.enriched(s, d)).groupBy("status").agg(F.count("*").alias("n")), (
    "SELECT CASE WHEN coalesce(pct_arr_delayed_15, 0) >= 0.5 THEN 'Disrupted' WHEN coalesce(traffic_vs_usual, 0) >= 0.2 OR "
    "coalesce(pct_arr_delayed_15, 0) >= 0.3 THEN 'Busy' ELSE 'Calm' END AS status, count(*) AS n FROM enr GROUP BY ALL"
))
register(
    "horizon_profile",
    lambda s, d: star.horizon_profile(P.predicted(s, d), H),
    "SELECT airport_code, " + ", ".join(f"round(avg(predicted_arr_delay_min) FILTER (horizon_h = {h}), 6) + 0.0 AS h{h}" for h in H) + ", greatest(" + ", ".join(f"avg(predicted_arr_delay_min) FILTER (horizon_h = {h})" for h in H) + ") >= 15 AS any_late FROM preds GROUP BY ALL",
)
register("history_trend", lambda s, d: star.history_trend(P.predicted(s, d)), (
    "SELECT prediction_ts::VARCHAR AS prediction_ts, round(avg(predicted_arr_delay_min), 6) + 0.0 AS mean_predicted_delay, "
    "count(*) AS n FROM preds GROUP BY preds.prediction_ts"
))

# ---- metrics -------------------------------------------------------------------------------------------
_P, _Y = "predicted_arr_delay_min", "actual_arr_delay_min"
_REG = {"mae": f"avg(abs({_P} - {_Y}))", "rmse": f"sqrt(avg(({_P} - {_Y}) ** 2))", "mape": f"100 * avg(abs({_P} - {_Y}) / greatest(abs({_Y}), 1))", "r2": f"1 - sum(({_P} - {_Y}) ** 2) / (var_pop({_Y}) * count({_Y}))"}


def _cls(p: str, y: str, prefix: str = "") -> dict[str, str]:
    tp, fp, fn, tn = (f"(count(*) FILTER (({a}) AND ({b})))" for a, b in ((p, y), (p, f"NOT ({y})"), (f"NOT ({p})", y), (f"NOT ({p})", f"NOT ({y})")))
    pr, rc = f"({tp} / greatest({tp} + {fp}, 1))", f"({tp} / greatest({tp} + {fn}, 1))"
    return {f"{prefix}accuracy": f"({tp} + {tn}) / greatest(count(*), 1)", f"{prefix}precision": pr, f"{prefix}recall": rc, f"{prefix}f1": f"2 * {pr} * {rc} / greatest({pr} + {rc}, 1e-8)"}


_DLY, _BCE = _cls(f"{_P} >= 15", f"{_Y} >= 15"), _cls("pct_arr_delayed_15 >= 0.5", "pct_target >= 0.5", "bce_")
_cols = lambda m: ", ".join(f"coalesce(round({e}, 6), 0.0) AS {k}" for k, e in m.items())
for _k, _e in _REG.items():
    register(f"metric_{_k}", lambda s, d, k=_k: metrics.metric_regression(P.predicted(s, d)).select(k), f"SELECT coalesce(round({_e}, 6), 0.0) AS {_k} FROM preds")
register("metric_classification", lambda s, d: metrics.metric_classification(P.predicted(s, d)), f"SELECT {_cols(_DLY)} FROM preds")
register("metric_bce_classification", lambda s, d: metrics.metric_bce_classification(P.predicted(s, d)), f"SELECT {_cols(_BCE)} FROM preds")
_ALL = _REG | _DLY | _BCE
register("metric_unified", lambda s, d: metrics.metric_unified(P.predicted(s, d)), f"SELECT {_cols(_ALL)} FROM preds")
register("metrics_single", lambda s, d: metrics.metric_unified(P.predicted(s, d), bce=False), f"SELECT {_cols(_REG | _DLY)} FROM preds")
_BYH = "SELECT horizon_h::VARCHAR AS horizon, " + ", ".join(f"{e} AS {k}" for k, e in _ALL.items()) + " FROM preds GROUP BY ALL"
_HSQL = (
    f"SELECT horizon, {', '.join(f'round({k}, 6) AS {k}' for k in _ALL)} FROM ({_BYH}) UNION ALL "
    f"SELECT 'average', {', '.join(f'coalesce(round(avg({k}), 6), 0.0)' for k in _ALL)} FROM ({_BYH})"
)
register("metrics_by_horizon", lambda s, d: metrics.metrics_by_horizon(P.predicted(s, d)), _HSQL)


def _batch_predict(s, d):
    f, nodes = P.prepared(s, d)
    lag = lambda grid, cells: history.series_lookup(grid, cells, "arr_delay_mean", -1, "x")
    return P.batch_predict(f, nodes, predictions.recent_scorer(H), lag, min_rows=P.MIN_ROWS)


register(
    "batch_predict",
    _batch_predict,
    f"""
    SELECT p.node AS airport_code, horizon_h, round(delay, 6) + 0.0 AS predicted_arr_delay_min, round(1 / (1 + exp(-(delay - 15) / 10)), 6) AS pct_arr_delayed_15,
      (p.snapshot_ts + to_hours(horizon_h))::VARCHAR AS target_ts, p.snapshot_ts::VARCHAR AS prediction_ts,
      round(arr, 6) AS actual_arr_delay_min, (arr >= 15)::INT AS actual_arr_del15, round(pct, 6) AS pct_target
    FROM (SELECT q.snapshot_ts, q.node, h, CASE WHEN h <= 2 THEN x ELSE m END AS delay FROM seqs q, hz WHERE n = 6) p
    JOIN targets t ON t.snapshot_ts = p.snapshot_ts AND t.node = p.node AND t.horizon_h = p.h
    ORDER BY p.snapshot_ts, airport_code, horizon_h""",
)
register(
    "mae_by_horizon",
    lambda s, d: metrics.mae_by_horizon(P.predicted(s, d)),
    f"SELECT horizon_h, round({_REG['mae']}, 6) AS mae FROM preds GROUP BY ALL",
)
_HW = "(CASE horizon_h WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 4 THEN 4 WHEN 6 THEN 5 ELSE 5 END * 5.0 / 20)"
_LW = f"(CASE WHEN abs({_Y}) >= 15 THEN 2.0 ELSE 1.0 END * {_HW})"
_HUB = "CASE WHEN abs({0}) <= 10 THEN 0.5 * ({0}) ** 2 ELSE 10 * (abs({0}) - 5) END"
_HWS = (3, 3, 4, 5, 5)
register(
    "loss_weighted_mse",
    lambda s, d: metrics.weighted_loss(P.predicted(s, d), "mse", H, _HWS),
    f"SELECT round(avg({_LW} * ({_P} - {_Y}) ** 2), 6) AS loss FROM preds",
)
register(
    "loss_weighted_huber",
    lambda s, d: metrics.weighted_loss(P.predicted(s, d), "huber", H, _HWS),
    f"SELECT round(avg({_LW} * {_HUB.format(f'({_P} - {_Y})')}), 6) AS loss FROM preds",
)


def _multi_task(s, d):
    """Arrival delay, departure delay and late share against their targets."""
    dep = P.targets(s, d).select(F.col("node").alias("airport_code"), F.col("snapshot_ts").alias("prediction_ts"), "horizon_h", "dep")
    rows = P.predicted(s, d).join(dep, ["airport_code", "prediction_ts", "horizon_h"])
    logit = (F.col(_P) - 15) / 10
    arr, pct = F.col(_Y).alias("arr"), F.col("pct_target").alias("pct")
    rows = rows.select("horizon_h", F.col(_P).alias("arr_pred"), arr, F.col(_P).alias("dep_pred"), "dep", logit.alias("logit"), pct)
    return metrics.multi_task_loss(rows, H, _HWS)


_DEP_ERROR = _HUB.format(f"({_P} - dep)")
_MT = f"""
    SELECT avg({_LW} * {_HUB.format(f"({_P} - {_Y})")}) AS a,
      avg(CASE WHEN abs(dep) >= 15 THEN 2.0 ELSE 1.0 END * {_HW} * {_DEP_ERROR}) AS b,
      avg({_HW} * (greatest(z, 0) - z * pct_target + ln(1 + exp(-abs(z))))) AS c
    FROM (SELECT p.*, t.dep, ({_P} - 15) / 10 AS z FROM preds p
          JOIN targets t ON t.node = p.airport_code AND t.snapshot_ts = p.prediction_ts AND t.horizon_h = p.horizon_h)"""
register("loss_multi_task", _multi_task, (
    f"SELECT round(a, 6) AS arr_huber, round(b, 6) AS dep_huber, round(c, 6) AS pct_bce, round(a + 0.3 * b + 0.5 * c, "
    f"6) AS total FROM ({_MT})"
))
register("calibration_deciles", lambda s, d: metrics.calibration_deciles(P.predicted(s, d)), (
    "SELECT least(floor(pct_arr_delayed_15 * 10) + 1, 10)::INT AS decile, count(*) AS n, round(avg(pct_arr_delayed_15), "
    "6) AS predicted_rate, round(avg(actual_arr_del15), 6) AS observed_rate FROM preds GROUP BY ALL"
))
register(
    "error_histogram",
    lambda s, d: metrics.error_histogram(P.predicted(s, d)).groupBy().agg(F.sum("n").alias("n"), F.max("bin").alias("top"), F.min("bin").alias("low"), F.max("mean_error").alias("mean_error")),
    f"SELECT count(*) AS n, 99 AS top, 0 AS low, round(avg({_P} - {_Y}), 6) AS mean_error FROM preds",
)
register(  # real values as rounded and whole-numbered edges, so that both sides see the same errors
    "error_histogram_bins",
    lambda s, d: metrics.error_histogram(P.predicted(s, d).withColumns({c: F.round(c, 6) for c in (_P, _Y)}), 100, (-120, 80)),
    f"SELECT greatest(least(floor(((p - y) + 120) / 2), 99), 0)::INT AS bin, count(*) AS n, round(max(m), 6) AS mean_error "
    f"FROM (SELECT *, avg(p - y) OVER () AS m FROM (SELECT round({_P}, 6) AS p, round({_Y}, 6) AS y FROM preds)) GROUP BY 1",
)
register(
    "sample_points",
    lambda s, d: metrics.sample_points(P.predicted(s, d), 5000),
    "SELECT round(predicted_arr_delay_min, 6) + 0.0 AS predicted_arr_delay_min, round(actual_arr_delay_min, 6) + 0.0 AS actual_arr_delay_min FROM preds "
    "ORDER BY md5(airport_code || '|' || horizon_h || '|' || prediction_ts::VARCHAR), airport_code, horizon_h LIMIT 5000",
)
register(
    "champion_challenger",
    lambda s, d: (lambda p: metrics.champion_challenger(metrics.metric_regression(p), metrics.metric_regression(p.withColumn(_P, F.col(_P) * 0.5))))(P.predicted(s, d)),
    (
        f"SELECT round(a, 6) AS champion, round(b, 6) AS challenger, round((a - b) / a, 6) AS gain, "
        f"(a - b) / a >= 0.02 AS promote FROM (SELECT avg(abs({_P} - {_Y})) AS a, avg(abs({_P} * 0.5 - {_Y})) AS b FROM preds)"
    ),
)


# ---- streaming -----------------------------------------------------------------------------------------
def _stream_source(s: SparkSession, d: str) -> tuple[str, DataFrame]:
    """Trips written as files in event order, as many as their size asks for, and a stream over them."""
    base = _folder(s)
    rows = cleaning.derive_timestamps(P.flights(s, d)).select(*FLIGHT_KEYS, "Origin", "Dest", "timestamp", "arr_timestamp", "ArrDelay")
    rows.repartitionByRange("timestamp").write.parquet(f"{base}/in")
    return base, streaming.file_stream(s, f"{base}/in", s.read.parquet(f"{base}/in").schema)


def _ingest(s, d):
    base, stream = _stream_source(s, d)
    streaming.stream_ingest_hourly(stream, f"{base}/buffer", f"{base}/ck1", stream.columns).awaitTermination()
    return base, sinks.read_hour_partitions(s, f"{base}/buffer")


_ONCE = "(SELECT DISTINCT l_orderkey, l_linenumber, Origin, Dest, ts, arr_ts, ArrDelay FROM timed)"  # the stream keeps one of equal rows
register("stream_ingest_hourly", lambda s, d: _per_hour(_ingest(s, d)[1]), _HOURS.format("").replace("FROM timed", f"FROM {_ONCE}"))


def _to_table(s, df, path, checkpoint):
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(path)


def _stream_node(s, d):
    base, stream = _stream_source(s, d)
    return _to_table(s, streaming.stream_node_hour(stream), f"{base}/out", f"{base}/ck")


def _stream_route(s, d):
    base, stream = _stream_source(s, d)
    return _to_table(s, streaming.stream_route_hour(stream), f"{base}/out", f"{base}/ck")


_CLOSED = "WHERE arr_ts + INTERVAL 1 HOUR <= (SELECT max(arr_ts) FROM timed) - INTERVAL 2 HOUR"
register("stream_node_hour", _stream_node, (
    f"SELECT arr_ts::VARCHAR AS bucket, Dest AS node, count(*) AS n, round(avg(ArrDelay), 6) AS arr_delay_mean "
    f"FROM timed {_CLOSED} GROUP BY ALL"
))
register("stream_route_hour", _stream_route, (
    f"SELECT arr_ts::VARCHAR AS bucket, Origin AS src, Dest AS dst, count(*) AS n, round(avg(ArrDelay), "
    f"6) AS route_arr_delay FROM timed {_CLOSED} GROUP BY ALL"
))


def _stream_recent(s, d):
    """All node series over the last 24 hours of the buffer, as the batch operators build them."""
    base, buffer = _ingest(s, d)
    stream = streaming.file_stream(s, f"{base}/in", s.read.parquet(f"{base}/in").schema)
    build = lambda rows: history.node_history(history.with_buckets(rows)).drop("sched_arr_mean_distance")
    streaming.stream_recent_features(stream, f"{base}/buffer", f"{base}/ck2", build, f"{base}/features").awaitTermination()
    return s.read.parquet(f"{base}/features")


_RECENT = f"(SELECT * FROM {_ONCE} WHERE ts >= (SELECT max(ts) FROM timed) - INTERVAL 24 HOUR)"
_LIVE = f"""
    SELECT node, bucket::VARCHAR AS bucket, round(v, 6) AS arr_delay_mean, round(rm, 6) AS rolling_mean, round(rs, 6) AS rolling_std, sched_arr_count, sched_arr_from_top10, sched_dep_count
    FROM (SELECT Dest AS node, arr_ts AS bucket, count(*) AS sched_arr_count, nullif(count(*) FILTER (Origin IN
            (SELECT Origin FROM {_RECENT} GROUP BY Origin ORDER BY count(*) DESC, Origin LIMIT 10)), 0) AS sched_arr_from_top10 FROM {_RECENT} GROUP BY ALL)
    LEFT JOIN (SELECT node, bucket, v, avg(v) OVER w AS rm, coalesce(stddev_samp(v) OVER w, 0) AS rs
          FROM (SELECT Dest AS node, arr_ts AS bucket, avg(ArrDelay) AS v FROM {_RECENT} GROUP BY ALL HAVING count(ArrDelay) > 0)
          WINDOW w AS (PARTITION BY node ORDER BY bucket ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) USING (node, bucket)
    FULL JOIN (SELECT Origin AS node, ts AS bucket, count(*) AS sched_dep_count FROM {_RECENT} GROUP BY ALL) USING (node, bucket)"""
register("stream_recent_features", _stream_recent, _LIVE)


def _stream_features(s, d):
    """Each closed hour of each node once, with rolling values over its last six observed hours."""
    base, stream = _stream_source(s, d)
    busy = [r["code"] for r in network.top10_origins(P.flights(s, d)).collect()]  # ten codes
    return _to_table(s, streaming.stream_features(stream, busy), f"{base}/out", f"{base}/ck")


_ENDS = (
    "SELECT Dest AS node, arr_ts AS moment, true AS arrival, ArrDelay AS late, Origin IN (SELECT Origin FROM flights GROUP BY Origin "
    "ORDER BY count(*) DESC, Origin LIMIT 10) AS top FROM timed UNION ALL SELECT Origin, ts, false, NULL, false FROM timed"
)
register("stream_features", _stream_features, f"""
    SELECT * FROM (WITH e AS ({_ENDS}),
    c AS (SELECT node, moment AS bucket, avg(late) AS v, count(*) FILTER (arrival) AS a, count(*) FILTER (top) AS t, count(*) FILTER (NOT arrival) AS n
      FROM e WHERE moment + INTERVAL 1 HOUR <= (SELECT max(moment) FROM e) - INTERVAL 2 HOUR GROUP BY ALL),
    r AS (SELECT node, bucket, avg(v) OVER w AS rm, coalesce(stddev_samp(v) OVER w, 0) AS rs FROM c WHERE v IS NOT NULL
      WINDOW w AS (PARTITION BY node ORDER BY bucket ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
    SELECT node, c.bucket::VARCHAR AS bucket, round(v, 6) + 0.0 AS arr_delay_mean, round(rm, 6) + 0.0 AS rolling_mean, round(rs, 6) AS rolling_std,
      nullif(a, 0) AS sched_arr_count, nullif(t, 0) AS sched_arr_from_top10, nullif(n, 0) AS sched_dep_count FROM c LEFT JOIN r USING (node, bucket))""")


def _stream_predictions(s, d):
    """History and latest after four micro-batches and a replay of the last one."""
    base = _folder(s)
    P.predicted(s, d).select(*predictions.PREDICTION_COLUMNS).repartitionByRange(4, "prediction_ts").write.parquet(f"{base}/in")
    stream = streaming.file_stream(s, f"{base}/in", s.read.parquet(f"{base}/in").schema, files_per_batch=1)
    streaming.stream_predictions(stream, f"{base}/latest", f"{base}/history", f"{base}/ck").awaitTermination()
    last = sinks.read_predictions_batches(s, f"{base}/history").where(F.expr("prediction_ts >= timestamp_ntz'2019-10-05 00:00:00'"))
    for _ in range(2):  # a replay changes nothing
        sinks.merge_predictions_latest(last, f"{base}/latest", 99)
    return base


register(
    "stream_predictions",
    lambda s, d: sinks.read_predictions_batches(s, f"{_stream_predictions(s, d)}/history"),
    f"SELECT {_PRED} FROM preds",
)
register(
    "stream_predictions_latest",
    lambda s, d: sinks.read_predictions_latest(s, f"{_stream_predictions(s, d)}/latest"),
(
        f"SELECT {_PRED} FROM preds p WHERE p.prediction_ts = (SELECT max(q.prediction_ts) FROM preds q "
        f"WHERE q.airport_code = p.airport_code AND q.horizon_h = p.horizon_h)"
    ),
)


def _stream_retention(s, d):
    """The hours that are left when every micro-batch of the ingest trims what is older than 168 hours."""
    base, stream = _stream_source(s, d)
    streaming.stream_ingest_hourly(stream, f"{base}/buffer", f"{base}/ck1", stream.columns, now=_now).awaitTermination()
    return _per_hour(sinks.read_hour_partitions(s, f"{base}/buffer"))


register("stream_retention", _stream_retention, _HOURS.format(_KEPT).replace("FROM timed", f"FROM {_ONCE}"))


def _price_quantiles(s: SparkSession, d: str) -> DataFrame:
    """Few groups with many different values: their ranks are selected by histograms."""
    q = selection.exact_quantiles(s.read.parquet(f"{d}/lineitem.parquet"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95], buffered=0)
    return q.select("l_returnflag", *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(("p05", "p50", "p95"))])


register("exact_quantiles", _price_quantiles, (
    "SELECT l_returnflag, round(quantile_cont(l_extendedprice::DOUBLE, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), "
    "6) AS p50, round(quantile_cont(l_extendedprice::DOUBLE, 0.95), 6) AS p95 FROM lineitem GROUP BY ALL"
))
