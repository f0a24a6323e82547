"""Every registered query of the network analytics, each over whole tables, with its SQL beside it.

SQL is built from named common table expressions; ``_sql`` puts the ones a query needs before it.
Timestamps and dates are returned as text and computed reals are rounded, on both sides alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Named common table expressions; each lists what it needs by using it.
CTES = {
    "flights0": """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    'A' || lpad(s_nationkey::VARCHAR, 2, '0') AS Origin, 'A' || lpad(c_nationkey::VARCHAR, 2, '0') AS Dest,
    DATE '2019-09-10' + (l_orderkey % 30)::INT AS FlightDate, ((l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 24)::INT AS hh, (l_partkey % 60)::INT AS mi,
    (l_orderkey * 3 + l_linenumber) % 53 = 0 AS Cancelled, (l_orderkey * 5 + l_linenumber) % 97 = 0 AS Diverted,
    l_returnflag || l_linestatus AS Airline, (100 + abs(s_nationkey - c_nationkey) * 95)::DOUBLE AS Distance,
    CASE WHEN (l_orderkey * 3 + l_linenumber) % 53 = 0 OR (l_orderkey * 5 + l_linenumber) % 97 = 0 THEN NULL
      ELSE ((l_partkey * 31 + l_orderkey * 17 + l_linenumber * 7) % 120 - 20)::DOUBLE END AS ArrDelay,
    CASE WHEN (l_orderkey * 3 + l_linenumber) % 53 = 0 THEN NULL ELSE ((l_suppkey * 13 + l_orderkey * 11) % 90 - 10)::DOUBLE END AS DepDelay
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""",
    "flights": """
  SELECT *, hh * 100 + mi AS CRSDepTime, (((hh + l_suppkey % 4) % 24) * 100 + mi)::INT AS CRSArrTime, month(FlightDate)::INT AS Month, day(FlightDate)::INT AS DayofMonth, isodow(FlightDate)::INT AS DayOfWeek,
    (30 + floor(Distance / 8))::DOUBLE AS AirTime, (8 + l_linenumber)::DOUBLE AS TaxiOut, (3 + l_partkey % 7)::DOUBLE AS TaxiIn,
    (ArrDelay >= 15)::INT::DOUBLE AS ArrDel15, (DepDelay >= 15)::INT::DOUBLE AS DepDel15,
    CASE WHEN ArrDelay >= 15 THEN CASE WHEN l_partkey % 5 = 0 THEN ArrDelay ELSE 0 END END AS CarrierDelay,
    CASE WHEN ArrDelay >= 15 THEN CASE WHEN l_partkey % 5 = 1 THEN ArrDelay ELSE 0 END END AS WeatherDelay,
    CASE WHEN ArrDelay >= 15 THEN CASE WHEN l_partkey % 5 = 2 THEN ArrDelay ELSE 0 END END AS NASDelay,
    CASE WHEN ArrDelay >= 15 THEN CASE WHEN l_partkey % 5 = 3 THEN ArrDelay ELSE 0 END END AS SecurityDelay,
    CASE WHEN ArrDelay >= 15 THEN CASE WHEN l_partkey % 5 = 4 THEN ArrDelay ELSE 0 END END AS LateAircraftDelay
  FROM flights0 WHERE Origin <> Dest""",
    "timed": (
        "SELECT *, FlightDate::TIMESTAMP + to_hours(hh) AS ts, FlightDate::TIMESTAMP + to_hours((CRSArrTime // 100)::INT) + "
        "CASE WHEN CRSArrTime < CRSDepTime THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS arr_ts FROM flights"
    ),
    "clean": "SELECT * FROM timed WHERE NOT Cancelled AND NOT Diverted AND ArrDelay IS NOT NULL",
    "activity": "SELECT code, count(*) AS n FROM (SELECT Origin AS code FROM clean UNION ALL SELECT Dest FROM clean) GROUP BY code",
    "nodes": "SELECT code FROM activity ORDER BY n DESC, code LIMIT 20",
    "f": (
        "SELECT * REPLACE (coalesce(CarrierDelay, 0) AS CarrierDelay, coalesce(WeatherDelay, 0) AS WeatherDelay, "
        "coalesce(NASDelay, 0) AS NASDelay, coalesce(SecurityDelay, 0) AS SecurityDelay, coalesce(LateAircraftDelay, "
        "0) AS LateAircraftDelay) FROM clean WHERE Origin IN (SELECT code FROM nodes) AND Dest IN (SELECT code FROM nodes)"
    ),
    "rf": "SELECT * FROM timed WHERE Origin IN (SELECT code FROM nodes) AND Dest IN (SELECT code FROM nodes)",
    "fdep": (
        "SELECT Origin AS airport_code, ts AS ts_hour, count(*) AS sched_dep, count(*) FILTER (NOT Cancelled) AS dep_operated, "
        "count(*) FILTER (Cancelled) AS dep_cancelled, avg(DepDelay) AS dep_delay_mean, coalesce(sum(DepDel15), "
        "0)::BIGINT AS dep_del15 FROM rf GROUP BY ALL"
    ),
    "farr": (
        "SELECT Dest AS airport_code, arr_ts AS ts_hour, count(*) AS sched_arr, "
        "count(*) FILTER (NOT Cancelled) AS arr_operated, count(*) FILTER (Cancelled) AS arr_cancelled, "
        "avg(ArrDelay) AS arr_delay_mean, quantile_cont(ArrDelay, 0.5) AS arr_delay_median, coalesce(sum(ArrDel15), "
        "0)::BIGINT AS arr_del15 FROM rf GROUP BY ALL"
    ),
    "fad": (
        "SELECT airport_code, ts_hour, coalesce(sched_arr, 0) AS sched_arr, coalesce(arr_operated, 0) AS arr_operated, "
        "coalesce(arr_cancelled, 0) AS arr_cancelled, arr_delay_mean, arr_delay_median, coalesce(arr_del15, 0) AS arr_del15, "
        "coalesce(sched_dep, 0) AS sched_dep, coalesce(dep_operated, 0) AS dep_operated, coalesce(dep_cancelled, "
        "0) AS dep_cancelled, dep_delay_mean, coalesce(dep_del15, 0) AS dep_del15 FROM farr FULL "
        "JOIN fdep USING (airport_code, ts_hour)"
    ),
    "fact": (
        "SELECT *, ts_hour::DATE AS date, hour(ts_hour)::INT AS hour, (isodow(ts_hour) - 1)::INT AS day_of_week, "
        "month(ts_hour)::INT AS month, year(ts_hour)::INT AS year, sched_arr * 130 AS est_arr_passengers, "
        "sched_dep * 130 AS est_dep_passengers FROM fad"
    ),
    "baseline": (
        "SELECT airport_code, day_of_week, hour, avg(sched_arr) AS baseline_sched_arr, avg(sched_dep) AS baseline_sched_dep, "
        "avg(arr_delay_mean) AS baseline_arr_delay_mean, count(*) AS n_observations FROM fact GROUP BY ALL"
    ),
    "span": "SELECT min(ts) AS lo, max(ts) AS hi FROM f",
    "times": "SELECT unnest(generate_series(lo, hi - INTERVAL 9 HOUR, INTERVAL 1 HOUR)) + INTERVAL 1 HOUR AS snapshot_ts FROM span",
    "dep_ok": "SELECT ts + INTERVAL 1 HOUR AS snapshot_ts FROM f GROUP BY 1 HAVING count(*) >= 10",
    "arr_ok": "SELECT arr_ts AS bucket FROM f GROUP BY 1 HAVING count(*) >= 10",
    "hz": "SELECT unnest([1, 2, 4, 6, 8])::INT AS h",
    "full_h": "SELECT bucket - to_hours(h - 1) AS snapshot_ts FROM arr_ok, hz GROUP BY 1 HAVING count(*) = 5",
    "snaps": "SELECT snapshot_ts FROM times SEMI JOIN dep_ok USING (snapshot_ts) SEMI JOIN full_h USING (snapshot_ts)",
    "grid": "SELECT snapshot_ts, code AS node FROM snaps, nodes",
    "hist": "SELECT Dest AS node, arr_ts AS bucket, avg(ArrDelay) AS v FROM f GROUP BY ALL",
    "roll": (
        "SELECT node, bucket, v, avg(v) OVER w AS rm, coalesce(stddev_samp(v) OVER w, 0) AS rs FROM hist "
        "WINDOW w AS (PARTITION BY node ORDER BY bucket ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
    ),
    "sarr": "SELECT Dest AS node, arr_ts AS bucket, count(*) AS n, avg(Distance) AS d FROM f GROUP BY ALL",
    "sdep": "SELECT Origin AS node, ts AS bucket, count(*) AS n FROM f GROUP BY ALL",
    "top10": "SELECT Origin AS code, count(*) AS n FROM f GROUP BY ALL ORDER BY n DESC, code LIMIT 10",
    "s10": "SELECT Dest AS node, arr_ts AS bucket, count(*) AS n FROM f WHERE Origin IN (SELECT code FROM top10) GROUP BY ALL",
    "route": "SELECT Origin AS src, Dest AS dst, arr_ts AS bucket, avg(ArrDelay) AS v FROM f GROUP BY ALL",
    "rroll": "SELECT src, dst, bucket, v, avg(v) OVER (PARTITION BY src, dst ORDER BY bucket ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS rm FROM route",
    "rsched": "SELECT Origin AS src, Dest AS dst, ts AS bucket, count(*) AS n FROM f GROUP BY ALL",
    "routes": "SELECT Origin, Dest, count(*) AS c, coalesce(avg(AirTime), 0) AS a, coalesce(avg(Distance), 0) AS d FROM f GROUP BY ALL HAVING count(*) >= 30",
    "mx": "SELECT max(c) AS mc, max(a) AS ma, max(d) AS md FROM routes",
    "edges": (
        "SELECT Origin || '>' || Dest AS edge_id, Origin AS src, Dest AS dst, c / mc AS count_norm, a / ma AS air_time_norm, "
        "d / md AS distance_norm FROM routes, mx UNION ALL SELECT Origin || '<' || Dest, Dest, Origin, c / mc, a / ma, d / md "
        "FROM routes, mx"
    ),
    "aw": (
        "SELECT src, dst, w / sqrt(ds * dt) AS w FROM (SELECT src, dst, sum(count_norm) AS w FROM edges GROUP BY ALL) e "
        "JOIN (SELECT src AS s, sum(count_norm) AS ds FROM edges GROUP BY ALL) a ON a.s = e.src "
        "JOIN (SELECT dst AS t, sum(count_norm) AS dt FROM edges GROUP BY ALL) b ON b.t = e.dst"
    ),
    "dm": (
        "SELECT snapshot_ts, node, coalesce(x.m, 0) AS m FROM (SELECT ts + INTERVAL 1 HOUR AS snapshot_ts, Origin AS node, "
        "avg(DepDelay) AS m FROM f GROUP BY ALL) x FULL JOIN (SELECT DISTINCT ts + INTERVAL 1 HOUR AS snapshot_ts, Dest AS node "
        "FROM f) y USING (snapshot_ts, node) WHERE snapshot_ts IN (SELECT snapshot_ts FROM snaps)"
    ),
    "done": "SELECT *, ts + INTERVAL 1 HOUR AS snapshot_ts FROM f WHERE arr_ts < ts + INTERVAL 1 HOUR",
    "blk_a1": (
        "SELECT snapshot_ts, Dest AS node, avg(ArrDelay) AS m, stddev_pop(ArrDelay) AS s, quantile_cont(ArrDelay, "
        "0.75) AS p75, quantile_cont(ArrDelay, 0.9) AS p90, avg((ArrDelay > 15)::INT) AS l, avg((ArrDelay > 60)::INT) AS l60, "
        "avg(TaxiIn) AS ti FROM done GROUP BY ALL"
    ),
    "blk_a2": "SELECT snapshot_ts, Origin AS node, avg(DepDelay) AS dm, stddev_pop(DepDelay) AS ds, avg(TaxiOut) AS tx FROM done GROUP BY ALL",
    "block_a": (
        "SELECT snapshot_ts, node, round(coalesce(m, 0), 6) AS a_arr_mean, round(coalesce(s, 0), 6) AS a_arr_std, "
        "round(coalesce(p75, 0), 6) AS a_arr_p75, round(coalesce(p90, 0), 6) AS a_arr_p90, round(coalesce(l, 0), "
        "6) AS a_share_late, round(coalesce(l60, 0), 6) AS a_share_60, round(coalesce(dm, 0), 6) AS a_dep_mean, "
        "round(coalesce(ds, 0), 6) AS a_dep_std, round(coalesce(CASE WHEN tx IS NULL THEN ti WHEN coalesce(ti, "
        "0) <> 0 THEN (ti + tx) / 2 ELSE tx END, 0), 6) AS a_taxi FROM blk_a1 FULL JOIN blk_a2 USING (snapshot_ts, node)"
    ),
    "blk_b": (
        "SELECT snapshot_ts, node, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(cc, 0) AS cc, coalesce(dd, 0) AS dd "
        "FROM (SELECT snapshot_ts, Dest AS node, count(*) AS x FROM done GROUP BY ALL) FULL "
        "JOIN (SELECT ts + INTERVAL 1 HOUR AS snapshot_ts, Origin AS node, count(*) AS y, count(*) FILTER (Cancelled) AS cc, "
        "count(*) FILTER (Diverted) AS dd FROM f GROUP BY ALL) USING (snapshot_ts, node)"
    ),
    "block_b": (
        "SELECT snapshot_ts, node, round(CASE WHEN max(x) OVER w > 0 THEN x / max(x) OVER w ELSE 0 END, 6) AS b_arrivals, "
        "round(CASE WHEN max(y) OVER w > 0 THEN y / max(y) OVER w ELSE 0 END, 6) AS b_departures, cc::DOUBLE AS b_cancelled, "
        "dd::DOUBLE AS b_diverted FROM blk_b WINDOW w AS (PARTITION BY snapshot_ts)"
    ),
    "block_c": (
        "SELECT snapshot_ts, Dest AS node, round(avg(CarrierDelay), 6) AS c_CarrierDelay, round(avg(WeatherDelay), "
        "6) AS c_WeatherDelay, round(avg(NASDelay), 6) AS c_NASDelay, round(avg(SecurityDelay), 6) AS c_SecurityDelay, "
        "round(avg(LateAircraftDelay), 6) AS c_LateAircraftDelay FROM done GROUP BY ALL"
    ),
    "block_d": "SELECT snapshot_ts, g.node, " + ", ".join(f"round(coalesce(h{k}.v, 0), 6) AS d_lag_{k}" for k in (1, 3, 6, 24)) + " FROM grid g " + " ".join(f"LEFT JOIN hist h{k} ON h{k}.node = g.node AND h{k}.bucket = g.snapshot_ts - INTERVAL {k} HOUR" for k in (1, 3, 6, 24)),
    "block_e": (
        "SELECT snapshot_ts, g.node, round(coalesce(rm, 0), 6) AS e_rolling_mean, round(coalesce(rs, 0), 6) AS e_rolling_std "
        "FROM grid g LEFT JOIN roll r ON r.node = g.node AND r.bucket = g.snapshot_ts - INTERVAL 1 HOUR"
    ),
    "block_f": "SELECT snapshot_ts, node, " + ", ".join(f"round({fn}(2 * pi() * {v} / {p}), 6) + 0.0 AS f_{n}_{fn}" for n, v, p in (("hour", "hour(snapshot_ts)", 24), ("dow", "(isodow(snapshot_ts) - 1)", 7), ("month", "(month(snapshot_ts) - 1)", 12)) for fn in ("sin", "cos")) + " FROM grid",
    "block_g": "SELECT snapshot_ts, g.node, " + ", ".join((
        f"round(coalesce(a{h}.n, 0)::DOUBLE, 6) AS g{h}_sched_arr_count, round(coalesce(d{h}.n, 0)::DOUBLE, "
        f"6) AS g{h}_sched_dep_count, round(coalesce(t{h}.n, 0)::DOUBLE, 6) AS g{h}_sched_arr_from_top10, "
        f"round(coalesce(a{h}.d, 0), 6) AS g{h}_sched_arr_mean_distance"
    ) for h in (1, 2, 4, 6, 8)) + " FROM grid g " + " ".join(f"LEFT JOIN {t} {x}{h} ON {x}{h}.node = g.node AND {x}{h}.bucket = g.snapshot_ts + INTERVAL {h - 1} HOUR" for h in (1, 2, 4, 6, 8) for t, x in (("sarr", "a"), ("sdep", "d"), ("s10", "t"))),
    "cells": "SELECT Dest AS node, arr_ts AS bucket, avg(ArrDelay) AS arr, avg(DepDelay) AS dep, avg((ArrDelay >= 15)::INT) AS pct FROM f GROUP BY ALL",
    "targets": (
        "SELECT snapshot_ts, g.node, h AS horizon_h, coalesce(arr, 0) AS arr, coalesce(dep, 0) AS dep, coalesce(pct, 0) AS pct "
        "FROM (SELECT * FROM grid, hz) g LEFT JOIN cells c ON c.node = g.node AND c.bucket = g.snapshot_ts + to_hours(h - 1)"
    ),
    "scored": (
        "SELECT g.snapshot_ts, g.node, h AS horizon_h, CASE WHEN h <= 2 THEN coalesce(r.v, 0) ELSE coalesce(r.rm, "
        "0) END AS delay FROM (SELECT * FROM grid, hz) g LEFT JOIN roll r ON r.node = g.node "
        "AND r.bucket = g.snapshot_ts - INTERVAL 1 HOUR"
    ),
    "preds": (
        "SELECT s.node AS airport_code, s.horizon_h, delay AS predicted_arr_delay_min, "
        "1 / (1 + exp(-(delay - 15) / 10)) AS pct_arr_delayed_15, s.snapshot_ts + to_hours(s.horizon_h) AS target_ts, "
        "s.snapshot_ts AS prediction_ts, t.arr AS actual_arr_delay_min, (t.arr >= 15)::INT AS actual_arr_del15, "
        "t.pct AS pct_target FROM scored s JOIN targets t ON t.node = s.node AND t.snapshot_ts = s.snapshot_ts "
        "AND t.horizon_h = s.horizon_h"
    ),
    "enr": (
        "SELECT p.*, coalesce(x.sched_arr, 0) AS sched_arr, coalesce(x.sched_dep, 0) AS sched_dep, "
        "(isodow(target_ts) - 1)::INT AS dow, hour(target_ts)::INT AS hour, b.baseline_sched_arr, pct_arr_delayed_15 * "
        "coalesce(x.sched_arr, 0) AS expected_delayed_flights, CASE WHEN b.baseline_sched_arr > 0 THEN coalesce(x.sched_arr, "
        "0) / b.baseline_sched_arr - 1 END AS traffic_vs_usual FROM preds p LEFT "
        "JOIN fact x ON x.airport_code = p.airport_code AND x.ts_hour = date_trunc('hour', p.target_ts) LEFT "
        "JOIN baseline b ON b.airport_code = p.airport_code AND b.day_of_week = isodow(target_ts) - 1 "
        "AND b.hour = hour(target_ts)"
    ),
    "split": (
        "SELECT snapshot_ts, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' "
        "WHEN r <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM (SELECT snapshot_ts, "
        "row_number() OVER (ORDER BY snapshot_ts) AS r, count(*) OVER () AS n FROM snaps)"
    ),
    "seqs": """
  SELECT snapshot_ts, node, x, avg(x) OVER w AS m, count(*) OVER w AS n
  FROM (SELECT g.snapshot_ts, g.node, s.split, coalesce(v, 0) AS x
        FROM grid g JOIN split s ON s.snapshot_ts = g.snapshot_ts
        LEFT JOIN hist h ON h.node = g.node AND h.bucket = g.snapshot_ts - INTERVAL 1 HOUR)
  WHERE split = 'test'
  WINDOW w AS (PARTITION BY node ORDER BY snapshot_ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
    "airports": (
        "SELECT 'A' || lpad(n_nationkey::VARCHAR, 2, '0') AS airport_code, n_name AS name, "
        "(n_nationkey * 2 - 20)::DOUBLE AS latitude, (n_nationkey * 5 - 60)::DOUBLE AS longitude, "
        "(n_nationkey * 10)::INT AS elevation_m FROM nation"
    ),
    "wx": (
        "SELECT event_id, 'A' || lpad((user_id % 25)::VARCHAR, 2, '0') AS iata, "
        "ts::TIMESTAMP + to_days((DATE '2019-09-10' - DATE '2024-01-01')::INT) AS ts, (v % 40)::DOUBLE AS wind, "
        "(v % 60 + 10)::DOUBLE AS gust, (v % 5)::DOUBLE AS precip, (v % 101)::DOUBLE AS cloud, code, CASE code WHEN 45 THEN 1 "
        "WHEN 61 THEN 2 WHEN 75 THEN 3 WHEN 95 THEN 4 ELSE 0 END AS cat FROM (SELECT *, trunc(value)::INT AS v, "
        "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 45 WHEN 'purchase' THEN 61 WHEN 'signup' THEN 75 "
        "WHEN 'error' THEN 95 ELSE 1 END AS code FROM events)"
    ),
    "wxh": (
        "SELECT * REPLACE (date_trunc('hour', ts)::TIMESTAMP AS ts) FROM wx QUALIFY row_number() OVER (PARTITION BY iata, "
        "date_trunc('hour', ts) ORDER BY ts, event_id) = 1"
    ),
}


def _sql(body: str) -> str:
    """``body`` with the expressions it needs, in order."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                need(CTES[name])
                needed.append(name)

    need(body)
    return ("WITH " + ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in needed) + "\n" if needed else "") + body


def plain(df: DataFrame) -> DataFrame:
    """Dates and times as text, reals to six decimals (never -0.0)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: plain(query(spark, folder))
    if sql is not None:
        ORACLES[name] = _sql(sql)
