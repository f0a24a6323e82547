"""Exact values of small hand-made tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from transloom.functions import clean_code, inf_to_zero, nan_to_zero, parse_iso, two_digits, wmo_category
from transloom.operators import cleaning, history, metrics, network, predictions, snapshots, star, tabular, weather
from transloom.sources import scans, schema, sinks

DAY = dt.date(2019, 10, 1)


def ts(day, hour, minute=0):
    return dt.datetime(2019, 10, day, hour, minute)


@pytest.fixture(scope="module")
def export_flights(spark):
    """Six trips between P and Q: four arrive at Q at 14, one of them cancelled; one arrives after midnight."""
    rows = [
        ("P", "Q", 1210, 1405, 4.0, 8.0, 0.0, False), ("P", "Q", 1225, 1430, 6.0, 16.0, 1.0, False), ("P", "Q", 1240, 1455, 2.0, 36.0, 1.0, False),
        ("P", "Q", 1255, 1459, None, None, None, True), ("Q", "P", 615, 702, -3.0, -8.0, 0.0, False), ("Q", "P", 2245, 20, 1.0, 2.0, 0.0, False),
    ]
    df = spark.createDataFrame(rows, "Origin string, Dest string, CRSDepTime int, CRSArrTime int, DepDelay double, ArrDelay double, ArrDel15 double, Cancelled boolean")
    return df.withColumns({"FlightDate": F.lit(DAY), "Airline": F.lit("ZZ"), "Distance": F.lit(320.0), "DepDel15": F.lit(0.0), "Diverted": F.lit(False)})


def frame(spark, flights):
    return cleaning.build_flight_frame(flights, spark.createDataFrame([("P",), ("Q",)], "code string"))


def at(day, hour):
    return F.col("ts_hour") == F.lit(ts(day, hour)).cast("timestamp_ntz")


def test_overnight_arrival(spark, export_flights):
    r = frame(spark, export_flights).where("CRSDepTime = 2245").first()
    assert (r["dep_ts_hour"], r["arr_ts_hour"]) == (ts(1, 22), ts(2, 0))


def test_fact_airport_hour(spark, export_flights):
    fact = star.fact_airport_hour(frame(spark, export_flights), seats=50)
    q = fact.where((F.col("airport_code") == "Q") & at(1, 14)).first()
    assert (q["sched_arr"], q["arr_operated"], q["arr_cancelled"], q["arr_delay_mean"], q["arr_del15"], q["est_arr_passengers"]) == (4, 3, 1, 20.0, 2, 200)
    assert (q["arr_delay_median"], q["sched_dep"], q["dep_delay_mean"]) == (16.0, 0, None)
    p = fact.where((F.col("airport_code") == "P") & at(1, 12)).first()
    assert (p["sched_dep"], p["dep_operated"], p["dep_cancelled"], p["dep_delay_mean"]) == (4, 3, 1, 4.0)


def test_enrichment(spark, export_flights):
    fact = star.fact_airport_hour(frame(spark, export_flights))
    p = spark.createDataFrame([("Q", 2, 18.0, 0.25, ts(1, 14), ts(1, 12)), ("Q", 2, 18.0, 0.25, ts(1, 3), ts(1, 1))], "airport_code string, horizon_h int, predicted_arr_delay_min double, pct_arr_delayed_15 double, target_ts timestamp_ntz, prediction_ts timestamp_ntz")
    rows = predictions.enrich_predictions(p, fact, star.agg_baseline_volume(fact)).orderBy("prediction_ts").collect()
    assert [(r["sched_arr"], r["expected_delayed_flights"], r["traffic_vs_usual"]) for r in rows] == [(0, 0.0, None), (4, 1.0, 0.0)]


def test_dimensions(spark):
    days = star.dim_date(spark.createDataFrame([(dt.date(2020, 2, 28), dt.date(2020, 3, 2))], "d0 date, d1 date")).orderBy("date").collect()
    assert [d["day_name"] for d in days] == ["Fri", "Sat", "Sun", "Mon"] and [d["season"] for d in days] == ["Winter", "Winter", "Spring", "Spring"]
    assert [d["is_weekend"] for d in days] == [False, True, True, False] and days[1]["day"] == 29
    hours = {r["hour"]: r["part_of_day"] for r in star.dim_hour(spark).collect()}
    assert [hours[h] for h in (5, 6, 12, 18, 23)] == ["Night", "Morning", "Afternoon", "Evening", "Evening"] and len(hours) == 24


def test_cleaning(spark, export_flights):
    assert cleaning.clean_flights(export_flights).count() == 5
    assert {r["Hour"] for r in cleaning.encode_time(export_flights).collect()} == {6, 12, 22}
    assert network.top_n_airports(export_flights, 1).first()["code"] == "P"


def test_scalars(spark):
    one = spark.sql("SELECT ' ab1 ' AS code, '2020-03-04T05:06:07Z' AS z, '2020-03-04T05:06:07+02:00' AS off, 'never' AS bad, double('nan') AS nan, double('-inf') AS inf, 7 AS n")
    r = one.select(clean_code(F.col("code")), parse_iso(F.col("z")), parse_iso(F.col("off")), parse_iso(F.col("bad")), nan_to_zero(F.col("nan")), inf_to_zero(F.col("inf")), two_digits(F.col("n"))).first()
    assert tuple(r) == ("AB1", dt.datetime(2020, 3, 4, 5, 6, 7), dt.datetime(2020, 3, 4, 5, 6, 7), None, 0.0, 0.0, "07")
    assert weather.enabled_groups(["wind_gust", "cloud"]) == {"wind", "precip_cloud"} and weather.enabled_groups(None) == set(weather.GROUPS)
    with pytest.raises(ValueError):
        weather.enabled_groups(["sunshine"])


def test_label_encoder_is_dense(spark):
    rows = spark.createDataFrame([(f"v{i % 57:02d}",) for i in range(300)] + [(None,)], "x string").repartition(5)
    codes = {r["value"]: r["code"] for r in tabular.fit_label_encoder(rows, "x").collect()}
    assert codes == {f"v{i:02d}": i for i in range(57)}


def test_latest_predictions_survive_replays_and_short_batches(spark, tmp_path):
    kinds = "airport_code string, horizon_h int, predicted_arr_delay_min double, pct_arr_delayed_15 double, target_ts timestamp_ntz, prediction_ts timestamp_ntz"
    row = lambda code, hour, value: (code, 1, value, 0.5, ts(1, hour + 1), ts(1, hour))
    batches = [[row("P", 1, 1.0), row("Q", 1, 2.0)], [row("P", 2, 3.0)], [row("Q", 3, 4.0), row("Q", 3, 4.0)]]
    latest, history_path = f"{tmp_path}/latest", f"{tmp_path}/history"
    assert sinks.read_predictions_latest(spark, latest).count() == 0 and sinks.read_predictions_batches(spark, history_path).count() == 0
    for number in (0, 1, 1, 2, 2):  # batches 1 and 2 are replayed
        batch = spark.createDataFrame(batches[number], kinds)
        sinks.write_predictions_batch(batch, history_path, number)
        sinks.merge_predictions_latest(batch, latest, number)
    got = {r["airport_code"]: r["predicted_arr_delay_min"] for r in sinks.read_predictions_latest(spark, latest).collect()}
    assert got == {"P": 3.0, "Q": 4.0} and sinks.read_predictions_batches(spark, history_path).count() == 4


def leak_flights(spark):
    rows = [(o, d, h * 100 + k, (h + 1) % 24 * 100 + k, 0.0, 1_000_000.0 if (o, h) == ("AAA", 18) else 5.0) for h in range(24) for k in range(5) for o, d in (("AAA", "BBB"), ("BBB", "CCC"))]
    df = spark.createDataFrame(rows, "Origin string, Dest string, CRSDepTime int, CRSArrTime int, DepDelay double, ArrDelay double")
    df = df.withColumns({"FlightDate": F.lit(dt.date(2018, 1, 1)), "Distance": F.lit(100.0), "AirTime": F.lit(30.0), "TaxiIn": F.lit(5.0), "TaxiOut": F.lit(10.0), "Cancelled": F.lit(False), "Diverted": F.lit(False)})
    return history.with_buckets(cleaning.derive_timestamps(df))


def test_no_feature_sees_the_future(spark):
    f = leak_flights(spark)
    nodes = spark.createDataFrame([("AAA",), ("BBB",), ("CCC",)], "code string")
    snaps = snapshots.guarded_snapshots(f, horizons=(1, 2))
    rich = snapshots.node_features_rich(f, nodes, snaps, horizons=(1, 2))
    values = [c for c in rich.columns if c not in ("snapshot_ts", "node")]
    assert len(values) == 40
    before = rich.where(F.col("snapshot_ts") <= F.lit(dt.datetime(2018, 1, 1, 19)).cast("timestamp_ntz"))
    assert before.agg(F.max(F.greatest(*[F.abs(F.col(c)) for c in values]))).first()[0] < 1e5
    edges = history.edge_dynamic(network.edge_static(f, 1), snaps, history.route_history(f))
    early = edges.where((F.col("snapshot_ts") <= F.lit(dt.datetime(2018, 1, 1, 19)).cast("timestamp_ntz")) & (F.col("src") == "AAA"))
    assert early.agg(F.max(F.abs("recent_delay_norm"))).first()[0] < 0.5
    target = snapshots.node_targets(f, nodes, snaps, (1, 2)).where((F.col("snapshot_ts") == F.lit(dt.datetime(2018, 1, 1, 18)).cast("timestamp_ntz")) & (F.col("node") == "BBB") & (F.col("horizon_h") == 2)).first()
    assert target["arr"] > 1e5 and target["pct"] == 1.0


def test_targets(spark):
    rows = [("AAA", 30.0, 20.0), ("AAA", 20.0, 10.0), ("AAA", 25.0, 15.0), ("AAA", 25.0, 12.0), ("BBB", 5.0, 2.0), ("BBB", 5.0, 3.0)]
    f = spark.createDataFrame(rows, "Dest string, ArrDelay double, DepDelay double").withColumn("arr_timestamp", F.lit(ts(1, 8)).cast("timestamp_ntz"))
    nodes = spark.createDataFrame([("AAA",), ("BBB",), ("CCC",)], "code string")
    snaps = spark.createDataFrame([(ts(1, 8),)], "snapshot_ts timestamp_ntz")
    got = {r["node"]: (r["arr"], r["dep"], r["pct"]) for r in snapshots.node_targets(f, nodes, snaps, (1,)).collect()}
    assert got == {"AAA": (25.0, 14.25, 1.0), "BBB": (5.0, 2.5, 0.0), "CCC": (0.0, 0.0, 0.0)}
    assert snapshots.node_targets(f, nodes, snaps, (1,), threshold=30.0).where("node = 'AAA'").first()["pct"] == 0.25


def test_weather_payload(spark):
    codes = [0, 1, 45, 51, 63, 71, 80, 95]
    good = json.dumps({"hourly": {"time": [f"2019-10-01T{h:02d}:00" for h in range(8)], "wind_speed_10m": [1.5] * 7 + ["x"], "wind_gusts_10m": [2] * 8, "precipitation": [0] * 8, "cloud_cover": [50] * 8, "weather_code": codes}})
    rows = scans.scan_weather_json(spark.createDataFrame([("AAA", good), ("BBB", "{}"), ("CCC", "broken")], "iata string, payload string")).orderBy("timestamp").collect()
    assert [r["weather_category"] for r in rows] == [0, 0, 1, 2, 2, 3, 2, 4]
    assert rows[0]["wind_speed_10m"] == 1.5 and rows[7]["wind_speed_10m"] is None
    assert spark.range(1).select(wmo_category(F.lit(None).cast("int"))).first()[0] == 0


def test_weather_window_and_point(spark):
    rows = [("AAA", ts(1, h), 10.0 + h, 15.0, 0.0, 50.0, 4 if 10 <= h <= 15 else 0) for h in range(24)]
    w = spark.createDataFrame(rows, "iata string, timestamp timestamp_ntz, wind_speed_10m double, wind_gusts_10m double, precipitation double, cloud_cover double, weather_category int")
    agg = weather.weather_window_agg(w, 6).where(F.col("snapshot_ts") == F.lit(ts(1, 18)).cast("timestamp_ntz")).first()
    assert (agg["h_precip_sum"], agg["h_cloud_mean"], agg["h_cat_4"]) == (0.0, 50.0, 1.0)
    grid = spark.createDataFrame([(ts(1, 12), "AAA"), (ts(1, 12), "ZZZ")], "snapshot_ts timestamp_ntz, node string")
    got = {r["node"]: r for r in weather.weather_point(w, grid, (1,)).collect()}
    assert got["AAA"]["wx_obs_cat_4"] == 1.0 and got["ZZZ"]["wx_obs_wind"] == 0.0
    off = weather.weather_window_agg(w, 6, ["wind"]).first()
    assert off["h_cloud_mean"] == 0.0 and off["h_wind_mean"] > 0
    assert weather.WEATHER_WIDTH(5) == 54


def test_predictions(spark):
    scored = spark.createDataFrame([(ts(1, 5), n, d, z) for n, d, z in (("AAA", [10.0, 20.0], [0.0, 2.0]), ("BBB", [5.0, 40.0], [-2.0, 0.0]), ("CCC", [99.0, 99.0], [0.0, 0.0]))], "snapshot_ts timestamp_ntz, node string, delays array<double>, logits array<double>")
    active = spark.createDataFrame([(ts(1, 5), "AAA", True), (ts(1, 5), "BBB", True), (ts(1, 5), "CCC", False)], "snapshot_ts timestamp_ntz, node string, active boolean")
    p = predictions.assemble_predictions(predictions.from_arrays(scored, [1, 4]), active)
    rows = {(r["airport_code"], r["horizon_h"]): r for r in p.collect()}
    assert len(rows) == 4 and rows["AAA", 1]["pct_arr_delayed_15"] == 0.5 and rows["AAA", 1]["target_ts"] == ts(1, 6)
    assert rows["AAA", 4]["pct_arr_delayed_15"] == pytest.approx(1 / (1 + 2.718281828459045**-2)) and rows["AAA", 4]["target_ts"] == ts(1, 9)
    assert predictions.assemble_predictions(predictions.from_arrays(scored.limit(0), [1, 4])).columns == predictions.PREDICTION_COLUMNS
    with pytest.raises(ValueError):
        scans.lookup_prediction(p, "AAA", 3)


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 10.0, 20.0, 1), (1, 20.0, 20.0, 1), (2, 0.0, 0.0, 0)], "horizon_h int, predicted_arr_delay_min double, actual_arr_delay_min double, actual_arr_del15 int").withColumns({"pct_arr_delayed_15": F.lit(0.6), "pct_target": F.lit(0.7)})
    m = metrics.metric_unified(rows).first()
    assert m["mae"] == pytest.approx(10 / 3) and m["accuracy"] == pytest.approx(2 / 3) and m["precision"] == 1.0 and m["recall"] == 0.5
    by = {r["horizon"]: r for r in metrics.metrics_by_horizon(rows).collect()}
    assert by["average"]["mae"] == pytest.approx(2.5) and by["2"]["r2"] == 0.0
    empty = metrics.metric_unified(rows.limit(0)).first()
    assert empty["mae"] == 0.0 and empty["accuracy"] == 0.0
    assert metrics.weighted_loss(rows, "mse").first()[0] == pytest.approx(200 / 3)


def test_sequences_and_splits(spark):
    snaps = spark.createDataFrame([(ts(1, h),) for h in range(20)], "snapshot_ts timestamp_ntz")
    seq = snapshots.sliding_sequences(snaps).orderBy("target_ts").collect()
    assert len(seq) == 15 and seq[0]["target_ts"] == ts(1, 5) and len(seq[0]["members"]) == 6
    assert snapshots.sliding_sequences(snaps.limit(3)).count() == 0
    got = {r["split"]: r["count"] for r in snapshots.split_by_ratio(snaps).groupBy("split").count().collect()}
    assert got == {"train": 14, "val": 3, "test": 3}


def test_missing_sources(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scans.scan_years(spark, str(tmp_path), [2018])


def test_contract_metadata():
    s = schema.flight_schema()
    assert s["ArrDelay"].metadata == {"availability": "actual"} and s["Origin"].metadata == {"availability": "schedule"}
