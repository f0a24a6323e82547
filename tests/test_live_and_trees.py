"""Closed windows in keyed state, sequences by halo ranges, and boosted trees against plain loops."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from transloom import streaming
from transloom.operators import predictions, snapshots, trees

T0 = datetime(2019, 9, 1)
TRIP = "Origin string, Dest string, timestamp timestamp_ntz, arr_timestamp timestamp_ntz, ArrDelay double"


def hour(h, minute=0):
    return T0 + timedelta(hours=h, minutes=minute)


def closed(trips, upto):
    """(node, bucket) -> features, by plain loops; hours that end by ``upto``."""
    cells = {}
    for origin, dest, dep, arr, late in trips:
        for node, at, arrival in ((dest, arr, True), (origin, dep, False)):
            cell = cells.setdefault((node, at.replace(minute=0)), [[], 0, 0, 0])
            if arrival:
                cell[1] += 1
                cell[2] += origin == "AAA"
                cell[0] += [late] if late is not None else []
            else:
                cell[3] += 1
    out, ring = {}, {}
    for (node, bucket), (late, a, t, n) in sorted(cells.items()):
        if bucket + timedelta(hours=1) > upto:
            continue
        mean = sum(late) / len(late) if late else None
        if late:
            ring[node] = [*ring.get(node, []), mean][-6:]
        r = ring.get(node, [])
        rolled = (np.mean(r), np.std(r, ddof=1) if len(r) > 1 else 0.0) if late else (None, None)
        out[node, bucket] = (mean, *rolled, a or None, t or None, n or None)
    return out


def test_windows_close_once_over_restarts(spark, tmp_path):
    rng = np.random.default_rng(1)
    trips = []
    for i in range(400):
        h = i // 10
        late = None if i % 17 == 0 else float(rng.integers(-20, 90))
        a, b = rng.choice(["AAA", "BBB", "CCC", "DDD"], 2, replace=False)
        trips.append((str(a), str(b), hour(h, i % 60), hour(h + 1, i % 60), late))
    # rows of neighbouring hours change files: out of order, but inside the delay
    order = sorted(range(400), key=lambda i: i // 10 + rng.uniform(0, 1.5))
    query = None
    for batch in range(4):
        part = [trips[i] for i in order[batch * 100 : (batch + 1) * 100]]
        spark.createDataFrame(part, TRIP).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streaming.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
        out = streaming.stream_features(stream, ["AAA"], "4 hours")
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        query.awaitTermination()  # and starts again from its checkpoint
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    upto = max(t[3] for t in trips) - timedelta(hours=4)
    wanted = closed(trips, upto)
    assert len(rows) == len({(r["node"], r["bucket"]) for r in rows}) == len(wanted)
    for r in rows:
        got = (r["arr_delay_mean"], r["rolling_mean"], r["rolling_std"], r["sched_arr_count"], r["sched_arr_from_top10"], r["sched_dep_count"])
        assert got == pytest.approx(wanted[r["node"], r["bucket"]], nan_ok=True)
    # open hours of the delay and a ring a node
    assert sum(op["numRowsTotal"] for op in query.recentProgress[-1]["stateOperators"]) < 4 * 10


@pytest.mark.parametrize("size", [1, 4, 64])
def test_halo_ranges_score_alike(spark, size):
    hours = [hour(h) for h in range(30) if h != 11]
    snaps = spark.createDataFrame([(h,) for h in hours], "snapshot_ts timestamp_ntz")
    rng = np.random.default_rng(2)
    x = {(h, n): float(rng.integers(0, 100)) for h in hours for n in "abc" if (h.hour, n) != (5, "b")}
    features = spark.createDataFrame([(h, n, v) for (h, n), v in x.items()], "snapshot_ts timestamp_ntz, node string, x double").repartition(5)
    sequences = snapshots.sliding_sequences(snaps)
    seen = []

    def scorer(rows):
        assert rows["snapshot_ts"].is_monotonic_increasing and list(rows.columns) == ["snapshot_ts", "node", "x"]
        return predictions.mean_scorer(rows)

    found = predictions.score_sequences(sequences, features, scorer, size).collect()
    for s in sequences.collect():
        for n in "abc":
            values = [x[m, n] for m in s["members"] if (m, n) in x]
            seen.append((s["target_ts"], n, round(sum(values) / len(values), 9)))
    assert sorted((r["snapshot_ts"], r["node"], round(r["delay"], 9)) for r in found) == sorted(seen)


def test_a_halo_copies_little(spark):
    """As many rows reach the ranges as there are snapshots, but for five a range."""
    snaps = spark.createDataFrame([(hour(h),) for h in range(640)], "snapshot_ts timestamp_ntz")
    sequences = snapshots.sliding_sequences(snaps)
    features = snaps.withColumns({"node": F.lit("a"), "x": F.lit(1.0)})
    assert predictions.score_sequences(sequences, features, predictions.mean_scorer).count() == 635
    numbered = sequences.select("members", (F.row_number().over(Window.orderBy("target_ts")) - 1).alias("nth"))
    dealt = numbered.select(F.floor(F.col("nth") / predictions.RANGE_TARGETS).alias("of"), F.explode("members").alias("at")).distinct()
    assert dealt.count() == 640 + 5 * 9 <= 1.1 * 640


def loops(x, y, count, depth, edges, rate, ridge, least):
    """Predictions of boosted trees by plain loops; x: rows of values (None: null)."""
    bins = [[0 if v is None else 1 + sum(v > e for e in edges[f]) for f, v in enumerate(row)] for row in x]
    start = sum(y) / len(y)
    out = [start] * len(y)
    for _ in range(count):
        residual = [t - p for t, p in zip(y, out, strict=True)]

        def grow(rows, level):
            total, n = sum(residual[i] for i in rows), len(rows)
            best = None
            for f in range(len(edges)):
                for b in sorted({bins[i][f] for i in rows})[:-1] if level < depth else []:
                    left = [i for i in rows if bins[i][f] <= b]
                    if min(len(left), n - len(left)) < least:
                        continue
                    s = sum(residual[i] for i in left)
                    gain = s**2 / (len(left) + ridge) + (total - s) ** 2 / (n - len(left) + ridge) - total**2 / (n + ridge)
                    if gain > 1e-9 * max(1.0, abs(total)) and (best is None or gain > best[0] * (1 + 1e-12)):
                        best = gain, f, b
            if best is None:
                for i in rows:
                    out[i] += rate * total / (n + ridge)
                return
            grow([i for i in rows if bins[i][best[1]] <= best[2]], level + 1)
            grow([i for i in rows if bins[i][best[1]] > best[2]], level + 1)

        grow(list(range(len(y))), 0)
    return out


def test_trees_equal_plain_loops(spark):
    rng = np.random.default_rng(3)
    x = [[int(rng.integers(0, 9)), float(rng.integers(0, 5)) if rng.random() > 0.1 else None, 4] for _ in range(300)]
    y = [float(3 * a * (b or 0) - (a > 4) * 7 + rng.integers(0, 3)) for a, b, _ in x]
    df = spark.createDataFrame([(i, *v, t) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id int, a int, b double, c int, y double").repartition(4)
    model = trees.fit_trees(df, ["a", "b", "c"], "y", trees=4, depth=3, bins=16, rate=0.5, ridge=1.0, least=5)
    edges = [v for _, v in trees.cuts(df, ["a", "b", "c"], 16).items()]
    assert edges == [list(range(8)), [0.0, 1.0, 2.0, 3.0], []]
    wanted = loops(x, y, 4, 3, edges, 0.5, 1.0, 5)
    again = trees.Trees.read(model.table(spark))
    for m in (model, again):
        got = {r["id"]: r["p"] for r in df.select("id", m.prediction().alias("p")).collect()}
        assert [got[i] for i in range(300)] == pytest.approx(wanted)


def test_trees_beat_a_line_on_held_out_rows(spark):
    from transloom.operators import tabular

    rng = np.random.default_rng(4)
    a, b = rng.uniform(-2, 2, 3000), rng.uniform(-2, 2, 3000)
    pdf = pd.DataFrame({"id": range(3000), "a": a, "b": b, "y": np.where(a > 0, b * b * 5, -3) + rng.normal(0, 0.3, 3000)})
    df = spark.createDataFrame(pdf).repartition(4)
    train = F.col("id") % 4 != 0
    model = trees.fit_trees(df.where(train), ["a", "b"], "y")
    error = lambda d, c: d.where(~train).agg(F.avg(F.pow(F.col(c) - F.col("y"), 2))).first()[0]
    assert error(df.withColumn("p", model.prediction()), "p") < 0.3 * error(tabular.tabular_regressor(df, ["a", "b"], "y", train), "prediction")


def test_odd_trees(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (1.0, 3.0), (1.0, 3.0), (2.0, None)], "a double, y double")
    model = trees.fit_trees(df, ["a"], "y", trees=1, depth=1, rate=1.0, ridge=0.0, least=1)
    assert [r["p"] for r in df.select(model.prediction().alias("p")).collect()] == [1.0, 1.0, 3.0, 3.0, 3.0]
    assert trees.fit_trees(df.limit(0), ["a"], "y").leaves == {}
    flat = trees.fit_trees(df.where("a = 1"), ["a"], "y")
    assert flat.splits == {} and flat.start == 3.0


def test_repeated_keys_go_after_the_shuffle(spark):
    """The tasks of the scan hold no table of keys: rows are dealt out first."""
    rows = spark.createDataFrame([(i % 7, float(i % 7)) for i in range(50)], "id int, x double")
    once = streaming.one_of_each(rows, rows.columns)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "HashAggregate" not in plan[plan.index("Exchange hashpartitioning") :]
    assert sorted(tuple(r) for r in once.collect()) == [(i, float(i)) for i in range(7)]


def test_a_stream_has_files_by_its_size(spark, monkeypatch, tmp_path):
    from transloom.plans import pipelines, queries

    trips = [(i, 1, "A", "B", datetime(2019, 9, 1 + i % 28), 100 * (i % 24), 100 * (i % 24), 1.0) for i in range(500)]
    flights = spark.createDataFrame(trips, "l_orderkey long, l_linenumber int, Origin string, Dest string, FlightDate date, CRSDepTime int, CRSArrTime int, ArrDelay double")
    monkeypatch.setattr(pipelines, "flights", lambda s, d: flights)
    monkeypatch.setattr(queries, "_folder", lambda s: str(tmp_path))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")  # as if each of the eight shuffle partitions were large
    try:
        base, _ = queries._stream_source(spark, "")
    finally:
        spark.conf.unset(name)
    assert len(list(tmp_path.glob("in/part-*.parquet"))) == 8 and spark.read.parquet(f"{base}/in").count() == 500
