"""What is moved or kept stays in proportion: plans and tables of operators that run on large trip tables."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from transloom.operators import network, trees


def test_trips_are_not_shuffled_by_their_ends(spark):
    flights = spark.range(1000).select(F.format_string("A%02d", F.col("id") % 5).alias("Origin"), F.format_string("A%02d", F.col("id") % 3).alias("Dest"))
    kept = network.filter_network(flights, spark.createDataFrame([("A00",), ("A01",)], "code string"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "Exchange hashpartitioning" not in plan
    assert kept.count() == sum(i % 5 < 2 and i % 3 < 2 for i in range(1000))


def test_trees_learn_from_cells(spark, monkeypatch):
    """Four values of one feature and two of the other: eight cells, whatever the number of rows."""
    sizes = []

    def cut(df):
        sizes.append(df.count())
        return df.localCheckpoint()

    monkeypatch.setattr(trees, "cut", cut)
    df = spark.range(2000).select((F.col("id") % 4).alias("a"), (F.floor(F.col("id") / 4) % 2).alias("b"), (F.col("id") % 8 * 3 % 7).cast("double").alias("y"))
    model = trees.fit_trees(df, ["a", "b"], "y", trees=3, rate=1.0, ridge=0.0)
    assert set(sizes) == {8} and model.leaves
    off = model.predict(df).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert off == pytest.approx(0, abs=1e-9)


def test_a_failed_batch_writes_a_file_an_hour(spark, monkeypatch, tmp_path):
    from transloom.plans import pipelines, queries

    trips = [(i, 1 + i % 2, "A", "B", datetime(2019, 9, 1), 100 * (i % 6), 100 * (i % 6), 1.0) for i in range(600)]
    flights = spark.createDataFrame(trips, "l_orderkey long, l_linenumber int, Origin string, Dest string, FlightDate date, CRSDepTime int, CRSArrTime int, ArrDelay double").repartition(5)
    monkeypatch.setattr(pipelines, "flights", lambda s, d: flights)
    monkeypatch.setattr(queries, "_folder", lambda s: str(tmp_path))
    rows = queries._committed(spark, "").collect()
    assert len(rows) == 6 and all(r["same"] for r in rows)
    files = list(tmp_path.glob("landing/y=*/m=*/d=*/h=*/batch=2/part-*.parquet"))
    assert len(files) == len({os.path.dirname(f) for f in files}) == 3
