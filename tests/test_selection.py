"""Quantiles by histograms and lookups in clustered predictions."""

import math
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from transloom.operators.selection import coarse_cell, exact_quantiles
from transloom.sources import clustered, scans, sinks


def test_quantiles_of_odd_groups_equal_the_built_in_ones(spark):
    rng = np.random.default_rng(3)
    rows = [("many", float(v)) for v in rng.lognormal(0, 40, 3000) * rng.choice([-1, 1], 3000)]
    rows += [("ties", float(v)) for v in rng.integers(-3, 3, 500)] + [("one", 7.0), ("none", None), (None, 1.0), (None, 2.0), ("two", -0.0), ("two", 0.0)]
    rows += [("close", 1.0 + k * 2.0**-52) for k in range(50)] + [("edge", v) for v in (math.inf, -math.inf, math.nan, 5e-324, -5e-324, 1.7e308, -1.7e308, 0.0)]
    df = spark.createDataFrame(rows, "key string, v double")
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    found = {r["key"]: r["quantiles"] for r in exact_quantiles(df, ["key"], "v", shares, buffered=0).collect()}
    wanted = {r["key"]: r["q"] for r in df.groupBy("key").agg(F.percentile("v", shares).alias("q")).collect() if r["q"] is not None}
    assert found.keys() == wanted.keys() and "none" not in found
    for key in wanted:
        assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(found[key], wanted[key], strict=True)), key
    for buffered in (0, 100_000):
        assert exact_quantiles(df.where("false"), ["key"], "v", shares, buffered=buffered).count() == 0
    few = {r["key"]: r["quantiles"] for r in exact_quantiles(df, ["key"], "v", shares).collect()}
    assert str(sorted(few.items(), key=str)) == str(sorted(wanted.items(), key=str))


def test_a_hot_group_with_a_million_values(spark):
    df = spark.range(0, 1_100_000, 1, 8).select(F.when(F.col("id") < 1_000_000, "hot").otherwise("cold").alias("key"), (F.pmod(F.col("id") * 7_368_787, F.lit(1_100_000)) / 3 + F.col("id") * 1e-7).alias("v"))
    found = {r["key"]: r["quantiles"] for r in exact_quantiles(df, ["key"], "v", [0.25, 0.9]).collect()}
    wanted = {r["key"]: r["q"] for r in df.groupBy("key").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.9))).alias("q")).collect()}
    assert found == wanted
    # what one task puts in order: the values of a fine cell, a small part of the group
    held = df.where("key = 'hot'").withColumn("c", coarse_cell(F.col("v"))).groupBy("c").agg(F.count("*").alias("n"))
    assert held.agg(F.max("n")).first()[0] < 30_000


def _rows_read(df):
    """Rows that the scans of a DataFrame give, by their metrics."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif plan.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(plan.plan())
        if plan.nodeName().startswith("Scan"):
            out += plan.metrics().get("numOutputRows").get().value()
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return out


def test_a_lookup_opens_one_file_and_few_of_its_rows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(f"A{a:02d}", h, float(a * 100 + t), 0.25, start + timedelta(hours=t + h), start + timedelta(hours=t)) for a in range(0, 40, 2) for h in (1, 2, 4) for t in range(400)]
    df = spark.createDataFrame(rows, sinks.PREDICTIONS)
    path = f"{tmp_path}/clustered"
    for _ in range(2):  # a second writing takes the place of the first
        clustered.write_clustered(df, path, file_rows=3000, page_rows=100)
    index = spark.read.parquet(f"{path}/index")
    assert index.count() > 4 and index.agg(F.sum("n")).first()[0] == len(rows) == spark.read.parquet(f"{path}/rows-*").count()
    for airport, h in (("a04 ", 4), ("A38", 1), ("A00", 2)):
        found = clustered.lookup_clustered(spark, path, airport, h)
        assert found.collect() == scans.lookup_prediction(df, airport, h).collect() and len(found.collect()) == 1
        assert len(found.inputFiles()) == 1 and 0 < _rows_read(found) <= 600
    # between two airports, before the first and behind the last
    for airport in ("A05", "000", "ZZZ"):
        found = clustered.lookup_clustered(spark, path, airport, 2)
        assert found.collect() == [] and found.columns == df.columns
    clustered.write_clustered(df.where("false"), path)
    assert clustered.lookup_clustered(spark, path, "A04", 4).count() == 0
