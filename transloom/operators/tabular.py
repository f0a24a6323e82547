"""The per-trip feature matrix and a distributed regressor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transloom.functions import cyclic
from transloom.sources.shared import cut

EXCLUDED = {"FlightDate", "DepDelay", "DepDel15", "ArrDel15", "Cancelled", "Diverted", "timestamp", "arr_timestamp", "ActualElapsedTime", "WheelsOff", "WheelsOn", "DepTime", "ArrTime"}


def temporal_features(flights: DataFrame) -> DataFrame:
    """month, day_of_week, is_weekend, sines and cosines of hour and weekday.

    Stored Month and DayOfWeek win; a stored 1..7 weekday keeps its own numbering, so is_weekend (>= 5) then
    marks Friday to Sunday.
    """
    if "Month" not in flights.columns:
        flights = flights.withColumn("month", F.month("FlightDate"))
    dow = F.col("DayOfWeek") if "DayOfWeek" in flights.columns else F.weekday("FlightDate")
    out = flights.withColumn("day_of_week", dow)
    out = out.withColumn("is_weekend", (F.col("day_of_week") >= 5).cast("int"))
    if "Hour" in out.columns:
        s, c = cyclic(F.col("Hour"), 24)
        out = out.withColumns({"hour_sin": s, "hour_cos": c})
    s, c = cyclic(F.col("day_of_week"), 7)
    return out.withColumns({"dow_sin": s, "dow_cos": c})


def fit_label_encoder(rows: DataFrame, column: str) -> DataFrame:
    """(value, code): index in sorted order of the distinct values.

    Values are range-partitioned and numbered inside their partition; only partition sizes are summed in one place.
    """
    values = rows.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    values = cut(values.repartitionByRange("value").select("value", F.spark_partition_id().alias("part")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over partitions
    first = values.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    return values.join(F.broadcast(first), "part").select("value", (F.col("first") + nth).cast("int").alias("code"))


def label_encode(rows: DataFrame, column: str, encoder: DataFrame, out: str | None = None) -> DataFrame:
    """Add the code of ``column``; -1 for values the encoder has not seen."""
    e = encoder.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    return rows.join(e, F.col(column).cast("string") == F.col("__value"), "left").withColumn(out or f"{column}_encoded", F.coalesce("__code", F.lit(-1))).drop("__value", "__code")


def fit_standard_scaler(rows: DataFrame, columns: list[str], fit_on: Column | None = None) -> DataFrame:
    """(feature, mean, std): population deviation, 1 for constants."""
    rows = rows if fit_on is None else rows.where(fit_on)
    one = lambda c: F.when(F.coalesce(F.stddev_pop(c), F.lit(0.0)) > 0, F.stddev_pop(c)).otherwise(1.0)
    agg = rows.agg(*[F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), one(c).alias("std")).alias(f"s{i}") for i, c in enumerate(columns)])
    return agg.select(F.explode(F.array(*[f"s{i}" for i in range(len(columns))])).alias("s")).select("s.*")


def standard_scale(rows: DataFrame, columns: list[str], scaler: DataFrame) -> DataFrame:
    from transloom.operators.snapshots import normalize_features

    return normalize_features(rows, scaler, columns)


def select_feature_columns(rows: DataFrame, target: str) -> list[str]:
    """Numeric columns without the target and what is known only afterwards."""
    return [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != target and f.name not in EXCLUDED]


def feature_matrix(flights: DataFrame, categorical: list[str], numeric: list[str], fit_on: Column | None = None) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(features, encoders, scaler): temporal features, encoded categories, scaled numbers."""
    rows = temporal_features(flights)
    seen = rows if fit_on is None else rows.where(fit_on)
    encoders = {c: fit_label_encoder(seen, c) for c in categorical}
    for c, e in encoders.items():
        rows = label_encode(rows, c, e)
    scaler = fit_standard_scaler(rows, numeric, fit_on)
    return standard_scale(rows, numeric, scaler), encoders, scaler


def tabular_regressor(rows: DataFrame, features: list[str], target: str = "ArrDelay", train: Column | None = None, ridge: float = 0.01) -> DataFrame:
    """Rows with a linear prediction of ``target``, fitted distributedly on the training rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    data = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(rows)
    model = LinearRegression(featuresCol="__x", labelCol=target, predictionCol="prediction", regParam=ridge, solver="normal").fit(data if train is None else data.where(train))
    return model.transform(data).drop("__x")
