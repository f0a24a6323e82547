"""Accuracy metrics and losses as single-pass aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transloom.functions import bce_with_logits, clamp, horizon_weight, huber, sigmoid
from transloom.operators.predictions import decile


def _ratio(a: Column, b: Column, least: float = 1.0) -> Column:
    return a / F.greatest(b.cast("double"), F.lit(least))


def regression(p: Column, y: Column) -> dict[str, Column]:
    """MAE, RMSE, MAPE (denominator at least 1) and R2 (0 for a constant target); 0 over no rows."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = F.var_pop(y) * F.count(y)
    return {
        "mae": zero(F.avg(F.abs(p - y))), "rmse": zero(F.sqrt(F.avg((p - y) * (p - y)))), "mape": zero(F.avg(F.abs(p - y) / F.greatest(F.abs(y), F.lit(1.0))) * 100),
        "r2": zero(F.when(total > 0, 1 - F.sum((p - y) * (p - y)) / total)),
    }


def classification(p: Column, y: Column, prefix: str = "") -> dict[str, Column]:
    """Accuracy, precision, recall and F1 of boolean columns, with guarded denominators."""
    tp, fp, fn, tn = (F.count_if(a & b) for a, b in ((p, y), (p, ~y), (~p, y), (~p, ~y)))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return {f"{prefix}accuracy": _ratio(tp + tn, tp + tn + fp + fn), f"{prefix}precision": precision, f"{prefix}recall": recall, f"{prefix}f1": 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-8))}


def _delay_classes(rows: DataFrame, threshold: float) -> dict[str, Column]:
    return classification(F.col("predicted_arr_delay_min") >= threshold, F.col("actual_arr_delay_min") >= threshold)


def metric_regression(rows: DataFrame) -> DataFrame:
    return rows.agg(*[c.alias(k) for k, c in regression(F.col("predicted_arr_delay_min"), F.col("actual_arr_delay_min")).items()])


def metric_classification(rows: DataFrame, threshold: float = 15.0) -> DataFrame:
    return rows.agg(*[c.alias(k) for k, c in _delay_classes(rows, threshold).items()])


def bce_classes(threshold: float = 0.5, target: float = 0.5) -> dict[str, Column]:
    return classification(F.col("pct_arr_delayed_15") >= threshold, F.col("pct_target") >= target, "bce_")


def metric_bce_classification(rows: DataFrame, threshold: float = 0.5, target: float = 0.5) -> DataFrame:
    return rows.agg(*[c.alias(k) for k, c in bce_classes(threshold, target).items()])


def unified(rows: DataFrame, threshold: float = 15.0, bce: bool = True) -> dict[str, Column]:
    return regression(F.col("predicted_arr_delay_min"), F.col("actual_arr_delay_min")) | _delay_classes(rows, threshold) | (bce_classes() if bce else {})


def metric_unified(rows: DataFrame, threshold: float = 15.0, bce: bool = True) -> DataFrame:
    return rows.agg(*[c.alias(k) for k, c in unified(rows, threshold, bce).items()])


def metrics_by_horizon(rows: DataFrame, threshold: float = 15.0, bce: bool = True) -> DataFrame:
    """One row a horizon and ``average``: the unweighted mean over horizons."""
    m = unified(rows, threshold, bce)
    by = rows.groupBy(F.col("horizon_h").cast("string").alias("horizon")).agg(*[c.alias(k) for k, c in m.items()])
    # each horizon's row also counts for the average, so the input is aggregated once; the empty row keeps
    # ``average`` where there are no rows
    labels = F.explode(F.array("horizon", F.lit("average"))).alias("horizon")
    none = rows.sparkSession.createDataFrame([("average",)], "horizon string").select("horizon", *[F.lit(None).cast("double").alias(k) for k in m])
    both = by.select(labels, *m).unionByName(none).groupBy("horizon")
    zero = F.when(F.col("horizon") == "average", 0.0)
    return both.agg(*[F.avg(k).alias(k) for k in m]).select("horizon", *[F.coalesce(F.col(k), zero).alias(k) for k in m])


def mae_by_horizon(rows: DataFrame) -> DataFrame:
    return rows.groupBy("horizon_h").agg(F.avg(F.abs(F.col("predicted_arr_delay_min") - F.col("actual_arr_delay_min"))).alias("mae"))


def _weights(y: Column, horizons: Sequence[int] | None, weights: Sequence[float] | None, threshold: float, high: float) -> Column:
    return F.when(F.abs(y) >= threshold, high).otherwise(1.0) * (horizon_weight(F.col("horizon_h"), horizons, weights) if weights else F.lit(1.0))


def weighted_loss(rows: DataFrame, kind: str = "mse", horizons: Sequence[int] | None = None, weights: Sequence[float] | None = None, threshold: float = 15.0, high: float = 2.0, delta: float = 10.0) -> DataFrame:
    """Mean of the squared or Huber error, weighted by delay and horizon."""
    y = F.col("actual_arr_delay_min")
    e = F.col("predicted_arr_delay_min") - y
    point = e * e if kind == "mse" else huber(e, delta)
    return rows.agg(F.avg(_weights(y, horizons, weights, threshold, high) * point).alias("loss"))


def multi_task_loss(rows: DataFrame, horizons: Sequence[int] | None = None, weights: Sequence[float] | None = None, main: float = 1.0, aux: float = 0.3, bce: float = 0.5, threshold: float = 15.0, high: float = 2.0, delta: float = 10.0, pos_weight: float = 1.0) -> DataFrame:
    """Components and total; rows: horizon_h, (pred, target) of arr and dep, logit, pct."""
    if main + aux + bce <= 0:
        raise ValueError("at least one weight must be positive")
    hw = horizon_weight(F.col("horizon_h"), horizons, weights) if weights else F.lit(1.0)
    part = lambda p, y: F.avg(_weights(F.col(y), horizons, weights, threshold, high) * huber(F.col(p) - F.col(y), delta))
    out = rows.agg(part("arr_pred", "arr").alias("arr_huber"), part("dep_pred", "dep").alias("dep_huber"), F.avg(hw * bce_with_logits(F.col("logit"), clamp(F.col("pct"), 0.0, 1.0), pos_weight)).alias("pct_bce"))
    return out.withColumn("total", main * F.col("arr_huber") + aux * F.col("dep_huber") + bce * F.col("pct_bce"))


def calibration_deciles(rows: DataFrame) -> DataFrame:
    """Predicted against observed rate by decile of the predicted probability."""
    p = F.col("pct_arr_delayed_15")
    return rows.groupBy(decile(p).alias("decile")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted_rate"), F.avg(F.col("actual_arr_del15").cast("double")).alias("observed_rate"))


def error_histogram(rows: DataFrame, bins: int = 100, span: tuple[float, float] | None = None) -> DataFrame:
    """Equal-width histogram of prediction minus actual, with the mean error.

    Bins cover the errors, or ``span`` if given; the largest error, and what lies beyond a span, is in the outer bins.
    """
    e = rows.select((F.col("predicted_arr_delay_min") - F.col("actual_arr_delay_min")).alias("e")).where("e is not null")
    lo, hi = (F.min("e"), F.max("e")) if span is None else map(F.lit, map(float, span))
    one = e.agg(lo.alias("lo"), hi.alias("hi"), F.avg("e").alias("mean_error"))  # one row
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    at = F.floor((F.col("e") - F.col("lo")) / width)
    b = e.crossJoin(F.broadcast(one)).withColumn("bin", F.greatest(F.least(at, F.lit(bins - 1)), F.lit(0)).cast("int"))
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.max("mean_error").alias("mean_error"))


def sample_points(rows: DataFrame, n: int = 5000, key: Sequence[str] = ("airport_code", "horizon_h", "prediction_ts")) -> DataFrame:
    """At most ``n`` (predicted, actual) points, chosen by a digest of the key."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    return rows.orderBy(digest, *key).limit(n).select("predicted_arr_delay_min", "actual_arr_delay_min")


def champion_challenger(champion: DataFrame, challenger: DataFrame, metric: str = "mae", least: float = 0.02) -> DataFrame:
    """Promote the challenger if it lowers the champion's metric by the least relative gain."""
    j = champion.select(F.col(metric).alias("champion")).crossJoin(challenger.select(F.col(metric).alias("challenger")))
    gain = F.when(F.col("champion") > 0, (F.col("champion") - F.col("challenger")) / F.col("champion")).otherwise(0.0)
    return j.withColumn("gain", gain).withColumn("promote", F.col("gain") >= least)
