"""Scoring, assembly and enrichment of predictions."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transloom.functions import add_hours, clamp, floor_bucket, sigmoid
from transloom.operators.history import wide_lookup

PREDICTION_COLUMNS = ["airport_code", "horizon_h", "predicted_arr_delay_min", "pct_arr_delayed_15", "target_ts", "prediction_ts"]
ACTUAL_COLUMNS = ["actual_arr_delay_min", "actual_arr_del15", "pct_target"]
SCORED = "snapshot_ts timestamp_ntz, node string, horizon_h int, delay double, logit double"


#: Targets of a range; a range also gets the snapshots before it that its first sequences reach back to.
RANGE_TARGETS = 64
#: Snapshots whose small tables (times only) are broadcast; more are joined.
BROADCAST_SNAPSHOTS = 1_000_000


def score_sequences(sequences: DataFrame, features: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], range_targets: int = RANGE_TARGETS) -> DataFrame:
    """Run a user's scorer on the whole network of each sequence.

    The scorer gets the rows (snapshot_ts, node, features) of a sequence's members, oldest first, and returns
    (node, horizon_h, delay, logit); it runs once for each target snapshot, in parallel. A sequence is made of the snapshots from
    its least to its largest member.

    Targets are dealt into ranges of consecutive ones, and snapshots go to the range of their targets with a halo: only those
    that the first sequences of the next range reach back to travel twice. A range is read once in the order of time, with
    the members of one sequence in memory.
    """
    nth = F.row_number().over(Window.orderBy("target_ts")) - 1  # over snapshots, not over their rows
    numbered = sequences.select("target_ts", "members", F.floor(nth / range_targets).cast("int").alias("__range"))
    shape = sequences.agg(F.count("*").alias("n"), F.max(F.size("members")).alias("longest")).first()
    longest = shape["longest"] or 1
    needed = numbered.select("__range", F.explode("members").alias("snapshot_ts")).distinct()
    ends = numbered.groupBy("__range", F.array_max("members").alias("snapshot_ts")).agg(F.collect_list(F.struct("target_ts", F.array_min("members").alias("first"))).alias("__targets"))
    times = needed.join(ends, ["__range", "snapshot_ts"], "left")
    if shape["n"] <= BROADCAST_SNAPSHOTS:
        times = F.broadcast(times)
    rows = features.join(times, "snapshot_ts").repartition("__range").sortWithinPartitions("__range", "snapshot_ts", "node")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ring: deque[tuple[pd.Timestamp, pd.DataFrame]] = deque(maxlen=longest)
        of, parts = None, []

        def close() -> Iterator[pd.DataFrame]:
            if not parts:
                return
            whole = pd.concat(parts, ignore_index=True)
            ring.append((of[1], whole.drop(columns=["__range", "__targets"])))
            for target in whole["__targets"].iloc[0] if whole["__targets"].iloc[0] is not None else []:
                members = [frame for at, frame in ring if at >= pd.Timestamp(target["first"])]
                out = scorer(pd.concat(members, ignore_index=True))
                yield pd.DataFrame({"snapshot_ts": pd.Timestamp(target["target_ts"]), "node": out["node"], "horizon_h": out["horizon_h"].astype("int32"), "delay": out["delay"].astype(float), "logit": out["logit"].astype(float)})

        for frame in frames:
            for key, part in frame.groupby(["__range", "snapshot_ts"], sort=False):
                if key != of:
                    yield from close()
                    if of is None or key[0] != of[0]:
                        ring.clear()
                    of, parts = key, []
                parts.append(part)
        yield from close()

    return rows.mapInPandas(run, SCORED)


def mean_scorer(group: pd.DataFrame) -> pd.DataFrame:
    """A plain scorer for one horizon: the mean of feature ``x`` over the sequence."""
    delay = group.groupby("node", as_index=False)["x"].mean().rename(columns={"x": "delay"})
    return delay.assign(horizon_h=1, logit=0.0)


def recent_scorer(horizons: Sequence[int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A plain scorer of sequences: feature ``x`` of the last member up to two hours ahead, its mean over the sequence beyond."""

    def score(group: pd.DataFrame) -> pd.DataFrame:
        by = group.groupby("node", as_index=False)["x"].agg(["last", "mean"])
        out = by.merge(pd.DataFrame({"horizon_h": list(horizons)}), how="cross")
        delay = out["last"].where(out["horizon_h"] <= 2, out["mean"])
        return out.assign(delay=delay, logit=(delay - 15) / 10)

    return score


def persistence_scorer(grid: DataFrame, rolled: DataFrame, horizons: Sequence[int], window: int = 1) -> DataFrame:
    """The default scorer, as a projection of ``history.rolling_node``: last hour's mean delay now, fading to the rolling mean by horizon."""
    rows = wide_lookup(grid, rolled, [(-window, "arr_delay_mean", "last"), (-window, "rolling_mean", "mean")])
    rows = rows.select("snapshot_ts", "node", "last", "mean", F.explode(F.array(*map(F.lit, horizons))).alias("horizon_h"))
    delay = F.when(F.col("horizon_h") <= 2, F.col("last")).otherwise(F.col("mean"))
    return rows.select("snapshot_ts", "node", "horizon_h", delay.alias("delay"), ((delay - 15) / 10).alias("logit"))


def assemble_predictions(scored: DataFrame, active: DataFrame | None = None, known: DataFrame | None = None, reference_ts: Column | None = None) -> DataFrame:
    """Long rows of the canonical columns, for active and known nodes only; no rows keep the schema."""
    if active is not None:
        scored = scored.join(active.where("active").select("snapshot_ts", "node"), ["snapshot_ts", "node"], "left_semi")
    if known is not None:
        scored = scored.join(F.broadcast(known.select(F.col("code").alias("node"))), "node", "left_semi")
    ts = F.col("snapshot_ts") if reference_ts is None else reference_ts.cast("timestamp_ntz")
    return scored.select(
        F.col("node").alias("airport_code"), "horizon_h", F.col("delay").alias("predicted_arr_delay_min"), sigmoid(F.col("logit")).alias("pct_arr_delayed_15"), add_hours(ts, F.col("horizon_h")).alias("target_ts"), ts.alias("prediction_ts")
    )


def from_arrays(scored: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """(snapshot_ts, node, delays array, logits array) to one row a horizon."""
    h = F.element_at(F.array(*map(F.lit, horizons)), F.col("i") + 1)
    return scored.select("snapshot_ts", "node", F.posexplode(F.arrays_zip("delays", "logits")).alias("i", "x")).select("snapshot_ts", "node", h.alias("horizon_h"), F.col("x.delays").alias("delay"), F.col("x.logits").alias("logit"))


def align_actuals(predictions: DataFrame, targets: DataFrame) -> DataFrame:
    """Attach the actual delay, its 15-minute flag and the delayed share."""
    t = targets.select(F.col("node").alias("airport_code"), F.col("snapshot_ts").alias("prediction_ts"), "horizon_h", F.col("arr").alias("actual_arr_delay_min"), (F.col("arr") >= 15).cast("int").alias("actual_arr_del15"), F.col("pct").alias("pct_target"))
    return predictions.join(t, ["airport_code", "prediction_ts", "horizon_h"]).select(*PREDICTION_COLUMNS, *ACTUAL_COLUMNS)


def join_pred_schedule(predictions: DataFrame, fact: DataFrame) -> DataFrame:
    """Scheduled volume at the target hour; 0 where there is none."""
    f = fact.select("airport_code", F.col("ts_hour").alias("__hour"), "sched_arr", "sched_dep")
    j = predictions.withColumn("__hour", floor_bucket(F.col("target_ts"), 1)).join(f, ["airport_code", "__hour"], "left").drop("__hour")
    return j.na.fill(0, ["sched_arr", "sched_dep"])


def join_pred_baseline(predictions: DataFrame, baseline: DataFrame) -> DataFrame:
    """The usual volume of the airport, weekday and hour of the target."""
    b = baseline.select("airport_code", F.col("day_of_week").alias("dow"), "hour", "baseline_sched_arr")
    p = predictions.withColumns({"dow": F.weekday("target_ts"), "hour": F.hour("target_ts")})
    return p.join(b, ["airport_code", "dow", "hour"], "left")


def with_volume_measures(rows: DataFrame) -> DataFrame:
    """Expected delayed flights, and traffic against the usual (null without a positive baseline)."""
    usual = F.col("baseline_sched_arr")
    return rows.withColumns({"expected_delayed_flights": F.col("pct_arr_delayed_15") * F.col("sched_arr"), "traffic_vs_usual": F.when(usual > 0, F.col("sched_arr") / usual - 1)})


def enrich_predictions(predictions: DataFrame, fact: DataFrame, baseline: DataFrame) -> DataFrame:
    return with_volume_measures(join_pred_baseline(join_pred_schedule(predictions, fact), baseline))


def hourly_schedule_counts(schedule: DataFrame, code: str, ts: str) -> DataFrame:
    return schedule.where(F.col(code).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(code).alias("airport_code"), F.col(ts).alias("ts_hour")).agg(F.count("*").alias("n"))


def join_pred_live_counts(predictions: DataFrame, schedule: DataFrame) -> DataFrame:
    """Counts of the live schedule at the target hour, and rounded expected delayed flights."""
    out = predictions.withColumn("ts_hour", floor_bucket(F.col("target_ts"), 1))
    for code, ts, name in (("Dest", "arr_timestamp", "sched_arr_count"), ("Origin", "timestamp", "sched_dep_count")):
        out = out.join(hourly_schedule_counts(schedule, code, ts).withColumnRenamed("n", name), ["airport_code", "ts_hour"], "left").na.fill(0, [name])
    return out.withColumn("expected_delayed_flights", F.round(F.col("pct_arr_delayed_15") * F.col("sched_arr_count"), 2)).drop("ts_hour")


def latest_per_key(predictions: DataFrame) -> DataFrame:
    """The newest prediction of each airport and horizon."""
    w = Window.partitionBy("airport_code", "horizon_h").orderBy(F.desc("prediction_ts"))
    return predictions.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def prediction_summary(predictions: DataFrame) -> DataFrame:
    p = F.col("predicted_arr_delay_min")
    return predictions.groupBy("horizon_h").agg(F.avg(p).alias("mean_delay"), F.min(p).alias("min_delay"), F.max(p).alias("max_delay"), F.count_distinct("airport_code").alias("airports"))


def order_predictions(predictions: DataFrame) -> DataFrame:
    return predictions.orderBy("prediction_ts", "airport_code", "horizon_h")


def status_badge(rows: DataFrame, busy_traffic: float = 0.2, busy_share: float = 0.3, disrupted_share: float = 0.5) -> DataFrame:
    traffic, p = F.coalesce("traffic_vs_usual", F.lit(0.0)), F.coalesce("pct_arr_delayed_15", F.lit(0.0))
    return rows.withColumn("status", F.when(p >= disrupted_share, "Disrupted").when((traffic >= busy_traffic) | (p >= busy_share), "Busy").otherwise("Calm"))


def decile(p: Column) -> Column:
    return clamp(F.floor(p * 10) + 1, 1, 10).cast("int")
