"""Per-hour series of airports and routes, and what is read from them by time shift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transloom.functions import add_hours, clamp, floor_bucket
from transloom.operators.network import top10_origins

LAGS = (1, 3, 6, 24)
ROLLING_HOURS = 6
SCHEDULE_SERIES = ("sched_arr_count", "sched_dep_count", "sched_arr_from_top10", "sched_arr_mean_distance")


def with_buckets(flights: DataFrame, window: int = 1) -> DataFrame:
    return flights.withColumns({"arr_bucket": floor_bucket(F.col("arr_timestamp"), window), "dep_bucket": floor_bucket(F.col("timestamp"), window)})


def history_arr_delay(f: DataFrame) -> DataFrame:
    return f.where("ArrDelay is not null").groupBy(F.col("Dest").alias("node"), F.col("arr_bucket").alias("bucket")).agg(F.avg("ArrDelay").alias("arr_delay_mean"))


def sched_arr(f: DataFrame) -> DataFrame:
    """(node, bucket, sched_arr_count, sched_arr_mean_distance)."""
    distance = F.avg("Distance") if "Distance" in f.columns else F.lit(None).cast("double")
    return f.groupBy(F.col("Dest").alias("node"), F.col("arr_bucket").alias("bucket")).agg(F.count("*").alias("sched_arr_count"), distance.alias("sched_arr_mean_distance"))


def arrival_cells(f: DataFrame, top: DataFrame | None = None, threshold: float = 15.0) -> DataFrame:
    """(node, bucket, ...): all that is known by destination and arrival hour, in one pass over the trips.

    Mean delays at both ends, share of late arrivals, scheduled arrivals and their mean distance and, with ``top``
    (code), arrivals from those origins (null where there are none). Cells number nodes x hours.
    """
    x, extra = F.col("ArrDelay"), []
    mean = lambda c: F.avg(c) if c in f.columns else F.lit(None).cast("double")
    if top is not None:
        f = f.join(F.broadcast(top.select(F.col("code").alias("__top"))), F.col("Origin") == F.col("__top"), "left")
        extra = [F.nullif(F.count("__top"), F.lit(0)).alias("sched_arr_from_top10")]
    return f.groupBy(F.col("Dest").alias("node"), F.col("arr_bucket").alias("bucket")).agg(
        F.avg(x).alias("arr_delay_mean"),
        mean("DepDelay").alias("dep_delay_mean"),
        F.avg((x >= threshold).cast("double")).alias("late_share"),
        F.count("*").alias("sched_arr_count"),
        mean("Distance").alias("sched_arr_mean_distance"),
        *extra,
    )


def sched_dep_count(f: DataFrame) -> DataFrame:
    return f.groupBy(F.col("Origin").alias("node"), F.col("dep_bucket").alias("bucket")).agg(F.count("*").alias("sched_dep_count"))


def sched_arr_from_top10(f: DataFrame) -> DataFrame:
    top = top10_origins(f)
    some = f.join(F.broadcast(top.select(F.col("code").alias("__top"))), F.col("Origin") == F.col("__top"), "left_semi")
    return some.groupBy(F.col("Dest").alias("node"), F.col("arr_bucket").alias("bucket")).agg(F.count("*").alias("sched_arr_from_top10"))


def route_arr_delay(f: DataFrame) -> DataFrame:
    return f.where("ArrDelay is not null").groupBy(F.col("Origin").alias("src"), F.col("Dest").alias("dst"), F.col("arr_bucket").alias("bucket")).agg(F.avg("ArrDelay").alias("route_arr_delay"))


def route_sched_count(f: DataFrame) -> DataFrame:
    return f.groupBy(F.col("Origin").alias("src"), F.col("Dest").alias("dst"), F.col("dep_bucket").alias("bucket")).agg(F.count("*").alias("route_sched_count"))


def _frame(keys: list[str | Column], steps: int, by_time: int | None):
    w = Window.partitionBy(*keys)
    if by_time is None:
        return w.orderBy("bucket").rowsBetween(-(steps - 1), 0)
    return w.orderBy(F.unix_seconds(F.col("bucket").cast("timestamp"))).rangeBetween(-(steps - 1) * 3600 * by_time, 0)


def rolling_node(series: DataFrame, window: int = 1, squeeze_gaps: bool = True) -> DataFrame:
    """Rolling mean and sample deviation (0 for a single value) over the last buckets that have a delay.

    Gaps are squeezed unless ``squeeze_gaps`` is false: then the frame is a span of time. Buckets without a delay
    are no part of any frame and have no rolling values.
    """
    has = F.col("arr_delay_mean").isNotNull()
    w = _frame(["node", has], max(1, ROLLING_HOURS // max(1, window)), None if squeeze_gaps else window)
    deviation = F.when(has, F.coalesce(F.stddev_samp("arr_delay_mean").over(w), F.lit(0.0)))
    return series.withColumns({"rolling_mean": F.avg("arr_delay_mean").over(w), "rolling_std": deviation})


def rolling_route(series: DataFrame, window: int = 1) -> DataFrame:
    w = _frame(["src", "dst"], max(1, ROLLING_HOURS // max(1, window)), None)
    return series.withColumn("route_recent_arr_delay", F.avg("route_arr_delay").over(w))


def node_history(f: DataFrame, window: int = 1) -> DataFrame:
    """All node series in one table (node, bucket, ...): one aggregate by arrival and one by departure, joined."""
    arrivals = rolling_node(arrival_cells(f, top10_origins(f)).drop("dep_delay_mean", "late_share"), window)
    return arrivals.join(sched_dep_count(f), ["node", "bucket"], "full_outer")


def route_history(f: DataFrame, window: int = 1) -> DataFrame:
    return rolling_route(route_arr_delay(f), window).join(route_sched_count(f), ["src", "dst", "bucket"], "full_outer")


def series_lookup(grid: DataFrame, series: DataFrame, value: str, hours: int = 0, out: str | None = None, keys: tuple[str, ...] = ("node",)) -> DataFrame:
    """Left join of ``value`` at snapshot_ts + hours; 0 on a miss."""
    at = series.select(*[F.col(k) for k in keys], add_hours(F.col("bucket"), -hours).alias("snapshot_ts"), F.col(value).cast("double").alias("__v"))
    joined = grid.join(at, [*keys, "snapshot_ts"], "left")
    return joined.withColumn(out or value, F.coalesce("__v", F.lit(0.0))).drop("__v")


Pick = tuple[int, str, str]


def wide_lookup(grid: DataFrame, series: DataFrame, picks: Sequence[Pick], keys: tuple[str, ...] = ("node",)) -> DataFrame:
    """Add a column for each pick (hours after the snapshot, value of ``series``, output); 0 on a miss.

    Every row of the series is dealt once to the snapshots that ask for it, whatever the number of picks; one
    grouped maximum and one join follow.
    """
    shifts = sorted({hours for hours, _, _ in picks})
    values = list(dict.fromkeys(value for _, value, _ in picks))
    long = series.select(*keys, "bucket", *values, F.explode(F.array(*map(F.lit, shifts))).alias("__shift"))
    long = long.withColumn("snapshot_ts", add_hours(F.col("bucket"), -F.col("__shift")))
    cells = [F.max(F.when(F.col("__shift") == hours, F.col(value).cast("double"))).alias(out) for hours, value, out in picks]
    wide = long.groupBy(*keys, "snapshot_ts").agg(*cells)
    return grid.join(wide, [*keys, "snapshot_ts"], "left").na.fill(0.0, [out for _, _, out in picks])


def lag_picks(window: int = 1, lags: tuple[int, ...] = LAGS) -> list[Pick]:
    """Mean arrival delay k windows before each snapshot."""
    return [(-k * window, "arr_delay_mean", f"d_lag_{k}") for k in lags]


def rolling_picks(window: int = 1) -> list[Pick]:
    return [(-window, "rolling_mean", "e_rolling_mean"), (-window, "rolling_std", "e_rolling_std")]


def horizon_picks(horizons: tuple[int, ...], window: int = 1) -> list[Pick]:
    """The four schedule series at the start of each horizon's window, one set of columns a horizon."""
    return [((h - 1) * window, v, f"g{h}_{v}") for h in horizons for v in SCHEDULE_SERIES]


def lag_lookup(grid: DataFrame, series: DataFrame, window: int = 1, lags: tuple[int, ...] = LAGS) -> DataFrame:
    return wide_lookup(grid, series, lag_picks(window, lags))


def rolling_lookup(grid: DataFrame, rolled: DataFrame, window: int = 1) -> DataFrame:
    return wide_lookup(grid, rolled, rolling_picks(window))


def horizon_lookup(grid: DataFrame, history: DataFrame, horizons: tuple[int, ...], window: int = 1) -> DataFrame:
    return wide_lookup(grid, history, horizon_picks(horizons, window))


def edge_dynamic(edges: DataFrame, snapshots: DataFrame, routes: DataFrame, window: int = 1, delay_norm: float = 60.0, count_norm: float = 50.0) -> DataFrame:
    """(edge, snapshot) with the route's recent delay and next scheduled trips, scaled and clipped."""
    # every edge at every snapshot; Spark broadcasts the smaller side only if it knows its size to be small
    grid = snapshots.select("snapshot_ts").crossJoin(edges.select("edge_id", "src", "dst"))
    grid = wide_lookup(grid, routes, [(-window, "route_recent_arr_delay", "recent"), (0, "route_sched_count", "sched")], ("src", "dst"))
    return grid.select("edge_id", "src", "dst", "snapshot_ts", clamp(F.col("recent") / delay_norm, -1.0, 1.0).alias("recent_delay_norm"), clamp(F.col("sched") / count_norm, 0.0, 1.0).alias("sched_next_norm"))
