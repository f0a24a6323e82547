"""Weather features of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transloom.functions import N_WEATHER_CATEGORIES, add_hours, floor_bucket, one_hot

GROUPS = ("wind", "precip_cloud", "category")
#: Names of configurations and the group each switches on.
ALIASES = {
    "wind": "wind",
    "wind_gust": "wind",
    "precip": "precip_cloud",
    "precip_cloud": "precip_cloud",
    "cloud": "precip_cloud",
    "category": "category",
    "weather_code": "category",
}


def enabled_groups(names: list[str] | None) -> set[str]:
    """Feature groups behind names and aliases; None means all. Unknown names are an error, not a silent switch-off."""
    if names is None:
        return set(GROUPS)
    unknown = sorted(set(names) - ALIASES.keys())
    if unknown:
        raise ValueError(f"unknown weather groups {unknown}; known are {sorted(ALIASES)}")
    return {ALIASES[n] for n in names}


def _toggle(c: Column, group: str, enabled: set[str]) -> Column:
    return c if group in enabled else F.lit(0.0)


def dedup_first_per_hour(weather: DataFrame, nodes: DataFrame | None = None, tie: str | None = None) -> DataFrame:
    """One observation of each place and hour: the first; ``timestamp`` becomes the hour."""
    if nodes is not None:
        weather = weather.join(F.broadcast(nodes.select(F.col("code").alias("__n"))), F.col("iata") == F.col("__n"), "left_semi")
    hour = floor_bucket(F.col("timestamp"), 1)
    w = Window.partitionBy("iata", "__hour").orderBy("timestamp", *([tie] if tie else []))
    rows = weather.withColumn("__hour", hour).withColumn("__rank", F.row_number().over(w)).where("__rank = 1")
    return rows.withColumn("timestamp", F.col("__hour")).drop("__hour", "__rank")


def weather_window_agg(weather: DataFrame, window: int = 1, enabled: list[str] | None = None) -> DataFrame:
    """(snapshot_ts, node, 9 columns) over the observations of the window before each snapshot."""
    on = enabled_groups(enabled)
    rows = weather.groupBy(F.col("iata").alias("node"), add_hours(floor_bucket(F.col("timestamp"), window), window).alias("snapshot_ts"))
    agg = rows.agg(F.avg("wind_speed_10m").alias("w"), F.max("wind_gusts_10m").alias("g"), F.sum("precipitation").alias("p"), F.avg("cloud_cover").alias("c"), F.mode("weather_category", True).alias("k"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return agg.select(
        "snapshot_ts", "node", _toggle(zero("w"), "wind", on).alias("h_wind_mean"), _toggle(zero("g"), "wind", on).alias("h_gust_max"),
        _toggle(zero("p"), "precip_cloud", on).alias("h_precip_sum"), _toggle(zero("c"), "precip_cloud", on).alias("h_cloud_mean"),
        *[_toggle(x, "category", on).alias(f"h_cat_{i}") for i, x in enumerate(one_hot(F.col("k")))],
    )


def weather_point(weather_hourly: DataFrame, grid: DataFrame, horizons: tuple[int, ...], window: int = 1, enabled: list[str] | None = None) -> DataFrame:
    """The observation in the hour at the centre of each horizon's window (a perfect-forecast stand-in)."""
    on = enabled_groups(enabled)
    asked = grid.select("snapshot_ts", "node", F.explode(F.array(*map(F.lit, horizons))).alias("h"))
    centre = F.expr(f"timestampadd(MINUTE, (h - 1) * {60 * window} + {30 * window}, snapshot_ts)")
    asked = asked.withColumn("timestamp", floor_bucket(centre, 1))
    j = asked.join(weather_hourly.withColumnRenamed("iata", "node"), ["node", "timestamp"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return j.select(
        "snapshot_ts", "node", F.col("h").alias("horizon_h"), _toggle(zero("wind_speed_10m"), "wind", on).alias("wx_obs_wind"), _toggle(zero("wind_gusts_10m"), "wind", on).alias("wx_obs_gust"),
        _toggle(zero("precipitation"), "precip_cloud", on).alias("wx_obs_precip"), _toggle(zero("cloud_cover"), "precip_cloud", on).alias("wx_obs_cloud"),
        *[_toggle(x, "category", on).alias(f"wx_obs_cat_{i}") for i, x in enumerate(one_hot(F.col("weather_category")))],
    )


def weather_block(weather: DataFrame, grid: DataFrame, horizons: tuple[int, ...], window: int = 1, enabled: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """Block H, wide: 9 window columns and 9 of each horizon. Without observations every column is 0."""
    hourly = dedup_first_per_hour(weather, tie=tie)
    point = weather_point(hourly, grid, horizons, window, enabled)
    values = [c for c in point.columns if c.startswith("wx_obs_")]
    wide = point.groupBy("snapshot_ts", "node").agg(*[F.max(F.when(F.col("horizon_h") == h, F.col(v))).alias(f"h{h}_{v}") for h in horizons for v in values])
    return wide.join(weather_window_agg(hourly, window, enabled), ["snapshot_ts", "node"], "left").na.fill(0.0)


WEATHER_WIDTH = lambda n_horizons: (4 + N_WEATHER_CATEGORIES) * (1 + n_horizons)
