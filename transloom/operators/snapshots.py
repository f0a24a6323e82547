"""Snapshots of the graph over time: gates, targets, feature blocks, statistics, splits and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transloom.functions import add_hours, cyclic, floor_bucket, zero_if_missing
from transloom.operators import history, network
from transloom.operators.selection import exact_quantiles, with_same_keys
from transloom.operators.weather import weather_block
from transloom.sources.schema import CAUSES
from transloom.sources.shared import cut

HORIZONS = (1, 2, 4, 6, 8)


def snapshot_times(f: DataFrame, window: int = 1, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(snapshot_ts): ends of all windows whose farthest horizon still fits before the last departure."""
    span = f.agg(floor_bucket(F.min("timestamp"), window).alias("lo"), F.max("timestamp").alias("hi"))
    ahead = window * (1 + max(horizons))
    span = span.where(add_hours(F.col("lo"), ahead) <= F.col("hi"))
    starts = span.select(F.explode(F.sequence("lo", add_hours(F.col("hi"), -ahead), F.expr(f"INTERVAL {window} HOUR"))).alias("t"))
    return starts.select(add_hours(F.col("t"), window).alias("snapshot_ts"))


def window_slice(f: DataFrame, start: Column, hours: int, ts: str = "timestamp") -> DataFrame:
    return f.where((F.col(ts) >= start) & (F.col(ts) < add_hours(start, hours)))


def guarded_snapshots(f: DataFrame, window: int = 1, horizons: tuple[int, ...] = HORIZONS, min_rows: int = 10) -> DataFrame:
    """Snapshots with enough trips in their window and in every horizon's window.

    Both ends of the trips are counted in one pass. Each bucket with enough trips then votes for the snapshots
    that need it; a snapshot stays if all its windows vote and its farthest horizon fits before the last departure.
    """
    none = F.lit(None).cast("timestamp_ntz")
    ends = F.array(
        F.struct(floor_bucket(F.col("timestamp"), window).alias("bucket"), F.col("timestamp").alias("departs")),
        F.struct(floor_bucket(F.col("arr_timestamp"), window).alias("bucket"), none.alias("departs")),
    )
    counts = f.select(F.explode(ends).alias("x")).select("x.*").where("bucket is not null").groupBy("bucket")
    counts = counts.agg(F.count("departs").alias("departures"), F.count("*").alias("n"), F.max("departs").alias("departs"))
    vote = lambda shift, n: F.struct(F.lit(shift).alias("shift"), (n >= min_rows).alias("enough"))
    arrivals = F.col("n") - F.col("departures")
    votes = F.array(vote(window, F.col("departures")), *[vote(-(h - 1) * window, arrivals) for h in horizons])
    last = F.max("departs").over(Window.partitionBy())  # over buckets, one row an hour
    cast = counts.select("bucket", last.alias("last"), F.explode(votes).alias("v")).where("v.enough")
    cast = cast.select(add_hours(F.col("bucket"), F.col("v.shift")).alias("snapshot_ts"), "last").groupBy("snapshot_ts")
    held = cast.agg(F.count("*").alias("votes"), F.max("last").alias("last"))
    fits = add_hours(F.col("snapshot_ts"), window * max(horizons)) <= F.col("last")
    return held.where((F.col("votes") == len(horizons) + 1) & fits).select("snapshot_ts")


def dense_grid(nodes: DataFrame, snapshots: DataFrame, horizons: tuple[int, ...] | None = None) -> DataFrame:
    """Every node at every snapshot (and horizon). Nodes and horizons are small by nature."""
    grid = snapshots.select("snapshot_ts").crossJoin(F.broadcast(nodes.select(F.col("code").alias("node"))))
    return grid if horizons is None else grid.withColumn("horizon_h", F.explode(F.array(*map(F.lit, horizons))))


def completed_only(f: DataFrame, cutoff: Column) -> DataFrame:
    """The leak guard: only trips that have arrived before the cutoff."""
    return f.where(F.col("arr_timestamp") < cutoff)


def _keyed(f: DataFrame, window: int) -> DataFrame:
    return f.withColumn("snapshot_ts", add_hours(floor_bucket(F.col("timestamp"), window), window))


def node_features_basic(f: DataFrame, threshold: float = 15.0, window: int = 1) -> DataFrame:
    """Six features by (snapshot, node) of the trips of the window; the delayed share is of all rows."""
    k = _keyed(f, window)
    dep = k.groupBy("snapshot_ts", F.col("Origin").alias("node")).agg(
        F.avg("DepDelay").alias("dep_mean"), F.stddev_pop("DepDelay").alias("dep_std"), F.avg(F.coalesce(F.col("DepDelay") > threshold, F.lit(False)).cast("double")).alias("dep_share"), F.count("*").cast("double").alias("flights")
    )
    arr = k.groupBy("snapshot_ts", F.col("Dest").alias("node")).agg(F.avg("ArrDelay").alias("arr_mean"), F.stddev_pop("ArrDelay").alias("arr_std"))
    out = dep.join(arr, ["snapshot_ts", "node"], "full_outer").na.fill(0.0)
    return snapshot_max_norm(out, ["flights"])


def snapshot_max_norm(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Divide by the largest value of the snapshot."""
    w = Window.partitionBy("snapshot_ts")
    return rows.withColumns({c: F.when(F.max(c).over(w) > 0, F.col(c) / F.max(c).over(w)).otherwise(F.lit(0.0)) for c in columns})


def _done() -> Column:
    return F.col("arr_timestamp") < F.col("snapshot_ts")


def _a_arrivals(threshold: float) -> list[Column]:
    a = F.col("ArrDelay")
    over = lambda limit: F.avg(F.when(a.isNotNull(), (a > limit).cast("double")))
    return [
        F.avg(a).alias("a_arr_mean"), F.stddev_pop(a).alias("a_arr_std"),
        over(threshold).alias("a_share_late"), over(60).alias("a_share_60"), F.avg("TaxiIn").alias("__in"),
    ]


def _a_departures() -> list[Column]:
    of = lambda c: F.when(_done(), F.col(c))
    return [F.avg(of("DepDelay")).alias("a_dep_mean"), F.stddev_pop(of("DepDelay")).alias("a_dep_std"), F.avg(of("TaxiOut")).alias("__out")]


def _a_finished(rows: DataFrame) -> DataFrame:
    """Both percentiles, and the taxi time: the mean of both ends, or the one that is there."""
    taxi = F.when(F.col("__out").isNull(), F.col("__in")).when(F.coalesce("__in", F.lit(0.0)) != 0, (F.col("__in") + F.col("__out")) / 2).otherwise(F.col("__out"))
    tail = {"a_arr_p75": F.get("__tail", F.lit(0)), "a_arr_p90": F.get("__tail", F.lit(1))}
    return rows.withColumns(tail | {"a_taxi": taxi}).drop("__tail", "__in", "__out")


def _b_departures() -> list[Column]:
    return [F.count("*").cast("double").alias("b_departures"), F.count_if("Cancelled").cast("double").alias("b_cancelled"), F.count_if("Diverted").cast("double").alias("b_diverted")]


def _b_arrivals() -> list[Column]:
    return [F.count("*").cast("double").alias("b_arrivals")]


def _c_arrivals(columns: list[str]) -> list[Column]:
    return [F.coalesce(F.avg(c if c in columns else F.lit(0.0)), F.lit(0.0)).alias(f"c_{c}") for c in CAUSES]


def _by(rows: DataFrame, end: str, columns: list[Column]) -> DataFrame:
    return rows.groupBy("snapshot_ts", F.col(end).alias("node")).agg(*columns)


def _arrivals(done: DataFrame, columns: list[Column]) -> DataFrame:
    """``columns`` by destination, with both tail percentiles of the delay; these are selected by rank, not buffered."""
    keys = ["snapshot_ts", "node"]
    tail = exact_quantiles(done.withColumn("node", F.col("Dest")), keys, "ArrDelay", [0.75, 0.9], "__tail")
    return with_same_keys(_by(done, "Dest", columns), tail, keys, "left")


def node_block_a(f: DataFrame, threshold: float = 15.0, window: int = 1) -> DataFrame:
    done = _keyed(f, window).where(_done())
    out = _arrivals(done, _a_arrivals(threshold)).join(_by(done, "Origin", _a_departures()), ["snapshot_ts", "node"], "full_outer")
    return _a_finished(out).na.fill(0.0)


def node_block_b(f: DataFrame, window: int = 1) -> DataFrame:
    k = _keyed(f, window)
    out = _by(k.where(_done()), "Dest", _b_arrivals()).join(_by(k, "Origin", _b_departures()), ["snapshot_ts", "node"], "full_outer")
    return snapshot_max_norm(out.na.fill(0.0), ["b_arrivals", "b_departures"])


def node_block_c(f: DataFrame, window: int = 1) -> DataFrame:
    return _by(_keyed(f, window).where(_done()), "Dest", _c_arrivals(f.columns))


def node_blocks_abc(f: DataFrame, threshold: float = 15.0, window: int = 1) -> DataFrame:
    """Blocks A, B and C together: one aggregate by destination and one by origin."""
    k = _keyed(f, window)
    arrivals = _arrivals(k.where(_done()), [*_a_arrivals(threshold), *_b_arrivals(), *_c_arrivals(f.columns)])
    departures = _by(k, "Origin", [*_a_departures(), *_b_departures()])
    out = _a_finished(arrivals.join(departures, ["snapshot_ts", "node"], "full_outer")).na.fill(0.0)
    return snapshot_max_norm(out, ["b_arrivals", "b_departures"])


def with_block_f(grid: DataFrame) -> DataFrame:
    """Calendar of the snapshot on cycles."""
    ts = F.col("snapshot_ts")
    out = {}
    for name, value, period in (("hour", F.hour(ts), 24), ("dow", F.weekday(ts), 7), ("month", F.month(ts) - 1, 12)):
        out[f"f_{name}_sin"], out[f"f_{name}_cos"] = cyclic(value, period)
    return grid.withColumns(out)


def target_hour_sin(h: int, window: int = 1) -> Column:
    """Sine of the hour at the centre of the horizon's window."""
    centre = F.timestamp_add("MINUTE", F.lit((h - 1) * window * 60 + window * 30), F.col("snapshot_ts"))
    return cyclic(F.hour(centre), 24)[0]


def node_features_rich(f: DataFrame, nodes: DataFrame, snapshots: DataFrame, window: int = 1, horizons: tuple[int, ...] = HORIZONS, weather_block: DataFrame | None = None) -> DataFrame:
    """Blocks A to G (and H) of every node at every snapshot: 30 + 5 x horizons columns (+ 9 + 9 x horizons).

    Trips are read once for each grain: by arrival hour, by departure hour, and twice by snapshot.
    """
    hist = history.node_history(history.with_buckets(f, window), window)
    grid = with_block_f(dense_grid(nodes, snapshots)).join(node_blocks_abc(f, window=window), ["snapshot_ts", "node"], "left")
    picks = history.lag_picks(window) + history.rolling_picks(window) + history.horizon_picks(horizons, window)
    grid = history.wide_lookup(grid, hist, picks)
    grid = grid.withColumns({f"g{h}_hour_sin": target_hour_sin(h, window) for h in horizons})
    if weather_block is not None:
        grid = grid.join(weather_block, ["snapshot_ts", "node"], "left")
    values = [c for c in grid.columns if c not in ("snapshot_ts", "node")]
    return grid.select("snapshot_ts", "node", *[zero_if_missing(F.col(c)).alias(c) for c in values])


def node_targets(f: DataFrame, nodes: DataFrame, snapshots: DataFrame, horizons: tuple[int, ...] = HORIZONS, window: int = 1, threshold: float = 15.0) -> DataFrame:
    """(snapshot_ts, node, horizon_h, arr, dep, pct): means over the trips that arrive in the horizon's window."""
    rows = f.withColumn("arr_bucket", floor_bucket(F.col("arr_timestamp"), window))
    return targets_from_cells(history.arrival_cells(rows, threshold=threshold), nodes, snapshots, horizons, window)


def targets_from_cells(cells: DataFrame, nodes: DataFrame, snapshots: DataFrame, horizons: tuple[int, ...] = HORIZONS, window: int = 1) -> DataFrame:
    """The targets from ``history.arrival_cells``. The interval join is an equality of buckets, because arrivals are bucketed once."""
    values = {"arr": "arr_delay_mean", "dep": "dep_delay_mean", "pct": "late_share"}
    cells = cells.select("node", "bucket", *[F.col(c).alias(k) for k, c in values.items()])
    grid = dense_grid(nodes, snapshots, horizons).withColumn("bucket", add_hours(F.col("snapshot_ts"), (F.col("horizon_h") - 1) * window))
    return grid.join(cells, ["node", "bucket"], "left").drop("bucket").na.fill(0.0, list(values))


def create_snapshots(
    f: DataFrame, nodes: DataFrame, window: int = 1, horizons: tuple[int, ...] = HORIZONS, min_rows: int = 10, min_flights: int = 30,
    weather: DataFrame | None = None, weather_groups: list[str] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, targets, edges) of all guarded snapshots of the trips ``f``.

    features: (snapshot_ts, node, all blocks, active); targets: (snapshot_ts, node, horizon_h, arr, dep, pct);
    edges: (snapshot_ts, edge_id, src, dst, three static and two dynamic attributes). ``weather`` (observations)
    adds block H. All snapshots are made at once; no step walks over them.
    """
    f = history.with_buckets(f, window)
    snaps = cut(guarded_snapshots(f, window, horizons, min_rows))
    block = None if weather is None else weather_block(weather, dense_grid(nodes, snaps), horizons, window, weather_groups)
    features = node_features_rich(f, nodes, snaps, window, horizons, block)
    features = active_nodes(features, [c for c in features.columns if c not in ("snapshot_ts", "node")])
    static = network.edge_static(f, min_flights)
    edges = history.edge_dynamic(static, snaps, history.route_history(f, window), window).join(static.drop("src", "dst"), "edge_id")
    return features, node_targets(f, nodes, snaps, horizons, window), edges


def active_nodes(features: DataFrame, values: list[str]) -> DataFrame:
    """Add ``active``: any feature differs from 0."""
    total = F.aggregate(F.array(*values), F.lit(0.0), lambda a, v: a + F.abs(v))
    return features.withColumn("active", total > 0)


def feature_stats(features: DataFrame, values: list[str], train_filter: Column | None = None) -> DataFrame:
    """(feature, mean, std): sample deviation, at least 1e-6, in one pass over the active training rows.

    Rows count where ``train_filter`` holds (all, if None) and, if the table has the column ``active``, it is true.
    """
    if train_filter is not None:
        features = features.where(train_filter)
    if "active" in features.columns:
        features = features.where("active")
    stats = features.agg(*[F.struct(F.avg(v).alias("mean"), F.greatest(F.coalesce(F.stddev_samp(v), F.lit(0.0)), F.lit(1e-6)).alias("std")).alias(v) for v in values])
    return stats.select(F.explode(F.array(*[F.struct(F.lit(v).alias("feature"), F.col(f"{v}.mean").alias("mean"), F.col(f"{v}.std").alias("std")) for v in values])).alias("s")).select("s.*")


def normalize_features(features: DataFrame, stats: DataFrame, values: list[str]) -> DataFrame:
    """(x - mean) / std; features without statistics stay as they are."""
    wide = stats.agg(*[F.max(F.when(F.col("feature") == v, F.struct("mean", "std"))).alias(f"__{v}") for v in values])
    mean = lambda v: F.coalesce(F.col(f"__{v}.mean"), F.lit(0.0))
    std = lambda v: F.coalesce(F.col(f"__{v}.std"), F.lit(1.0))
    return features.crossJoin(F.broadcast(wide)).select(*[((F.col(c) - mean(c)) / std(c)).alias(c) if c in values else F.col(c) for c in features.columns])


def split_by_ratio(snapshots: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Chronological split by position. The window is over snapshots, one row for each hour."""
    n = F.count("*").over(Window.partitionBy())
    at = F.row_number().over(Window.orderBy("snapshot_ts"))
    cut = lambda share: F.floor(n * F.lit(share))
    return snapshots.select("snapshot_ts", F.when(at <= cut(train), "train").when(at <= cut(train + val), "val").otherwise("test").alias("split"))


def split_by_date(rows: DataFrame, train_end: str, val_end: str, ts: str = "snapshot_ts") -> DataFrame:
    end = lambda d: F.lit(d).cast("timestamp_ntz")
    return rows.withColumn("split", F.when(F.col(ts) < end(train_end), "train").when(F.col(ts) < end(val_end), "val").otherwise("test"))


def split_by_month(rows: DataFrame, train: list[int], val: list[int], test: list[int], month: str = "Month") -> DataFrame:
    """Rows of the listed months with their split."""
    c = F.when(F.col(month).isin(*train), "train").when(F.col(month).isin(*val), "val").when(F.col(month).isin(*test), "test")
    return rows.withColumn("split", c).where("split is not null")


def sliding_sequences(snapshots: DataFrame, length: int = 6, require_contiguous: bool = False, window: int = 1, within: list[str] | None = None) -> DataFrame:
    """(target_ts, members): every run of ``length`` existing snapshots, by split if ``within`` names one."""
    w = Window.partitionBy(*(within or [])).orderBy("snapshot_ts").rowsBetween(-(length - 1), 0)
    out = snapshots.select(*(within or []), F.col("snapshot_ts").alias("target_ts"), F.collect_list("snapshot_ts").over(w).alias("members")).where(F.size("members") == length)
    if require_contiguous:
        out = out.where(F.expr(f"members[0] = timestampadd(HOUR, {-(length - 1) * window}, target_ts)"))
    return out


def last_n_snapshots(snapshots: DataFrame, n: int = 6) -> DataFrame:
    return snapshots.orderBy(F.desc("snapshot_ts")).limit(n)
