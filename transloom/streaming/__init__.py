"""The hourly live path as Structured Streaming queries.

Batch and stream share the operators: windowed aggregates run with a watermark, and everything that needs a
row-based window runs on closed windows in keyed state, or per micro-batch over the retained hour partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from transloom.sources.hours import HOUR, HourIndex
from transloom.sources.scans import exists
from transloom.sources.sinks import merge_predictions_latest, read_hour_partitions, trim_retention, write_hour_partition, write_predictions_batch


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 hour")).start()


def _literals(hours: DataFrame) -> list[Column]:
    """The values of a one-column table of hours, as literals for partition pruning."""
    return [F.lit(r[0]).cast("timestamp_ntz") for r in hours.collect()]


def one_of_each(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key. Rows are dealt out by key first: nearly all keys differ, and to look for repeated ones in the tasks
    of the scan as well would hold a whole split's rows in memory there and send as many."""
    return rows.repartition(*key).dropDuplicates(key)


def stream_ingest_hourly(stream: DataFrame, path: str, checkpoint: str, key: list[str], ts: str = "timestamp", now: Callable[[], Column] | None = None, available_now: bool = True) -> StreamingQuery:
    """Land trips in hour partitions. A batch rewrites the partitions it touches with old and new rows, one of each
    key, so replays and late rows are harmless; with ``now`` it trims retention.

    The hours that a batch touches reach the driver and prune the partitions that are read again.
    """

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if exists(spark, f"{path}/y=*"):
            touched = _literals(batch.select(F.date_trunc("hour", ts).cast("timestamp_ntz").cast("string")).distinct())
            old = read_hour_partitions(spark, path)
            batch = old.where(F.col("part_ts").isin(*touched)).select(batch.columns).unionByName(batch) if touched else batch
        write_hour_partition(one_of_each(batch, key), path, ts)
        if now is not None:
            trim_retention(spark, path, now())

    return _run(stream, each, checkpoint, available_now)


def stream_node_hour(stream: DataFrame, ts: str = "arr_timestamp", delay: str = "2 hours") -> DataFrame:
    """(node, bucket): trips and mean arrival delay, as windows close."""
    s = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
    agg = s.groupBy(F.window("__ts", "1 hour"), F.col("Dest").alias("node")).agg(F.count("*").alias("n"), F.avg("ArrDelay").alias("arr_delay_mean"))
    return agg.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), "node", "n", "arr_delay_mean")


def stream_route_hour(stream: DataFrame, ts: str = "arr_timestamp", delay: str = "2 hours") -> DataFrame:
    s = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
    agg = s.groupBy(F.window("__ts", "1 hour"), F.col("Origin").alias("src"), F.col("Dest").alias("dst")).agg(F.count("*").alias("n"), F.avg("ArrDelay").alias("route_arr_delay"))
    return agg.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), "src", "dst", "n", "route_arr_delay")


_COUNTS = ["late_n", "arrivals", "top", "departures"]
_OPEN = ["buckets", "late_sum", *_COUNTS]
_STATE = "delays array<double>, buckets array<long>, late_sum array<double>, " + ", ".join(f"{c} array<long>" for c in _COUNTS)
_CELLS = "node string, bucket long, at timestamp, late_sum double, " + ", ".join(f"{c} long" for c in _COUNTS)
_FEATURES = "node string, bucket long, arr_delay_mean double, rolling_mean double, rolling_std double, sched_arr_count long, sched_arr_from_top10 long, sched_dep_count long"
_HOUR_S = 3600


def _partial_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts and sums by node and hour of a task's rows."""
    for frame in frames:
        if len(frame):
            sums = {c: (c, "sum") for c in ("late_sum", *_COUNTS)}
            yield frame.groupby(["node", "bucket"], as_index=False).agg(at=("at", "max"), **sums)[["node", "bucket", "at", "late_sum", *_COUNTS]]


def stream_features(stream: DataFrame, busy: Sequence[str], delay: str = "2 hours", observed: int = 6) -> DataFrame:
    """The features of each node and hour, once, when the watermark has passed the hour's end.

    Tasks count their trips by node and hour first, so a busy node brings some rows a task. A node's state holds its open hours
    and a ring of the last ``observed`` mean delays, from which rolling mean and deviation are taken; a timer at the end of
    the first open hour closes it. Hours of a node close in the order of time, so files out of order inside the delay, other
    micro-batches and restarts from the checkpoint give the same rows. What is older than the watermark is dropped. ``busy``
    are the origins whose arrivals are counted apart.
    """

    def side(node: str, at: str, arrival: bool) -> Column:
        late = F.col("ArrDelay").cast("double") if arrival else F.lit(None).cast("double")
        return F.struct(
            F.col(node).alias("node"), F.unix_seconds(F.date_trunc("hour", F.col(at).cast("timestamp"))).alias("bucket"), F.col(at).cast("timestamp").alias("at"), F.coalesce(late, F.lit(0.0)).alias("late_sum"),
            late.isNotNull().cast("long").alias("late_n"), F.lit(int(arrival)).cast("long").alias("arrivals"), (F.col("Origin").isin(*busy) & F.lit(arrival)).cast("long").alias("top"), F.lit(int(not arrival)).cast("long").alias("departures"),
        )

    ends = stream.select(F.explode(F.array(side("Dest", "arr_timestamp", True), side("Origin", "timestamp", False))).alias("e")).select("e.*").where("node IS NOT NULL AND at IS NOT NULL")
    cells = ends.mapInPandas(_partial_cells, _CELLS).withWatermark("at", delay)

    def close(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([],) * (1 + len(_OPEN))
        ring = list(held[0])
        known = pd.DataFrame(dict(zip(_OPEN, held[1:], strict=True)))
        new = [f.rename(columns={"bucket": "buckets"})[_OPEN] for f in frames]
        cells = pd.concat([x for x in (known, *new) if len(x)], ignore_index=True) if len(known) or any(map(len, new)) else known
        cells = cells.groupby("buckets", as_index=False).sum().sort_values("buckets")
        now = state.getCurrentWatermarkMs() // 1000
        done = cells[cells["buckets"] + _HOUR_S <= now] if state.hasTimedOut or now > 0 else cells.iloc[:0]
        left = cells.iloc[len(done) :]
        out = []
        for row in done.itertuples(index=False):
            mean = row.late_sum / row.late_n if row.late_n else None
            if mean is not None:
                ring = [*ring, mean][-observed:]
            spread = float(pd.Series(ring).std()) if len(ring) > 1 else 0.0
            rolled = (mean, sum(ring) / len(ring), spread) if mean is not None else (None, None, None)
            out.append((key[0], int(row.buckets), *rolled, *(int(n) or None for n in (row.arrivals, row.top, row.departures))))
        state.update((ring, *[left[c].tolist() for c in _OPEN]))
        if len(left):
            state.setTimeoutTimestamp(max(int(left["buckets"].iloc[0]) + _HOUR_S, now + 1) * 1000)
        names = [c.split()[0] for c in _FEATURES.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in names[-3:]} | {c: float for c in names[2:5]})

    closed = cells.groupBy("node").applyInPandasWithState(close, _FEATURES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return closed.withColumn("bucket", F.timestamp_seconds("bucket").cast("timestamp_ntz"))


def stream_recent_features(stream: DataFrame, buffer: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], out: str, hours: int = 24, available_now: bool = True) -> StreamingQuery:
    """On each batch, the batch operators over the last ``hours`` of the buffer, written to ``out``.

    The newest hour is told by the folders' names; without any hour nothing is written.
    """

    def each(batch: DataFrame, _: int) -> None:
        index = HourIndex(batch.sparkSession, buffer)
        if index.hours:
            build(index.read(index.between(index.hours[-1] - hours * HOUR, index.hours[-1] + HOUR))).write.mode("overwrite").parquet(out)

    return _run(stream, each, checkpoint, available_now)


def stream_predictions(stream: DataFrame, latest: str, history: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Predictions to a latest table, merged by airport and horizon, and a history, keyed by micro-batch.

    Both can be written again after a failure without another result; empty batches change nothing. Read them
    with ``read_predictions_latest`` and ``read_predictions_batches``.
    """

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write_predictions_batch(batch, history, number)
            merge_predictions_latest(batch, latest, number)

    return _run(stream, each, checkpoint, available_now)
