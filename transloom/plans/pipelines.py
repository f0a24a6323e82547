"""Tables that several queries start from.

Trips are staged once for a session (``adapters.staged_trips``); every operator's scan of them is pruned to its own
columns. What several parts of one plan share is small by nature (snapshots, cells of nodes and hours) and is cut
to the shared folder, so that no part aggregates the trips again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom.operators import cleaning, history, network, predictions, snapshots, star, weather
from transloom.sources.adapters import read, staged_trips, weather_from_events
from transloom.sources.shared import cut

TOP_N = 20
#: Trips that a snapshot needs in its window and in each horizon's.
MIN_ROWS = 10
HORIZONS = snapshots.HORIZONS


def flights(spark: SparkSession, folder: str) -> DataFrame:
    return staged_trips(spark, folder)


def prepared(spark: SparkSession, folder: str, top_n: int = TOP_N) -> tuple[DataFrame, DataFrame]:
    """(cleaned trips between the busiest airports, with event times and buckets; those airports)."""
    rows, nodes = cleaning.preprocess_pipeline(flights(spark, folder), top_n)
    return history.with_buckets(cleaning.derive_timestamps(rows)), nodes


def report_frame(spark: SparkSession, folder: str) -> DataFrame:
    f = flights(spark, folder)
    return cleaning.build_flight_frame(f, network.collected(network.top_n_airports(cleaning.clean_flights(f), TOP_N)))


def fact(spark: SparkSession, folder: str) -> DataFrame:
    return star.fact_airport_hour(report_frame(spark, folder))


def snapshot_base(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trips, airports, guarded snapshots)."""
    f, nodes = prepared(spark, folder)
    return f, nodes, cut(snapshots.guarded_snapshots(f, min_rows=MIN_ROWS))


def airports(spark: SparkSession, folder: str) -> DataFrame:
    """An airport dimension derived from nations."""
    k = F.col("n_nationkey")
    return read(spark, folder, "nation").select(F.concat(F.lit("A"), F.lpad(k.cast("string"), 2, "0")).alias("iata"), F.col("n_name").alias("name"), (k * 2 - 20).cast("double").alias("latitude"), (k * 5 - 60).cast("double").alias("longitude"), (k * 10).cast("int").alias("elevation_m"))


def predicted(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of the default scorer with actuals, at every snapshot."""
    f, nodes, snaps = snapshot_base(spark, folder)
    cells = cut(history.arrival_cells(f))
    scored = predictions.persistence_scorer(snapshots.dense_grid(nodes, snaps), history.rolling_node(cells), HORIZONS)
    return predictions.align_actuals(predictions.assemble_predictions(scored, known=nodes), snapshots.targets_from_cells(cells, nodes, snaps))


def targets(spark: SparkSession, folder: str) -> DataFrame:
    """The targets of every node, snapshot and horizon."""
    f, nodes, snaps = snapshot_base(spark, folder)
    return snapshots.node_targets(f, nodes, snaps)


def enriched(spark: SparkSession, folder: str) -> DataFrame:
    hours = cut(fact(spark, folder))
    return predictions.enrich_predictions(predicted(spark, folder), hours, star.agg_baseline_volume(hours))


def weather_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return weather.dedup_first_per_hour(weather_from_events(spark, folder), tie="event_id")


def batch_predict(
    f: DataFrame, nodes: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], features: Callable[[DataFrame, DataFrame], DataFrame],
    split: str = "test", horizons: Sequence[int] = HORIZONS, length: int = 6, min_rows: int = 10, include_actuals: bool = True,
) -> DataFrame:
    """The long prediction frame of a split (``all`` for every one) of cleaned trips with buckets.

    Guarded snapshots are split by time, sequences of ``length`` snapshots are built inside each split, ``scorer``
    runs on the ``features(grid, cells)`` of each sequence (see ``predictions.score_sequences``), and its rows are
    assembled with the actuals, in the order of prediction_ts, airport and horizon. A split without sequences
    gives no rows.
    """
    snaps = cut(snapshots.split_by_ratio(snapshots.guarded_snapshots(f, horizons=tuple(horizons), min_rows=min_rows)))
    cells = cut(history.arrival_cells(f))
    sequences = snapshots.sliding_sequences(snaps, length, within=["split"])
    if split != "all":
        sequences = sequences.where(F.col("split") == split)
    rows = features(snapshots.dense_grid(nodes, snaps), cells)
    scored = predictions.score_sequences(sequences.select("target_ts", "members"), rows, scorer)
    out = predictions.assemble_predictions(scored, known=nodes)
    if include_actuals:
        out = predictions.align_actuals(out, snapshots.targets_from_cells(cells, nodes, snaps, tuple(horizons)))
    return predictions.order_predictions(out)
