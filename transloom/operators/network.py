"""Airports as nodes, routes as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transloom.sources.shared import cut


def airport_activity(flights: DataFrame) -> DataFrame:
    """(code, n): departures plus arrivals."""
    ends = flights.select(F.explode(F.array("Origin", "Dest")).alias("code"))
    return ends.groupBy("code").agg(F.count("*").alias("n"))


def top_n_airports(flights: DataFrame, n: int) -> DataFrame:
    """The ``n`` busiest airports; ties by code."""
    return airport_activity(flights).orderBy(F.desc("n"), "code").limit(n)


def collected(nodes: DataFrame) -> DataFrame:
    """The node list as a local table, so that plans hold it instead of its lineage; bounded by the list's limit."""
    return nodes.sparkSession.createDataFrame([(r["code"],) for r in nodes.select("code").collect()], "code string")


def filter_network(flights: DataFrame, nodes: DataFrame) -> DataFrame:
    """Trips with both ends in ``nodes`` (code), which are small by nature: Spark does not know the size of a local list and
    would shuffle and sort all trips by each end, a few airports in all."""
    for end in ("Origin", "Dest"):
        flights = flights.join(F.broadcast(nodes.select(F.col("code").alias("__node"))), F.col(end) == F.col("__node"), "left_semi")
    return flights


def node_index(nodes: DataFrame) -> DataFrame:
    """(node_idx, code): dense index in alphabetical order. The window is over the node list only."""
    return nodes.select("code").distinct().select((F.row_number().over(Window.orderBy("code")) - 1).alias("node_idx"), "code")


def with_node_index(rows: DataFrame, index: DataFrame, code: str, out: str) -> DataFrame:
    return rows.join(index.select(F.col("code").alias(code), F.col("node_idx").alias(out)), code, "left")


def edge_static(flights: DataFrame, min_flights: int = 30) -> DataFrame:
    """(edge_id, src, dst, origin, dest, norms): every qualifying route, in both directions.

    X to Y and Y to X, if both qualify, give two parallel edges a direction. Norms are shares of the largest value.
    """
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)) if c in flights.columns else F.lit(0.0)
    routes = flights.groupBy("Origin", "Dest").agg(F.count("*").alias("count"), mean("AirTime").alias("air_time"), mean("Distance").alias("distance"))
    routes = routes.where(F.col("count") >= min_flights)
    every = Window.partitionBy()  # over routes, one row for each pair of nodes: the trips are aggregated once

    def share(x: str) -> Column:
        top = F.max(x).over(every)
        return F.when(top > 0, F.col(x) / top).otherwise(F.lit(0.0))

    norms = {"count_norm": share("count"), "air_time_norm": share("air_time"), "distance_norm": share("distance")}
    ends = lambda mark, a, b: F.struct(F.concat_ws(mark, "Origin", "Dest").alias("edge_id"), F.col(a).alias("src"), F.col(b).alias("dst"))
    both = F.explode(F.array(ends(">", "Origin", "Dest"), ends("<", "Dest", "Origin"))).alias("e")
    return routes.withColumns(norms).select(both, *norms).select("e.*", *norms)


def top10_origins(flights: DataFrame, n: int = 10) -> DataFrame:
    return flights.groupBy(F.col("Origin").alias("code")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(n)


def missing_dim_keys(nodes: DataFrame, dim: DataFrame, key: str = "airport_code") -> DataFrame:
    """Nodes that the dimension lacks."""
    return nodes.join(dim, F.col("code") == F.col(key), "left_anti")


def normalised_adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, w): count_norm over the root of the end points' weighted degrees; parallel edges are summed first."""
    w = edges.groupBy("src", "dst").agg(F.sum("count_norm").alias("w"))
    out = w.groupBy(F.col("src").alias("s")).agg(F.sum("w").alias("d_s"))
    into = w.groupBy(F.col("dst").alias("t")).agg(F.sum("w").alias("d_t"))
    return w.join(out, F.col("src") == F.col("s")).join(into, F.col("dst") == F.col("t")).select("src", "dst", (F.col("w") / F.sqrt(F.col("d_s") * F.col("d_t"))).alias("w"))


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, dst, w) of the sparse matrices' product a b: joined where a's columns meet b's rows, and summed."""
    right = b.select(F.col("src").alias("__mid"), F.col("dst").alias("__to"), F.col("w").alias("__w"))
    terms = a.join(right, F.col("dst") == F.col("__mid"))
    return terms.groupBy("src", F.col("__to").alias("dst")).agg(F.sum(F.col("w") * F.col("__w")).alias("w"))


def matrix_power(matrix: DataFrame, n: int) -> DataFrame:
    """The sparse matrix to the ``n``-th (1 at least) by repeated squaring; every product is cut to the shared folder, so
    that plans do not double with each square. It has an entry for each pair of nodes with a path of n edges."""
    power, square = None, cut(matrix) if n > 1 else matrix
    while True:
        if n & 1:
            power = square if power is None else cut(matrix_product(power, square))
        n >>= 1
        if not n:
            return power
        square = cut(matrix_product(square, square))


def neighbor_aggregate(features: DataFrame, edges: DataFrame, values: list[str], hops: int = 1) -> DataFrame:
    """Degree-normalised weighted sum of the neighbours' features, ``hops`` times.

    features: (snapshot_ts, node, values); edges: (src, dst, count_norm). The weight of an edge is that of
    ``normalised_adjacency``. All snapshots have the same edges, so hops are powers of one matrix of nodes: the features, of
    which there are many snapshots of each node, are joined once however many hops there are. Null values and nodes without a
    row add nothing; a node whose paths all start at null values has a null.
    """
    if hops < 1:
        return features
    w = matrix_power(normalised_adjacency(edges), hops)
    joined = w.join(features, F.col("src") == F.col("node"))
    return joined.groupBy("snapshot_ts", F.col("dst").alias("node")).agg(*[F.sum(F.col("w") * F.col(v)).alias(v) for v in values])
