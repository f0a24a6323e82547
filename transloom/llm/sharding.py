"""Operator 6: sharding by sampled splitters. DataFrame functions only.

Law ``bytes``: shards of near equal size. Rows are ordered by a hash of their text, so equal texts are
neighbours. A size-weighted sample of keys gives quantile boundaries of many ranges; every row is placed by
a binary search over the boundaries (an expression, no join); ranges that turn out overfull in bytes or
rows (one text may hold a third of all rows) are subdivided by a row number hash. Exact totals of the ranges
then fix where each begins, a running sum inside each range finds every row's place on the byte line, and the
line is cut into equal parts. A group of equal texts is cut only where its range is overfull.

Defined cases: a null text has 0 bytes and checksum 0; null and repeated ids are rows like any other; equal texts
(ties) follow each other in the order of their row numbers; a very long text is never cut and may fill a shard; an
empty table gives an empty result. Counts that reach the driver are bounded by the number of ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transloom.llm.common import cut, written

SHARDS = 24
#: Ranges drawn for each shard, and sampled keys for each range.
RANGES_PER_SHARD = 64
KEYS_PER_RANGE = 16
#: A range is overfull above this many times the mean.
OVERFULL = 2
ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = cut(rows)  # row numbers are fixed from here on
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    ranges = shards * ranges_per_shard
    size, n = max(1, total["size"]), max(1, total["n"])

    weight = F.col("size") * F.lit(KEYS_PER_RANGE * ranges / size)
    drawn = (F.floor(weight) + (F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 20)) < (weight - F.floor(weight)) * F.lit(float(1 << 20))).cast("long")).cast("int")
    sample = rows.select(F.explode(F.array_repeat("key", drawn)).alias("key"))
    edges = sample.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10000).alias("edges")).first()["edges"] or []
    steps = [1 << i for i in reversed(range(max(1, len(edges).bit_length())))]
    bounds = F.lit(edges) if edges else F.array().cast("array<bigint>")
    place = F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when((at + s <= len(edges)) & (F.get(bounds, at + s - 1) <= F.col("key")), at + s).otherwise(at))
    # a written table, not a checkpoint: that would pass on range = search(key) for filters on the joined side
    rows = written(rows.withColumn("range", place))

    full = lambda x, all_: F.ceil(F.sum(x) / F.lit(OVERFULL * all_ / ranges))
    parts = rows.groupBy("range").agg(F.greatest(F.lit(1), full(F.col("size"), size), F.when(F.count("*") > 2 * OVERFULL, full(F.lit(1), n)).otherwise(1)).alias("parts"))
    rows = rows.join(F.broadcast(parts), "range").withColumn("part", F.pmod(F.xxhash64("row", F.lit(2)), F.col("parts")))

    cells = rows.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)  # over at most a few cells for each range
    cells = cells.select("range", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"))
    rows = rows.join(F.broadcast(cells), ["range", "part"])

    inside = Window.partitionBy("range", "part").orderBy("key", "row")
    group = Window.partitionBy("range", "part", "key")
    rows = rows.withColumns({"run": F.sum("size").over(inside) - F.col("size"), "nth": F.row_number().over(inside)})
    rows = rows.withColumns({"group0": F.min("run").over(group), "group_bytes": F.sum("size").over(group)})
    middle = F.when(F.col("parts") == 1, 2 * (F.col("bytes0") + F.col("group0")) + F.col("group_bytes")).otherwise(2 * (F.col("bytes0") + F.col("run")) + F.col("size"))
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * size))).cast("int")
    placed = cut(rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows0") + F.col("nth") - 1).alias("rank")))

    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
