"""Predictions laid out for lookups: ranges of (airport, horizon, time), one file each, with an index of the files.

A lookup reads the index, which has a row a file, opens the one file that can hold the newest row of its key, and inside it
only the pages whose bounds and Bloom filters let the key through.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom.functions import clean_code
from transloom.sources.scans import lookup_prediction
from transloom.sources.shared import delete, file_system

CLUSTER = ["airport_code", "horizon_h", "prediction_ts"]
#: Rows of a file, and of a page, the least that a lookup reads.
FILE_ROWS = 4_000_000
PAGE_ROWS = 1_000


def write_clustered(predictions: DataFrame, path: str, file_rows: int = FILE_ROWS, page_rows: int = PAGE_ROWS) -> None:
    """Write ``predictions`` range-partitioned and sorted by CLUSTER, and then the index that readers go by.

    Rows of equal key lie in one file. A reader sees the former table until the index is there; its files go afterwards.
    """
    spark = predictions.sparkSession
    fs, pattern = file_system(spark, f"{path}/rows-*")
    old = [f.getPath() for f in fs.globStatus(pattern) or []]
    files = max(1, -(-predictions.count() // file_rows))
    folder = f"rows-{uuid.uuid4().hex}"
    ranges = predictions.repartitionByRange(files, *CLUSTER).sortWithinPartitions(*CLUSTER)
    ranges.write.option("parquet.bloom.filter.enabled#airport_code", "true").option("parquet.page.row.count.limit", page_rows).parquet(f"{path}/{folder}")
    rows = spark.read.schema(predictions.schema).parquet(f"{path}/{folder}").select(F.struct(*CLUSTER).alias("key"), F.col("_metadata.file_name").alias("file"))
    index = rows.groupBy("file").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"))
    index.select(F.concat(F.lit(f"{folder}/"), "file").alias("file"), "lo", "hi", "n").orderBy("lo").write.mode("overwrite").parquet(f"{path}/index")
    for gone in old:
        delete(spark, gone.toString())


def file_of(spark: SparkSession, path: str, airport: str, horizon: int) -> str | None:
    """The file with the newest row of a key if there is one: the last whose bounds hold the key. Ranges do not overlap, so a
    file before it has none of the key's rows unless this one has too."""
    key = F.struct(clean_code(F.lit(airport)).alias("airport_code"), F.lit(horizon).cast("int").alias("horizon_h"))
    bound = lambda c: F.struct(f"{c}.airport_code", f"{c}.horizon_h")
    holds = spark.read.parquet(f"{path}/index").where((bound("lo") <= key) & (key <= bound("hi")))
    last = holds.orderBy(F.desc("hi")).select("file").first()
    return f"{path}/{last['file']}" if last else None


def lookup_clustered(spark: SparkSession, path: str, airport: str, horizon: int, horizons: Sequence[int] = (1, 2, 4, 6, 8)) -> DataFrame:
    """``lookup_prediction`` on a table of ``write_clustered``: the same row, from one file. No rows for an unknown airport."""
    where = file_of(spark, path, airport, horizon)
    if where is None:
        one = spark.read.parquet(f"{path}/index").select("file").first()
        rows = spark.read.parquet(f"{path}/{one['file']}").where("false") if one else spark.read.parquet(f"{path}/rows-*")
    else:
        rows = spark.read.parquet(where)
    return lookup_prediction(rows, airport, horizon, horizons)
