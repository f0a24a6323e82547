"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom.sources.shared import cut, shared_dir, written

__all__ = ["SPACES", "among", "cut", "drop_shuffles", "once", "remainder", "shared_dir", "small_batches", "table", "vocabulary", "written"]

#: The ASCII white space that separates words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"

#: Arrow batches stay this small (or hold one row), so that a batch of very long texts fits a Python worker.
ARROW_BYTES = str(4 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Limit the bytes of the session's Arrow batches to ARROW_BYTES, unless a limit is set already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, ARROW_BYTES)


def once(function: Callable, returns) -> Callable:
    """A pandas UDF that a row meets once. Spark would put a filter on its result below the projection and call it in both,
    by two Python workers a core that stay with the executor."""
    return F.pandas_udf(function, returns).asNondeterministic()


def among(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The ``rows`` whose long column ``name`` is one of ``ids`` (a column of that name). The rows stay where they are: what is
    broadcast is a bit a number, in blocks of 4 KB, so numbers should lie close together."""
    block, bit = F.bitmap_bucket_number(F.col(name)), F.bitmap_bit_position(F.col(name))
    bits = ids.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(bits), block == F.col("block"))
    return found.where(byte.bitwiseAND(F.expr(f"shiftleft(1, CAST(bitmap_bit_position(`{name}`) % 8 AS INT))")) != 0).select(*rows.columns)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nobody refers to any more; else they stay until the driver's JVM
    happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer file; the folder can be set with TOKENIZERS_DIR."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
