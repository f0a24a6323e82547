"""The shared folder for intermediate tables, and what is kept there.

Executors can be lost at any time and do not see each other's disks, so whatever outlives a stage lies in the
folder that ``spark.checkpoint.dir`` names. Checkpoints that nobody refers to any more are deleted by Spark
itself if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set; tables that were written here are deleted when
the driver's process ends (a result may still read them before).
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. A session on one machine (tests) may leave it unset and gets a
    folder of its own; on a cluster that is an error, since executors would write to their own disks."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = f"file://{tempfile.mkdtemp(prefix='transloom-')}"
    spark.conf.set("spark.checkpoint.dir", where)
    return where


_MADE: list[tuple] = []


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """A path in the shared folder that nothing uses yet; what is written there lives as long as the driver."""
    path = f"{shared_dir(spark)}/transloom-{kind}-{uuid.uuid4().hex}"
    _MADE.append(file_system(spark, path))
    return path


@atexit.register
def _clear() -> None:
    for fs, path in _MADE:
        with contextlib.suppress(Exception):  # the gateway, or the folder, may be gone already
            fs.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, compression: str = "zstd", path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = path or new_folder(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(file system, path) as Hadoop sees them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.delete(p, True)
