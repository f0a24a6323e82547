"""CSV scans by header signature, with a quarantine for rows that do not parse.

Files are grouped by their own header; each group is read in its own column order and the groups meet by name, so files whose
columns are ordered differently, or that lack some, give one table. What a row that does not parse holds is not guessed: the row
is left out of the table and can be read from the quarantine, with its file and line.
"""

from __future__ import annotations

import csv
import logging
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transloom.sources.shared import file_system

log = logging.getLogger(__name__)

#: Where Spark puts the text of a row that does not parse.
BAD = "__bad_record"
#: Headers that are read at once.
READERS = 16


def data_files(spark: SparkSession, patterns: str | Sequence[str]) -> list[str]:
    """The data files that the patterns name, folders opened; sorted."""
    found = []
    for pattern in [patterns] if isinstance(patterns, str) else patterns:
        fs, path = file_system(spark, pattern)
        for status in fs.globStatus(path) or []:
            if status.isFile():
                found.append(status.getPath().toString())
                continue
            inside = fs.listFiles(status.getPath(), True)
            while inside.hasNext():
                p = inside.next().getPath()
                if not p.getName().startswith(("_", ".")):
                    found.append(p.toString())
    return sorted(set(found))


def header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """The column names in a file's first line (compressed files too); none for an empty file."""
    fs, path = file_system(spark, file)
    jvm = spark._jvm
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(path)
    stream = fs.open(path)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        line = reader.readLine()
    finally:
        stream.close()
    return tuple(name.strip() for name in next(csv.reader([line.removeprefix("\ufeff")]))) if line else ()


def header_groups(spark: SparkSession, patterns: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their headers; only the first line of each file is read. A header that names a column twice is an error."""
    files = data_files(spark, patterns)
    with ThreadPoolExecutor(READERS) as pool:
        headers = list(pool.map(lambda f: header(spark, f), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, names in zip(files, headers, strict=True):
        if len({n.lower() for n in names}) < len(names):
            raise ValueError(f"{file} names a column twice: {', '.join(names)}")
        if names:
            groups.setdefault(names, []).append(file)
    return groups


def _read(spark: SparkSession, names: Sequence[str], files: list[str], schema: T.StructType) -> DataFrame:
    kinds = {f.name.lower(): f for f in schema.fields}
    fields = [kinds.get(n.lower(), T.StructField(n, T.StringType())) for n in names]
    reader = spark.read.option("header", True).option("columnNameOfCorruptRecord", BAD)
    rows = reader.schema(T.StructType([*fields, T.StructField(BAD, T.StringType())])).csv(files)
    # Spark parses the columns that a plan uses; a condition that always holds uses all of them, so that which rows parse does
    # not depend on the columns that are asked for
    return rows.where(F.hash(*[f"`{f.name}`" for f in fields]) >= -(1 << 31))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scan_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None, schema: T.StructType) -> DataFrame:
    """Rows of all files that parse, typed by the column names in their own file's header.

    A column that some files lack is null in their rows; wanted columns that all files lack are left out with a warning; names
    that the schema does not know are text. Columns of the schema are named as it names them, whatever their case.
    """
    groups = header_groups(spark, path)
    if not groups:
        raise FileNotFoundError(f"no CSV file with a header in {path}")
    rows = union_all([_read(spark, names, files, schema).where(F.col(BAD).isNull()).drop(BAD) for names, files in groups.items()])
    if columns is None:
        return rows
    absent = [c for c in columns if c not in rows.columns]
    if absent:
        log.warning("columns not in %s: %s", path, absent)
    return rows.select([c for c in columns if c in rows.columns])


def quarantine(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """(file, line, record) of the rows that ``scan_csv`` leaves out; lines count from 1, the header included.

    Lines are counted for the files that have such rows: a file's splits are numbered by their line counts, and only those
    counts are summed up file by file.
    """
    groups = header_groups(spark, path)
    empty = spark.createDataFrame([], "file string, line long, record string")
    if not groups:
        return empty
    file = F.col("_metadata.file_path").alias("file")
    bad = union_all([_read(spark, names, files, schema).select(file, F.col(BAD).alias("record")).where("record IS NOT NULL") for names, files in groups.items()])
    bad = bad.distinct()  # what does not parse once does not parse elsewhere in its file
    named = [r["file"] for r in bad.select("file").distinct().collect()]  # names of files
    if not named:
        return empty
    lines = spark.read.text(named).select(file, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("record"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    found = lines.join(bad, ["file", "record"], "left_semi").join(blocks, ["file", "block"])
    return found.select("file", (F.col("nth") + F.col("shift")).alias("line"), "record").where("line > 1")
