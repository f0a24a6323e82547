"""Labelled rows: all of them as (doc_id, label), and bounded samples on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.llm.common import remainder

#: Expected rows of each label value in a fitting sample: the documented bound.
ROWS_PER_LABEL = 4000
LEARN_MODULUS = 5
_STEPS = 1_000_000


def learning_rows(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of all learning rows: crc32(doc_id as text) mod 5 is not 0, id and label not null; of
    repeated ids the largest label counts."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where((remainder("doc_id", LEARN_MODULUS) != 0) & F.col("label").isNotNull())
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_label: int = ROWS_PER_LABEL) -> DataFrame:
    """(text, label) of about ``rows_per_label`` learning rows of each label value, chosen by a hash of the id.

    The ids of the sample are broadcast: at most about twice the bound, whatever the input.
    """
    rows = learning_rows(labels, label)
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(_STEPS)
    for value, n in counts.items():
        rate = F.when(F.col("label") == value, F.lit(min(_STEPS, -(-rows_per_label * _STEPS // n)))).otherwise(rate)
    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(_STEPS)) < rate)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(some), "doc_id").select("text", "label")
