"""Exact quantiles of groups of any size, without holding a group's values in one task.

``percentile`` and ``median`` buffer each different value of a group in its task. Here a rank is found by histograms: values
are counted once by (group, value), which spreads a hot group over all tasks; counts by coarse cells tell which cell holds the
rank; counts by fine cells inside it narrow it again; only the values of that fine cell are then put in order. A cell is any
function that never falls where the value rises, so rounding in it costs nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coarse cells of an octave, and what puts the cells of positive values behind zero.
PER_OCTAVE, SHIFT = 64, 70_000
#: Fine cells of a coarse one.
FINE = 1024
#: Values that a task may hold of each group; beyond, ranks are selected.
BUFFERED = 1 << 16


def coarse_cell(v: Column) -> Column:
    """A cell of relative width 2^(1/PER_OCTAVE); infinities and NaN (the largest of all) have cells of their own."""
    size = F.abs(v)
    of = F.when(v == 0, 0).when(size == float("inf"), 2 * SHIFT).otherwise(F.floor(F.log2(size) * PER_OCTAVE) + SHIFT)
    return F.when(F.isnan(v), 3 * SHIFT).when(v < 0, -of).otherwise(of).cast("int")


def fine_cell(v: Column, lo: Column, hi: Column) -> Column:
    """One of FINE cells of equal width between ``lo`` and ``hi``."""
    return F.when((lo == hi) | (hi - lo == 0), 0).otherwise(F.least(F.lit(FINE - 1), F.floor((v - lo) / (hi - lo) * FINE))).cast("int")


def with_same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, nulls equal to nulls; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def _holding(counted: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """The rows of ``counted`` that hold one of the ranks ``__ranks``; ``__before`` is the number of values before the row."""
    upto = F.sum("__n").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = counted.withColumn("__start", F.col("__before") + upto - F.col("__n"))
    held = F.filter("__ranks", lambda r: (r >= F.col("__start")) & (r < F.col("__start") + F.col("__n")))
    return rows.withColumn("__ranks", held).where(F.size("__ranks") > 0).withColumn("__before", F.col("__start")).drop("__start", "__n")


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], name: str = "quantiles", buffered: int = BUFFERED) -> DataFrame:
    """(keys, ``name``): the quantiles of ``value`` at ``shares``, interpolated between ranks as ``percentile`` does.

    Null values do not count and groups without a value have no row; null keys are a group. Equal values count as often as
    they occur. NaN is larger than all numbers. Where a count shows that no group has over ``buffered`` values, the built-in
    function gives the same quantiles in one aggregation; 0 always selects.
    """
    keys = list(keys)
    rows = rows.where(F.col(value).isNotNull())
    if buffered and (rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= buffered:
        of = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(s)) for s in shares]))
        return rows.groupBy(*keys).agg(of.alias(name))
    values = rows.select(*keys, F.col(value).cast("double").alias("__v"))
    values = values.groupBy(*keys, "__v").agg(F.count("*").alias("__n")).withColumn("__c", coarse_cell(F.col("__v")))

    coarse = values.groupBy(*keys, "__c").agg(F.sum("__n").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    coarse = coarse.withColumns({"__all": F.sum("__n").over(Window.partitionBy(*keys)), "__before": F.lit(0)})
    place = lambda share: F.lit(float(share)) * (F.col("__all") - 1)
    ranks = F.array_distinct(F.array(*[r for s in shares for r in (F.floor(place(s)), F.ceil(place(s)))]))
    coarse = _holding(coarse.withColumn("__ranks", ranks), keys, "__c")

    inside = with_same_keys(values, coarse, [*keys, "__c"])
    inside = inside.withColumn("__f", fine_cell(F.col("__v"), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
    fine = inside.groupBy(*keys, "__c", "__f").agg(F.sum("__n").alias("__n"), F.first("__before").alias("__before"), F.first("__ranks").alias("__ranks"))
    fine = _holding(fine, [*keys, "__c"], "__f")

    last = with_same_keys(inside.drop("__before", "__ranks"), fine, [*keys, "__c", "__f"])
    last = _holding(last, [*keys, "__c", "__f"], "__v").select(*keys, "__all", "__v", F.explode("__ranks").alias("__rank"))
    found = last.groupBy(*keys).agg(F.first("__all").alias("__all"), F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))

    def quantile(share: float) -> Column:
        at = place(share)
        low, high = F.element_at("__at", F.floor(at)), F.element_at("__at", F.ceil(at))
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(*keys, F.array(*map(quantile, shares)).alias(name))
