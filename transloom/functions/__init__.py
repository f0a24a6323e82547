"""Column expressions; none of them runs Python per row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WMO weather codes by category (0 clear or unknown, 1 fog and cloud, 2 rain, 3 snow, 4 storm).
WMO_CATEGORIES = {1: (45, 48), 2: (*range(51, 58), *range(61, 68), *range(80, 83)), 3: (*range(71, 78), 85, 86), 4: (95, 96, 99)}
N_WEATHER_CATEGORIES = 5

#: Distance bands in miles, closed on the left.
DISTANCE_EDGES = (0, 250, 500, 750, 1000, 1500, 2000)
SEASONS = {"Winter": (12, 1, 2), "Spring": (3, 4, 5), "Summer": (6, 7, 8), "Fall": (9, 10, 11)}


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; null stays null (SQL greatest and least would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def nan_to_zero(c: Column) -> Column:
    """NaN becomes 0; null stays null."""
    c = c.cast("double")
    return F.when(F.isnan(c), 0.0).otherwise(c)


def inf_to_zero(c: Column) -> Column:
    """Infinities become 0; null and NaN stay."""
    c = c.cast("double")
    return F.when(F.abs(c) == float("inf"), 0.0).otherwise(c)


def zero_if_missing(c: Column) -> Column:
    """Null, NaN and infinities become 0."""
    return F.coalesce(inf_to_zero(nan_to_zero(c)), F.lit(0.0))


def clean_code(c: Column) -> Column:
    """An airport code as it is stored: trimmed, in capitals."""
    return F.upper(F.trim(c))


def parse_iso(c: Column) -> Column:
    """TIMESTAMP_NTZ of an ISO text; a zone at its end is cut off, not converted. Null for other texts."""
    return F.try_to_timestamp(F.regexp_replace(c, r"(Z|[+-]\d{2}:?\d{2})$", "")).cast("timestamp_ntz")


def two_digits(c: Column) -> Column:
    """A number below 100 with a leading zero, as in the names of hour partitions."""
    return F.lpad(c.cast("string"), 2, "0")


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a value on a cycle."""
    angle = value.cast("double") * F.lit(2 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def hhmm_hour(c: Column) -> Column:
    """Hour 0..23 of an HHMM number."""
    return clamp(F.floor(c / 100), 0, 23).cast("int")


def add_hours(ts: Column, hours: Column | int) -> Column:
    return F.timestamp_add("HOUR", hours if isinstance(hours, Column) else F.lit(hours), ts)


def date_hour(date: Column, hour: Column) -> Column:
    """TIMESTAMP_NTZ of a date and an hour."""
    return add_hours(date.cast("timestamp_ntz"), hour)


def floor_bucket(ts: Column, hours: int) -> Column:
    """Start of the epoch-aligned bucket of ``hours`` hours."""
    size = 3600 * hours
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / size) * size).cast("timestamp_ntz")


def wmo_category(code: Column) -> Column:
    out = F.lit(0)
    for category, codes in WMO_CATEGORIES.items():
        out = F.when(code.isin(*codes), category).otherwise(out)
    return out


def one_hot(c: Column, n: int = N_WEATHER_CATEGORIES) -> list[Column]:
    return [F.coalesce((c == k).cast("double"), F.lit(0.0)) for k in range(n)]


def distance_band(miles: Column) -> Column:
    """Label of the band, e.g. ``250-500``; null below 0 and for null."""
    out = F.lit(None).cast("string")
    for lo, hi in zip(DISTANCE_EDGES, [*DISTANCE_EDGES[1:], None], strict=True):
        label = f"{lo}+" if hi is None else f"{lo}-{hi}"
        out = F.when((miles >= lo) & (F.lit(True) if hi is None else miles < hi), label).otherwise(out)
    return out


def season(month: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        out = F.when(month.isin(*months), name).otherwise(out)
    return out


def part_of_day(hour: Column) -> Column:
    return F.when(hour < 6, "Night").when(hour < 12, "Morning").when(hour < 18, "Afternoon").otherwise("Evening")


def huber(error: Column, delta: float) -> Column:
    a = F.abs(error)
    return F.when(a <= delta, 0.5 * error * error).otherwise(delta * (a - 0.5 * delta))


def bce_with_logits(logit: Column, target: Column, pos_weight: float = 1.0) -> Column:
    """Stable binary cross-entropy of a logit."""
    soft = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    return (1 - target) * logit + (1 + (pos_weight - 1) * target) * soft


def horizon_weight(h: Column, horizons: Sequence[int], weights: Sequence[float] | None) -> Column:
    """Weights rescaled to sum to the number of horizons."""
    if weights is None:
        return F.lit(1.0)
    out = F.lit(None).cast("double")
    for k, w in zip(horizons, weights, strict=True):
        out = F.when(h == k, w * len(weights) / sum(weights)).otherwise(out)
    return out
