"""Small column helpers: dates, row-wise array statistics, splitting and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(column: Column, pattern: str = "yyyy/MM/dd HH:mm:ss", strict: bool = False) -> Column:
    """Text to timestamp; unreadable text is null unless ``strict``."""
    return F.to_timestamp(column, pattern) if strict else F.try_to_timestamp(column, F.lit(pattern))


def month_number(ts: Column) -> Column:
    return F.month(ts)


def month_period(ts: Column) -> Column:
    """Year and month as ``yyyy-MM``."""
    return F.date_format(ts, "yyyy-MM")


def argmax(values: Column) -> Column:
    """0-based place of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def row_mean(values: Column) -> Column:
    """Mean of the elements that are neither null nor NaN; null when none is left."""
    kept = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.size(kept))


def row_max(values: Column) -> Column:
    return F.array_max(values)


def row_mode(values: Column) -> Column:
    """Most frequent element, the smallest one on ties, nulls ignored."""
    kept = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    tally = F.transform(
        F.array_distinct(kept),
        lambda v: F.struct((-F.size(F.filter(kept, lambda w: w == v))).alias("n"), v.alias("v")),
    )
    return F.array_min(tally).getField("v")


def split_labels(label: Column, separator: str = ";") -> Column:
    return F.transform(F.split(label, separator), lambda part: F.trim(part))


def name_category(name: Column) -> Column:
    """Part of a feature name before the first dash, then before the first underscore."""
    return F.substring_index(F.substring_index(name, "-", 1), "_", 1)


def f1(precision: Column, recall: Column, weight: float = 1.0) -> Column:
    """Harmonic mean of precision and recall, 0 if either is 0."""
    return F.when(precision * recall > 0, F.lit(weight) * 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
