"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seqcast.schema import HORIZON, FEATURES, Category


def target_column(category: str) -> Column:
    """The column a category stands for; ALL gives the array of the five features."""
    wanted = Category.of(category)
    if wanted is Category.ALL:
        return F.array(*[F.col(name) for name in FEATURES])
    return F.col(wanted.value)


def split_position(n: Column, ratio: float) -> Column:
    """Rows that go to the train part: ``n * ratio`` rounded half up."""
    return F.floor(n * F.lit(float(ratio)) + F.lit(0.5)).cast("bigint")


def window_count(rows: Column, length: int) -> Column:
    """Windows cut from a part of ``rows`` rows: one per start in [0, rows - (length + HORIZON))."""
    return F.greatest(rows - F.lit(length + HORIZON), F.lit(0)).cast("bigint")


def scaled(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling into [0, 1]; a constant feature gives 0.5."""
    return F.when(high > low, (value - low) / (high - low)).when(value.isNotNull(), F.lit(0.5))


def unscaled(value: Column, low: Column, high: Column) -> Column:
    """Inverse of :func:`scaled`; a constant feature gives its minimum."""
    return value * (high - low) + low


def truncated_int(value: Column) -> Column:
    """Truncation toward zero, clamped to the 32-bit range."""
    return F.greatest(F.least(value, F.lit(2147483647.0)), F.lit(-2147483648.0)).cast("int")
