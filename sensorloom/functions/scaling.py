"""Range checks and min-max scaling of single columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_nan(value: Column) -> Column:
    """NaN as NULL, so that averages skip it."""
    return F.when(~F.isnan(value), value)


def inside(value: Column, lo, hi) -> Column:
    """The value where it lies strictly between the limits, else NULL."""
    return F.when((value > lo) & (value < hi), value)


def normalize(value: Column, lo, hi) -> Column:
    lo, hi = _col(lo), _col(hi)
    return (value - lo) / (hi - lo)


def denormalize(value: Column, lo, hi) -> Column:
    lo, hi = _col(lo), _col(hi)
    return value * (hi - lo) + lo


def _col(limit) -> Column:
    return limit if isinstance(limit, Column) else F.lit(float(limit))
