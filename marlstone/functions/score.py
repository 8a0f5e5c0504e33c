"""Number expressions: rounding, normalising, scores."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def nice(value: Column, step: Column) -> Column:
    """value to the nearest multiple of step, halves up."""
    return half_up(value / step) * step


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def min_max(c: Column, *keys: str) -> Column:
    """(v - min) / (max - min) within the keys; 0.5 where all are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high == low, F.lit(0.5)).otherwise((c - low) / (high - low))


def sqrt_index(count: Column, most: Column) -> Column:
    """0 to 100 by the square root of the share of the largest count."""
    return F.round(100 * F.sqrt(count / most))


def growth(first: Column, last: Column) -> Column:
    """last / first - 1; 0 where first is 0."""
    return F.when(first == 0, F.lit(0.0)).otherwise(last / first - 1)


def at_clamped(series: Column, index: int) -> Column:
    """The element at a 0-based index, the nearest one if out of range, 0 of an empty series."""
    place = F.greatest(F.least(F.lit(index + 1), F.size(series)), F.lit(1))
    return F.when(F.size(series) > 0, F.get(series, place - 1)).otherwise(F.lit(0.0))


def per_cent_change(new: Column, old: Column, digits: int = 1) -> Column:
    """Change in per cent; null without an old value or if it is 0."""
    return F.round((new - old) / F.nullif(old, F.lit(0.0)) * 100, digits)
