"""Column functions on sampled segments (arrays of double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def argmin(x: Column) -> Column:
    """Place of the first smallest element, from 1."""
    return F.array_position(x, F.array_min(x))


def argmax(x: Column) -> Column:
    return F.array_position(x, F.array_max(x))


def reach(x: Column) -> Column:
    """Largest less smallest element."""
    return F.array_max(x) - F.array_min(x)


def cropped(x: Column, before: int, after: int) -> Column:
    """``before`` elements up to the first minimum and ``after`` from it on; the border elements repeat beyond the ends."""
    at, n = argmin(x), F.size(x)
    place = lambda k: F.least(F.greatest(at + k, F.lit(1)), n)
    return F.transform(F.sequence(F.lit(-before), F.lit(after - 1)), lambda k: F.element_at(x, place(k).cast("int")))


def scaled_to_peak(x: Column) -> Column:
    """``x`` less its mean, over the largest absolute value of that; zeros for a constant one. ``x`` should be a column, not an expression."""
    m = mean(x)
    top = F.greatest(F.array_max(x) - m, m - F.array_min(x))
    return F.transform(x, lambda v: F.when(top > 0, (v - m) / top).otherwise(0.0))


def scaled_to_reach(x: Column) -> Column:
    """(x - mean) / (max - min), zeros for a constant one."""
    m, r = mean(x), reach(x)
    return F.transform(x, lambda v: F.when(r > 0, (v - m) / r).otherwise(0.0))


def polarity_normalised(x: Column, baseline: int) -> Column:
    """``x`` less the median of its first ``baseline`` elements, turned so that its largest deflection is negative."""
    ordered = F.array_sort(F.slice(x, 1, baseline))
    middle = (F.element_at(ordered, (baseline + 1) // 2) + F.element_at(ordered, baseline // 2 + 1)) / 2
    sign = F.when(F.abs(F.array_max(x) - middle) > F.abs(F.array_min(x) - middle), -1.0).otherwise(1.0)
    return F.transform(x, lambda v: (v - middle) * sign)


def block_means(x: Column, size: int) -> Column:
    """Means of whole blocks of ``size`` elements; a remainder is dropped."""
    n = F.floor(F.size(x) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: mean(F.slice(x, i * size + 1, F.lit(size))))).otherwise(F.array().cast("array<double>"))


def width_at_half(x: Column) -> Column:
    """Elements around the first minimum that lie below half of it."""
    at, half = argmin(x).cast("int"), F.array_min(x) / 2
    above = lambda part: F.filter(F.transform(part, lambda v, i: F.when(v > half, i)), lambda i: i.isNotNull())
    right = F.coalesce(F.get(above(F.slice(x, at, F.size(x))), 0), F.size(x) - at + 1)
    left = F.coalesce(F.get(above(F.reverse(F.slice(x, 1, at))), 0), at)
    return left + right - 1
