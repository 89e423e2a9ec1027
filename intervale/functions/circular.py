"""Circular statistics as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 18


def resultant(phase: Column, weight: Column | None = None) -> Column:
    """Length of the mean unit vector; with weights, of the weighted sum over the number of values."""
    w = F.lit(1.0) if weight is None else weight
    c, s = F.avg(w * F.cos(phase)), F.avg(w * F.sin(phase))
    return F.sqrt(c * c + s * s)


def mean_direction(phase: Column) -> Column:
    """Circular mean in [0, 2 pi)."""
    return F.pmod(F.atan2(F.avg(F.sin(phase)), F.avg(F.cos(phase))), F.lit(6.283185307179586))


def rayleigh(n: Column, r: Column) -> tuple[Column, Column]:
    """Z = n R^2 and the four-term series of its p-value, within [0, 1]; fewer than two values give (0, 1)."""
    z = n * r * r
    x = n.cast("double")
    series = F.exp(-z) * (1 + (2 * z - z * z) / (4 * x) - (24 * z - 132 * z * z + 76 * z * z * z - 9 * z * z * z * z) / (288 * x * x))
    return F.when(n < 2, 0.0).otherwise(z), F.when(n < 2, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def phase_bin(phase: Column, bins: int) -> Column:
    return F.least(F.floor(phase / (6.283185307179586 / bins)), F.lit(bins - 1)).cast("long")


def modulation_index(means: Column, bins: int = BINS) -> Column:
    """Divergence of an array of ``bins`` mean amplitudes from the uniform one, over log(bins); empty bins count as 0."""
    total = F.aggregate(means, F.lit(0.0), lambda a, v: a + v)
    eps = 1e-10
    parts = F.transform(means, lambda v: v / total * F.log((v / total + eps) / (1.0 / bins + eps)))
    return F.when(total > 0, F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / F.log(F.lit(float(bins))))
