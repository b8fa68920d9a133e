"""Gain, leaf weight and soft threshold of gradient sums, as columns that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def soft_threshold(g: Column, alpha: float) -> Column:
    return F.when(g > alpha, g - alpha).when(g < -alpha, g + alpha).otherwise(F.lit(0.0)) if alpha else g


def gain(g: Column, h: Column, lam: float = 1.0, alpha: float = 0.0, delta: float = 2.0) -> Column:
    """What a node of these sums gains; with ``delta`` the weight is bounded."""
    c = soft_threshold(g, alpha)
    w = -c / (h + lam)
    free = -w * c
    if not delta:
        return free
    bound = F.when(w < 0, F.lit(-float(delta))).otherwise(F.lit(float(delta)))
    held = -(2 * g * bound + (h + lam) * bound * bound) + alpha * F.abs(bound)
    return F.when(F.abs(w) > delta, held).otherwise(free)


def weight(g: Column, h: Column, lam: float = 1.0, alpha: float = 0.0, delta: float = 2.0) -> Column:
    w = -soft_threshold(g, alpha) / (F.greatest(h, F.lit(0.0)) + lam)
    return F.least(F.greatest(w, F.lit(-float(delta))), F.lit(float(delta))) if delta else w


def leaf_value(g: Column, h: Column, eta: float = 0.3, min_hess: float = 0.0, lam: float = 1.0, alpha: float = 0.0, delta: float = 2.0) -> Column:
    return F.when(h <= min_hess, F.lit(0.0)).otherwise(weight(g, h, lam, alpha, delta) * eta)


def forest_value(g: Column, h: Column) -> Column:
    """The share of positives of a leaf, 0.5 for an empty one."""
    return F.when(h <= 0, F.lit(0.5)).when(g <= 0, F.lit(0.0)).otherwise(F.least(g / h, F.lit(1.0)))
