"""Losses as column factories: each gives the gradient and hessian of a row from label and margin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def softmax(margins: Column) -> Column:
    """Of an array of margins, shifted by the largest."""
    shifted = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda e: e / total)


def cross_entropy(y: Column, margin: Column) -> tuple[Column, Column]:
    p = sigmoid(margin)
    return p - y, p * (1 - p)


def log_loss(y: Column, margin: Column) -> Column:
    """Of one row; its mean is the loss."""
    p = sigmoid(margin)
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def softmax_cross_entropy(y: Column, margins: Column) -> tuple[Column, Column]:
    """Gradients and hessians of all classes at once, as arrays; ``y`` is the class number."""
    p = softmax(margins)
    return F.transform(p, lambda v, i: v - (i == y).cast("double")), F.transform(p, lambda v: v * (1 - v))


def least_squares(y: Column, margin: Column) -> tuple[Column, Column]:
    return margin - y, F.lit(1.0)


def forest(y: Column, margin: Column) -> tuple[Column, Column]:
    """Random-forest votes: the gradient counts positives, the hessian rows."""
    return (y == 1).cast("double"), F.lit(1.0)


LOSSES: dict[str, Callable[[Column, Column], tuple[Column, Column]]] = {"cross_entropy": cross_entropy, "least_squares": least_squares, "forest": forest}


def clipped(value: Column, bound: float) -> Column:
    return F.least(F.greatest(value, F.lit(-bound)), F.lit(bound))
