"""Segmentation losses and scores as one-pass aggregates of truth t and prediction p."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EPS = 1e-7


def _clipped(p: Column) -> Column:
    return F.greatest(F.lit(_EPS), F.least(F.lit(1 - _EPS), p))


def cross_entropy(t: Column, p: Column) -> Column:
    q = _clipped(p)
    return F.avg(-(t * F.log(q) + (1 - t) * F.log(1 - q)))


def dice(t: Column, p: Column, smooth: float = 1.0) -> Column:
    return (2 * F.sum(t * p) + smooth) / (F.sum(t) + F.sum(p) + smooth)


def tversky_loss(t: Column, p: Column, smooth: float = 1.0, false_positive: float = 0.3, false_negative: float = 0.7) -> Column:
    hit = F.sum(t * p)
    rest = false_positive * F.sum((1 - t) * p) + false_negative * F.sum(t * (1 - p))
    return 1 - (hit + smooth) / (hit + rest + smooth)


def focal_loss(t: Column, p: Column, alpha: float = 0.8, gamma: float = 2.0) -> Column:
    bce = cross_entropy(t, p)
    return alpha * F.pow(1 - F.exp(-bce), F.lit(gamma)) * bce


def focal_tversky_loss(t: Column, p: Column) -> Column:
    return 10 * focal_loss(t, p) + tversky_loss(t, p)


def squared_error_x10(t: Column, p: Column) -> Column:
    return 10 * F.avg((t - p) * (t - p))


def dice_loss(t: Column, p: Column, smooth: float = 1.0) -> Column:
    return 1 - dice(t, p, smooth)


def dice_bce_loss(t: Column, p: Column) -> Column:
    return dice_loss(t, p) + 10 * cross_entropy(t, p)


#: The weights of three classes.
CLASS_WEIGHTS = (0.36650165, 11.27804614, 5.46951642)


def categorical_cross_entropy(classes: list[tuple[Column, Column]]) -> Column:
    """Mean over rows of -sum over classes of t log p, the p of a row scaled to a sum of one."""
    total = sum(p for _, p in classes)
    return F.avg(-sum(t * F.log(_clipped(p / total)) for t, p in classes))


def weighted_cross_entropy(classes: list[tuple[Column, Column]], weights: tuple[float, ...] = CLASS_WEIGHTS) -> Column:
    """The mean categorical cross entropy times each weight, summed: the weights scale the whole, not its classes."""
    return float(sum(weights)) * categorical_cross_entropy(classes)


def class_weighted_cross_entropy(classes: list[tuple[Column, Column]], weights: tuple[float, ...] = CLASS_WEIGHTS) -> Column:
    """Mean over rows of -sum over classes of weight * t * log p, for (t, p) of each class."""
    return F.avg(-sum(w * t * F.log(_clipped(p)) for w, (t, p) in zip(weights, classes, strict=True)))


def memory_gigabytes(outputs: list[tuple[int | None, ...]], parameters: int, batch: int, number_bytes: int = 4) -> float:
    """Memory of a net's outputs (shapes by layer; None for the batch axis) and parameters."""
    cells = sum(math.prod(n for n in shape if n is not None) for shape in outputs)
    return round(number_bytes * (batch * cells + parameters) / 1024**3, 3)


def all_metrics(df: DataFrame, by: tuple[str, ...] = ("img",), t: str = "t", p: str = "p") -> DataFrame:
    """Every metric of each group in one aggregate."""
    a, b = F.col(t), F.col(p)
    return df.groupBy(*by).agg(
        dice(a, b).alias("dice"), tversky_loss(a, b).alias("tversky"), focal_loss(a, b).alias("focal"), focal_tversky_loss(a, b).alias("focal_tversky"),
        squared_error_x10(a, b).alias("mse_x10"), cross_entropy(a, b).alias("bce"), dice_bce_loss(a, b).alias("dice_bce"),
    )
