"""Depth and magnitude classes (D1, D2) and the estimate weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quakes.functions.rules import (
    ALERT_LOSS_WEIGHTS,
    CASUALTY_WEIGHTS,
    INTERMEDIATE_BELOW_KM,
    LOSS_WEIGHTS,
    MAG_CLASSES,
    MAG_TOP_CLASS,
    SHALLOW_BELOW_KM,
)


def depth_class(depth: Column) -> Column:
    """< 70 Shallow, < 300 Intermediate, else Deep (a null depth is Deep)."""
    return (
        F.when(depth < SHALLOW_BELOW_KM, "Shallow")
        .when(depth < INTERMEDIATE_BELOW_KM, "Intermediate")
        .otherwise("Deep")
    )


def mag_class(mag: Column) -> Column:
    """Minor / Light / Moderate / Strong, else Destructive (null too)."""
    (b0, c0), *rest = MAG_CLASSES
    expr = F.when(mag < b0, c0)
    for bound, cls in rest:
        expr = expr.when(mag < bound, cls)
    return expr.otherwise(MAG_TOP_CLASS)


def weight_of(c: Column, weights: dict[str, int], default: int = 0) -> Column:
    """Searched CASE over class labels -> weight, ELSE default."""
    items = list(weights.items())
    expr = F.when(c == items[0][0], F.lit(items[0][1]))
    for label, w in items[1:]:
        expr = expr.when(c == label, F.lit(w))
    return expr.otherwise(F.lit(default))


def casualty_weight(intensity: Column) -> Column:
    return weight_of(intensity, CASUALTY_WEIGHTS)


def loss_weight(intensity: Column) -> Column:
    return weight_of(intensity, LOSS_WEIGHTS)


def alert_loss_weight(alert: Column) -> Column:
    return weight_of(alert, ALERT_LOSS_WEIGHTS)
