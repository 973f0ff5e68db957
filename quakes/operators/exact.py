"""Sums and averages that do not depend on the order of their rows.

A sum of doubles changes in its last digits with the order in which partial sums meet,
so equal groups may rank differently from run to run.  Summed as decimals the total is
exact, and one division gives the same double everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 9  # decimal places that count
DECIMAL = f"decimal(28,{SCALE})"  # its sums have 38 digits


def scaled(c: Column | str) -> Column:
    """The value at SCALE places; null if it is null or not a finite number."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d.cast(DECIMAL))


def exact_sum(c: Column | str) -> Column:
    """Sum at SCALE places (decimal); null without values."""
    return F.sum(scaled(c))


def exact_avg(c: Column | str) -> Column:
    """Average as a double: exact sum over count, divided once; null without values."""
    return F.try_divide(exact_sum(c).cast("double"), F.count(scaled(c)).cast("double"))
