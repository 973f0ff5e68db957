"""Cleaning operators C1-C8, C12.  Every step is DataFrame -> DataFrame and
built from JVM expressions, so the whole cleaning is one narrow projection
(no shuffle) except the median computation, a distributed selection that
returns seven scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakes.functions.rules import ALERT_MISSING, DOUBLE_COLUMNS, EMPTY_COLUMNS, MEDIAN_FILL_COLUMNS
from quakes.functions.text import country_of, last_comma_part, strip_ws
from quakes.functions.timeparts import time_parts
from quakes.operators.median import exact_medians


def add_time_parts(df: DataFrame, ts: str = "time") -> DataFrame:
    """C1."""
    return df.withColumns(time_parts(F.col(ts)))


def drop_empty(df: DataFrame, cols: list[str] = EMPTY_COLUMNS) -> DataFrame:
    """C2."""
    return df.drop(*cols)


def strip_place(df: DataFrame) -> DataFrame:
    """C3."""
    return df.withColumn("place", strip_ws(F.col("place")))


def add_country(df: DataFrame, rewrite: bool = True) -> DataFrame:
    """C4 + C5: last comma part of the place, then the ordered rewrites.

    ``rewrite=False`` stops after C4; the pipeline then applies C5 once per
    distinct text inside the country lookup (``enrich.country_lookup``).
    """
    if rewrite:
        return df.withColumn("country", country_of(F.col("place")))
    return df.withColumn("country", last_comma_part(F.col("place")))


def lower_alert(df: DataFrame) -> DataFrame:
    """C6."""
    return df.withColumn("alert", F.lower(F.col("alert")))


def cast_doubles(df: DataFrame, cols: list[str] = DOUBLE_COLUMNS, strict: bool = True) -> DataFrame:
    """Strict casts raise on bad text (ANSI); ``strict=False`` turns it into null."""
    conv = (lambda c: F.col(c).cast("double")) if strict else (lambda c: F.try_cast(F.col(c), "double"))
    return df.withColumns({c: conv(c) for c in cols})


def column_medians(
    df: DataFrame, cols: list[str] = MEDIAN_FILL_COLUMNS, approx_accuracy: int | None = None
) -> dict[str, float | None]:
    """Exact medians of non-null values (midpoint of the two middle values), by the
    distributed selection of ``operators.median``: no task holds a column's values.
    ``approx_accuracy`` (e.g. 100000) asks for a fixed-size sketch per task instead:
    relative rank error 1/accuracy, the lower middle value and not the midpoint.
    """
    if not approx_accuracy:
        return exact_medians(df, cols, uuid.uuid4().hex)
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, approx_accuracy).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def fill_medians(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """Replace nulls by the given medians (the column becomes double)."""
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(m).cast("double")) for c, m in medians.items()}
    )


def fill_alert(df: DataFrame, value: str = ALERT_MISSING) -> DataFrame:
    """C12."""
    return df.withColumn("alert", F.coalesce(F.col("alert"), F.lit(value)))


def clean_unfilled(raw: DataFrame, rewrite: bool = True) -> DataFrame:
    """Everything before the fills (what the profiles look at)."""
    return (
        raw.transform(add_time_parts)
        .transform(drop_empty)
        .transform(strip_place)
        .transform(add_country, rewrite)
        .transform(lower_alert)
        .transform(cast_doubles)
    )


def clean(raw: DataFrame, medians: dict[str, float | None] | None = None, rewrite: bool = True) -> DataFrame:
    """C1-C8, C12 in the catalogue's order.  Medians are computed from the
    data unless given (e.g. when appending a month to an existing table)."""
    df = clean_unfilled(raw, rewrite)
    if medians is None:
        medians = column_medians(df)
    return df.transform(fill_medians, medians).transform(fill_alert)
