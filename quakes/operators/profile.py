"""Data-profile operators C9-C11, C13.

All are distributed aggregates.  Several columns are profiled in one pass by
unpivoting to (col_name, value) first, so each column's work is its own group
instead of one task per statistic.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakes.operators.median import exact_quantiles

PROFILE_COLUMNS = ["mmi", "rms", "dmin", "gap", "nst", "cdi", "felt"]


def long_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col_name, value) for the non-null values of ``cols`` (cast to double)."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot([], cols, "col_name", "value").where(F.col("value").isNotNull())


def modes(df: DataFrame, cols: list[str] = PROFILE_COLUMNS) -> DataFrame:
    """Every most frequent value per column (ties all kept), nulls skipped.

    (col_name, value) counts are a partial+final aggregate; the per-column
    maximum is one row per column, joined back by broadcast (bounded by the
    number of profiled columns).
    """
    counts = long_values(df, cols).groupBy("col_name", "value").agg(F.count(F.lit(1)).alias("count"))
    return top_counts(counts)


def top_counts(counts: DataFrame) -> DataFrame:
    """The rows of ``col_name, value, count`` with their column's largest count."""
    top = counts.groupBy("col_name").agg(F.max("count").alias("_max"))
    return (
        counts.join(F.broadcast(top), "col_name")
        .where(F.col("count") == F.col("_max"))
        .select("col_name", "value", "count")
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency table of one column, nulls skipped, most frequent first."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc(col))
    )


def null_counts(df: DataFrame) -> DataFrame:
    """C11: (col_name, null_count) for every column, in one scan."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "col_name", "null_count")


def quartile_rows(spark: SparkSession, cols: list[str], got: dict[tuple[str, float], float | None]) -> DataFrame:
    """``col_name, p25, p50, p75``: a row per profiled column."""
    return spark.createDataFrame(
        pd.DataFrame(
            [(c, got[(c, 0.25)], got[(c, 0.5)], got[(c, 0.75)]) for c in cols],
            columns=["col_name", "p25", "p50", "p75"],
        ).astype({"p25": "float64", "p50": "float64", "p75": "float64"}),
        "col_name string, p25 double, p50 double, p75 double",
    )


def describe(df: DataFrame, cols: list[str] = PROFILE_COLUMNS, approx_accuracy: int | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles (exact, interpolated), max per column.

    Moments are one grouped aggregate.  Exact quartiles come from the
    distributed selection in ``operators.median`` (no task holds a whole
    column's values); ``approx_accuracy`` switches to a fixed-size sketch.
    """
    moments = [
        F.count(F.lit(1)).alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]
    out_cols = ["col_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    long = long_values(df, cols)
    if approx_accuracy:
        q = F.percentile_approx(F.col("value"), [0.25, 0.5, 0.75], approx_accuracy)
        agg = long.groupBy("col_name").agg(*moments, q.alias("_q"))
        quartiles = {"p25": F.col("_q")[0], "p50": F.col("_q")[1], "p75": F.col("_q")[2]}
        return agg.select(*[quartiles[c].alias(c) if c in quartiles else F.col(c) for c in out_cols])
    quart = quartile_rows(df.sparkSession, cols, exact_quantiles(df, cols, [0.25, 0.5, 0.75], "describe", uuid.uuid4().hex))
    # one row per profiled column on both sides
    return long.groupBy("col_name").agg(*moments).join(F.broadcast(quart), "col_name").select(*out_cols)
