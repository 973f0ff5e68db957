"""C8-C11, C13, G8-G10 from a state that is kept per month.

A month's state holds, for every profiled column, how often each value occurs, and for
every column the number of its nulls.  States of months merge by sums, so a profile of
the whole table reads the states alone, and a month that is added or corrected costs a
read of that month.  Medians and quartiles are exact: ranks are found in the merged
counts by the distributed selection of ``operators.median``.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakes.operators.median import quantiles_of_counts
from quakes.operators.profile import PROFILE_COLUMNS, quartile_rows, top_counts
from quakes.sources.incremental import clear_windows, months_between
from quakes.sources.table import materialize

TEXT_COLUMNS = ["alert"]
QUARTILES = [0.25, 0.5, 0.75]


def month_counts(
    df: DataFrame, numbers: list[str] = PROFILE_COLUMNS, texts: list[str] = TEXT_COLUMNS, time: str = "time"
) -> DataFrame:
    """``kind, col_name, value, text, cnt, year, month`` of the rows of ``df``: kind ``number``
    and ``text`` count a value, kind ``nulls`` the nulls of a column.  Rows without a time
    are a month of their own (null); an empty table has no state."""
    keys = [F.year(time).alias("_year"), F.month(time).alias("_month")]
    none, label = F.lit(None), lambda kind, c: [F.lit(kind).alias("kind"), F.lit(c).alias("col_name")]
    entry = lambda kind, c, v, t: F.struct(*label(kind, c), v.cast("double").alias("value"), t.cast("string").alias("text"))
    entries = [entry("number", c, F.col(c), none) for c in numbers] + [entry("text", c, none, F.col(c)) for c in texts]
    met = df.select(*keys, F.explode(F.array(*entries)).alias("e")).select("_year", "_month", "e.*")
    values = (
        met.where("value IS NOT NULL OR text IS NOT NULL")
        .groupBy("_year", "_month", "kind", "col_name", "value", "text")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    # a row per month, then a row per month and column
    wide = df.groupBy(*keys).agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)))
    each = [F.struct(*label("nulls", c), F.col(f"n{i}").alias("cnt")) for i, c in enumerate(df.columns)]
    nulls = wide.select("_year", "_month", F.explode(F.array(*each)).alias("e")).select(
        "_year", "_month", "e.kind", "e.col_name", none.cast("double").alias("value"), none.cast("string").alias("text"), "e.cnt"
    )
    both = values.unionByName(nulls)
    return both.select("kind", "col_name", "value", "text", "cnt", F.col("_year").alias("year"), F.col("_month").alias("month"))


def save_months(
    df: DataFrame, path: str, start: dt.date | str | None = None, end: dt.date | str | None = None, time: str = "time", **columns
) -> DataFrame:
    """Put the state of ``df`` in the place of its months' states at ``path`` and return the
    states of all months.  With ``start`` and ``end`` (first days of months) only the rows
    in ``[start, end)`` are read, and windows without a row lose their state; without them
    every month that ``df`` has is replaced and no other.  A load again changes nothing."""
    spark, windows = df.sparkSession, []
    if (start is None) != (end is None):
        raise ValueError("start and end go together")
    if start is not None:
        start, end = (dt.date.fromisoformat(d) if isinstance(d, str) else d for d in (start, end))
        windows = months_between(start, end)
        at = lambda d: F.lit(str(d)).cast("timestamp_ntz")
        df = df.where((F.col(time) >= at(start)) & (F.col(time) < at(end)))
    state = month_counts(df, time=time, **columns).hint("rebalance", "year", "month")
    schema = state.schema
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)
    if windows:
        clear_windows(spark, path, windows, df.select(F.year(time), F.month(time)))
    return spark.read.schema(schema).parquet(path)


def _numbers(state: DataFrame) -> DataFrame:
    """Merged counts: ``col_name, value, cnt``."""
    return state.where("kind = 'number'").groupBy("col_name", "value").agg(F.sum("cnt").alias("cnt"))


def state_modes(state: DataFrame) -> DataFrame:
    """Every most frequent value per column."""
    return top_counts(_numbers(state).withColumnRenamed("cnt", "count"))


def state_value_counts(state: DataFrame, col: str) -> DataFrame:
    """Frequency table of a text column, most frequent first."""
    rows = state.where((F.col("kind") == "text") & (F.col("col_name") == col))
    return rows.groupBy(F.col("text").alias(col)).agg(F.sum("cnt").alias("count")).orderBy(F.desc("count"), F.asc(col))


def state_null_counts(state: DataFrame) -> DataFrame:
    """C11: ``col_name, null_count``."""
    return state.where("kind = 'nulls'").groupBy("col_name").agg(F.sum("cnt").alias("null_count"))


def state_medians(state: DataFrame, cols: list[str] = PROFILE_COLUMNS) -> dict[str, float | None]:
    """Exact medians."""
    got = quantiles_of_counts(materialize(_numbers(state), uuid.uuid4().hex, "month_counts"), cols, [0.5])
    return {c: got[(c, 0.5)] for c in cols}


def state_describe(state: DataFrame, cols: list[str] = PROFILE_COLUMNS) -> DataFrame:
    """Count, mean, std, min, exact quartiles, max per column that has a value."""
    counts = materialize(_numbers(state).where(F.col("col_name").isin(cols)), uuid.uuid4().hex, "month_counts")
    weight = F.col("cnt") * F.col("value")
    first = counts.groupBy("col_name").agg(
        F.sum("cnt").alias("count"), F.sum(weight).alias("_sum"), F.min("value").alias("min"), F.max("value").alias("max")
    ).withColumn("mean", F.col("_sum") / F.col("count"))
    # a row per column on the broadcast side; deviations from the mean, so no cancellation
    apart = counts.join(F.broadcast(first.select("col_name", "mean")), "col_name")
    squares = apart.groupBy("col_name").agg(F.sum(F.col("cnt") * F.pow(F.col("value") - F.col("mean"), 2)).alias("_squares"))
    std = F.when(F.col("count") > 1, F.sqrt(F.col("_squares") / (F.col("count") - 1)))
    quart = quartile_rows(counts.sparkSession, cols, quantiles_of_counts(counts, cols, QUARTILES))
    joined = first.join(F.broadcast(squares), "col_name").join(F.broadcast(quart), "col_name")
    return joined.select("col_name", "count", "mean", std.alias("std"), "min", "p25", "p50", "p75", "max")
