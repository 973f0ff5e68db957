"""Exact medians without a single-task merge (G8 at any cardinality).

``F.median`` is exact but its final aggregate merges one value -> count map per
column in one task: fine for coarse measurements, not for a column whose
distinct values grow with the data.  This selection keeps every task bounded:

1. ``(col_name, value) -> count``: a partial + final aggregate (hot values
   collapse map-side); materialised so later steps read one consistent copy.
2. The counts are range-partitioned by (col_name, value); each slice reports
   its total and value bounds.  That table has at most
   partitions x columns rows.
3. Prefix sums over the slices (small) locate the slice holding each middle
   rank; only those slices are ranked with a window, one slice per task.

The median is the midpoint of the values at 0-based ranks ``(n - 1) // 2``
and ``n // 2`` of the non-null values, as for pandas / ``F.median``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakes.sources.table import materialize


def value_counts_long(df: DataFrame, cols: list[str]) -> DataFrame:
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return (
        wide.unpivot([], cols, "col_name", "value")
        .where(F.col("value").isNotNull())
        .groupBy("col_name", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def exact_quantiles(
    df: DataFrame, cols: list[str], qs: list[float], *cache_key: str, slices: int | None = None
) -> dict[tuple[str, float], float | None]:
    """Exact quantiles with linear interpolation between the values at ranks
    ``floor((n-1)q)`` and ``ceil((n-1)q)`` (as pandas and Spark's percentile)."""
    return quantiles_of_counts(materialize(value_counts_long(df, cols), *cache_key, "quantile_counts"), cols, qs, slices)


def quantiles_of_counts(
    counts: DataFrame, cols: list[str], qs: list[float], slices: int | None = None
) -> dict[tuple[str, float], float | None]:
    """The same from a stored table ``col_name, value, cnt`` with a row per value."""
    ranged = counts.repartitionByRange(slices, "col_name", "value") if slices else counts.repartitionByRange(
        "col_name", "value"
    )
    bounds = ranged.groupBy(F.spark_partition_id().alias("slice"), "col_name").agg(
        F.sum("cnt").alias("cnt"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    # Bounded by slices x columns rows: ordering it in one task is cheap.
    w = Window.partitionBy("col_name").orderBy("lo")
    before = F.coalesce(F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("cnt").over(Window.partitionBy("col_name"))
    slices_df = bounds.select("col_name", "lo", "hi", "cnt", before.alias("before"), total.alias("n"))
    pos = (F.col("n") - 1) * F.col("q")
    ranks = F.array(F.floor(pos), F.ceil(pos))
    targets = (
        slices_df.select("*", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
        .select("*", F.explode(ranks).alias("rank"))
        .where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("cnt")))
        .select("col_name", "lo", "hi", "before", "n", "rank")
        .distinct()
    )
    # Only the slices holding a wanted rank are ranked (bounded by slice size).
    picked = counts.join(F.broadcast(targets), "col_name").where(F.col("value").between(F.col("lo"), F.col("hi")))
    ws = Window.partitionBy("col_name", "rank").orderBy("value")
    upto = F.col("before") + F.sum("cnt").over(ws.rowsBetween(Window.unboundedPreceding, 0))
    at_rank = (
        picked.select("col_name", "rank", "value", "cnt", "n", upto.alias("upto"))
        .where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("cnt") <= F.col("rank")))
        .select("col_name", "rank", "value", "n")
    )
    rows = at_rank.collect()  # 2 per (column, quantile)
    values = {(r.col_name, r.rank): r.value for r in rows}
    totals = {r.col_name: r.n for r in rows}
    out: dict[tuple[str, float], float | None] = {}
    for c in cols:
        n = totals.get(c)
        for q in qs:
            if not n:
                out[(c, q)] = None
                continue
            p = (n - 1) * q
            lo, hi = math.floor(p), math.ceil(p)
            a, b = values[(c, lo)], values[(c, hi)]
            out[(c, q)] = a if lo == hi else (hi - p) * a + (p - lo) * b
    return out


def exact_medians(df: DataFrame, cols: list[str], *cache_key: str, slices: int | None = None) -> dict[str, float | None]:
    """Exact median per column (midpoint of the two middle values)."""
    got = exact_quantiles(df, cols, [0.5], *cache_key, slices=slices)
    return {c: got[(c, 0.5)] for c in cols}
