"""Serial numbers of a result of any size.

A window without a partition key would sort the whole result in one task.  Here
the result is sorted into range slices, each row gets its place within its slice,
and the slices' row counts, summed up in order, give what to add per slice.  Only
the counts (a row per slice) reach the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakes.sources.table import materialize

#: ``monotonically_increasing_id`` holds the slice above these bits and the place below.
PLACE_BITS = 33


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the next like it that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def serial_numbers(result: DataFrame, *order: Column | str, name: str = "S_No") -> DataFrame:
    """R2: 1-based serial number in the given order, as the first column.

    Rows equal in ``order`` go by all other columns and are numbered alike in every
    run; rows equal in all columns are split over slices like any other (each has
    an arrival number behind them), so no value is too frequent.  Null order values go
    where the given order puts them.  An empty result gives an empty one; ``name`` may
    not be a column of the result.
    """
    if name.lower() in {c.lower() for c in result.columns}:
        raise ValueError(f"the result has a column {name} already")
    arrival, place = free_name(result, "_arrival"), free_name(result, "_place")
    rest = [F.col(c) for c, kind in result.dtypes if not kind.startswith(("map", "variant"))]
    rows = result.withColumn(arrival, F.monotonically_increasing_id())
    # a sort is a range shuffle and a sort within slices; ids are given after it
    rows = rows.sort(*order, *rest, arrival).withColumn(place, F.monotonically_increasing_id()).drop(arrival)
    stored = materialize(rows, "serial")
    part = F.shiftright(F.col(place), PLACE_BITS)
    counts = sorted((r[0], r[1]) for r in stored.groupBy(part).count().collect())  # a row per slice
    before = dict(zip((s for s, _ in counts), accumulate((n for _, n in counts), initial=0), strict=False))
    spark = result.sparkSession
    offsets = spark.createDataFrame(sorted(before.items()), "_slice int, _before long") if before else None
    if offsets is None:
        return stored.select(F.lit(0).cast("long").alias(name), *result.columns)
    within = F.col(place) - F.shiftleft(part, PLACE_BITS)
    joined = stored.join(F.broadcast(offsets), part == F.col("_slice"))
    return joined.select((F.col("_before") + within + 1).alias(name), *result.columns)
