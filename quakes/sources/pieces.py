"""Text files cut into pieces, with sums over all pieces before each.

A document or a quoted field may be larger than a task should read, and what a piece
of it means depends on all text before it.  Files are read in byte ranges as pieces
between separators; each range's sums are small, and summed up over a file's ranges
they tell every piece what precedes it.  No file has to be read by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A piece's place: its file, the first byte of its range, its number within the range.
PLACE = ("file", "block", "at")


def read_pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``file, block, at, piece``: the text between separators, in order of the place."""
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("piece"),
    )


def _before() -> tuple:
    within = Window.partitionBy("file", "block").orderBy("at")
    ranges = Window.partitionBy("file").orderBy("block")
    return within, within.rowsBetween(Window.unboundedPreceding, -1), ranges.rowsBetween(Window.unboundedPreceding, -1)


def sums_before(pieces: DataFrame, **columns: Column) -> DataFrame:
    """``pieces`` with a column for each of ``columns``: its sum over all earlier pieces
    of the same file."""
    _, earlier, earlier_ranges = _before()
    rows = pieces.withColumns({f"_{n}": c.cast("long") for n, c in columns.items()})
    totals = rows.groupBy("file", "block").agg(*(F.sum(f"_{n}").alias(f"_{n}_total") for n in columns))
    totals = totals.select(
        "file", "block", *(F.coalesce(F.sum(f"_{n}_total").over(earlier_ranges), F.lit(0)).alias(f"_{n}_ranges") for n in columns)
    )
    own = {n: F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)) for n in columns}
    rows = rows.withColumns(own).join(totals, ["file", "block"])
    rows = rows.withColumns({n: F.col(n) + F.col(f"_{n}_ranges") for n in columns})
    return rows.drop(*(f"_{n}" for n in columns), *(f"_{n}_ranges" for n in columns))


def last_before(pieces: DataFrame, name: str, value: Column) -> DataFrame:
    """``pieces`` with ``name``: the last value that is not null in earlier pieces of the file."""
    within, earlier, earlier_ranges = _before()
    rows = pieces.withColumn("_value", value)
    lasts = rows.groupBy("file", "block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("at"))).alias("_last"))
    lasts = lasts.select("file", "block", F.last("_last", ignorenulls=True).over(earlier_ranges).alias("_carried"))
    rows = rows.withColumn("_own", F.last("_value", ignorenulls=True).over(earlier)).join(lasts, ["file", "block"])
    return rows.withColumn(name, F.coalesce("_own", "_carried")).drop("_value", "_own", "_carried")
