"""Loading a table month by month.

The table is partitioned by year and month.  A load covers whole months: it replaces
the partitions of its own windows and touches no other, so a window may be loaded
again when the feed has corrected its events.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakes.sources.feed import source_filter


def months_between(start: dt.date, end: dt.date) -> list[tuple[int, int]]:
    """(year, month) of the windows from ``start`` to before ``end``, both first days of months."""
    if start.day != 1 or end.day != 1 or start >= end:
        raise ValueError(f"windows are whole months: {start} to {end}")
    count = (end.year - start.year) * 12 + end.month - start.month
    return [((start.year * 12 + start.month - 1 + k) // 12, (start.month - 1 + k) % 12 + 1) for k in range(count)]


def load_windows(raw: DataFrame, path: str, start: dt.date | str, end: dt.date | str, min_mag: float = 3.0) -> DataFrame:
    """Load the events of ``raw`` in ``[start, end)`` with at least ``min_mag`` into the table
    at ``path`` and return the table.  Windows that have no event any more become empty.
    Events without a time or a magnitude are in no window.  Other windows stay."""
    start, end = (dt.date.fromisoformat(d) if isinstance(d, str) else d for d in (start, end))
    windows = months_between(start, end)
    spark = raw.sparkSession
    rows = source_filter(raw, start, end, min_mag).withColumns({"year": F.year("time"), "month": F.month("time")})
    # one exchange: a window's rows come in files of even size whatever the input's order
    rows = rows.hint("rebalance", "year", "month")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)
    schema = rows.schema
    clear_windows(spark, path, windows, source_filter(raw, start, end, min_mag).select(F.year("time"), F.month("time")))
    return spark.read.schema(schema).parquet(path)


def clear_windows(spark: SparkSession, path: str, windows: list[tuple[int, int]], loaded: DataFrame) -> None:
    """A dynamic overwrite leaves partitions it has no row for: remove those of the
    load's own windows.  ``loaded`` has the year and month of every row of the load."""
    met = {tuple(r) for r in loaded.distinct().collect()}  # a row per window
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for year, month in windows:
        if (year, month) not in met:
            p = jvm.org.apache.hadoop.fs.Path(f"{path}/year={year}/month={month}")
            p.getFileSystem(conf).delete(p, True)
