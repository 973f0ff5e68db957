"""Incremental landing of feed pages with Structured Streaming.

The catalogue is filled one month window at a time.  Here every landed page
file is picked up once by a file-source stream, flattened (S1, S4, S5) and
appended to a RAW Parquet table partitioned by year and month.  The stream's
checkpoint (beside the table unless given) records which files were
committed, so re-runs append only new pages and a lost executor re-runs its
batch without duplicates.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from quakes.schema import FEATURE, FEED
from quakes.sources.feed import flatten, page_features


def _raw_stream(spark: SparkSession, landing_dir: str, pages: bool, max_bytes_per_trigger: int):
    reader = spark.readStream.option("maxBytesPerTrigger", max_bytes_per_trigger).option("mode", "FAILFAST")
    if pages:
        src = reader.schema(FEED).option("multiLine", True).json(landing_dir)
        feats = page_features(src)
    else:
        src = reader.schema(FEATURE).json(landing_dir)
        feats = src.select(F.struct(*[F.col(c) for c in FEATURE.fieldNames()]).alias("f"))
    return flatten(feats).withColumns({"year": F.year("time"), "month": F.month("time")})


def _stream_checkpoint(table_path: str, checkpoint: str | None) -> str:
    """Beside the table unless given: the same in every application."""
    return checkpoint or f"{table_path.rstrip('/')}.checkpoint"


def _committed(spark: SparkSession, checkpoint: str) -> int:
    """Number of micro-batches that the stream has committed so far."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(n) + 1 for n in names if n.isdigit()), default=0)


def _writer(spark: SparkSession, raw, table_path: str, checkpoint: str | None):
    return (
        raw.writeStream.format("parquet")
        .option("path", table_path)
        .option("checkpointLocation", _stream_checkpoint(table_path, checkpoint))
        .partitionBy("year", "month")
        .outputMode("append")
    )


def ingest_pages(
    spark: SparkSession,
    landing_dir: str,
    table_path: str,
    checkpoint: str | None = None,
    pages: bool = True,
    max_bytes_per_trigger: int = 4 << 30,
) -> int:
    """Process every page not yet ingested, then stop (availableNow).

    Returns the number of micro-batches that ran.
    """
    raw = _raw_stream(spark, landing_dir, pages, max_bytes_per_trigger)
    place = _stream_checkpoint(table_path, checkpoint)
    before = _committed(spark, place)
    q = _writer(spark, raw, table_path, checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return _committed(spark, place) - before


def start_ingest(
    spark: SparkSession,
    landing_dir: str,
    table_path: str,
    checkpoint: str | None = None,
    pages: bool = True,
    every: str = "1 minute",
    max_bytes_per_trigger: int = 4 << 30,
) -> StreamingQuery:
    """Long-running form: pick up new pages every ``every``; returns the
    running query (stop it with ``.stop()``)."""
    raw = _raw_stream(spark, landing_dir, pages, max_bytes_per_trigger)
    return _writer(spark, raw, table_path, checkpoint).trigger(processingTime=every).start()
