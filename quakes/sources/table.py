"""Table and file sinks / sources (S6-S10) and lineage cutting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quakes.schema import EQ
from quakes.session import table_dir


# Full microsecond precision for timestamps in CSV (Spark's default keeps ms).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

# Blanks around a text are kept; quotes inside one are doubled.
CSV_TEXT = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header row, no index column."""
    w = df.write.mode(mode).option("header", True).option("timestampNTZFormat", TS_FORMAT)
    w.options(**CSV_TEXT).csv(path)


def read_csv(spark: SparkSession, path: str, schema=EQ) -> DataFrame:
    """CSV scan with a fixed schema (never inferred), files read in byte ranges.

    Quoted line breaks belong to their row and empty strings stay empty
    (``csv_ranges.read_csv_ranges``).
    """
    from quakes.sources.csv_ranges import read_csv_ranges

    return read_csv_ranges(spark, path, schema)


def save_table(
    df: DataFrame,
    path: str | None = None,
    name: str = "eq_data",
    partition_by=("year",),
    rebalance: bool = False,
) -> DataFrame:
    """Replace the EQ table.

    By default the write is narrow: each task writes one file per year it
    holds, all open at once (no exchange of the fact table, and no sort of a
    task's rows, ``session.open_partitions``).  Feeds land in time order, so a task usually holds one year.
    ``rebalance=True`` adds AQE's rebalance (one shuffle of the table) to even
    out file sizes when tasks hold many years in small pieces.
    With a path the table is Parquet files there, registered as a temp view;
    without one, a named table (``schema.table``, or of the current schema).
    Either way the earlier table stays until the new one is whole
    (``versions.replace_folder``, ``versions.replace_table``).
    """
    from quakes.sources.versions import replace_folder, replace_table

    spark = df.sparkSession
    src = df.hint("rebalance", *partition_by) if rebalance else df
    if path is None:
        schema, _, short = name.rpartition(".")
        return replace_table(src, schema or spark.catalog.currentDatabase(), short, tuple(partition_by))[0]
    replace_folder(src, path, tuple(partition_by))
    out = spark.read.parquet(path)
    out.createOrReplaceTempView(name)
    return out


def loaded_count(table: DataFrame) -> int:
    """Row count of the written table (a Parquet footer read)."""
    return table.count()


def save_table_counted(df: DataFrame, path: str | None = None, **kw) -> tuple[DataFrame, int]:
    """S8 + S9 in one pass: the row count is observed while the table is
    written (an accumulator-style metric), no second scan."""
    obs = Observation("loaded_rows")
    table = save_table(df.observe(obs, F.count(F.lit(1)).alias("rows")), path, **kw)
    return table, obs.get["rows"]


def read_table(spark: SparkSession, name: str = "eq_data") -> DataFrame:
    """S10."""
    return spark.table(name)


def materialize(df: DataFrame, *key: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts lineage, survives executor loss and keeps Parquet pruning and
    pushdown for later readers.  Every call has a folder of its own, so two
    builds over the same key do not overwrite each other.
    """
    spark = df.sparkSession
    path = table_dir(spark, uuid.uuid4().hex, *key)
    df.write.parquet(path)
    return spark.read.parquet(path)


def save_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], mode: str = "overwrite") -> None:
    """S8 towards a SQL server: replace ``table`` over JDBC.

    Credentials come from the caller (never from this repository).  Partitions
    write in parallel; ``batchsize`` and ``numPartitions`` in ``properties``
    bound the load on the server.
    """
    df.write.mode(mode).jdbc(url, table, properties=properties)
