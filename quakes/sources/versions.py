"""Replacing a table without a moment in which it is missing or half written.

By name: each load is a table of its own in the schema, written whole; the name is a
view of one of them, and replacing the view is the switch.  A load that fails leaves
the name as it was.  By path: a load is written beside the folder, which it then
takes the place of by renames.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quakes.session import open_partitions

MARK = "__load_"


def _quoted(*names: str) -> str:
    return ".".join(f"`{n.replace('`', '``')}`" for n in names)


def loads(spark: SparkSession, schema: str, name: str) -> list[str]:
    """The tables that hold loads of a name."""
    prefix = f"{name}{MARK}".lower()
    rows = spark.sql(f"SHOW TABLES IN {_quoted(schema)}").collect()
    return sorted(r["tableName"] for r in rows if r["tableName"].lower().startswith(prefix))


def current_load(spark: SparkSession, schema: str, name: str) -> str | None:
    """The load that the name shows now."""
    if not spark.catalog.tableExists(f"{_quoted(schema, name)}"):
        return None
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(schema, name)}").collect()
    text = next((r["data_type"] for r in rows if r["col_name"] == "View Text"), "")
    return next((t for t in loads(spark, schema, name) if f"`{t}`" in text), None)


def replace_table(
    df: DataFrame, schema: str, name: str, partition_by: tuple[str, ...] = ("year",), keep: int = 1, location: str | None = None
) -> tuple[DataFrame, int]:
    """S8 + S9: write ``df`` as a new load, switch ``schema.name`` to it, and return the
    table with its row count (observed while writing).  The schema is made if it is
    missing (at ``location``, else in the warehouse).  ``keep`` earlier loads stay for readers that still hold them; older ones are
    dropped.  A failed write is dropped and raised, and the name keeps showing what it
    showed.  A plain table of that name becomes its first load.  Null partition
    values are a partition of their own; an empty ``df`` makes an empty table."""
    spark = df.sparkSession
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {_quoted(schema)}{where}")
    before = current_load(spark, schema, name)
    if before is None and spark.catalog.tableExists(_quoted(schema, name)):
        before = f"{name}{MARK}0"
        spark.sql(f"ALTER TABLE {_quoted(schema, name)} RENAME TO {_quoted(schema, before)}")
        _show(spark, schema, name, before)
    load = f"{name}{MARK}{uuid.uuid4().hex[:12]}"
    seen = Observation()
    try:
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("parquet")
        with open_partitions(spark) as options:
            (writer.options(**options).partitionBy(*partition_by) if partition_by else writer).saveAsTable(_quoted(schema, load))
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(schema, load)}")
        raise
    _show(spark, schema, name, load)
    old = [t for t in loads(spark, schema, name) if t not in (load, before)]
    for t in old if keep else [*old, *([before] if before else [])]:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(schema, t)}")
    return spark.table(_quoted(schema, name)), seen.get["rows"]


def _show(spark: SparkSession, schema: str, name: str, load: str) -> None:
    spark.sql(f"CREATE OR REPLACE VIEW {_quoted(schema, name)} AS SELECT * FROM {_quoted(schema, load)}")


def read_named(spark: SparkSession, schema: str, name: str) -> DataFrame:
    """The table that a name shows."""
    return spark.table(_quoted(schema, name))


def named_count(spark: SparkSession, schema: str, name: str) -> int:
    """S9 on the stored table."""
    return read_named(spark, schema, name).count()


def replace_folder(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("year",)) -> None:
    """Write ``df`` beside ``path`` and put it in its place when it is whole.  If the last
    step fails the earlier folder is put back; a failed write leaves it untouched."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    run = uuid.uuid4().hex[:12]
    target = path.rstrip("/")
    head, _, tail = target.rpartition("/")
    staged, aside = (f"{head}/_{kind}-{tail}-{run}" for kind in ("staged", "replaced"))
    fs = place(target).getFileSystem(conf)
    writer = df.write
    try:
        with open_partitions(spark) as options:
            (writer.options(**options).partitionBy(*partition_by) if partition_by else writer).parquet(staged)
    except Exception:
        fs.delete(place(staged), True)
        raise
    held = fs.exists(place(target))
    if held and not fs.rename(place(target), place(aside)):
        raise OSError(f"{target} cannot be set aside")
    if not fs.rename(place(staged), place(target)):
        if held:
            fs.rename(place(aside), place(target))
        raise OSError(f"{staged} cannot take the place of {target}")
    if held:
        fs.delete(place(aside), True)
