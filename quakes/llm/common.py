"""Helpers shared by the operators: shared folder, stored tables, components."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words everywhere in this subpackage.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Only a local session may have its own."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        d = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: Folders stored within ``scratch``; None outside of it.
_stored: list[str] | None = None


#: Removes the shuffle files of a query when it ends (else they stay until the driver's next collection).
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, so a
    lost executor costs a re-read, and the plan after it knows the real size.
    ``drop_shuffles`` frees the disk that its shuffles took."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if _stored is not None:
        _stored.append(path)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true" if drop_shuffles else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Lists the folders that ``store`` writes meanwhile, for ``remove`` when what
    was computed from them has been written elsewhere."""
    global _stored
    outer, _stored = _stored, []
    try:
        yield _stored
    finally:
        if outer is not None:
            outer += _stored
        _stored = outer


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of stored tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def once_per_worker(key: tuple, make):
    """``make()``, kept for all tasks of a Python worker.  The keeper is a module of the
    worker process, as functions travel by value and do not share their globals."""
    kept = sys.modules.setdefault("llm_worker_kept", types.ModuleType("llm_worker_kept")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def portions(texts, most: int, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of an Arrow array of texts that are worked on together."""
    first = size = 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        if k - first == most or (k > first and size + n > most_bytes):
            yield first, k
            first, size = k, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def whole(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


#: Key of a stored row, where rows may repeat id and text.
ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a key for each row, stored so that every read sees the same keys."""
    return store(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def keep_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``numbered`` documents whose key is among ``kept``'s, without the key."""
    k = kept.select(F.col(ROW).alias("__keep_row"))
    return rows.join(k, rows[ROW] == k["__keep_row"], "left_semi").drop(ROW)


def _stars(edges: DataFrame) -> bool:
    """Whether each ``u`` has one ``v`` and no ``v`` is a ``u``; ``v`` is the lesser,
    so its components are then read off directly."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("met")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    seen = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("met").alias("met"))
    return seen.where("out > 1 OR (out = 1 AND met = 1)").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of ``edges``; root is the least node that
    can be reached.  Alternating large-star / small-star rounds: each round joins
    edges to their node's least neighbour and is written to the shared folder; the
    loop ends when every component is a star around its least node."""
    spark = edges.sparkSession
    e = store(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s")
        )
        e = store(small.select("s.u", "s.v").where("u <> v").distinct(), "edges")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v"), F.col("v")).distinct())
