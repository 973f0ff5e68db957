"""Exact dedup over an extendible-hash index kept on shared files (native).

A key is the 64-bit hash of the whole text.  The directory is read off by the
key's leading bits.  It begins with one bucket; a bucket with more distinct keys
than ``capacity`` is split by one more bit, and the directory doubles when the
split bucket was as deep as the directory, to at most ``max_depth`` bits (beyond
it a bucket just grows, so nothing is lost).  A directory has 2**max_depth
entries whatever the data, so it is broadcast.

Owner tasks hold ranges of (bucket, key).  Texts that share a key are chained by
comparing their bytes: the text itself is a grouping key, combined before the
shuffle, so a group of a million copies sends one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakes.llm.common import ROW, keep_rows, new_path, numbered, store, table, whole


def directory(keys: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """``(cell, depth, bucket)``: the bucket that each ``max_depth``-bit prefix points to."""
    cells = keys.distinct().groupBy(F.shiftrightunsigned("h", 64 - max_depth).alias("cell")).agg(F.count("*").alias("n"))
    cells = store(cells, "cells")
    at = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftright(cell, {max_depth} - depth)")
    )
    load = at.groupBy("depth", "prefix").agg(F.sum("n").alias("load"))
    fits = at.join(load, ["depth", "prefix"]).groupBy("cell").agg(
        F.coalesce(F.min(F.when(F.col("load") <= capacity, F.col("depth"))), F.lit(max_depth)).alias("depth")
    )
    return fits.select(
        "cell", "depth", F.expr(f"depth * {1 << max_depth}L + shiftright(cell, {max_depth} - depth)").alias("bucket")
    )


def _entries_and_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1_000_000,
    max_depth: int = 12,
    key: Column | None = None,
    carry: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """An entry for each row (``doc_id, h, text_sha256`` and the columns ``carry``) and
    one index row for each text (``h, text_sha256, keep_id, group_size``)."""
    t = whole(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), t.alias("text"), *carry).withColumn(
        "h", (F.xxhash64("text") if key is None else key).cast("long")
    )
    entries = store(rows.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256"), *carry), "entries")
    found = F.broadcast(directory(entries.select("h"), capacity, max_depth))  # 2**max_depth rows at most

    chains = (
        rows.groupBy("h", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("h", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
        .withColumn("cell", F.shiftrightunsigned("h", 64 - max_depth))
        .join(found, "cell")
        .select("bucket", "h", "text_sha256", "keep_id", "group_size")
    )
    path = new_path(docs.sparkSession, "index")
    chains.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h", "text_sha256").write.parquet(path)
    index = docs.sparkSession.read.schema(chains.schema).parquet(path)
    # bytes that differ under one key and one digest are two rows here: stop rather than merge them
    index = index.groupBy("h", "text_sha256").agg(
        F.max("keep_id").alias("keep_id"),
        F.when(F.count("*") > 1, F.raise_error(F.lit("two texts share a digest")).cast("long"))
        .otherwise(F.sum("group_size"))
        .alias("group_size"),
    )
    return entries, index


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty.  Texts are equal when identical; of equal texts the
    largest id stays (a null id only if the group has no other).  Rows that repeat
    both id and text cannot be told apart and get the same answer (``drop_copies``
    keeps one).  The option ``key`` replaces the hash of the text (tests use a weak
    one to force chains).
    """
    entries, index = _entries_and_index(docs, **options)
    return entries.join(index, ["h", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each text: of the largest id (null only if there is no
    other), of its rows the first.  Rows are told apart by a key of their own, so ids
    may repeat, under one text or several, and be null."""
    rows = numbered(docs)
    entries, index = _entries_and_index(rows, carry=(ROW,), **options)
    first = entries.groupBy("h", "text_sha256", "doc_id").agg(F.min(ROW).alias(ROW))
    index = index.where("group_size > 0").withColumnsRenamed({"h": "index_h", "text_sha256": "index_sha256"})  # also the check of digests
    same = (F.col("h") == F.col("index_h")) & (F.col("text_sha256") == F.col("index_sha256"))
    return keep_rows(rows, first.join(index, same & F.col("doc_id").eqNullSafe(F.col("keep_id"))))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
