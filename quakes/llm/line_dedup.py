r"""Line dedup over range-partitioned line hashes (native).

Every line with a long enough key is an entry (hash, document, position).  Entries
are range-partitioned by (hash, document), largest document first, so a line that a
third of all documents hold is spread over as many slices as its rows fill.  Each
sorted slice is streamed: the first document of a hash stays, and whether a later one
goes is told by its neighbours alone (the two rows before it and the one after it), so
no group is ever gathered.  The rows at the borders of slices, six at most of each
(the first and the last three), are streamed once more on their own.

The result is a keep bitmap per document, run-length coded: runs (start, length) of
kept lines.  Texts are not shuffled; ``keep_lines`` applies bitmaps to them.

Line hashes have 96 bits (XXH64 and Murmur3): two keys that share both count as one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakes.llm.common import SPACE, store, table, whole

LEAST_CHARS = 20
LEAST_DOCS = 3
RUNS = "array<struct<start:int,length:int>>"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    key = F.btrim(line, F.lit(SPACE))
    letters = F.translate(key, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(letters)  # the short way for ASCII


def _documents(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """A row per row of ``docs`` without its text: ``doc_id, text_key, n_lines`` and
    the entries (``pos, h, g``) of its long lines."""
    lines = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.split("text", "\n").alias("lines")
    )
    keys = lines.select("doc_id", "text_key", F.size("lines").alias("n_lines"), F.transform("lines", line_key).alias("keys"))
    entry = F.transform(
        "keys", lambda k, i: F.when(F.length(k) >= least_chars, F.struct(i.alias("pos"), F.xxhash64(k).alias("h"), F.hash(k).alias("g")))
    )
    return keys.select("doc_id", "text_key", "n_lines", F.filter(entry, lambda e: e.isNotNull()).alias("entries"))


def _goes(order: Window) -> tuple[Column, Column, Column]:
    """Of rows in order: whether the row goes, and the hash two rows before and one after."""
    key = F.struct("h", "g")
    before, second, after = F.lag(key, 1).over(order), F.lag(key, 2).over(order), F.lead(key, 1).over(order)
    # of a hash the first document stays; the second goes if there is a third; later ones go
    goes = second.eqNullSafe(key) | (before.eqNullSafe(key) & after.eqNullSafe(key))
    return goes, second, after


def _dropped(entries: DataFrame) -> DataFrame:
    """``doc_id, text_key, positions``: the lines that go, a row per hash and document."""
    by_doc = F.col("doc_id").desc_nulls_last()
    ranged = entries.repartitionByRange("h", "g", by_doc, "text_key")
    # the range partitioning clusters these columns: no further shuffle
    held = ranged.groupBy("h", "g", "doc_id", "text_key").agg(F.collect_set("pos").alias("positions"))
    held = held.withColumn("slice", F.spark_partition_id())
    order = Window.partitionBy("slice").orderBy("h", "g", by_doc, "text_key")
    goes, second, after = _goes(order)
    streamed = held.select(
        "h", "g", "doc_id", "text_key", "positions",
        goes.alias("goes"),
        (second.isNull() | after.isNull()).alias("open"),  # its neighbours lie in other slices
        (F.lag("h", 3).over(order).isNull() | F.lead("h", 3).over(order).isNull()).alias("border"),
    )
    streamed = store(streamed.where("goes OR border"), "line_stream")
    # six rows of a slice at most, so this table is as small as the number of slices
    borders = streamed.where("border").select("h", "g", "doc_id", "text_key", "positions", "open")
    again = borders.withColumn("goes", _goes(Window.orderBy("h", "g", by_doc, "text_key"))[0])
    found = ["doc_id", "text_key", "positions"]
    return streamed.where("goes AND NOT open").select(*found).union(again.where("goes AND open").select(*found))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, text_key, n_lines, n_dropped, keep`` for every row of ``docs``.

    ``keep`` is the run-length coded bitmap of the lines that stay.  A document is an
    id and a text: rows that repeat both are one document and get the same answer,
    rows that share an id only are documents of their own, of which the largest
    ``text_key`` (XXH64 of the text) comes last.  A null id is less than any other.
    Null or empty text is one empty line, which stays.  A document that repeats a line
    keeps or loses all of its lines together.  An empty table gives an empty result;
    other columns of ``docs`` are not read.
    """
    slim = store(_documents(docs, id_col, text_col, least_chars), "line_entries")
    entries = slim.select("doc_id", "text_key", F.explode("entries").alias("e")).select("doc_id", "text_key", "e.*")
    gone = _dropped(entries).groupBy("doc_id", "text_key").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("gone"))
    gone = store(gone, "lines_gone").withColumnsRenamed({"doc_id": "gone_id", "text_key": "gone_key"})
    rows = slim.select("doc_id", "text_key", "n_lines")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key"))
    at = F.coalesce("gone", F.expr("CAST(array() AS array<int>)"))
    runs = F.zip_with(
        F.concat(F.array(F.lit(-1)), at),
        F.concat(at, F.array("n_lines")),
        lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")),
    )
    return rows.join(gone, same, "left").select(
        "doc_id",
        "text_key",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size(at).cast("long").alias("n_dropped"),
        F.filter(runs, lambda r: r["length"] > 0).cast(RUNS).alias("keep"),
    )


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of ``text`` that the bitmap keeps, joined by ``\\n``."""
    lines = F.split(text, "\n")
    return F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")


def keep_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with only the lines kept by ``line_bitmaps``; other columns and all rows
    stay, a text that loses no line stays as it is (null too).  One shuffle of the texts,
    or none where Spark finds the bitmaps of touched documents small."""
    names = [_free(docs, n) for n in ("text_key", "kept_id", "kept_key", "keep")]
    key, kept_id, kept_key, keep = names
    touched = bitmaps.where("n_dropped > 0").select(
        F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_key), F.col("keep").alias(keep)
    )
    # rows that repeat have the same bitmap
    touched = store(touched.dropDuplicates([kept_id, kept_key]), "bitmaps")
    rows = docs.withColumn(key, F.xxhash64(whole(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key))
    text = F.when(F.col(keep).isNull(), F.col(text_col)).otherwise(kept_text(F.col(text_col), F.col(keep)))
    return rows.join(touched, same, "left").withColumn(text_col, text).select(*docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Bitmaps of all documents, and from them the digest of each document's kept text.
    Rows that repeat id and text are each returned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = store(line_bitmaps(docs), "line_bitmaps")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    kept = keep_lines(docs.withColumn("text_key", F.xxhash64(whole())), bitmaps).select("doc_id", "text_key", digest)
    counts = bitmaps.select(
        F.col("doc_id").alias("b_id"), F.col("text_key").alias("b_key"), "n_lines", "n_dropped"
    ).dropDuplicates(["b_id", "b_key"])
    same = F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_key") == F.col("b_key"))
    return kept.join(counts, same).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP11_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM lines),
shared AS (
  SELECT line_key, max(doc_id) AS keep_id FROM keyed WHERE length(line_key) >= 20
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id <> keep_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep_id IS NULL OR doc_id = keep_id), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (line_key) GROUP BY doc_id
"""
