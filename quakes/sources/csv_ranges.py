"""CSV files read in byte ranges, quoted line breaks included.

A line break ends a row only outside of quotes, which depends on all quotes before it
in the file.  Lines are read in ranges (``pieces.read_pieces``), the quotes before each
are summed up, and a line begins a row where their number is even.  Rows of one line
(nearly all) are parsed where they are; only the lines of longer ones are put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakes.sources.pieces import read_pieces, sums_before
from quakes.sources.table import CSV_TEXT, TS_FORMAT, materialize

#: Stands for null while a row is parsed (unquoted and empty), so a quoted empty string stays one.
NULL_MARK = "\x00null\x00"


def logical_rows(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``text`` of every row of the files; the header row of each file is left out."""
    lines = read_pieces(spark, path, "\n")
    quotes = F.length("piece") - F.length(F.replace("piece", F.lit('"'), F.lit("")))
    lines = materialize(lines.withColumn("quotes", quotes), "csv_lines")
    lines = sums_before(lines, quotes_before=F.col("quotes"), lines_before=F.lit(1))
    lines = lines.withColumn("begins", F.col("quotes_before") % 2 == 0)
    one = F.col("begins") & (F.col("quotes") % 2 == 0)
    numbered = sums_before(lines, rows_before=F.col("begins").cast("long"))
    row = (F.col("rows_before") + F.col("begins").cast("long")).alias("row")
    long_rows = (
        numbered.where(~one)
        .select("file", row, "block", "at", "piece")
        .groupBy("file", "row")
        .agg(F.sort_array(F.collect_list(F.struct("block", "at", "piece"))).alias("parts"))
        .select("row", F.array_join(F.transform("parts", lambda p: p["piece"]), "\n").alias("text"))
    )
    if header:
        lines, long_rows = lines.where("lines_before > 0"), long_rows.where("row > 1")
    texts = lines.where(one).select(F.col("piece").alias("text")).unionByName(long_rows.select("text"))
    return texts.select(F.regexp_replace("text", r"\r$", "").alias("text")).where("text <> ''")


def read_csv_ranges(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Rows of the files by a fixed schema.  Nulls are empty unquoted fields; a quoted
    empty string, line breaks, quotes and blanks in a field are kept.  A row that does
    not fit the schema stops the read; empty lines are passed over; no files or
    only headers give an empty result."""
    options = {"mode": "FAILFAST", "timestampNTZFormat": TS_FORMAT, "nullValue": NULL_MARK, "emptyValue": ""}
    options |= {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV_TEXT.items()}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    rows = logical_rows(spark, path, header)
    return rows.select(F.from_csv("text", ddl, options).alias("r")).select(*(F.col(f"r.`{f.name}`") for f in schema))
