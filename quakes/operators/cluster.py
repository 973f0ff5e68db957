"""Rows clustered on several columns, so that filters on any of them skip data
(P8, P9; Q3, Q18, Q25, Q30).

A column's values are ranked by quantile bounds; the ranks' bits are interleaved, and
the table is written in the order of the interleaved number.  Rows near each other
in all columns then share a row group, whose least and greatest values let the scan
pass over it.  One range shuffle at the write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakes.operators.serial import free_name

BITS = 6  # per column: 64 ranks
ROW_GROUP_BYTES = 16 << 20


def quantile_bounds(df: DataFrame, columns: list[str], bits: int = BITS) -> dict[str, list[float]]:
    """Inner bounds of ``2**bits`` ranks per column; that many numbers reach the driver."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    row = df.agg(*(F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"b{k}") for k, c in enumerate(columns))).first()
    return {c: sorted(set(row[f"b{k}"] or [])) for k, c in enumerate(columns)}


def interleaved(bounds: dict[str, list[float]], bits: int = BITS) -> Column:
    """The interleaved ranks; null ranks first."""
    parts = []
    for k, (column, limits) in enumerate(bounds.items()):
        value = F.col(column).cast("double")
        rank = _rank(F.array(*(F.lit(x) for x in limits)), value) if limits else F.lit(0)
        for i in range(bits):
            parts.append(F.shiftleft(F.shiftright(rank, i).bitwiseAND(1).cast("long"), i * len(bounds) + k))
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def _rank(limits: Column, value: Column) -> Column:
    return F.when(value.isNull(), F.lit(0)).otherwise(F.size(F.filter(limits, lambda b: b <= value)))


def write_clustered(
    df: DataFrame, path: str, columns: list[str], bits: int = BITS, row_group_bytes: int = ROW_GROUP_BYTES, partitions: int | None = None
) -> DataFrame:
    """Write ``df`` clustered on ``columns`` (numbers or what casts to a double) and read
    it back; all rows and columns stay.  Rows of one interleaved number are split by
    arrival, so a value that a third of the rows hold fills as many files as it needs."""
    key, arrival = free_name(df, "_cluster"), free_name(df, "_arrival")
    rows = df.withColumns({key: interleaved(quantile_bounds(df, columns, bits), bits), arrival: F.monotonically_increasing_id()})
    order = [F.col(key), F.col(arrival)]
    rows = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    rows = rows.sortWithinPartitions(*order).drop(key, arrival)
    rows.write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
