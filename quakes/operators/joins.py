"""Joins against lookup tables: broadcast within a checked size, else salted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakes.operators.serial import free_name

# A lookup within both bounds is shipped to every executor.
MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 64 << 20
ROW_BYTES = 16  # of each value, besides its characters
SPREAD = 8  # salts for each even share, so that those that meet in one task stay small


def lookup_size(dim: DataFrame) -> tuple[int, int]:
    """Rows and about the bytes they take in memory, from one scan of a stored lookup."""
    if not dim.columns:
        return dim.count(), 0
    chars = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + ROW_BYTES for c in dim.columns]
    n, size = dim.agg(F.count(F.lit(1)), F.sum(sum(chars[1:], chars[0]))).first()
    return n, size or 0


def heavy_keys(fact: DataFrame, key: str, partitions: int) -> DataFrame:
    """``heavy, salts`` of keys (null too) with more rows than a partition's even share:
    fewer than ``partitions`` rows, and a number of salts that brings each share down."""
    counts = fact.groupBy(F.col(key).alias("heavy")).agg(F.count(F.lit(1)).alias("n"))
    total = fact.count()
    share = max(1.0, total / partitions)
    return counts.where(F.col("n") > share).select("heavy", F.ceil(SPREAD * F.col("n") / share).cast("long").alias("salts"))


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    fact_key: str,
    dim_key: str,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Left join of ``fact`` with a stored ``dim`` of other column names, all columns of both.

    A lookup within the bounds is broadcast.  Beyond them both sides are shuffled:
    the rows of a key that would fill more than its share of a partition are dealt
    over several salts, and the lookup's rows of that key are copied to each.
    Rows with a null key match nothing and are dealt like any other; a key that the
    lookup holds twice gives two rows.
    """
    n, size = lookup_size(dim)
    if n <= max_rows and size <= max_bytes:
        return fact.join(F.broadcast(dim), F.col(fact_key) == F.col(dim_key), "left")
    partitions = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(fact, fact_key, partitions)
    listed = heavy.collect()  # fewer than ``partitions`` rows
    if not listed:
        return fact.join(dim, F.col(fact_key) == F.col(dim_key), "left")
    heavy = fact.sparkSession.createDataFrame([tuple(r) for r in listed], heavy.schema)
    salt, salts, name, dim_salt = (free_name(fact, c) for c in ("_salt", "_salts", "_heavy", "_dim_salt"))
    heavy = F.broadcast(heavy.withColumnsRenamed({"heavy": name, "salts": salts}))
    dealt = F.pmod(F.monotonically_increasing_id(), F.coalesce(F.col(salts), F.lit(1)))
    left = fact.join(heavy, F.col(fact_key).eqNullSafe(F.col(name)), "left").withColumn(salt, dealt).drop(name, salts)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(salts), F.lit(1)) - 1))
    right = dim.join(heavy, F.col(dim_key) == F.col(name), "left").withColumn(dim_salt, copies).drop(name, salts)
    joined = left.join(right, (F.col(fact_key) == F.col(dim_key)) & (F.col(salt) == F.col(dim_salt)), "left")
    return joined.drop(salt, dim_salt)
