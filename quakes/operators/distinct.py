"""Distinct counts per group from bit words that can be kept and merged.

The column's distinct values get code numbers (range-sorted, no single task).  A
group's state is, for each word of 64 codes that it has, the bits of the codes met:
a bitwise OR, so it is combined before the shuffle, and states of different loads
merge by OR again.  A value that a third of all rows hold costs one bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakes.operators.joins import lookup_join
from quakes.operators.serial import serial_numbers

WORD = 64


def code_table(df: DataFrame, column: str) -> DataFrame:
    """``value, code``: a number from 0 for every distinct value that is not null."""
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    return serial_numbers(values, "value", name="code").select("value", (F.col("code") - 1).alias("code"))


def distinct_state(df: DataFrame, groups: list[str], column: str, codes: DataFrame) -> DataFrame:
    """``groups, word, bits`` of the values met; nulls are no value."""
    rows = df.select(*groups, F.col(column).alias("_value")).where("_value IS NOT NULL")
    coded = lookup_join(rows, codes.withColumnsRenamed({"value": "_coded", "code": "_code"}), "_value", "_coded")
    bit = F.expr(f"shiftleft(1L, CAST(_code % {WORD} AS INT))")
    return coded.groupBy(*groups, F.expr(f"_code DIV {WORD}").alias("word")).agg(F.bit_or(bit).alias("bits"))


def merge_states(*states: DataFrame) -> DataFrame:
    """One state of several (over the same codes)."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    groups = [c for c in both.columns if c != "bits"]
    return both.groupBy(*groups).agg(F.bit_or("bits").alias("bits"))


def state_counts(state: DataFrame, groups: list[str], name: str = "n") -> DataFrame:
    """Distinct values of every group that has any."""
    return state.groupBy(*groups).agg(F.sum(F.bit_count("bits").cast("long")).alias(name))


def distinct_counts(df: DataFrame, groups: list[str], column: str, name: str = "n") -> DataFrame:
    """``count(DISTINCT column)`` per group; groups with nulls alone count 0, null is a
    group value of its own, an empty table gives an empty result."""
    counts = state_counts(distinct_state(df, groups, column, code_table(df, column)), groups, "_n")
    every = df.select(*groups).distinct()
    same = [every[g].eqNullSafe(counts[g]) for g in groups]
    joined = every.join(counts, same, "left")
    return joined.select(*(every[g] for g in groups), F.coalesce(counts["_n"], F.lit(0)).cast("long").alias(name))
