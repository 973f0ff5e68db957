"""Serial numbers of results of any size."""

import re

import pytest
from pyspark.sql import functions as F

from quakes.operators.serial import serial_numbers


@pytest.mark.parametrize("partitions", [1, 7, 50])
def test_numbers_follow_the_order(spark, partitions):
    rows = [(k * 37 % 1000, None if k % 11 == 0 else k % 5, f"t{k % 3}") for k in range(1000)]
    df = spark.createDataFrame(rows, "id int, v int, t string").repartition(partitions)
    got = serial_numbers(df, F.desc_nulls_last("v"), F.asc("id")).orderBy("S_No").collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [tuple(r) for r in got] == [(k + 1, *r) for k, r in enumerate(want)]


def test_rows_alike_are_split_and_numbered_once(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = serial_numbers(df.repartition(10), "x")
        sizes = [r["count"] for r in got.groupBy(F.input_file_name()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(r["S_No"] for r in got.collect()) == list(range(1, 4001))
    assert len(sizes) > 4 and max(sizes) < 2000  # two thirds of the rows are alike


def test_no_window_over_the_whole_result(spark):
    df = spark.range(100).withColumn("_arrival", F.lit(1)).withColumn("_place", F.lit(2))
    got = serial_numbers(df, F.desc("id"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and not re.search("SinglePartition", plan)
    assert got.columns == ["S_No", "id", "_arrival", "_place"]
    assert got.orderBy("S_No").first().asDict() == {"S_No": 1, "id": 99, "_arrival": 1, "_place": 2}


def test_empty_and_taken_name(spark):
    none = spark.range(0)
    assert serial_numbers(none, "id").collect() == [] and serial_numbers(none, "id").columns == ["S_No", "id"]
    with pytest.raises(ValueError, match="already"):
        serial_numbers(spark.range(3).withColumn("s_no", F.lit(1)), "id")
