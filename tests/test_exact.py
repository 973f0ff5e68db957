"""Order-free averages and mergeable distinct counts."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from quakes.operators.distinct import code_table, distinct_counts, distinct_state, merge_states, state_counts
from quakes.operators.exact import exact_avg, exact_sum


def test_average_does_not_depend_on_the_order(spark):
    rng = random.Random(2)
    values = [round(rng.uniform(-9, 9), 4) for _ in range(3000)] + [1e9, -1e9, 0.1, None, float("nan"), float("inf")]
    want = sum(Fraction(str(v)) for v in values if v is not None and abs(v) < 1e300)
    seen = set()
    for parts in (1, 3, 17):
        rng.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(parts)
        row = df.agg(exact_avg("v").alias("a"), exact_sum("v").alias("s")).first()
        seen.add(row["a"])
        assert Fraction(row["s"]) == want
    assert len(seen) == 1 and abs(seen.pop() - float(want) / 3003) < 1e-12


def test_no_values(spark):
    df = spark.createDataFrame([(1, None), (1, float("nan"))], "k int, v double")
    assert df.groupBy("k").agg(exact_avg("v").alias("a")).first()["a"] is None


def test_distinct_counts_equal_count_distinct(spark):
    rows = [(k % 4 if k % 9 else None, f"v{k * k % 300}" if k % 13 else None) for k in range(5000)] + [(77, None)]
    df = spark.createDataFrame(rows, "g int, v string").withColumn("code", F.lit(1)).repartition(6)
    got = sorted(map(repr, map(tuple, distinct_counts(df, ["g"], "v").collect())))
    assert got == sorted(map(repr, map(tuple, df.groupBy("g").agg(F.count_distinct("v")).collect())))
    assert distinct_counts(df.limit(0), ["g"], "v").count() == 0


def test_states_of_two_loads_merge(spark):
    df = spark.createDataFrame([(k % 3, k % 150, k % 2) for k in range(900)], "g int, v int, load int")
    codes = code_table(df, "v")
    states = [distinct_state(df.where(F.col("load") == n), ["g"], "v", codes) for n in (0, 1)]
    got = state_counts(merge_states(*states), ["g"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, df.groupBy("g").agg(F.count_distinct("v")).collect()))
