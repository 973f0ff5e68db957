"""Modes by summaries against the plain ones."""

import random
from collections import Counter

import pytest

from quakes.operators.frequent import frequent_modes, summaries
from quakes.operators.profile import modes


def rows(df):
    return sorted((r["col_name"], repr(r["value"]), r["count"]) for r in df.collect())  # a NaN is not equal to itself


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(5)
    data = []
    for k in range(6000):
        data.append((
            7.5 if k % 3 == 0 else rnd.random(),                            # a third of rows, the rest distinct
            float(k),                                                       # every value once
            -0.0 if k % 4 == 0 else 0.0 if k % 4 == 1 else float(k),        # one zero
            float("nan") if k % 5 == 0 else float(k % 700),                 # not a number
            rnd.choice([1.0, 2.0]) if k < 4000 else [1.0, 2.0][k % 2],      # two values, near a tie
            None,
        ))
    return spark.createDataFrame(data, "a double, b double, c double, d double, e double, f double").repartition(5).cache()


@pytest.mark.parametrize("counters, candidates", [(20, 10_000), (1000, 10_000), (20, 0), (2, 3)])
def test_modes_by_summaries_are_the_modes(table, counters, candidates):
    cols = table.columns
    assert rows(frequent_modes(table, cols, counters, candidates)) == rows(modes(table, cols))


def test_ties_are_all_kept(spark):
    df = spark.createDataFrame([(float(k % 4),) for k in range(400)] + [(float(k),) for k in range(100, 300)], "x double")
    assert rows(frequent_modes(df, ["x"], 50)) == [("x", repr(float(k)), 100) for k in range(4)]


def test_summaries_bound_the_counts(table):
    got = {r["value"]: r["low"] for r in summaries(table, ["a"], 30).collect()}
    error, true = got.pop(None), Counter(r["a"] for r in table.select("a").collect())
    assert len(got) <= 5 * 30 and 0 < error < 2000
    assert all(low <= true[v] <= low + error for v, low in got.items())


def test_no_rows_and_nulls_alone(spark):
    df = spark.createDataFrame([(None,)] * 3, "x double")
    assert rows(frequent_modes(df, ["x"])) == rows(frequent_modes(df.limit(0), ["x"])) == []
