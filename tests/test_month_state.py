"""Profiles from states kept per month."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quakes.operators import month_state, profile

COLUMNS = {"numbers": ["a", "b"], "texts": ["s"]}


def events(spark, n=400, seed=3):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        when = None if k % 50 == 0 else f"{2020 + k % 2}-{k % 12 + 1:02d}-15 00:00:00"
        a = None if k % 7 == 0 else 1.0 if k % 3 == 0 else float(rnd.randint(0, 9))
        rows.append((when, a, rnd.gauss(0, 1), rnd.choice(["x", "y", "", None]), None))
    df = spark.createDataFrame(rows, "t string, a double, b double, s string, year string")
    return df.withColumn("time", F.col("t").cast("timestamp_ntz"))


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def same_as_full(state, df):
    assert rows(month_state.state_modes(state)) == rows(profile.modes(df, ["a", "b"]))
    assert rows(month_state.state_value_counts(state, "s")) == rows(profile.value_counts(df, "s"))
    assert rows(month_state.state_null_counts(state)) == rows(profile.null_counts(df))
    got, want = (
        {r["col_name"]: r for r in d.collect()}
        for d in (month_state.state_describe(state, ["a", "b"]), profile.describe(df, ["a", "b"]))
    )
    assert got.keys() == want.keys()
    for c, r in want.items():
        for field in ("count", "mean", "std", "min", "p25", "p50", "p75", "max"):
            assert got[c][field] == pytest.approx(r[field], abs=1e-9), (c, field)
    medians = df.agg(F.median("a"), F.median("b")).first()
    assert month_state.state_medians(state, ["a", "b"]) == pytest.approx({"a": medians[0], "b": medians[1]})


def test_states_of_months_add_up(spark, tmp_dir):
    df = events(spark)
    path = f"{tmp_dir}/state"
    month_state.save_months(df.where("time IS NULL OR year(time) = 2020"), path, **COLUMNS)
    state = month_state.save_months(df, path, "2021-01-01", "2022-01-01", **COLUMNS)
    same_as_full(state, df)
    same_as_full(month_state.save_months(df, path, "2021-03-01", "2021-05-01", **COLUMNS), df)  # again


def test_a_corrected_month_replaces_itself_alone(spark, tmp_dir):
    df = events(spark)
    path = f"{tmp_dir}/state"
    month_state.save_months(df, path, **COLUMNS)
    other = f"{path}/year=2020/month=3"
    before = sorted(os.listdir(other))
    march = F.date_format("time", "yyyy-MM") == "2021-04"
    corrected = df.withColumn("a", F.when(march, 5.0).otherwise(F.col("a")))
    same_as_full(month_state.save_months(corrected, path, "2021-04-01", "2021-05-01", **COLUMNS), corrected)
    assert sorted(os.listdir(other)) == before
    gone = corrected.where(~march | F.col("time").isNull())
    same_as_full(month_state.save_months(gone, path, "2021-04-01", "2021-05-01", **COLUMNS), gone)


def test_empty_table_and_bad_windows(spark, tmp_dir):
    none = events(spark).limit(0)
    state = month_state.save_months(none, f"{tmp_dir}/state", **COLUMNS)
    assert state.count() == 0 and month_state.state_modes(state).count() == 0
    assert month_state.state_describe(state, ["a"]).count() == 0
    assert month_state.state_medians(state, ["a"]) == {"a": None}
    with pytest.raises(ValueError, match="whole months"):
        month_state.save_months(none, f"{tmp_dir}/state", "2021-01-02", "2021-02-01")
    with pytest.raises(ValueError, match="together"):
        month_state.save_months(none, f"{tmp_dir}/state", "2021-01-01")
