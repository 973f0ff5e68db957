import pandas as pd

from quakes.operators.profile import describe, modes, null_counts, value_counts


def test_modes_keep_ties_and_skip_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (3.0, 3.0), (3.0, None), (None, None), (None, None)],
                               "a double, b double")
    got = sorted((r.col_name, r.value, r["count"]) for r in modes(df, ["a", "b"]).collect())
    assert got == [("a", 1.0, 2), ("a", 3.0, 2), ("b", 2.0, 2)]
    pdf = df.toPandas()
    assert sorted(pdf["a"].mode().tolist()) == [1.0, 3.0]


def test_describe_matches_pandas(spark):
    vals = [1.0, 2.0, 2.0, 5.0, 9.0, None, 11.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = describe(df, ["x"]).first()
    d = pd.Series(vals, dtype="float64").describe()
    assert r["count"] == d["count"]
    for ours, theirs in [("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"),
                         ("p75", "75%"), ("max", "max")]:
        assert abs(r[ours] - d[theirs]) < 1e-9, ours


def test_null_counts_and_value_counts(spark):
    df = spark.createDataFrame([("x", None), (None, 1), ("x", 2)], "s string, n int")
    assert {r.col_name: r.null_count for r in null_counts(df).collect()} == {"s": 1, "n": 1}
    assert [(r.s, r["count"]) for r in value_counts(df, "s").collect()] == [("x", 2)]


def test_describe_approx_option(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)], "x double")
    r = describe(df, ["x"], approx_accuracy=10000).first()
    assert (r.p25, r.p50, r.p75, r["count"]) == (25.0, 50.0, 75.0, 101)
