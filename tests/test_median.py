import random

import pytest
from pyspark.sql import functions as F

from quakes.operators.median import exact_medians


@pytest.mark.parametrize("slices", [None, 1, 3, 17])
def test_exact_medians_match_spark_median(spark, slices):
    rnd = random.Random(7)
    rows = []
    for i in range(3001):
        rows.append((
            rnd.choice([None, rnd.randint(0, 50) / 10]),       # few distinct values, nulls
            rnd.random() * 1000,                               # all distinct (continuous)
            7.0 if i < 1000 else float(i),                     # one hot value, a third of rows
            float(i % 2) if i < 3000 else None,                # even count of non-nulls
            None,                                              # all null
        ))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    cols = ["a", "b", "c", "d", "e"]
    got = exact_medians(df, cols, "median-test", str(slices), slices=slices)
    want = df.agg(*[F.median(c).alias(c) for c in cols]).first().asDict()
    pdf = df.toPandas()
    for c in cols:
        if want[c] is None:
            assert got[c] is None
        else:
            assert got[c] == pytest.approx(want[c], abs=1e-12), c
            assert got[c] == pytest.approx(float(pdf[c].median()), abs=1e-12), c


def test_exact_quantiles_match_pandas(spark):
    from quakes.operators.median import exact_quantiles

    rnd = random.Random(11)
    rows = [(rnd.choice([None, float(rnd.randint(0, 30))]), rnd.gauss(0, 1)) for _ in range(1234)]
    df = spark.createDataFrame(rows, "a double, b double")
    qs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["a", "b"], qs, "quantile-test", slices=5)
    pdf = df.toPandas()
    for c in ("a", "b"):
        for q in qs:
            assert got[(c, q)] == pytest.approx(float(pdf[c].quantile(q)), abs=1e-12), (c, q)
