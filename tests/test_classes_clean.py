import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from quakes.functions.classes import depth_class, mag_class
from quakes.operators.clean import add_time_parts, column_medians, fill_alert, fill_medians, lower_alert


def test_depth_class_boundaries(spark):
    vals = [0.0, 69.999, 70.0, 299.99, 300.0, 700.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "d double")
    got = [r[0] for r in df.select(depth_class(F.col("d"))).collect()]
    # null and NaN compare false everywhere -> Deep, as a row loop over NaN would
    assert got == ["Shallow", "Shallow", "Intermediate", "Intermediate", "Deep", "Deep", "Deep", "Deep"]


def test_mag_class_boundaries(spark):
    vals = [3.0, 3.99, 4.0, 4.99, 5.0, 6.0, 6.99, 7.0, 7.5, None]
    df = spark.createDataFrame([(v,) for v in vals], "m double")
    got = [r[0] for r in df.select(mag_class(F.col("m"))).collect()]
    assert got == ["Minor", "Minor", "Light", "Light", "Moderate", "Strong", "Strong", "Destructive", "Destructive",
                   "Destructive"]


def test_medians_even_odd_all_null(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, None), (2.0, None, None), (3.0, 7.0, None), (4.0, 1.0, None)], "a double, b double, c double"
    )
    med = column_medians(df, ["a", "b", "c"])
    assert med == {"a": 2.5, "b": 5.0, "c": None}
    pdf = df.toPandas()
    assert med["a"] == pdf["a"].median() and med["b"] == pdf["b"].median()
    filled = fill_medians(df, med).collect()
    assert [r.b for r in filled] == [5.0, 5.0, 7.0, 1.0]
    assert all(r.c is None for r in filled)


def test_alert_lower_then_fill(spark):
    df = spark.createDataFrame([("Yellow",), ("green",), (None,)], "alert string")
    got = [r.alert for r in fill_alert(lower_alert(df)).collect()]
    assert got == ["yellow", "green", "Data_Not_available"]


def test_time_parts_full_day_name(spark):
    ts = dt.datetime(2024, 1, 1, 13, 5, 0)  # a Monday
    df = spark.createDataFrame([(ts,)], "time timestamp_ntz")
    r = add_time_parts(df).first()
    assert (r.year, r.month, r.day, r.day_of_week, r.hour) == (2024, 1, 1, "Monday", 13)
    assert r.day_of_week == pd.Timestamp(ts).day_name()



def test_epoch_micros_is_zone_free(spark):
    from quakes.functions.timeparts import epoch_micros, epoch_ms_to_ts

    stamps = [dt.datetime(2023, 3, 12, 1, 59, 59, 999999), dt.datetime(2023, 3, 12, 2, 30, 0, 1),
              dt.datetime(2023, 11, 5, 1, 30, 0, 500000), dt.datetime(1969, 12, 31, 23, 59, 59, 250000),
              dt.datetime(2024, 2, 29, 23, 0, 0)]
    df = spark.createDataFrame([(s,) for s in stamps], "t timestamp_ntz")
    want = [(s - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for s in stamps]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r[0] for r in df.select(epoch_micros(F.col("t"))).collect()] == want, zone
            back = df.select(epoch_ms_to_ts(F.floor(epoch_micros(F.col("t")) / 1000)).alias("b")).collect()
            assert [r.b for r in back] == [s.replace(microsecond=s.microsecond // 1000 * 1000) for s in stamps], zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
