import datetime as dt

import pytest
from pyspark.sql import functions as F

from quakes.operators.pairs import FIRST, consecutive_pairs, consecutive_pairs_bruteforce, slice_candidates
from quakes.plans.pipeline import eq_table

from conftest import SF_MID, SF_SMALL


def _rows(df):
    return sorted((r.prev_id, r.id, round(r.gap_s, 6), round(r.distance_km, 6)) for r in df.collect())


@pytest.mark.parametrize("slices", [1, 7, 64])
def test_pairs_match_global_window_on_fixture(spark, slices):
    eq = eq_table(spark, SF_MID)
    fast = consecutive_pairs(eq, slices=slices)
    assert _rows(fast) == _rows(consecutive_pairs_bruteforce(eq))
    assert len(_rows(fast)) == 82


def test_pairs_edge_cases(spark):
    t0 = dt.datetime(2020, 1, 1, 0, 0, 0)
    s = lambda secs: t0 + dt.timedelta(seconds=secs)
    rows = [
        ("a", s(0), 10.0, 20.0),
        ("b", s(3600), 10.0, 20.1),        # exactly 3600 s later: kept
        ("c", s(7201), 10.0, 20.1),        # 3601 s later: dropped
        ("d", s(7201), 10.0, 20.1),        # same time as c, ordered by id: kept (0 s, 0 km)
        ("e", s(7300), None, None),        # null coordinates: dropped
        ("f", s(7400), 10.0, 20.1),        # neighbour is e (null): dropped
        ("g", s(7500), 10.0, 25.0),        # > 50 km: dropped
        ("h", s(90000), 10.0, 25.0),       # across empty hours: dropped
        ("i", None, 10.0, 25.0),           # no time: not in the order
        ("j", s(90001), 10.0, 25.0001),
    ]
    df = spark.createDataFrame(rows, "id string, time timestamp_ntz, latitude double, longitude double")
    expect = [("a", "b"), ("c", "d"), ("h", "j")]
    for slices in (1, 3, 10):
        got = sorted((r.prev_id, r.id) for r in consecutive_pairs(df, slices=slices).collect())
        assert got == expect, slices
    assert sorted((r.prev_id, r.id) for r in consecutive_pairs_bruteforce(df).collect()) == expect


def test_pairs_one_hot_timestamp_is_split(spark):
    """A third of the rows share one timestamp: the range split still spreads them."""
    t0 = dt.datetime(2021, 5, 5, 5, 5, 5)
    rows = [(f"x{i:04d}", t0, 1.0, 1.0) for i in range(300)]
    rows += [(f"y{i:04d}", t0 + dt.timedelta(minutes=i), 1.0, 1.0) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, time timestamp_ntz, latitude double, longitude double")
    fast = consecutive_pairs(df, slices=16)
    assert _rows(fast) == _rows(consecutive_pairs_bruteforce(df))
    per_part = (
        df.select(F.col("id"), F.col("time")).repartitionByRange(16, "time", "id")
        .groupBy(F.spark_partition_id()).count().collect()
    )
    assert max(r["count"] for r in per_part) < 300


def test_pairs_small_fixture(spark):
    eq = eq_table(spark, SF_SMALL)
    assert _rows(consecutive_pairs(eq, slices=5)) == _rows(consecutive_pairs_bruteforce(eq))


def test_slices_grow_with_the_rows(spark):
    eq = eq_table(spark, SF_SMALL)
    n = eq.where("time IS NOT NULL").count()
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = n // (4 * few)
    firsts = lambda **k: slice_candidates(eq, 50.0, 3600.0, **k).where(F.col("kind") == FIRST).count()
    assert firsts() <= few and firsts(rows_per_slice=size) > 3 * few
    assert _rows(consecutive_pairs(eq, rows_per_slice=size)) == _rows(consecutive_pairs_bruteforce(eq))
