import datetime as dt

from pyspark.sql import functions as F

from quakes.plans import catalog
from quakes.schema import EQ


def _eq(spark, rows):
    """EQ-shaped frame from a few dicts (missing fields are null)."""
    data = [tuple(r.get(f.name) for f in EQ.fields) for r in rows]
    return spark.createDataFrame(data, EQ)


T = dt.datetime(2020, 5, 1, 12, 0, 0)


def test_q3_case_insensitive_and_bounds(spark):
    eq = _eq(spark, [
        dict(id="a", EQ_type="Shallow", depth_km=10.0, mag=7.6),
        dict(id="b", EQ_type="Shallow", depth_km=50.0, mag=7.6),
        dict(id="c", EQ_type="Shallow", depth_km=10.0, mag=7.5),
        dict(id="d", EQ_type="Deep", depth_km=10.0, mag=8.0),
    ])
    assert [r.id for r in catalog.q3_shallow_strong(eq).collect()] == ["a"]


def test_q26_no_deep_gives_null_ratio_sorted_last(spark):
    eq = _eq(spark, [
        dict(id="1", country="A", EQ_type="Shallow"), dict(id="2", country="A", EQ_type="Deep"),
        dict(id="3", country="B", EQ_type="Shallow"), dict(id="4", country="B", EQ_type="Shallow"),
        dict(id="5", country="C", EQ_type="Shallow"), dict(id="6", country="C", EQ_type="Shallow"),
        dict(id="7", country="C", EQ_type="Deep"),
    ])
    got = [(r.country, r.shallow_count, r.deep_count, r.ratio) for r in catalog.q26_shallow_deep_ratio(eq).collect()]
    assert got == [("C", 2, 1, 2.0), ("A", 1, 1, 1.0), ("B", 2, 0, None)]


def test_q23_growth(spark):
    rows = [dict(id=str(i), year=2020) for i in range(4)] + [dict(id=f"x{i}", year=2021) for i in range(5)]
    got = [(r.year, r["count"], r.prev_year_count, r.growth_rate) for r in catalog.q23_yoy_growth(_eq(spark, rows)).collect()]
    assert got == [(2020, 4, None, None), (2021, 5, 4, 25.0)]


def test_q22_both_classes_same_month(spark):
    eq = _eq(spark, [
        dict(id="1", country="A", month=1, year=2020, EQ_type="Shallow"),
        dict(id="2", country="A", month=1, year=2020, EQ_type="Deep"),
        dict(id="3", country="A", month=2, year=2020, EQ_type="Shallow"),
        dict(id="4", country="A", month=2, year=2020, EQ_type="Intermediate"),
        dict(id="5", country="B", month=1, year=2020, EQ_type="Deep"),
    ])
    assert [(r.country, r.month, r.year) for r in catalog.q22_shallow_and_deep(eq).collect()] == [("A", 1, 2020)]
    literal = catalog.q22_shallow_and_deep(eq, distinct_count=True)
    assert [(r.country, r.month, r.year) for r in literal.collect()] == [("A", 1, 2020)]


def test_q13_skips_missing_alerts_and_weights(spark):
    eq = _eq(spark, [dict(id="1", alert="green"), dict(id="2", alert="red"), dict(id="3", alert="Data_Not_available"),
                     dict(id="4", alert="purple")])
    got = {r.alert: r.avg_loss for r in catalog.q13_loss_alert(eq).collect()}
    assert got == {"green": 1000.0, "red": 100000.0, "purple": 0.0}


def test_q11_weights_light_below_minor(spark):
    eq = _eq(spark, [dict(id="1", country="A", EQ_intensity="Light"), dict(id="2", country="B", EQ_intensity="Minor"),
                     dict(id="3", country="C", EQ_intensity="Destructive")])
    got = [(r.country, r.estimated_casualities) for r in catalog.q11_casualties(eq).collect()]
    assert got == [("C", 10000), ("B", 10), ("A", 0)]


def test_r1_registry_and_r2_numbering(spark):
    eq = _eq(spark, [dict(id=str(i), hour=i % 3) for i in range(7)])
    res = catalog.run(eq, "9. Count of earthquakes per hour of day")
    numbered = catalog.numbered(res, F.asc("hour")).collect()
    assert [(r.S_No, r.hour, r.no_of_eq_per_hour) for r in numbered] == [(1, 0, 3), (2, 1, 2), (3, 2, 2)]
    assert len(catalog.CATALOG) == 31 and catalog.run(eq, "q9").count() == 3
