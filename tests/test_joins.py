"""Lookup joins within and beyond the broadcast bounds."""

import statistics

import pytest
from pyspark.sql import functions as F

from quakes.operators.enrich import keyword_continent
from quakes.operators.joins import heavy_keys, lookup_join, lookup_size
from quakes.functions.rules import keyword_rows


def tables(spark, n=9000):
    """A third of the rows hold one key, a ninth none, the rest many."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 9 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 700))
    fact = spark.range(n).select("id", key.alias("country"), F.lit("x").alias("_salt"))
    dim = spark.range(700).select(F.concat(F.lit("k"), F.col("id")).alias("name"), F.col("id").alias("v"))
    return fact.repartition(8), dim.unionByName(spark.createDataFrame([("hot", -1), ("unused", -2)], "name string, v long"))


def rows(df):
    return sorted(map(repr, map(tuple, df.select("id", "country", "_salt", "name", "v").collect())))


@pytest.fixture()
def shuffled(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_a_key_with_a_third_of_the_rows_is_dealt_over_tasks(spark, shuffled):
    fact, dim = tables(spark)
    want = rows(fact.join(dim, fact["country"] == dim["name"], "left"))
    assert {r["heavy"] for r in heavy_keys(fact, "country", 16).collect()} == {"hot", None}
    for bounds in ({"max_rows": 10}, {"max_bytes": 100}):
        out = lookup_join(fact, dim, "country", "name", **bounds)
        assert out.columns == [*fact.columns, *dim.columns] and rows(out) == want
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * statistics.median(sizes)
    plain = fact.join(dim, fact["country"] == dim["name"], "left")
    assert max(r["count"] for r in plain.groupBy(F.spark_partition_id()).count().collect()) > 3000


def test_within_the_bounds_it_is_broadcast(spark, shuffled):
    fact, dim = tables(spark, 900)
    assert lookup_size(dim)[0] == 702 and 20_000 < lookup_size(dim)[1] < 40_000
    out = lookup_join(fact, dim, "country", "name")
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out) == rows(fact.join(dim, fact["country"] == dim["name"], "left"))


def test_empty_sides(spark, shuffled):
    fact, dim = tables(spark, 30)
    assert lookup_join(fact.limit(0), dim, "country", "name", max_rows=0).count() == 0
    assert lookup_join(fact, dim.limit(0), "country", "name", max_rows=0).where("v IS NULL").count() == 30


def test_keywords_by_substrings_equal_the_rule(spark):
    texts = [r[1].upper() + " ridge" for r in keyword_rows()] + [None, "", "x", "Norwegian Sea", "Ta", "Åland é or", "South Pacific Ocean", "orca"]
    ranked = [(k, c) for _, k, c, _ in sorted(keyword_rows(), key=lambda r: r[3])]
    got = {r["country"]: r["kw_continent"] for r in keyword_continent(spark.createDataFrame([(t,) for t in set(texts)], "country string")).collect()}
    assert got == {t: next((c for k, c in ranked if t and k in t.lower()), None) for t in set(texts)}
