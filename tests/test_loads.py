"""Replaced tables, month loads, clustered tables."""

import datetime as dt
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quakes.operators.cluster import write_clustered
from quakes.sources import incremental, versions
from quakes.sources.fixture import quake_raw
from quakes.sources.table import save_table

from conftest import SF_MID, SF_SMALL


@pytest.fixture()
def schema(spark, tmp_dir):
    name = f"s_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE SCHEMA {name} LOCATION '{tmp_dir}/{name}'")
    return name


def years(n, first=2000):
    return [(k, first + k % 3) for k in range(n)]


def failing(spark):
    return spark.range(10).select(F.col("id"), F.when(F.col("id") == 7, F.raise_error(F.lit("broken")).cast("int")).otherwise(2001).alias("year"))


def test_replace_by_name(spark, schema):
    made = spark.createDataFrame(years(9), "id long, year int")
    t, n = versions.replace_table(made, schema, "eq")
    assert n == 9 and t.count() == 9
    t, n = versions.replace_table(made.limit(4), schema, "eq")
    assert n == 4 and versions.named_count(spark, schema, "eq") == 4
    assert len(versions.loads(spark, schema, "eq")) == 2  # the one before stays for its readers
    versions.replace_table(made, schema, "eq")
    assert len(versions.loads(spark, schema, "eq")) == 2
    assert versions.read_named(spark, schema, "eq").where("year = 2001").count() == 3


def test_a_failed_write_keeps_the_old_table(spark, schema):
    versions.replace_table(spark.createDataFrame(years(5), "id long, year int"), schema, "eq")
    before = versions.loads(spark, schema, "eq")
    with pytest.raises(Exception, match="broken"):
        versions.replace_table(failing(spark), schema, "eq")
    assert versions.named_count(spark, schema, "eq") == 5
    assert versions.loads(spark, schema, "eq") == before


def test_a_plain_table_becomes_the_first_load(spark, schema):
    spark.range(3).write.saveAsTable(f"{schema}.eq")
    _, n = versions.replace_table(spark.range(8), schema, "eq", partition_by=())
    assert n == 8 and versions.named_count(spark, schema, "eq") == 8
    assert f"eq{versions.MARK}0" in versions.loads(spark, schema, "eq")


def test_save_table_by_name_and_empty_table(spark, schema):
    none = spark.createDataFrame([], "id long, year int")
    assert save_table(none, name=f"{schema}.none").count() == 0


def test_replace_by_path(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    versions.replace_folder(spark.createDataFrame(years(6), "id long, year int"), path)
    with pytest.raises(Exception, match="broken"):
        versions.replace_folder(failing(spark), path)
    assert spark.read.parquet(path).count() == 6
    versions.replace_folder(spark.createDataFrame(years(2), "id long, year int"), path)
    assert spark.read.parquet(path).count() == 2
    import os

    assert os.listdir(tmp_dir) == ["t"]


EVENTS = [("a", "2020-12-31 23:59:59", 5.0), ("b", "2021-01-01 00:00:00", 5.0), ("c", "2021-01-31 12:00:00", 2.9), ("d", "2021-02-01 00:00:00", 6.0), ("e", None, 7.0), ("f", "2021-02-03 00:00:00", None)]


def events(spark, rows=EVENTS):
    df = spark.createDataFrame(rows, "id string, t string, mag double")
    return df.select("id", F.col("t").cast("timestamp_ntz").alias("time"), "mag")


def ids(table):
    return sorted(r["id"] for r in table.collect())


def test_month_loads_replace_their_own_windows(spark, tmp_dir):
    path = f"{tmp_dir}/m"
    assert ids(incremental.load_windows(events(spark), path, "2020-12-01", "2021-02-01")) == ["a", "b"]
    assert ids(incremental.load_windows(events(spark), path, "2021-02-01", dt.date(2021, 3, 1))) == ["a", "b", "d"]
    later = events(spark, [("b", "2021-01-01 00:00:00", 1.0), ("x", "2020-12-05 00:00:00", 4.0)])
    # January has no event left; December is corrected; February is not in the load
    assert ids(incremental.load_windows(later, path, "2020-12-01", "2021-02-01")) == ["d", "x"]
    assert ids(incremental.load_windows(later, path, "2020-12-01", "2021-02-01")) == ["d", "x"]
    with pytest.raises(ValueError, match="whole months"):
        incremental.load_windows(later, path, "2020-12-02", "2021-02-01")


def test_windows():
    got = incremental.months_between(dt.date(2020, 11, 1), dt.date(2021, 3, 1))
    assert got == [(2020, 11), (2020, 12), (2021, 1), (2021, 2)]


def scanned(df):
    """Rows that the scan gives after passing over row groups."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.getClass().getName():
        plan = plan.executedPlan()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


FILTERS = ["depth_km > 400", "mag > 7", "latitude BETWEEN -3 AND 3 AND mag > 6", "depth_km < 20 AND mag > 5"]


def test_clustered_table_is_skipped_and_answers_alike(spark, tmp_dir):
    raw = quake_raw(spark, SF_MID).select("id", "depth_km", "mag", "latitude")
    plain = f"{tmp_dir}/plain"
    raw.repartition(80).write.parquet(plain)
    near = write_clustered(raw, f"{tmp_dir}/near", ["depth_km", "mag", "latitude"], partitions=80)
    assert near.count() == raw.count() and near.columns == raw.columns
    files = spark.read.parquet(plain)
    for f in FILTERS:
        assert sorted(map(tuple, near.where(f).collect())) == sorted(map(tuple, files.where(f).collect()))
        assert scanned(near.where(f).select("id")) < 0.6 * scanned(files.where(f).select("id")), f


def test_clustering_of_ties_and_nulls(spark, tmp_dir):
    rows = [(k, None if k % 5 == 0 else 1.0, None) for k in range(3000)] + [(9000, 2.0, float("nan"))]
    df = spark.createDataFrame(rows, "id long, depth_km double, mag double").withColumn("_cluster", F.lit(1))
    got = write_clustered(df, f"{tmp_dir}/t", ["depth_km", "mag"], partitions=8)
    assert got.count() == 3001 and got.columns == df.columns
    sizes = [pq.read_metadata(f).num_rows for f in (r[0].removeprefix("file://") for r in got.select(F.input_file_name()).distinct().collect())]
    assert max(sizes) < 1000  # one cell holds most rows and is split
    assert write_clustered(df.limit(0), f"{tmp_dir}/e", ["mag"]).count() == 0


def test_small_table_is_the_registered_one(spark):
    from quakes.plans.registry import queries

    assert queries()["s8_managed_table"](spark, SF_SMALL).count() > 1


def test_rows_go_to_their_partitions_without_a_sort(spark, tmp_dir):
    """A task writes before it has read its last row, so it does not hold them all."""

    def seen(batches):
        import glob
        import time

        import pyarrow as pa

        n = 0
        for b in batches:
            n += b.num_rows
            files = 0
            for _ in range(50 if n == 400_000 else 0):  # at the last rows
                files = len(glob.glob(f"{tmp_dir}/_staged-*/**/*.parquet", recursive=True))
                if files:
                    break
                time.sleep(0.1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([files] * b.num_rows, pa.int32())], names=["id", "files"])

    df = spark.range(0, 400_000, 1, 1).mapInArrow(seen, "id long, files int").withColumn("year", F.col("id").cast("int") % 7)
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    versions.replace_folder(df, f"{tmp_dir}/t")
    assert spark.conf.get(key, None) == before
    got = spark.read.parquet(f"{tmp_dir}/t")
    assert got.agg(F.max("files")).first()[0] > 0
    assert (got.count(), got.distinct().count(), got.where("id % 7 <> year").count()) == (400_000, 400_000, 0)
    many = spark.range(0, 4000, 1, 1).withColumn("year", F.col("id").cast("int") % 50)  # more than are kept open
    versions.replace_folder(many, f"{tmp_dir}/t")
    got = spark.read.parquet(f"{tmp_dir}/t")
    assert (got.distinct().count(), got.where("id % 50 <> year").count()) == (4000, 0)
