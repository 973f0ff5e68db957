"""Pages and CSV files read in byte ranges, whatever the ranges' size."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakes.sources import feed, pages
from quakes.sources.csv_ranges import read_csv_ranges
from quakes.sources.pieces import read_pieces
from quakes.sources.table import write_csv


@pytest.fixture(params=["100", "1k", "128m"])
def ranges(spark, request):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def feature(k, **more):
    return {"type": "Feature", "id": f"f{k}", "properties": {"mag": k / 10, "place": f"{{x}} \"[\" \\ é{k}", "time": k, **more},
            "geometry": {"type": "Point", "coordinates": [k, -k / 2, 1.5]}}


def land(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)


def page(features, **kw):
    before = {"type": "FeatureCollection", "metadata": {"title": "a \"features\":[ {no} ", "n": [[{"x": [{}]}]]}, "links": [{"id": "l0"}]}
    return json.dumps({**before, "features": features, "bbox": [1, 2], "more": [{"id": "l1"}], "after": {"b": [{"id": "l2"}]}}, ensure_ascii=False, **kw)


def rows(df):
    return sorted((r["f"]["id"], r["f"]["properties"]["place"], r["f"]["geometry"]["coordinates"]) for r in df.collect())


def test_pages_of_all_shapes(spark, tmp_dir, ranges):
    land(tmp_dir, "a.json", page([feature(k) for k in range(40)]))
    land(tmp_dir, "b.json", page([feature(k, extra={"deep": [{"y": "}"}]}) for k in range(40, 60)], indent=2))
    land(tmp_dir, "c.json", page([]))
    land(tmp_dir, "d.json", json.dumps({"features": [feature(60)]}))
    got = rows(pages.read_pages(spark, tmp_dir))
    assert got == sorted((f"f{k}", f"{{x}} \"[\" \\ é{k}", [k, -k / 2, 1.5]) for k in range(61))
    if ranges == "100":  # one page is many tasks
        assert read_pieces(spark, f"{tmp_dir}/a.json", "{").select("block").distinct().count() > 20


def test_bad_pages_stop_the_read_or_are_kept_aside(spark, tmp_dir):
    good = page([feature(1), feature(2)])
    land(f"{tmp_dir}/in", "good.json", good)
    land(f"{tmp_dir}/in", "cut.json", good[: len(good) - 30])
    land(f"{tmp_dir}/in", "none.json", '{"type":"FeatureCollection"}')
    wrong = page([feature(3), feature(4)]).replace('"mag": 0.4', '"mag": "x{"')
    land(f"{tmp_dir}/in", "wrong.json", wrong)
    for name in ("cut", "none", "wrong"):
        with pytest.raises(ValueError, match=f"{name}.json"):
            pages.read_pages(spark, f"{tmp_dir}/in/{name}.json")
    got = [r[0] for r in rows(pages.read_pages(spark, f"{tmp_dir}/in", quarantine=f"{tmp_dir}/bad"))]
    assert got == ["f1", "f1", "f2", "f2", "f3"]
    bad = spark.read.schema(pages.QUARANTINE).parquet(f"{tmp_dir}/bad").collect()
    assert sorted((os.path.basename(r["file"]), r["feature"], r["reason"]) for r in bad) == sorted(
        [("cut.json", None, "unbalanced page"), ("none.json", None, "feed page without features"), ("wrong.json", 2, "unparsed feature")], key=str
    ) or len(bad) == 3
    assert {r["reason"] for r in bad} == {"unbalanced page", "feed page without features", "unparsed feature"}


def test_written_pages_are_valid_documents(spark, tmp_dir):
    f = spark.createDataFrame([(json.dumps(feature(k, tz=None)),) for k in range(30)], "j string")
    f = f.select(F.from_json("j", feed.FEATURE).alias("f"))
    pages.write_pages(f, tmp_dir + "/p")
    names = [os.path.join(d, n) for d, _, ns in os.walk(tmp_dir + "/p") for n in ns if n.endswith(".txt")]
    docs = [json.load(open(n, encoding="utf-8")) for n in names]
    assert sorted(x["id"] for d in docs for x in d["features"]) == sorted(f"f{k}" for k in range(30))


def test_a_month_is_one_page_however_partitions_are_joined(spark, tmp_dir):
    rows_ = spark.range(0, 3000, 1, 6).select(F.concat(F.lit("f"), "id").alias("id"), (F.col("id") % 40 * 30 * 86_400_000).alias("time"))
    f = rows_.select(F.struct(F.lit("Feature").alias("type"), "id", F.struct("time").alias("properties")).alias("f"))
    f = f.select(F.from_json(F.to_json("f"), feed.FEATURE).alias("f"))
    # so many bytes of lines call for several tasks, those of the months for one
    small = {"advisoryPartitionSizeInBytes": "20k", "coalescePartitions.minPartitionSize": "1k", "coalescePartitions.parallelismFirst": "false"}
    old = {k: spark.conf.get(f"spark.sql.adaptive.{k}") for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(f"spark.sql.adaptive.{k}", v)
        pages.write_pages(f, tmp_dir + "/p")
    finally:
        for k, v in old.items():
            spark.conf.set(f"spark.sql.adaptive.{k}", v)
    names = [os.path.join(d, n) for d, _, ns in os.walk(tmp_dir + "/p") for n in ns if n.endswith(".txt")]
    assert len(names) == len({os.path.dirname(n) for n in names}) > 30
    docs = [json.load(open(n, encoding="utf-8")) for n in names]
    assert sorted(x["id"] for d in docs for x in d["features"]) == sorted(f"f{k}" for k in range(3000))
    assert all([x["id"] for x in d["features"]] == sorted(x["id"] for x in d["features"]) for d in docs)
    assert pages.read_pages(spark, tmp_dir + "/p").count() == 3000


ODD = [
    (1, "plain", 1.5), (2, 'a "quoted", one', None), (3, "two\nlines", 0.0), (4, "", 2.0), (5, None, 3.0), (6, " blank ", None),
    (7, '"', 1.0), (8, "\n\n\n", 1.0), (9, "x\r\ny\r", 1.0), (10, 'end"\n"', 1.0), (11, "é,ß\t'", 1e-7), (12, "null", 1.0),
]
SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("x", T.DoubleType())])


def test_csv_of_odd_texts(spark, tmp_dir, ranges):
    rows = [(i + 100 * k, t, x) for k in range(20) for i, t, x in ODD]
    df = spark.createDataFrame(rows, SCHEMA)
    write_csv(df.coalesce(2), f"{tmp_dir}/c")
    got = [tuple(r) for r in read_csv_ranges(spark, f"{tmp_dir}/c", SCHEMA).collect()]
    assert sorted(got) == sorted(rows)
    if ranges == "100":
        assert read_pieces(spark, f"{tmp_dir}/c", "\n").select("file", "block").distinct().count() > 20


def test_csv_of_other_writers(spark, tmp_dir):
    land(f"{tmp_dir}/w", "a.csv", 'id,text,x\r\n1,"a\r\nb",2.5\r\n2,,\r\n\r\n3,"",1\r\n')
    land(f"{tmp_dir}/w", "b.csv", "id,text,x\n")
    got = sorted(tuple(r) for r in read_csv_ranges(spark, f"{tmp_dir}/w", SCHEMA).collect())
    assert got == [(1, "a\r\nb", 2.5), (2, None, None), (3, "", 1.0)]
    land(f"{tmp_dir}/bad", "a.csv", "id,text,x\n1,a,notanumber\n")
    with pytest.raises(Exception, match="(?i)malformed|parse|cannot"):
        read_csv_ranges(spark, f"{tmp_dir}/bad", SCHEMA).collect()
