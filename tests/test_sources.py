import datetime as dt
import json
import os

from pyspark.sql import functions as F

from quakes.schema import EQ, RAW_COLUMNS
from quakes.sources import feed
from quakes.sources.table import read_csv, save_table, save_table_counted, write_csv
from quakes.streaming.ingest import ingest_pages, start_ingest

EPOCH = dt.datetime(1970, 1, 1)


def ms(d: dt.datetime) -> int:
    return int((d - EPOCH).total_seconds() * 1000)


def feature(fid, when, coords, **props):
    p = {"mag": 4.5, "magType": "mb", "place": "10 km S of X, Chile", "time": ms(when) if when else None,
         "updated": ms(when) + 60000 if when else None, "tsunami": 0, "sig": 312, "net": "us", "code": fid,
         "ids": f",us{fid},", "sources": ",us,", "types": ",origin,", "nst": 40, "dmin": 1.2, "rms": 0.7,
         "gap": 35, "type": "earthquake", "status": "reviewed", "alert": None, "felt": None, "cdi": None,
         "mmi": None, "magError": None, "magNst": None, "depthError": None}
    p.update(props)
    return {"type": "Feature", "id": f"us{fid}", "properties": p, "geometry": {"type": "Point", "coordinates": coords}}


def write_page(path, feats):
    with open(path, "w") as f:
        json.dump({"type": "FeatureCollection", "metadata": {"count": len(feats)}, "features": feats}, f, indent=1)


def test_read_pages_and_flatten(spark, tmp_dir):
    dec = dt.datetime(2023, 12, 31, 23, 59, 59)
    start = dt.datetime(2024, 1, 1, 0, 0, 0)
    write_page(os.path.join(tmp_dir, "2023-12.json"), [
        feature("1", dec, [-70.5, -33.1, 35.0], magType="mww", alert="Green", felt=12),
        feature("2", dec, [], place=None),
        feature("3", None, [10.0, 20.0, 5.0]),
    ])
    write_page(os.path.join(tmp_dir, "2024-01.json"), [feature("4", start, [1.0, 2.0, 3.0], mag=3.0)])
    write_page(os.path.join(tmp_dir, "2024-02.json"), [])  # an empty month
    raw = feed.flatten(feed.read_pages(spark, tmp_dir))
    assert raw.columns == RAW_COLUMNS
    rows = {r.id: r for r in raw.collect()}
    assert set(rows) == {"us1", "us2", "us3", "us4"}
    r1 = rows["us1"]
    assert (r1.longitude, r1.latitude, r1.depth_km) == (-70.5, -33.1, 35.0)
    assert r1.time == dec and r1.updated == dec + dt.timedelta(minutes=1)
    assert (r1.magtype, r1.alert, r1.felt) == ("mww", "Green", 12)
    assert rows["us2"].latitude is None and rows["us2"].place is None
    assert rows["us3"].time is None
    assert rows["us4"].time == start


def test_month_windows_roll_over_december(spark):
    w = feed.month_windows(spark, 2023, 2024).orderBy("window_start").collect()
    assert len(w) == 24
    assert (w[11].window_start, w[11].window_end) == (dt.date(2023, 12, 1), dt.date(2024, 1, 1))
    assert w[-1].window_end == dt.date(2025, 1, 1)


def test_source_filter_half_open_and_min_mag(spark):
    rows = [("a", dt.datetime(2024, 1, 1), 3.0), ("b", dt.datetime(2024, 2, 1), 5.0),
            ("c", dt.datetime(2024, 1, 15), 2.9), ("d", dt.datetime(2024, 1, 31, 23, 59), None)]
    df = spark.createDataFrame(rows, "id string, time timestamp_ntz, mag double")
    got = [r.id for r in feed.source_filter(df, "2024-01-01", "2024-02-01").collect()]
    assert got == ["a"]


def test_window_counts_include_empty_windows(spark):
    rows = [("a", dt.datetime(2024, 1, 1), 3.5), ("b", dt.datetime(2024, 3, 31, 23), 4.0)]
    df = spark.createDataFrame(rows, "id string, time timestamp_ntz, mag double")
    got = {r.window_start.month: r.events for r in feed.window_counts(df, feed.month_windows(spark, 2024, 2024)).collect()}
    assert got[1] == 1 and got[2] == 0 and got[3] == 1 and len(got) == 12


def test_features_roundtrip(spark, tmp_dir):
    from quakes.sources.fixture import quake_raw

    raw = quake_raw(spark, "/root/testdata/sf0.001")
    feed.write_features(raw, tmp_dir + "/landed")
    back = feed.flatten(feed.read_features(spark, tmp_dir + "/landed"))
    assert back.count() == raw.count()
    trunc = raw.withColumn("time", F.timestamp_add("MILLISECOND", F.timestamp_diff(
        "MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "time"), F.lit("1970-01-01").cast("timestamp_ntz")))
    cols = ["id", "time", "place", "mag", "latitude", "longitude", "depth_km", "felt", "nst", "types"]
    assert trunc.select(*cols).exceptAll(back.select(*cols)).count() == 0


def test_csv_and_table_roundtrip(spark, tmp_dir):
    from quakes.plans.pipeline import eq_table

    eq = eq_table(spark, "/root/testdata/sf0.001")
    write_csv(eq, tmp_dir + "/csv")
    back = read_csv(spark, tmp_dir + "/csv", EQ)
    assert back.exceptAll(eq).count() == 0 and eq.exceptAll(back).count() == 0
    t = save_table(eq, tmp_dir + "/tbl", name="eq_copy")
    assert spark.table("eq_copy").count() == eq.count() == t.count()
    assert sorted(os.listdir(tmp_dir + "/tbl"))[0].startswith("_") or any(
        d.startswith("year=") for d in os.listdir(tmp_dir + "/tbl"))


def test_streaming_ingest_appends_new_pages_once(spark, tmp_dir):
    land, table = tmp_dir + "/landing", tmp_dir + "/raw_table"
    os.makedirs(land)
    write_page(f"{land}/2024-01.json", [feature("1", dt.datetime(2024, 1, 5), [1.0, 2.0, 3.0]),
                                        feature("2", dt.datetime(2024, 1, 6), [1.0, 2.0, 3.0])])
    write_page(f"{land}/2024-02.json", [feature("3", dt.datetime(2024, 2, 5), [1.0, 2.0, 3.0])])
    ckpt = tmp_dir + "/ckpt"
    ingest_pages(spark, land, table, checkpoint=ckpt)
    assert spark.read.parquet(table).count() == 3
    write_page(f"{land}/2024-03.json", [feature("4", dt.datetime(2024, 3, 5), [1.0, 2.0, 3.0])])
    ingest_pages(spark, land, table, checkpoint=ckpt)
    got = spark.read.parquet(table)
    assert got.count() == 4
    assert sorted(r.month for r in got.select("month").distinct().collect()) == [1, 2, 3]


def test_loaded_count_is_observed_during_the_write(spark, tmp_dir):
    from quakes.sources.fixture import quake_raw

    raw = quake_raw(spark, "/root/testdata/sf0.001").withColumn("year", F.year("time"))
    table, n = save_table_counted(raw, tmp_dir + "/counted")
    assert n == raw.count() == table.count()


def test_recent_month_windows_cover_six_calendar_years(spark):
    w = feed.recent_month_windows(spark).orderBy("window_start").collect()
    this_year = dt.date.today().year
    assert len(w) == 72
    assert w[0].window_start == dt.date(this_year - 5, 1, 1) and w[-1].window_end == dt.date(this_year + 1, 1, 1)


def test_long_running_ingest_picks_up_new_pages(spark, tmp_dir):
    land, table = tmp_dir + "/landing", tmp_dir + "/raw_table"
    os.makedirs(land)
    write_page(f"{land}/2024-01.json", [feature("1", dt.datetime(2024, 1, 5), [1.0, 2.0, 3.0])])
    q = start_ingest(spark, land, table, checkpoint=tmp_dir + "/ckpt", every="1 second")
    try:
        q.processAllAvailable()
        assert spark.read.parquet(table).count() == 1
        write_page(f"{land}/2024-02.json", [feature("2", dt.datetime(2024, 2, 5), [1.0, 2.0, 3.0])])
        q.processAllAvailable()
        assert spark.read.parquet(table).count() == 2
    finally:
        q.stop()


def test_bad_pages_and_lines_stop_the_read(spark, tmp_dir):
    import pytest

    good = json.dumps(feature("1", dt.datetime(2024, 1, 5), [1.0, 2.0, 3.0]))
    for name, text in (("cut", '{"type": "FeatureCollection", "features": [' + good), ("none", '{"type": "FeatureCollection"}')):
        os.makedirs(f"{tmp_dir}/{name}")
        with open(f"{tmp_dir}/{name}/page.json", "w") as f:
            f.write(text)
        with pytest.raises(Exception):
            feed.flatten(feed.read_pages(spark, f"{tmp_dir}/{name}")).collect()
        with pytest.raises(Exception):
            ingest_pages(spark, f"{tmp_dir}/{name}", f"{tmp_dir}/{name}_table")
    with open(f"{tmp_dir}/lines.json", "w") as f:
        f.write(good + "\n" + good[:80] + "\n")
    with pytest.raises(Exception):
        feed.flatten(feed.read_features(spark, f"{tmp_dir}/lines.json")).collect()


def test_csv_keeps_line_breaks_quotes_and_blanks(spark, tmp_dir):
    rows = [("a\nb", 1), (' led "q" , x ', 2), (None, 3), ("back\\slash\"", 4)]
    df = spark.createDataFrame(rows, "place string, n int")
    write_csv(df, tmp_dir + "/csv")
    back = read_csv(spark, tmp_dir + "/csv", df.schema)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)


def test_ingest_without_a_given_checkpoint_reads_each_page_once(spark, tmp_dir):
    land, table = tmp_dir + "/landing", tmp_dir + "/raw_table"
    os.makedirs(land)
    write_page(f"{land}/1.json", [feature("1", dt.datetime(2024, 1, 5), [1.0, 2.0, 3.0])])
    assert ingest_pages(spark, land, table) == 1
    write_page(f"{land}/2.json", [feature("2", dt.datetime(2024, 2, 5), [1.0, 2.0, 3.0])])
    assert ingest_pages(spark, land, table) == 1
    assert ingest_pages(spark, land, table) == 0
    assert spark.read.parquet(table).count() == 2


def test_two_builds_stay_readable(spark):
    from quakes.plans.pipeline import build_eq
    from quakes.sources.fixture import quake_raw

    raw = quake_raw(spark, "/root/testdata/sf0.001")
    first, second = build_eq(raw, "k"), build_eq(raw, "k")
    assert first.count() == second.count() == raw.count()
