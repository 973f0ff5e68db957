"""Driver-facing registry: name -> (spark, sf_dir) -> DataFrame, and the
matching DuckDB SQL.  Double columns are rounded to the oracle's digits.

Besides the 31 catalogue questions, the cleaning, enrichment, profile,
source and sink operators are registered on their own, each over the whole
quake view derived from ``events``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakes.operators import month_state, profile
from quakes.operators.clean import clean, clean_unfilled, lower_alert
from quakes.operators.cluster import write_clustered
from quakes.operators.distinct import distinct_counts
from quakes.operators.enrich import continent_lookup
from quakes.operators.frequent import frequent_modes
from quakes.operators.median import exact_medians
from quakes.operators.serial import serial_numbers
from quakes.plans import catalog, oracle
from quakes.plans.pipeline import eq_table
from quakes.schema import EQ, RAW_COLUMNS
from quakes.session import table_dir
from quakes.sources import feed, incremental, pages, versions
from quakes.sources.fixture import quake_raw
from quakes.sources.table import read_csv, write_csv


def round_doubles(df: DataFrame, digits: int = oracle.DIGITS) -> DataFrame:
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _catalog_query(q: catalog.NamedQuery) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(q.fn(eq_table(spark, sf_dir)))

    run.__name__ = q.key
    run.__doc__ = q.label
    return run


def _eq(spark, sf_dir):
    return eq_table(spark, sf_dir)


def _csv_roundtrip(spark, sf_dir):
    path = table_dir(spark, sf_dir, "eq_csv")
    write_csv(eq_table(spark, sf_dir), path)
    return read_csv(spark, path, EQ)


def _feed_roundtrip(spark, sf_dir):
    path = table_dir(spark, sf_dir, "feed_landing")
    feed.write_features(quake_raw(spark, sf_dir), path)
    return feed.flatten(feed.read_features(spark, path))


def _month_windows(spark, sf_dir):
    raw = quake_raw(spark, sf_dir)
    bounds = raw.agg(F.min(F.year("time")).alias("s"), F.max(F.year("time")).alias("e"))
    return feed.window_counts(raw, feed.windows_between(bounds, F.col("s"), F.col("e")))


def _country_rows(spark, sf_dir):
    """C3-C5 evaluated per row (the stand-alone cleaning path)."""
    return clean_unfilled(quake_raw(spark, sf_dir)).select("id", "place", "country")


def _source_filter(spark, sf_dir):
    return feed.source_filter(quake_raw(spark, sf_dir), "2019-01-01", "2023-01-01", 3.0)


def _stream_ingest(spark, sf_dir):
    """Land the quake view as feature files, ingest them with the stream."""
    from quakes.streaming.ingest import ingest_pages

    run = uuid.uuid4().hex[:8]  # each call lands and ingests into fresh folders
    land = table_dir(spark, sf_dir, run, "stream_landing")
    out = table_dir(spark, sf_dir, run, "stream_raw")
    feed.write_features(quake_raw(spark, sf_dir), land)
    ingest_pages(spark, land, out, checkpoint=table_dir(spark, sf_dir, run, "stream_ckpt"), pages=False)
    return spark.read.parquet(out).select(*RAW_COLUMNS, "year", "month")


def _medians(spark, sf_dir):
    """C8 medians as the pipeline computes them (distributed exact selection)."""
    cols = profile.PROFILE_COLUMNS
    got = exact_medians(clean_unfilled(quake_raw(spark, sf_dir)), cols, sf_dir, uuid.uuid4().hex)
    row = pd.DataFrame([[got[c] for c in cols]], columns=cols).astype("float64")
    return spark.createDataFrame(row, ", ".join(f"{c} double" for c in cols))


def _month_state(spark, sf_dir):
    """States of the months before 2021, of 2021 with values that are corrected later, then of all from 2021 on."""
    raw = lower_alert(quake_raw(spark, sf_dir))
    path = table_dir(spark, sf_dir, uuid.uuid4().hex, "month_state")
    later = "time >= TIMESTAMP_NTZ '2021-01-01'"
    month_state.save_months(raw.where(f"time IS NULL OR NOT ({later})"), path)
    month_state.save_months(raw.withColumns({"gap": F.col("gap") + 1, "alert": F.lit("red")}), path, "2021-01-01", "2022-01-01")
    return month_state.save_months(raw.where(later), path)


def _lookup(spark, sf_dir):
    return continent_lookup(clean_unfilled(quake_raw(spark, sf_dir)).select("country"))


def _numbered_q12(spark, sf_dir):
    q12 = catalog.q12_loss_continent(eq_table(spark, sf_dir))
    return catalog.numbered(q12, F.desc("estimated_loss"), F.asc("continent"))


def _numbered_q3(spark, sf_dir):
    return serial_numbers(catalog.q3_shallow_strong(eq_table(spark, sf_dir)), F.desc("mag"), F.asc("id"))


def _numbered_q16(spark, sf_dir):
    q16 = catalog.q16_types(eq_table(spark, sf_dir))
    return serial_numbers(q16, F.desc("total_no_of_earthquakes"), F.asc_nulls_first("types"))


def _numbered_events(spark, sf_dir):
    """A result as large as the table."""
    return serial_numbers(eq_table(spark, sf_dir).select("id", "time"), F.asc_nulls_first("time"), F.asc("id"))


def _pages_roundtrip(spark, sf_dir):
    """Month pages of the quake view, each read in ranges."""
    path = table_dir(spark, sf_dir, uuid.uuid4().hex, "page_landing")
    pages.write_pages(feed.to_features(quake_raw(spark, sf_dir)), path)
    return feed.flatten(pages.read_pages(spark, path))


def _managed_table(spark, sf_dir):
    """A named table loaded in part, then replaced by the whole, read by name."""
    eq = eq_table(spark, sf_dir)
    schema = f"quakes_{uuid.uuid4().hex[:8]}"
    where = table_dir(spark, sf_dir, schema, "schema")
    versions.replace_table(eq.where("mag > 5"), schema, "eq_data", location=where)
    table, loaded = versions.replace_table(eq, schema, "eq_data", location=where)
    return table.groupBy("year").agg(F.count("*").alias("events")).withColumn("loaded_rows", F.lit(loaded).cast("long"))


def _incremental_load(spark, sf_dir):
    """Three years loaded, then half a year again after a correction of its magnitudes."""
    raw = quake_raw(spark, sf_dir)
    path = table_dir(spark, sf_dir, uuid.uuid4().hex, "month_loads")
    incremental.load_windows(raw, path, "2020-01-01", "2023-01-01", 4.0)
    corrected = raw.withColumn("mag", F.col("mag") - 0.5)
    return incremental.load_windows(corrected, path, "2021-01-01", "2021-07-01", 4.0).select("id", "year", "month", "mag")


def _clustered_scan(spark, sf_dir):
    eq = eq_table(spark, sf_dir)
    path = table_dir(spark, sf_dir, uuid.uuid4().hex, "clustered")
    near = write_clustered(eq, path, ["depth_km", "mag", "latitude"])
    deep = near.where("depth_km > 300 AND mag > 5")
    return deep.unionByName(near.where("latitude BETWEEN -5 AND 5 AND depth_km < 70")).select("id", "country", "year")


OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "eq_table": _eq,
    "s7_csv_roundtrip": _csv_roundtrip,
    "s1_feed_roundtrip": _feed_roundtrip,
    "s2_month_windows": _month_windows,
    "c5_country_rows": _country_rows,
    "s3_source_filter": _source_filter,
    "stream_ingest": _stream_ingest,
    "c8_medians": _medians,
    "c9_modes": lambda spark, d: profile.modes(clean_unfilled(quake_raw(spark, d))),
    "c10_alert_counts": lambda spark, d: profile.value_counts(lower_alert(quake_raw(spark, d)), "alert"),
    "c11_null_counts": lambda spark, d: profile.null_counts(quake_raw(spark, d)),
    "c13_describe": lambda spark, d: profile.describe(clean_unfilled(quake_raw(spark, d))),
    "c9_modes_by_summary": lambda spark, d: frequent_modes(clean_unfilled(quake_raw(spark, d))),
    "c9_modes_by_month": lambda spark, d: month_state.state_modes(_month_state(spark, d)),
    "c10_alerts_by_month": lambda spark, d: month_state.state_value_counts(_month_state(spark, d), "alert"),
    "c11_nulls_by_month": lambda spark, d: month_state.state_null_counts(_month_state(spark, d)),
    "c13_describe_by_month": lambda spark, d: month_state.state_describe(_month_state(spark, d)),
    "d_continent_lookup": _lookup,
    "r2_numbered_q12": _numbered_q12,
    "r2_numbered_q3": _numbered_q3,
    "r2_numbered_q16": _numbered_q16,
    "r2_numbered_events": _numbered_events,
    "s1_pages_roundtrip": _pages_roundtrip,
    "s8_managed_table": _managed_table,
    "s2_incremental_load": _incremental_load,
    "g5_count_distinct": lambda spark, d: distinct_counts(eq_table(spark, d), ["month", "year", "country"], "EQ_type", "n_types"),
    "p8_clustered_scan": _clustered_scan,
}


def _rounded(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(fn(spark, sf_dir))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {q.key: _catalog_query(q) for q in catalog.CATALOG}
    out.update({k: _rounded(fn) for k, fn in OPERATORS.items()})
    return out


def oracle_sql() -> dict[str, str]:
    return oracle.all_sql()
