"""GeoJSON feed source.

* S1 ``read_pages``: feed page documents (one FeatureCollection per file, as
  returned per request) -> one row per feature.  A page document is not
  splittable, so land one file per month window (the API caps a page), or
  land features one per line and use ``read_features`` (splittable).
* S2 ``month_windows``: the half-open monthly request windows of a year range.
* S3 ``source_filter``: time window and minimum magnitude.
* S4/S5 ``flatten``: the 29 catalogue fields, camelCase -> lowercase, epoch
  milliseconds -> naive UTC timestamps, coordinates (lon, lat, depth).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakes.functions.timeparts import epoch_millis, epoch_ms_to_ts
from quakes.schema import FEATURE, FEED, RAW

# feed property -> RAW column (where the names differ)
RENAMES = {"magType": "magtype", "magError": "magerror", "magNst": "magnst", "depthError": "deptherror"}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page documents -> column ``f`` (one feature per row).

    A malformed page, or one without ``features``, stops the read.
    """
    pages = spark.read.schema(FEED).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return page_features(pages)


def page_features(pages: DataFrame) -> DataFrame:
    """One row per feature; raises on a page without a feature list."""
    missing = F.raise_error(F.lit("feed page without features"))
    return pages.select(F.explode(F.when(F.col("features").isNull(), missing).otherwise(F.col("features"))).alias("f"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """S1 (splittable form): one GeoJSON feature per line -> column ``f``.

    A malformed line stops the read.
    """
    return spark.read.schema(FEATURE).option("mode", "FAILFAST").json(path).select(F.struct(*[F.col(c) for c in FEATURE.fieldNames()]).alias("f"))


def flatten(features: DataFrame, col: str = "f") -> DataFrame:
    """S4 + S5: nested feature -> RAW row."""
    f = F.col(col)
    p = f["properties"]
    coords = f["geometry"]["coordinates"]
    fields: dict[str, Column] = {
        "id": f["id"],
        "time": epoch_ms_to_ts(p["time"]),
        "updated": epoch_ms_to_ts(p["updated"]),
        "latitude": F.get(coords, 1),
        "longitude": F.get(coords, 0),
        "depth_km": F.get(coords, 2),
    }
    for name in FEED_FIELDS:
        fields.setdefault(RENAMES.get(name, name), p[name])
    return features.select(*[fields[c.name].cast(c.dataType).alias(c.name) for c in RAW.fields])


FEED_FIELDS = [
    "mag", "magType", "place", "status", "tsunami", "alert", "felt", "cdi", "mmi", "sig", "net", "code",
    "ids", "sources", "types", "nst", "dmin", "rms", "gap", "type", "magError", "magNst", "depthError",
]


def month_windows(spark: SparkSession, start_year: int, end_year: int) -> DataFrame:
    """(window_start, window_end) for every month of the year range."""
    one = spark.range(1).select(F.lit(start_year).alias("s"), F.lit(end_year).alias("e"))
    return windows_between(one, F.col("s"), F.col("e"))


def recent_month_windows(spark: SparkSession, years_back: int = 5) -> DataFrame:
    """S2 with the default range: from January ``years_back`` years ago to
    December of the current year (six calendar years for 5), from the
    session's current date."""
    this_year = F.year(F.current_date())
    one = spark.range(1).select((this_year - years_back).alias("s"), this_year.alias("e"))
    return windows_between(one, F.col("s"), F.col("e"))


def windows_between(one_row: DataFrame, start_year: Column, end_year: Column) -> DataFrame:
    """S2 from a one-row frame holding the year bounds (may be data derived)."""
    starts = F.sequence(
        F.make_date(start_year, F.lit(1), F.lit(1)),
        F.make_date(end_year, F.lit(12), F.lit(1)),
        F.expr("INTERVAL 1 MONTH"),
    )
    return one_row.select(F.explode(starts).alias("window_start")).select(
        "window_start", F.add_months("window_start", 1).alias("window_end")
    )


def source_filter(raw: DataFrame, start: str | dt.date, end: str | dt.date, min_mag: float = 3.0) -> DataFrame:
    """S3: ``start <= time < end`` and ``mag >= min_mag``."""
    s = F.lit(str(start)).cast("timestamp_ntz")
    e = F.lit(str(end)).cast("timestamp_ntz")
    return raw.where((F.col("time") >= s) & (F.col("time") < e) & (F.col("mag") >= min_mag))


def window_counts(raw: DataFrame, windows: DataFrame, min_mag: float = 3.0) -> DataFrame:
    """Events per request window (empty windows give 0), as the per-window
    progress line of a monthly fetch would show.  Each event falls in exactly
    one half-open window, found by truncating its time (an equi-join)."""
    per_month = (
        raw.where(F.col("mag") >= min_mag)
        .groupBy(F.trunc(F.col("time").cast("date"), "MM").alias("window_start"))
        .agg(F.count(F.lit(1)).alias("events"))
    )
    return (
        windows.join(per_month, "window_start", "left")
        .select("window_start", "window_end", F.coalesce(F.col("events"), F.lit(0)).alias("events"))
    )


def to_features(raw: DataFrame) -> DataFrame:
    """RAW rows -> GeoJSON feature structs (for landing test feeds)."""
    def ms(c: str) -> Column:
        return epoch_millis(F.col(c))

    props = {name: F.col(RENAMES.get(name, name)) for name in FEED_FIELDS}
    props["time"] = ms("time")
    props["updated"] = ms("updated")
    prop_struct = F.struct(
        *[props[fld.name].cast(fld.dataType).alias(fld.name) if fld.name in props else F.lit(None).cast(fld.dataType).alias(fld.name)
          for fld in FEATURE["properties"].dataType.fields]
    )
    coords = F.when(
        F.col("longitude").isNotNull() | F.col("latitude").isNotNull() | F.col("depth_km").isNotNull(),
        F.array(F.col("longitude"), F.col("latitude"), F.col("depth_km")),
    )
    return raw.select(
        F.struct(
            F.lit("Feature").alias("type"),
            F.col("id").alias("id"),
            prop_struct.alias("properties"),
            F.struct(F.lit("Point").alias("type"), coords.alias("coordinates")).alias("geometry"),
        ).alias("f")
    )


def write_features(raw: DataFrame, path: str) -> None:
    """Land features one per line (splittable JSON Lines)."""
    to_features(raw).select("f.*").write.mode("overwrite").json(path)
