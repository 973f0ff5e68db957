"""Quake view over the driver's ``events`` table (FIXTURES.md, F3).

The test tables hold no earthquakes, so a RAW-shaped catalogue is derived from
``events`` by fixed arithmetic.  It is a pure projection (no shuffle), so it
scales with ``events`` and keeps Parquet column pruning on the scan.  The same
formulas are written in DuckDB SQL in ``quakes.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakes.schema import RAW

NETS = ["us", "ak", "ci", "nc", "pr"]
MAGTYPES = ["mb", "ml", "mww"]  # u % 4 == 3 -> null
TOWN_REGIONS = [
    "Japan", "Indonesia", "Chile", "California", "CA", "Alaska",
    "Papua New Guinea", "Peru", "Greece", "Turkey", "Fiji", "Mexico",
]
LITERAL_PLACES = [
    "New Zealand earthquake",
    "north of Ascension Island",
    "Southeast of the Loyalty Islands",
    "Burma (Myanmar) earthquake",
    "12 km NNE of Ta",
    "South Sandwich Islands region",
    "Carlsberg Ridge",
    "Mid-Indian Ridge",
    "northern Mid-Atlantic Ridge",
    "Southern Mid-Atlantic Ridge",
    "Banda Sea",
    "  Kahramanmaras earthquake sequence ",
]
TYPES = [",origin,phase-data,", ",dyfi,origin,phase-data,", ",moment-tensor,origin,"]


def _pick(values: list[str], idx: Column) -> Column:
    """values[idx] (0-based), null outside the list."""
    return F.get(F.array(*[F.lit(v) for v in values]), idx.cast("int"))


def _null_if(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def quake_view(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    u = F.col("user_id")
    v = F.col("value")
    k = F.regexp_extract(F.col("props"), "[0-9]+", 0).cast("bigint")
    base = events.select(
        e.alias("e"), u.alias("u"), v.alias("v"), F.col("ts"), F.col("event_type"), k.alias("k"), (u % 25).alias("p")
    )
    e, u, v, k, p = (F.col(c) for c in ("e", "u", "v", "k", "p"))
    ts = F.col("ts").cast("timestamp_ntz")

    net = _pick(NETS, u % 5)
    shift_days = ((k * 7 + u) % 72) * 30
    time = F.timestamp_add("DAY", -shift_days, ts)
    town = F.concat(k.cast("string"), F.lit(" km NE of Town "), u.cast("string"), F.lit(", "), _pick(TOWN_REGIONS, p))
    place = F.when(p < 12, town).otherwise(_pick(LITERAL_PLACES, p - 12))
    alert = (
        F.when(k < 10, "green").when(k < 14, "Yellow").when(k < 16, "orange").when(k == 16, "red")
    )
    ident = F.concat(net, e.cast("string"))
    cols = {
        "id": ident,
        "time": time,
        "updated": F.timestamp_add("DAY", F.lit(1), time),
        "latitude": _null_if(e % 211 == 0, (p * 13 % 121) - 60 + (k - 50) / 250.0),
        "longitude": _null_if(e % 211 == 0, (p * 47 % 360) - 180 + ((u % 7) - 3) / 20.0),
        "depth_km": _null_if(e % 97 == 0, (e * 37 % 700) + k / 100.0),
        "mag": _null_if(e % 499 == 0, 3 + F.floor(F.least(v, F.lit(245.0)) / 4.9) / 10.0),
        "magtype": _pick(MAGTYPES, u % 4),
        "place": place,
        "status": F.when(F.col("event_type") == "error", "automatic").otherwise("reviewed"),
        "tsunami": F.when(k % 10 == 0, 1).otherwise(0),
        "alert": alert,
        "felt": F.when(k % 4 == 0, e % 500),
        "cdi": F.when(k % 4 == 0, (e % 80) / 10.0),
        "mmi": _null_if(k % 12 == 0, (e % 60) / 10.0),
        "sig": e % 1000,
        "net": net,
        "code": e.cast("string"),
        "ids": F.concat(F.lit(","), ident, F.lit(",")),
        "sources": F.concat(F.lit(","), net, F.lit(",")),
        "types": _pick(TYPES, k % 3),
        "nst": _null_if(e % 4 == 1, e % 200),
        "dmin": _null_if(e % 28 == 0, (e % 1000) / 100.0),
        "rms": _null_if(e % 101 == 0, (e * 7 % 150) / 100.0),
        "gap": _null_if(e % 37 == 0, (e % 360).cast("double")),
        "type": F.when(k == 99, "volcanic eruption").when(k == 98, "landslide").otherwise("earthquake"),
        "magerror": F.lit(None),
        "magnst": F.lit(None),
        "deptherror": F.lit(None),
    }
    return base.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in RAW.fields])


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def quake_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW catalogue derived from ``{sf_dir}/events.parquet``."""
    return quake_view(read_events(spark, sf_dir))
