"""Fixed schemas: the GeoJSON feed page, the flattened RAW table and the
cleaned / enriched EQ table.  Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_D = T.DoubleType()
_I = T.IntegerType()
_L = T.LongType()
_S = T.StringType()

# Feed page: {"features": [{"id", "properties": {...}, "geometry": {"coordinates": [lon, lat, depth]}}]}
FEED_PROPERTIES = T.StructType(
    [
        T.StructField("mag", _D),
        T.StructField("place", _S),
        T.StructField("time", _L),
        T.StructField("updated", _L),
        T.StructField("tz", _I),
        T.StructField("url", _S),
        T.StructField("detail", _S),
        T.StructField("felt", _I),
        T.StructField("cdi", _D),
        T.StructField("mmi", _D),
        T.StructField("alert", _S),
        T.StructField("status", _S),
        T.StructField("tsunami", _I),
        T.StructField("sig", _I),
        T.StructField("net", _S),
        T.StructField("code", _S),
        T.StructField("ids", _S),
        T.StructField("sources", _S),
        T.StructField("types", _S),
        T.StructField("nst", _I),
        T.StructField("dmin", _D),
        T.StructField("rms", _D),
        T.StructField("gap", _D),
        T.StructField("magType", _S),
        T.StructField("type", _S),
        T.StructField("title", _S),
        T.StructField("magError", _D),
        T.StructField("magNst", _I),
        T.StructField("depthError", _D),
    ]
)

FEATURE = T.StructType(
    [
        T.StructField("type", _S),
        T.StructField("id", _S),
        T.StructField("properties", FEED_PROPERTIES),
        T.StructField("geometry", T.StructType([T.StructField("type", _S), T.StructField("coordinates", T.ArrayType(_D))])),
    ]
)

FEED = T.StructType([T.StructField("type", _S), T.StructField("features", T.ArrayType(FEATURE))])

# Flattened feed, one row per feature (29 columns, feed order).
RAW = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("updated", T.TimestampNTZType()),
        T.StructField("latitude", _D),
        T.StructField("longitude", _D),
        T.StructField("depth_km", _D),
        T.StructField("mag", _D),
        T.StructField("magtype", _S),
        T.StructField("place", _S),
        T.StructField("status", _S),
        T.StructField("tsunami", _I),
        T.StructField("alert", _S),
        T.StructField("felt", _L),
        T.StructField("cdi", _D),
        T.StructField("mmi", _D),
        T.StructField("sig", _L),
        T.StructField("net", _S),
        T.StructField("code", _S),
        T.StructField("ids", _S),
        T.StructField("sources", _S),
        T.StructField("types", _S),
        T.StructField("nst", _L),
        T.StructField("dmin", _D),
        T.StructField("rms", _D),
        T.StructField("gap", _D),
        T.StructField("type", _S),
        T.StructField("magerror", _D),
        T.StructField("magnst", _L),
        T.StructField("deptherror", _D),
    ]
)

RAW_COLUMNS = [f.name for f in RAW.fields]

# Final EQ table (35 columns).
EQ = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("updated", T.TimestampNTZType()),
        T.StructField("latitude", _D),
        T.StructField("longitude", _D),
        T.StructField("depth_km", _D),
        T.StructField("mag", _D),
        T.StructField("magtype", _S),
        T.StructField("place", _S),
        T.StructField("status", _S),
        T.StructField("tsunami", _I),
        T.StructField("alert", _S),
        T.StructField("felt", _D),
        T.StructField("cdi", _D),
        T.StructField("mmi", _D),
        T.StructField("sig", _D),
        T.StructField("net", _S),
        T.StructField("code", _S),
        T.StructField("ids", _S),
        T.StructField("sources", _S),
        T.StructField("types", _S),
        T.StructField("nst", _D),
        T.StructField("dmin", _D),
        T.StructField("rms", _D),
        T.StructField("gap", _D),
        T.StructField("type", _S),
        T.StructField("year", _I),
        T.StructField("month", _I),
        T.StructField("day", _I),
        T.StructField("day_of_week", _S),
        T.StructField("hour", _I),
        T.StructField("country", _S),
        T.StructField("EQ_type", _S),
        T.StructField("EQ_intensity", _S),
        T.StructField("continent", _S),
    ]
)

EQ_COLUMNS = [f.name for f in EQ.fields]
