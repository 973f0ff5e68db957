"""Enrichment operators D1-D8.

Continent assignment follows the catalogue: evaluate the expensive text rules
(the 27 rewrites of C5 and the matching below) once per *distinct* country
text (D3), never per row, then map the answer back onto the rows with a
size-checked broadcast join (D8).

* D4 gazetteer: theta join of the distinct countries with the fixed 249-row
  ISO table (broadcast nested-loop join), scored exact / contained.
* D5 keywords: theta join with the fixed 279-row keyword table on
  ``contains``; the longest keyword (then dictionary order) wins via min_by.
* D6 ocean words, D7 default: one expression.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakes.functions.classes import depth_class, mag_class
from quakes.functions.gazetteer import EXACT_POINTS, GAZETTEER_DDL, PARTIAL_FLOOR, PARTIAL_TOP, gazetteer_rows
from quakes.functions.text import apply_rewrites, fold_accents
from quakes.functions.rules import OCEAN_LABEL, OCEAN_WORDS, UNKNOWN_LABEL, keyword_rows
from quakes.operators.joins import MAX_BROADCAST_ROWS, lookup_join

KEYWORD_DDL = "k_ord INT, k_keyword STRING, k_continent STRING, k_prio INT"


def add_classes(df: DataFrame) -> DataFrame:
    """D1 + D2."""
    return df.withColumns({"EQ_type": depth_class(F.col("depth_km")), "EQ_intensity": mag_class(F.col("mag"))})


def _small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Fixed, bounded table from Python data via Arrow (decoded in the JVM)."""
    schema = T.StructType.fromDDL(ddl)
    pdf = pd.DataFrame.from_records(rows, columns=schema.fieldNames())
    return spark.createDataFrame(pdf, schema)


def gazetteer_dim(spark: SparkSession) -> DataFrame:
    return _small_table(spark, gazetteer_rows(), GAZETTEER_DDL)


def keyword_dim(spark: SparkSession) -> DataFrame:
    return _small_table(spark, keyword_rows(), KEYWORD_DDL)


def distinct_countries(df: DataFrame) -> DataFrame:
    """D3 (partial aggregation collapses hot countries map-side)."""
    return df.select("country").distinct()


def _partial_points(pos):
    return F.greatest(F.lit(PARTIAL_FLOOR), F.lit(PARTIAL_TOP) - 2 * (pos - 1))


def gazetteer_continent(countries: DataFrame) -> DataFrame:
    """(country, gaz_continent) for each distinct country."""
    spark = countries.sparkSession
    g = F.broadcast(gazetteer_dim(spark))
    lc = fold_accents(F.lower(F.col("country")))
    exact = (
        (lc == g.g_code2) | (lc == g.g_code3) | (lc == g.g_name) | (lc == g.g_official) | (lc == g.g_common)
    )
    name_pos = F.instr(g.g_name, lc)
    off_pos = F.instr(g.g_official, lc)
    cond = (lc != "") & (exact | (name_pos > 0) | (F.coalesce(off_pos, F.lit(0)) > 0))
    keep = countries.columns
    matched = countries.join(g, cond, "left")
    points = F.when(exact, F.lit(EXACT_POINTS)).otherwise(0) + (
        F.when(name_pos > 0, _partial_points(name_pos)).when(off_pos > 0, _partial_points(off_pos)).otherwise(0)
    )
    best = F.struct(points.alias("pts"), (-F.col("g_ord")).alias("neg_ord"))
    return matched.groupBy(*keep).agg(
        F.max_by(F.col("g_continent"), F.when(F.col("g_ord").isNotNull(), best)).alias("gaz_continent")
    )


def substrings(text: F.Column, lengths: list[int]) -> F.Column:
    """The distinct substrings of these lengths."""
    def of(n: int) -> F.Column:
        starts = F.sequence(F.lit(1), F.length(text) - n + 1)
        return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*(of(n) for n in lengths)))


def keyword_continent(countries: DataFrame) -> DataFrame:
    """Adds kw_continent to a table with one row per distinct country.

    A keyword is contained in a text when it is one of its substrings, so each text's
    substrings of the keywords' lengths meet the keywords by equality (a hash join),
    however many texts there are."""
    spark = countries.sparkSession
    k = F.broadcast(keyword_dim(spark))
    keep = countries.columns
    lengths = sorted({len(word) for _, word, _, _ in keyword_rows()})
    lc = F.lower(F.col("country"))
    parts = countries.select(*keep, F.explode_outer(substrings(lc, lengths)).alias("_part"))
    matched = parts.join(k, F.col("_part") == F.col("k_keyword"), "left")
    return matched.groupBy(*keep).agg(F.min_by("k_continent", "k_prio").alias("kw_continent"))


def is_ocean(country) -> F.Column:
    """D6 test: any ocean word contained in the lowercased text."""
    lc = F.lower(country)
    return F.exists(F.array(*[F.lit(w) for w in OCEAN_WORDS]), lambda w: F.instr(lc, w) > 0)


def _resolve(d: DataFrame) -> DataFrame:
    """D4-D7 on a table with one row per key and a ``country`` column."""
    merged = keyword_continent(gazetteer_continent(d))
    continent = (
        F.when(F.col("country").isNull(), F.lit(UNKNOWN_LABEL))
        .when(F.col("gaz_continent").isNotNull(), F.col("gaz_continent"))
        .when(F.col("kw_continent").isNotNull(), F.col("kw_continent"))
        .when(is_ocean(F.col("country")), F.lit(OCEAN_LABEL))
        .otherwise(F.lit(UNKNOWN_LABEL))
    )
    return merged.select(*d.columns, continent.alias("continent"))


def continent_lookup(countries: DataFrame) -> DataFrame:
    """One row per distinct country -> continent."""
    return _resolve(distinct_countries(countries))


def country_lookup(extracted: DataFrame) -> DataFrame:
    """C5 + D3-D7 per distinct extracted text: (country_raw, country, continent).

    The 27 rewrite patterns and the keyword / gazetteer matching then run once
    per distinct text instead of once per row.
    """
    d = extracted.select(F.col("country").alias("country_raw")).distinct()
    return _resolve(d.select("country_raw", apply_rewrites(F.col("country_raw")).alias("country")))


def map_continent(df: DataFrame, lookup: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Attach the continent to every row (null country -> unknown)."""
    lk = lookup.where(F.col("country").isNotNull()).withColumnRenamed("country", "_lk_country")
    joined = lookup_join(df, lk, "country", "_lk_country", max_broadcast_rows)
    return joined.withColumn("continent", F.coalesce(F.col("continent"), F.lit(UNKNOWN_LABEL))).drop("_lk_country")


def map_country(df: DataFrame, lookup: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """C5 + D8 from a ``country_lookup``: rewritten country and continent per row."""
    lk = lookup.where(F.col("country_raw").isNotNull()).select(
        F.col("country_raw").alias("_lk_raw"),
        F.col("country").alias("_lk_country"),
        F.col("continent").alias("_lk_continent"),
    )
    joined = lookup_join(df, lk, "country", "_lk_raw", max_broadcast_rows)
    return joined.withColumns(
        {
            "country": F.when(F.col("_lk_raw").isNotNull(), F.col("_lk_country")).otherwise(F.col("country")),
            "continent": F.coalesce(F.col("_lk_continent"), F.lit(UNKNOWN_LABEL)),
        }
    ).drop("_lk_raw", "_lk_country", "_lk_continent")
