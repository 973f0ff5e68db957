"""raw -> clean -> enrich -> stored EQ table.

Three jobs at any scale:
1. exact medians of seven columns (7 columns read; distributed selection,
   see ``operators.median``),
2. the continent lookup over distinct countries (1 column read, written to
   the shared checkpoint folder, a few hundred rows in practice),
3. the final projection + size-checked broadcast join, written as Parquet
   partitioned by year.
Fact rows are never shuffled before the final write (an input in fewer splits
than cores is first spread round-robin, see ``spread``).
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from quakes.functions.rules import MEDIAN_FILL_COLUMNS
from quakes.operators.clean import clean_unfilled, fill_alert, fill_medians
from quakes.operators.enrich import add_classes, country_lookup, map_country
from quakes.operators.joins import MAX_BROADCAST_ROWS
from quakes.operators.median import exact_medians
from quakes.schema import EQ, EQ_COLUMNS
from quakes.sources.fixture import quake_raw
from quakes.sources.table import materialize, save_table
from quakes.session import apply_conf, files_state, path_exists, table_dir


def enrich(df: DataFrame, *cache_key: str, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """C5 + D1-D8 on a cleaned frame whose ``country`` is the extracted text
    (``clean(..., rewrite=False)``).  The lookup (one row per distinct text)
    is materialised before use so the broadcast decision sees its real size."""
    classed = add_classes(df)
    lookup = materialize(country_lookup(classed.select("country")), *cache_key, "country_lookup")
    return map_country(classed, lookup, max_broadcast_rows).select(*EQ_COLUMNS)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin an input that arrives in fewer splits than there are cores.

    A large input already comes in thousands of splits and passes unchanged;
    a few small or unsplittable files (one Parquet row group, a gzipped page)
    would otherwise run the whole row-wise cleaning in a handful of tasks.
    Projections are pushed below the repartition, so only needed columns move.
    """
    n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def build_eq(raw: DataFrame, *cache_key: str, medians: dict | None = None) -> DataFrame:
    """Lazy EQ frame; the median job and the lookup job run eagerly.

    The two jobs do not depend on each other (the country text needs no
    medians), so they are submitted together from two driver threads and
    their stages share the executors.
    """
    base = clean_unfilled(spread(raw), rewrite=False)
    with ThreadPoolExecutor(max_workers=2) as pool:
        lookup_f = pool.submit(
            lambda: materialize(country_lookup(base.select("country")), *cache_key, "country_lookup")
        )
        medians_f = pool.submit(
            lambda: medians if medians is not None else exact_medians(base, MEDIAN_FILL_COLUMNS, *cache_key)
        )
        lookup, meds = lookup_f.result(), medians_f.result()
    filled = base.transform(fill_medians, meds).transform(fill_alert)
    return map_country(add_classes(filled), lookup).select(*EQ_COLUMNS)


_TABLES: dict[tuple[str, str, str], str] = {}


def eq_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored EQ table for the quake view over ``{sf_dir}/events``.

    Built once per application, data folder and state of its files, written under the shared
    checkpoint folder, then every query reads it (pruned, pushed down).
    """
    apply_conf(spark)
    folder = sf_dir if "://" in sf_dir else os.path.abspath(sf_dir)
    key = (spark.sparkContext.applicationId, folder, files_state(spark, f"{sf_dir}/events.parquet"))
    path = _TABLES.get(key)
    if path is None or not path_exists(spark, path):
        path = table_dir(spark, folder, key[2], "eq_data")
        save_table(build_eq(quake_raw(spark, sf_dir), key[1]), path)
        _TABLES[key] = path
    return spark.read.schema(EQ).parquet(path).select(*EQ_COLUMNS)
