"""The catalogue of named questions over the EQ table (Q1-Q30, Q7.1) and the
query registry (R1) with row numbering (R2).

Every query is ``DataFrame -> DataFrame`` over the stored EQ table, written
with built-in functions only: scans prune to the 2-6 columns a query reads,
filters reach the Parquet reader, aggregates are partial + final, and
``orderBy().limit(k)`` plans as ``TakeOrderedAndProject`` (top-k per task,
no global sort).  Ties on ORDER BY ... LIMIT get an explicit tie-break column
so the answer is deterministic.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakes.functions.classes import alert_loss_weight, casualty_weight, loss_weight
from quakes.functions.rules import ALERT_MISSING
from quakes.operators.exact import exact_avg
from quakes.operators.pairs import consecutive_pairs

def _cnt(alias: str) -> Column:
    return F.count(F.lit(1)).alias(alias)


def _ieq(c: Column, text: str) -> Column:
    """Case-insensitive equality (the catalogue's SQL ran under a _ci collation)."""
    return F.lower(c) == F.lit(text.lower())


def q1_strongest(eq: DataFrame, n: int = 11) -> DataFrame:
    return eq.select("id", "mag", "updated", "country", "type").orderBy(F.desc_nulls_last("mag"), F.asc("id")).limit(n)


def q2_deepest(eq: DataFrame, n: int = 11) -> DataFrame:
    return (
        eq.select("id", "depth_km", "mag", "updated", "country", "type")
        .orderBy(F.desc_nulls_last("depth_km"), F.asc("id"))
        .limit(n)
    )


def q3_shallow_strong(eq: DataFrame, max_depth: float = 50.0, min_mag: float = 7.5) -> DataFrame:
    return eq.where(_ieq(F.col("EQ_type"), "SHALLOW") & (F.col("depth_km") < max_depth) & (F.col("mag") > min_mag)).select(
        "id", "EQ_type", "depth_km", "mag", "updated", "country"
    )


def q4_avg_depth_continent(eq: DataFrame) -> DataFrame:
    return eq.groupBy("continent").agg(F.avg("depth_km").alias("avg_depth")).orderBy(F.desc_nulls_last("avg_depth"))


def q5_avg_mag_magtype(eq: DataFrame) -> DataFrame:
    return eq.groupBy("magtype").agg(F.avg("mag").alias("avg_mag"))


def q6_busiest_year(eq: DataFrame) -> DataFrame:
    return eq.groupBy("year").agg(_cnt("highest_no_of_eq")).orderBy(F.desc("highest_no_of_eq"), F.asc("year")).limit(1)


def q7_busiest_month_year(eq: DataFrame) -> DataFrame:
    return (
        eq.groupBy("month", "year")
        .agg(_cnt("highest_no_of_eq"))
        .orderBy(F.desc("highest_no_of_eq"), F.asc("year"), F.asc("month"))
        .limit(1)
    )


def q7_1_busiest_month(eq: DataFrame) -> DataFrame:
    return eq.groupBy("month").agg(_cnt("highest_no_of_eq")).orderBy(F.desc("highest_no_of_eq"), F.asc("month")).limit(1)


def q8_busiest_weekday(eq: DataFrame) -> DataFrame:
    return (
        eq.groupBy("day_of_week")
        .agg(_cnt("highest_no_of_eq"))
        .orderBy(F.desc("highest_no_of_eq"), F.asc("day_of_week"))
        .limit(1)
    )


def q9_per_hour(eq: DataFrame) -> DataFrame:
    return eq.groupBy("hour").agg(_cnt("no_of_eq_per_hour")).orderBy("hour")


def q10_networks(eq: DataFrame) -> DataFrame:
    return eq.groupBy("net").agg(_cnt("most_active_reporting_network")).orderBy(F.desc("most_active_reporting_network"))


def q11_casualties(eq: DataFrame, n: int = 5) -> DataFrame:
    return (
        eq.groupBy("country")
        .agg(F.sum(casualty_weight(F.col("EQ_intensity"))).cast("bigint").alias("estimated_casualities"))
        .orderBy(F.desc("estimated_casualities"), F.asc_nulls_first("country"))
        .limit(n)
    )


def q12_loss_continent(eq: DataFrame) -> DataFrame:
    return (
        eq.groupBy("continent")
        .agg(F.sum(loss_weight(F.col("EQ_intensity"))).cast("bigint").alias("estimated_loss"))
        .orderBy(F.desc("estimated_loss"))
    )


def q13_loss_alert(eq: DataFrame) -> DataFrame:
    return (
        eq.where(F.col("alert") != ALERT_MISSING)
        .groupBy("alert")
        .agg(F.avg(alert_loss_weight(F.col("alert"))).alias("avg_loss"))
        .orderBy(F.desc("alert"))
    )


def q14_status(eq: DataFrame) -> DataFrame:
    return eq.groupBy("status").agg(_cnt("count")).orderBy(F.desc("count"))


def q15_type(eq: DataFrame) -> DataFrame:
    return eq.groupBy("type").agg(_cnt("total_no_of_earthquakes")).orderBy(F.desc("total_no_of_earthquakes"))


def q16_types(eq: DataFrame) -> DataFrame:
    return eq.groupBy("types").agg(_cnt("total_no_of_earthquakes")).orderBy(F.desc("total_no_of_earthquakes"))


def q17_rms_gap_continent(eq: DataFrame) -> DataFrame:
    return (
        eq.groupBy("continent")
        .agg(F.avg("rms").alias("avg_rms"), F.avg("gap").alias("avg_gap"))
        .orderBy(F.asc_nulls_first("continent"))
    )


def q18_station_coverage(eq: DataFrame, threshold: float = 10) -> DataFrame:
    return eq.where(F.col("nst") > threshold).groupBy("nst").agg(_cnt("total_events")).orderBy(F.desc("total_events"))


def q19_tsunamis_year(eq: DataFrame) -> DataFrame:
    return eq.where(F.col("tsunami") == 1).groupBy("year").agg(_cnt("tsunami_count")).orderBy(F.desc("tsunami_count"))


def q20_alerts(eq: DataFrame) -> DataFrame:
    return eq.groupBy("alert").agg(_cnt("total_no_of_earthquakes")).orderBy(F.desc("total_no_of_earthquakes"))


def q21_top_avg_mag(eq: DataFrame, n: int = 5) -> DataFrame:
    return (
        eq.groupBy("country")
        .agg(exact_avg("mag").alias("avg_mag"))
        .orderBy(F.desc_nulls_last("avg_mag"), F.asc_nulls_first("country"))
        .limit(n)
    )


def q22_shallow_and_deep(eq: DataFrame, distinct_count: bool = False) -> DataFrame:
    # HAVING count(DISTINCT EQ_type) = 2 over rows filtered to two values is
    # "both values present": one partial+final aggregate.  The literal
    # distinct count (G5, ``distinct_count=True``) plans a second shuffle on
    # (group, EQ_type); both give the same rows.
    rows = eq.where(F.col("EQ_type").isin("Shallow", "Deep")).groupBy("month", "year", "country")
    if distinct_count:
        grouped = rows.agg(F.count_distinct("EQ_type").alias("_n")).where(F.col("_n") == 2)
    else:
        grouped = rows.agg(
            F.bool_or(F.col("EQ_type") == "Shallow").alias("_s"),
            F.bool_or(F.col("EQ_type") == "Deep").alias("_d"),
        ).where(F.col("_s") & F.col("_d"))
    return grouped.select("country", "month", "year").orderBy("year")


def q23_yoy_growth(eq: DataFrame) -> DataFrame:
    # The window runs on the per-year counts (one row per year), not on events.
    per_year = eq.groupBy("year").agg(_cnt("count"))
    prev = F.lag("count").over(Window.orderBy("year"))
    return (
        per_year.withColumn("prev_year_count", prev)
        .withColumn(
            "growth_rate",
            F.try_divide((F.col("count") - F.col("prev_year_count")).cast("double"), F.col("prev_year_count")) * 100,
        )
        .orderBy("year")
    )


def q24_active_regions(eq: DataFrame, n: int = 3) -> DataFrame:
    return (
        eq.groupBy("country")
        .agg(_cnt("count"), exact_avg("mag").alias("avg_mag"))
        .withColumn("seismic_activity", F.col("count") * F.col("avg_mag"))
        .orderBy(F.desc_nulls_last("seismic_activity"), F.asc_nulls_first("country"))
        .limit(n)
    )


def q25_equator_depth(eq: DataFrame, half_width: float = 5.0) -> DataFrame:
    return (
        eq.where(F.col("latitude").between(-half_width, half_width))
        .groupBy("country")
        .agg(F.avg("depth_km").alias("avg_depth"), F.avg("latitude").alias("avg_latitude"))
        .orderBy("avg_latitude")
    )


def q26_shallow_deep_ratio(eq: DataFrame, n: int = 10) -> DataFrame:
    return (
        eq.groupBy("country")
        .agg(
            F.count_if(F.col("EQ_type") == "Shallow").alias("shallow_count"),
            F.count_if(F.col("EQ_type") == "Deep").alias("deep_count"),
        )
        .withColumn("ratio", F.try_divide(F.col("shallow_count").cast("double"), F.col("deep_count")))
        .orderBy(F.desc_nulls_last("ratio"), F.asc_nulls_first("country"))
        .limit(n)
    )


def q27_tsunami_mag(eq: DataFrame) -> DataFrame:
    t = F.avg(F.when(F.col("tsunami") == 1, F.col("mag")))
    nt = F.avg(F.when(F.col("tsunami") == 0, F.col("mag")))
    return eq.agg(t.alias("avg_mag_tsunami"), nt.alias("avg_mag_no_tsunami"), (t - nt).alias("magnitude_difference"))


def q28_least_reliable(eq: DataFrame, n: int = 10) -> DataFrame:
    return (
        eq.select("id", "country", "updated", (F.col("gap") + F.col("rms")).alias("reliability_score"))
        .orderBy(F.desc_nulls_last("reliability_score"), F.asc("id"))
        .limit(n)
    )


def q29_consecutive_pairs(eq: DataFrame, max_km: float = 50.0, max_seconds: float = 3600.0) -> DataFrame:
    return consecutive_pairs(eq, max_km=max_km, max_seconds=max_seconds)


def q30_deep_focus(eq: DataFrame, n: int = 10, min_depth: float = 300.0) -> DataFrame:
    return (
        eq.where(F.col("depth_km") > min_depth)
        .groupBy("country")
        .agg(_cnt("no_of_highest_frequency_deep_focus_eq"))
        .orderBy(F.desc("no_of_highest_frequency_deep_focus_eq"), F.asc_nulls_first("country"))
        .limit(n)
    )


@dataclass(frozen=True)
class NamedQuery:
    key: str
    label: str
    fn: Callable[[DataFrame], DataFrame]
    bounded: bool  # result size independent of the data volume


# Ordered registry, label -> query.
CATALOG: list[NamedQuery] = [
    NamedQuery("q1", "1. Top 10 strongest earthquakes (mag)", q1_strongest, True),
    NamedQuery("q2", "2. Top 10 deepest earthquakes (depth_km)", q2_deepest, True),
    NamedQuery("q3", "3. Shallow earthquakes < 50 km and mag > 7.5", q3_shallow_strong, False),
    NamedQuery("q4", "4. Average depth per continent", q4_avg_depth_continent, True),
    NamedQuery("q5", "5. Average magnitude per magnitude type", q5_avg_mag_magtype, True),
    NamedQuery("q6", "6. Year with most earthquakes", q6_busiest_year, True),
    NamedQuery("q7", "7. Month with highest number of earthquakes", q7_busiest_month_year, True),
    NamedQuery("q7_1", "7.1. Month with highest number of earthquakes over all years", q7_1_busiest_month, True),
    NamedQuery("q8", "8. Day of week with most earthquakes", q8_busiest_weekday, True),
    NamedQuery("q9", "9. Count of earthquakes per hour of day", q9_per_hour, True),
    NamedQuery("q10", "10. Most active reporting network", q10_networks, True),
    NamedQuery("q11", "11. Top 5 places with highest estimated casualties", q11_casualties, True),
    NamedQuery("q12", "12. Total estimated economic loss per continent", q12_loss_continent, True),
    NamedQuery("q13", "13. Average economic loss by alert level", q13_loss_alert, True),
    NamedQuery("q14", "14. Count of reviewed vs automatic earthquakes", q14_status, True),
    NamedQuery("q15", "15. Count by earthquake type", q15_type, True),
    NamedQuery("q16", "16. Number of earthquakes by data types", q16_types, False),
    NamedQuery("q17", "17. Average RMS and gap per continent", q17_rms_gap_continent, True),
    NamedQuery("q18", "18. Events with high station coverage (nst > threshold)", q18_station_coverage, False),
    NamedQuery("q19", "19. Number of tsunamis per year", q19_tsunamis_year, True),
    NamedQuery("q20", "20. Count of earthquakes by alert level", q20_alerts, True),
    NamedQuery("q21", "21. Top 5 countries by average magnitude", q21_top_avg_mag, True),
    NamedQuery("q22", "22. Countries with shallow and deep earthquakes in the same month", q22_shallow_and_deep, False),
    NamedQuery("q23", "23. Year-over-year growth of earthquake counts", q23_yoy_growth, True),
    NamedQuery("q24", "24. Top 3 seismically active regions (count x average magnitude)", q24_active_regions, True),
    NamedQuery("q25", "25. Average depth per country within 5 degrees of the equator", q25_equator_depth, False),
    NamedQuery("q26", "26. Countries with the highest shallow : deep ratio", q26_shallow_deep_ratio, True),
    NamedQuery("q27", "27. Average magnitude, tsunami vs non-tsunami", q27_tsunami_mag, True),
    NamedQuery("q28", "28. Events with the lowest data reliability (gap + rms)", q28_least_reliable, True),
    NamedQuery("q29", "29. Consecutive earthquakes within 50 km and 1 hour", q29_consecutive_pairs, False),
    NamedQuery("q30", "30. Regions with most deep-focus earthquakes (depth > 300 km)", q30_deep_focus, True),
]

BY_KEY = {q.key: q for q in CATALOG}
BY_LABEL = {q.label: q for q in CATALOG}


def numbered(result: DataFrame, *order: Column | str, name: str = "S_No") -> DataFrame:
    """R2: 1-based serial number in result order, as the first column.

    Use on bounded results (top-k, per-group aggregates): the window has no
    partition key, so it runs in one task.  ``operators.serial.serial_numbers``
    numbers results of any size.
    """
    w = Window.orderBy(*order)
    return result.select(F.row_number().over(w).alias(name), *result.columns)


def run(eq: DataFrame, key_or_label: str) -> DataFrame:
    """Pick a query by key or label and run it on the EQ table."""
    q = BY_KEY.get(key_or_label) or BY_LABEL[key_or_label]
    return q.fn(eq)
