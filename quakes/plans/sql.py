"""The catalogue as Spark SQL text over the view ``eq_data``.

For users who keep their questions as SQL strings: register the stored table
as ``eq_data`` and run ``spark.sql(SQL[key])``.  Catalyst plans these exactly
like the DataFrame versions in ``catalog.py`` (same pruning, pushdown,
partial aggregation, TakeOrderedAndProject); the two forms are checked
against each other in the tests.  Q29 needs the scalable neighbour operator
(``operators.pairs``); its SQL form would be a global window, so it is not
offered here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quakes.functions.rules import ALERT_LOSS_WEIGHTS, ALERT_MISSING, CASUALTY_WEIGHTS, LOSS_WEIGHTS

VIEW = "eq_data"
# Of exact sums, so that ranks do not depend on the order of rows.
EXACT_AVG_MAG = "try_divide(CAST(sum(CAST(mag AS DECIMAL(28,9))) AS DOUBLE), CAST(count(mag) AS DOUBLE))"


def _case(col: str, weights: dict[str, int]) -> str:
    arms = " ".join(f"WHEN {col} = '{k}' THEN {w}" for k, w in weights.items())
    return f"CASE {arms} ELSE 0 END"


SQL: dict[str, str] = {
    "q1": f"SELECT id, mag, updated, country, type FROM {VIEW} ORDER BY mag DESC NULLS LAST, id LIMIT 11",
    "q2": f"SELECT id, depth_km, mag, updated, country, type FROM {VIEW} ORDER BY depth_km DESC NULLS LAST, id LIMIT 11",
    "q3": f"SELECT id, EQ_type, depth_km, mag, updated, country FROM {VIEW} "
    "WHERE lower(EQ_type) = 'shallow' AND depth_km < 50 AND mag > 7.5",
    "q4": f"SELECT continent, avg(depth_km) AS avg_depth FROM {VIEW} GROUP BY continent ORDER BY avg_depth DESC NULLS LAST",
    "q5": f"SELECT magtype, avg(mag) AS avg_mag FROM {VIEW} GROUP BY magtype",
    "q6": f"SELECT year, count(*) AS highest_no_of_eq FROM {VIEW} GROUP BY year ORDER BY highest_no_of_eq DESC, year LIMIT 1",
    "q7": f"SELECT month, year, count(*) AS highest_no_of_eq FROM {VIEW} GROUP BY month, year "
    "ORDER BY highest_no_of_eq DESC, year, month LIMIT 1",
    "q7_1": f"SELECT month, count(*) AS highest_no_of_eq FROM {VIEW} GROUP BY month "
    "ORDER BY highest_no_of_eq DESC, month LIMIT 1",
    "q8": f"SELECT day_of_week, count(*) AS highest_no_of_eq FROM {VIEW} GROUP BY day_of_week "
    "ORDER BY highest_no_of_eq DESC, day_of_week LIMIT 1",
    "q9": f"SELECT hour, count(*) AS no_of_eq_per_hour FROM {VIEW} GROUP BY hour ORDER BY hour",
    "q10": f"SELECT net, count(*) AS most_active_reporting_network FROM {VIEW} GROUP BY net "
    "ORDER BY most_active_reporting_network DESC",
    "q11": f"SELECT country, CAST(sum({_case('EQ_intensity', CASUALTY_WEIGHTS)}) AS BIGINT) AS estimated_casualities "
    f"FROM {VIEW} GROUP BY country ORDER BY estimated_casualities DESC, country ASC NULLS FIRST LIMIT 5",
    "q12": f"SELECT continent, CAST(sum({_case('EQ_intensity', LOSS_WEIGHTS)}) AS BIGINT) AS estimated_loss "
    f"FROM {VIEW} GROUP BY continent ORDER BY estimated_loss DESC",
    "q13": f"SELECT alert, avg({_case('alert', ALERT_LOSS_WEIGHTS)}) AS avg_loss FROM {VIEW} "
    f"WHERE alert != '{ALERT_MISSING}' GROUP BY alert ORDER BY alert DESC",
    "q14": f"SELECT status, count(*) AS count FROM {VIEW} GROUP BY status ORDER BY count DESC",
    "q15": f"SELECT type, count(*) AS total_no_of_earthquakes FROM {VIEW} GROUP BY type ORDER BY total_no_of_earthquakes DESC",
    "q16": f"SELECT types, count(*) AS total_no_of_earthquakes FROM {VIEW} GROUP BY types "
    "ORDER BY total_no_of_earthquakes DESC",
    "q17": f"SELECT continent, avg(rms) AS avg_rms, avg(gap) AS avg_gap FROM {VIEW} GROUP BY continent "
    "ORDER BY continent ASC NULLS FIRST",
    "q18": f"SELECT nst, count(*) AS total_events FROM {VIEW} WHERE nst > 10 GROUP BY nst ORDER BY total_events DESC",
    "q19": f"SELECT year, count(*) AS tsunami_count FROM {VIEW} WHERE tsunami = 1 GROUP BY year ORDER BY tsunami_count DESC",
    "q20": f"SELECT alert, count(*) AS total_no_of_earthquakes FROM {VIEW} GROUP BY alert "
    "ORDER BY total_no_of_earthquakes DESC",
    "q21": f"SELECT country, {EXACT_AVG_MAG} AS avg_mag FROM {VIEW} GROUP BY country "
    "ORDER BY avg_mag DESC NULLS LAST, country ASC NULLS FIRST LIMIT 5",
    "q22": f"SELECT country, month, year FROM {VIEW} WHERE EQ_type IN ('Shallow', 'Deep') "
    "GROUP BY month, year, country HAVING bool_or(EQ_type = 'Shallow') AND bool_or(EQ_type = 'Deep') ORDER BY year",
    "q23": f"""SELECT year, count, prev_year_count,
  try_divide(CAST(count - prev_year_count AS DOUBLE), prev_year_count) * 100 AS growth_rate
FROM (SELECT year, count(*) AS count, lag(count(*)) OVER (ORDER BY year) AS prev_year_count FROM {VIEW} GROUP BY year)
ORDER BY year""",
    "q24": f"""SELECT country, count, avg_mag, count * avg_mag AS seismic_activity
FROM (SELECT country, count(*) AS count, {EXACT_AVG_MAG} AS avg_mag FROM {VIEW} GROUP BY country)
ORDER BY seismic_activity DESC NULLS LAST, country ASC NULLS FIRST LIMIT 3""",
    "q25": f"SELECT country, avg(depth_km) AS avg_depth, avg(latitude) AS avg_latitude FROM {VIEW} "
    "WHERE latitude BETWEEN -5 AND 5 GROUP BY country ORDER BY avg_latitude",
    "q26": f"""SELECT country, shallow_count, deep_count, try_divide(CAST(shallow_count AS DOUBLE), deep_count) AS ratio
FROM (SELECT country, count_if(EQ_type = 'Shallow') AS shallow_count, count_if(EQ_type = 'Deep') AS deep_count
      FROM {VIEW} GROUP BY country)
ORDER BY ratio DESC NULLS LAST, country ASC NULLS FIRST LIMIT 10""",
    "q27": f"""SELECT avg(CASE WHEN tsunami = 1 THEN mag END) AS avg_mag_tsunami,
  avg(CASE WHEN tsunami = 0 THEN mag END) AS avg_mag_no_tsunami,
  avg(CASE WHEN tsunami = 1 THEN mag END) - avg(CASE WHEN tsunami = 0 THEN mag END) AS magnitude_difference
FROM {VIEW}""",
    "q28": f"SELECT id, country, updated, gap + rms AS reliability_score FROM {VIEW} "
    "ORDER BY reliability_score DESC NULLS LAST, id LIMIT 10",
    "q30": f"SELECT country, count(*) AS no_of_highest_frequency_deep_focus_eq FROM {VIEW} WHERE depth_km > 300 "
    "GROUP BY country ORDER BY no_of_highest_frequency_deep_focus_eq DESC, country ASC NULLS FIRST LIMIT 10",
}


def run_sql(spark: SparkSession, eq: DataFrame, key: str) -> DataFrame:
    """Register ``eq`` as the view and run one catalogue question as SQL."""
    eq.createOrReplaceTempView(VIEW)
    return spark.sql(SQL[key])
