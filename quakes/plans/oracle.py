"""DuckDB SQL for the correctness gate.

For every registered query this builds one SQL statement that DuckDB runs on
the driver's tables: quake view over ``events`` -> cleaning -> enrichment ->
the question.  The rule tables are spliced in as VALUES lists from the same
Python data the Spark code uses; the logic is written independently in SQL
(global window for the pairs, row_number for best matches, etc.).
Double columns are rounded to ``DIGITS`` on both sides.
"""

from __future__ import annotations

from quakes.functions.gazetteer import EXACT_POINTS, PARTIAL_FLOOR, PARTIAL_TOP, gazetteer_rows
from quakes.functions.rules import (
    ALERT_LOSS_WEIGHTS,
    ALERT_MISSING,
    CASUALTY_WEIGHTS,
    COUNTRY_REWRITES,
    LOSS_WEIGHTS,
    OCEAN_WORDS,
    keyword_rows,
)
from quakes.functions.text import ACCENTED, LAST_PART_PATTERN, STRIP_PATTERN, UNACCENTED
from quakes.sources.fixture import LITERAL_PLACES, MAGTYPES, NETS, TOWN_REGIONS, TYPES

DIGITS = 6


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def _case(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


def _weights(col: str, weights: dict[str, int]) -> str:
    arms = " ".join(f"WHEN {col} = {lit(k)} THEN {w}" for k, w in weights.items())
    return f"CASE {arms} ELSE 0 END"


def _rewrites(expr: str) -> str:
    for pattern, repl in COUNTRY_REWRITES:
        expr = f"regexp_replace({expr}, {lit(pattern)}, {lit(repl)})"
    return expr


def _values(rows, cols: str, name: str) -> str:
    body = ",\n    ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({cols}) AS (SELECT * FROM (VALUES\n    {body}) AS t({cols}))"


def base_ctes() -> str:
    """WITH-list ending in ``eq`` (the 35-column EQ table)."""
    net = _case("u % 5", NETS)
    town = _case("p", TOWN_REGIONS)
    lit_place = _case("p - 12", LITERAL_PLACES)
    ocean = " OR ".join(f"strpos(lower(c.country), {lit(w)}) > 0" for w in OCEAN_WORDS)
    lc = f"translate(lower(c.country), {lit(ACCENTED)}, {lit(UNACCENTED)})"
    exact = f"({lc} = g.g_code2 OR {lc} = g.g_code3 OR {lc} = g.g_name OR {lc} = g.g_official OR {lc} = g.g_common)"
    npos = f"strpos(g.g_name, {lc})"
    opos = f"strpos(g.g_official, {lc})"

    def pp(pos: str) -> str:
        return f"greatest({PARTIAL_FLOOR}, {PARTIAL_TOP} - 2 * ({pos} - 1))"

    points = (
        f"(CASE WHEN {exact} THEN {EXACT_POINTS} ELSE 0 END + "
        f"CASE WHEN {npos} > 0 THEN {pp(npos)} WHEN {opos} > 0 THEN {pp(opos)} ELSE 0 END)"
    )
    gaz = _values(
        gazetteer_rows(), "g_ord, g_alpha2, g_code2, g_code3, g_name, g_official, g_common, g_continent", "gaz"
    )
    kw = _values(keyword_rows(), "k_ord, k_keyword, k_continent, k_prio", "kw")
    fill = ["mmi", "rms", "dmin", "gap", "nst", "cdi", "felt"]
    return f"""WITH
ev AS (
  SELECT event_id AS e, user_id AS u, value AS v, CAST(ts AS TIMESTAMP) AS ts, event_type,
         CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k, user_id % 25 AS p
  FROM events
),
ev2 AS (
  SELECT *, {net} AS net, ts - to_days(CAST(((k * 7 + u) % 72) * 30 AS INTEGER)) AS qtime FROM ev
),
quake AS (
  SELECT
    net || CAST(e AS VARCHAR) AS id,
    qtime AS time,
    qtime + INTERVAL 1 DAY AS updated,
    CASE WHEN e % 211 = 0 THEN NULL ELSE (p * 13 % 121) - 60 + CAST(k - 50 AS DOUBLE) / 250 END AS latitude,
    CASE WHEN e % 211 = 0 THEN NULL ELSE (p * 47 % 360) - 180 + CAST(u % 7 - 3 AS DOUBLE) / 20 END AS longitude,
    CASE WHEN e % 97 = 0 THEN NULL ELSE (e * 37 % 700) + CAST(k AS DOUBLE) / 100 END AS depth_km,
    CASE WHEN e % 499 = 0 THEN NULL
         ELSE 3 + floor(least(v, CAST(245 AS DOUBLE)) / CAST(4.9 AS DOUBLE)) / CAST(10 AS DOUBLE) END AS mag,
    {_case("u % 4", MAGTYPES)} AS magtype,
    CASE WHEN p < 12 THEN CAST(k AS VARCHAR) || ' km NE of Town ' || CAST(u AS VARCHAR) || ', ' || {town}
         ELSE {lit_place} END AS place,
    CASE WHEN event_type = 'error' THEN 'automatic' ELSE 'reviewed' END AS status,
    CAST(CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS INTEGER) AS tsunami,
    CASE WHEN k < 10 THEN 'green' WHEN k < 14 THEN 'Yellow' WHEN k < 16 THEN 'orange' WHEN k = 16 THEN 'red' END AS alert,
    CASE WHEN k % 4 = 0 THEN e % 500 END AS felt,
    CASE WHEN k % 4 = 0 THEN CAST(e % 80 AS DOUBLE) / 10 END AS cdi,
    CASE WHEN k % 12 = 0 THEN NULL ELSE CAST(e % 60 AS DOUBLE) / 10 END AS mmi,
    e % 1000 AS sig,
    net,
    CAST(e AS VARCHAR) AS code,
    ',' || net || CAST(e AS VARCHAR) || ',' AS ids,
    ',' || net || ',' AS sources,
    {_case("k % 3", TYPES)} AS types,
    CASE WHEN e % 4 = 1 THEN NULL ELSE e % 200 END AS nst,
    CASE WHEN e % 28 = 0 THEN NULL ELSE CAST(e % 1000 AS DOUBLE) / 100 END AS dmin,
    CASE WHEN e % 101 = 0 THEN NULL ELSE CAST(e * 7 % 150 AS DOUBLE) / 100 END AS rms,
    CASE WHEN e % 37 = 0 THEN NULL ELSE CAST(e % 360 AS DOUBLE) END AS gap,
    CASE WHEN k = 99 THEN 'volcanic eruption' WHEN k = 98 THEN 'landslide' ELSE 'earthquake' END AS type,
    CAST(NULL AS DOUBLE) AS magerror, CAST(NULL AS BIGINT) AS magnst, CAST(NULL AS DOUBLE) AS deptherror
  FROM ev2
),
stripped AS (
  SELECT * REPLACE (regexp_replace(place, {lit(STRIP_PATTERN)}, '', 'g') AS place) FROM quake
),
clean0 AS (
  SELECT id, time, updated, latitude, longitude,
    CAST(depth_km AS DOUBLE) AS depth_km, CAST(mag AS DOUBLE) AS mag, magtype, place, status, tsunami,
    lower(alert) AS alert,
    CAST(felt AS DOUBLE) AS felt, CAST(cdi AS DOUBLE) AS cdi, CAST(mmi AS DOUBLE) AS mmi, CAST(sig AS DOUBLE) AS sig,
    net, code, ids, sources, types,
    CAST(nst AS DOUBLE) AS nst, CAST(dmin AS DOUBLE) AS dmin, CAST(rms AS DOUBLE) AS rms, CAST(gap AS DOUBLE) AS gap,
    type,
    CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month, CAST(day(time) AS INTEGER) AS day,
    dayname(time) AS day_of_week, CAST(hour(time) AS INTEGER) AS hour,
    {_rewrites(f"coalesce(nullif(regexp_extract(place, {lit(LAST_PART_PATTERN)}, 1), ''), place)")} AS country
  FROM stripped
),
med AS (
  SELECT {", ".join(f"median({c}) AS m_{c}" for c in fill)} FROM clean0
),
clean AS (
  SELECT c.* REPLACE ({", ".join(f"coalesce(c.{x}, med.m_{x}) AS {x}" for x in fill)},
                      coalesce(c.alert, {lit(ALERT_MISSING)}) AS alert)
  FROM clean0 c CROSS JOIN med
),
{gaz},
{kw},
ctry AS (SELECT DISTINCT country FROM clean),
gm AS (
  SELECT country, g_continent AS gaz_continent FROM (
    SELECT c.country, g.g_continent,
           row_number() OVER (PARTITION BY c.country ORDER BY {points} DESC, g.g_ord ASC) AS rn
    FROM ctry c JOIN gaz g
      ON {lc} <> '' AND ({exact} OR {npos} > 0 OR coalesce({opos}, 0) > 0)
  ) WHERE rn = 1
),
km AS (
  SELECT country, k_continent AS kw_continent FROM (
    SELECT c.country, k.k_continent, row_number() OVER (PARTITION BY c.country ORDER BY k.k_prio) AS rn
    FROM ctry c JOIN kw k ON strpos(lower(c.country), k.k_keyword) > 0
  ) WHERE rn = 1
),
lookup AS (
  SELECT c.country,
    CASE WHEN c.country IS NULL THEN 'unknown'
         WHEN gm.gaz_continent IS NOT NULL THEN gm.gaz_continent
         WHEN km.kw_continent IS NOT NULL THEN km.kw_continent
         WHEN {ocean} THEN 'Ocean/Other'
         ELSE 'unknown' END AS continent
  FROM ctry c LEFT JOIN gm ON c.country = gm.country LEFT JOIN km ON c.country = km.country
),
eq AS (
  SELECT cl.*,
    CASE WHEN cl.depth_km < 70 THEN 'Shallow' WHEN cl.depth_km < 300 THEN 'Intermediate' ELSE 'Deep' END AS EQ_type,
    CASE WHEN cl.mag < 4 THEN 'Minor' WHEN cl.mag < 5 THEN 'Light' WHEN cl.mag < 6 THEN 'Moderate'
         WHEN cl.mag < 7 THEN 'Strong' ELSE 'Destructive' END AS EQ_intensity,
    coalesce(l.continent, 'unknown') AS continent
  FROM clean cl LEFT JOIN lookup l ON cl.country = l.country
)"""


def r(expr: str) -> str:
    return f"round({expr}, {DIGITS})"


# Of exact sums, so that ranks do not depend on the order of rows.
EXACT_AVG_MAG = "(CAST(sum(CAST(mag AS DECIMAL(28, 9))) AS DOUBLE) / nullif(count(mag), 0))"

_HAVERSINE = (
    "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(prev_lat)) / 2), 2) + "
    "cos(radians(prev_lat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(prev_lon)) / 2), 2))))"
)

# Final SELECT of each query over ``eq`` (after base_ctes()).
QUERY_SQL: dict[str, str] = {
    "q1": f"SELECT id, {r('mag')} AS mag, updated, country, type FROM eq ORDER BY mag DESC NULLS LAST, id LIMIT 11",
    "q2": f"SELECT id, {r('depth_km')} AS depth_km, {r('mag')} AS mag, updated, country, type FROM eq "
    "ORDER BY depth_km DESC NULLS LAST, id LIMIT 11",
    "q3": f"SELECT id, EQ_type, {r('depth_km')} AS depth_km, {r('mag')} AS mag, updated, country FROM eq "
    "WHERE lower(EQ_type) = 'shallow' AND depth_km < 50 AND mag > 7.5",
    "q4": f"SELECT continent, {r('avg(depth_km)')} AS avg_depth FROM eq GROUP BY continent",
    "q5": f"SELECT magtype, {r('avg(mag)')} AS avg_mag FROM eq GROUP BY magtype",
    "q6": "SELECT year, count(*) AS highest_no_of_eq FROM eq GROUP BY year ORDER BY highest_no_of_eq DESC, year LIMIT 1",
    "q7": "SELECT month, year, count(*) AS highest_no_of_eq FROM eq GROUP BY month, year "
    "ORDER BY highest_no_of_eq DESC, year, month LIMIT 1",
    "q7_1": "SELECT month, count(*) AS highest_no_of_eq FROM eq GROUP BY month ORDER BY highest_no_of_eq DESC, month LIMIT 1",
    "q8": "SELECT day_of_week, count(*) AS highest_no_of_eq FROM eq GROUP BY day_of_week "
    "ORDER BY highest_no_of_eq DESC, day_of_week LIMIT 1",
    "q9": "SELECT hour, count(*) AS no_of_eq_per_hour FROM eq GROUP BY hour ORDER BY hour",
    "q10": "SELECT net, count(*) AS most_active_reporting_network FROM eq GROUP BY net",
    "q11": f"SELECT country, CAST(sum({_weights('EQ_intensity', CASUALTY_WEIGHTS)}) AS BIGINT) AS estimated_casualities "
    "FROM eq GROUP BY country ORDER BY estimated_casualities DESC, country ASC NULLS FIRST LIMIT 5",
    "q12": f"SELECT continent, CAST(sum({_weights('EQ_intensity', LOSS_WEIGHTS)}) AS BIGINT) AS estimated_loss "
    "FROM eq GROUP BY continent",
    "q13": f"SELECT alert, {r('avg(' + _weights('alert', ALERT_LOSS_WEIGHTS) + ')')} AS avg_loss FROM eq "
    f"WHERE alert <> {lit(ALERT_MISSING)} GROUP BY alert",
    "q14": "SELECT status, count(*) AS count FROM eq GROUP BY status",
    "q15": "SELECT type, count(*) AS total_no_of_earthquakes FROM eq GROUP BY type",
    "q16": "SELECT types, count(*) AS total_no_of_earthquakes FROM eq GROUP BY types",
    "q17": f"SELECT continent, {r('avg(rms)')} AS avg_rms, {r('avg(gap)')} AS avg_gap FROM eq GROUP BY continent",
    "q18": f"SELECT {r('nst')} AS nst, count(*) AS total_events FROM eq WHERE nst > 10 GROUP BY nst",
    "q19": "SELECT year, count(*) AS tsunami_count FROM eq WHERE tsunami = 1 GROUP BY year",
    "q20": "SELECT alert, count(*) AS total_no_of_earthquakes FROM eq GROUP BY alert",
    "q21": f"SELECT country, {r('avg_mag')} AS avg_mag FROM (SELECT country, {EXACT_AVG_MAG} AS avg_mag FROM eq GROUP BY country) "
    "ORDER BY avg_mag DESC NULLS LAST, country ASC NULLS FIRST LIMIT 5",
    "q22": "SELECT country, month, year FROM eq WHERE EQ_type IN ('Shallow', 'Deep') GROUP BY month, year, country "
    "HAVING count(DISTINCT EQ_type) = 2",
    "q23": f"""SELECT year, count, prev_year_count,
  {r('CAST(count - prev_year_count AS DOUBLE) / nullif(prev_year_count, 0) * 100')} AS growth_rate
FROM (SELECT year, count(*) AS count, lag(count(*)) OVER (ORDER BY year) AS prev_year_count FROM eq GROUP BY year)""",
    "q24": f"""SELECT country, count, {r('avg_mag')} AS avg_mag, {r('seismic_activity')} AS seismic_activity FROM (
  SELECT country, count(*) AS count, {EXACT_AVG_MAG} AS avg_mag, count(*) * {EXACT_AVG_MAG} AS seismic_activity FROM eq GROUP BY country)
ORDER BY seismic_activity DESC NULLS LAST, country ASC NULLS FIRST LIMIT 3""",
    "q25": f"SELECT country, {r('avg(depth_km)')} AS avg_depth, {r('avg(latitude)')} AS avg_latitude FROM eq "
    "WHERE latitude BETWEEN -5 AND 5 GROUP BY country",
    "q26": f"""SELECT country, shallow_count, deep_count, {r('ratio')} AS ratio FROM (
  SELECT country, shallow_count, deep_count, CAST(shallow_count AS DOUBLE) / nullif(deep_count, 0) AS ratio FROM (
    SELECT country, count(*) FILTER (WHERE EQ_type = 'Shallow') AS shallow_count,
           count(*) FILTER (WHERE EQ_type = 'Deep') AS deep_count
    FROM eq GROUP BY country))
ORDER BY ratio DESC NULLS LAST, country ASC NULLS FIRST LIMIT 10""",
    "q27": f"""SELECT {r('t')} AS avg_mag_tsunami, {r('nt')} AS avg_mag_no_tsunami, {r('t - nt')} AS magnitude_difference
FROM (SELECT avg(CASE WHEN tsunami = 1 THEN mag END) AS t, avg(CASE WHEN tsunami = 0 THEN mag END) AS nt FROM eq)""",
    "q28": f"SELECT id, country, updated, {r('gap + rms')} AS reliability_score FROM eq "
    "ORDER BY gap + rms DESC NULLS LAST, id LIMIT 10",
    "q29": f"""SELECT prev_id, id, prev_time, time, {r('gap_s')} AS gap_s, {r('distance_km')} AS distance_km FROM (
  SELECT prev_id, id, prev_time, time, (t - prev_t) / 1000000.0 AS gap_s, {_HAVERSINE} AS distance_km FROM (
    SELECT lag(id) OVER w AS prev_id, lag(t) OVER w AS prev_t, lag(time) OVER w AS prev_time,
           lag(lat) OVER w AS prev_lat, lag(lon) OVER w AS prev_lon, id, t, time, lat, lon
    FROM (SELECT id, time, epoch_us(time) AS t, latitude AS lat, longitude AS lon FROM eq WHERE time IS NOT NULL)
    WINDOW w AS (ORDER BY t, id))
  WHERE prev_t IS NOT NULL)
WHERE gap_s <= 3600 AND distance_km <= 50""",
    "q30": "SELECT country, count(*) AS no_of_highest_frequency_deep_focus_eq FROM eq WHERE depth_km > 300 "
    "GROUP BY country ORDER BY no_of_highest_frequency_deep_focus_eq DESC, country ASC NULLS FIRST LIMIT 10",
}


def query_sql(key: str) -> str:
    return base_ctes() + "\n" + QUERY_SQL[key]


# ---- operator-level checks -------------------------------------------------

def _eq_select(cols_types, source: str) -> str:
    parts = []
    for name, is_double in cols_types:
        parts.append(f"{r(name)} AS {name}" if is_double else name)
    return f"SELECT {', '.join(parts)} FROM {source}"


def _eq_cols():
    from pyspark.sql import types as T

    from quakes.schema import EQ

    return [(f.name, isinstance(f.dataType, T.DoubleType)) for f in EQ.fields]


def _raw_cols(ms_times: bool = False):
    from pyspark.sql import types as T

    from quakes.schema import RAW

    out = []
    for f in RAW.fields:
        if ms_times and f.name in ("time", "updated"):
            out.append((f"make_timestamp(epoch_us({f.name}) // 1000 * 1000) AS {f.name}", False))
        else:
            out.append((f.name, isinstance(f.dataType, T.DoubleType)))
    return out


def _long_union(cols: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS col_name, CAST({c} AS DOUBLE) AS value FROM {source} WHERE {c} IS NOT NULL" for c in cols
    )


_PROFILE = ["mmi", "rms", "dmin", "gap", "nst", "cdi", "felt"]


def operator_sql() -> dict[str, str]:
    from quakes.schema import RAW

    null_counts = " UNION ALL ".join(
        f"SELECT '{f.name}' AS col_name, count(*) FILTER (WHERE {f.name} IS NULL) AS null_count FROM quake"
        for f in RAW.fields
    )
    return {
        "eq_table": _eq_select(_eq_cols(), "eq"),
        "s7_csv_roundtrip": _eq_select(_eq_cols(), "eq"),
        "s1_feed_roundtrip": _eq_select(_raw_cols(ms_times=True), "quake"),
        "s2_month_windows": """SELECT CAST(w.ws AS DATE) AS window_start, CAST(w.ws + INTERVAL 1 MONTH AS DATE) AS window_end,
  coalesce(c.events, 0) AS events
FROM (SELECT ws FROM (SELECT min(year(time)) AS s, max(year(time)) AS e FROM quake) yr,
      generate_series(make_date(yr.s, 1, 1), make_date(yr.e, 12, 1), INTERVAL 1 MONTH) AS g(ws)) w
LEFT JOIN (SELECT CAST(date_trunc('month', time) AS DATE) AS ws, count(*) AS events FROM quake WHERE mag >= 3 GROUP BY 1) c
  ON CAST(w.ws AS DATE) = c.ws""",
        "c5_country_rows": "SELECT id, place, country FROM clean0",
        "s3_source_filter": _eq_select(_raw_cols(), "quake")
        + " WHERE time >= TIMESTAMP '2019-01-01' AND time < TIMESTAMP '2023-01-01' AND mag >= 3",
        "stream_ingest": _eq_select(_raw_cols(ms_times=True), "quake").replace(" FROM quake", "")
        + ", CAST(year(make_timestamp(epoch_us(time) // 1000 * 1000)) AS INTEGER) AS year"
        + ", CAST(month(make_timestamp(epoch_us(time) // 1000 * 1000)) AS INTEGER) AS month FROM quake",
        "c8_medians": "SELECT " + ", ".join(f"{r('median(' + c + ')')} AS {c}" for c in _PROFILE) + " FROM clean0",
        "c9_modes": f"""SELECT col_name, {r('value')} AS value, count FROM (
  SELECT col_name, value, count, max(count) OVER (PARTITION BY col_name) AS mx FROM (
    SELECT col_name, value, count(*) AS count FROM ({_long_union(_PROFILE, 'clean0')}) GROUP BY col_name, value))
WHERE count = mx""",
        "c10_alert_counts": "SELECT lower(alert) AS alert, count(*) AS count FROM quake WHERE alert IS NOT NULL GROUP BY 1",
        "c11_null_counts": null_counts,
        "c13_describe": f"""SELECT col_name, count(*) AS count, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std,
  {r('min(value)')} AS min, {r('quantile_cont(value, 0.25)')} AS p25, {r('quantile_cont(value, 0.5)')} AS p50,
  {r('quantile_cont(value, 0.75)')} AS p75, {r('max(value)')} AS max
FROM ({_long_union(_PROFILE, 'clean0')}) GROUP BY col_name""",
        "d_continent_lookup": "SELECT country, continent FROM lookup",
        "r2_numbered_q12": f"""SELECT row_number() OVER (ORDER BY estimated_loss DESC, continent) AS S_No, continent, estimated_loss
FROM (SELECT continent, CAST(sum({_weights('EQ_intensity', LOSS_WEIGHTS)}) AS BIGINT) AS estimated_loss FROM eq GROUP BY continent)""",
        "r2_numbered_q3": f"SELECT row_number() OVER (ORDER BY mag DESC, id) AS S_No, * FROM ({QUERY_SQL['q3']})",
        "r2_numbered_q16": "SELECT row_number() OVER (ORDER BY total_no_of_earthquakes DESC, types ASC NULLS FIRST) AS S_No, * "
        f"FROM ({QUERY_SQL['q16']})",
        "r2_numbered_events": "SELECT row_number() OVER (ORDER BY time ASC NULLS FIRST, id) AS S_No, id, time FROM eq",
        "s1_pages_roundtrip": _eq_select(_raw_cols(ms_times=True), "quake"),
        "s8_managed_table": "SELECT year, count(*) AS events, (SELECT count(*) FROM eq) AS loaded_rows FROM eq GROUP BY year",
        "s2_incremental_load": f"SELECT id, CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month, "
        f"{r('CASE WHEN year(time) = 2021 AND month(time) <= 6 THEN mag - 0.5 ELSE mag END')} AS mag FROM quake "
        "WHERE time >= TIMESTAMP '2020-01-01' AND time < TIMESTAMP '2023-01-01' "
        "AND CASE WHEN year(time) = 2021 AND month(time) <= 6 THEN mag - 0.5 ELSE mag END >= 4",
        "g5_count_distinct": "SELECT month, year, country, count(DISTINCT EQ_type) AS n_types FROM eq GROUP BY month, year, country",
        "p8_clustered_scan": "SELECT id, country, year FROM eq WHERE depth_km > 300 AND mag > 5 "
        "UNION ALL SELECT id, country, year FROM eq WHERE latitude BETWEEN -5 AND 5 AND depth_km < 70",
    }


#: Queries that answer as another one does, by another way.
SAME_ANSWER = {
    "c9_modes_by_summary": "c9_modes",
    "c9_modes_by_month": "c9_modes",
    "c10_alerts_by_month": "c10_alert_counts",
    "c11_nulls_by_month": "c11_null_counts",
    "c13_describe_by_month": "c13_describe",
}


def all_sql() -> dict[str, str]:
    base = base_ctes()
    out = {key: base + "\n" + body for key, body in QUERY_SQL.items()}
    operators = operator_sql()
    operators.update({key: operators[same] for key, same in SAME_ANSWER.items()})
    out.update({key: base + "\n" + body for key, body in operators.items()})
    return out
