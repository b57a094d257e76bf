"""What each query must return, as SQL over the test tables."""

from __future__ import annotations

from ..operators.advice import ADVICE
from ..schema import BASELINE_MEASURES, FEATURES, MEASURES

READINGS = """
core AS (
SELECT l.l_orderkey AS reading_id, l.l_linenumber AS line_no,
 l.l_shipdate + to_hours(CAST(l.l_orderkey % 24 AS INT)) AS datetime, r.r_name AS city,
 l.l_extendedprice / 50 AS components_co, l.l_tax * 500 AS components_no2,
 l.l_discount * 800 AS components_o3, l.l_quantity * 5 AS components_pm2_5,
 l.l_quantity * 6 AS components_pm10, CAST(l.l_suppkey % 40 AS DOUBLE) AS components_so2,
 l.l_discount * 300 + 5 AS temperature_2m,
 CAST(l.l_partkey % 100 AS DOUBLE) AS relative_humidity_2m,
 CAST(l.l_suppkey % 25 AS DOUBLE) AS wind_speed_10m,
 CASE WHEN l.l_linenumber = 7 AND l.l_orderkey % 10 = 0 THEN NULL
      WHEN l.l_partkey % 11 = 0 THEN 1 + CAST(l.l_suppkey % 5 AS INT)
      WHEN l.l_quantity > 30 THEN 5 WHEN l.l_quantity > 20 THEN 4
      WHEN l.l_quantity > 10 THEN 3 WHEN l.l_quantity > 5 THEN 2 ELSE 1 END AS main_aqi
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey),
readings AS (SELECT * FROM core UNION ALL SELECT * FROM core WHERE reading_id % 50 = 0)
"""

CLEAN = """,
clean AS (
SELECT *, CAST(hour(datetime) AS INT) AS hour, CAST(month(datetime) AS INT) AS month,
 CAST(year(datetime) AS INT) AS year
FROM (SELECT DISTINCT * FROM readings WHERE main_aqi IS NOT NULL AND datetime IS NOT NULL))
"""

# Readings as they come back from a raw text file.
PARSED = """,
parsed AS (
SELECT reading_id, line_no, main_aqi,
 CASE WHEN reading_id % 11 = 0 THEN NULL ELSE city END AS city,
 CASE WHEN reading_id % 12 IN (2, 7) THEN NULL
      WHEN reading_id % 12 = 10 THEN date_trunc('day', datetime)
      ELSE datetime END AS datetime,
 components_co, components_no2, components_o3, components_pm2_5, components_pm10,
 CASE WHEN reading_id % 10 IN (3, 5, 7) THEN NULL ELSE components_so2 END AS components_so2,
 temperature_2m, relative_humidity_2m, wind_speed_10m
FROM readings)
"""

# Clean rows of a raw text file.
LOADED = PARSED + """,
clean AS (
SELECT *, CAST(hour(datetime) AS INT) AS hour, CAST(month(datetime) AS INT) AS month,
 CAST(year(datetime) AS INT) AS year
FROM (SELECT DISTINCT * FROM parsed WHERE main_aqi IS NOT NULL AND datetime IS NOT NULL))
"""

REQUESTS = """,
requests AS (
SELECT reading_id, line_no,
 CASE WHEN reading_id % 7 <> 0 THEN city END AS city,
 CASE WHEN reading_id % 5 <> 1 THEN components_pm2_5 END AS components_pm2_5,
 CASE WHEN reading_id % 6 <> 2 THEN components_co END AS components_co,
 CASE WHEN reading_id % 4 <> 3 THEN components_no2 END AS components_no2,
 CASE WHEN reading_id % 9 <> 4 THEN temperature_2m END AS temperature_2m,
 CASE WHEN reading_id % 3 <> 0 THEN CAST(hour(datetime) AS INT) END AS hour,
 CASE WHEN reading_id % 8 <> 5 THEN CAST(month(datetime) AS INT) END AS month
FROM readings),
filled AS (
SELECT reading_id, line_no, coalesce(city, 'Karachi') AS city,
 coalesce(components_pm2_5, 101.0::DOUBLE) AS components_pm2_5,
 coalesce(components_co, 1795.0::DOUBLE) AS components_co,
 coalesce(components_no2, 38.0::DOUBLE) AS components_no2,
 coalesce(temperature_2m, 25.0::DOUBLE) AS temperature_2m,
 coalesce(hour, 12) AS hour, coalesce(month, 6) AS month
FROM requests)
"""

BAND = (
    "CASE WHEN components_pm2_5 > 150 THEN 5 WHEN components_pm2_5 > 100 THEN 4 "
    "WHEN components_pm2_5 > 50 THEN 3 WHEN components_pm2_5 > 25 THEN 2 ELSE 1 END"
)
ALL_RULE = f"""{CLEAN},
scored AS (SELECT main_aqi AS label, {BAND} AS predicted FROM clean)
"""
PER_CLASS = f"""{ALL_RULE},
classes AS (
SELECT k.code,
 (SELECT count(*) FROM scored s WHERE s.label = k.code) AS support,
 (SELECT count(*) FROM scored s WHERE s.predicted = k.code) AS claimed,
 (SELECT count(*) FROM scored s WHERE s.label = k.code AND s.predicted = k.code) AS hits
FROM (SELECT unnest([1, 2, 3, 4, 5]) AS code) k)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ADVICE_ROWS = ", ".join(
    f"({code}, {_quoted(status)}, {_quoted(prefix)}, {_quoted(text)}, "
    f"{_quoted(' | '.join(steps))}, {_quoted(color)})"
    for code, status, prefix, text, steps, color in ADVICE
)
ADVICE_CTE = f""",
advice AS (SELECT * FROM (VALUES {ADVICE_ROWS})
 AS t(advice_class, health_status, label_prefix, aqi_desc, precautions, color_theme))
"""
MEANS = f""",
means AS (SELECT {', '.join(f'avg({name}) AS {name}' for name in BASELINE_MEASURES)} FROM clean)
"""
MEAN_COLUMNS = ", ".join(f"round(m.{name}, 6) AS mean_{name}" for name in BASELINE_MEASURES)
SHOWN_INDEX = (
    "CASE aqi_code WHEN 1 THEN 25 WHEN 2 THEN 45 WHEN 3 THEN 78 WHEN 4 THEN 135 "
    "WHEN 5 THEN 240 ELSE 25 END"
)
ANSWERS = f"""{CLEAN}{REQUESTS}{ADVICE_CTE}{MEANS},
coded AS (SELECT *, {BAND} AS aqi_code FROM filled),
answers AS (
SELECT reading_id, line_no, 'success' AS status, aqi_code, health_status,
 label_prefix || ' (' || city || ')' AS aqi_label, aqi_desc, color_theme, city, precautions,
 {SHOWN_INDEX} AS display_index, {MEAN_COLUMNS}
FROM coded JOIN advice ON aqi_code = advice_class CROSS JOIN means m)
"""
ANSWER_COLUMNS = [
    "aqi_code", "health_status", "aqi_label", "aqi_desc", "color_theme", "city", "precautions",
    "display_index", *[f"mean_{name}" for name in BASELINE_MEASURES],
]
MONTHLY = """
SELECT year, month, avg(main_aqi) AS mean_aqi, avg(components_pm2_5) AS mean_pm2_5
FROM clean GROUP BY year, month
"""
LABEL = "lpad(CAST(month AS VARCHAR), 2, '0') || '/' || year"
ALL_MEASURES = ", ".join(MEASURES)
VECTOR = ", ".join(f"CAST({name} AS DOUBLE) AS f_{name}" for name in FEATURES)


def _shown(value: str, digits: int) -> str:
    """Printing rounds by the binary value."""
    return f"CAST(format('{{:.{digits}f}}', {value}) AS DOUBLE)"


def _with(parts: str, select: str) -> str:
    return f"WITH {READINGS}{parts} {select}"


def all_oracles() -> dict[str, str]:
    means_of_features = " UNION ALL ".join(
        f"SELECT {place} AS place, '{name}' AS feature, count({name}) AS n_values, "
        f"round(avg(CAST({name} AS DOUBLE)), 4) AS mean_value FROM clean"
        for place, name in enumerate(f for f in FEATURES if f != "components_so2")
    )
    return {
        "csv_scan": _with(PARSED, f"SELECT reading_id, line_no, city, main_aqi, {ALL_MEASURES} FROM parsed"),
        "preferred_source": _with(PARSED, """
            SELECT 'concatenated' AS source, main_aqi, count(*) AS n_rows,
             sum(components_pm2_5) AS total_pm2_5 FROM parsed GROUP BY main_aqi
            UNION ALL
            SELECT 'pieces', main_aqi, count(*), sum(components_pm2_5)
            FROM parsed WHERE line_no % 2 = 0 GROUP BY main_aqi"""),
        "concat_by_name": _with(PARSED, """
            SELECT reading_id, line_no, city, main_aqi,
             CASE WHEN city = 'ASIA' THEN NULL ELSE components_so2 END AS components_so2,
             components_pm2_5 FROM parsed"""),
        "empty_input_guard": _with("", """
            SELECT 'found' AS source, 'read' AS outcome, count(*) AS n_rows FROM readings
            UNION ALL SELECT 'absent', 'empty', 0"""),
        "csv_sink": _with(CLEAN, f"""
            SELECT reading_id, line_no, datetime, city, main_aqi, hour, month, year,
             {ALL_MEASURES} FROM clean"""),
        "readings_table": _with(CLEAN, """
            SELECT year, month, count(*) AS n_rows, sum(components_pm2_5) AS total_pm2_5
            FROM clean GROUP BY year, month"""),
        "feature_table": _with(CLEAN, f"SELECT {VECTOR}, main_aqi FROM clean"),
        "rows_to_frame": _with(CLEAN + ADVICE_CTE, """
            SELECT advice_class, health_status, label_prefix, color_theme, count(*) AS n_readings
            FROM clean JOIN advice ON main_aqi = advice_class GROUP BY ALL"""),
        "model_store": _with(CLEAN, """
            SELECT main_aqi, count(*) AS n_rows, count(*) AS n_same
            FROM clean WHERE reading_id % 5 = 0 GROUP BY main_aqi"""),
        "drop_null_label": _with("", """
            SELECT reading_id, line_no, datetime, city, main_aqi, components_pm2_5
            FROM readings WHERE main_aqi IS NOT NULL"""),
        "full_row_dedup": _with("", "SELECT DISTINCT * FROM readings"),
        "mixed_timestamp_parse": _with(PARSED, "SELECT reading_id, line_no, datetime AS moment FROM parsed"),
        "drop_bad_datetime": _with(PARSED, """
            SELECT reading_id, line_no, datetime FROM parsed WHERE datetime IS NOT NULL"""),
        "date_parts": _with("", """
            SELECT reading_id, line_no, datetime, CAST(hour(datetime) AS INT) AS hour,
             CAST(month(datetime) AS INT) AS month, CAST(year(datetime) AS INT) AS year
            FROM readings"""),
        "clean_readings": _with(CLEAN, "SELECT * FROM clean"),
        "feature_projection": _with(CLEAN, means_of_features),
        "feature_vector": _with(CLEAN, f"""
            SELECT reading_id, line_no, {VECTOR} FROM clean WHERE reading_id % 97 <> 0"""),
        "incomplete_rows": _with(CLEAN, """
            SELECT count(*) AS n_rows, count(*) FILTER (WHERE reading_id % 97 = 0) AS incomplete_rows
            FROM clean"""),
        "vector_and_label": _with(CLEAN, """
            SELECT main_aqi, count(*) AS n_rows, 11 AS vector_size,
             sum(components_pm2_5) AS total_pm2_5 FROM clean GROUP BY main_aqi"""),
        "request_defaults": _with(REQUESTS, "SELECT * FROM filled"),
        "derived_features": _with(REQUESTS, """
            SELECT reading_id, line_no, components_co, components_no2, 40.0::DOUBLE AS components_o3,
             components_pm2_5, components_pm2_5 * 1.2::DOUBLE AS components_pm10,
             12.0::DOUBLE AS components_so2, temperature_2m,
             60.0::DOUBLE AS relative_humidity_2m, 10.0::DOUBLE AS wind_speed_10m, hour, month
            FROM filled"""),
        "lenient_number": _with("", """
            SELECT reading_id, line_no, CASE reading_id % 7
             WHEN 0 THEN components_pm2_5 + 0.5
             WHEN 1 THEN components_pm2_5
             WHEN 5 THEN -10 * components_pm2_5
             WHEN 6 THEN CAST('0.' || CAST(CAST(components_pm2_5 AS INT) AS VARCHAR) AS DOUBLE)
             ELSE 0.0 END AS number FROM readings"""),
        "form_requests": _with("", """
            SELECT reading_id, line_no, city, components_pm2_5,
             CASE WHEN reading_id % 3 <> 0 THEN components_pm2_5 ELSE 0.0 END AS components_co,
             0.0::DOUBLE AS components_no2, -(line_no + 0.5::DOUBLE) AS temperature_2m FROM readings"""),
        "pm25_class": _with(REQUESTS, f"""
            SELECT reading_id, line_no, components_pm2_5, {BAND} AS aqi_code FROM requests"""),
        "fallback_rule": _with(REQUESTS, """
            SELECT reading_id, line_no,
             CASE WHEN high THEN 4 ELSE 2 END AS aqi_code,
             CASE WHEN high THEN 'UNHEALTHY' ELSE 'HEALTHY' END AS health_status,
             CASE WHEN high THEN 'Smog Vector Risk (' ELSE 'Optimal Air Index (' END || city || ')' AS aqi_label,
             'Data compiled using static regional fallback evaluation matrices.' AS aqi_desc,
             CASE WHEN high THEN 'Wear a protective N95 mask outside. | Curtail heavy training exercises.'
              ELSE 'Atmosphere is stable. Safe to proceed with standard tasks.' END AS precautions,
             CASE WHEN high THEN '#d9bca7' ELSE '#10b981' END AS color_theme,
             91.5::DOUBLE AS prediction_confidence, city, 1795.7::DOUBLE AS components_co,
             38.6::DOUBLE AS components_no2, 101.0::DOUBLE AS components_pm2_5, 21.5::DOUBLE AS temperature_2m
            FROM (SELECT *, components_pm2_5 > 100 AS high FROM filled)"""),
        "rule_confidence": _with("", f"""
            SELECT {BAND} AS aqi_code, count(*) AS n_rows, count(*) AS n_inside
            FROM readings GROUP BY 1"""),
        "model_or_rule": _with("", f"""
            SELECT reading_id, line_no,
             coalesce(CASE WHEN reading_id % 3 <> 0 THEN main_aqi END, {BAND}) AS aqi_code FROM readings"""),
        "vector_max": _with("", """
            SELECT reading_id, line_no,
             greatest(components_no2, components_o3, components_pm2_5, components_so2) AS largest
            FROM readings"""),
        **{
            query: _with(CLEAN, f"""
            SELECT main_aqi, count(*) AS n_rows, count(*) AS {column}
            FROM clean WHERE reading_id % 5 = 0 GROUP BY main_aqi""")
            for query, column in (
                ("prediction_to_int", "n_whole"), ("forest_confidence", "n_same"), ("forest_predictions", "n_same"))
        },
        "csv_malformed": _with(PARSED + """,
            kinds AS (SELECT * REPLACE (
             CASE WHEN reading_id % 31 = 3 THEN NULL ELSE components_co END AS components_co,
             CASE WHEN reading_id % 31 = 6 THEN NULL ELSE wind_speed_10m END AS wind_speed_10m,
             CASE WHEN reading_id % 31 = 6 THEN NULL ELSE relative_humidity_2m END AS relative_humidity_2m,
             CASE WHEN reading_id % 31 = 4 THEN 'A "B", C' ELSE city END AS city),
             reading_id % 31 AS kind FROM parsed),
            sound AS (SELECT * FROM kinds WHERE main_aqi IS NOT NULL AND kind NOT IN (1, 2, 5, 7))""", """
            SELECT *, initial_rows - clean_rows AS dropped_rows FROM
             (SELECT unnest(['exact', 'pass']) AS counted_by),
             (SELECT count(*) AS initial_rows, count(*) FILTER (WHERE kind IN (5, 7)) AS malformed_rows,
              count(*) FILTER (WHERE kind = 6) AS short_rows,
              count(*) FILTER (WHERE kind IN (1, 2)) AS bad_label_rows FROM kinds),
             (SELECT count(*) AS labelled_rows FROM sound),
             (SELECT count(*) AS unique_rows, count(datetime) AS clean_rows FROM (SELECT DISTINCT * FROM sound))"""),
        "rejected_rows": _with(PARSED, """
            SELECT CASE WHEN main_aqi IS NULL THEN 'unlabelled' WHEN datetime IS NULL THEN 'undated' ELSE 'clean' END AS cleaning_outcome,
             CAST(year(datetime) AS INT) AS year, CAST(month(datetime) AS INT) AS month, count(*) AS n_rows,
             CAST(sum(copies) AS BIGINT) AS n_input_rows, sum(components_pm2_5) AS total_pm2_5
            FROM (SELECT *, count(*) AS copies FROM parsed GROUP BY ALL) GROUP BY 1, 2, 3"""),
        "csv_line_breaks": _with("", """
            SELECT reading_id, line_no, city || CASE reading_id % 5 WHEN 0 THEN ' a' || chr(10) || 'b'
             WHEN 1 THEN 'c' || chr(13) || chr(10) || '"d",' WHEN 2 THEN '\\n\\'
             WHEN 3 THEN 'e\\s' || chr(10) || '\\r' ELSE 'plain ' END AS city,
             count(*) OVER () AS n_lines FROM readings"""),
        "timestamp_shapes": _with("", """
            SELECT reading_id, line_no, CASE WHEN reading_id % 15 IN (0, 1, 2, 11, 12, 14) THEN date_trunc('day', datetime)
             WHEN reading_id % 15 IN (5, 6, 10) THEN date_trunc('month', datetime) ELSE datetime END AS moment
            FROM readings"""),
        "forest_fit": _with(CLEAN, """
            SELECT count(*) AS n_train, 11 AS n_features, 1.0::DOUBLE AS total_importance,
             true AS none_negative, true AS layout_is_no_matter FROM clean WHERE reading_id % 5 <> 0"""),
        "forest_on_counted_rows": _with(CLEAN, f"""
            SELECT sum(CASE WHEN reading_id % 3 = 0 THEN 3 ELSE 1 END)::BIGINT AS n_rows,
             count(DISTINCT ({", ".join(FEATURES)}, main_aqi)) AS n_different,
             true AS accuracy_is_close, true AS weighted_f1_is_close FROM clean WHERE reading_id % 5 <> 0"""),
        "forest_metrics": _with(CLEAN, """
            SELECT count(*) AS n_rows, true AS accuracy_agrees, true AS weighted_f1_agrees
            FROM clean WHERE reading_id % 5 = 0"""),
        "score_by_forest": _with(REQUESTS, """
            SELECT 'success' AS status, count(*) AS n_rows, count(*) AS n_advice, count(*) AS n_index,
             count(*) AS n_confidence, count(*) AS n_model FROM requests"""),
        "stream_by_forest": _with(REQUESTS, """
            SELECT CASE WHEN ok THEN 'success' ELSE 'error' END AS status, count(*) AS n_rows,
             count(*) FILTER (WHERE ok) AS n_advice, count(*) FILTER (WHERE ok) AS n_index,
             count(*) FILTER (WHERE ok) AS n_confidence, count(*) FILTER (WHERE ok) AS n_model
            FROM (SELECT reading_id % 13 <> 0 AS ok FROM requests) GROUP BY ok"""),
        "score_json_requests": _with(REQUESTS, f"""
            SELECT CASE WHEN kind NOT IN (4, 5) THEN reading_id END AS reading_id,
             CASE WHEN kind NOT IN (4, 5) THEN line_no END AS line_no,
             CASE WHEN kind IN (3, 4, 5) THEN 'error' ELSE 'success' END AS status,
             CASE WHEN kind NOT IN (3, 4, 5) THEN {BAND} END AS aqi_code,
             CASE WHEN kind NOT IN (3, 4, 5) THEN city END AS city, hour, month,
             CASE WHEN kind NOT IN (3, 4, 5) THEN 'rule' END AS scored_by,
             CASE WHEN kind = 3 THEN 'components_pm2_5 is no number'
              WHEN kind IN (4, 5) THEN 'no JSON object' END AS message
            FROM (SELECT reading_id, line_no, reading_id % 17 AS kind, coalesce(city, 'Karachi') AS city,
             CASE WHEN reading_id % 17 = 6 THEN 101.0::DOUBLE
              ELSE coalesce(components_pm2_5, 101.0::DOUBLE) END AS components_pm2_5,
             CAST(CASE WHEN reading_id % 17 IN (4, 5) THEN 12 WHEN reading_id % 17 = 7 THEN line_no
              ELSE coalesce(hour, 12) END AS INT) AS hour,
             CAST(CASE WHEN reading_id % 17 IN (4, 5) THEN 6 WHEN reading_id % 17 = 7 THEN line_no + 1
              ELSE coalesce(month, 6) END AS INT) AS month FROM requests)"""),
        "percent_rounding": _with("", f"""
            SELECT reading_id, line_no, {_shown('components_pm2_5 / 400 * 100', 1)} AS percent FROM readings"""),
        "display_index": _with("", f"""
            SELECT *, {SHOWN_INDEX} AS display_index FROM (
             SELECT reading_id, line_no, CASE WHEN reading_id % 10 <> 9 THEN reading_id % 8 END AS aqi_code
             FROM readings)"""),
        "percent_of_baseline": _with(CLEAN + MEANS, "SELECT reading_id, line_no, " + ", ".join(
            f"CAST(floor(c.{name} / nullif(m.{name}, 0) * 100 + 0.5) AS BIGINT) AS {name}_percent"
            for name in BASELINE_MEASURES
        ) + " FROM clean c CROSS JOIN means m"),
        # Reading id and line number are no key of the test tables, so shares stay within a row.
        "composition_profile": _with(CLEAN + """,
            wholes AS (SELECT *, components_pm2_5 + components_co / 10 + components_no2
             + temperature_2m AS whole FROM clean),
            parts AS (
             SELECT reading_id, line_no, whole, 'components_pm2_5' AS part, components_pm2_5 AS part_value FROM wholes
             UNION ALL SELECT reading_id, line_no, whole, 'components_co', components_co / 10 FROM wholes
             UNION ALL SELECT reading_id, line_no, whole, 'components_no2', components_no2 FROM wholes
             UNION ALL SELECT reading_id, line_no, whole, 'temperature_2m', temperature_2m FROM wholes)
            """, """
            SELECT reading_id, line_no, part, part_value, round(part_value / nullif(whole, 0), 9) AS share
            FROM parts"""),
        "timeline_label": _with(CLEAN, f"SELECT reading_id, line_no, {LABEL} AS label FROM clean"),
        "city_label": _with("", """
            SELECT reading_id, line_no, 'Optimal Air Index (' || city || ')' AS aqi_label FROM readings"""),
        "advice_lookup": _with(ADVICE_CTE + """,
            coded AS (SELECT reading_id, line_no, city,
             CASE WHEN reading_id % 10 <> 9 THEN reading_id % 8 END AS aqi_code FROM readings)
            """, """
            SELECT reading_id, line_no, city, aqi_code, health_status, aqi_desc, precautions,
             color_theme, label_prefix || ' (' || city || ')' AS aqi_label
            FROM coded JOIN advice ON advice_class = CASE WHEN aqi_code BETWEEN 1 AND 5 THEN aqi_code ELSE 3 END"""),
        "attach_baselines": _with(CLEAN + MEANS, f"""
            SELECT reading_id, line_no, {MEAN_COLUMNS} FROM clean CROSS JOIN means m"""),
        **{
            name: _with(PARSED, """
            SELECT *, initial_rows - clean_rows AS dropped_rows FROM (SELECT
             (SELECT count(*) FROM parsed) AS initial_rows,
             (SELECT count(*) FROM parsed WHERE main_aqi IS NOT NULL) AS labelled_rows,
             (SELECT count(*) FROM (SELECT DISTINCT * FROM parsed WHERE main_aqi IS NOT NULL)) AS unique_rows,
             (SELECT count(*) FROM (SELECT DISTINCT * FROM parsed
              WHERE main_aqi IS NOT NULL AND datetime IS NOT NULL)) AS clean_rows)""")
            for name in ("cleaning_report", "cleaning_report_after_write")
        },
        "dataset_baselines": _with(CLEAN + MEANS, "SELECT " + ", ".join(
            f"round({name}, 6) AS {name}" for name in BASELINE_MEASURES) + " FROM means"),
        "monthly_means": _with(CLEAN, f"""
            SELECT year, month, round(mean_aqi, 9) AS mean_aqi, round(mean_pm2_5, 9) AS mean_pm2_5
            FROM ({MONTHLY})"""),
        "monthly_order": _with(CLEAN, f"""
            SELECT year, month, round(mean_pm2_5, 9) AS mean_pm2_5 FROM ({MONTHLY}) ORDER BY year, month"""),
        "monthly_timeline": _with(CLEAN, f"""
            SELECT {LABEL} AS label, {_shown("mean_pm2_5", 2)} AS real_pm25 FROM ({MONTHLY}) ORDER BY year, month"""),
        "overall_index": _with(CLEAN, f"SELECT {_shown('avg(main_aqi) * 40', 1)} AS overall_index FROM clean"),
        "city_leaderboard": _with(CLEAN, f"""
            SELECT city, round(avg(main_aqi), 9) AS mean_aqi, count(*) AS n_readings,
             {_shown('avg(main_aqi) * 40', 1)} AS city_index
            FROM clean GROUP BY city ORDER BY avg(main_aqi) DESC, city"""),
        "timeline_series": _with(CLEAN, f"""
            SELECT CAST(row_number() OVER (ORDER BY year, month) - 1 AS INT) AS place,
             {LABEL} AS label, {_shown("mean_pm2_5", 2)} AS real_pm25 FROM ({MONTHLY})"""),
        "dashboard_or_fallback": _with(CLEAN + """,
            board AS (SELECT city, avg(main_aqi) AS mean FROM clean WHERE city IS NOT NULL GROUP BY city)""", f"""
            SELECT 'success' AS status, CAST(count(*) AS INT) AS n_months,
             string_agg({LABEL}, ',' ORDER BY year, month) AS labels,
             (SELECT {_shown('avg(main_aqi) * 40', 1)} FROM clean) AS overall_index,
             (SELECT string_agg(city, ',' ORDER BY mean DESC, city) FROM board) AS cities,
             (SELECT {_shown('max(mean) * 40', 1)} FROM board) AS highest_index FROM ({MONTHLY})
            UNION ALL SELECT 'fallback', 0, '', NULL, '', NULL"""),
        "dedup_across_loads": _with(LOADED, f"""
            SELECT reading_id, line_no, datetime, city, main_aqi, hour, month, year, {ALL_MEASURES} FROM clean"""),
        "rollup_monthly_means": _with(LOADED, f"""
            SELECT year, month, round(mean_aqi, 6) AS mean_aqi, round(mean_pm2_5, 6) AS mean_pm2_5 FROM ({MONTHLY})"""),
        "rollup_baselines": _with(LOADED + MEANS, "SELECT " + ", ".join(
            f"round({name}, 6) AS {name}" for name in BASELINE_MEASURES) + " FROM means"),
        "rollup_leaderboard": _with(LOADED, f"""
            SELECT city, round(avg(main_aqi), 9) AS mean_aqi, count(*) AS n_readings,
             {_shown('avg(main_aqi) * 40', 1)} AS city_index
            FROM clean WHERE city IS NOT NULL GROUP BY city ORDER BY avg(main_aqi) DESC, city"""),
        "rollup_dashboard": _with(LOADED + """,
            board AS (SELECT city, avg(main_aqi) AS mean FROM clean WHERE city IS NOT NULL GROUP BY city)""", f"""
            SELECT 'success' AS status, CAST(count(*) AS INT) AS n_months,
             string_agg({LABEL}, ',' ORDER BY year, month) AS labels,
             (SELECT {_shown('avg(main_aqi) * 40', 1)} FROM clean) AS overall_index,
             (SELECT string_agg(city, ',' ORDER BY mean DESC, city) FROM board) AS cities,
             (SELECT {_shown('max(mean) * 40', 1)} FROM board) AS highest_index FROM ({MONTHLY})
            UNION ALL SELECT 'fallback', 0, '', NULL, '', NULL"""),
        "city_leaderboard_of_pieces": _with(PARSED, f"""
            SELECT city, round(avg(main_aqi), 9) AS mean_aqi, count(*) AS n_readings,
             {_shown('avg(main_aqi) * 40', 1)} AS city_index
            FROM (SELECT replace(min(city), ' ', '-') AS city, * EXCLUDE (city) FROM parsed
             WHERE city IS NOT NULL AND main_aqi IS NOT NULL AND datetime IS NOT NULL GROUP BY ALL)
            GROUP BY city ORDER BY avg(main_aqi) DESC, city"""),
        "forest_shape": _with(CLEAN, """
            SELECT 15 AS num_trees, 5 AS max_depth, 11 AS num_features,
             CAST(max(main_aqi) + 1 AS INT) AS num_classes, count(*) AS n_train
            FROM clean WHERE reading_id % 5 <> 0"""),
        "forest_prediction_counts": _with(CLEAN, """
            SELECT main_aqi, count(*) AS n_rows, count(*) AS n_class_valid, count(*) AS n_confidence_valid
            FROM clean WHERE reading_id % 5 = 0 GROUP BY main_aqi"""),
        "rule_accuracy": _with(ALL_RULE, """
            SELECT count(*) AS n_rows,
             round(avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy FROM scored"""),
        "rule_weighted_f1": _with(PER_CLASS, """
            SELECT CAST(sum(support) AS BIGINT) AS n_rows,
             round(sum(support * coalesce(2.0::DOUBLE * hits / nullif(support + claimed, 0), 0)) / sum(support), 9)
              AS weighted_f1 FROM classes"""),
        "confusion_matrix": _with(ALL_RULE, """
            SELECT label, predicted, count(*) AS n_rows FROM scored GROUP BY label, predicted"""),
        "score_by_rule": _with(ANSWERS, "SELECT * FROM answers"),
        "stream_by_rule": _with(ANSWERS, "SELECT " + ", ".join(
            f"CASE WHEN ok THEN {name} END AS {name}" for name in ["reading_id", "line_no", *ANSWER_COLUMNS]
        ) + ", CASE WHEN ok THEN 'success' ELSE 'error' END AS status"
            " FROM (SELECT *, reading_id % 13 <> 0 AS ok FROM answers)"),
        "stream_over_versions": _with(CLEAN + MEANS, """
            SELECT CAST(reading_id % 3 AS INT) AS model_version, CAST(reading_id % 3 AS INT) AS lot,
             CASE WHEN reading_id % 3 = 2 THEN 'model' ELSE 'rule' END AS scored_by, 'success' AS status,
             count(*) AS n_rows, CAST(1 AS BIGINT) AS n_batches,
             CASE WHEN reading_id % 3 = 0 THEN 101.0 ELSE (SELECT round(components_pm2_5, 6) FROM means) END AS mean_pm2_5
            FROM readings GROUP BY reading_id % 3"""),
        "stream_equals_batch": _with("", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM readings"),
    }
