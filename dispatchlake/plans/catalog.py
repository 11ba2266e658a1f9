"""Registered queries over the driver's tables and their DuckDB text.

Each entry is (name, Spark query, SQL). The SQL is written on its own: it doesn't share logic with the operators, and
what the incidents' parsing must give (times, roads, categories) is stated in the binding ``INC``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.functions import causes, geo, roads, text, times, weather
from dispatchlake.operators import coverage as cov_ops
from dispatchlake.operators import episodes as ep_ops
from dispatchlake.operators import filters, hourly, ingest, insights, panels, roadstats
from dispatchlake.plans import bindings as b
from dispatchlake.sources.scratch import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW, LONG_NOW = b.NOW, b.LONG_NOW


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _inc(s: SparkSession, d: str, mode: str = "full") -> DataFrame:
    return times.with_reported_ts(b.incidents(s, d), mode)


def _best(s: SparkSession, d: str) -> DataFrame:
    return times.with_best_ts(b.incidents(s, d))


def _ts(c: str, name: str | None = None):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name or c)


def _dts(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c.split('.')[-1]}"


def _roads(s: SparkSession, d: str) -> DataFrame:
    return roads.with_incident_corridors(_inc(s, d))


def _crashes(s: SparkSession, d: str) -> DataFrame:
    c = causes.with_severity(b.crashes_long(s, d))
    return c.filter(causes.category(F.col("cause")) == "accident")


def _cov(s: SparkSession, d: str) -> DataFrame:
    return cov_ops.coverage(b.crashes_long(s, d), LONG_NOW)


W = "WITH " + b.INC + " "
WC = "WITH " + b.CRASHES + ", "
#: cov: covered days of the long crash table, by the island rule.
COV = """days AS (SELECT DISTINCT CAST(reported_ts AS DATE) AS date FROM crashes), stepped AS (SELECT date, CASE WHEN date_diff('day', lag(date) OVER (ORDER BY date), date) <= 1 THEN 0 ELSE 1 END AS brk FROM days),
isl AS (SELECT date, sum(brk) OVER (ORDER BY date) AS island FROM stepped), ends AS (SELECT island, min(date) AS lo, max(date) AS hi FROM isl GROUP BY island),
cov AS (SELECT isl.date, isl.island, isl.date > lo AND isl.date < hi AND isl.date <> DATE '2001-08-02' AS is_full FROM isl JOIN ends USING (island))"""
WCOV = WC + COV + " "
RUSH = "(isodow(reported_ts) < 6 AND ((hour(reported_ts) >= 7 AND hour(reported_ts) < 9) OR (hour(reported_ts) >= 16 AND hour(reported_ts) < 19)))"


def _school(d: str) -> str:
    thanks = f"(make_date(year({d}), 11, 1) + CAST((3 - (isodow(make_date(year({d}), 11, 1)) - 1) + 7) % 7 + 21 AS INTEGER))"
    return f"(isodow({d}) < 6 AND NOT (month({d}) IN (6, 7) OR (month({d}) = 8 AND day({d}) < 15) OR (month({d}) = 12 AND day({d}) >= 20) OR (month({d}) = 1 AND day({d}) <= 3) OR (month({d}) = 11 AND day({d}) BETWEEN 21 AND 27 AND abs(date_diff('day', {thanks}, CAST({d} AS DATE))) <= 1)))"


# ---- columns
_add("prj_01_content_key", lambda s, d: text.with_content_key(b.incidents(s, d)).select("incident_number", "content_key"), W + "SELECT incident_number, concat_ws('|', location_key, upper(trim(regexp_replace(cause, '\\s+', ' ', 'g'))), upper(trim(regexp_replace(reported, '\\s+', ' ', 'g')))) AS content_key FROM inc")
_add("prj_02_incident_id", lambda s, d: text.with_incident_id(b.incidents(s, d)).select("event_id", "incident_number"), W + "SELECT event_id, replace(location, ' ', '_') || chr(10) || repeat('_', 24) || 'LAF_PARISH,_LA_' || replace(cause, ' ', '_') || '_' || replace(reported, ' ', '_') AS incident_number FROM inc")
_add("prj_03_location_key", lambda s, d: text.with_location_key(b.incidents(s, d)).select("incident_number", "location_key"), W + "SELECT incident_number, location_key FROM inc")
_add("prj_04_clean_values", lambda s, d: b.incidents(s, d).select("incident_number", text.clean_numeric(F.when(F.col("event_id") % 3 == 0, "nan").when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(" "))).otherwise("x")).alias("number"), text.clean_text(F.when(F.col("event_id") % 2 == 0, " None ").otherwise(F.col("assisting"))).alias("text")), W + "SELECT incident_number, CASE WHEN event_id % 3 = 1 THEN CAST(event_id AS DOUBLE) END AS number, CASE WHEN event_id % 2 = 1 AND assisting <> '' THEN assisting END AS text FROM inc")
_add("prj_05_reported_full", lambda s, d: _inc(s, d).select("incident_number", _ts("reported_ts")), W + f"SELECT incident_number, {_dts('reported_ts')} FROM inc")
_add("prj_05_reported_strict4", lambda s, d: _inc(s, d, "strict4").select("incident_number", _ts("reported_ts")), W + f"SELECT incident_number, {_dts('strict_ts', 'reported_ts')} FROM inc")
_add("prj_05_reported_timed", lambda s, d: _inc(s, d, "timed").select("incident_number", _ts("reported_ts")), W + f"SELECT incident_number, {_dts('reported_ts')} FROM inc")
_add("prj_06_best_ts", lambda s, d: _best(s, d).select("incident_number", _ts("best_ts")), W + f"SELECT incident_number, {_dts('coalesce(reported_ts, created_at)', 'best_ts')} FROM inc")
_add("prj_07_local_time", lambda s, d: b.incidents(s, d).select("incident_number", F.date_format(times.to_local(F.col("created_at").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("local")), W + f"SELECT incident_number, {_dts('created_at - INTERVAL 6 HOUR', 'local')} FROM inc")
_add("prj_08_time_context", lambda s, d: times.with_time_context(_inc(s, d)).select("incident_number", "hour_of_day", "day_of_week", "month", "is_weekend", "is_rush_hour"), W + f"SELECT incident_number, hour(reported_ts) AS hour_of_day, isodow(reported_ts) - 1 AS day_of_week, month(reported_ts) AS month, isodow(reported_ts) >= 6 AS is_weekend, {RUSH} AS is_rush_hour FROM inc")
_add("prj_09_school_day", lambda s, d: times.with_school_day(b.crashes_long(s, d)).select("incident_number", "is_school_day"), WC[:-2] + f" SELECT incident_number, {_school('reported_ts')} AS is_school_day FROM crashes")


def _fixed_days(observed: bool) -> str:
    out = []
    for m, k in ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25)):
        for y in range(1995, 2003):
            h = f"DATE '{y}-{m:02d}-{k:02d}'"
            out.append(f"SELECT {h} AS date")
            if observed:
                out.append(f"SELECT CASE isodow({h}) WHEN 6 THEN CAST({h} - INTERVAL 1 DAY AS DATE) WHEN 7 THEN CAST({h} + INTERVAL 1 DAY AS DATE) ELSE {h} END AS date")
    return " UNION ".join(out)


_FLOATING = "SELECT date FROM (SELECT CAST(range AS DATE) AS date FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2003-01-01', INTERVAL 1 DAY)) WHERE (isodow(date) = 1 AND ((month(date) IN (1, 2) AND day(date) BETWEEN 15 AND 21) OR (month(date) = 5 AND day(date) >= 25) OR (month(date) = 9 AND day(date) <= 7) OR (month(date) = 10 AND day(date) BETWEEN 8 AND 14))) OR (isodow(date) = 4 AND month(date) = 11 AND day(date) BETWEEN 22 AND 28)"
for _obs in (True, False):
    _add(f"prj_10_holiday_{'observed' if _obs else 'plain'}", lambda s, d, o=_obs: times.with_holiday(b.crashes_long(s, d), o).select("incident_number", "is_holiday"), WC + f"hol AS ({_fixed_days(_obs)} UNION {_FLOATING}) SELECT incident_number, CAST(reported_ts AS DATE) IN (SELECT date FROM hol) AS is_holiday FROM crashes")
_add("prj_12_road_type", lambda s, d: roads.with_road_type(b.incidents(s, d)).select("incident_number", "road_type"), W + "SELECT incident_number, CASE WHEN user_id % 10 = 5 THEN 'motorway' WHEN user_id % 10 = 6 THEN 'trunk' WHEN user_id % 10 IN (0, 1, 2, 3, 4, 7, 8) THEN 'primary' END AS road_type FROM inc")
_add("prj_13_category_map", lambda s, d: causes.with_category(b.incidents(s, d)).select("incident_number", "category"), W + "SELECT incident_number, category FROM inc")
_add("prj_13_category_digest", lambda s, d: causes.with_category(b.incidents(s, d), "digest").select("incident_number", "category"), W + "SELECT incident_number, CASE category WHEN 'accident' THEN 'Accidents' WHEN 'hazard' THEN 'Hazards' WHEN 'vehicle' THEN 'Stalled' ELSE 'Signals' END AS category FROM inc")
_add("prj_13_cause_groups", lambda s, d: causes.with_category(b.incidents(s, d), "filter").select("incident_number", F.array_join("cause_groups", ",").alias("cause_groups")), W + "SELECT incident_number, CASE WHEN cause LIKE '%ACCIDENT%' THEN 'accident' WHEN cause = 'HIT AND RUN' THEN 'other' WHEN category = 'hazard' THEN 'hazard' WHEN category = 'vehicle' THEN 'stalled' ELSE 'signal' END AS cause_groups FROM inc")
_add("prj_14_severity", lambda s, d: causes.with_severity(_inc(s, d)).select("incident_number", "severity", "is_severe", "is_hit_and_run", "is_night"), W + "SELECT incident_number, severity, cause = 'TRAFFIC ACCIDENT MAJOR' AS is_severe, cause = 'HIT AND RUN' AS is_hit_and_run, hour(reported_ts) >= 21 OR hour(reported_ts) < 5 AS is_night FROM inc")
_add("prj_15_agencies", lambda s, d: causes.with_agencies(b.incidents(s, d)).select("incident_number", "agency_mask", F.array_join("agencies", ",").alias("agencies")), W + "SELECT incident_number, CASE assisting WHEN 'POLICE' THEN 1 WHEN 'POLICE FIRE' THEN 5 WHEN 'SHERIFF' THEN 2 ELSE 16 END AS agency_mask, CASE assisting WHEN 'POLICE FIRE' THEN 'police,fire' ELSE lower(assisting) END AS agencies FROM inc")
_add("prj_16_normalize_road", lambda s, d: b.incidents(s, d).select("location").distinct().select("location", roads.normalize_road(F.substring_index("location", "/", 1)).alias("road")), W + "SELECT DISTINCT location, CASE user_id % 10 WHEN 8 THEN 'AMBASSADOR CAFFERY PKWY AT KALISTE SALOOM RD' ELSE coalesce(corridors[1], '') END AS road FROM inc")
_add("prj_17_corridors", lambda s, d: roads.with_corridors(b.incidents(s, d)).select("incident_number", F.array_join("corridors", "|").alias("corridors")), W + "SELECT incident_number, CASE user_id % 10 WHEN 0 THEN 'AMBASSADOR CAFFERY PKWY|CURRAN LN' WHEN 1 THEN 'JOHNSTON ST|W CONGRESS ST' WHEN 2 THEN 'PINHOOK RD|W BENDEL RD' WHEN 7 THEN 'E BROUSSARD RD|DUHON RD' ELSE array_to_string(corridors, '|') END AS corridors FROM inc")
_add("prj_18_incident_corridors", lambda s, d: roads.with_incident_corridors(b.incidents(s, d)).select("incident_number", F.array_join("corridors", "|").alias("corridors")), W + "SELECT incident_number, array_to_string(corridors, '|') AS corridors FROM inc")
_add("prj_19_place_parts", lambda s, d: text.with_place_parts(b.incidents(s, d)).select("incident_number", "town", "block", "cross_street"), W + "SELECT incident_number, CASE WHEN event_id % 7 = 0 THEN '' WHEN user_id % 10 = 9 AND user_id % 3 < 2 THEN '' ELSE CASE user_id % 3 WHEN 0 THEN 'Lafayette' WHEN 1 THEN 'Broussard' ELSE 'Parish' END END AS town, CASE WHEN event_id % 7 = 0 THEN split_part(trim(regexp_replace(location, '\\s+', ' ', 'g')), '/', 1) WHEN user_id % 10 = 9 THEN CASE WHEN user_id % 3 = 2 THEN 'LAF' ELSE location END ELSE split_part(regexp_replace(location, ' (LAFAYETTE|BROUSSARD|LAF PARISH), LA$', ''), '/', 1) END AS block, CASE WHEN event_id % 7 = 0 THEN split_part(trim(regexp_replace(location, '\\s+', ' ', 'g')), '/', 2) WHEN user_id % 10 = 9 THEN '' ELSE split_part(regexp_replace(location, ' (LAFAYETTE|BROUSSARD|LAF PARISH), LA$', ''), '/', 2) END AS cross_street FROM inc")
_add("prj_20_title_case", lambda s, d: _roads(s, d).select(F.explode("corridors").alias("road")).distinct().select("road", text.title_case_road(F.col("road")).alias("title")), W + "SELECT DISTINCT road, CASE road WHEN 'AMBASSADOR CAFFERY PKWY' THEN 'Ambassador Caffery Pkwy' WHEN 'JOHNSTON ST' THEN 'Johnston St' WHEN 'PINHOOK RD' THEN 'Pinhook Rd' WHEN 'KALISTE SALOOM RD' THEN 'Kaliste Saloom Rd' WHEN 'EVANGELINE THRUWAY' THEN 'Evangeline Thruway' WHEN 'E BROUSSARD RD' THEN 'E Broussard Rd' ELSE road END AS title FROM (SELECT unnest(corridors) AS road FROM inc)")
_add("prj_21_time_block", lambda s, d: times.with_time_block(_inc(s, d)).select("incident_number", "day_type", "time_block"), W + "SELECT incident_number, CASE WHEN isodow(reported_ts) >= 6 THEN 'weekend' WHEN reported_ts IS NOT NULL THEN 'weekday' END AS day_type, CASE WHEN reported_ts IS NULL THEN 'unknown' WHEN hour(reported_ts) < 6 THEN 'latenight' WHEN hour(reported_ts) < 10 THEN 'morning' WHEN hour(reported_ts) < 15 THEN 'midday' WHEN hour(reported_ts) < 19 THEN 'evening' ELSE 'night' END AS time_block FROM inc")
_add("prj_22_daylight", lambda s, d: times.with_daylight(b.crashes_long(s, d)).select("incident_number", "is_daylight"), WC + "sun(m, rise, fall) AS (VALUES " + ", ".join(f"({m}, {a}, {z})" for m, (a, z) in enumerate(times.SUN, 1)) + ") SELECT incident_number, hour(reported_ts) * 60 + minute(reported_ts) >= rise AND hour(reported_ts) * 60 + minute(reported_ts) < fall AS is_daylight FROM crashes JOIN sun ON m = month(reported_ts)")
_BANDS_SQL = """SELECT incident_number,
 CASE WHEN weather_temp_f <= 50 THEN 'cold' WHEN weather_temp_f < 70 THEN 'mild' WHEN weather_temp_f < 85 THEN 'warm' WHEN weather_temp_f >= 85 THEN 'hot' END AS temp_band,
 CASE WHEN weather_precip_prob < 20 THEN 'low' WHEN weather_precip_prob < 60 THEN 'med' WHEN weather_precip_prob >= 60 THEN 'high' END AS precip_prob_band,
 CASE WHEN weather_precip_in <= 0.01 THEN 'none' WHEN weather_precip_in <= 0.10 THEN 'light' WHEN weather_precip_in < 0.50 THEN 'moderate' WHEN weather_precip_in >= 0.50 THEN 'heavy' END AS precip_band,
 CASE WHEN weather_wind_mph < 10 THEN 'calm' WHEN weather_wind_mph < 20 THEN 'breezy' WHEN weather_wind_mph >= 20 THEN 'windy' END AS wind_band,
 CASE WHEN weather_visibility_mi < 3 THEN 'low' WHEN weather_visibility_mi < 10 THEN 'hazy' WHEN weather_visibility_mi >= 10 THEN 'clear' END AS visibility_band,
 CASE WHEN weather_cloud_pct < 25 THEN 'clear' WHEN weather_cloud_pct < 70 THEN 'partly' WHEN weather_cloud_pct >= 70 THEN 'overcast' END AS cloud_band FROM inc"""
_add("prj_24_weather_bands", lambda s, d: weather.with_weather_bands(b.incidents(s, d)).select("incident_number", *[f"{k}_band" for k in weather.BANDS]), W + _BANDS_SQL)
_CODE = "CASE WHEN precip_in >= 0.30 THEN 'h' WHEN precip_in >= 0.01 OR regexp_matches(wx, 'RA|DZ|TS|SN|PL|GR|FZ|UP') THEN 'r' WHEN visibility_mi < 1.0 OR wx LIKE '%FG%' THEN 'f' WHEN precip_in IS NULL AND visibility_mi IS NULL THEN '-' ELSE 'd' END"
_add("prj_25_condition_code", lambda s, d: weather.with_condition_code(b.weather_obs(s, d)).groupBy("code").agg(F.count(F.lit(1)).alias("n")), "WITH " + b.WEATHER + f" SELECT {_CODE} AS code, count(*) AS n FROM weather_obs GROUP BY 1")
_add("prj_27_grade_geocodes", lambda s, d: ingest.grade_geocodes(b.geocode_results(s, d)).select("result_id", "reason", "label"), "WITH " + b.GEOCODES + ", r AS (SELECT *, CASE WHEN place = 'Opelousas' THEN 'place' WHEN NOT (latitude BETWEEN 29.9 AND 30.5 AND longitude BETWEEN -92.4 AND -91.7) THEN 'bounds' WHEN result_type = 'locality' THEN 'precision' WHEN location_type = 'APPROXIMATE' AND result_type IN ('route', 'school') THEN 'precision' ELSE 'ok' END AS reason FROM geo) SELECT result_id, reason, CASE WHEN reason <> 'ok' THEN 'rejected' WHEN location_type IN ('ROOFTOP', 'RANGE_INTERPOLATED') OR result_type = 'intersection' THEN 'exact' ELSE 'approximate' END AS label FROM r")
_add("prj_28_visible_minutes", lambda s, d: b.incidents(s, d).select("incident_number", times.visible_minutes(F.col("first_seen_at"), F.col("last_seen_at")).alias("visible")), W + "SELECT incident_number, CAST(event_id % 180 AS BIGINT) AS visible FROM inc")
_add("prj_29_recency", lambda s, d: _best(s, d).groupBy(times.recency_bucket(F.col("best_ts"), NOW).alias("bucket")).agg(F.count(F.lit(1)).alias("n")), W + "SELECT CASE WHEN a <= 0 THEN 'Today' WHEN a = 1 THEN 'Yesterday' WHEN a < 7 THEN 'This week' WHEN a < 30 THEN 'This month' ELSE 'Earlier' END AS bucket, count(*) AS n FROM (SELECT date_diff('day', CAST(coalesce(reported_ts, created_at) AS DATE), DATE '2024-01-31') AS a FROM inc) GROUP BY 1")
_add("prj_30_distances", lambda s, d: b.incidents(s, d).filter("latitude IS NOT NULL").select("incident_number", F.round(geo.dist_m(F.lit(30.2), F.lit(-92.05), F.col("latitude"), F.col("longitude")), 3).alias("metres")), W + "SELECT incident_number, round(sqrt(pow((longitude + 92.05) * cos(radians(30.2)) * 111320.0, 2) + pow((latitude - 30.2) * 111320.0, 2)), 3) AS metres FROM inc WHERE latitude IS NOT NULL")
_CELL = "CAST(floor((floor(latitude * 1000000 + 0.5) + 500) / 1000) AS BIGINT) AS cell_y, CAST(floor((floor(longitude * 1000000 + 0.5) + 500) / 1000) AS BIGINT) AS cell_x"
_add("prj_31_grid", lambda s, d: b.incidents(s, d).filter("latitude IS NOT NULL").groupBy(*[c.alias(n) for c, n in zip(geo.cell(F.col("latitude"), F.col("longitude")), ("cell_y", "cell_x"), strict=True)]).agg(F.count(F.lit(1)).alias("n")), W + f"SELECT {_CELL}, count(*) AS n FROM inc WHERE latitude IS NOT NULL GROUP BY 1, 2")
_add("prj_33_rain_flag", lambda s, d: weather.with_rain_flag(b.incidents(s, d)).select("incident_number", "is_rain", "any_alert"), W + "SELECT incident_number, coalesce(weather_precip_prob >= 20, false) OR coalesce(weather_precip_in > 0.005, false) AS is_rain, event_id % 50 = 0 OR event_id % 70 = 0 OR event_id % 90 = 0 AS any_alert FROM inc")
_add("prj_34_location_state", lambda s, d: ingest.location_state(b.incidents(s, d)).select("incident_number", "location_state"), W + "SELECT incident_number, CASE WHEN event_id % 11 <> 0 THEN 'located' WHEN event_id % 5 >= 3 THEN 'unmappable' ELSE 'locating' END AS location_state FROM inc")

# ---- episodes
_EP = """rows AS (SELECT *, lag(TS) OVER (PARTITION BY location_key ORDER BY TS, incident_number) AS prev FROM inc WHERE TS IS NOT NULL AND location_key <> '' AND cause <> 'TRAFFIC CONTROL'),
 chained AS (SELECT *, sum(CASE WHEN prev IS NULL OR TS > prev + INTERVAL 15 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY location_key ORDER BY TS, incident_number) AS no FROM rows),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY location_key, no ORDER BY CASE WHEN latitude IS NOT NULL THEN 0 ELSE 1 END, severity DESC, TS, incident_number) AS rk, count(*) OVER (PARTITION BY location_key, no) AS n_listings,
   min(TS) OVER (PARTITION BY location_key, no) AS first_ts, max(TS) OVER (PARTITION BY location_key, no) AS last_ts FROM chained)"""


def _episodes(mode: str) -> Callable:
    def run(s: SparkSession, d: str) -> DataFrame:
        ep = ep_ops.episodes(_inc(s, d, mode))
        return ep.select("incident_number", "location_key", "severity", "n_listings", _ts("first_ts"), _ts("last_ts"), F.array_join(F.transform("extras", lambda x: x["incident_number"]), ",").alias("extras"))

    return run


for _mode, _col in (("full", "reported_ts"), ("strict4", "strict_ts")):
    _add(f"agg_01_episodes_{_mode}", _episodes(_mode), W + "," + _EP.replace("TS", _col) + f", x AS (SELECT location_key, no, string_agg(incident_number, ',' ORDER BY {_col}, incident_number) AS extras FROM ranked WHERE rk > 1 GROUP BY 1, 2) SELECT r.incident_number, r.location_key, r.severity, r.n_listings, {_dts('r.first_ts')}, {_dts('r.last_ts')}, coalesce(x.extras, '') AS extras FROM ranked r LEFT JOIN x USING (location_key, no) WHERE rk = 1")
_FOLDED = ", folded AS (SELECT incident_number FROM ranked WHERE rk > 1)"
_add("jn_22_drop_secondaries", lambda s, d: ep_ops.drop_secondaries(_inc(s, d), ep_ops.episodes(_inc(s, d))).select("incident_number"), W + "," + _EP.replace("TS", "reported_ts") + _FOLDED + " SELECT incident_number FROM inc WHERE incident_number NOT IN (SELECT incident_number FROM folded)")


def _control(s: SparkSession, d: str) -> DataFrame:
    out = ep_ops.collapse_control(_inc(s, d))
    return out.select("location_key", "incident_number", "n_calls", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), _ts("first_ts"), _ts("last_ts"), F.array_join(F.transform("history", lambda x: F.concat(x["day"].cast("string"), F.lit("="), x["n"].cast("string"))), ";").alias("history"))


_add("agg_02_control_collapse", _control, W + f""", c AS (SELECT * FROM inc WHERE cause = 'TRAFFIC CONTROL' AND latitude IS NOT NULL), h AS (SELECT location_key, CAST(reported_ts AS DATE) AS day, count(*) AS n FROM c WHERE reported_ts IS NOT NULL GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY location_key ORDER BY day DESC) AS r FROM h), hist AS (SELECT location_key, string_agg(CAST(day AS VARCHAR) || '=' || CAST(n AS VARCHAR), ';' ORDER BY day) AS history FROM k WHERE r <= 30 GROUP BY 1)
 SELECT location_key, min(incident_number) AS incident_number, count(*) AS n_calls, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude, {_dts('min(reported_ts)', 'first_ts')}, {_dts('max(reported_ts)', 'last_ts')}, coalesce(any_value(history), '') AS history FROM c LEFT JOIN hist USING (location_key) GROUP BY location_key""")


def _hot(s: SparkSession, d: str) -> DataFrame:
    inc = stored(_inc(s, d), "incidents")
    return panels.hot_spots(inc.join(ep_ops.folded_ids(inc), "incident_number", "left_anti"), NOW)


_add("agg_03_hot_spots", _hot, W + "," + _EP.replace("TS", "reported_ts") + _FOLDED + f" SELECT {_CELL}, count(*) AS n, round(sum(CASE WHEN reported_ts IS NULL THEN 0.1 ELSE exp(-greatest(date_diff('second', reported_ts, TIMESTAMP '{NOW}') / 86400.0, 0) / 30) END), 6) AS score FROM inc WHERE latitude IS NOT NULL AND incident_number NOT IN (SELECT incident_number FROM folded) GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY score DESC, 1, 2 LIMIT 100")
_add("agg_04_grid_groups", lambda s, d: panels.grid_groups(b.incidents(s, d)), W + f", g AS (SELECT {_CELL}, category, count(*) AS k FROM inc WHERE latitude IS NOT NULL GROUP BY 1, 2, 3) SELECT cell_y, cell_x, CAST(sum(k) AS BIGINT) AS n, arg_min(category, (-k, category)) AS category FROM g GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 100")
_add("agg_05_location_history", lambda s, d: panels.location_history(_inc(s, d), 3), W + f"SELECT {_CELL}, count(*) AS n, strftime(min(reported_ts), '%Y-%m-%d') AS first_date FROM inc WHERE latitude IS NOT NULL GROUP BY 1, 2")
_add("agg_07_corridor_counts", lambda s, d: panels.corridor_counts(_roads(s, d)), W + "SELECT road, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT road, count(*) AS n FROM (SELECT unnest(corridors) AS road FROM inc) GROUP BY 1) ORDER BY n DESC, road LIMIT 12")


def _digest(s: SparkSession, d: str) -> DataFrame:
    inc = stored(_inc(s, d), "incidents")
    return panels.digest(inc, NOW, ep_ops.folded_ids(inc))


_add("agg_08_digest", _digest, W + "," + _EP.replace("TS", "reported_ts") + _FOLDED + f""", d AS (SELECT inc.*, created_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND created_at < TIMESTAMP '{NOW}' AS day, created_at >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR AND created_at < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AS prior, incident_number IN (SELECT incident_number FROM folded) AS f FROM inc), m AS (SELECT *, day AND NOT f AS mine FROM d)
 SELECT count(*) FILTER (mine) AS "new", count(*) FILTER (prior AND NOT f) AS previous, count(*) FILTER (day AND f) AS folded, count(*) AS archive_total, count(*) FILTER (mine AND category = 'accident') AS n_accidents, count(*) FILTER (false) AS n_fire, count(*) FILTER (mine AND category = 'hazard') AS n_hazards, count(*) FILTER (mine AND category = 'control') AS n_signals, count(*) FILTER (mine AND category = 'vehicle') AS n_stalled, count(*) FILTER (false) AS n_medical, count(*) FILTER (false) AS n_other,
 count(*) FILTER (mine AND assisting LIKE '%POLICE%') AS agency_police, count(*) FILTER (mine AND assisting = 'SHERIFF') AS agency_sheriff, count(*) FILTER (mine AND assisting LIKE '%FIRE%') AS agency_fire, count(*) FILTER (false) AS agency_ems, count(*) FILTER (mine AND latitude IS NOT NULL) AS located, count(*) FILTER (mine AND latitude IS NULL AND geocode_attempts < 3) AS locating, count(*) FILTER (mine AND latitude IS NULL AND geocode_attempts >= 3) AS unmappable,
 count(*) FILTER (mine AND (coalesce(weather_precip_prob >= 20, false) OR coalesce(weather_precip_in > 0.005, false))) AS in_rain, count(*) FILTER (mine AND (nws_flash_flood_warning OR nws_severe_thunderstorm_warning OR nws_tornado_watch)) AS under_alert FROM m""")
_add("agg_08_digest_hours", lambda s, d: panels.digest_hours(_inc(s, d), NOW), W + f"SELECT CAST(h.range AS INTEGER) AS hour, count(inc.event_id) AS n FROM range(24) h LEFT JOIN inc ON hour(reported_ts) = h.range AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND created_at < TIMESTAMP '{NOW}' GROUP BY 1")

# ---- queues and merges
_KEYED = "k AS (SELECT *, geocode_attempts AS tries FROM inc)"


def _keyed(s: SparkSession, d: str) -> DataFrame:
    return text.with_content_key(text.with_location_key(b.incidents(s, d)))


_add("agg_09_budget", lambda s, d: ingest.budget(b._view(s, d, "events").filter("event_type = 'click'").select(F.col("ts").cast("timestamp_ntz").alias("requested_at")), "2024-01-20 12:00:00", 100, 25), "SELECT used, greatest(100 - used, 0) AS \"left\", least(25, greatest(100 - used, 0)) AS approved FROM (SELECT count(*) AS used FROM events WHERE event_type = 'click' AND ts > TIMESTAMP '2024-01-19 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00')")
_add("agg_11_fallback_points", lambda s, d: ingest.fallback_points(_keyed(s, d).withColumn("latitude", F.floor(F.col("latitude") * 25) / 25).withColumn("longitude", F.floor(F.col("longitude") * 25) / 25)), W + "SELECT floor(latitude * 25) / 25 AS latitude, floor(longitude * 25) / 25 AS longitude, count(DISTINCT location_key) AS places, count(*) AS n FROM inc WHERE latitude IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT location_key) >= 8")
_add("agg_12_failure_history", lambda s, d: ingest.failure_history(_keyed(s, d)), W + f"SELECT location_key, max(geocode_attempts) AS attempts, {_dts('max(created_at)', 'last_attempt')} FROM inc WHERE latitude IS NULL AND location_key <> '' GROUP BY 1 HAVING max(geocode_attempts) >= 3")
_add("jn_06_skippable", lambda s, d: ingest.skippable_addresses(ingest.failure_history(_keyed(s, d)), NOW), W + f"SELECT location_key FROM inc WHERE latitude IS NULL AND location_key <> '' GROUP BY 1 HAVING max(geocode_attempts) >= 3 AND date_trunc('second', max(created_at)) >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")


def _estimate(s: SparkSession, d: str) -> DataFrame:
    k = _keyed(s, d)
    return ingest.estimate_lookups(k, k.filter("latitude IS NOT NULL").select("location_key").distinct(), ingest.skippable_addresses(ingest.failure_history(k), NOW))


_add("agg_10_estimate_lookups", _estimate, W + f", skip AS (SELECT location_key FROM inc WHERE latitude IS NULL GROUP BY 1 HAVING max(geocode_attempts) >= 3 AND date_trunc('second', max(created_at)) >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) SELECT count(DISTINCT location_key) AS n FROM inc WHERE latitude IS NULL AND location_key <> '' AND location_key NOT IN (SELECT location_key FROM inc WHERE latitude IS NOT NULL) AND location_key NOT IN (SELECT location_key FROM skip)")
_add("agg_13_feed_checks", lambda s, d: cov_ops.feed_checks(b.feed_checks(s, d)).select(_ts("hour"), "n_ok", "n_failed"), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) FILTER (event_type <> 'error') AS n_ok, count(*) FILTER (event_type = 'error') AS n_failed FROM events GROUP BY 1")
_add("agg_13_feed_hours", lambda s, d: cov_ops.feed_hours(cov_ops.feed_checks(b.feed_checks(s, d))).select(F.col("date").cast("string").alias("date"), "hours"), "SELECT strftime(ts, '%Y-%m-%d') AS date, count(DISTINCT hour(ts)) AS hours FROM events WHERE event_type <> 'error' GROUP BY 1")
_add("jn_03_sightings", lambda s, d: ingest.track_sightings(b.listings(s, d)).select("incident_number", _ts("first_seen_at"), _ts("last_seen_at"), "observation_count"), "WITH " + b.LISTINGS + f" SELECT incident_number, {_dts('min(sweep_ts)', 'first_seen_at')}, {_dts('max(sweep_ts)', 'last_seen_at')}, count(DISTINCT sweep_ts) AS observation_count FROM listings GROUP BY 1")
_add("jn_04_agency_changes", lambda s, d: ingest.accumulate_agencies(b.listings(s, d)).select("incident_number", "agency", _ts("changed_at")), "WITH " + b.LISTINGS + f" SELECT incident_number, 'fire' AS agency, {_dts('min(sweep_ts)', 'changed_at')} FROM listings WHERE assisting LIKE '%FIRE%' GROUP BY 1")
_add("agg_14_change_stats", lambda s, d: ingest.change_stats(ingest.accumulate_agencies(b.listings(s, d))), "WITH " + b.LISTINGS + f", c AS (SELECT incident_number, min(sweep_ts) AS changed_at FROM listings WHERE assisting LIKE '%FIRE%' GROUP BY 1) SELECT {_dts('min(changed_at)', 'since')}, count(DISTINCT incident_number) AS tracked, count(*) AS added, count(*) AS fire_added FROM c")
_add("str_03_active_set_changes", lambda s, d: ingest.active_set_changes(b.listings(s, d)).select("incident_number", _ts("at"), "event"), "WITH " + b.LISTINGS + f""", sw AS (SELECT sweep_ts, lead(sweep_ts) OVER (ORDER BY sweep_ts) AS nxt, lag(sweep_ts) OVER (ORDER BY sweep_ts) AS prv FROM (SELECT DISTINCT sweep_ts FROM listings)), l AS (SELECT DISTINCT incident_number, sweep_ts FROM listings)
 SELECT l.incident_number, {_dts('l.sweep_ts', 'at')}, 'appeared' AS event FROM l JOIN sw USING (sweep_ts) WHERE NOT EXISTS (SELECT 1 FROM l p WHERE p.incident_number = l.incident_number AND p.sweep_ts = sw.prv)
 UNION ALL SELECT l.incident_number, {_dts('sw.nxt', 'at')}, 'left' AS event FROM l JOIN sw USING (sweep_ts) WHERE sw.nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l p WHERE p.incident_number = l.incident_number AND p.sweep_ts = sw.nxt)""")


def _filter_new(s: SparkSession, d: str) -> DataFrame:
    k = _keyed(s, d)
    old = k.filter("event_id % 4 = 0")
    batch = k.withColumn("pos", F.col("event_id")).filter("event_id % 4 <> 0")
    return ingest.filter_new(batch, old).select("incident_number", "content_key")


_CK = "concat_ws('|', location_key, upper(trim(cause)), upper(trim(reported)))"
_add("jn_01_filter_new", _filter_new, W + f", k AS (SELECT *, {_CK} AS content_key FROM inc), o AS (SELECT * FROM k WHERE event_id % 4 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY content_key ORDER BY event_id) AS rn FROM k WHERE event_id % 4 <> 0 AND content_key NOT IN (SELECT content_key FROM o)) SELECT incident_number, content_key FROM n WHERE rn = 1")


def _merged(kind: str) -> Callable:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = text.with_location_key(b.incidents(s, d)).filter("location_key <> ''")
        half = lambda e: rows.filter(e).groupBy("location_key").agg(F.count(F.lit(1)).alias("n"))
        cur, new = half("event_id % 3 = 0"), half("event_id % 3 <> 0")
        if kind == "add":
            return ingest.merge_add(cur, new, ["location_key"], ["n"])
        return (ingest.merge_ignore if kind == "ignore" else ingest.merge_replace)(cur, new, ["location_key"])

    return run


_HALVES = ", c AS (SELECT location_key, count(*) AS n FROM inc WHERE event_id % 3 = 0 AND location_key <> '' GROUP BY 1), u AS (SELECT location_key, count(*) AS n FROM inc WHERE event_id % 3 <> 0 AND location_key <> '' GROUP BY 1) SELECT coalesce(c.location_key, u.location_key) AS location_key, {} AS n FROM c FULL JOIN u ON c.location_key = u.location_key"
for _kind, _expr in (("ignore", "coalesce(c.n, u.n)"), ("add", "coalesce(c.n, 0) + coalesce(u.n, 0)"), ("replace", "coalesce(u.n, c.n)")):
    _add(f"jn_02_merge_{_kind}", _merged(_kind), W + _HALVES.format(_expr))
_add("jn_05_reuse_coords", lambda s, d: ingest.reuse_coords(_keyed(s, d)).select("incident_number", "coord_source", "latitude", "longitude"), W + """, e AS (SELECT location, arg_min(latitude, incident_number) AS la, arg_min(longitude, incident_number) AS lo FROM inc WHERE latitude IS NOT NULL GROUP BY 1), n AS (SELECT location_key, arg_min(latitude, incident_number) AS la, arg_min(longitude, incident_number) AS lo FROM inc WHERE latitude IS NOT NULL GROUP BY 1)
 SELECT incident_number, CASE WHEN latitude IS NOT NULL THEN 'own' WHEN e.la IS NOT NULL THEN 'exact' WHEN n.la IS NOT NULL THEN 'normalised' ELSE 'none' END AS coord_source, coalesce(latitude, e.la, n.la) AS latitude, coalesce(longitude, e.lo, n.lo) AS longitude FROM inc LEFT JOIN e USING (location) LEFT JOIN n USING (location_key)""")


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    k = _keyed(s, d).filter("location_key <> ''")
    tried = k.filter("event_id % 2 = 0").select("location_key").distinct()
    done = k.filter("event_id % 6 = 0 AND length(location_key) % 3 = 0").select("location_key").distinct()
    return ingest.record_outcomes(tried, done, ingest.failure_history(k).select("location_key", "attempts"))


_add("jn_07_record_outcomes", _outcomes, W + ", k AS (SELECT * FROM inc WHERE location_key <> ''), d AS (SELECT DISTINCT location_key FROM k WHERE event_id % 6 = 0 AND length(location_key) % 3 = 0), f AS (SELECT location_key, max(geocode_attempts) AS a FROM k WHERE latitude IS NULL GROUP BY 1 HAVING max(geocode_attempts) >= 3), t AS (SELECT DISTINCT location_key, 1 AS a FROM k WHERE event_id % 2 = 0) SELECT location_key, CAST(sum(a) AS BIGINT) AS attempts FROM (SELECT * FROM f UNION ALL SELECT * FROM t) WHERE location_key NOT IN (SELECT location_key FROM d) GROUP BY 1")


def _in_feed(s: SparkSession, d: str) -> DataFrame:
    rows = b.listings(s, d)
    last = rows.agg(F.max("sweep_ts").alias("last"))
    return ingest.with_in_feed(b.incidents(s, d), rows.join(F.broadcast(last), F.col("sweep_ts") == F.col("last"))).select("incident_number", "in_feed")


_add("jn_18_in_feed", _in_feed, "WITH " + b.LISTINGS + " SELECT concat('INC', event_id) AS incident_number, concat('INC', event_id) IN (SELECT incident_number FROM listings WHERE sweep_ts = (SELECT max(sweep_ts) FROM listings)) AS in_feed FROM events")


def _attempts(s: SparkSession, d: str) -> DataFrame:
    k = _keyed(s, d)
    tried = k.filter("event_id % 10 = 0").select("location_key")
    return ingest.retire(ingest.bump_attempts(k, tried), k.filter("event_id % 15 = 0").select("location_key")).select("incident_number", "geocode_attempts")


_add("jn_23_attempts", _attempts, W + ", n AS (SELECT *, geocode_attempts + CASE WHEN latitude IS NULL AND location_key IN (SELECT location_key FROM inc WHERE event_id % 10 = 0) THEN 1 ELSE 0 END AS a FROM inc) SELECT incident_number, CASE WHEN latitude IS NULL AND location_key IN (SELECT location_key FROM inc WHERE event_id % 15 = 0) THEN greatest(a, 3) ELSE a END AS geocode_attempts FROM n")
_add("snk_05_backfill_coords", lambda s, d: ingest.backfill_coords(b.incidents(s, d).select("incident_number", "latitude", "longitude"), b.incidents(s, d).filter("event_id % 22 = 0").select("incident_number", F.lit(30.2).alias("latitude"), F.lit(-92.0).alias("longitude"))).select("incident_number", "latitude", "longitude"), W + "SELECT incident_number, CASE WHEN latitude IS NULL AND event_id % 22 = 0 THEN 30.2 ELSE latitude END AS latitude, CASE WHEN longitude IS NULL AND event_id % 22 = 0 THEN -92.0 ELSE longitude END AS longitude FROM inc")


def _retry(s: SparkSession, d: str) -> DataFrame:
    k = _keyed(s, d)
    requests = b._view(s, d, "events").filter("event_type = 'click'").select(F.col("ts").cast("timestamp_ntz").alias("requested_at"))
    return ingest.retry_plan(k, ingest.skippable_addresses(ingest.failure_history(k), NOW), requests, "2024-01-20 12:00:00", cap=100_000)


_add("agg_53_retry_plan", _retry, W + f", skip AS (SELECT location_key FROM inc WHERE latitude IS NULL AND location_key <> '' GROUP BY 1 HAVING max(geocode_attempts) >= 3 AND date_trunc('second', max(created_at)) >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) SELECT CAST(row_number() OVER (ORDER BY created_at DESC, incident_number) AS INTEGER) AS rank, incident_number, location_key FROM inc WHERE latitude IS NULL AND geocode_attempts < 3 AND location_key NOT IN (SELECT location_key FROM skip) ORDER BY created_at DESC, incident_number LIMIT 25")

# ---- filters
_F1 = filters.Filters(now=NOW, categories={"accident", "hazard"}, range="7d", day_type="weekday", agencies={"police", "fire"}, bands={"wind": "calm"}, exact_only=True)
_F1_SQL = {"category": "category IN ('accident', 'hazard')", "range": f"best >= TIMESTAMP '{NOW}' - INTERVAL 168 HOUR", "day_type": "isodow(best) < 6", "wind_band": "weather_wind_mph < 10", "agency": "assisting LIKE '%POLICE%'", "exact": "coalesce(geocode_confidence, '') <> 'approximate'"}
_F_ROWS = ", r AS (SELECT *, coalesce(reported_ts, created_at) AS best FROM inc) "
_add("flt_apply_conjunction", lambda s, d: filters.apply_filters(causes.with_agencies(_best(s, d)), _F1).select("incident_number"), W + _F_ROWS + "SELECT incident_number FROM r WHERE " + " AND ".join(_F1_SQL.values()))
_add("flt_facet_sweep", lambda s, d: filters.facet_sweep(causes.with_agencies(_best(s, d)), _F1), W + _F_ROWS + "SELECT count(*) FILTER (" + " AND ".join(_F1_SQL.values()) + ") AS all_facets, " + ", ".join(f"count(*) FILTER ({' AND '.join(v for j, v in _F1_SQL.items() if j != k)}) AS without_{k}" for k in _F1_SQL) + " FROM r")


def _filtered(f: filters.Filters) -> Callable:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = times.with_time_context(_best(s, d), "best_ts").withColumn("n_calls", F.col("event_id") % 3)
        for wanted, prepare in ((f.school_day, lambda x: times.with_school_day(x, "best_ts")), (f.holiday, lambda x: times.with_holiday(x, ts="best_ts")), (f.light, lambda x: times.with_daylight(x, "best_ts")), (f.road_type, roads.with_road_type), (f.road, roads.with_incident_corridors), (f.agencies, causes.with_agencies)):
            if wanted:
                rows = prepare(rows)
        return filters.apply_filters(rows, f).select("incident_number")

    return run


_MIN = "(hour(best) * 60 + minute(best))"
for _name, _f, _sql in (
    ("02_cause", {"cause": "HIT AND RUN"}, "cause = 'HIT AND RUN'"),
    ("03_cause_group", {"cause_group": "other"}, "cause = 'HIT AND RUN'"),
    ("04_today", {"range": "today", "now": "2024-01-20 12:00:00"}, "CAST(best AS DATE) = DATE '2024-01-20'"),
    ("05_dates", {"date_from": "2024-01-05", "date_to": "2024-01-09"}, "CAST(best AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'"),
    ("06_parts", {"month": 1, "day": 7, "year": 2024}, "month(best) = 1 AND day(best) = 7 AND year(best) = 2024"),
    ("08_time_block", {"time_block": "evening"}, "hour(best) BETWEEN 15 AND 18"),
    ("09_hour", {"hour": 8}, "hour(best) = 8"),
    ("10_dow", {"dow": 0}, "dayofweek(best) = 0"),
    ("11_rush", {"rush_hour": True}, RUSH.replace("reported_ts", "best")),
    ("12_school", {"school_day": True}, _school("best")),
    ("13_holiday", {"holiday": True}, "CAST(best AS DATE) IN (DATE '2024-01-01', DATE '2024-01-15')"),
    ("14_light", {"light": "day"}, f"{_MIN} >= 423 AND {_MIN} < 1042"),
    ("15_weather", {"any_weather": True}, "event_id % 13 <> 0"),
    ("16_21_bands", {"bands": {"temp": "mild", "precip_prob": "med", "precip": "moderate", "visibility": "hazy", "cloud": "partly"}}, "weather_temp_f > 50 AND weather_temp_f < 70 AND weather_precip_prob BETWEEN 20 AND 59 AND weather_precip_in > 0.10 AND weather_precip_in < 0.50 AND weather_visibility_mi BETWEEN 3 AND 9 AND weather_cloud_pct BETWEEN 25 AND 69"),
    ("22_alerts", {"alerts": {"flood", "storm"}}, "event_id % 350 = 0"),
    ("23_road_type", {"road_type": "motorway"}, "user_id % 10 = 5"),
    ("24_road", {"road": "KALISTE SALOOM RD"}, "user_id % 10 IN (3, 8)"),
    ("27_search", {"road_search": "kalist salom"}, "user_id % 10 IN (3, 8)"),
    ("28_bounds", {"bounds": (30.17, -92.08, 30.22, -92.03)}, "latitude BETWEEN 30.17 AND 30.22 AND longitude BETWEEN -92.08 AND -92.03"),
    ("29_routine", {"skip_routine": True}, "NOT (cause = 'TRAFFIC CONTROL' AND event_id % 3 > 1)"),
):
    _add(f"flt_{_name}", _filtered(filters.Filters(**_f)), W + _F_ROWS + f"SELECT incident_number FROM r WHERE {_sql}")
_add("flt_30_recent_live", lambda s, d: filters.recent_live(_best(s, d), "2024-01-20 12:00:00").select("incident_number"), W + _F_ROWS + "SELECT incident_number FROM r WHERE best >= TIMESTAMP '2024-01-20 10:00:00' AND best <= TIMESTAMP '2024-01-20 12:00:00' ORDER BY best DESC, incident_number LIMIT 20")

# ---- coverage and crash analytics
_add("agg_16_coverage", lambda s, d: cov_ops.islands(_cov(s, d)), WCOV + "SELECT island, CAST(lo AS VARCHAR) AS lo, CAST(hi AS VARCHAR) AS hi, date_diff('day', lo, hi) + 1 AS days, date_diff('day', lag(hi) OVER (ORDER BY island), lo) - 1 AS gap_before FROM ends")


def _cov_feed(s: SparkSession, d: str) -> DataFrame:
    return cov_ops.coverage(_inc(s, d), "2024-01-30", cov_ops.feed_hours(cov_ops.feed_checks(b.feed_checks(s, d)))).select(F.col("date").cast("string").alias("date"), "is_full")


_add("agg_16_coverage_feed_log", _cov_feed, W + ", f AS (SELECT CAST(ts AS DATE) AS date, count(DISTINCT hour(ts)) AS hours FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT CAST(date AS VARCHAR) AS date, hours >= 22 AND date <> DATE '2024-01-30' AS is_full FROM (SELECT DISTINCT CAST(reported_ts AS DATE) AS date FROM inc WHERE reported_ts IS NOT NULL) JOIN f USING (date)")
_add("agg_17_exposure", lambda s, d: cov_ops.exposure(_cov(s, d)), WCOV + f"SELECT count(*) AS days, count(*) FILTER (isodow(date) < 6) AS weekdays, count(*) FILTER (isodow(date) >= 6) AS weekend_days, count(*) FILTER (is_full) AS full_days, count(*) FILTER (isodow(date) < 6) * 5 AS rush_hours, count(*) * 24 - count(*) FILTER (isodow(date) < 6) * 5 AS other_hours, count(*) FILTER ({_school('date')}) * 24 AS school_hours, count(*) FILTER (NOT {_school('date')}) * 24 AS no_school_hours FROM cov")
_add("agg_18_hour_week_matrix", lambda s, d: insights.hour_week_matrix(_crashes(s, d), _cov(s, d)), WCOV + ", n AS (SELECT isodow(date) - 1 AS dow, hour(reported_ts) AS hour, count(*) AS n FROM crashes JOIN cov ON cov.date = CAST(reported_ts AS DATE) WHERE is_full AND is_crash GROUP BY 1, 2), g AS (SELECT isodow(date) - 1 AS dow, count(*) AS days FROM cov WHERE is_full GROUP BY 1) SELECT CAST(r.range // 24 AS INTEGER) AS dow, CAST(r.range % 24 AS INTEGER) AS hour, coalesce(n, 0) AS n, coalesce(days, 0) AS days, CASE WHEN days > 0 THEN round(coalesce(n, 0) / days, 6) END AS rate FROM range(168) r LEFT JOIN n ON n.dow = r.range // 24 AND n.hour = r.range % 24 LEFT JOIN g ON g.dow = r.range // 24")
_RATE = ", n AS (SELECT {0}(reported_ts) AS k, count(*) AS n FROM crashes WHERE is_crash GROUP BY 1), g AS (SELECT {0}(date) AS k, count(*) AS days FROM cov GROUP BY 1) SELECT CAST(k {1} AS INTEGER) AS {2}, coalesce(n, 0) AS n, days, round(coalesce(n, 0) / days, 6) AS rate FROM g LEFT JOIN n USING (k)"
_add("agg_19_dow_rates", lambda s, d: insights.dow_rates(_crashes(s, d), _cov(s, d)), WCOV + _RATE.format("isodow", "- 1", "dow"))
_add("agg_19_month_rates", lambda s, d: insights.month_rates(_crashes(s, d), _cov(s, d)), WCOV + _RATE.format("month", "", "month"))
_add("agg_20_monthly_series", lambda s, d: cov_ops.monthly_series(_crashes(s, d), _cov(s, d)), WCOV + ", g AS (SELECT strftime(date, '%Y-%m') AS month, count(*) AS days FROM cov WHERE is_full GROUP BY 1), n AS (SELECT strftime(date, '%Y-%m') AS month, count(*) AS n FROM crashes JOIN cov ON date = CAST(reported_ts AS DATE) WHERE is_full AND is_crash GROUP BY 1) SELECT month, days, coalesce(n, 0) AS n, CASE WHEN days >= 5 THEN round(coalesce(n, 0) / days, 6) END AS per_day FROM g LEFT JOIN n USING (month)")
_add("agg_21_daily_calendar", lambda s, d: cov_ops.daily_calendar(_crashes(s, d), _cov(s, d)), WCOV + ", s AS (SELECT CAST(unnest(range((SELECT CAST(min(date) AS TIMESTAMP) FROM cov), (SELECT CAST(max(date) AS TIMESTAMP) FROM cov) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date), n AS (SELECT CAST(reported_ts AS DATE) AS date, count(*) AS n FROM crashes WHERE is_crash GROUP BY 1) SELECT CAST(s.date AS VARCHAR) AS date, coalesce(n, 0) AS n, CASE WHEN is_full THEN 'full' WHEN is_full IS NOT NULL THEN 'partial' ELSE 'none' END AS state FROM s LEFT JOIN cov USING (date) LEFT JOIN n USING (date)")
_KPI = ", e AS (SELECT CAST(max(reported_ts) AS DATE) AS e FROM crashes WHERE is_crash), c AS (SELECT *, date_diff('day', CAST(reported_ts AS DATE), e) AS age FROM crashes, e WHERE is_crash), k AS (SELECT count(*) FILTER ({0}) AS n, count(*) FILTER ({0} AND is_severe) AS severe, count(*) FILTER ({0} AND is_hit_and_run) AS hit_and_run, count(*) FILTER ({1}) AS previous FROM c), f AS (SELECT count(*) FILTER ({2}) AS full_days FROM cov, e WHERE is_full) SELECT n, severe, hit_and_run, previous, full_days, CASE WHEN full_days > 0 THEN round(n / full_days, 6) END AS per_day, round(severe / n, 6) AS severe_share, round(hit_and_run / n, 6) AS hit_and_run_share FROM k, f"
_add("agg_22_kpis_all", lambda s, d: insights.crash_kpis(_crashes(s, d), _cov(s, d)), WCOV + _KPI.format("true", "false", "true"))
_add("agg_22_kpis_90_days", lambda s, d: insights.crash_kpis(_crashes(s, d), _cov(s, d), 90), WCOV + _KPI.format("age < 90", "age >= 90 AND age < 180", "date_diff('day', date, e) < 90"))
_add("agg_23_severity_by_hour", lambda s, d: insights.severity_by_hour(_crashes(s, d)), WC[:-2] + " SELECT hour(reported_ts) AS hour, count(*) AS n, count(*) FILTER (is_severe) AS severe, count(*) FILTER (is_hit_and_run) AS hit_and_run, round(count(*) FILTER (is_severe) / count(*), 6) AS severe_share, round(count(*) FILTER (is_hit_and_run) / count(*), 6) AS hit_and_run_share FROM crashes WHERE is_crash GROUP BY 1 HAVING count(*) >= 20")


def _blocks(s: SparkSession, d: str) -> DataFrame:
    rows = text.with_location_key(causes.with_severity(_inc(s, d))).filter((causes.category(F.col("cause")) == "accident") & F.col("reported_ts").isNotNull())
    return insights.block_ranking(rows, "location_key")


_add("agg_24_block_ranking", _blocks, W + ", h AS (SELECT location_key, hour(reported_ts) AS hour, count(*) AS k FROM inc WHERE category = 'accident' AND reported_ts IS NOT NULL GROUP BY 1, 2), p AS (SELECT location_key, arg_min(hour, (-k, hour)) AS peak_hour FROM h GROUP BY 1) SELECT location_key, count(*) AS n, count(*) FILTER (cause LIKE '%MAJOR') AS severe, count(*) FILTER (cause = 'HIT AND RUN') AS hit_and_run, round(avg(latitude), 5) AS latitude, round(avg(longitude), 5) AS longitude, any_value(peak_hour) AS peak_hour FROM inc JOIN p USING (location_key) WHERE category = 'accident' AND reported_ts IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, location_key LIMIT 12")


def _road_crashes(s: SparkSession, d: str) -> DataFrame:
    return causes.with_severity(_roads(s, d)).filter(causes.category(F.col("cause")) == "accident")


_ROADN = ", r AS (SELECT unnest(corridors) AS road, cause LIKE '%MAJOR' AS sev, reported_ts FROM inc WHERE category = 'accident')"
_add("agg_25_road_ranking", lambda s, d: insights.road_ranking(_road_crashes(s, d)), W + _ROADN + " SELECT road, count(*) AS n, count(*) FILTER (sev) AS severe, round(count(*) FILTER (sev) / count(*), 6) AS severe_share FROM r GROUP BY 1")
_STATS = """, own AS (SELECT route_id, from_mi, to_mi, CASE WHEN full_name LIKE 'Amb%' THEN 'AMBASSADOR CAFFERY PKWY' ELSE replace(upper(full_name), 'STREET', 'ST') END AS road, regexp_replace(route_id, '_[12]_1_010$', '') AS base FROM segs WHERE route_id LIKE '%\\_1\\_010' ESCAPE '\\' AND full_name NOT LIKE 'Proposed%'),
 mi AS (SELECT road, base, route_id, sum(to_mi - from_mi) AS miles FROM own GROUP BY 1, 2, 3), lap AS (SELECT road, o.route_id, sum(least(o.to_mi, c.to_mi) - greatest(o.from_mi, c.from_mi)) AS counted, sum((least(o.to_mi, c.to_mi) - greatest(o.from_mi, c.from_mi)) * aadt) AS traffic FROM own o JOIN counts c ON o.route_id = c.route_id AND o.from_mi < c.to_mi AND c.from_mi < o.to_mi WHERE aadt IS NOT NULL GROUP BY 1, 2),
 pr AS (SELECT road, base, max(miles) AS miles, max(coalesce(traffic, 0)) AS traffic, max(coalesce(counted, 0)) AS counted FROM mi LEFT JOIN lap USING (road, route_id) GROUP BY 1, 2), tot AS (SELECT road, sum(miles) AS miles, sum(traffic) AS traffic, sum(counted) AS counted FROM pr GROUP BY 1),
 stats AS (SELECT road, round(miles, 3) AS miles, round(CASE WHEN counted >= 0.6 * miles THEN traffic / counted * miles ELSE 0 END, 1) AS vehicle_miles FROM tot WHERE miles >= 0.05)"""
_add("agg_47_road_stats", lambda s, d: roadstats.road_stats(*b.road_tables(s, d)), "WITH " + b.SEGMENTS + _STATS + " SELECT * FROM stats")
_add("jn_11_overlap_segments", lambda s, d: roadstats.overlap_totals(*b.road_tables(s, d)).select("route_id", "n", F.round("counted", 4).alias("miles")), "WITH " + b.SEGMENTS + " SELECT s.route_id, count(*) AS n, round(sum(least(s.to_mi, c.to_mi) - greatest(s.from_mi, c.from_mi)), 4) AS miles FROM segs s JOIN counts c ON s.route_id = c.route_id AND s.from_mi < c.to_mi AND c.from_mi < s.to_mi WHERE aadt IS NOT NULL GROUP BY 1")
_add("agg_26_risk_ranking", lambda s, d: insights.risk_ranking(_road_crashes(s, d), roadstats.road_stats(*b.road_tables(s, d)), 30, 10, 1.0, 1.0), W + _ROADN + ", " + b.SEGMENTS + _STATS + " SELECT road, n, miles, vehicle_miles, round(n / (vehicle_miles * 30) * 1e6, 6) AS risk FROM (SELECT road, count(*) AS n FROM r GROUP BY 1) JOIN stats USING (road) WHERE n >= 10 AND miles >= 1 AND vehicle_miles / miles >= 1")
_add("jn_12_road_join", lambda s, d: insights.road_ranking(_road_crashes(s, d), roadstats.road_stats(*b.road_tables(s, d))), W + _ROADN + ", " + b.SEGMENTS + _STATS + " SELECT road, n, severe, severe_share, miles, vehicle_miles, CASE WHEN miles > 0 THEN round(n / miles, 6) END AS per_mile FROM (SELECT road, count(*) AS n, count(*) FILTER (sev) AS severe, round(count(*) FILTER (sev) / count(*), 6) AS severe_share FROM r GROUP BY 1) LEFT JOIN stats USING (road)")


def _hours(s: SparkSession, d: str) -> DataFrame:
    return hourly.merge_hours(b.weather_obs(s, d), ("obs_ts", "l_orderkey", "seq", "temp_f"))


_MERGE = ", m AS (SELECT date_trunc('hour', obs_ts) AS hour, arg_max(temp_f, (obs_ts, l_orderkey, seq, temp_f)) AS temp_f, max(precip_in) AS precip_in, min(visibility_mi) AS visibility_mi, max(wind_mph) AS wind_mph, coalesce(string_agg(DISTINCT wx, ' ' ORDER BY wx) FILTER (wx <> ''), '') AS wx FROM weather_obs GROUP BY 1)"
_add("agg_15_merge_hours", lambda s, d: _hours(s, d).select(_ts("hour"), "temp_f", F.round("precip_in", 6).alias("precip_in"), "visibility_mi", F.round("wind_mph", 6).alias("wind_mph"), "wx"), "WITH " + b.WEATHER + _MERGE + f" SELECT {_dts('hour')}, temp_f, round(precip_in, 6) AS precip_in, visibility_mi, round(wind_mph, 6) AS wind_mph, wx FROM m")
_add("snk_06_weather_hours", lambda s, d: hourly.export_weather_hours(_hours(s, d)), "WITH " + b.WEATHER + _MERGE + f", s AS (SELECT unnest(range((SELECT min(hour) FROM m), (SELECT max(hour) FROM m) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour) SELECT strftime(min(s.hour), '%Y-%m-%dT%H') AS start, string_agg(CASE WHEN m.hour IS NULL THEN '-' ELSE {_CODE} END, '' ORDER BY s.hour) AS codes FROM s LEFT JOIN m ON m.hour = s.hour")
# Ranges by recursion: each begins with the first missing day behind the one before.
_BACKFILL = ", s0 AS (SELECT unnest(range((SELECT min(hour) FROM m), (SELECT max(hour) FROM m) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour), g0 AS (SELECT CAST(hour AS DATE) AS day, count(*) AS hours FROM s0 WHERE hour NOT IN (SELECT hour FROM m) GROUP BY 1), r(first_day) AS (SELECT min(day) FROM g0 UNION ALL SELECT (SELECT min(day) FROM g0 WHERE day >= r.first_day + 120) FROM r WHERE r.first_day IS NOT NULL)"
_add("agg_51_backfill_ranges", lambda s, d: hourly.backfill_ranges(_hours(s, d)), "WITH RECURSIVE " + b.WEATHER + _MERGE + _BACKFILL + " SELECT strftime(first_day, '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day, CAST(sum(hours) AS BIGINT) AS hours FROM r JOIN g0 ON day >= first_day AND day < first_day + 120 GROUP BY r.first_day")
_add("agg_51_missing_hours", lambda s, d: hourly.missing_hours(_hours(s, d)), "WITH " + b.WEATHER + _MERGE + f", s AS (SELECT unnest(range((SELECT min(hour) FROM m), (SELECT max(hour) FROM m) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour), g AS (SELECT hour, hour - INTERVAL 1 HOUR * row_number() OVER (ORDER BY hour) AS run FROM s WHERE hour NOT IN (SELECT hour FROM m)) SELECT {_dts('min(hour)', 'lo')}, {_dts('max(hour)', 'hi')}, count(*) AS hours FROM g GROUP BY run")
_add("jn_10_weather_hours", lambda s, d: weather.with_condition_code(hourly.join_weather_hours(_crashes(s, d), _hours(s, d))).groupBy("code").agg(F.count(F.lit(1)).alias("n")), WC + b.WEATHER + _MERGE + f" SELECT coalesce({_CODE.replace('wx', 'm.wx')}, '-') AS code, count(*) AS n FROM crashes LEFT JOIN m ON m.hour = date_trunc('hour', reported_ts) WHERE is_crash GROUP BY 1")


def _effect(s: SparkSession, d: str) -> DataFrame:
    return insights.weather_effect(_crashes(s, d), _cov(s, d), weather.with_condition_code(_hours(s, d)).select("hour", "code"))


_add("agg_27_weather_effect", _effect, WCOV + ", " + b.WEATHER + _MERGE + f""", h AS (SELECT hour, {_CODE} AS code FROM m WHERE CAST(hour AS DATE) IN (SELECT date FROM cov)), n AS (SELECT date_trunc('hour', reported_ts) AS hour, count(*) AS n FROM crashes WHERE is_crash GROUP BY 1),
 g AS (SELECT (isodow(h.hour) - 1) * 24 + hour(h.hour) AS slot, code, count(*) AS hours, sum(coalesce(n, 0)) AS n FROM h LEFT JOIN n ON n.hour = h.hour WHERE code <> '-' GROUP BY 1, 2), dry AS (SELECT slot, n / hours AS rate FROM g WHERE code = 'd' AND hours >= 5), k(code, kind) AS (VALUES ('h', 'wet'), ('h', 'heavy'), ('r', 'wet'), ('f', 'fog'))
 SELECT kind, CAST(sum(hours) AS BIGINT) AS hours, CAST(sum(n) AS BIGINT) AS observed, round(sum(hours * rate), 6) AS expected, round(CASE WHEN sum(hours * rate) > 0 THEN sum(n) / sum(hours * rate) END, 6) AS ratio FROM g JOIN dry USING (slot) JOIN k USING (code) GROUP BY 1""")
_DARK = """, g AS (SELECT date, CAST(r.range AS INTEGER) AS hour, (dayofyear(date) - 81) * 2 * pi() / 364 AS b, date >= make_date(year(date), 3, 1) + CAST(7 + (7 - isodow(make_date(year(date), 3, 1))) % 7 AS INTEGER) AND date < make_date(year(date), 11, 1) + CAST((7 - isodow(make_date(year(date), 11, 1))) % 7 AS INTEGER) AS summer FROM cov, range(24) r),
 a AS (SELECT date, hour, 720 + 4 * 92.0198 - (9.87 * sin(2 * b) - 7.53 * cos(b) - 1.5 * sin(b)) + CASE WHEN summer THEN -300 ELSE -360 END AS noon, radians(23.45 * sin(b)) AS decl FROM g), h AS (SELECT date, hour, noon, 4 * degrees(acos(greatest(-1, least(1, (sin(radians(-0.833)) - sin(radians(30.2241)) * sin(decl)) / (cos(radians(30.2241)) * cos(decl)))))) AS half FROM a),
 l AS (SELECT date, hour, CASE WHEN hour * 60 >= noon - half AND hour * 60 + 60 <= noon + half THEN 'light' WHEN hour * 60 + 60 <= noon - half - 30 OR hour * 60 >= noon + half + 30 THEN 'dark' ELSE 'twilight' END AS light FROM h),
 n AS (SELECT CAST(reported_ts AS DATE) AS date, hour(reported_ts) AS hour, count(*) AS n FROM crashes WHERE is_crash GROUP BY 1, 2), t AS (SELECT l.hour, count(*) FILTER (light = 'dark') AS dh, coalesce(sum(n) FILTER (light = 'dark'), 0) AS dn, count(*) FILTER (light = 'light') AS lh, coalesce(sum(n) FILTER (light = 'light'), 0) AS ln FROM l LEFT JOIN n ON n.date = l.date AND n.hour = l.hour GROUP BY 1), q AS (SELECT * FROM t WHERE dh >= 20 AND lh >= 20)
 SELECT CAST(sum(dn) AS BIGINT) AS dark_n, CAST(sum(dh) AS BIGINT) AS dark_hours, CAST(sum(ln) AS BIGINT) AS light_n, CAST(sum(lh) AS BIGINT) AS light_hours, round(sum(dh * ln / lh), 6) AS expected, round(CASE WHEN sum(dh * ln / lh) > 0 THEN sum(dn) / sum(dh * ln / lh) END, 6) AS ratio FROM q"""
_add("agg_28_darkness_effect", lambda s, d: insights.darkness_effect(_crashes(s, d), _cov(s, d)), WCOV + _DARK)


_FOLLOW = W + """, p AS (SELECT *, epoch(reported_ts) AS t FROM inc WHERE category = 'accident' AND reported_ts IS NOT NULL AND latitude IS NOT NULL),
 fo AS (SELECT DISTINCT b.incident_number, CAST(v.s AS INTEGER) AS shift FROM (VALUES (0), (7)) v(s) JOIN p a ON true JOIN p b ON b.t BETWEEN a.t + v.s * 86400 + 180 AND a.t + v.s * 86400 + 2700 AND a.incident_number <> b.incident_number AND sqrt(pow((b.longitude - a.longitude) * cos(radians(a.latitude)) * 111320.0, 2) + pow((b.latitude - a.latitude) * 111320.0, 2)) <= 500)"""


def _accidents(s: SparkSession, d: str) -> DataFrame:
    return _inc(s, d).filter((causes.category(F.col("cause")) == "accident") & F.col("reported_ts").isNotNull())


_add("jn_15_followers", lambda s, d: insights.followers(_accidents(s, d), shifts=(0, 7)), _FOLLOW + " SELECT incident_number, shift FROM fo")
_add("agg_29_follow_on_share", lambda s, d: insights.follow_on_share(_accidents(s, d)), _FOLLOW + """, e AS (SELECT p.*, t - 604800 - 2700 >= min(t) OVER () AS full_week FROM p), c AS (SELECT (SELECT count(*) FROM e) AS n, (SELECT count(*) FROM fo WHERE shift = 0) AS following, (SELECT count(*) FROM e WHERE full_week) AS eligible, (SELECT count(*) FROM fo JOIN e USING (incident_number) WHERE shift = 7 AND full_week) AS control)
 SELECT n, following, eligible, control, round(following / n, 6) AS share, round(control / eligible, 6) AS control_share FROM c""")


def _upgraded(s: SparkSession, d: str) -> DataFrame:
    ep = causes.with_upgrade_flag(ep_ops.episodes(_inc(s, d)))
    return insights.upgraded_share(ep.withColumn("is_severe", causes.severe(F.col("cause"))))


_add("agg_30_upgraded_share", _upgraded, W + "," + _EP.replace("TS", "reported_ts") + " SELECT count(*) AS severe, count(*) FILTER (EXISTS (SELECT 1 FROM ranked x WHERE x.location_key = r.location_key AND x.no = r.no AND x.rk > 1 AND x.severity < r.severity AND x.reported_ts < r.reported_ts)) AS upgraded FROM ranked r WHERE rk = 1 AND cause LIKE '%MAJOR'")
def _long_roads(s: SparkSession, d: str, moved: Column | None = None) -> DataFrame:
    """Long crashes with a road each, named by the order's customer; those for which ``moved`` holds are on the third."""
    named = F.element_at(F.array(*map(F.lit, b.LONG_ROADS)), F.col("road_no") % 4 + 1)
    return _crashes(s, d).withColumn("corridors", F.array(named if moved is None else F.when(moved, b.LONG_ROADS[2]).otherwise(named)))


#: Crashes of the second road that were on the third in the years before, so that the second has a trend.
_MOVED = "road_no % 4 = 1 AND reported_ts < TIMESTAMP '2001-01-01 00:00:00' AND o_orderkey % 2 = 1"


_LONG = WC + "r AS (SELECT *, CASE road_no % 4 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(b.LONG_ROADS)) + " END AS road FROM crashes WHERE is_crash)"
_add("agg_26_risk_ranking_default", lambda s, d: insights.risk_ranking(_long_roads(s, d), roadstats.road_stats(*b.road_tables(s, d)), 2406), _LONG + ", " + b.SEGMENTS + _STATS + " SELECT road, n, miles, vehicle_miles, round(n / (vehicle_miles * 2406) * 1e6, 6) AS risk FROM (SELECT road, count(*) AS n FROM r GROUP BY 1) JOIN stats USING (road) WHERE n >= 40 AND miles >= 1 AND vehicle_miles / miles >= 5000")
_add("agg_31_trending_roads_default", lambda s, d: insights.trending_roads(_long_roads(s, d, F.expr(_MOVED)), LONG_NOW), _LONG + f", a AS (SELECT road, date_diff('second', reported_ts, TIMESTAMP '{LONG_NOW}') / 86400.0 AS age FROM (SELECT * REPLACE (CASE WHEN {_MOVED} THEN '{b.LONG_ROADS[2]}' ELSE road END AS road) FROM r)), t AS (SELECT road, count(*) FILTER (age <= 60) AS recent, count(*) FILTER (age > 60) AS earlier FROM a GROUP BY 1), q AS (SELECT road, recent, earlier, round(recent / (60 / 7.0::DOUBLE), 6) AS recent_week, round(earlier / (((SELECT max(age) FROM a) - 60) / 7), 6) AS earlier_week, round((recent / (60 / 7.0::DOUBLE)) / (earlier / (((SELECT max(age) FROM a) - 60) / 7)), 6) AS ratio FROM t WHERE recent >= 20 AND earlier >= 20) SELECT * FROM q WHERE ratio >= 1.25 ORDER BY ratio DESC, road LIMIT 15")
_add("agg_31_trending_roads", lambda s, d: insights.trending_roads(_road_crashes(s, d), NOW, days=10, least=5, ratio=0.5), W + _ROADN + f", a AS (SELECT road, date_diff('second', reported_ts, TIMESTAMP '{NOW}') / 86400.0 AS age FROM r WHERE reported_ts IS NOT NULL), t AS (SELECT road, count(*) FILTER (age <= 10) AS recent, count(*) FILTER (age > 10) AS earlier FROM a GROUP BY 1), q AS (SELECT road, recent, earlier, round(recent / (10 / 7.0::DOUBLE), 6) AS recent_week, round(earlier / (((SELECT max(age) FROM a) - 10) / 7), 6) AS earlier_week, round((recent / (10 / 7.0::DOUBLE)) / (earlier / (((SELECT max(age) FROM a) - 10) / 7)), 6) AS ratio FROM t WHERE recent >= 5 AND earlier >= 5) SELECT * FROM q WHERE ratio >= 0.5 ORDER BY ratio DESC, road LIMIT 15")


def _events(s: SparkSession, d: str) -> DataFrame:
    return insights.event_effect(_crashes(s, d), _cov(s, d), times.event_calendar(s, 1995, 2001).filter("event IN ('Christmas', 'Independence Day', 'Halloween', 'New Year')"))


_add("agg_32_event_effect", _events, WCOV + ", n AS (SELECT isodow(reported_ts) AS k, count(*) AS n FROM crashes WHERE is_crash GROUP BY 1), g AS (SELECT isodow(date) AS k, count(*) AS days FROM cov GROUP BY 1), u AS (SELECT k, coalesce(n, 0) / days AS usual FROM g LEFT JOIN n USING (k)), ev AS (SELECT date, CASE WHEN month(date) = 12 AND day(date) IN (24, 25) THEN 'Christmas' WHEN month(date) = 12 AND day(date) = 31 THEN 'New Year' WHEN month(date) = 7 AND day(date) = 4 THEN 'Independence Day' WHEN month(date) = 10 AND day(date) = 31 THEN 'Halloween' END AS event FROM cov), c AS (SELECT CAST(reported_ts AS DATE) AS date, count(*) AS n FROM crashes WHERE is_crash GROUP BY 1) SELECT event, count(*) AS days, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS observed, round(sum(usual), 6) AS expected, round(sum(coalesce(c.n, 0)) / sum(usual), 6) AS ratio FROM ev LEFT JOIN c USING (date) JOIN u ON u.k = isodow(ev.date) WHERE event IS NOT NULL GROUP BY 1")
#: Easter Sundays of the crash table's years, from a calendar.
_EASTER = ["1995-04-16", "1996-04-07", "1997-03-30", "1998-04-12", "1999-04-04", "2000-04-23", "2001-04-15"]
_EVENTS = ", e(d) AS (VALUES " + ", ".join(f"(DATE '{x}')" for x in _EASTER) + """), days AS (SELECT DISTINCT CAST(reported_ts AS DATE) AS date FROM crashes), f AS (SELECT date, make_date(year(date), 5, 1) + CAST((7 - isodow(make_date(year(date), 5, 1))) % 7 AS INTEGER) AS may FROM days)
 SELECT CAST(date AS VARCHAR) AS date, 'Easter' AS event FROM days JOIN e ON date = d UNION ALL SELECT CAST(date AS VARCHAR), 'Mardi Gras' FROM days JOIN e ON date = d - 47 UNION ALL SELECT CAST(date AS VARCHAR), 'Mardi Gras weekend' FROM days JOIN e ON date BETWEEN d - 51 AND d - 48
 UNION ALL SELECT CAST(date AS VARCHAR), 'Festival' FROM f WHERE date BETWEEN may - 11 AND may - 7
 UNION ALL SELECT CAST(date AS VARCHAR), CASE isodow(date) WHEN 4 THEN 'Thanksgiving' ELSE 'Black Friday' END FROM days WHERE month(date) = 11 AND (isodow(date) = 4 AND day(date) BETWEEN 22 AND 28 OR isodow(date) = 5 AND day(date) BETWEEN 23 AND 29)
 UNION ALL SELECT CAST(date AS VARCHAR), CASE WHEN month(date) = 12 AND day(date) = 31 THEN 'New Year' WHEN month(date) = 12 THEN 'Christmas' WHEN month(date) = 7 THEN 'Independence Day' ELSE 'Halloween' END FROM days WHERE month(date) = 12 AND day(date) IN (24, 25, 31) OR month(date) = 7 AND day(date) = 4 OR month(date) = 10 AND day(date) = 31"""
_add("prj_11_event_calendar", lambda s, d: b.crashes_long(s, d).select(F.to_date("reported_ts").alias("date")).distinct().join(times.event_calendar(s, 1995, 2001), "date").select(F.col("date").cast("string").alias("date"), "event"), WC[:-2] + _EVENTS)
_add("agg_32_school_effect", lambda s, d: insights.school_effect(_crashes(s, d), _cov(s, d)), WCOV + f", g AS (SELECT date, {_school('date')} AS school FROM cov WHERE isodow(date) < 6), n AS (SELECT CAST(reported_ts AS DATE) AS date, count(*) AS n FROM crashes WHERE is_crash GROUP BY 1), t AS (SELECT count(*) FILTER (school) AS school_days, CAST(sum(coalesce(n, 0)) FILTER (school) AS BIGINT) AS school_n, count(*) FILTER (NOT school) AS other_days, CAST(sum(coalesce(n, 0)) FILTER (NOT school) AS BIGINT) AS other_n FROM g LEFT JOIN n USING (date)) SELECT *, round((school_n / school_days) / (other_n / other_days), 6) AS ratio FROM t")
_add("agg_33_recurring_calls", lambda s, d: insights.recurring_calls(text.with_location_key(causes.with_category(_roads(s, d)))), W + ", p AS (SELECT 'signal' AS kind, location_key AS place FROM inc WHERE category = 'control' AND location_key <> '' UNION ALL SELECT CASE category WHEN 'vehicle' THEN 'stall' ELSE 'hazard' END AS kind, unnest(corridors) AS place FROM inc WHERE category IN ('vehicle', 'hazard')), q AS (SELECT kind, place, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, place) AS rank FROM p GROUP BY 1, 2 HAVING count(*) >= 2) SELECT * FROM q WHERE rank <= 6")
_add("agg_34_agency_load", lambda s, d: insights.agency_load(causes.with_agencies(_inc(s, d))), W + "SELECT agency, hour(reported_ts) AS hour, count(*) AS n FROM (SELECT lower(unnest(string_split(assisting, ' '))) AS agency, reported_ts FROM inc WHERE assisting <> '' AND reported_ts IS NOT NULL) GROUP BY 1, 2")
_add("agg_34_area_table", lambda s, d: insights.area_table(text.with_place_parts(causes.with_severity(_inc(s, d)).filter(causes.category(F.col("cause")) == "accident").withColumn("location", F.upper("location")))), W + "SELECT town, n, severe, hit_and_run, round(severe / n, 6) AS severe_share, round(hit_and_run / n, 6) AS hit_and_run_share FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'Lafayette' WHEN 1 THEN 'Broussard' ELSE 'Parish' END AS town, count(*) AS n, count(*) FILTER (cause LIKE '%MAJOR') AS severe, count(*) FILTER (cause = 'HIT AND RUN') AS hit_and_run FROM inc WHERE category = 'accident' AND (user_id % 10 <> 9 OR user_id % 3 = 2) GROUP BY 1) WHERE n >= 20 ORDER BY n DESC, town LIMIT 8")
_add("agg_35_feed_time", lambda s, d: insights.feed_time_quartiles(_crashes(s, d), "cause", "visible_min"), WC[:-2] + " SELECT cause, count(*) AS n, median(visible_min) AS median, list_sort(list(visible_min))[least(count(*), CAST(floor(count(*) * 0.25) AS BIGINT) + 1)] AS q1, list_sort(list(visible_min))[least(count(*), CAST(floor(count(*) * 0.75) AS BIGINT) + 1)] AS q3 FROM crashes WHERE is_crash GROUP BY 1 HAVING count(*) >= 15")
_TODAY = "2001-07-18 15:30:00"
_add("agg_36_today_vs_norm", lambda s, d: insights.today_vs_norm(_crashes(s, d), _cov(s, d), _TODAY), WCOV + ", n AS (SELECT CAST(reported_ts AS DATE) AS date, count(*) AS n FROM crashes WHERE is_crash AND hour(reported_ts) * 60 + minute(reported_ts) <= 930 GROUP BY 1), v AS (SELECT list_sort(list(coalesce(n, 0))) AS v, count(*) AS days FROM cov LEFT JOIN n USING (date) WHERE is_full AND date < DATE '2001-07-18' AND isodow(date) = isodow(DATE '2001-07-18')), q AS (SELECT (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM n WHERE date = DATE '2001-07-18') AS today, days, list_median(v) AS median, v[least(days, CAST(floor(days * 0.1) AS BIGINT) + 1)] AS low, v[least(days, CAST(floor(days * 0.9) AS BIGINT) + 1)] AS high FROM v) SELECT today, days, median, low, high, CASE WHEN days < 6 THEN 'unknown' WHEN today < low THEN 'quiet' WHEN today > high THEN 'busy' ELSE 'usual' END AS verdict FROM q".replace("list_median(v)", "list_aggregate(v, 'median')"))
_add("agg_37_trend", lambda s, d: panels.trend(_inc(s, d), NOW), W + f", n AS (SELECT CAST(floor(floor(date_diff('second', reported_ts, TIMESTAMP '{NOW}') / 60) / 60) AS INTEGER) AS bin, count(*) AS n FROM inc WHERE reported_ts IS NOT NULL AND date_diff('second', reported_ts, TIMESTAMP '{NOW}') BETWEEN 0 AND 86399 GROUP BY 1), t AS (SELECT CAST(r.range AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(24) r LEFT JOIN n ON n.bin = r.range) SELECT bin, n, n - lag(n) OVER (ORDER BY bin DESC) AS change FROM t")
_add("agg_38_stat_tiles", lambda s, d: panels.stat_tiles(_best(s, d), NOW), W + _F_ROWS + "SELECT " + ", ".join(f"count(*) FILTER (best >= TIMESTAMP '{NOW}' - INTERVAL {h} HOUR) AS {n}" for h, n in ((24, "last_24h"), (168, "last_7d"), (720, "last_30d"))) + ", count(*) AS total FROM r")
_add("agg_39_category_mix", lambda s, d: panels.category_mix(b.incidents(s, d)), W + "SELECT category, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT category, count(*) AS n FROM inc GROUP BY 1)")
_add("agg_40_data_quality", lambda s, d: panels.data_quality(b.incidents(s, d)), W + "SELECT count(latitude) AS located, count(*) FILTER (latitude IS NULL AND geocode_attempts < 3) AS locating, count(*) FILTER (latitude IS NULL AND geocode_attempts >= 3) AS unmappable, count(*) FILTER (latitude IS NOT NULL AND event_id % 3 = 0) AS exact, count(*) FILTER (latitude IS NOT NULL AND event_id % 3 = 1) AS approximate, count(*) FILTER (latitude IS NOT NULL AND event_id % 3 = 2) AS untracked FROM inc")
_NR = ", n AS (SELECT " + ", ".join(f"count(*) FILTER ({e}) AS {k}_n" for k, e in (("rush", RUSH), ("other", "NOT " + RUSH), ("weekday", "isodow(reported_ts) < 6"), ("weekend", "isodow(reported_ts) >= 6"), ("school", _school("reported_ts")), ("no_school", "NOT " + _school("reported_ts")))) + " FROM crashes WHERE is_crash)"
_add("agg_41_normalised_rates", lambda s, d: insights.normalised_rates(_crashes(s, d), _cov(s, d)), WCOV + _NR + f", x AS (SELECT count(*) FILTER (isodow(date) < 6) AS wd, count(*) FILTER (isodow(date) >= 6) AS we, count(*) FILTER ({_school('date')}) * 24 AS sh, count(*) FILTER (NOT {_school('date')}) * 24 AS nh, count(*) AS d FROM cov) SELECT n.*, round(rush_n / (wd * 5), 6) AS rush_rate, round(other_n / (d * 24 - wd * 5), 6) AS other_rate, round(weekday_n / wd, 6) AS weekday_rate, round(weekend_n / we, 6) AS weekend_rate, round(school_n / sh, 6) AS school_rate, round(no_school_n / nh, 6) AS no_school_rate FROM n, x")
_TOP = "(SELECT '{0}' AS what, k AS value, n FROM (SELECT CAST({1} AS VARCHAR) AS k, count(*) AS n FROM {2} WHERE {1} IS NOT NULL GROUP BY 1) ORDER BY n DESC, k LIMIT 1)"
_add("agg_42_smart_summary", lambda s, d: panels.smart_summary(_roads(s, d)), W + ", u AS (SELECT unnest(corridors) AS road FROM inc) " + " UNION ALL ".join(_TOP.format(*x) for x in (("peak_hour", "strftime(reported_ts, '%H')", "inc"), ("busiest_day", "(isodow(reported_ts) - 1)", "inc"), ("category", "category", "inc"), ("road", "road", "u"))))
_add("agg_43_road_profile", lambda s, d: panels.road_profile(_roads(s, d), "KALISTE SALOOM RD", NOW), W + f", a AS (SELECT *, date_diff('second', reported_ts, TIMESTAMP '{NOW}') / 86400.0 AS age FROM inc WHERE user_id % 10 IN (3, 8)) SELECT 'KALISTE SALOOM RD' AS road, count(*) AS total, count(*) FILTER (category = 'accident') AS crashes, count(*) FILTER (age BETWEEN 0 AND 30) AS last_30, count(*) FILTER (age > 30 AND age <= 60) AS previous_30 FROM a")
_add("agg_44_facet_counts", lambda s, d: panels.facet_counts(_inc(s, d)), W + "SELECT 'cause' AS facet, cause AS value, count(*) AS n FROM inc GROUP BY 2 UNION ALL SELECT 'agency', lower(a), count(*) FROM (SELECT unnest(string_split(assisting, ' ')) AS a FROM inc WHERE assisting <> '') GROUP BY 2 UNION ALL SELECT 'year', CAST(year(reported_ts) AS VARCHAR), count(*) FROM inc WHERE reported_ts IS NOT NULL GROUP BY 2 UNION ALL SELECT 'month', CAST(month(reported_ts) AS VARCHAR), count(*) FROM inc WHERE reported_ts IS NOT NULL GROUP BY 2")
_add("agg_45_unlocated", lambda s, d: panels.unlocated(b.incidents(s, d)), W + f"SELECT incident_number, {_dts('created_at')}, CASE WHEN geocode_attempts >= 3 THEN 'unmappable' ELSE 'locating' END AS state FROM inc WHERE latitude IS NULL ORDER BY date_trunc('second', inc.created_at) DESC, incident_number LIMIT 50")
_add("agg_46_extent", lambda s, d: panels.extent(b.incidents(s, d)), W + "SELECT round(avg(latitude), 6) AS centre_lat, round(avg(longitude), 6) AS centre_lon, round(floor(round((min(latitude) - 0.02) / 0.05, 9)) * 0.05, 6) AS south, round(ceil(round((max(latitude) + 0.02) / 0.05, 9)) * 0.05, 6) AS north, round(floor(round((min(longitude) - 0.02) / 0.05, 9)) * 0.05, 6) AS west, round(ceil(round((max(longitude) + 0.02) / 0.05, 9)) * 0.05, 6) AS east FROM inc WHERE latitude IS NOT NULL")
_add("agg_50_archive_status", lambda s, d: panels.archive_status(_inc(s, d)), W + f"SELECT {_dts('max(created_at)', 'newest')}, {_dts('min(reported_ts)', 'first_incident')}, count(*) AS n, arg_max(incident_number, (created_at, incident_number)) FILTER (weather_temp_f IS NOT NULL) AS latest_weather FROM inc")
_add("agg_56_in_view", lambda s, d: panels.in_view(b.incidents(s, d), 30.17, -92.08, 30.22, -92.03).agg(F.count(F.lit(1)).alias("n")), W + "SELECT count(*) AS n FROM inc WHERE latitude BETWEEN 30.17 AND 30.22 AND longitude BETWEEN -92.08 AND -92.03")
_add("feed_page", lambda s, d: panels.feed_page(_best(s, d), NOW).select("incident_number", "bucket", "location_state"), W + _F_ROWS + f"SELECT incident_number, CASE WHEN latitude IS NOT NULL THEN 'located' WHEN geocode_attempts >= 3 THEN 'unmappable' ELSE 'locating' END AS location_state, CASE WHEN date_diff('day', CAST(best AS DATE), DATE '2024-01-31') <= 0 THEN 'Today' WHEN date_diff('day', CAST(best AS DATE), DATE '2024-01-31') = 1 THEN 'Yesterday' ELSE 'This week' END AS bucket FROM r ORDER BY best DESC, incident_number LIMIT 30")


# ---- geography
def _snapped(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = b.road_network(s, d)
    return roadstats.snap_to_node(b.incidents(s, d).filter("latitude IS NOT NULL"), edges, nodes)


_SNAP = """, deg AS (SELECT node_id, count(*) AS degree FROM (SELECT u AS node_id FROM edges UNION ALL SELECT v FROM edges) GROUP BY 1), e AS (SELECT edges.*, a.lat AS ulat, a.lon AS ulon, c.lat AS vlat, c.lon AS vlon, da.degree AS ud, dc.degree AS vd FROM edges JOIN nodes a ON a.node_id = u JOIN nodes c ON c.node_id = v JOIN deg da ON da.node_id = u JOIN deg dc ON dc.node_id = v),
 pt AS (SELECT DISTINCT latitude AS la, longitude AS lo FROM inc WHERE latitude IS NOT NULL), x AS (SELECT *, (ulon - lo) * cos(radians(la)) * 111320.0 AS ax, (ulat - la) * 111320.0 AS ay, (vlon - lo) * cos(radians(la)) * 111320.0 AS bx, (vlat - la) * 111320.0 AS cy FROM pt, e WHERE abs(ulat - la) < 0.02 AND abs(ulon - lo) < 0.02),
 t AS (SELECT *, greatest(0, least(1, -(ax * (bx - ax) + ay * (cy - ay)) / ((bx - ax) * (bx - ax) + (cy - ay) * (cy - ay)))) AS t FROM x), q AS (SELECT *, round(sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (cy - ay), 2)), 3) AS d FROM t),
 k AS (SELECT *, row_number() OVER (PARTITION BY la, lo ORDER BY d, u, v) AS rn FROM q WHERE d <= 800), sn AS (SELECT la AS latitude, lo AS longitude, d AS metres, u, v, road_class, CASE WHEN greatest(ud, vd) >= 3 THEN CASE WHEN ud >= vd THEN u ELSE v END END AS node_id FROM k WHERE rn = 1)"""
_add("jn_16_snap_to_node", _snapped, W + ", " + b.ROADNET + _SNAP + " SELECT * FROM sn")
_add("agg_06_intersections", lambda s, d: roadstats.intersection_counts(b.incidents(s, d), _snapped(s, d)), W + ", " + b.ROADNET + _SNAP + " SELECT node_id, count(*) AS n FROM inc JOIN sn USING (latitude, longitude) WHERE node_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, node_id LIMIT 100")
_add("jn_17_road_class_by_edge", lambda s, d: roadstats.road_class_by_edge(roads.with_road_type(b.incidents(s, d)), _snapped(s, d)), W + ", " + b.ROADNET + _SNAP + ", r AS (SELECT *, CASE WHEN user_id % 10 = 5 THEN 'motorway' WHEN user_id % 10 = 6 THEN 'trunk' WHEN user_id % 10 IN (0, 1, 2, 3, 4, 7, 8) THEN 'primary' END AS road_type FROM inc) SELECT incident_number, road_type AS old_class, road_class AS new_class FROM r JOIN sn USING (latitude, longitude) WHERE road_type IS DISTINCT FROM road_class")
ROUTE = [(30.16, -92.05), (30.19, -92.05), (30.22, -92.05)]


def _routes(s: SparkSession) -> DataFrame:
    points = ", ".join(f"named_struct('lat', double({a}), 'lng', double({o}))" for a, o in ROUTE)
    return s.sql(f"SELECT 1 AS route_id, array({points}) AS path")


_ALONG = ", p AS (SELECT incident_number, round(sqrt(pow((longitude + 92.05) * cos(radians(latitude)), 2) + pow(greatest(30.16 - latitude, latitude - 30.22, 0), 2)) * 111320.0, 3) AS metres, round((least(greatest(latitude, 30.16), 30.22) - 30.16) * 111320.0, 3) AS along, corridors FROM inc WHERE latitude IS NOT NULL)"
_add("jn_13_near_path", lambda s, d: roadstats.near_path(b.incidents(s, d), _routes(s)).select("route_id", "incident_number", "metres", F.round("along", 1).alias("along")), W + _ALONG + " SELECT 1 AS route_id, incident_number, metres, round(along, 1) AS along FROM p WHERE metres <= 150")
_add("agg_48_route_roads", lambda s, d: roadstats.route_roads(_roads(s, d), _routes(s)), W + _ALONG + ", u AS (SELECT unnest(corridors) AS road, along FROM p WHERE metres <= 150) SELECT 1 AS route_id, road, count(*) AS n, round(max(along) - min(along), 1) AS spread FROM u GROUP BY road HAVING max(along) - min(along) >= 400")


# ---- state, time joins, snapshots, streams in batch form
def _state(s: SparkSession, d: str) -> DataFrame:
    seen = ingest.track_sightings(b.listings(s, d)).filter("observation_count > 1").withColumn("geocode_attempts", F.lit(7))
    return ingest.attach_state(b.incidents(s, d), seen).select("incident_number", "geocode_attempts", "observation_count", _ts("last_seen_at"))


_add("jn_19_attach_state", _state, "WITH " + b.LISTINGS + f", n AS (SELECT incident_number, count(DISTINCT sweep_ts) AS c, max(sweep_ts) AS l FROM listings GROUP BY 1 HAVING count(DISTINCT sweep_ts) > 1) SELECT concat('INC', event_id) AS incident_number, CASE WHEN c IS NULL THEN 0 ELSE 7 END AS geocode_attempts, coalesce(c, 1) AS observation_count, {_dts('l', 'last_seen_at')} FROM events LEFT JOIN n ON n.incident_number = concat('INC', event_id)")


def _forecast(s: SparkSession, d: str) -> DataFrame:
    grid = b._view(s, d, "events").select(F.date_trunc("HOUR", F.col("ts").cast("timestamp_ntz")).alias("start")).withColumn("start", F.col("start") - F.make_interval(hours=F.hour("start") % 3)).groupBy("start").agg(F.count(F.lit(1)).cast("double").alias("value"))
    grid = grid.select(F.lit("events").alias("variable"), "start", F.expr("start + INTERVAL 2 HOURS").alias("end"), "value")
    return hourly.forecast_asof(_inc(s, d).filter("reported_ts IS NOT NULL"), grid)


_add("jn_08_forecast_asof", _forecast, W + ", g AS (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * (hour(ts) % 3) AS start, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1) SELECT incident_number, 'events' AS variable, coalesce(g.value, (SELECT arg_min(value, start) FROM g)) AS value FROM inc LEFT JOIN g ON reported_ts >= start AND reported_ts < start + INTERVAL 2 HOUR WHERE reported_ts IS NOT NULL")


def _last_state(s: SparkSession, d: str) -> DataFrame:
    states = b._view(s, d, "events").filter("event_type = 'signup'").groupBy(F.date_trunc("MINUTE", F.col("ts").cast("timestamp_ntz")).alias("at")).agg(F.max("event_id").alias("state"))
    return hourly.attach_last(_inc(s, d), states, "state")


_add("jn_09_attach_last", _last_state, W + ", st AS (SELECT date_trunc('minute', ts) AS at, max(event_id) AS state FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT incident_number, state FROM (SELECT * FROM inc WHERE reported_ts IS NOT NULL) i ASOF LEFT JOIN st ON i.reported_ts >= st.at")


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    from dispatchlake.sources.feed import parse_snapshots

    inc = b.incidents(s, d)
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c), F.lit("</td>"))
    rows = inc.groupBy(F.date_trunc("MINUTE", "created_at").alias("sweep_ts")).agg(F.array_join(F.collect_list(F.concat(F.lit("<tr>"), *[cell(c) for c in ("location", "cause", "reported", "assisting")], F.lit("</tr>"))), "").alias("data"))
    payload = F.to_json(F.struct((F.minute("sweep_ts") % 10 != 0).alias("success"), F.concat(F.lit("<table><tr><th>Location</th></tr>"), F.col("data"), F.lit("</table>")).alias("data")))
    return parse_snapshots(rows.select("sweep_ts", payload.alias("payload"))).select(_ts("sweep_ts"), "location", "cause", "reported", "assisting")


_add("src_01_parse_snapshots", _snapshots, W + "SELECT strftime(date_trunc('minute', created_at), '%Y-%m-%d %H:%M:%S') AS sweep_ts, trim(location) AS location, cause, reported, assisting FROM inc WHERE minute(created_at) % 10 <> 0")


def _health(s: SparkSession, d: str) -> DataFrame:
    from dispatchlake.streaming.jobs import feed_health

    return feed_health(b.listings(s, d), NOW).select(_ts("last_sweep"), "status")


_add("str_11_feed_health", _health, "WITH " + b.LISTINGS + f" SELECT {_dts('max(sweep_ts)', 'last_sweep')}, CASE WHEN date_diff('second', max(sweep_ts), TIMESTAMP '{NOW}') >= 1260 THEN 'unverified' ELSE 'verified' END AS status FROM listings")


def _status_at(s: SparkSession, d: str) -> DataFrame:
    from dispatchlake.streaming.jobs import status_at

    return status_at(b.incidents(s, d), "2024-01-20 12:00:00").select("incident_number")


_add("str_12_status_at", _status_at, W + "SELECT incident_number FROM inc WHERE first_seen_at <= TIMESTAMP '2024-01-20 12:05:00' AND last_seen_at >= TIMESTAMP '2024-01-20 11:54:00'")


def _export(s: SparkSession, d: str) -> DataFrame:
    from dispatchlake.operators.export import export_incidents

    rows = b.listings(s, d)
    last = rows.join(F.broadcast(rows.agg(F.max("sweep_ts").alias("last"))), F.col("sweep_ts") == F.col("last"))  # one row
    out = export_incidents(_inc(s, d), last)
    return out.select("incident_number", "category", "n_calls", _ts("reported_ts"), F.coalesce(F.array_join("corridors", "|"), F.lit("")).alias("corridors"), F.coalesce(F.size("folded"), F.lit(0)).alias("n_folded"), F.coalesce("in_feed", F.lit(False)).alias("in_feed"))


_add("snk_03_export", _export, W + "," + _EP.replace("TS", "reported_ts") + f""", {b.LISTINGS}, fold AS (SELECT incident_number FROM ranked WHERE rk > 1), prim AS (SELECT incident_number, n_listings - 1 AS n_folded FROM ranked WHERE rk = 1), act AS (SELECT incident_number FROM listings WHERE sweep_ts = (SELECT max(sweep_ts) FROM listings))
 SELECT incident_number, category, CAST(1 AS BIGINT) AS n_calls, {_dts('reported_ts')}, array_to_string(corridors, '|') AS corridors, coalesce(n_folded, 0) AS n_folded, incident_number IN (SELECT incident_number FROM act) AS in_feed FROM inc LEFT JOIN prim USING (incident_number) WHERE latitude IS NOT NULL AND cause <> 'TRAFFIC CONTROL' AND incident_number NOT IN (SELECT incident_number FROM fold)
 UNION ALL SELECT min(incident_number), 'control', count(*), {_dts('max(reported_ts)', 'reported_ts')}, '', 0, false FROM inc WHERE cause = 'TRAFFIC CONTROL' AND latitude IS NOT NULL GROUP BY location_key""")


def _resolved(s: SparkSession, d: str) -> DataFrame:
    from dispatchlake.operators.export import resolve_road

    known = _roads(s, d).select(F.explode("corridors").alias("road"))
    return resolve_road(known.select(F.substring("road", 1, 5).alias("typed")), known)


_add("jn_21_resolve_road", _resolved, W + ", k AS (SELECT DISTINCT road FROM (SELECT unnest(corridors) AS road FROM inc)), t AS (SELECT DISTINCT substr(road, 1, 5) AS typed FROM k) SELECT typed, arg_min(road, (length(road), road)) AS road FROM t JOIN k ON starts_with(road, trim(typed)) GROUP BY 1")
