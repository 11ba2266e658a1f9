"""Registered queries of readers, routes, and the batch twins of streaming jobs, with their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.functions import causes, weather
from dispatchlake.operators import export, ingest, routes
from dispatchlake.plans import bindings as b
from dispatchlake.plans.catalog import _EP, NOW, W, _add, _dts, _keyed, _roads, _routes, _ts
from dispatchlake.sources import feed, sinks
from dispatchlake.streaming import state

AT = "2024-01-20 12:00:00"


# ---- readers
def _stations(s: SparkSession, d: str) -> DataFrame:
    raw = b.weather_obs(s, d).select(F.date_format("obs_ts", "yyyy-MM-dd HH:mm").alias("valid"), F.when(F.col("seq") == 3, "M").otherwise(F.col("temp_f").cast("string")).alias("tmpf"), F.when(F.col("seq") == 4, "T").otherwise(F.coalesce(F.round("precip_in", 2).cast("string"), F.lit("M"))).alias("p01i"), F.coalesce(F.col("visibility_mi").cast("string"), F.lit("M")).alias("vsby"), F.round("wind_mph", 0).cast("string").alias("sknt"), F.when(F.col("wx") == "", "M").otherwise(F.col("wx")).alias("wxcodes"))
    out = feed.parse_station_csv(raw)
    return out.groupBy("wx").agg(F.count(F.lit(1)).alias("n"), F.count("temp_f").alias("temps"), F.round(F.sum("temp_f"), 3).alias("temp_f"), F.round(F.sum("precip_in"), 3).alias("precip_in"), F.count("visibility_mi").alias("seen"), F.round(F.sum("wind_mph"), 1).alias("wind_mph"), F.date_format(F.max("hour"), "yyyy-MM-dd HH:mm:ss").alias("last_hour"))


_add("src_05_station_csv", _stations, "WITH " + b.WEATHER + " SELECT wx, count(*) AS n, count(*) FILTER (seq <> 3) AS temps, round(sum(temp_f) FILTER (seq <> 3), 3) AS temp_f, round(sum(CASE WHEN seq = 4 THEN 0.001 ELSE round(precip_in, 2) END), 3) AS precip_in, count(visibility_mi) AS seen, round(sum(round(round(wind_mph, 0) * 1.150779, 1)), 1) AS wind_mph, strftime(date_trunc('hour', max(obs_ts)), '%Y-%m-%d %H:%M:%S') AS last_hour FROM weather_obs GROUP BY 1")


def _forecasts(s: SparkSession, d: str) -> DataFrame:
    cell = F.struct(F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00/PT"), (F.col("event_id") % 5 + 1).cast("string"), F.lit("H")).alias("validTime"), F.col("user_id").cast("double").alias("value"))
    grid = b._view(s, d, "events").withColumn("name", F.when(F.col("event_id") % 2 == 0, "temperature").otherwise("windSpeed"))
    grid = grid.groupBy("name", (F.col("event_id") % 64).alias("page")).agg(F.to_json(F.struct(F.lit("wmoUnit:degC").alias("uom"), F.collect_list(cell).alias("values"))).alias("body"))
    pages = grid.select(F.concat(F.lit('{"properties":{"'), F.col("name"), F.lit('":'), F.col("body"), F.lit("}}")).alias("payload"))
    out = feed.explode_forecast(pages).withColumn("hours", F.timestamp_diff("HOUR", F.col("start"), F.col("end")))
    return out.groupBy("variable", "hours").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(weather.convert_units(F.col("value"), F.col("uom"), "temp")), 3).alias("fahrenheit"))


_add("src_07_forecast", _forecasts, "SELECT CASE WHEN event_id % 2 = 0 THEN 'temperature' ELSE 'windSpeed' END AS variable, event_id % 5 + 1 AS hours, count(*) AS n, round(sum(user_id * 9.0 / 5 + 32), 3) AS fahrenheit FROM events GROUP BY 1, 2")


def _alerts(s: SparkSession, d: str) -> DataFrame:
    names = F.array_compact(F.array(F.when(F.col("event_id") % 2 == 0, "Flash Flood Warning"), F.when(F.col("event_id") % 3 == 0, "Severe Thunderstorm Warning"), F.when(F.col("event_id") % 5 == 0, "Tornado Watch"), F.when(F.col("event_id") % 7 == 0, "Heat Advisory")))
    payload = F.to_json(F.struct(F.transform(names, lambda x: F.struct(F.struct(x.alias("event")).alias("properties"))).alias("features")))
    return feed.summarise_alerts(b._view(s, d, "events").select("event_id", payload.alias("payload")))


_add("src_08_alerts", _alerts, "SELECT event_id, event_id % 2 = 0 AS nws_flash_flood_warning, event_id % 3 = 0 AS nws_severe_thunderstorm_warning, event_id % 5 = 0 AS nws_tornado_watch, (event_id % 2 = 0)::INT + (event_id % 3 = 0)::INT + (event_id % 5 = 0)::INT + (event_id % 7 = 0)::INT AS nws_active_alert_count FROM events")


def _latlon(s: SparkSession, d: str) -> DataFrame:
    rows = b.geocode_results(s, d).withColumnsRenamed({"latitude": "Lat", "longitude": "LNG"})
    return feed.conform(feed.resolve_latlon(rows), "result_id long, latitude double, longitude double, note string")


_add("src_04_snk_02_columns", _latlon, "WITH " + b.GEOCODES + " SELECT CAST(result_id AS BIGINT) AS result_id, latitude, longitude, CAST(NULL AS VARCHAR) AS note FROM geo")
_UNITS = [("degC", "temp", "c_custkey * 9.0 / 5 + 32"), ("wmoUnit:mm", "length", "c_custkey / 25.4"), ("wmoUnit:m", "distance", "c_custkey / 1609.344"), ("wmoUnit:km_h-1", "speed", "c_custkey / 1.609344"), ("wmoUnit:m_s-1", "speed", "c_custkey * 2.236936"), ("odd", "temp", "c_custkey * 1.0")]


def _converted(s: SparkSession, d: str) -> DataFrame:
    value = F.col("c_custkey").cast("double")
    cases = [F.round(weather.convert_units(value, F.lit(u), k), 6).alias(f"v{n}") for n, (u, k, _) in enumerate(_UNITS)]
    return b._view(s, d, "customer").select("c_custkey", *cases)


_add("prj_26_units", _converted, "SELECT c_custkey, " + ", ".join(f"round({x}, 6) AS v{n}" for n, (_, _, x) in enumerate(_UNITS)) + " FROM customer")


def _hash(s: SparkSession, d: str) -> DataFrame:
    """Two orders of one table have one hash, a changed value another."""
    rows = b.incidents(s, d).select("incident_number", "location", "cause")
    one, two, three = (sinks.content_hash(x) for x in (rows, rows.orderBy(F.desc("incident_number")), rows.withColumn("cause", F.lit("x"))))
    return rows.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(one == two).alias("same"), F.lit(one == three).alias("changed_same"))


_add("snk_04_content_hash", _hash, "SELECT count(*) AS n, true AS same, false AS changed_same FROM events")


_add("snk_07_seed", lambda s, d: ingest.seed_from_archive(b.incidents(s, d).filter("event_id % 3 = 0").select("incident_number", "cause"), b.incidents(s, d).select("incident_number", F.lit("seed").alias("cause"))).groupBy("cause").agg(F.count(F.lit(1)).alias("n")), W + "SELECT CASE WHEN event_id % 3 = 0 THEN cause ELSE 'seed' END AS cause, count(*) AS n FROM inc GROUP BY 1")


# ---- routes
def _messages(s: SparkSession, d: str) -> DataFrame:
    no, slot = F.col("c_custkey").cast("string"), (F.col("c_custkey") % 20 + 1).cast("string")
    body = F.concat(F.lit("Hi,\n> X_ROUTE_"), slot, F.lit("_NAME="), F.col("c_name"), F.lit("\n> > X_ROUTE_"), slot, F.lit("_CORRIDORS=Johnston Street |\n  W Pinhook Rd\n\nsigned "), no, F.lit("\nROUTE_"), slot, F.lit("_DEPART = "), F.lpad((F.col("c_custkey") % 24).cast("string"), 2, "0"), F.lit(":05\nROUTE_"), slot, F.lit("_RADIUS_M="), no)
    return b._view(s, d, "customer").select(F.col("c_custkey").cast("long").alias("message_id"), body.alias("body"))


def _lines(s: SparkSession, d: str) -> DataFrame:
    r = routes.parse_route_lines(_messages(s, d))
    table = routes.routes_from_fields(r.select((F.col("message_id") * 100 + F.col("route_id")).alias("route_id"), "fields"))
    return table.select("route_id", "name", F.array_join("corridors", "|").alias("corridors"), "radius_m", "depart", "days")


_add("src_09_route_lines", _lines, "SELECT CAST(c_custkey * 100 + c_custkey % 20 + 1 AS BIGINT) AS route_id, c_name AS name, 'JOHNSTON ST|PINHOOK RD' AS corridors, CAST(greatest(50, least(2000, c_custkey)) AS INTEGER) AS radius_m, printf('%02d:05', CAST(c_custkey % 24 AS INTEGER)) AS depart, 'mon-fri' AS days FROM customer")


def _edited(s: SparkSession, d: str) -> DataFrame:
    none = s.createDataFrame([], "route_id int, fields map<string,string>")
    r = routes.routes_from_fields(routes.apply_route_edits(none, routes.parse_route_lines(_messages(s, d))))
    return r.select("route_id", "name", "radius_m", "depart")


_add("src_09_route_edits", _edited, "SELECT CAST(c_custkey % 20 + 1 AS INTEGER) AS route_id, arg_max(c_name, c_custkey) AS name, CAST(greatest(50, least(2000, max(c_custkey))) AS INTEGER) AS radius_m, printf('%02d:05', CAST(max(c_custkey) % 24 AS INTEGER)) AS depart FROM customer GROUP BY 1")
_DAYS = [("mon-fri", "0,1,2,3,4"), ("fri-mon", "0,4,5,6"), ("daily", "0,1,2,3,4,5,6"), ("Sat, wed", "2,5"), ("weekends", "5,6")]


def _plans(s: SparkSession, d: str) -> DataFrame:
    days = F.element_at(F.array(*[F.lit(x) for x, _ in _DAYS]), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = b._view(s, d, "customer").select(F.col("c_custkey").alias("route_id"), days.alias("days"), F.concat((F.col("c_custkey") % 30).cast("string"), F.lit(":"), F.lpad((F.col("c_custkey") % 60).cast("string"), 2, "0")).alias("depart"))
    return routes.with_route_schedule(rows).select("route_id", F.array_join(F.transform("day_numbers", lambda x: x.cast("string")), ",").alias("day_numbers"), "depart_minutes")


_add("prj_32_route_schedule", _plans, "SELECT c_custkey AS route_id, CASE c_custkey % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, (_, v) in enumerate(_DAYS)) + " END AS day_numbers, CASE WHEN c_custkey % 30 < 24 THEN CAST(c_custkey % 30 * 60 + c_custkey % 60 AS INTEGER) END AS depart_minutes FROM customer")


def _overridden(s: SparkSession, d: str) -> DataFrame:
    key = b._view(s, d, "customer").select(F.col("c_custkey").alias("route_id"), F.col("c_name").alias("name"))
    road = F.array(F.lit("JOHNSTON ST"))
    path = F.lit(None).cast("array<struct<lat:double,lng:double>>")
    base = key.filter("route_id % 4 <> 0").select("route_id", "name", path.alias("path"), F.when(F.col("route_id") % 5 != 0, road).alias("corridors"))
    over = key.filter("route_id % 3 = 0").select("route_id", F.when(F.col("route_id") % 2 == 0, "other").alias("name"), path.alias("path"), F.when(F.col("route_id") % 4 == 0, road).alias("corridors"))
    return routes.effective_routes(base, over).select("route_id", "name", F.array_join("corridors", "|").alias("corridors"))


_add("jn_24_effective_routes", _overridden, "SELECT c_custkey AS route_id, CASE WHEN c_custkey % 6 = 0 THEN 'other' WHEN c_custkey % 4 <> 0 THEN c_name END AS name, 'JOHNSTON ST' AS corridors FROM customer WHERE (c_custkey % 3 = 0 AND c_custkey % 4 = 0) OR (c_custkey % 4 <> 0 AND c_custkey % 5 <> 0)")


def _plan(s: SparkSession) -> DataFrame:
    return _routes(s).withColumn("corridors", F.array(F.lit("KALISTE SALOOM RD"))).withColumn("day_numbers", F.array(*map(F.lit, range(7)))).withColumn("depart_minutes", F.lit(725))


def _incidents_now(s: SparkSession, d: str) -> DataFrame:
    return causes.with_severity(_roads(s, d))


_HOW = {"window_min": 360, "fold_min": 15}
_CAND = f""", cand AS (SELECT *, CASE WHEN last_seen_at >= TIMESTAMP '{AT}' - INTERVAL 6 MINUTE THEN 'active' ELSE 'cleared' END AS st FROM (SELECT * REPLACE (coalesce(reported_ts, first_seen_at) AS reported_ts) FROM inc) WHERE reported_ts IS NOT NULL AND first_seen_at <= TIMESTAMP '{AT}' + INTERVAL 6 MINUTE),
 unk AS (SELECT *, 'unknown' AS st FROM (SELECT * REPLACE (coalesce(reported_ts, first_seen_at) AS reported_ts) FROM inc) WHERE first_seen_at > TIMESTAMP '{AT}' + INTERVAL 6 MINUTE),
 c0 AS (SELECT *, CAST(trunc(date_diff('second', reported_ts, TIMESTAMP '{AT}') / 60) AS BIGINT) AS age FROM (SELECT * FROM cand UNION ALL SELECT * FROM unk)),
 c1 AS (SELECT * FROM c0 WHERE age >= -5 AND age <= 720 AND (age <= 360 OR st = 'active')), """ + _EP.replace("FROM inc WHERE", "FROM c1 WHERE").replace("TS", "reported_ts") + """,
 alive AS (SELECT * FROM c1 WHERE incident_number NOT IN (SELECT incident_number FROM ranked WHERE rk > 1)),
 m AS (SELECT *, round(sqrt(pow((longitude + 92.05) * cos(radians(latitude)), 2) + pow(greatest(30.16 - latitude, latitude - 30.22, 0), 2)) * 111320.0, 3) AS metres, list_contains(corridors, 'KALISTE SALOOM RD') AS named FROM alive),
 v AS (SELECT incident_number, st AS status, age, CASE WHEN metres <= 150 OR named AND metres <= 400 THEN 'path' WHEN named AND latitude IS NULL THEN 'approximate' END AS match, metres, named FROM m),
 f AS (SELECT incident_number, status, match, metres, CASE WHEN match IS NULL THEN 'skipped' WHEN status = 'cleared' THEN 'cleared' ELSE 'alert' END AS verdict FROM v WHERE match IS NOT NULL OR named OR metres <= 1200)"""
_add("agg_49_route_incidents", lambda s, d: routes.in_route_order(routes.route_incidents(_incidents_now(s, d), _plan(s), None, AT, **_HOW)).select("incident_number", "status", "match", "verdict"), W + _CAND + " SELECT incident_number, status, match, verdict FROM f UNION ALL SELECT incident_number, NULL, NULL, 'merged' FROM ranked WHERE rk > 1")
_add("agg_54_route_state", lambda s, d: routes.route_state(routes.route_incidents(_incidents_now(s, d), _plan(s), None, AT, **_HOW)), W + _CAND + " SELECT 1 AS route_id, count(*) FILTER (match IS NOT NULL AND status = 'active') AS active, count(*) FILTER (match IS NOT NULL AND status = 'cleared') AS cleared, count(*) FILTER (match = 'approximate') AS approximate, count(*) FILTER (match IS NOT NULL AND status = 'unknown') AS unknown, CASE WHEN count(*) FILTER (match IS NOT NULL AND status = 'active') > 0 THEN 'alert' WHEN count(*) FILTER (match IS NOT NULL AND status = 'unknown') > 0 THEN 'unverified' ELSE 'clear' END AS state FROM f")
_add("agg_55_route_replay", lambda s, d: routes.route_replay(_incidents_now(s, d), _plan(s), AT, **_HOW).withColumn("near_misses", F.array_join("near_misses", ",")), W + _CAND + " SELECT 1 AS route_id, true AS scheduled, CAST(705 AS INTEGER) AS send_minutes, count(*) FILTER (verdict = 'alert') AS incidents, count(*) FILTER (verdict = 'cleared') AS cleared, (SELECT coalesce(string_agg(incident_number, ',' ORDER BY metres, incident_number), '') FROM (SELECT * FROM f WHERE match IS NULL AND metres <= 450 ORDER BY metres, incident_number LIMIT 3)) AS near_misses FROM f")
_SLOT_ROADS = ["AMBASSADOR CAFFERY PKWY", "JOHNSTON ST", "PINHOOK RD", "KALISTE SALOOM RD", "EVANGELINE THRUWAY", "I-10", "US 90", "E BROUSSARD RD"]


def _many(s: SparkSession, d: str) -> DataFrame:
    """A route for each supplier: a road, a radius, and for four in five a path straight north."""
    no = F.col("s_suppkey")
    lon = F.lit(-92.1) + (no % 89) / F.lit(1000.0)
    path = F.when(no % 5 > 0, F.array(F.struct(F.lit(30.16).alias("lat"), lon.alias("lng")), F.struct(F.lit(30.22).alias("lat"), lon.alias("lng"))))
    road = F.element_at(F.array(*map(F.lit, _SLOT_ROADS)), (no % 8 + 1).cast("int"))
    return b._view(s, d, "supplier").select(no.cast("int").alias("route_id"), path.alias("path"), F.array(road).alias("corridors"), (F.lit(50) + no % 7 * 50).cast("int").alias("radius_m"), F.array(*map(F.lit, range(5))).alias("day_numbers"), (no % 1440).cast("int").alias("depart_minutes"))


_MANY = _CAND[: _CAND.index(",\n m AS")] + ", rt AS (SELECT CAST(s_suppkey AS INTEGER) AS route_id, -92.1 + (s_suppkey % 89) / 1000.0 AS lon, s_suppkey % 5 > 0 AS has_path, CASE s_suppkey % 8 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_SLOT_ROADS)) + """ END AS road, 50 + s_suppkey % 7 * 50 AS radius, CAST(s_suppkey % 1440 AS INTEGER) AS depart FROM supplier),
 m AS (SELECT route_id, radius, has_path, incident_number, st AS status, latitude, CASE WHEN has_path THEN round(sqrt(pow((longitude - lon) * cos(radians(latitude)), 2) + pow(greatest(30.16 - latitude, latitude - 30.22, 0), 2)) * 111320.0, 3) END AS metres, list_contains(corridors, road) AS named FROM alive JOIN rt ON true),
 v AS (SELECT *, CASE WHEN metres <= radius OR named AND metres <= greatest(400, 2 * radius) THEN 'path' WHEN named AND NOT has_path THEN 'road' WHEN named AND latitude IS NULL THEN 'approximate' END AS match FROM m),
 f AS (SELECT *, CASE WHEN match IS NULL THEN 'skipped' WHEN status = 'cleared' THEN 'cleared' ELSE 'alert' END AS verdict FROM v WHERE match IS NOT NULL OR named OR metres <= greatest(1200, 3 * radius))"""
_add("agg_49_many_routes", lambda s, d: routes.route_incidents(_incidents_now(s, d), _many(s, d), None, AT, **_HOW).select("route_id", "incident_number", "status", "match", "verdict"), W + _MANY + " SELECT route_id, incident_number, status, match, verdict FROM f UNION ALL SELECT NULL, incident_number, NULL, NULL, 'merged' FROM ranked WHERE rk > 1")
_add("agg_54_many_routes", lambda s, d: routes.route_states(_incidents_now(s, d), _many(s, d), None, AT, **_HOW), W + _MANY + " SELECT route_id, count(*) FILTER (match IS NOT NULL AND status = 'active') AS active, count(*) FILTER (match IS NOT NULL AND status = 'cleared') AS cleared, count(*) FILTER (match = 'approximate') AS approximate, count(*) FILTER (match IS NOT NULL AND status = 'unknown') AS unknown, CASE WHEN count(*) FILTER (match IS NOT NULL AND status = 'active') > 0 THEN 'alert' WHEN count(*) FILTER (match IS NOT NULL AND status = 'unknown') > 0 THEN 'unverified' ELSE 'clear' END AS state FROM f GROUP BY 1")
_add("agg_55_many_routes", lambda s, d: routes.route_replay(_incidents_now(s, d), _many(s, d), AT, **_HOW).withColumn("near_misses", F.array_join("near_misses", ",")), W + _MANY + ", nm AS (SELECT route_id, string_agg(incident_number, ',' ORDER BY metres, incident_number) AS near_misses FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY metres, incident_number) AS k FROM f WHERE match IS NULL AND metres <= 450) WHERE k <= 3 GROUP BY 1) SELECT rt.route_id, false AS scheduled, CAST(greatest(0, depart - 20) AS INTEGER) AS send_minutes, count(*) FILTER (verdict = 'alert') AS incidents, count(*) FILTER (verdict = 'cleared') AS cleared, coalesce(any_value(near_misses), '') AS near_misses FROM rt LEFT JOIN f ON f.route_id = rt.route_id LEFT JOIN nm ON nm.route_id = rt.route_id GROUP BY rt.route_id, depart")
_add("jn_14_on_route_roads", lambda s, d: routes.on_route_roads(_roads(s, d), _plan(s)), W + "SELECT 1 AS route_id, incident_number FROM inc WHERE list_contains(corridors, 'KALISTE SALOOM RD')")


def _checks(s: SparkSession, d: str) -> DataFrame:
    at = F.date_trunc("MINUTE", F.col("created_at"))
    found = F.struct(F.array("incident_number").alias("ids"), F.when(F.col("event_id") % 3 == 0, "cleared").otherwise("active").alias("status"))
    return b.incidents(s, d).groupBy((F.col("user_id") % 7).cast("int").alias("route_id"), at.alias("at")).agg(F.sort_array(F.collect_list(found)).alias("found"))


def _alerted(s: SparkSession, d: str) -> DataFrame:
    plan = b._view(s, d, "customer").filter("c_custkey < 7").select(F.col("c_custkey").cast("int").alias("route_id"), F.array(*map(F.lit, range(7))).alias("day_numbers"), (F.col("c_custkey") * 180 + 400).cast("int").alias("depart_minutes"))
    return routes.route_alerts(_checks(s, d), plan).select("route_id", _ts("at"), "kind", F.array_join("ids", ",").alias("ids"))


_add("str_09_route_alerts", _alerted)


def _paths(s: SparkSession, d: str) -> DataFrame:
    rows = b.incidents(s, d).filter("latitude IS NOT NULL").groupBy((F.col("user_id") % 500).alias("path_id")).agg(F.sort_array(F.collect_list(F.struct("event_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lng")))).alias("p"))
    out = export.simplify_paths(rows.select("path_id", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lng"].alias("lng"))).alias("path")))
    return out.select("path_id", F.size("path").alias("points"), F.col("path")[0]["lat"].alias("first_lat"))


_add("agg_52_simplify_paths", _paths)


# ---- batch twins of streams
def _touched(s: SparkSession, d: str) -> DataFrame:
    k = _keyed(s, d).withColumn("observation_count", (F.col("event_id") % 5).cast("int")).withColumn("first_seen_at", F.when(F.col("event_id") % 4 != 0, F.col("first_seen_at")))
    sweep = k.filter("event_id % 10 = 0").select(F.when(F.col("event_id") % 20 == 0, F.col("incident_number")).otherwise(F.concat(F.lit("NEW"), F.col("incident_number"))).alias("incident_number"), F.when(F.col("event_id") % 20 == 0, F.lit("another key")).otherwise(F.col("content_key")).alias("content_key"))
    at = F.lit(NOW).cast("timestamp_ntz")
    return ingest.touch_observations(k, sweep, at).select("incident_number", _ts("first_seen_at"), _ts("last_seen_at"), "observation_count")


_CKEY = "concat_ws('|', location_key, upper(trim(cause)), upper(trim(reported)))"
_add("jn_03_touch_observations", _touched, W + f", k AS (SELECT *, {_CKEY} AS content_key FROM inc), h AS (SELECT *, event_id % 20 = 0 OR content_key IN (SELECT content_key FROM k WHERE event_id % 20 = 10) AS hit FROM k) SELECT incident_number, strftime(CASE WHEN event_id % 4 <> 0 THEN first_seen_at WHEN hit THEN TIMESTAMP '{NOW}' END, '%Y-%m-%d %H:%M:%S') AS first_seen_at, strftime(CASE WHEN hit THEN TIMESTAMP '{NOW}' ELSE last_seen_at END, '%Y-%m-%d %H:%M:%S') AS last_seen_at, event_id % 5 + CAST(hit AS INTEGER) AS observation_count FROM h")


def _failures(s: SparkSession, d: str) -> DataFrame:
    tries = _keyed(s, d).filter("location_key <> ''").select("location_key", F.col("created_at").alias("at"), (F.col("event_id") % 9 == 0).alias("ok"))
    return state.failure_state(tries, "2024-01-30 00:00:00").select("location_key", "attempts", _ts("last_at"))


_add("str_08_failure_state", _failures, W + f", r AS (SELECT location_key, created_at AS tried, event_id % 9 = 0 AS ok, CASE WHEN event_id % 9 = 0 OR coalesce(lag(event_id % 9 = 0) OVER w, true) OR created_at > lag(created_at) OVER w + INTERVAL 7 DAY THEN 1 ELSE 0 END AS brk FROM inc WHERE location_key <> '' WINDOW w AS (PARTITION BY location_key ORDER BY created_at, event_id % 9 = 0)), g AS (SELECT *, sum(brk) OVER (PARTITION BY location_key ORDER BY tried, ok ROWS UNBOUNDED PRECEDING) AS run FROM r), l AS (SELECT *, max(run) OVER (PARTITION BY location_key) AS last FROM g) SELECT location_key, CAST(count(*) AS INTEGER) AS attempts, {_dts('max(tried)', 'last_at')} FROM l WHERE run = last AND NOT ok GROUP BY 1 HAVING max(tried) >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY")


def _resolved_hours(s: SparkSession, d: str) -> DataFrame:
    log = b.weather_obs(s, d).withColumn("source", F.when(F.col("l_orderkey") % 3 == 0, "archive").otherwise("live"))
    out = state.resolve_hours(log.select("obs_ts", "temp_f", "precip_in", "visibility_mi", "wind_mph", "wx", "source"))
    return out.select(_ts("hour"), F.round("precip_in", 6).alias("precip_in"), "visibility_mi", F.round("wind_mph", 6).alias("wind_mph"), "wx", "archived")


SQL_OF_HOURS = "WITH " + b.WEATHER + f", w AS (SELECT *, date_trunc('hour', obs_ts) AS hour, l_orderkey % 3 = 0 AS archived FROM weather_obs), k AS (SELECT * FROM w WHERE archived OR hour NOT IN (SELECT hour FROM w WHERE archived)) SELECT {_dts('hour')}, round(max(precip_in), 6) AS precip_in, min(visibility_mi) AS visibility_mi, round(max(wind_mph), 6) AS wind_mph, coalesce(string_agg(DISTINCT wx, ' ' ORDER BY wx) FILTER (wx <> ''), '') AS wx, bool_or(archived) AS archived FROM k GROUP BY hour"
_add("str_10_resolve_hours", _resolved_hours, SQL_OF_HOURS)
