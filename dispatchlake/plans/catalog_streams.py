"""Registered queries of streams and of sources and sinks, with their DuckDB text.

The stream queries start the job on the files of the table, let it take all that is there, and return what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.functions import sql, text
from dispatchlake.functions.times import with_reported_ts
from dispatchlake.operators import episodes as ep_ops
from dispatchlake.plans import bindings as b
from dispatchlake.plans import catalog_feeds as _feeds
from dispatchlake.plans.catalog import _CK, _EP, W, _add, _dts, _inc, _roads, _ts
from dispatchlake.sources import feed, sinks
from dispatchlake.sources.scratch import scratch, stored
from dispatchlake.streaming import archive, jobs, state, stateful


def _drained(s: SparkSession, make: Callable[[], DataFrame], mode: str = "append") -> DataFrame:
    stateful.use_keyed_state(s)
    path = scratch(s, "stream")
    return stateful.drain(make(), f"{path}/out", f"{path}/check", mode)


# ---- keyed state
def _presence(s: SparkSession, d: str) -> DataFrame:
    out = _drained(s, lambda: stateful.presence(b.listings(s, d, b.event_stream(s, d)), buckets=stateful.PRESENCE_BUCKETS))
    return out.select("incident_number", "event", _ts("at"), _ts("first_seen_at"), _ts("last_seen_at"), "observation_count")


_add("str_02_presence", _presence, "WITH " + b.LISTINGS + f""", r AS (SELECT DISTINCT incident_number, sweep_ts AS t FROM listings),
 x AS (SELECT *, lag(t) OVER w AS prev, lead(t) OVER w AS nxt, first_value(t) OVER w AS first_seen_at, CAST(row_number() OVER w AS INTEGER) AS observation_count, max(t) OVER () AS newest FROM r WINDOW w AS (PARTITION BY incident_number ORDER BY t))
 SELECT incident_number, 'appeared' AS event, {_dts('t', 'at')}, {_dts('first_seen_at')}, {_dts('t', 'last_seen_at')}, observation_count FROM x WHERE prev IS NULL OR t > prev + INTERVAL 5 MINUTE
 UNION ALL SELECT incident_number, 'left', {_dts('t + INTERVAL 5 MINUTE', 'at')}, {_dts('first_seen_at')}, {_dts('t', 'last_seen_at')}, observation_count FROM x WHERE (nxt IS NULL OR nxt > t + INTERVAL 5 MINUTE) AND t + INTERVAL 5 MINUTE < newest""")
_add("str_04_agency_log", lambda s, d: _drained(s, lambda: stateful.agency_log(b.listings(s, d, b.event_stream(s, d)))).select("incident_number", "agency", _ts("changed_at")), "WITH " + b.LISTINGS + f" SELECT incident_number, 'fire' AS agency, {_dts('min(sweep_ts)', 'changed_at')} FROM listings WHERE assisting LIKE '%FIRE%' GROUP BY 1")


def _cache(s: SparkSession, d: str) -> DataFrame:
    def job() -> DataFrame:
        rows = text.with_location_key(b.incidents(s, d, b.event_stream(s, d))).filter("location_key <> ''")
        return stateful.negative_cache(rows.select("location_key", F.col("created_at").alias("at"), (F.col("event_id") % 9 == 0).alias("ok")))

    return stateful.latest(_drained(s, job, "update"), ["location_key"]).filter("attempts > 0").select("location_key", "attempts", _ts("last_at"))


_add("str_08_negative_cache", _cache, W + f""", r AS (SELECT location_key, created_at AS tried, event_id % 9 = 0 AS ok FROM inc WHERE location_key <> ''), e AS (SELECT max(tried) AS newest FROM r),
 k AS (SELECT *, CASE WHEN ok OR coalesce(lag(ok) OVER w, true) OR tried > lag(tried) OVER w + INTERVAL 7 DAY THEN 1 ELSE 0 END AS brk FROM r WINDOW w AS (PARTITION BY location_key ORDER BY tried, ok)),
 g AS (SELECT *, sum(brk) OVER (PARTITION BY location_key ORDER BY tried, ok ROWS UNBOUNDED PRECEDING) AS run FROM k), l AS (SELECT *, max(run) OVER (PARTITION BY location_key) AS last FROM g)
 SELECT location_key, CAST(count(*) AS INTEGER) AS attempts, {_dts('max(tried)', 'last_at')} FROM l, e WHERE run = last AND NOT ok GROUP BY location_key, newest HAVING max(tried) + INTERVAL 7 DAY >= newest""")


# ---- route alerts: incidents come back under the id of their user, so that earlier ids are known again
def _checks(s: SparkSession, d: str) -> DataFrame:
    found = F.struct(F.array("incident_number", F.concat(F.lit("USER"), F.col("user_id") % 50)).alias("ids"), F.when(F.col("event_id") % 3 == 0, "cleared").otherwise("active").alias("status"))
    rows = b.incidents(s, d).groupBy((F.col("user_id") % 7).cast("int").alias("route_id"), F.date_trunc("MINUTE", F.col("created_at")).alias("at")).agg(F.sort_array(F.collect_list(found)).alias("found"))  # the incidents of one minute
    path = scratch(s, "checks")
    rows.write.parquet(path)
    return s.readStream.schema(rows.schema).parquet(path)


def _alerts(s: SparkSession, d: str) -> DataFrame:
    plan = b._view(s, d, "customer").filter("c_custkey < 7").select(F.col("c_custkey").cast("int").alias("route_id"), F.array(*map(F.lit, range(7))).alias("day_numbers"), (F.col("c_custkey") * 180 + 300).cast("int").alias("depart_minutes"))
    out = _drained(s, lambda: stateful.route_alert_stream(_checks(s, d), plan))
    return out.select("route_id", _ts("at"), "kind", F.array_join("ids", ",").alias("ids"))


_FOLLOW = "".join(f""", c{n} AS (SELECT k.route_id, k.day, k.sent, k.known, min(f.tm) AS tm FROM k{n - 1} k JOIN f ON f.route_id = k.route_id AND f.tm > k.tm AND f.tm <= k.sent + INTERVAL 30 MINUTE AND CAST(f.tm AS DATE) = k.day AND f.status <> 'cleared' AND NOT list_has_any(f.ids, k.known) GROUP BY ALL),
 k{n} AS (SELECT c.route_id, c.day, c.sent, c.tm, list_concat(any_value(c.known), flatten(list(f.ids))) AS known, list_sort(list_distinct(flatten(list(f.ids)))) AS fresh FROM c{n} c JOIN f ON f.route_id = c.route_id AND f.tm = c.tm AND f.status <> 'cleared' AND NOT list_has_any(f.ids, c.known) GROUP BY c.route_id, c.day, c.sent, c.tm)""" for n in (1, 2, 3))
_add("str_09_route_alert_stream", _alerts, W + f""", f AS (SELECT CAST(user_id % 7 AS INTEGER) AS route_id, date_trunc('minute', created_at) AS tm, [incident_number, concat('USER', user_id % 50)] AS ids, CASE WHEN event_id % 3 = 0 THEN 'cleared' ELSE 'active' END AS status FROM inc),
 dep AS (SELECT f.route_id, CAST(f.tm AS DATE) AS day, min(f.tm) AS sent FROM f JOIN customer ON c_custkey = f.route_id AND c_custkey < 7 WHERE hour(f.tm) * 60 + minute(f.tm) BETWEEN c_custkey * 180 + 280 AND c_custkey * 180 + 299 GROUP BY 1, 2),
 k0 AS (SELECT dep.route_id, dep.day, dep.sent, dep.sent AS tm, flatten(list(f.ids)) AS known, list_sort(list_distinct(flatten(list(f.ids)))) AS fresh FROM dep JOIN f ON f.route_id = dep.route_id AND f.tm = dep.sent GROUP BY ALL){_FOLLOW}
 SELECT route_id, {_dts('tm', 'at')}, 'departure' AS kind, array_to_string(fresh, ',') AS ids FROM k0""" + "".join(f" UNION ALL SELECT route_id, {_dts('tm', 'at')}, 'follow-up', array_to_string(fresh, ',') FROM k{n}" for n in (1, 2, 3)))


def _fed(s: SparkSession, parts: list[DataFrame], each: Callable[[DataFrame, int], None]) -> None:
    """Gives parts to a job one after another, each as one batch of the files that its tasks wrote."""
    path, check = scratch(s, "parts"), scratch(s, "check")
    for part in parts:
        part.write.mode("append").parquet(path)
        s.readStream.schema(part.schema).parquet(path).writeStream.foreachBatch(each).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()


# ---- the archive: four parts of the listings told by day and cause, then the same ids once more under other keys
def _archived(s: SparkSession, d: str) -> DataFrame:
    inc = stored(b.incidents(s, d).select("event_id", "incident_number", "location", "cause", F.date_format("created_at", "yyyy-MM-dd").alias("reported"), F.col("event_id").alias("pos")), "listings")
    last = inc.agg(F.max("event_id").alias("last"))
    rows = inc.join(F.broadcast(last)).withColumn("quarter", F.least(F.floor(F.col("event_id") * 4 / (F.col("last") + 1)), F.lit(3))).drop("last")  # one row
    parts = [rows.filter(F.col("quarter") == k).drop("quarter") for k in range(4)] + [inc.withColumn("reported", F.concat("reported", F.lit(" again")))]
    table = archive.Archive(s, scratch(s, "archive"), inc.schema, fan=2)
    _fed(s, parts, archive.archive_stream(table))
    return table.read().select("incident_number", "reported", "content_key")


_SEEN = f"d AS (SELECT event_id, incident_number, location_key, cause, strftime(created_at, '%Y-%m-%d') AS reported FROM inc), k AS (SELECT *, row_number() OVER (PARTITION BY {_CK} ORDER BY event_id) AS rn, {_CK} AS ck FROM d)"
_add("str_01_archive_stream", _archived, W + ", " + _SEEN + " SELECT incident_number, CASE rn WHEN 1 THEN reported ELSE concat(reported, ' again') END AS reported, CASE rn WHEN 1 THEN ck ELSE concat(ck, ' AGAIN') END AS content_key FROM k WHERE rn <= 2")


# ---- windows
def _rolling(s: SparkSession, d: str) -> DataFrame:
    inc = stored(_inc(s, d), "incidents")
    more = ep_ops.folded_ids(inc).withColumn("folded", F.lit(True))
    out = jobs.rolling_digest(inc.join(more, "incident_number", "left"))
    return out.select(_ts("until"), *[c for c in out.columns if c != "until"])


_WHAT = {"folded": "f", "n_accidents": "NOT f AND category = 'accident'", "n_fire": "false", "n_hazards": "NOT f AND category = 'hazard'", "n_signals": "NOT f AND category = 'control'", "n_stalled": "NOT f AND category = 'vehicle'", "n_medical": "false", "n_other": "false", "agency_police": "NOT f AND assisting LIKE '%POLICE%'", "agency_sheriff": "NOT f AND assisting = 'SHERIFF'", "agency_fire": "NOT f AND assisting LIKE '%FIRE%'", "agency_ems": "false", "located": "NOT f AND latitude IS NOT NULL", "locating": "NOT f AND latitude IS NULL AND geocode_attempts < 3", "unmappable": "NOT f AND latitude IS NULL AND geocode_attempts >= 3", "in_rain": "NOT f AND (coalesce(weather_precip_prob >= 20, false) OR coalesce(weather_precip_in > 0.005, false))", "under_alert": "NOT f AND (nws_flash_flood_warning OR nws_severe_thunderstorm_warning OR nws_tornado_watch)"}
_HOURS = "SELECT CAST(range AS INTEGER) AS k FROM range(1, 49)"
_add("str_07_rolling_digest", _rolling, W + "," + _EP.replace("TS", "reported_ts") + """, folds AS (SELECT incident_number FROM ranked WHERE rk > 1), d AS (SELECT inc.*, incident_number IN (SELECT incident_number FROM folds) AS f FROM inc),
 w AS (SELECT d.*, k <= 24 AS late, date_trunc('hour', created_at) + INTERVAL 1 HOUR * k AS until FROM d, (""" + _HOURS + f""") h)
 SELECT {_dts('until')}, count(*) FILTER (late AND NOT f) AS "new", count(*) FILTER (NOT late AND NOT f) AS previous, """ + ", ".join(f"count(*) FILTER (late AND ({c})) AS {n}" for n, c in _WHAT.items()) + " FROM w GROUP BY 1")


def _top_roads(s: SparkSession, d: str) -> DataFrame:
    return jobs.top_roads(jobs.rolling_roads(_roads(s, d).select("created_at", "corridors"))).select(_ts("until"), "rank", "road", "n")


_add("str_07_rolling_roads", _top_roads, W + f", w AS (SELECT unnest(corridors) AS road, date_trunc('hour', created_at) + INTERVAL 1 HOUR * k AS until FROM inc, ({_HOURS}) h WHERE k <= 24), n AS (SELECT until, road, count(*) AS n FROM w GROUP BY 1, 2) SELECT {_dts('until')}, CAST(row_number() OVER o AS INTEGER) AS rank, road, n FROM n WINDOW o AS (PARTITION BY until ORDER BY n DESC, road) QUALIFY row_number() OVER o <= 5")
_add("str_07_rolling_budget", lambda s, d: jobs.rolling_budget(b._view(s, d, "events").filter("event_type = 'click'").select(F.col("ts").cast("timestamp_ntz").alias("requested_at"))).select(_ts("until"), "used", "left"), f"SELECT {_dts('until')}, count(*) AS used, greatest(100 - count(*), 0) AS \"left\" FROM (SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR * k AS until FROM events, ({_HOURS}) h WHERE event_type = 'click' AND k <= 24) GROUP BY 1")


def _feed_stream(s: SparkSession, d: str) -> DataFrame:
    rows = b.event_stream(s, d).select(F.col("ts").cast("timestamp").alias("check_ts"), (F.col("event_type") != "error").alias("ok"))
    return _drained(s, lambda: jobs.feed_check_windows(rows)).select(_ts("hour"), "n_ok", "n_failed")


_add("str_05_feed_check_stream", _feed_stream, f"SELECT {_dts('h', 'hour')}, count(*) FILTER (event_type <> 'error') AS n_ok, count(*) FILTER (event_type = 'error') AS n_failed FROM (SELECT *, date_trunc('hour', ts) AS h, max(ts) OVER () AS newest FROM events) GROUP BY h, newest HAVING h + INTERVAL 1 HOUR <= newest - INTERVAL 10 MINUTE")


def _sessions(s: SparkSession, d: str) -> DataFrame:
    out = _drained(s, lambda: jobs.episodes_stream(with_reported_ts(b.incidents(s, d, b.event_stream(s, d))).withColumn("reported_ts", F.col("reported_ts").cast("timestamp"))))
    return out.select("location_key", "incident_number", F.array_join("extras", ",").alias("extras"), _ts("first_ts"), _ts("last_ts"), "n_listings")


_add("str_06_session_stream", _sessions, W + "," + _EP.replace("TS", "reported_ts") + f""", e AS (SELECT max(reported_ts) AS newest FROM rows), x AS (SELECT location_key, no, coalesce(string_agg(incident_number, ',' ORDER BY reported_ts, incident_number) FILTER (rk > 1), '') AS extras, max(incident_number) FILTER (rk = 1) AS incident_number, min(first_ts) AS first_ts, max(last_ts) AS last_ts, count(*) AS n_listings FROM ranked GROUP BY 1, 2)
 SELECT location_key, incident_number, extras, {_dts('first_ts')}, {_dts('last_ts')}, n_listings FROM x, e WHERE last_ts + INTERVAL 15 MINUTE <= newest - INTERVAL 6 MINUTE""")


def _weather(s: SparkSession, d: str) -> DataFrame:
    """Live observations as one batch, then those of the archive and the live ones once more as a second."""
    source = F.when(F.col("l_orderkey") % 3 == 0, "archive").otherwise("live")
    log = stored(b.weather_obs(s, d).select("obs_ts", "temp_f", "precip_in", "visibility_mi", "wind_mph", "wx", source.alias("source")), "observations")
    table = state.weather_log(s, scratch(s, "weather_log"))
    _fed(s, [log.filter("source = 'live'"), log], state.weather_stream(table))
    out = state.resolve_hours(table.read())
    return out.select(_ts("hour"), F.round("precip_in", 6).alias("precip_in"), "visibility_mi", F.round("wind_mph", 6).alias("wind_mph"), "wx", "archived")


_add("str_10_weather_stream", _weather, _feeds.SQL_OF_HOURS)


# ---- SQL functions
def _sql_roads(s: SparkSession, d: str) -> DataFrame:
    """The SQL functions of road names over all incidents: roads by the scalar and by the table function."""
    inc = b.incidents(s, d)
    sql.register_roads(s, inc, scratch(s, "roads"))
    return s.sql("SELECT incident_number, coalesce(array_join(corridors(location), '|'), '') AS corridors, normalize_road(split_part(upper(trim(location)), '/', 1)) AS first_road, (SELECT count(*) FROM roads_of(location)) AS n_roads FROM {inc}", inc=inc)


_add("sql_road_functions", _sql_roads, W + ", c AS (SELECT incident_number, CASE user_id % 10 WHEN 0 THEN 'AMBASSADOR CAFFERY PKWY|CURRAN LN' WHEN 1 THEN 'JOHNSTON ST|W CONGRESS ST' WHEN 2 THEN 'PINHOOK RD|W BENDEL RD' WHEN 7 THEN 'E BROUSSARD RD|DUHON RD' ELSE array_to_string(corridors, '|') END AS corridors, CASE user_id % 10 WHEN 8 THEN 'AMBASSADOR CAFFERY PKWY AT KALISTE SALOOM RD' ELSE coalesce(corridors[1], '') END AS first_road FROM inc) SELECT *, CAST(CASE WHEN corridors = '' THEN 0 ELSE len(string_split(corridors, '|')) END AS BIGINT) AS n_roads FROM c")


# ---- sources and sinks
def _csv(s: SparkSession, d: str) -> DataFrame:
    """Incidents written as CSV under other columns and in another order, and read back."""
    rows = b.incidents(s, d).select(F.lit("x").alias("unknown"), F.when(F.col("event_id") % 5 == 0, "NaN").otherwise(F.col("longitude").cast("string")).alias("longitude"), "cause", F.concat(F.lit(" "), F.col("incident_number"), F.lit(" ")).alias("incident_number"), F.when(F.col("event_id") % 4 > 0, F.col("location")).otherwise("  ").alias("location"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.when(F.col("event_id") % 6 == 0, "many").otherwise(F.col("geocode_attempts").cast("string")).alias("geocode_attempts"))
    path = scratch(s, "csv")
    rows.write.option("header", True).csv(path)
    out = feed.read_archive_csv(s, path)
    return out.select("incident_number", "cause", F.upper("location").alias("location"), "longitude", "latitude", _ts("created_at"), "geocode_attempts")


_add("src_02_archive_csv", _csv, W + f"SELECT incident_number, cause, CASE WHEN event_id % 4 > 0 THEN upper(nullif(trim(location), '')) END AS location, CASE WHEN event_id % 5 > 0 THEN longitude END AS longitude, CAST(NULL AS DOUBLE) AS latitude, {_dts('created_at')}, CASE WHEN event_id % 6 > 0 THEN geocode_attempts END AS geocode_attempts FROM inc")


def _archive(s: SparkSession, d: str) -> DataFrame:
    """Two overlapping batches, the second given twice; then read in the fixed projection."""
    inc, path = b.incidents(s, d), scratch(s, "archive")
    early = inc.filter("created_at < TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    sinks.append_archive(early, path)
    for _ in range(2):
        sinks.append_archive(inc, path)
    return feed.read_archive(s, path).select("incident_number", "cause", "latitude", "longitude", _ts("created_at"), "geocode_attempts", "observation_count")


_add("snk_01_src_03_archive", _archive, W + f"SELECT incident_number, cause, latitude, longitude, {_dts('created_at')}, geocode_attempts, CAST(NULL AS INTEGER) AS observation_count FROM inc")


def _upserted(s: SparkSession, d: str) -> DataFrame:
    """The archive of all incidents, with new attempts for those of the last days."""
    inc, path = b.incidents(s, d), scratch(s, "archive")
    sinks.append_archive(inc, path)
    sinks.upsert_archive(inc.filter("created_at >= TIMESTAMP_NTZ '2024-01-20 00:00:00'").withColumn("geocode_attempts", F.col("geocode_attempts") + 10), path)
    return feed.read_archive(s, path).groupBy("geocode_attempts").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("incident_number").alias("incidents"))


_add("jn_02_archive_upsert", _upserted, W + "SELECT CAST(geocode_attempts + CASE WHEN created_at >= TIMESTAMP '2024-01-20 00:00:00' THEN 10 ELSE 0 END AS INTEGER) AS geocode_attempts, count(*) AS n, count(DISTINCT incident_number) AS incidents FROM inc GROUP BY 1")


def _station_json(s: SparkSession, d: str) -> DataFrame:
    value = lambda c, n: F.struct(F.struct(c.cast("double").alias("value")).alias(n))[n].alias(n)
    obs = b.weather_obs(s, d)
    props = F.struct(F.date_format("obs_ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"), value((F.col("temp_f") - 32) * 5 / 9, "temperature"), value(F.col("precip_in") * 25.4, "precipitationLastHour"), value(F.col("visibility_mi") * 1609.344, "visibility"), value(F.col("wind_mph") * 1.609344, "windSpeed"), F.concat(F.lit("KLFT AUTO "), F.col("wx")).alias("rawMessage"))
    payload = F.to_json(F.struct(F.array(F.struct(props.alias("properties"))).alias("features")))
    out = feed.parse_station_json(obs.select(payload.alias("payload")))
    return out.groupBy(F.date_format("obs_ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("temp_f"), 1).alias("temp_f"), F.count("precip_in").alias("rain_known"), F.round(F.sum("precip_in"), 2).alias("precip_in"), F.count("visibility_mi").alias("seen"), F.round(F.sum("wind_mph"), 0).alias("wind_mph"))


_add("src_06_station_json", _station_json, "WITH " + b.WEATHER + ", o AS (SELECT *, coalesce(precip_in, CASE WHEN wx <> '-RA' THEN 0 END) AS rain FROM weather_obs) SELECT strftime(obs_ts, '%Y-%m') AS month, count(*) AS n, round(sum(round(temp_f, 1)), 1) AS temp_f, count(rain) AS rain_known, round(sum(round(rain, 3)), 2) AS precip_in, count(visibility_mi) AS seen, round(sum(round(wind_mph, 1)), 0) AS wind_mph FROM o GROUP BY 1")


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    """Snapshots of the feed, one for each hour, as JSON files that are read as a stream."""
    cell = lambda c: F.concat(F.lit("<td>"), F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.col("location")), cell(F.col("cause")), cell(F.col("reported")), cell(F.col("assisting")), F.lit("</tr>"))
    hours = b.incidents(s, d).groupBy(F.date_trunc("HOUR", "created_at").alias("h")).agg(F.concat_ws("", F.collect_list(row)).alias("rows"))  # the listings of one hour
    body = F.to_json(F.struct((F.hour("h") != 3).alias("success"), F.concat(F.lit("<table><tr><th>Location</th></tr>"), F.col("rows"), F.lit("</table>")).alias("data")))
    path = scratch(s, "snapshots")
    hours.select(F.date_format("h", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("sweep_ts"), body.alias("payload")).write.json(path)
    out = _drained(s, lambda: feed.parse_snapshots(feed.snapshot_stream(s, path, 100)).select("sweep_ts", "cause", "assisting", "reported"))
    return out.groupBy("cause", "assisting").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sweep_ts").alias("sweeps"), F.count_distinct("reported").alias("times"))


_add("src_10_snapshot_stream", _snapshots, W + "SELECT cause, assisting, count(*) AS n, count(DISTINCT date_trunc('hour', created_at)) AS sweeps, count(DISTINCT reported) AS times FROM inc WHERE hour(created_at) <> 3 GROUP BY 1, 2")
