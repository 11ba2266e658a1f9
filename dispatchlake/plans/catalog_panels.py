"""Registered queries of the parts that complete panels and analytics, with their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.functions import causes, roads
from dispatchlake.operators import coverage as cov_ops
from dispatchlake.operators import episodes as ep_ops
from dispatchlake.operators import filters, insights, panels, road_search, roadstats
from dispatchlake.plans import bindings as b
from dispatchlake.plans.catalog import _CELL, _F_ROWS, _LONG, _MERGE, _STATS, NOW, W, WC, WCOV, _add, _best, _cov, _crashes, _hours, _inc, _long_roads, _roads

_MATRIX = ", f AS (SELECT date FROM cov WHERE is_full), k AS (SELECT isodow(date) - 1 AS dow, count(*) AS days FROM f GROUP BY 1), n AS (SELECT isodow(reported_ts) - 1 AS dow, hour(reported_ts) AS hour, count(*) AS n FROM crashes WHERE is_crash AND CAST(reported_ts AS DATE) IN (SELECT date FROM f) GROUP BY 1, 2), m AS (SELECT dow, hour, n, round(n / days, 6) AS rate FROM n JOIN k USING (dow))"
_add("agg_18_peak_cell", lambda s, d: insights.peak_cell(insights.hour_week_matrix(_crashes(s, d), _cov(s, d))), WCOV + _MATRIX + " SELECT CAST(dow AS INTEGER) AS dow, CAST(hour AS INTEGER) AS hour, n, rate FROM m ORDER BY rate DESC, dow, hour LIMIT 1")
_add("agg_19_hour_counts", lambda s, d: insights.hour_counts(_crashes(s, d)), WC[:-2] + ", n AS (SELECT hour(reported_ts) AS hour, count(*) AS n FROM crashes WHERE is_crash GROUP BY 1) SELECT CAST(r.range AS INTEGER) AS hour, coalesce(n, 0) AS n FROM range(24) r LEFT JOIN n ON n.hour = r.range")
_SERIES = ", g AS (SELECT strftime(date, '%Y-%m') AS month, count(*) AS days FROM cov WHERE is_full GROUP BY 1), c AS (SELECT strftime(reported_ts, '%Y-%m') AS month, count(*) AS n FROM crashes WHERE is_crash AND CAST(reported_ts AS DATE) IN (SELECT date FROM cov WHERE is_full) GROUP BY 1), s AS (SELECT month, days, coalesce(n, 0) AS n, CASE WHEN days >= 5 THEN round(coalesce(n, 0) / days, 6) END AS per_day FROM g LEFT JOIN c USING (month))"
_add("agg_20_monthly_gaps", lambda s, d: cov_ops.monthly_gaps(cov_ops.monthly_series(_crashes(s, d), _cov(s, d))), WCOV + _SERIES + ", m AS (SELECT strftime(unnest(generate_series(CAST((SELECT min(month) FROM s) || '-01' AS DATE), CAST((SELECT max(month) FROM s) || '-01' AS DATE), INTERVAL 1 MONTH)), '%Y-%m') AS month) SELECT month, days, n, per_day, per_day IS NULL AS is_gap FROM m LEFT JOIN s USING (month)")
_add("agg_22_worst_hour", lambda s, d: insights.worst_hour(_crashes(s, d), _cov(s, d)), WCOV + " SELECT CAST(hour(reported_ts) AS INTEGER) AS hour, count(*) AS n, round(count(*) / (SELECT count(*) FROM cov), 6) AS per_day FROM crashes WHERE is_crash GROUP BY hour(reported_ts) ORDER BY n DESC, hour LIMIT 1")
_add("agg_22_median_feed_time", lambda s, d: insights.feed_time_quartiles(_crashes(s, d).withColumn("all", F.lit("all")), "all", "visible_min").select("n", "median"), WC[:-2] + " SELECT count(*) AS n, median(visible_min) AS median FROM crashes WHERE is_crash")
_NIGHT = "(hour(reported_ts) >= 21 OR hour(reported_ts) < 5)"
_add("agg_23_night_severity", lambda s, d: insights.night_severity(_crashes(s, d)), WC[:-2] + f", h AS (SELECT hour(reported_ts) AS hour, round(count(*) FILTER (is_hit_and_run) / count(*), 6) AS share FROM crashes WHERE is_crash GROUP BY 1 HAVING count(*) >= 30 ORDER BY 2 DESC, 1 LIMIT 1) SELECT round(avg(CAST(is_severe AS INTEGER)) FILTER (WHERE {_NIGHT}), 6) AS night_severe, round(avg(CAST(is_severe AS INTEGER)) FILTER (WHERE NOT {_NIGHT}), 6) AS day_severe, CAST((SELECT hour FROM h) AS INTEGER) AS hit_and_run_hour, (SELECT share FROM h) AS hit_and_run_share FROM crashes WHERE is_crash")
_add("agg_25_road_rates", lambda s, d: insights.road_rates(_long_roads(s, d), roadstats.road_stats(*b.road_tables(s, d)), 2406).select("road", "n", "per_week", "per_mile_year"), _LONG + ", " + b.SEGMENTS + _STATS + " SELECT road, n, round(n / (2406 / 7), 6) AS per_week, CASE WHEN miles > 0 THEN round(n / miles / (2406 / 365.25::DOUBLE), 6) END AS per_mile_year FROM (SELECT road, count(*) AS n FROM r GROUP BY 1) LEFT JOIN stats USING (road)")
_add("agg_34_agency_rates", lambda s, d: insights.agency_rates(causes.with_agencies(_inc(s, d)), 30), W + "SELECT agency, CAST(hour(reported_ts) AS INTEGER) AS hour, count(*) AS n, round(count(*) / 30, 6) AS rate FROM (SELECT lower(unnest(string_split(assisting, ' '))) AS agency, reported_ts FROM inc WHERE assisting <> '' AND reported_ts IS NOT NULL) GROUP BY agency, hour(reported_ts)")


_LATER = "2001-08-03 12:00:00"  # the newest crash is some 36 hours old


def _stale(s: SparkSession, d: str) -> DataFrame:
    rows = _crashes(s, d)
    norm = insights.today_vs_norm(rows, _cov(s, d), _LATER).select("today", "days", "verdict")
    return insights.verdict_if_fresh(norm, rows.agg(F.max("reported_ts").alias("newest")), _LATER)


_add("agg_36_stale_verdict", _stale, WCOV + " SELECT (SELECT count(*) FROM crashes WHERE is_crash AND CAST(reported_ts AS DATE) = DATE '2001-08-03' AND hour(reported_ts) * 60 + minute(reported_ts) <= 720) AS today, count(*) AS days, 'unknown' AS verdict FROM cov WHERE is_full AND date < DATE '2001-08-03' AND isodow(date) = isodow(DATE '2001-08-03')")
for _range, (_bins, _minutes) in panels.TREND_BINS.items():
    _add(f"agg_37_trend_{_range}", lambda s, d, r=_range: panels.trend_of_range(_inc(s, d), NOW, r), W + f", n AS (SELECT CAST(floor(floor(date_diff('second', reported_ts, TIMESTAMP '{NOW}') / 60) / {_minutes}) AS INTEGER) AS bin, count(*) AS n FROM inc WHERE reported_ts IS NOT NULL AND date_diff('second', reported_ts, TIMESTAMP '{NOW}') BETWEEN 0 AND {_bins * _minutes * 60 - 1} GROUP BY 1), t AS (SELECT CAST(r.range AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range({_bins}) r LEFT JOIN n ON n.bin = r.range) SELECT bin, n, n - lag(n) OVER (ORDER BY bin DESC) AS change FROM t")
_FACETS = filters.Filters(now=NOW, categories={"accident"}, range="24h", agencies={"police"})
_KEPT = "category = 'accident' AND assisting LIKE '%POLICE%'"
_add("agg_38_faceted_tiles", lambda s, d: panels.faceted_tiles(causes.with_agencies(_best(s, d)), _FACETS, NOW), W + _F_ROWS + "SELECT " + ", ".join(f"count(*) FILTER (best >= TIMESTAMP '{NOW}' - INTERVAL {h} HOUR) AS {n}" for h, n in ((24, "last_24h"), (168, "last_7d"), (720, "last_30d"))) + f", count(*) AS total FROM r WHERE {_KEPT}")
_CHOSEN = filters.Filters(now=NOW, cause="HIT AND RUN", agencies={"police"}, year=2024)


def _faceted(s: SparkSession, d: str) -> DataFrame:
    rows = _best(s, d).withColumn("reported_ts", F.col("best_ts"))
    return panels.faceted_counts(causes.with_agencies(rows), _CHOSEN)


_PARTS = {"cause": "cause = 'HIT AND RUN'", "agency": "assisting LIKE '%POLICE%'", "year": "year(best) = 2024"}
_but = lambda k: " AND ".join(v for j, v in _PARTS.items() if j != k)
_add("agg_44_faceted_counts", _faceted, W + _F_ROWS + f"SELECT 'cause' AS facet, cause AS value, count(*) AS n FROM r WHERE {_but('cause')} GROUP BY 2 UNION ALL SELECT 'agency', lower(a), count(*) FROM (SELECT unnest(string_split(assisting, ' ')) AS a FROM r WHERE assisting <> '' AND {_but('agency')}) GROUP BY 2 UNION ALL SELECT 'year', CAST(year(best) AS VARCHAR), count(*) FROM r WHERE {_but('year')} GROUP BY 2 UNION ALL SELECT 'month', CAST(month(best) AS VARCHAR), count(*) FROM r WHERE {_but('')} GROUP BY 2")
_add("agg_41_weather_shares", lambda s, d: insights.weather_shares(b.incidents(s, d)), W + ", t AS (SELECT count(*) FILTER (weather_precip_prob IS NOT NULL OR weather_precip_in IS NOT NULL) AS rain_known, count(*) FILTER (coalesce(weather_precip_prob >= 20, false) OR coalesce(weather_precip_in > 0.005, false)) AS rain, count(weather_wind_mph) AS wind_known, count(*) FILTER (weather_wind_mph >= 20) AS windy, count(weather_visibility_mi) AS sight_known, count(*) FILTER (weather_visibility_mi < 3) AS low_sight FROM inc) SELECT *, round(rain / rain_known, 6) AS rain_share, round(windy / wind_known, 6) AS wind_share, round(low_sight / sight_known, 6) AS low_sight_share FROM t")
_ROADTYPE = "CASE WHEN user_id % 10 = 5 THEN 'motorway' WHEN user_id % 10 = 6 THEN 'trunk' WHEN user_id % 10 IN (0, 1, 2, 3, 4, 7, 8) THEN 'primary' END"
_add("agg_42_summary_changes", lambda s, d: panels.summary_changes(roads.with_road_type(_inc(s, d)), NOW), W + f", a AS (SELECT {_ROADTYPE} AS road_type, date_diff('second', reported_ts, TIMESTAMP '{NOW}') / 86400.0 AS age FROM inc), t AS (SELECT road_type, count(*) AS n FROM a WHERE road_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) SELECT road_type, n, (SELECT CASE WHEN max(age) >= 13 THEN count(*) FILTER (age >= 0 AND age < 7) END FROM a) AS last_week, (SELECT CASE WHEN max(age) >= 13 THEN count(*) FILTER (age >= 7 AND age < 14) END FROM a) AS week_before FROM t")


def _details(s: SparkSession, d: str) -> DataFrame:
    rows = _roads(s, d)
    control = roads.with_corridors(ep_ops.collapse_control(_inc(s, d)))
    return panels.road_details(rows.filter("cause <> 'TRAFFIC CONTROL'"), control, "KALISTE SALOOM RD", NOW)


_ON = "user_id % 10 IN (3, 8)"
_RANKED = "(SELECT '{0}' AS what, CAST(k AS VARCHAR) AS value, CAST(sum(n) AS BIGINT) AS n FROM {1} WHERE k IS NOT NULL GROUP BY k ORDER BY 3 DESC, k LIMIT {2})"
_add("agg_43_road_details", _details, W + f", o AS (SELECT * FROM inc WHERE {_ON} AND cause <> 'TRAFFIC CONTROL'), cc AS (SELECT location_key, CAST(reported_ts AS DATE) AS day, count(*) AS n FROM inc WHERE {_ON} AND cause = 'TRAFFIC CONTROL' AND latitude IS NOT NULL AND reported_ts IS NOT NULL GROUP BY 1, 2), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location_key ORDER BY day DESC) AS rk FROM cc) WHERE rk <= 30), hh AS (SELECT hour(reported_ts) AS k, 1 AS n FROM o), dd AS (SELECT isodow(reported_ts) - 1 AS k, 1 AS n FROM o UNION ALL SELECT isodow(day) - 1, n FROM c), ss AS (SELECT location_key AS k, 1 AS n FROM o UNION ALL SELECT location_key, n FROM c) " + " UNION ALL ".join(_RANKED.format(*x) for x in (("peak_hour", "hh", 1), ("peak_day", "dd", 1), ("spot", "ss", 5))))
_add("agg_45_unlocated_counts", lambda s, d: panels.unlocated_counts(b.incidents(s, d)), W + "SELECT count(*) FILTER (geocode_attempts < 3) AS locating, count(*) FILTER (geocode_attempts >= 3) AS unmappable FROM inc WHERE latitude IS NULL")
_add("agg_46_clamped_extent", lambda s, d: panels.clamped(panels.extent(b.incidents(s, d)), 30.15, -92.1, 30.25, -92.0).select("south", "north", "west", "east"), W + "SELECT greatest(30.15, least(30.25, round(floor(round((min(latitude) - 0.02) / 0.05, 9)) * 0.05, 6))) AS south, greatest(30.15, least(30.25, round(ceil(round((max(latitude) + 0.02) / 0.05, 9)) * 0.05, 6))) AS north, greatest(-92.1, least(-92.0, round(floor(round((min(longitude) - 0.02) / 0.05, 9)) * 0.05, 6))) AS west, greatest(-92.1, least(-92.0, round(ceil(round((max(longitude) + 0.02) / 0.05, 9)) * 0.05, 6))) AS east FROM inc WHERE latitude IS NOT NULL")
_add("agg_50_archive_growth", lambda s, d: panels.archive_growth(b.incidents(s, d)), "SELECT month, added, CAST(sum(added) OVER (ORDER BY month) AS BIGINT) AS total FROM (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS added FROM events GROUP BY 1)")
_add("agg_50_weather_log", lambda s, d: panels.weather_log_status(_hours(s, d)), "WITH " + b.WEATHER + _MERGE + " SELECT strftime(min(hour), '%Y-%m-%d %H:%M:%S') AS first_hour, strftime(max(hour), '%Y-%m-%d %H:%M:%S') AS last_hour, count(*) AS hours, date_diff('hour', min(hour), max(hour)) + 1 - count(*) AS missing FROM m")
_add("agg_08_digest_roads", lambda s, d: panels.digest_roads(_roads(s, d), NOW), W + f", u AS (SELECT unnest(corridors) AS road FROM inc WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND created_at < TIMESTAMP '{NOW}') SELECT road, count(*) AS n FROM u GROUP BY 1 ORDER BY n DESC, road LIMIT 5")
_add("agg_04_grid_members", lambda s, d: panels.grid_members(b.incidents(s, d)), W + f", c AS (SELECT incident_number, {_CELL} FROM inc WHERE latitude IS NOT NULL), t AS (SELECT cell_y, cell_x FROM c GROUP BY 1, 2 ORDER BY count(*) DESC, cell_y, cell_x LIMIT 100) SELECT cell_y, cell_x, incident_number FROM c JOIN t USING (cell_y, cell_x)")

# ---- road names as customers type them: with a letter missing or wrong
_NAMES = ["KALISTE SALOOM", "AMBASSADOR CAFFERY", "johnston street", "PINHOOK", "EVANGELINE THWY", "W CONGRESS", "broussard  duhon", "CURRAN LN", "BENDEL RD", "I-10", "LAFAYETTE LA"]
_TYPED = "concat(substr(name, 1, p - 1), CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE '' END, substr(name, p + 1))"


def _typed_roads(s: SparkSession, d: str) -> DataFrame:
    inc = b.incidents(s, d)
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("c_custkey") % len(_NAMES) + 1).cast("int"))
    keys = b._view(s, d, "customer").select("c_custkey", name.alias("name")).withColumn("p", (1 + F.floor(F.col("c_custkey") / len(_NAMES)) % F.length("name")).cast("int"))
    typed = keys.select(F.expr(_TYPED).alias("typed"))
    n = inc.groupBy(F.coalesce("location", F.lit("")).alias("location")).agg(F.count(F.lit(1)).alias("n"))
    hits = road_search.search(road_search.build(inc), typed)
    return hits.join(n, "location").groupBy("typed").agg(F.count(F.lit(1)).alias("locations"), F.sum("n").alias("incidents"))


_add("flt_27_typed_roads", _typed_roads, W + f""", k AS (SELECT c_custkey, {_NAMES}[c_custkey % {len(_NAMES)} + 1] AS name FROM customer), t AS (SELECT DISTINCT {_TYPED} AS typed FROM (SELECT *, 1 + CAST(floor(c_custkey / {len(_NAMES)}) AS INTEGER) % length(name) AS p FROM k)),
 q AS (SELECT typed, unnest(list_distinct(list_filter(string_split(upper(typed), ' '), lambda x: x <> ''))) AS term FROM t), p AS (SELECT coalesce(location, '') AS location, count(*) AS n FROM inc GROUP BY 1),
 w AS (SELECT location, upper(location) AS text, unnest(string_split_regex(upper(location), '[^A-Z0-9]+')) AS word FROM p), v AS (SELECT DISTINCT word FROM w), u AS (SELECT DISTINCT term FROM q),
 c AS (SELECT DISTINCT term, word FROM u, v WHERE length(term) > 2 AND levenshtein(word, term) <= CASE WHEN length(term) <= 4 THEN 1 ELSE 2 END),
 h AS (SELECT term, location FROM u, p WHERE contains(upper(location), term) UNION SELECT term, location FROM c JOIN w USING (word)),
 m AS (SELECT typed, count(*) AS need FROM q GROUP BY 1), f AS (SELECT typed, location FROM q JOIN h USING (term) JOIN m USING (typed) GROUP BY typed, location, need HAVING count(*) = need)
 SELECT typed, count(*) AS locations, CAST(sum(n) AS BIGINT) AS incidents FROM f JOIN p USING (location) GROUP BY 1""")
