"""The engine's tables made from the driver's tables, as DataFrames and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"

_ROAD = """CASE user_id % 10
  WHEN 0 THEN concat(100*(1+user_id%97),' AMBASSADOR CAFFERY PKWY/CURRAN LN')
  WHEN 1 THEN concat(100*(1+user_id%97),' JOHNSTON STREET/W CONGRESS ST')
  WHEN 2 THEN concat(100*(1+user_id%97),' W PINHOOK RD/W BENDEL RD')
  WHEN 3 THEN concat(100*(1+user_id%97),' KALISTE SALOOM')
  WHEN 4 THEN concat(100*(1+user_id%97),' NW EVANGELINE THWY')
  WHEN 5 THEN 'I-10 E' WHEN 6 THEN 'US HWY 90 EAST'
  WHEN 7 THEN concat(100*(1+user_id%97),' E BROUSSARD/DUHON RD')
  WHEN 8 THEN 'AMBASSADOR CAFFERY PKWY AT KALISTE SALOOM RD' ELSE '' END"""
_TOWN = "CASE user_id % 3 WHEN 0 THEN ' LAFAYETTE, LA' WHEN 1 THEN ' BROUSSARD, LA' ELSE ' LAF PARISH, LA' END"
_CAUSE = """CASE WHEN event_type='click' THEN 'TRAFFIC ACCIDENT MINOR' WHEN event_type='purchase' THEN 'TRAFFIC ACCIDENT MAJOR'
  WHEN event_type='error' THEN 'HIT AND RUN' WHEN event_type='signup' AND event_id % 2 = 0 THEN 'STALLED VEHICLE'
  WHEN event_type='signup' THEN 'TRAFFIC SIGNAL MALFUNCTION' WHEN event_id % 2 = 0 THEN 'TRAFFIC CONTROL' ELSE 'ROAD HAZARD' END"""


def _incidents(text) -> str:
    """SELECT text of the incidents in either dialect; text(pattern number) formats ts."""
    return f"""SELECT event_id, user_id, concat('INC', event_id) AS incident_number,
  CASE WHEN event_id % 7 = 0 THEN concat('  ', lower(concat({_ROAD}, {_TOWN})), '  ') ELSE trim(concat({_ROAD}, {_TOWN})) END AS location,
  {_CAUSE} AS cause,
  CASE WHEN event_id % 101 = 0 THEN 'N/A' WHEN event_id % 5 = 0 THEN {text(0)} WHEN event_id % 5 = 1 THEN {text(1)} WHEN event_id % 5 = 2 THEN {text(2)}
    WHEN event_id % 5 = 3 THEN {text(3)} ELSE {text(4)} END AS reported,
  CASE event_id % 4 WHEN 0 THEN 'POLICE' WHEN 1 THEN 'POLICE FIRE' WHEN 2 THEN 'SHERIFF' ELSE '' END AS assisting,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE (30150000 + (user_id % 97)*1000 + (event_id % 3)*10)/CAST(1000000 AS DOUBLE) END AS latitude,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE (-92100000 + (user_id % 89)*1000)/CAST(1000000 AS DOUBLE) END AS longitude,
  ts AS created_at, ts AS first_seen_at, ts + INTERVAL '1' MINUTE * (event_id % 180) AS last_seen_at,
  CAST(event_id % 5 AS INT) AS geocode_attempts, CASE event_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'approximate' END AS geocode_confidence,
  CASE WHEN event_id % 6 = 0 OR event_id % 13 = 0 THEN NULL ELSE 40 + user_id % 60 END AS weather_temp_f,
  CASE WHEN event_id % 6 = 0 OR event_id % 13 = 0 THEN NULL ELSE event_id % 100 END AS weather_precip_prob,
  CASE WHEN event_id % 9 = 0 OR event_id % 13 = 0 THEN NULL ELSE (event_id % 60) / CAST(100 AS DOUBLE) END AS weather_precip_in,
  CASE WHEN event_id % 13 <> 0 THEN event_id % 40 END AS weather_wind_mph, CASE WHEN event_id % 13 <> 0 THEN event_id % 14 END AS weather_visibility_mi, CASE WHEN event_id % 13 <> 0 THEN event_id % 101 END AS weather_cloud_pct,
  event_id % 50 = 0 AS nws_flash_flood_warning, event_id % 70 = 0 AS nws_severe_thunderstorm_warning, event_id % 90 = 0 AS nws_tornado_watch
FROM events"""


_SPARK_FORMATS = ["MM/dd/yyyy hh:mm a", "MM/dd/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm", "MM/dd/yy HH:mm"]
_DUCK_FORMATS = ["%m/%d/%Y %I:%M %p", "%m/%d/%Y %H:%M", "%m/%d/%Y %H:%M:%S", "%Y-%m-%d %H:%M", "%m/%d/%y %H:%M"]

#: inc: the incidents with what parsing must find (reported_ts in full mode, strict_ts in strict4 mode).
INC = f"""inc AS (SELECT *, CASE WHEN event_id % 101 = 0 THEN NULL ELSE date_trunc('minute', created_at) END AS reported_ts,
  CASE WHEN event_id % 101 = 0 OR event_id % 5 > 2 THEN NULL WHEN event_id % 5 = 2 THEN date_trunc('second', created_at) ELSE date_trunc('minute', created_at) END AS strict_ts,
  upper(trim(regexp_replace(location, '\\s+', ' ', 'g'))) AS location_key,
  CASE WHEN cause LIKE '%ACCIDENT%' OR cause = 'HIT AND RUN' THEN 'accident' WHEN cause = 'ROAD HAZARD' THEN 'hazard' WHEN cause = 'STALLED VEHICLE' THEN 'vehicle' ELSE 'control' END AS category,
  CASE cause WHEN 'HIT AND RUN' THEN 80 WHEN 'TRAFFIC ACCIDENT MAJOR' THEN 70 WHEN 'TRAFFIC ACCIDENT MINOR' THEN 50 WHEN 'STALLED VEHICLE' THEN 15 ELSE 30 END AS severity,
  CASE user_id % 10 WHEN 0 THEN ['AMBASSADOR CAFFERY PKWY'] WHEN 1 THEN ['JOHNSTON ST'] WHEN 2 THEN ['PINHOOK RD'] WHEN 3 THEN ['KALISTE SALOOM RD'] WHEN 4 THEN ['EVANGELINE THRUWAY'] WHEN 5 THEN ['I-10']
    WHEN 6 THEN ['US 90'] WHEN 7 THEN ['E BROUSSARD RD'] WHEN 8 THEN ['AMBASSADOR CAFFERY PKWY', 'KALISTE SALOOM RD'] ELSE CAST([] AS VARCHAR[]) END AS corridors
  FROM ({_incidents(lambda k: f"strftime(ts, '{_DUCK_FORMATS[k]}')")}))"""


def _view(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of their files (as a pattern, since the table may be one file).

    The files of a table are in no order of time, so they are taken together: one after another, what a later file has from
    before the end of an earlier one would be late and be dropped.
    """
    return spark.readStream.schema(_view(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")


def incidents(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    events = (_view(spark, sf_dir, "events") if events is None else events).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return spark.sql(_incidents(lambda k: f"date_format(ts, '{_SPARK_FORMATS[k]}')").replace("FROM events", "FROM {events}"), events=events)


_CRASHES = """SELECT concat('ORD', o_orderkey) AS incident_number, o_orderkey,
  ts0 + INTERVAL '1' HOUR * (o_orderkey % 24) + INTERVAL '1' MINUTE * (o_custkey % 60) AS reported_ts,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'TRAFFIC ACCIDENT MAJOR' WHEN '2-HIGH' THEN 'HIT AND RUN' WHEN '3-MEDIUM' THEN 'TRAFFIC ACCIDENT MINOR' WHEN '4-NOT SPECIFIED' THEN 'STALLED VEHICLE' ELSE 'ROAD HAZARD' END AS cause,
  CAST(o_custkey % 10 AS INT) AS road_no, (30150000 + (o_custkey % 97) * 1000) / CAST(1000000 AS DOUBLE) AS latitude, (-92100000 + (o_custkey % 89) * 1000) / CAST(1000000 AS DOUBLE) AS longitude,
  CAST(o_orderkey % 180 AS INT) AS visible_min
FROM orders0"""
#: ts0 of an order. Those of spring 1997 are moved on to summer, so that the table has a gap in its days.
_ORDERED = "ordered + INTERVAL '1' DAY * (CASE WHEN ordered >= TIMESTAMP '1997-03-01 00:00:00' AND ordered < TIMESTAMP '1997-06-01 00:00:00' THEN 92 ELSE 0 END)"
LONG_ROADS = ["AMBASSADOR CAFFERY PKWY", "OAK 1 ST", "OAK 3 ST", "OAK 5 ST"]
LONG_NOW = "2001-08-02 00:00:00"
CRASHES = "crashes AS (SELECT *, cause LIKE '%ACCIDENT%' OR cause = 'HIT AND RUN' AS is_crash, cause = 'TRAFFIC ACCIDENT MAJOR' AS is_severe, cause = 'HIT AND RUN' AS is_hit_and_run FROM (" + _CRASHES.replace("orders0", f"(SELECT *, {_ORDERED} AS ts0 FROM (SELECT *, CAST(o_orderdate AS TIMESTAMP) AS ordered FROM orders))") + "))"


def crashes_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _view(spark, sf_dir, "orders").withColumn("ordered", F.col("o_orderdate").cast("timestamp_ntz")).withColumn("ts0", F.expr(_ORDERED.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")))
    return spark.sql(_CRASHES.replace("FROM orders0", "FROM {orders}"), orders=orders)


_WEATHER = """SELECT ts0 + INTERVAL '1' HOUR * (l_orderkey % 24) + INTERVAL '1' MINUTE * (l_linenumber * 7 % 60) AS obs_ts, CAST(40 + l_quantity AS DOUBLE) AS temp_f,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_tax AS DOUBLE) * 5 WHEN l_linenumber % 5 = 0 THEN NULL ELSE 0 END AS precip_in,
  CASE WHEN l_partkey % 20 = 0 THEN CAST(0.5 AS DOUBLE) WHEN l_partkey % 31 = 0 THEN NULL ELSE 10 END AS visibility_mi, CAST(l_discount AS DOUBLE) * 300 AS wind_mph,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN '-RA' WHEN l_partkey % 20 = 0 THEN 'FG' ELSE '' END AS wx, l_linenumber AS seq, l_orderkey
FROM lineitem0"""
WEATHER = "weather_obs AS (" + _WEATHER.replace("lineitem0", "(SELECT *, CAST(l_shipdate AS TIMESTAMP) AS ts0 FROM lineitem)") + ")"


def weather_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _view(spark, sf_dir, "lineitem").withColumn("ts0", F.col("l_shipdate").cast("timestamp_ntz"))
    return spark.sql(_WEATHER.replace("FROM lineitem0", "FROM {lines}"), lines=lines)


_SEGMENTS = """SELECT concat('055_R', p_partkey % 20, '_', 1 + p_partkey % 2, '_', CASE WHEN p_partkey % 9 = 0 THEN 'A' ELSE '1' END, '_010') AS route_id,
  (p_partkey % 50) / CAST(10 AS DOUBLE) AS from_mi, (p_partkey % 50 + p_size) / CAST(10 AS DOUBLE) AS to_mi,
  CASE WHEN p_partkey % 17 = 0 THEN 'Proposed Rd' WHEN p_partkey % 2 = 0 THEN 'Ambassador Caffery Pkwy' ELSE concat('Oak ', p_partkey % 20, ' Street') END AS full_name, p_partkey FROM part0"""
_COUNTS = """SELECT concat('055_R', p_partkey % 20, '_', 1 + p_partkey % 2, '_1_010') AS route_id, (p_partkey % 30) / CAST(5 AS DOUBLE) AS from_mi, (p_partkey % 30 + 5) / CAST(5 AS DOUBLE) AS to_mi,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_retailprice AS DOUBLE) * 20 END AS aadt, p_partkey FROM part0"""
SEGMENTS = "segs AS (" + _SEGMENTS.replace("part0", "part") + "), counts AS (" + _COUNTS.replace("part0", "part") + ")"


def road_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = _view(spark, sf_dir, "part")
    return tuple(spark.sql(q.replace("FROM part0", "FROM {part}"), part=part) for q in (_SEGMENTS, _COUNTS))


_LISTINGS = """SELECT concat('INC', event_id) AS incident_number, date_trunc('hour', ts) + INTERVAL '5' MINUTE * (CAST(floor(minute(ts) / 5) AS INT) + 1 + k) AS sweep_ts,
  CASE WHEN k >= 2 THEN 'POLICE FIRE' ELSE 'POLICE' END AS assisting FROM events0 WHERE k <= event_id % 4"""
LISTINGS = "listings AS (" + _LISTINGS.replace("events0", "events CROSS JOIN (VALUES (0),(1),(2),(3)) AS v(k)") + ")"


def listings(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    events = (_view(spark, sf_dir, "events") if events is None else events).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    return spark.sql(_LISTINGS.replace("FROM events0", "FROM {events}"), events=events)


_GEOCODES = """SELECT c_custkey AS result_id, CASE c_custkey % 4 WHEN 0 THEN 'ROOFTOP' WHEN 1 THEN 'RANGE_INTERPOLATED' WHEN 2 THEN 'GEOMETRIC_CENTER' ELSE 'APPROXIMATE' END AS location_type,
  CASE c_custkey % 5 WHEN 0 THEN 'street_address' WHEN 1 THEN 'intersection' WHEN 2 THEN 'locality' WHEN 3 THEN 'route' ELSE 'school' END AS result_type,
  CASE c_custkey % 6 WHEN 0 THEN 'Opelousas' WHEN 1 THEN 'Scott' ELSE 'Lafayette' END AS place,
  (30150000 + (c_custkey % 97) * 12000) / CAST(1000000 AS DOUBLE) AS latitude, (-92100000 + (c_custkey % 89) * 1000) / CAST(1000000 AS DOUBLE) AS longitude FROM customer0"""
GEOCODES = "geo AS (" + _GEOCODES.replace("customer0", "customer") + ")"


def geocode_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _view(spark, sf_dir, "customer")
    return spark.sql(_GEOCODES.replace("FROM customer0", "FROM {customer}"), customer=customer)


_NODES = "SELECT c_custkey AS node_id, (30150000 + CAST(floor(c_custkey / CAST(20 AS DOUBLE)) AS INT) * 5000) / CAST(1000000 AS DOUBLE) AS lat, (-92100000 + (c_custkey % 20) * 5000) / CAST(1000000 AS DOUBLE) AS lon FROM customer"
_EDGES = """SELECT a.c_custkey AS u, b.c_custkey AS v, CASE WHEN a.c_custkey % 3 = 0 THEN 'primary' ELSE 'residential' END AS road_class
FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 20 OR b.c_custkey = a.c_custkey + 1 AND a.c_custkey % 20 <> 19"""
ROADNET = f"nodes AS ({_NODES}), edges AS ({_EDGES})"


def road_network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the lattice over every customer row."""
    key = _view(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("u"))
    nodes = key.select(F.col("u").alias("node_id"), ((30150000 + F.floor(F.col("u") / 20) * 5000) / F.lit(1000000.0)).alias("lat"), ((-92100000 + F.col("u") % 20 * 5000) / F.lit(1000000.0)).alias("lon"))
    ends = F.when(F.col("u") % 20 != 19, F.array(F.col("u") + 20, F.col("u") + 1)).otherwise(F.array(F.col("u") + 20))
    edges = key.withColumn("v", F.explode(ends)).join(key.select(F.col("u").alias("v")), "v", "left_semi")
    return nodes, edges.select("u", "v", F.when(F.col("u") % 3 == 0, "primary").otherwise("residential").alias("road_class"))


def feed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events").select(F.col("ts").cast("timestamp_ntz").alias("check_ts"), (F.col("event_type") != "error").alias("ok"))
