"""The column vocabulary as temporary SQL functions that Catalyst inlines (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.functions import roads, times
from dispatchlake.functions.geo import DEGREE_M

_FOLD = "upper(trim(regexp_replace(coalesce({0}, ''), '(?U)\\\\s+', ' ')))"


def _groups(pattern: str, n: int) -> str:
    """As times._groups: a pattern's groups by one match."""
    body = pattern if pattern.startswith("^") else f"^.*?{pattern}.*$"
    return f"split(regexp_replace(s, r'{body}', concat_ws('|', '\\u0001', " + ", ".join(f"'${k}'" for k in range(1, n + 1)) + r")), r'\|')"


def _time(groups: str, year: str, month: int, day: int, hour: int, half: int | None) -> str:
    """SQL of the time that an array of groups spells; a missing clock is midnight."""
    num = lambda k: f"try_cast(g[{k}] AS INT)"
    mark = f"g[{half}]" if half else "''"
    clock = f"CASE WHEN g[{hour}] = '' THEN 0 WHEN {mark} <> '' AND {num(hour)} BETWEEN 1 AND 12 THEN {num(hour)} % 12 + if(lower({mark}) = 'pm', 12, 0) WHEN {mark} = '' AND {num(hour)} BETWEEN 0 AND 23 THEN {num(hour)} END"
    made = f"try_make_timestamp_ntz({year}, {num(month)}, {num(day)}, {clock}, if(g[{hour}] = '', 0, {num(hour + 1)}), 0)"
    return f"transform(array({groups}), g -> if(g[0] = '\\u0001', {made}, NULL))[0]"


_YEAR = "CASE WHEN length(g[3]) = 2 THEN try_cast(g[3] AS INT) + if(try_cast(g[3] AS INT) <= 69, 2000, 1900) ELSE try_cast(g[3] AS INT) END"
_CLEAN = r"trim(regexp_replace(regexp_replace(coalesce(reported, ''), '(?U)\\s+', ' '), '[|\u0001]', '?'))"
_REPORTED = "transform(array(" + _CLEAN + "), s -> coalesce(" + _time(_groups(times._SLASH, 6), _YEAR, 1, 2, 4, 6) + ", " + _time(_groups(times._DASH, 5), "try_cast(g[1] AS INT)", 2, 3, 4, None) + "))[0]"
_PLANE = f"named_struct('ax', (a_lon - lon) * cos(radians(lat)) * {DEGREE_M}D, 'ay', (a_lat - lat) * {DEGREE_M}D, 'dx', (b_lon - a_lon) * cos(radians(lat)) * {DEGREE_M}D, 'dy', (b_lat - a_lat) * {DEGREE_M}D)"
_ALONG = "if(p.dx * p.dx + p.dy * p.dy > 0, greatest(0D, least(1D, -(p.ax * p.dx + p.ay * p.dy) / (p.dx * p.dx + p.dy * p.dy))), 0D)"
FUNCTIONS = {
    "reported_ts(reported STRING) RETURNS TIMESTAMP_NTZ": _REPORTED,
    "seg_dist_m(lat DOUBLE, lon DOUBLE, a_lat DOUBLE, a_lon DOUBLE, b_lat DOUBLE, b_lon DOUBLE) RETURNS DOUBLE": f"transform(array({_PLANE}), p -> sqrt(pow(p.ax + {_ALONG} * p.dx, 2) + pow(p.ay + {_ALONG} * p.dy, 2)))[0]",
    "location_key(location STRING) RETURNS STRING": _FOLD.format("location"),
    "content_key(location STRING, cause STRING, reported STRING) RETURNS STRING": "concat_ws('|', " + ", ".join(_FOLD.format(c) for c in ("location", "cause", "reported")) + ")",
    "condition_code(precip DOUBLE, visibility DOUBLE, wx STRING) RETURNS STRING": "CASE WHEN precip >= 0.30 THEN 'h' WHEN precip >= 0.01 OR coalesce(wx, '') RLIKE 'RA|DZ|TS|SN|PL|GR|FZ|UP' THEN 'r' WHEN visibility < 1.0 OR coalesce(wx, '') RLIKE 'FG' THEN 'f' WHEN precip IS NULL AND visibility IS NULL THEN '-' ELSE 'd' END",
    "cause_severity(cause STRING) RETURNS INT": "CASE WHEN upper(cause) LIKE '%FATAL%' THEN 100 WHEN upper(cause) RLIKE 'W/\\\\s*INJ|WITH\\\\s+INJ' THEN 90 WHEN upper(cause) LIKE '%HIT%' AND upper(cause) RLIKE 'RUN|&' THEN 80 WHEN upper(cause) LIKE '%MAJOR%' THEN 70 WHEN upper(cause) LIKE '%UNK%' AND upper(cause) LIKE '%INJ%' THEN 60 WHEN upper(cause) LIKE '%MINOR%' THEN 50 WHEN upper(cause) RLIKE 'ACCIDENT|CRASH|COLLISION' THEN 45 WHEN upper(cause) LIKE '%RESCUE%' THEN 20 WHEN upper(cause) RLIKE 'STALL|DISABLED' THEN 15 ELSE 30 END",
}


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def register_roads(spark: SparkSession, locations: DataFrame, path: str) -> None:
    """SQL functions of road names: ``normalize_road(name)``, ``corridors(location)`` and, as a table function,
    ``roads_of(location)`` with columns no and road.

    The rules of names are too long to be copied into each use, so they run once for each distinct location of
    ``locations`` and each name between its separators, and are stored under ``path``. The functions look them up, which
    Spark plans as a join; for a location or name that isn't there they give null (``roads_of``: no rows).
    """
    places = locations.select("location").filter("location IS NOT NULL").distinct()
    names = places.select(F.explode(F.split(F.upper(F.trim("location")), roads.SEPARATOR)).alias("name")).unionByName(places.select(F.col("location").alias("name"))).distinct()
    places.groupBy("location").agg(F.first(roads.corridors(F.col("location"))).alias("roads")).write.mode("overwrite").parquet(f"{path}/places")
    names.groupBy("name").agg(F.first(roads.normalize_road(F.col("name"))).alias("road")).write.mode("overwrite").parquet(f"{path}/names")
    spark.read.parquet(f"{path}/places").createOrReplaceTempView("road_places")
    spark.read.parquet(f"{path}/names").createOrReplaceTempView("road_names")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION normalize_road(mention STRING) RETURNS STRING RETURN (SELECT max(n.road) FROM road_names n WHERE n.name = mention)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION corridors(place STRING) RETURNS ARRAY<STRING> RETURN (SELECT max(p.roads) FROM road_places p WHERE p.location = place)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION roads_of(place STRING) RETURNS TABLE(no INT, road STRING) RETURN SELECT r.pos + 1, r.col FROM road_places p LATERAL VIEW posexplode(p.roads) r AS pos, col WHERE p.location = place")
