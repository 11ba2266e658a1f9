"""Hourly weather: merging, exports, gaps, and joins by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dispatchlake.functions.weather import condition_code


def merge_hours(obs: DataFrame, order: tuple[str, ...] = ("obs_ts",)) -> DataFrame:
    """AGG-15: one row for an hour: last temperature, most rain and wind, least visibility, all codes in order."""
    stamp = F.when(F.col("temp_f").isNotNull(), F.struct(*order))
    out = obs.groupBy(F.date_trunc("HOUR", "obs_ts").alias("hour")).agg(
        F.max_by("temp_f", stamp).alias("temp_f"), F.max("precip_in").alias("precip_in"), F.min("visibility_mi").alias("visibility_mi"), F.max("wind_mph").alias("wind_mph"),
        F.collect_set(F.when(F.col("wx") != "", F.col("wx"))).alias("codes"),
    )
    codes = F.sort_array(F.array_distinct(F.split(F.array_join("codes", " "), " ")))
    return out.withColumn("wx", F.array_join(F.filter(codes, lambda x: x != ""), " ")).drop("codes")


def export_weather_hours(hourly: DataFrame) -> DataFrame:
    """SNK-06: first hour and one letter for each hour from it to the last; - where nothing is known.

    The string is assembled by month from the dense spine, then joined in order.
    """
    ends = hourly.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    spine = ends.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    code = condition_code(F.col("precip_in"), F.col("visibility_mi"), F.col("wx"))
    rows = spine.join(hourly.select("hour", code.alias("code")), "hour", "left").withColumn("code", F.coalesce("code", F.lit("-")))
    months = rows.groupBy(F.date_trunc("MONTH", "hour").alias("month")).agg(F.sort_array(F.collect_list(F.struct("hour", "code"))).alias("v"), F.min("hour").alias("lo"))
    months = months.select("month", "lo", F.array_join(F.transform("v", lambda x: x["code"]), "").alias("s"))
    out = months.agg(F.min("lo").alias("lo"), F.sort_array(F.collect_list(F.struct("month", "s"))).alias("v"))
    return out.select(F.date_format("lo", "yyyy-MM-dd'T'HH").alias("start"), F.array_join(F.transform("v", lambda x: x["s"]), "").alias("codes"))


def missing_hours(hourly: DataFrame) -> DataFrame:
    """AGG-51: runs of hours between the first and the last that have no row: first, last and length."""
    ends = hourly.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    spine = ends.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    gone = spine.join(hourly.select("hour"), "hour", "left_anti").withColumn("h", F.floor(F.unix_seconds(F.col("hour").cast("timestamp")) / 3600))
    gone = gone.withColumn("run", F.col("h") - F.row_number().over(Window.orderBy("h")))  # hours of a log, not observations
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return gone.groupBy("run").agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"), F.count(F.lit(1)).alias("hours")).select(text("lo").alias("lo"), text("hi").alias("hi"), "hours")


def backfill_ranges(hourly: DataFrame, days: int = 120, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """AGG-51: what to ask an archive for so that no hour between ``lo`` and ``hi`` (default: the log's ends) is missing:
    ranges of at most ``days`` days that begin with the first missing day left, with their missing hours."""
    ends = hourly.agg(*[(F.lit(v).cast("timestamp_ntz") if v else f("hour")).alias(n) for v, f, n in ((lo, F.min, "lo"), (hi, F.max, "hi"))])
    spine = ends.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    gone = spine.join(hourly.select("hour"), "hour", "left_anti").groupBy(F.to_date("hour").alias("day")).agg(F.count(F.lit(1)).alias("hours"))
    missing = gone.agg(F.sort_array(F.collect_list(F.struct("day", "hours"))).alias("d"))  # days of a log
    kind = "array<struct<first_day:date,last_day:date,hours:bigint>>"
    step = f"""aggregate(d, cast(array() AS {kind}), (s, x) -> CASE WHEN size(s) > 0 AND x.day < date_add(element_at(s, -1).first_day, {days})
      THEN concat(slice(s, 1, size(s) - 1), array(named_struct('first_day', element_at(s, -1).first_day, 'last_day', x.day, 'hours', element_at(s, -1).hours + x.hours)))
      ELSE concat(s, array(named_struct('first_day', x.day, 'last_day', x.day, 'hours', x.hours))) END)"""
    return missing.select(F.explode(F.expr(step)).alias("r")).select(F.col("r.first_day").cast("string").alias("first_day"), F.col("r.last_day").cast("string").alias("last_day"), F.col("r.hours").alias("hours"))


def join_weather_hours(rows: DataFrame, hourly: DataFrame) -> DataFrame:
    """JN-10: rows with the weather of their hour."""
    return rows.withColumn("hour", F.date_trunc("HOUR", "reported_ts")).join(hourly, "hour", "left")


def forecast_asof(inc: DataFrame, grid: DataFrame) -> DataFrame:
    """JN-08: the forecast value whose [start, end) holds the incident's time, else the first of its series.

    ``grid`` has variable, start, end, value. Intervals are posted to the hours they touch, so it is an equi-join.
    """
    posts = grid.withColumn("hour", F.explode(F.sequence(F.date_trunc("HOUR", "start"), F.date_trunc("HOUR", F.expr("end - INTERVAL 1 SECOND")), F.expr("INTERVAL 1 HOUR"))))
    first = grid.filter("value IS NOT NULL").groupBy("variable").agg(F.min_by("value", "start").alias("first_value"))
    all_of = first.agg(F.sort_array(F.collect_list(F.struct("variable", "first_value"))).alias("series"))  # one row; a service has some dozens of variables
    rows = inc.select("incident_number", "reported_ts").withColumn("hour", F.date_trunc("HOUR", "reported_ts")).join(F.broadcast(all_of))
    rows = rows.select("incident_number", "reported_ts", "hour", F.inline("series"))
    met = rows.join(posts, ["hour", "variable"], "left").withColumn("hit", F.when((F.col("reported_ts") >= F.col("start")) & (F.col("reported_ts") < F.col("end")), F.col("value")))
    return met.groupBy("incident_number", "variable").agg(F.coalesce(F.max("hit"), F.max("first_value")).alias("value"))


def attach_last(inc: DataFrame, states: DataFrame, value: str) -> DataFrame:
    """JN-09: the value of the last state row (at, value) at or before each incident.

    Rows of both kinds are sorted together within hours; what an hour begins with is carried over from the table of
    hours (a row for each), so no task sorts more than one hour's rows.
    """
    a = states.select(F.col("at").alias("t"), F.lit(None).cast("string").alias("incident_number"), F.col(value).alias("v"), F.lit(0).alias("o"))
    b = inc.filter("reported_ts IS NOT NULL").select(F.col("reported_ts").alias("t"), "incident_number", F.lit(None).cast(states.schema[value].dataType).alias("v"), F.lit(1).alias("o"))
    both = a.unionByName(b).withColumn("hour", F.date_trunc("HOUR", "t"))
    hours = both.groupBy("hour").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("t"))).alias("last"))
    before = hours.withColumn("carried", F.last("last", ignorenulls=True).over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))).select("hour", "carried")
    w = Window.partitionBy("hour").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("v", F.last("v", ignorenulls=True).over(w)).filter("o = 1").join(before, "hour")
    return out.select("incident_number", F.coalesce("v", "carried").alias(value))
