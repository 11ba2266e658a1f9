"""Which days the collector was running, and the exposure that rates divide by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dispatchlake.functions import times


def coverage(inc: DataFrame, today: str, feed_hours: DataFrame | None = None) -> DataFrame:
    """AGG-16: covered days (date, island, is_full).

    A day with any incident is covered. Islands break where more than a day is missing; their first and last day and
    today are partial. Where the feed log (date, hours) knows a day, it is full with at least 22 hours, unless today.
    The windows run over days, some hundreds a year, not over incidents.
    """
    days = inc.filter("reported_ts IS NOT NULL").select(F.to_date("reported_ts").alias("date")).distinct()
    order = Window.orderBy("date")
    days = days.withColumn("step", F.datediff("date", F.lag("date").over(order))).withColumn("island", F.sum(F.when(F.col("step") <= 1, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    each = Window.partitionBy("island")
    inner = (F.col("date") > F.min("date").over(each)) & (F.col("date") < F.max("date").over(each))
    now = F.to_date(F.lit(today))
    if feed_hours is None:
        full = inner & (F.col("date") != now)
        return days.select("date", "island", full.alias("is_full"))
    out = days.withColumn("inner", inner).join(feed_hours, "date", "left")
    full = F.when(F.col("hours").isNotNull(), F.col("hours") >= 22).otherwise(F.col("inner")) & (F.col("date") != now)
    return out.select("date", "island", full.alias("is_full"))


def islands(cov: DataFrame) -> DataFrame:
    """First and last day of each island and the gap in days before it."""
    one = cov.groupBy("island").agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count(F.lit(1)).alias("days"))
    gap = F.datediff("lo", F.lag("hi").over(Window.orderBy("island"))) - 1
    return one.withColumn("gap_before", gap).select("island", F.col("lo").cast("string").alias("lo"), F.col("hi").cast("string").alias("hi"), "days", "gap_before")


def feed_checks(checks: DataFrame) -> DataFrame:
    """AGG-13: successful and failed checks of each hour."""
    return checks.groupBy(F.date_trunc("HOUR", "check_ts").alias("hour")).agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))


def feed_hours(hourly: DataFrame) -> DataFrame:
    """AGG-13: hours with a successful check of each day."""
    return hourly.filter("n_ok > 0").groupBy(F.to_date("hour").alias("date")).agg(F.count(F.lit(1)).alias("hours"))


def exposure(cov: DataFrame) -> DataFrame:
    """AGG-17: days and hours behind the covered days: weekdays, weekends, rush and other hours, school hours."""
    weekday, school = F.weekday("date") < 5, times.school_day(F.col("date").cast("timestamp_ntz"))
    return cov.agg(F.count(F.lit(1)).alias("days"), F.count_if(weekday).alias("weekdays"), F.count_if(~weekday).alias("weekend_days"), F.count_if("is_full").alias("full_days"), (F.count_if(weekday) * 5).alias("rush_hours"), (F.count(F.lit(1)) * 24 - F.count_if(weekday) * 5).alias("other_hours"), (F.count_if(school) * 24).alias("school_hours"), (F.count_if(~school) * 24).alias("no_school_hours"))


def daily_calendar(inc: DataFrame, cov: DataFrame) -> DataFrame:
    """AGG-21: crashes of every day from the first to the last covered one; state full, partial or none."""
    ends = cov.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    spine = ends.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    n = inc.groupBy(F.to_date("reported_ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    out = spine.join(cov.select("date", "is_full"), "date", "left").join(n, "date", "left")
    state = F.when(F.col("is_full"), "full").when(F.col("is_full").isNotNull(), "partial").otherwise("none")
    return out.select(F.col("date").cast("string").alias("date"), F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


def monthly_series(inc: DataFrame, cov: DataFrame, least: int = 5) -> DataFrame:
    """AGG-20: crashes on full days of each month and their rate a day; months with fewer full days have no rate."""
    full = cov.filter("is_full")
    days = full.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("days"))
    n = inc.join(full.select("date"), F.to_date(inc["reported_ts"]) == F.col("date")).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    out = days.join(n, "month", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("per_day", F.when(F.col("days") >= least, F.round(F.col("n") / F.col("days"), 6)))


def monthly_gaps(series: DataFrame) -> DataFrame:
    """AGG-20: the series with the months that it lacks between its first and last one, marked as gaps."""
    ends = series.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    first = lambda c: F.to_date(F.concat(F.col(c), F.lit("-01")))
    spine = ends.select(F.explode(F.sequence(first("lo"), first("hi"), F.expr("INTERVAL 1 MONTH"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    return spine.join(series, "month", "left").withColumn("is_gap", F.col("per_day").isNull())
