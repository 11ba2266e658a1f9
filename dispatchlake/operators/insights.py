"""Crash analytics: rates by exposure, risk, and the effects of weather, darkness, holidays and school days.

Crash tables have reported_ts, is_severe and is_hit_and_run; ratios come with their numerator and denominator.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dispatchlake.functions import geo, times


def index_quantile(values: Column, q: float) -> Column:
    """The element of a sorted array at floor(q n), at most the last one."""
    return F.element_at(values, F.least(F.size(values), F.floor(F.size(values) * q).cast("int") + 1))


def hour_week_matrix(crashes: DataFrame, cov: DataFrame) -> DataFrame:
    """AGG-18: crashes of each hour and weekday (Monday 0) on full days, and their rate for one such day."""
    full = cov.filter("is_full").select("date")
    days = full.groupBy(F.weekday("date").alias("dow")).agg(F.count(F.lit(1)).alias("days"))
    n = crashes.join(full, F.to_date(crashes["reported_ts"]) == F.col("date")).groupBy(F.weekday("date").alias("dow"), F.hour("reported_ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    spine = crashes.sparkSession.range(168).select(F.floor(F.col("id") / 24).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))
    out = spine.join(n, ["dow", "hour"], "left").join(days, "dow", "left").select("dow", "hour", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("days", F.lit(0)).alias("days"))
    return out.withColumn("rate", F.when(F.col("days") > 0, F.round(F.col("n") / F.col("days"), 6)))


def peak_cell(matrix: DataFrame) -> DataFrame:
    """AGG-18: the hour and weekday with the highest rate (ties: the earliest)."""
    best = F.min(F.struct((-F.col("rate")).alias("rate"), "dow", "hour", "n"))
    return matrix.filter("rate IS NOT NULL").agg(best.alias("b")).select("b.dow", "b.hour", "b.n", (-F.col("b.rate")).alias("rate"))


def hour_counts(crashes: DataFrame) -> DataFrame:
    """AGG-19: crashes of each hour of the day, all 24 of them."""
    spine = crashes.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    n = crashes.groupBy(F.hour("reported_ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(n, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def dow_rates(crashes: DataFrame, cov: DataFrame) -> DataFrame:
    """AGG-19: crashes of each weekday on covered days, the days, and the rate."""
    days = cov.groupBy(F.weekday("date").alias("dow")).agg(F.count(F.lit(1)).alias("days"))
    n = crashes.groupBy(F.weekday("reported_ts").alias("dow")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(n, "dow", "left").select("dow", F.coalesce("n", F.lit(0)).alias("n"), "days", F.round(F.coalesce("n", F.lit(0)) / F.col("days"), 6).alias("rate"))


def month_rates(crashes: DataFrame, cov: DataFrame) -> DataFrame:
    """AGG-19: seasonality, crashes of each month of the year for a covered day."""
    days = cov.groupBy(F.month("date").alias("month")).agg(F.count(F.lit(1)).alias("days"))
    n = crashes.groupBy(F.month("reported_ts").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(n, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"), "days", F.round(F.coalesce("n", F.lit(0)) / F.col("days"), 6).alias("rate"))


def crash_kpis(crashes: DataFrame, cov: DataFrame, days: int | None = None) -> DataFrame:
    """AGG-22: crashes, full days, rate, severe and hit-and-run shares of the period of ``days`` that ends at the newest
    crash (None: all), and the crashes of the equal period before."""
    end = crashes.agg(F.to_date(F.max("reported_ts")).alias("end"))
    rows = crashes.join(F.broadcast(end))  # one row
    age = F.datediff("end", F.to_date("reported_ts"))
    mine = age < days if days else F.lit(True)
    out = rows.agg(F.count_if(mine).alias("n"), F.count_if(mine & F.col("is_severe")).alias("severe"), F.count_if(mine & F.col("is_hit_and_run")).alias("hit_and_run"), F.count_if((age >= days) & (age < 2 * days) if days else F.lit(False)).alias("previous"))
    full = cov.filter("is_full").join(F.broadcast(end)).agg(F.count_if(F.datediff("end", "date") < days if days else F.lit(True)).alias("full_days"))
    share = lambda c: F.when(F.col("n") > 0, F.round(F.col(c) / F.col("n"), 6))
    return out.join(F.broadcast(full)).withColumn("per_day", F.when(F.col("full_days") > 0, F.round(F.col("n") / F.col("full_days"), 6))).withColumn("severe_share", share("severe")).withColumn("hit_and_run_share", share("hit_and_run"))


def worst_hour(crashes: DataFrame, cov: DataFrame) -> DataFrame:
    """AGG-22: the clock hour with most crashes for a covered day (ties: the earliest)."""
    days = cov.agg(F.count(F.lit(1)).alias("days"))
    best = hour_counts(crashes).agg(F.min(F.struct((-F.col("n")).alias("n"), "hour")).alias("b"))
    return best.join(F.broadcast(days)).select("b.hour", (-F.col("b.n")).alias("n"), F.round(-F.col("b.n") / F.col("days"), 6).alias("per_day"))  # one row each


def night_severity(crashes: DataFrame, least: int = 30) -> DataFrame:
    """AGG-23: severe share at night (21 to 5) and by day, and the hour with the highest hit-and-run share among those
    with at least ``least`` crashes (ties: the earliest)."""
    hour = F.hour("reported_ts")
    night = (hour >= 21) | (hour < 5)
    share = lambda c: F.round(F.avg(F.when(c, F.col("is_severe").cast("int"))), 6)
    both = crashes.agg(share(night).alias("night_severe"), share(~night).alias("day_severe"))
    hours = severity_by_hour(crashes, least).agg(F.min(F.struct((-F.col("hit_and_run_share")).alias("share"), "hour")).alias("b"))
    return both.join(F.broadcast(hours)).select("night_severe", "day_severe", F.col("b.hour").alias("hit_and_run_hour"), (-F.col("b.share")).alias("hit_and_run_share"))  # one row each


def severity_by_hour(crashes: DataFrame, least: int = 20) -> DataFrame:
    """AGG-23: severe and hit-and-run share of the hours with at least ``least`` crashes."""
    one = crashes.groupBy(F.hour("reported_ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_severe").alias("severe"), F.count_if("is_hit_and_run").alias("hit_and_run")).filter(F.col("n") >= least)
    return one.withColumn("severe_share", F.round(F.col("severe") / F.col("n"), 6)).withColumn("hit_and_run_share", F.round(F.col("hit_and_run") / F.col("n"), 6))


def block_ranking(crashes: DataFrame, place: str, least: int = 3, top_n: int = 12) -> DataFrame:
    """AGG-24: places with most crashes: severe and hit-and-run counts, mean position and peak hour (ties: earliest)."""
    hours = crashes.groupBy(place, F.hour("reported_ts").alias("hour")).agg(F.count(F.lit(1)).alias("k"), F.count_if("is_severe").alias("severe"), F.count_if("is_hit_and_run").alias("hit_and_run"), F.sum("latitude").alias("lat"), F.sum("longitude").alias("lon"), F.count("latitude").alias("m"))
    out = hours.groupBy(place).agg(F.sum("k").alias("n"), F.sum("severe").alias("severe"), F.sum("hit_and_run").alias("hit_and_run"), F.round(F.sum("lat") / F.sum("m"), 5).alias("latitude"), F.round(F.sum("lon") / F.sum("m"), 5).alias("longitude"), F.min(F.struct((-F.col("k")).alias("k"), "hour")).alias("p"))
    return out.filter(F.col("n") >= least).select(place, "n", "severe", "hit_and_run", "latitude", "longitude", F.col("p.hour").alias("peak_hour")).orderBy(F.desc("n"), place).limit(top_n)


def road_ranking(crashes: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """AGG-25: crashes and severe crashes of each road (rows have ``corridors``); with road stats also per mile."""
    one = crashes.select(F.explode("corridors").alias("road"), "is_severe").groupBy("road").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_severe").alias("severe"))
    one = one.withColumn("severe_share", F.round(F.col("severe") / F.col("n"), 6))
    return one if stats is None else one.join(stats, "road", "left").withColumn("per_mile", F.when(F.col("miles") > 0, F.round(F.col("n") / F.col("miles"), 6)))


def road_rates(crashes: DataFrame, stats: DataFrame, days: int) -> DataFrame:
    """AGG-25: the road ranking with crashes a week and a mile-year, over ``days`` days of data."""
    out = road_ranking(crashes, stats)
    return out.withColumn("per_week", F.round(F.col("n") / (days / 7), 6)).withColumn("per_mile_year", F.when(F.col("miles") > 0, F.round(F.col("n") / F.col("miles") / (days / 365.25), 6)))


def risk_ranking(crashes: DataFrame, stats: DataFrame, days: Column | int, least: int = 40, miles: float = 1.0, per_day: float = 5000.0) -> DataFrame:
    """AGG-26: crashes for a million vehicle-miles of roads with enough crashes, length and traffic."""
    one = crashes.select(F.explode("corridors").alias("road")).groupBy("road").agg(F.count(F.lit(1)).alias("n")).join(stats, "road")
    out = one.filter((F.col("n") >= least) & (F.col("miles") >= miles) & (F.col("vehicle_miles") / F.col("miles") >= per_day))
    return out.withColumn("risk", F.round(F.col("n") / (F.col("vehicle_miles") * days) * 1e6, 6)).select("road", "n", "miles", "vehicle_miles", "risk")


def weather_effect(crashes: DataFrame, cov: DataFrame, hourly: DataFrame, least: int = 5) -> DataFrame:
    """AGG-27: crashes in rain (r, h), heavy rain and fog against what dry hours of the same hour of week would give.

    ``hourly`` has hour and code. Hours of covered days with a code count, with or without crashes; hours of week with
    fewer than ``least`` dry hours are left out.
    """
    hours = hourly.join(cov.select("date"), F.to_date(hourly["hour"]) == F.col("date")).select("hour", "code").filter("code <> '-'")
    n = crashes.groupBy(F.date_trunc("HOUR", "reported_ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    rows = hours.join(n, "hour", "left").select((F.weekday("hour") * 24 + F.hour("hour")).alias("slot"), "code", F.coalesce("n", F.lit(0)).alias("n"))
    by = rows.groupBy("slot", "code").agg(F.count(F.lit(1)).alias("hours"), F.sum("n").alias("n"))
    dry = by.filter((F.col("code") == "d") & (F.col("hours") >= least)).select("slot", (F.col("n") / F.col("hours")).alias("rate"))
    kinds = F.when(F.col("code") == "h", F.array(F.lit("wet"), F.lit("heavy"))).when(F.col("code") == "r", F.array(F.lit("wet"))).when(F.col("code") == "f", F.array(F.lit("fog")))
    out = by.filter("code <> 'd'").join(dry, "slot").select(F.explode(kinds).alias("kind"), "hours", "n", (F.col("hours") * F.col("rate")).alias("expected"))
    out = out.groupBy("kind").agg(F.sum("hours").alias("hours"), F.sum("n").alias("observed"), F.sum("expected").alias("e"))
    return out.select("kind", "hours", "observed", F.round("e", 6).alias("expected"), F.round(F.when(F.col("e") > 0, F.col("observed") / F.col("e")), 6).alias("ratio"))


def darkness_effect(crashes: DataFrame, cov: DataFrame, least: int = 20) -> DataFrame:
    """AGG-28: rate of dark against light hours, over clock hours that have at least ``least`` of both."""
    hours = crashes.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    spine = times.with_darkness(cov.select("date").join(F.broadcast(hours))).select("date", "hour", "light")  # 24 rows
    n = crashes.groupBy(F.to_date("reported_ts").alias("date"), F.hour("reported_ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    by = spine.join(n, ["date", "hour"], "left").groupBy("hour").agg(*[f for k in ("dark", "light") for f in (F.count_if(F.col("light") == k).alias(f"{k}_hours"), F.sum(F.when(F.col("light") == k, F.coalesce("n", F.lit(0)))).alias(f"{k}_n"))])
    out = by.filter((F.col("dark_hours") >= least) & (F.col("light_hours") >= least))
    out = out.agg(F.sum("dark_n").alias("dark_n"), F.sum("dark_hours").alias("dark_hours"), F.sum("light_n").alias("light_n"), F.sum("light_hours").alias("light_hours"), F.sum(F.col("dark_hours") * F.col("light_n") / F.col("light_hours")).alias("e"))
    return out.select("dark_n", "dark_hours", "light_n", "light_hours", F.round("e", 6).alias("expected"), F.round(F.when(F.col("e") > 0, F.col("dark_n") / F.col("e")), 6).alias("ratio"))


SPLIT = 4096  # rows of a cell above which it is split


def followers(crashes: DataFrame, low: int = 3, high: int = 45, metres: float = 500.0, shifts: tuple[int, ...] = (0,), split: int = SPLIT) -> DataFrame:
    """JN-15: (incident_number, shift) of crashes that follow another within ``low`` to ``high`` minutes and ``metres``.

    The earlier ones are moved by each of ``shifts`` days; other shifts than 0 serve as a control. Two steps, neither of
    which pairs the rows of a dense place with each other:

    1. In cells whose diagonal is ``metres``, everything is near enough, so a sweep over the rows in order of time tells
       who follows whom. A cell is swept in stretches of eight times ``high``, so one that holds most crashes is spread.
    2. What is left looks around: earlier crashes are posted to the cells (of four times ``metres``) that they reach into,
       mostly one or two, and meet later ones of the same cell and of their own or the next ``high`` minutes. Cells of
       more than ``split`` rows are split in four, and again in four.
    """
    width, near_side, side = high * 60, metres / geo.DEGREE_M / math.sqrt(2) * 0.999, 4 * metres / geo.DEGREE_M
    rows = crashes.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select("incident_number", F.unix_seconds(F.col("reported_ts").cast("timestamp")).alias("t"), "latitude", "longitude")
    rows = rows.withColumn("shift", F.explode(F.array(*map(F.lit, shifts))))
    early = rows.withColumn("t", F.col("t") + F.col("shift") * 86400)
    # 1. sweep
    chunk = lambda c: F.floor(c / (8 * width))
    posted = early.withColumn("chunk", F.explode(F.array_distinct(F.array(chunk(F.col("t")), chunk(F.col("t") + width))))).withColumn("later", F.lit(0))
    both = rows.withColumn("chunk", chunk(F.col("t"))).withColumn("later", F.lit(1)).unionByName(posted)
    swept = Window.partitionBy("shift", F.floor(F.col("latitude") / near_side), F.floor(F.col("longitude") / near_side), "chunk").orderBy("t").rangeBetween(-width, -low * 60)
    both = both.withColumn("before", F.sum(1 - F.col("later")).over(swept)).filter("later = 1")
    hit = both.filter("before > 0").select("incident_number", "shift")
    # 2. look around
    open_ = both.filter("before IS NULL OR before = 0").select("incident_number", "shift", "t", "latitude", "longitude")
    base = lambda c: F.floor(F.col(c) / side)
    levels = rows.groupBy(base("latitude").alias("cy"), base("longitude").alias("cx")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split)
    levels = levels.select("cy", "cx", F.when(F.col("n") > 4 * split, 4).otherwise(2).alias("per_side"))
    fine = lambda c, per: F.floor(c / (F.lit(side) / per))
    open_ = open_.withColumn("cy", base("latitude")).withColumn("cx", base("longitude")).join(levels, ["cy", "cx"], "left").withColumn("per_side", F.coalesce("per_side", F.lit(1)))
    open_ = open_.withColumn("y", fine(F.col("latitude"), F.col("per_side"))).withColumn("x", fine(F.col("longitude"), F.col("per_side"))).withColumn("b", F.floor(F.col("t") / width))
    reach = {"y": (F.col("lat0"), F.lit(metres / geo.DEGREE_M * 1.0001)), "x": (F.col("lon0"), F.lit(metres / geo.DEGREE_M * 1.0001) / F.cos(F.radians("lat0")))}
    early = early.select("shift", F.col("t").alias("t0"), F.col("latitude").alias("lat0"), F.col("longitude").alias("lon0"), F.col("incident_number").alias("before"))
    for k, (c, r) in reach.items():
        early = early.withColumn(f"c{k}", F.explode(F.sequence(F.floor((c - r) / side), F.floor((c + r) / side))))
    early = early.join(levels, ["cy", "cx"], "left").withColumn("per_side", F.coalesce("per_side", F.lit(1)))
    for k, (c, r) in reach.items():  # the parts of the cell that it reaches into
        first, last = fine(c - r, F.col("per_side")), fine(c + r, F.col("per_side"))
        early = early.withColumn(k, F.explode(F.sequence(F.greatest(first, F.col(f"c{k}") * F.col("per_side")), F.least(last, (F.col(f"c{k}") + 1) * F.col("per_side") - 1))))
    early = early.withColumn("b", F.explode(F.array(F.floor(F.col("t0") / width), F.floor(F.col("t0") / width) + 1)))
    keys = ["shift", "per_side", "y", "x", "b"]
    a, z = early.alias("a"), open_.alias("z")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"z.{k}"))
    on = on & (F.col("z.t") - F.col("a.t0")).between(low * 60, high * 60) & (geo.dist_m(F.col("a.lat0"), F.col("a.lon0"), F.col("z.latitude"), F.col("z.longitude")) <= metres) & (F.col("z.incident_number") != F.col("a.before"))
    # sized by files, the posted rows look small enough to broadcast, but they are several times the crashes
    return hit.unionByName(z.join(a.hint("merge"), on, "left_semi").select("incident_number", "shift"))


def follow_on_share(crashes: DataFrame, high: int = 45, **how) -> DataFrame:
    """AGG-29: of all located crashes (n) those that follow another (following); of those with a whole week and window of
    data before them (eligible) those that would follow one of a week earlier (control); and both shares."""
    rows = crashes.filter("latitude IS NOT NULL AND longitude IS NOT NULL").withColumn("t", F.unix_seconds(F.col("reported_ts").cast("timestamp")))
    first = rows.agg(F.min("t").alias("first"))
    rows = rows.select("incident_number", "t").join(F.broadcast(first)).select("incident_number", (F.col("t") - 7 * 86400 - high * 60 >= F.col("first")).alias("full"))  # one row
    seen = followers(crashes, high=high, shifts=(0, 7), **how).groupBy("incident_number").agg(F.max(F.col("shift") == 0).alias("after"), F.max(F.col("shift") == 7).alias("chance"))
    out = rows.join(seen.hint("merge"), "incident_number", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if("after").alias("following"), F.count_if("full").alias("eligible"), F.count_if(F.col("full") & F.col("chance")).alias("control"))
    return out.withColumn("share", F.round(F.try_divide("following", "n"), 6)).withColumn("control_share", F.round(F.try_divide("control", "eligible"), 6))


def upgraded_share(ep: DataFrame) -> DataFrame:
    """AGG-30: severe crashes, and those that an earlier, milder listing announced (rows have is_upgraded, is_severe)."""
    return ep.agg(F.count_if("is_severe").alias("severe"), F.count_if("is_upgraded").alias("upgraded"))


def trending_roads(crashes: DataFrame, now: str, days: int = 60, least: int = 20, ratio: float = 1.25, top_n: int = 15) -> DataFrame:
    """AGG-31: roads whose weekly crashes of the last ``days`` exceed those before by ``ratio``; ``least`` on both sides."""
    age = F.timestamp_diff("SECOND", F.col("reported_ts"), F.lit(now).cast("timestamp_ntz")) / 86400.0
    rows = crashes.select(F.explode("corridors").alias("road"), age.alias("age")).filter("age >= 0")
    span = rows.agg(F.max("age").alias("span"))
    one = rows.groupBy("road").agg(F.count_if(F.col("age") <= days).alias("recent"), F.count_if(F.col("age") > days).alias("earlier")).join(F.broadcast(span))  # one row
    out = one.filter((F.col("recent") >= least) & (F.col("earlier") >= least)).withColumn("recent_week", F.round(F.col("recent") / (days / 7), 6)).withColumn("earlier_week", F.round(F.col("earlier") / ((F.col("span") - days) / 7), 6)).withColumn("ratio", F.round((F.col("recent") / (days / 7)) / (F.col("earlier") / ((F.col("span") - days) / 7)), 6))
    return out.filter(F.col("ratio") >= ratio).drop("span").orderBy(F.desc("ratio"), "road").limit(top_n)


def event_effect(crashes: DataFrame, cov: DataFrame, calendar: DataFrame) -> DataFrame:
    """AGG-32, JN-20: crashes on the days of each named event against the usual rate of their weekdays."""
    usual = dow_rates(crashes, cov).select("dow", (F.col("n") / F.col("days")).alias("usual"))
    n = crashes.groupBy(F.to_date("reported_ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    days = cov.select("date").join(calendar, "date").join(n, "date", "left").withColumn("dow", F.weekday("date")).join(usual, "dow")
    out = days.groupBy("event").agg(F.count(F.lit(1)).alias("days"), F.sum(F.coalesce("n", F.lit(0))).alias("observed"), F.sum("usual").alias("e"))
    return out.select("event", "days", "observed", F.round("e", 6).alias("expected"), F.round(F.col("observed") / F.col("e"), 6).alias("ratio"))


def school_effect(crashes: DataFrame, cov: DataFrame, least: int = 10) -> DataFrame:
    """AGG-32: crashes of a school weekday and of another weekday, if there are ``least`` of both."""
    days = cov.filter(F.weekday("date") < 5).select("date", times.school_day(F.col("date").cast("timestamp_ntz")).alias("school"))
    n = crashes.groupBy(F.to_date("reported_ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    out = days.join(n, "date", "left").agg(F.count_if("school").alias("school_days"), F.sum(F.when(F.col("school"), F.coalesce("n", F.lit(0)))).alias("school_n"), F.count_if(~F.col("school")).alias("other_days"), F.sum(F.when(~F.col("school"), F.coalesce("n", F.lit(0)))).alias("other_n"))
    enough = (F.col("school_days") >= least) & (F.col("other_days") >= least)
    return out.withColumn("ratio", F.when(enough, F.round((F.col("school_n") / F.col("school_days")) / (F.col("other_n") / F.col("other_days")), 6)))


def recurring_calls(inc: DataFrame, top_n: int = 6, least: int = 2) -> DataFrame:
    """AGG-33: places with most signal faults, roads with most stalls and hazards (rows have category and corridors)."""
    kind = F.when(F.col("category") == "control", "signal").when(F.col("category") == "vehicle", "stall").when(F.col("category") == "hazard", "hazard")
    where = F.when(F.col("category") == "control", F.array("location_key")).otherwise(F.col("corridors"))
    one = inc.select(kind.alias("kind"), F.explode(where).alias("place")).filter("kind IS NOT NULL AND place <> ''").groupBy("kind", "place").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    best = Window.partitionBy("kind").orderBy(F.desc("n"), "place")
    return one.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_n)


def agency_load(inc: DataFrame) -> DataFrame:
    """AGG-34: incidents of each agency and hour (rows have agencies)."""
    return inc.filter("reported_ts IS NOT NULL").select(F.explode("agencies").alias("agency"), F.hour("reported_ts").alias("hour")).groupBy("agency", "hour").agg(F.count(F.lit(1)).alias("n"))


def agency_rates(inc: DataFrame, days: int) -> DataFrame:
    """AGG-34: the load of each agency and hour for a day of data."""
    return agency_load(inc).withColumn("rate", F.round(F.col("n") / days, 6))


def area_table(crashes: DataFrame, least: int = 20, top_n: int = 8) -> DataFrame:
    """AGG-34: towns by crashes with severe and hit-and-run shares (rows have town)."""
    one = crashes.filter("town <> ''").groupBy("town").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_severe").alias("severe"), F.count_if("is_hit_and_run").alias("hit_and_run")).filter(F.col("n") >= least)
    return one.withColumn("severe_share", F.round(F.col("severe") / F.col("n"), 6)).withColumn("hit_and_run_share", F.round(F.col("hit_and_run") / F.col("n"), 6)).orderBy(F.desc("n"), "town").limit(top_n)


def feed_time_quartiles(rows: DataFrame, group: str, minutes: str, least: int = 15) -> DataFrame:
    """AGG-35: count, median and the indexed quartiles of the minutes on the feed.

    Minutes are whole numbers, so each group is reduced to a histogram (minute, count) before anything is gathered:
    no task ever holds all values of a large group.
    """
    one = rows.filter(F.col(minutes).isNotNull()).groupBy(group, F.col(minutes).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy(group).orderBy("v")
    one = one.withColumn("upto", F.sum("k").over(order)).withColumn("n", F.sum("k").over(Window.partitionBy(group)))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    q = lambda share: F.least(F.col("n") - 1, F.floor(F.col("n") * share))
    out = one.groupBy(group).agg(F.max("n").alias("n"), ((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"), at(q(0.25)).alias("q1"), at(q(0.75)).alias("q3"))
    return out.filter(F.col("n") >= least)


def today_vs_norm(crashes: DataFrame, cov: DataFrame, now: str, least: int = 6) -> DataFrame:
    """AGG-36: crashes of today up to now against the same weekday's full days up to the same minute."""
    t = F.lit(now).cast("timestamp_ntz")
    minute = F.hour("reported_ts") * 60 + F.minute("reported_ts")
    upto = crashes.filter(minute <= F.hour(t) * 60 + F.minute(t))
    n = upto.groupBy(F.to_date("reported_ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    today = n.filter(F.col("date") == F.to_date(t)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("today"))
    past = cov.filter(F.col("is_full") & (F.col("date") < F.to_date(t)) & (F.weekday("date") == F.weekday(t))).select("date").join(n, "date", "left")
    norm = past.agg(F.sort_array(F.collect_list(F.coalesce("n", F.lit(0)))).alias("v"))  # one number for each past day
    norm = norm.select(F.size("v").cast("long").alias("days"), F.when(F.size("v") > 0, (F.element_at("v", F.floor((F.size("v") - 1) / 2).cast("int") + 1) + F.element_at("v", F.least(F.size("v"), F.floor(F.size("v") / 2).cast("int") + 1))) / 2).alias("median"), F.when(F.size("v") > 0, index_quantile(F.col("v"), 0.1)).alias("low"), F.when(F.size("v") > 0, index_quantile(F.col("v"), 0.9)).alias("high"))
    verdict = F.when(F.col("days") < least, "unknown").when(F.col("today") < F.col("low"), "quiet").when(F.col("today") > F.col("high"), "busy").otherwise("usual")
    return today.join(F.broadcast(norm)).withColumn("verdict", verdict)


def verdict_if_fresh(norm: DataFrame, newest: DataFrame, now: str, hours: int = 6) -> DataFrame:
    """AGG-36: the comparison with the verdict ``unknown`` if the newest row (one value, ``newest``) is ``hours`` old."""
    late = F.timestamp_diff("SECOND", F.col("newest"), F.lit(now).cast("timestamp_ntz")) >= hours * 3600
    out = norm.join(F.broadcast(newest.select("newest")))  # one row
    return out.withColumn("verdict", F.when(F.coalesce(late, F.lit(True)), "unknown").otherwise(F.col("verdict"))).drop("newest")


def weather_shares(inc: DataFrame) -> DataFrame:
    """AGG-41: shares of rain, wind of 20 mph and more, and visibility below 3 miles, each among rows that have the value."""
    rain_known = F.col("weather_precip_prob").isNotNull() | F.col("weather_precip_in").isNotNull()
    rain = F.coalesce(F.col("weather_precip_prob") >= 20, F.lit(False)) | F.coalesce(F.col("weather_precip_in") > 0.005, F.lit(False))
    wind, sight = F.col("weather_wind_mph"), F.col("weather_visibility_mi")
    one = inc.agg(F.count_if(rain_known).alias("rain_known"), F.count_if(rain).alias("rain"), F.count("weather_wind_mph").alias("wind_known"), F.count_if(wind >= 20).alias("windy"), F.count("weather_visibility_mi").alias("sight_known"), F.count_if(sight < 3).alias("low_sight"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return one.withColumn("rain_share", share("rain", "rain_known")).withColumn("wind_share", share("windy", "wind_known")).withColumn("low_sight_share", share("low_sight", "sight_known"))


def normalised_rates(inc: DataFrame, cov: DataFrame) -> DataFrame:
    """AGG-41: incidents for an hour of rush and other time, for a weekday and a weekend day, in and out of term."""
    from dispatchlake.operators.coverage import exposure

    dow, hour = F.weekday("reported_ts"), F.hour("reported_ts")
    school = times.school_day(F.col("reported_ts"))
    n = inc.filter("reported_ts IS NOT NULL").agg(F.count_if(times.rush(hour, dow)).alias("rush_n"), F.count_if(~times.rush(hour, dow)).alias("other_n"), F.count_if(dow < 5).alias("weekday_n"), F.count_if(dow >= 5).alias("weekend_n"), F.count_if(school).alias("school_n"), F.count_if(~school).alias("no_school_n"))
    both = n.join(F.broadcast(exposure(cov)))  # one row
    rate = lambda a, b, k=1: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b) * k, 6))
    return both.select("rush_n", "other_n", "weekday_n", "weekend_n", "school_n", "no_school_n", rate("rush_n", "rush_hours").alias("rush_rate"), rate("other_n", "other_hours").alias("other_rate"), rate("weekday_n", "weekdays").alias("weekday_rate"), rate("weekend_n", "weekend_days").alias("weekend_rate"), rate("school_n", "school_hours").alias("school_rate"), rate("no_school_n", "no_school_hours").alias("no_school_rate"))
