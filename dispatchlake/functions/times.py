"""Reported times and the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Forms of reported times; each gives its fields as numbered groups. Fixed values.
_SLASH = r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?!\d)(?:[ T]+(\d{1,2}):(\d{2})(?::\d{2})?\s*([AaPp][Mm])?)?"
_DASH = r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T]+(\d{1,2}):(\d{2}))?"
_NO_YEAR = r"^(\d{1,2})/(\d{1,2})(?!/)(?:\s+(\d{1,2}):(\d{2})(?::\d{2})?\s*([AaPp][Mm])?)?$"
_STRICT = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{2})(?::(\d{2}))?(?: ([AaPp][Mm]))?$"


def _groups(s: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern's first match as an array, by one match; an array of one element if there is none."""
    body = pattern if pattern.startswith("^") else f"^.*?{pattern}.*$"
    return F.split(F.regexp_replace(s, body, "|".join(["\u0001", *[f"${k}" for k in range(1, n + 1)]])), r"\|")


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _int(g: Column, k: int) -> Column:
    return F.get(g, k).try_cast("int")


def _clock(hour: Column, half: Column) -> Column:
    """Hour of the day from a 12- or 24-hour clock; null if it can't be."""
    twelve = half != ""
    return F.when(twelve & hour.between(1, 12), hour % 12 + F.when(F.lower(half) == "pm", 12).otherwise(0)).when(~twelve & hour.between(0, 23), hour)


def _time(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column | None = None) -> Column:
    return F.try_make_timestamp_ntz(y, mo, d, h, mi, (F.lit(0) if s is None else s).cast("decimal(16,6)"))


def reported_ts(c: Column, mode: str = "full", now: str | None = None) -> Column:
    """PRJ-05: time of a reported text, as timestamp_ntz.

    ``full``: month/day/year with or without a clock, found anywhere, seconds dropped, two-digit years up to 69 in this
    century; also year-month-day, and month/day in the year of ``now``. ``strict4``: the whole text, four-digit year
    and a clock with or without seconds and AM/PM. ``timed``: as full, but a clock must be there.
    """
    s = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), "[|\u0001]", "?"))
    there = lambda g: F.get(g, 0) == "\u0001"
    if mode == "strict4":
        return _let(_groups(s, _STRICT, 7), lambda g: F.when(there(g), _time(_int(g, 3), _int(g, 1), _int(g, 2), _clock(_int(g, 4), F.get(g, 7)), _int(g, 5), F.coalesce(_int(g, 6), F.lit(0)))))

    def form(g: Column, y: Column, mo: int, d: int, hour: int, half: int | None) -> Column:
        none = F.lit(None).cast("int") if mode == "timed" else F.lit(0)
        timed = F.get(g, hour) != ""
        h = _clock(_int(g, hour), F.get(g, half) if half else F.lit(""))
        return F.when(there(g), _time(y, _int(g, mo), _int(g, d), F.when(timed, h).otherwise(none), F.when(timed, _int(g, hour + 1)).otherwise(none)))

    def century(g: Column) -> Column:
        year = _int(g, 3)
        return F.when(F.length(F.get(g, 3)) == 2, year + F.when(year <= 69, 2000).otherwise(1900)).otherwise(year)

    forms = [_let(_groups(s, _SLASH, 6), lambda g: form(g, century(g), 1, 2, 4, 6)), _let(_groups(s, _DASH, 5), lambda g: form(g, _int(g, 1), 2, 3, 4, None))]
    if now is not None:
        forms.append(_let(_groups(s, _NO_YEAR, 5), lambda g: form(g, F.year(F.lit(now).cast("timestamp_ntz")), 1, 2, 3, 5)))
    return F.coalesce(*forms)


def with_reported_ts(df: DataFrame, mode: str = "full", now: str | None = None) -> DataFrame:
    return df.withColumn("reported_ts", reported_ts(F.col("reported"), mode, now))


def with_best_ts(df: DataFrame, now: str | None = None) -> DataFrame:
    """PRJ-06: the time after ``last:``, else the reported time, else created_at."""
    last = F.regexp_extract(F.coalesce(F.col("reported"), F.lit("")), r"last:\s*([^)]*)", 1)
    return df.withColumn("best_ts", F.coalesce(reported_ts(last, "full", now), reported_ts(F.col("reported"), "full", now), F.col("created_at").cast("timestamp_ntz")))


def to_local(c: Column, tz: str = "America/Chicago") -> Column:
    """PRJ-07: local wall clock of a UTC instant, with summer time."""
    return F.from_utc_timestamp(c, tz).cast("timestamp_ntz")


def rush(hour: Column, dow: Column) -> Column:
    """Monday to Friday, 7 to 9 and 16 to 19; dow counts from Monday as 0."""
    return (dow < 5) & ((hour >= 7) & (hour < 9) | (hour >= 16) & (hour < 19))


def with_time_context(df: DataFrame, ts: str = "reported_ts") -> DataFrame:
    """PRJ-08: hour_of_day, day_of_week (Monday 0), is_weekend, is_rush_hour, month."""
    t = F.col(ts)
    out = df.withColumn("hour_of_day", F.hour(t)).withColumn("day_of_week", F.weekday(t)).withColumn("month", F.month(t))
    return out.withColumn("is_weekend", F.col("day_of_week") >= 5).withColumn("is_rush_hour", rush(F.col("hour_of_day"), F.col("day_of_week")))


def _nth(year: Column, month: int, n: int, weekday: int) -> Column:
    """Date of the nth weekday (Monday 0) of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))


def school_day(t: Column) -> Column:
    """PRJ-09: weekday in term. Thanksgiving's Wednesday to Friday are off if they fall on the 21st to 27th."""
    d, m, day = F.to_date(t), F.month(t), F.dayofmonth(t)
    thanks = _nth(F.year(t), 11, 4, 3)
    off = m.isin(6, 7) | (m == 8) & (day < 15) | (m == 12) & (day >= 20) | (m == 1) & (day <= 3)
    off |= (m == 11) & day.between(21, 27) & (F.abs(F.datediff(d, thanks)) <= 1)
    return (F.weekday(t) < 5) & ~off


def holiday(t: Column, observed: bool = True) -> Column:
    """PRJ-10: five fixed and six floating holidays; a fixed one on Saturday is also kept on Friday, on Sunday on Monday."""
    d, y = F.to_date(t), F.year(t)
    fixed = [F.make_date(y, F.lit(m), F.lit(k)) for m, k in ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))] + [F.make_date(y + 1, F.lit(1), F.lit(1))]
    out = F.lit(False)
    for h in fixed:
        out |= d == h
        if observed:
            out |= (F.weekday(h) == 5) & (d == F.date_sub(h, 1)) | (F.weekday(h) == 6) & (d == F.date_add(h, 1))
    last = F.make_date(y, F.lit(5), F.lit(31))
    floating = [_nth(y, 1, 3, 0), _nth(y, 2, 3, 0), F.date_sub(last, F.weekday(last)), _nth(y, 9, 1, 0), _nth(y, 10, 2, 0), _nth(y, 11, 4, 3)]
    for h in floating:
        out |= d == h
    return out


def with_school_day(df: DataFrame, ts: str = "reported_ts") -> DataFrame:
    return df.withColumn("is_school_day", school_day(F.col(ts)))


def with_holiday(df: DataFrame, observed: bool = True, ts: str = "reported_ts") -> DataFrame:
    return df.withColumn("is_holiday", holiday(F.col(ts), observed))


def easter(year: Column) -> Column:
    """Date of Easter Sunday by integer arithmetic."""
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    n = h + k - 7 * div(a + 11 * h + 22 * k, 451) + 114
    return F.make_date(year, div(n, 31), n % 31 + 1)


def event_calendar(spark: SparkSession, first: int, last: int) -> DataFrame:
    """PRJ-11: (event, date) of named days and spans from year ``first`` to ``last``."""
    y = F.col("y")
    e, thanks = easter(y), _nth(y, 11, 4, 3)
    day = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    spans = [("Mardi Gras", F.date_sub(e, 47), F.date_sub(e, 47)), ("Mardi Gras weekend", F.date_sub(e, 51), F.date_sub(e, 48)), ("Easter", e, e), ("Festival", F.date_sub(_nth(y, 5, 1, 6), 11), F.date_sub(_nth(y, 5, 1, 6), 7)), ("Thanksgiving", thanks, thanks), ("Black Friday", F.date_add(thanks, 1), F.date_add(thanks, 1)), ("Christmas", day(12, 24), day(12, 25)), ("New Year", day(12, 31), day(12, 31)), ("Independence Day", day(7, 4), day(7, 4)), ("Halloween", day(10, 31), day(10, 31))]
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("y"))
    rows = years.select(F.explode(F.array(*[F.struct(F.lit(n).alias("event"), a.alias("lo"), b.alias("hi")) for n, a, b in spans])).alias("s"))
    return rows.select("s.event", F.explode(F.sequence("s.lo", "s.hi")).alias("date"))


def time_block(hour: Column) -> Column:
    """PRJ-21: six-way block of the day."""
    return F.when(hour.between(6, 9), "morning").when(hour.between(10, 14), "midday").when(hour.between(15, 18), "evening").when(hour.between(19, 23), "night").when(hour.between(0, 5), "latenight").otherwise("unknown")


def with_time_block(df: DataFrame, ts: str = "reported_ts") -> DataFrame:
    return df.withColumn("day_type", F.when(F.weekday(ts) >= 5, "weekend").when(F.col(ts).isNotNull(), "weekday")).withColumn("time_block", time_block(F.hour(ts)))


#: Sunrise and sunset in minutes of the local clock, by month; fixed values.
SUN = [(423, 1042), (400, 1075), (447, 1155), (400, 1177), (369, 1200), (361, 1215), (372, 1216), (393, 1188), (412, 1147), (432, 1108), (388, 1039), (412, 1024)]


def with_daylight(df: DataFrame, ts: str = "reported_ts") -> DataFrame:
    """PRJ-22: daylight by the monthly table (twelve literal rows)."""
    rise, set_ = (F.element_at(F.array(*[F.lit(x[k]) for x in SUN]), F.month(ts)) for k in (0, 1))
    m = F.hour(ts) * 60 + F.minute(ts)
    return df.withColumn("is_daylight", (m >= rise) & (m < set_))


def with_darkness(df: DataFrame, lat: float = 30.2241, lon: float = -92.0198, hour: str = "hour", date: str = "date") -> DataFrame:
    """PRJ-23: light, dark or twilight of an hour of a day, by the solar declination and the equation of time."""
    n = F.dayofyear(date)
    b = (n - 81) * F.lit(2 * 3.141592653589793 / 364)
    eot = 9.87 * F.sin(2 * b) - 7.53 * F.cos(b) - 1.5 * F.sin(b)
    decl = F.radians(23.45 * F.sin(b))
    cosh = (F.sin(F.radians(F.lit(-0.833))) - F.sin(F.radians(F.lit(lat))) * F.sin(decl)) / (F.cos(F.radians(F.lit(lat))) * F.cos(decl))
    half = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosh)))) * 4
    y = F.year(date)
    summer = (F.col(date) >= _nth(y, 3, 2, 6)) & (F.col(date) < _nth(y, 11, 1, 6))
    noon = 720 - 4 * lon - eot + F.when(summer, -300).otherwise(-360)
    rise, set_ = noon - half, noon + half
    start, end = F.col(hour) * 60, F.col(hour) * 60 + 60
    light = F.when((start >= rise) & (end <= set_), "light").when((end <= rise - 30) | (start >= set_ + 30), "dark").otherwise("twilight")
    return df.withColumn("light", light)


def recency_bucket(t: Column, now: str) -> Column:
    """PRJ-29: Today, Yesterday, This week, This month, Earlier or Undated."""
    age = F.datediff(F.lit(now).cast("timestamp_ntz"), t)
    return F.when(t.isNull(), "Undated").when(age <= 0, "Today").when(age == 1, "Yesterday").when(age < 7, "This week").when(age < 30, "This month").otherwise("Earlier")


def visible_minutes(first: Column, last: Column) -> Column:
    """PRJ-28: whole minutes between the first and the last sighting, never negative."""
    seconds = F.unix_timestamp(last.cast("timestamp")) - F.unix_timestamp(first.cast("timestamp"))
    return F.greatest(F.lit(0), F.floor(seconds / 60 + 0.5)).cast("long")
