"""Faceted filters: one conjunction of predicates, in which a facet can be left out to count its own alternatives."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.functions import causes, times, weather

_RANGES = {"24h": 24, "7d": 168, "30d": 720}


@dataclass
class Filters:
    """Chosen values; None or an empty set leaves a predicate out. ``now`` anchors the relative ranges."""

    now: str = ""
    categories: set[str] = field(default_factory=set)
    cause: str | None = None
    cause_group: str | None = None
    range: str = "all"  # today, 24h, 7d, 30d
    date_from: str | None = None
    date_to: str | None = None
    month: int | None = None
    day: int | None = None
    year: int | None = None
    day_type: str | None = None  # weekday, weekend
    time_block: str | None = None
    hour: int | None = None
    dow: int | None = None  # Sunday 0
    rush_hour: bool = False
    school_day: bool = False
    holiday: bool = False
    light: str | None = None  # day, dark
    any_weather: bool = False
    bands: dict[str, str] = field(default_factory=dict)  # kind -> band
    alerts: set[str] = field(default_factory=set)  # flood, storm, tornado
    road_type: str | None = None
    road: str | None = None
    agencies: set[str] = field(default_factory=set)
    exact_only: bool = False
    road_search: str | None = None
    bounds: tuple[float, float, float, float] | None = None  # south, west, north, east
    skip_routine: bool = False


def predicates(f: Filters) -> dict[str, Column]:
    """The chosen predicates by facet. Rows are prepared: best_ts and what each chosen facet needs."""
    t, out = F.col("best_ts"), {}
    now = F.lit(f.now).cast("timestamp_ntz") if f.now else None
    if f.categories:
        out["category"] = causes.category(F.col("cause")).isin(sorted(f.categories))  # FLT-01
    if f.cause is not None:
        out["cause"] = F.trim("cause") == f.cause  # FLT-02
    if f.cause_group:
        out["cause_group"] = F.array_contains(causes.cause_groups(F.col("cause")), f.cause_group)  # FLT-03
    if f.range == "today":
        out["range"] = F.to_date(t) == F.to_date(now)  # FLT-04
    elif f.range in _RANGES:
        out["range"] = t >= now - F.expr(f"INTERVAL {_RANGES[f.range]} HOURS")
    if f.date_from or f.date_to:
        day = F.to_date(t)
        out["dates"] = reduce(lambda a, b: a & b, [x for x in (f.date_from and day >= F.lit(f.date_from).cast("date"), f.date_to and day <= F.lit(f.date_to).cast("date")) if x is not None and not isinstance(x, str)])  # FLT-05
    parts = [(f.month, F.month(t)), (f.day, F.dayofmonth(t)), (f.year, F.year(t))]
    if any(v is not None for v, _ in parts):
        out["parts"] = reduce(lambda a, b: a & b, [c == v for v, c in parts if v is not None])  # FLT-06
    if f.day_type:
        out["day_type"] = (F.weekday(t) >= 5) == (f.day_type == "weekend")  # FLT-07
    if f.time_block:
        out["time_block"] = times.time_block(F.hour(t)) == f.time_block  # FLT-08
    if f.hour is not None:
        out["hour"] = F.coalesce(F.col("hour_of_day"), F.hour(t)) == f.hour  # FLT-09
    if f.dow is not None:
        out["dow"] = F.dayofweek(t) - 1 == f.dow  # FLT-10
    if f.rush_hour:
        out["rush"] = times.rush(F.hour(t), F.weekday(t))  # FLT-11
    if f.school_day:
        out["school"] = F.coalesce(F.col("is_school_day"), times.school_day(t))  # FLT-12
    if f.holiday:
        out["holiday"] = F.coalesce(F.col("is_holiday"), times.holiday(t))  # FLT-13
    if f.light:
        out["light"] = F.col("is_daylight") == (f.light == "day")  # FLT-14
    if f.any_weather:
        out["weather"] = F.coalesce("weather_temp_f", "weather_precip_prob", "weather_precip_in", "weather_wind_mph", "weather_visibility_mi", "weather_cloud_pct").isNotNull()  # FLT-15
    for kind, name in f.bands.items():
        out[f"{kind}_band"] = weather.band(kind) == name  # FLT-16 to FLT-21
    for a in sorted(f.alerts):
        out[f"alert_{a}"] = F.col({"flood": "nws_flash_flood_warning", "storm": "nws_severe_thunderstorm_warning", "tornado": "nws_tornado_watch"}[a])  # FLT-22
    if f.road_type:
        r = F.lower("road_type")
        also = {"secondary": r.contains("tertiary"), "residential": r.isin("unclassified", "service", "living_street")}
        out["road_type"] = r.contains(f.road_type) | also.get(f.road_type, F.lit(False))  # FLT-23
    if f.road:
        out["road"] = F.array_contains("corridors", f.road)  # FLT-24
    if f.agencies:
        mask = sum(1 << [*causes.AGENCIES, "none"].index(a) for a in f.agencies)
        out["agency"] = F.col("agency_mask").bitwiseAND(F.lit(mask)) != 0  # FLT-25
    if f.exact_only:
        out["exact"] = ~F.coalesce(F.col("geocode_confidence") == "approximate", F.lit(False))  # FLT-26
    if f.road_search:
        out["search"] = fuzzy_road(F.col("location"), f.road_search)  # FLT-27
    if f.bounds:
        s, w, n, e = f.bounds
        out["bounds"] = F.col("latitude").between(s, n) & F.col("longitude").between(w, e)  # FLT-28
    if f.skip_routine:
        out["routine"] = ~((F.coalesce(F.col("n_calls"), F.lit(1)) > 1) & (F.col("cause") == "TRAFFIC CONTROL"))  # FLT-29
    return out


def _near(word: str, edits: int) -> Callable[[Column], Column]:
    """Test of a token: within so many edits of the word."""
    return lambda token: F.levenshtein(token, F.lit(word), edits) >= 0


def fuzzy_road(location: Column, words: str) -> Column:
    """FLT-27: every word is a part of the location, or within one (up to four letters) or two edits of one of its words."""
    text = F.upper(F.coalesce(location, F.lit("")))
    tokens = F.split(text, r"[^A-Z0-9]+")
    tests = []
    for w in words.upper().split():
        test = text.contains(w)
        if len(w) > 2:
            test |= F.exists(tokens, _near(w, 1 if len(w) <= 4 else 2))
        tests.append(test)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def apply_filters(df: DataFrame, f: Filters, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows for which every chosen predicate holds, but for the excluded facets."""
    tests = [c for k, c in predicates(f).items() if k not in exclude]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def facet_sweep(df: DataFrame, f: Filters) -> DataFrame:
    """For each chosen facet the rows that all the other predicates keep: one scan with conditional counts."""
    names = list(tests := predicates(f))
    rows = df.select(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in tests.items()])  # each predicate once
    failed = sum([(~F.col(k)).cast("int") for k in names], F.lit(0))
    rows = rows.select(*names, failed.alias("n_failed")).filter("n_failed <= 1")
    return rows.agg(F.count_if(F.col("n_failed") == 0).alias("all_facets"), *[F.count_if((F.col("n_failed") == 0) | ~F.col(k)).alias(f"without_{k}") for k in names])


def recent_live(df: DataFrame, now: str, limit: int = 20) -> DataFrame:
    """FLT-30: the newest rows of the last two hours."""
    end = F.lit(now).cast("timestamp_ntz")
    return df.filter((F.col("best_ts") >= end - F.expr("INTERVAL 2 HOURS")) & (F.col("best_ts") <= end)).orderBy(F.desc("best_ts"), "incident_number").limit(limit)
