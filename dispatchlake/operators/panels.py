"""Hot spots, leaderboards, digests and the panels over a filtered set."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dispatchlake.functions import causes, geo, times
from dispatchlake.functions.text import folded
from dispatchlake.operators.filters import Filters, apply_filters, predicates
from dispatchlake.operators.ingest import location_state


def _days(now: str, t: Column) -> Column:
    return F.timestamp_diff("SECOND", t, F.lit(now).cast("timestamp_ntz")) / 86400.0


def hot_spots(inc: DataFrame, now: str, tau: float = 30.0, min_n: int = 2, top_n: int = 100) -> DataFrame:
    """AGG-03: grid cells of a thousandth of a degree by recency-weighted count.

    Each incident weighs exp(-age / tau), one without a readable time 0.1; future times count as now.
    """
    cy, cx = geo.cell(F.col("latitude"), F.col("longitude"), 3)
    weight = F.when(F.col("reported_ts").isNull(), 0.1).otherwise(F.exp(-F.greatest(_days(now, F.col("reported_ts")), F.lit(0.0)) / tau))
    rows = inc.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select(cy.alias("cell_y"), cx.alias("cell_x"), weight.alias("w"))
    out = rows.groupBy("cell_y", "cell_x").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 6).alias("score")).filter(F.col("n") >= min_n)
    return out.orderBy(F.desc("score"), "cell_y", "cell_x").limit(top_n)


def grid_groups(inc: DataFrame, digits: int = 3, top_n: int = 100) -> DataFrame:
    """AGG-04: cells with count, number of places and dominant category (most rows, then name)."""
    cy, cx = geo.cell(F.col("latitude"), F.col("longitude"), digits)
    rows = inc.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select(cy.alias("cell_y"), cx.alias("cell_x"), causes.category(F.col("cause")).alias("category"))
    one = rows.groupBy("cell_y", "cell_x", "category").agg(F.count(F.lit(1)).alias("k"))
    out = one.groupBy("cell_y", "cell_x").agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("k"), "category")).alias("m")).select("cell_y", "cell_x", "n", F.col("m.category").alias("category"))
    return out.orderBy(F.desc("n"), "cell_y", "cell_x").limit(top_n)


def grid_members(inc: DataFrame, digits: int = 3, top_n: int = 100) -> DataFrame:
    """AGG-04: (cell_y, cell_x, incident_number) of the members of the top cells; only they are joined, by broadcast."""
    cy, cx = geo.cell(F.col("latitude"), F.col("longitude"), digits)
    top = grid_groups(inc, digits, top_n).select("cell_y", "cell_x")  # top_n rows
    rows = inc.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select("incident_number", cy.alias("cell_y"), cx.alias("cell_x"))
    return rows.join(F.broadcast(top), ["cell_y", "cell_x"])


def location_history(inc: DataFrame, digits: int = 4) -> DataFrame:
    """AGG-05: occurrences and first date of each cell."""
    cy, cx = geo.cell(F.col("latitude"), F.col("longitude"), digits)
    rows = inc.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    return rows.groupBy(cy.alias("cell_y"), cx.alias("cell_x")).agg(F.count(F.lit(1)).alias("n"), F.to_date(F.min("reported_ts")).cast("string").alias("first_date"))


def corridor_counts(inc: DataFrame, top_n: int = 12) -> DataFrame:
    """AGG-07: incidents of each road and their share of all mentions; rows have ``corridors``."""
    one = inc.select(F.explode("corridors").alias("road")).groupBy("road").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy()
    return one.withColumn("share", F.round(F.col("n") / F.sum("n").over(total), 6)).orderBy(F.desc("n"), "road").limit(top_n)


def digest(inc: DataFrame, now: str, folded_ids: DataFrame | None = None) -> DataFrame:
    """AGG-08: one row about the 24 hours before ``now`` and the 24 before those, by collection time, and the archive."""
    end = F.lit(now).cast("timestamp_ntz")
    rows = inc if folded_ids is None else inc.join(folded_ids.select("incident_number", F.lit(True).alias("folded")), "incident_number", "left")
    t = F.col("created_at")
    day, prior = (t >= end - F.expr("INTERVAL 24 HOURS")) & (t < end), (t >= end - F.expr("INTERVAL 48 HOURS")) & (t < end - F.expr("INTERVAL 24 HOURS"))
    fold = F.coalesce(F.col("folded"), F.lit(False)) if folded_ids is not None else F.lit(False)
    mine = day & ~fold
    label, mask = causes.category(F.col("cause"), "digest"), F.upper(F.coalesce(F.col("assisting"), F.lit("")))
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    aggs = [F.count_if(mine).alias("new"), F.count_if(prior & ~fold).alias("previous"), F.count_if(day & fold).alias("folded"), F.count(F.lit(1)).alias("archive_total")]
    aggs += [F.count_if(mine & (label == c)).alias("n_" + c.split()[0].lower()) for c in [*causes.DIGEST, "Other"]]
    aggs += [F.count_if(mine & mask.rlike(p)).alias(f"agency_{a}") for a, p in causes.AGENCIES.items()]
    tried = F.coalesce(F.col("geocode_attempts"), F.lit(0)) >= 3
    aggs += [F.count_if(mine & located).alias("located"), F.count_if(mine & ~located & ~tried).alias("locating"), F.count_if(mine & ~located & tried).alias("unmappable")]
    wet = F.coalesce(F.col("weather_precip_prob") >= 20, F.lit(False)) | F.coalesce(F.col("weather_precip_in") > 0.005, F.lit(False))
    alert = F.coalesce(F.col("nws_flash_flood_warning"), F.lit(False)) | F.coalesce(F.col("nws_severe_thunderstorm_warning"), F.lit(False)) | F.coalesce(F.col("nws_tornado_watch"), F.lit(False))
    aggs += [F.count_if(mine & wet).alias("in_rain"), F.count_if(mine & alert).alias("under_alert")]
    return rows.agg(*aggs)


def digest_hours(inc: DataFrame, now: str) -> DataFrame:
    """AGG-08: incidents of the last 24 hours by hour of the day, all 24 of them."""
    end = F.lit(now).cast("timestamp_ntz")
    hours = inc.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    one = inc.filter((F.col("created_at") >= end - F.expr("INTERVAL 24 HOURS")) & (F.col("created_at") < end)).groupBy(F.hour("reported_ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.join(one, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def digest_roads(inc: DataFrame, now: str, top_n: int = 5) -> DataFrame:
    """AGG-08: roads with most incidents of the 24 hours before ``now``, by collection time (rows have corridors)."""
    end = F.lit(now).cast("timestamp_ntz")
    rows = inc.filter((F.col("created_at") >= end - F.expr("INTERVAL 24 HOURS")) & (F.col("created_at") < end))
    return rows.select(F.explode("corridors").alias("road")).groupBy("road").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "road").limit(top_n)


#: Bins and their minutes by range of a trend.
TREND_BINS = {"24h": (24, 60), "7d": (7, 1440), "30d": (30, 1440), "all": (12, 43200)}


def trend_of_range(inc: DataFrame, now: str, range_: str) -> DataFrame:
    """AGG-37: the trend of a range: hours of a day, days of a week or month, or twelve times thirty days."""
    return trend(inc, now, *TREND_BINS[range_])


def faceted_tiles(inc: DataFrame, f: Filters, now: str) -> DataFrame:
    """AGG-38: the tiles of the rows that the chosen facets other than the time range keep."""
    return stat_tiles(apply_filters(inc, f, exclude=("range", "dates")), now)


def trend(inc: DataFrame, now: str, bins: int = 24, bin_minutes: int = 60) -> DataFrame:
    """AGG-37: incidents in the last ``bins`` bins before ``now`` (bin 0 is the newest) and the change to the bin before."""
    age = F.timestamp_diff("MINUTE", F.col("reported_ts"), F.lit(now).cast("timestamp_ntz"))
    one = inc.filter((age >= 0) & (age < bins * bin_minutes)).groupBy(F.floor(age / bin_minutes).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = inc.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = spine.join(one, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("change", F.col("n") - F.lag("n").over(Window.orderBy(F.desc("bin"))))  # at most ``bins`` rows


def stat_tiles(inc: DataFrame, now: str) -> DataFrame:
    """AGG-38: counts of 24 hours, 7 and 30 days, and all, in one scan."""
    end = F.lit(now).cast("timestamp_ntz")
    since = lambda h: F.count_if(F.col("best_ts") >= end - F.expr(f"INTERVAL {h} HOURS"))
    return inc.agg(since(24).alias("last_24h"), since(168).alias("last_7d"), since(720).alias("last_30d"), F.count(F.lit(1)).alias("total"))


def category_mix(inc: DataFrame) -> DataFrame:
    """AGG-39: rows of each category and its share."""
    one = inc.groupBy(causes.category(F.col("cause")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return one.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # some seven rows


def data_quality(inc: DataFrame) -> DataFrame:
    """AGG-40: located, locating and unmappable rows, and levels of confidence."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    tried = F.coalesce(F.col("geocode_attempts"), F.lit(0)) >= 3
    level = F.col("geocode_confidence")
    return inc.agg(F.count_if(located).alias("located"), F.count_if(~located & ~tried).alias("locating"), F.count_if(~located & tried).alias("unmappable"), F.count_if(located & (level == "exact")).alias("exact"), F.count_if(located & (level == "approximate")).alias("approximate"), F.count_if(located & level.isNull()).alias("untracked"))


def smart_summary(inc: DataFrame) -> DataFrame:
    """AGG-42: peak hour, busiest weekday, top category and top road, each with its count (ties: the smallest).

    The rows are read once; what has no values has nulls.
    """
    one = {"peak_hour": F.lpad(F.hour("reported_ts").cast("string"), 2, "0"), "busiest_day": F.weekday("reported_ts").cast("string"), "category": causes.category(F.col("cause"))}
    pair = lambda what, k: F.struct(F.lit(what).alias("what"), k.alias("k"))
    roads = F.transform(F.coalesce("corridors", F.array().cast("array<string>")), lambda r: pair("road", r))
    pairs = F.concat(F.array(*[pair(what, k) for what, k in one.items()]), roads)
    n = inc.select(F.explode(pairs).alias("p")).select("p.what", "p.k").filter("k IS NOT NULL").groupBy("what", "k").agg(F.count(F.lit(1)).alias("n"))
    best = lambda what: F.min(F.when(F.col("what") == what, F.struct((-F.col("n")).alias("n"), "k")))
    top = n.agg(*[best(what).alias(what) for what in (*one, "road")])
    rows = F.array(*[F.struct(F.lit(what).alias("what"), F.col(f"{what}.k").alias("value"), (-F.col(f"{what}.n")).alias("n")) for what in (*one, "road")])
    return top.select(F.inline(rows))


def summary_changes(inc: DataFrame, now: str) -> DataFrame:
    """AGG-42: the top road class with its count, and the last seven days against the seven before (rows have road_type;
    without 13 days of data the comparison is left out)."""
    age = _days(now, F.col("reported_ts"))
    top = inc.filter("road_type IS NOT NULL").groupBy("road_type").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "road_type")).alias("m"))
    weeks = inc.agg(F.max(age).alias("span"), F.count_if((age >= 0) & (age < 7)).alias("a"), F.count_if((age >= 7) & (age < 14)).alias("b"))
    enough = F.col("span") >= 13
    return weeks.join(F.broadcast(top)).select(F.col("m.road_type").alias("road_type"), (-F.col("m.n")).alias("n"), F.when(enough, F.col("a")).alias("last_week"), F.when(enough, F.col("b")).alias("week_before"))  # one row each


def road_details(inc: DataFrame, control: DataFrame, road: str, now: str, top_n: int = 5) -> DataFrame:
    """AGG-43: (what, value, n) of a road: its peak hour and weekday and its top spots.

    Collapsed control groups (``control`` has location, history and corridors) count once for each call of their history.
    """
    on = lambda df: df.filter(F.array_contains("corridors", road))
    rows = on(inc).select("reported_ts", folded(F.col("location")).alias("spot"), F.lit(1).cast("long").alias("n"))
    calls = on(control).select(F.explode("history").alias("h"), folded(F.col("location")).alias("spot")).select(F.col("h.day").cast("timestamp_ntz").alias("day"), "spot", F.col("h.n").alias("n"))
    days = rows.select(F.weekday("reported_ts").alias("k"), "n").unionByName(calls.select(F.weekday("day").alias("k"), "n"))
    spots = rows.select(F.col("spot").alias("k"), "n").unionByName(calls.select(F.col("spot").alias("k"), "n"))

    def top(df: DataFrame, what: str, most: int) -> DataFrame:
        one = df.filter("k IS NOT NULL").groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").limit(most)
        return one.select(F.lit(what).alias("what"), F.col("k").cast("string").alias("value"), "n")

    return top(rows.select(F.hour("reported_ts").alias("k"), "n"), "peak_hour", 1).unionByName(top(days, "peak_day", 1)).unionByName(top(spots, "spot", top_n))


def road_profile(inc: DataFrame, road: str, now: str) -> DataFrame:
    """AGG-43: totals, crashes, and the last 30 days against the 30 before, of one road."""
    age = _days(now, F.col("reported_ts"))
    rows = inc.filter(F.array_contains("corridors", road))
    crash = causes.category(F.col("cause")) == "accident"
    return rows.agg(F.lit(road).alias("road"), F.count(F.lit(1)).alias("total"), F.count_if(crash).alias("crashes"), F.count_if((age >= 0) & (age <= 30)).alias("last_30"), F.count_if((age > 30) & (age <= 60)).alias("previous_30"))


def _facet_values(kept: dict[str, Column]) -> Column:
    """Array of (facet, value) of a row; a facet's values only where its condition holds."""
    pair = lambda facet, v: F.struct(F.lit(facet).alias("facet"), v.cast("string").alias("value"))
    one = {"cause": F.col("cause"), "year": F.year("reported_ts"), "month": F.month("reported_ts")}
    agencies = F.transform(F.coalesce("agencies", F.array().cast("array<string>")), lambda a: pair("agency", a))
    return F.concat(F.when(kept["agency"], agencies).otherwise(F.slice(agencies, 1, 0)), F.array(*[pair(facet, F.when(kept[facet], v)) for facet, v in one.items()]))


def _count_facets(inc: DataFrame, kept: dict[str, Column]) -> DataFrame:
    # conditions first, each once a row; the pairs follow from narrow columns
    rows = causes.with_agencies(inc).select("agencies", "cause", "reported_ts", *[F.coalesce(c, F.lit(False)).alias(f"__{k}") for k, c in kept.items()])
    pairs = rows.select(F.explode(_facet_values({k: F.col(f"__{k}") for k in kept})).alias("p")).select("p.facet", "p.value").filter("value IS NOT NULL")
    return pairs.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def facet_counts(inc: DataFrame) -> DataFrame:
    """AGG-44: every value of the facets cause, agency, year and month with its count."""
    return _count_facets(inc, {k: F.lit(True) for k in ("cause", "agency", "year", "month")})


def faceted_counts(inc: DataFrame, f: Filters) -> DataFrame:
    """AGG-44: each facet's values and counts over the rows that the other chosen facets keep. The rows are read once."""
    none = {"date_from": None, "date_to": None}
    others = {"cause": replace(f, cause=None), "agency": replace(f, agencies=set()), "year": replace(f, year=None, **none), "month": replace(f, month=None, **none)}
    return _count_facets(inc, {facet: reduce(and_, predicates(rest).values(), F.lit(True)) for facet, rest in others.items()})


def unlocated_counts(inc: DataFrame) -> DataFrame:
    """AGG-45: rows that are being located and that can't be."""
    rows = inc.filter("latitude IS NULL OR longitude IS NULL")
    tried = F.coalesce(F.col("geocode_attempts"), F.lit(0)) >= 3
    return rows.agg(F.count_if(~tried).alias("locating"), F.count_if(tried).alias("unmappable"))


def clamped(box: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """AGG-46: a box kept within limits."""
    within = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c)))
    return box.withColumn("south", within("south", south, north)).withColumn("north", within("north", south, north)).withColumn("west", within("west", west, east)).withColumn("east", within("east", west, east))


def unlocated(inc: DataFrame, top_n: int = 50) -> DataFrame:
    """AGG-45: the newest rows without a position and whether they are still being located."""
    rows = inc.filter("latitude IS NULL OR longitude IS NULL")
    state = F.when(F.coalesce(F.col("geocode_attempts"), F.lit(0)) >= 3, "unmappable").otherwise("locating")
    return rows.select("incident_number", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), state.alias("state")).orderBy(F.desc("created_at"), "incident_number").limit(top_n)


def extent(inc: DataFrame, step: float = 0.05, pad: float = 0.02) -> DataFrame:
    """AGG-46: centre, and the padded bounding box snapped outward to a grid."""
    snap = lambda f, x: F.round(f(F.round(x / step, 9)) * step, 6)
    rows = inc.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    out = rows.agg(*[f(c).alias(f"{n}_{c}") for c in ("latitude", "longitude") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])
    return out.select(F.round("avg_latitude", 6).alias("centre_lat"), F.round("avg_longitude", 6).alias("centre_lon"), snap(F.floor, F.col("min_latitude") - pad).alias("south"), snap(F.ceil, F.col("max_latitude") + pad).alias("north"), snap(F.floor, F.col("min_longitude") - pad).alias("west"), snap(F.ceil, F.col("max_longitude") + pad).alias("east"))


def archive_status(inc: DataFrame) -> DataFrame:
    """AGG-50: newest collection, first incident, rows, and the newest row with weather."""
    has = F.col("weather_temp_f").isNotNull()
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return inc.agg(text(F.max("created_at")).alias("newest"), text(F.min("reported_ts")).alias("first_incident"), F.count(F.lit(1)).alias("n"), F.max(F.when(has, F.struct("created_at", "incident_number"))).alias("w")).select("newest", "first_incident", "n", F.col("w.incident_number").alias("latest_weather"))


def archive_growth(inc: DataFrame) -> DataFrame:
    """AGG-50: rows added to the archive in each month of collection, and all until then."""
    one = inc.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("added"))
    return one.withColumn("total", F.sum("added").over(Window.orderBy("month")))  # a row for each month


def weather_log_status(hourly: DataFrame) -> DataFrame:
    """AGG-50: first and last hour of the weather log, its hours, and those missing between."""
    out = hourly.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"), F.count_distinct("hour").alias("hours"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select(text("lo").alias("first_hour"), text("hi").alias("last_hour"), "hours", (F.timestamp_diff("HOUR", F.col("lo"), F.col("hi")) + 1 - F.col("hours")).alias("missing"))


def in_view(inc: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """AGG-56, FLT-28: rows inside a box, borders included."""
    return inc.filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def feed_page(inc: DataFrame, now: str, limit: int = 30) -> DataFrame:
    """Newest rows with the heading of their date group and whether they are placed or still pending."""
    return location_state(inc).withColumn("bucket", times.recency_bucket(F.col("best_ts"), now)).orderBy(F.col("best_ts").desc_nulls_last(), "incident_number").limit(limit)
