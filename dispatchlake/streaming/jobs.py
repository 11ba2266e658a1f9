"""Structured Streaming jobs over listings and checks; each names the batch operator that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispatchlake.functions.causes import AGENCIES, DIGEST, category, severity
from dispatchlake.functions.text import folded, with_content_key


def dedupe_stream(listings: DataFrame, watermark: str = "6 minutes") -> DataFrame:
    """STR-01: listings without those whose content key was seen within the watermark (at least); state stays bounded.

    ``archive.Archive`` is the exact form, over all time."""
    return with_content_key(listings).withWatermark("sweep_ts", watermark).dropDuplicatesWithinWatermark(["content_key"])


def track_observations(listings: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """STR-02: first and last sighting and number of sweeps of each incident (batch: track_sightings). Update mode.

    A listing of a sweep that was already counted is dropped within the watermark, so replays don't count twice.
    """
    once = listings.withWatermark("sweep_ts", watermark).dropDuplicatesWithinWatermark(["incident_number", "sweep_ts"])
    return once.groupBy("incident_number").agg(F.min("sweep_ts").alias("first_seen_at"), F.max("sweep_ts").alias("last_seen_at"), F.count(F.lit(1)).alias("observation_count"))


def agency_changes(listings: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """STR-04: sweeps in which each agency is named for an incident, once within the watermark, by the agencies' patterns.

    Update mode; state is bounded by the watermark. ``state.agency_log`` keeps the exact change log.
    """
    text = F.upper(F.coalesce("assisting", F.lit("")))
    named = F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in AGENCIES.items()]))
    rows = listings.withWatermark("sweep_ts", watermark).select("incident_number", "sweep_ts", F.explode(named).alias("agency"))
    return rows.dropDuplicatesWithinWatermark(["incident_number", "agency"]).withColumnRenamed("sweep_ts", "changed_at")


def feed_check_windows(checks: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """STR-05: successful and failed checks of each hour (batch: feed_checks)."""
    w = checks.withWatermark("check_ts", watermark).groupBy(F.window("check_ts", "1 hour"))
    return w.agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed")).select(F.col("window.start").alias("hour"), "n_ok", "n_failed")


def episodes_stream(inc: DataFrame, window_min: int = 15, watermark: str = "6 minutes") -> DataFrame:
    """STR-06: sessions of listings at one place (batch: episodes): primary, the others in order, first and last time.

    A session stays open until the watermark passes it; listings of one place within a gap are its bound.
    """
    rows = inc.withColumn("location_key", folded(F.col("location"))).withColumn("severity", severity(F.col("cause"))).filter((F.col("location_key") != "") & (F.upper(F.trim("cause")) != "TRAFFIC CONTROL") & F.col("reported_ts").isNotNull())
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    listing = F.struct("reported_ts", "incident_number", "cause", "severity", located.alias("located"))
    s = rows.withWatermark("reported_ts", watermark).groupBy("location_key", F.session_window("reported_ts", f"{window_min} minutes"))
    s = s.agg(F.sort_array(F.collect_list(listing)).alias("m"), F.count(F.lit(1)).alias("n_listings"))
    order = F.transform("m", lambda x, i: F.struct(~x["located"], -x["severity"], i.alias("i")))
    s = s.withColumn("p", F.array_min(order)["i"] + 1)
    extras = F.concat(F.slice("m", F.lit(1), F.col("p") - 1), F.slice("m", F.col("p") + 1, F.size("m")))
    return s.select("location_key", F.col("m")[F.col("p") - 1]["incident_number"].alias("incident_number"), F.transform(extras, lambda x: x["incident_number"]).alias("extras"), F.col("m")[0]["reported_ts"].alias("first_ts"), F.element_at("m", -1)["reported_ts"].alias("last_ts"), "n_listings")


ROLLING = ["new", "folded", *["n_" + c.split()[0].lower() for c in [*DIGEST, "Other"]], *[f"agency_{a}" for a in AGENCIES], "located", "locating", "unmappable", "in_rain", "under_alert"]


_DIGEST_INPUT = {"folded": "boolean", "weather_precip_prob": "double", "weather_precip_in": "double", "nws_flash_flood_warning": "boolean", "nws_severe_thunderstorm_warning": "boolean", "nws_tornado_watch": "boolean"}


def _panes(rows: DataFrame, at: str, watermark: str, *keys: str) -> DataFrame:
    """Groups of one hour; rows are aggregated once, into their hour."""
    return rows.withWatermark(at, watermark).groupBy(F.window(at, "1 hour"), *keys)


def _over(panes: DataFrame, hours: int, *keys: str) -> DataFrame:
    """Groups of ``hours`` hours that end at every full hour, over hourly panes."""
    return panes.groupBy(F.window("window", f"{hours} hours", "1 hour"), *keys)


def rolling_digest(inc: DataFrame, watermark: str = "6 minutes") -> DataFrame:
    """STR-07: the digest of the 24 hours before each full hour, and how many incidents the 24 before those had (batch:
    ``panels.digest`` at that hour). A row is counted once, in its hour's pane; windows merge 48 panes.

    ``inc`` has created_at, ``folded`` (another listing of an incident that is counted, null: not) and what the digest
    counts. Works on a stream (append mode) and on a table.
    """
    for c, kind in _DIGEST_INPUT.items():  # what a feed doesn't have counts as unknown
        inc = inc if c in inc.columns else inc.withColumn(c, F.lit(None).cast(kind))
    text, label = F.upper(F.coalesce("assisting", F.lit(""))), category(F.col("cause"), "digest")
    located, tried = F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.coalesce(F.col("geocode_attempts"), F.lit(0)) >= 3
    fold = F.coalesce("folded", F.lit(False))
    wet = F.coalesce(F.col("weather_precip_prob") >= 20, F.lit(False)) | F.coalesce(F.col("weather_precip_in") > 0.005, F.lit(False))
    alert = F.coalesce("nws_flash_flood_warning", F.lit(False)) | F.coalesce("nws_severe_thunderstorm_warning", F.lit(False)) | F.coalesce("nws_tornado_watch", F.lit(False))
    what = [~fold, fold, *[~fold & (label == c) for c in [*DIGEST, "Other"]], *[~fold & text.rlike(p) for p in AGENCIES.values()], ~fold & located, ~fold & ~located & ~tried, ~fold & ~located & tried, ~fold & wet, ~fold & alert]
    panes = _panes(inc, "created_at", watermark).agg(*[F.count_if(c).alias(n) for n, c in zip(ROLLING, what, strict=True)])
    late = F.col("hour") >= F.col("w.end") - F.expr("INTERVAL 24 HOURS")
    spread = panes.select(F.window("window", "48 hours", "1 hour").alias("w"), F.col("window.start").alias("hour"), *ROLLING)
    out = spread.groupBy("w").agg(*[F.sum(F.when(late, F.col(c)).otherwise(0)).alias(c) for c in ROLLING], F.sum(F.when(late, 0).otherwise(F.col("new"))).alias("previous"))
    return out.select(F.col("w.end").alias("until"), "new", "previous", *ROLLING[1:])


def rolling_24h(inc: DataFrame, watermark: str = "6 minutes") -> DataFrame:
    """STR-07: the digest's counts alone, all listings counted; ``rolling_digest`` has the rest."""
    return rolling_digest(inc.drop("folded"), watermark).select("until", F.col("new").alias("n"), *[c for c in ROLLING if c.startswith(("n_", "agency_")) or c in ("located", "locating", "unmappable")])


def rolling_roads(inc: DataFrame, watermark: str = "6 minutes") -> DataFrame:
    """STR-07: incidents of each road in the 24 hours before each full hour: until, road, n (append mode, or a table).
    ``inc`` has created_at and corridors; ``top_roads`` ranks what was written."""
    rows = inc.select("created_at", "corridors").withWatermark("created_at", watermark).select("created_at", F.explode_outer("corridors").alias("road"))
    panes = rows.groupBy(F.window("created_at", "1 hour"), "road").agg(F.count(F.lit(1)).alias("n"))  # incidents without a road move the watermark too
    return _over(panes, 24, "road").agg(F.sum("n").alias("n")).filter("road IS NOT NULL").select(F.col("window.end").alias("until"), "road", "n")


def top_roads(rolled: DataFrame, top_n: int = 5) -> DataFrame:
    """STR-07: the first roads of each hour of a table of ``rolling_roads``: until, rank, road, n (batch: ``panels.digest_roads``)."""
    most = Window.partitionBy("until").orderBy(F.desc("n"), "road")  # the roads of one hour
    return rolled.withColumn("rank", F.row_number().over(most)).filter(F.col("rank") <= top_n).select("until", "rank", "road", "n")


def rolling_budget(requests: DataFrame, cap: int = 100, watermark: str = "6 minutes") -> DataFrame:
    """STR-07: look-ups of the 24 hours before each full hour, and what is left of the cap (batch: ``ingest.budget``)."""
    panes = _panes(requests, "requested_at", watermark).agg(F.count(F.lit(1)).alias("used"))
    used = _over(panes, 24).agg(F.sum("used").alias("used"))
    return used.select(F.col("window.end").alias("until"), "used", F.greatest(F.lit(cap) - F.col("used"), F.lit(0)).alias("left"))


def feed_health(listings: DataFrame, now: str, minutes: int = 20) -> DataFrame:
    """STR-11: the last sweep and whether what it says can be relied on."""
    last = listings.agg(F.max("sweep_ts").alias("last_sweep"))
    age = F.timestamp_diff("MINUTE", F.col("last_sweep"), F.lit(now).cast("timestamp_ntz"))
    return last.withColumn("status", F.when(age.isNull() | (age > minutes), "unverified").otherwise("verified"))


def status_at(inc: DataFrame, at: str, slack_min: int = 6, skew_min: int = 5) -> DataFrame:
    """STR-12: what was on the feed at a moment: first seen by then (up to ``skew_min`` later, for clocks that are ahead),
    last seen no more than ``slack_min`` before."""
    t = F.lit(at).cast("timestamp_ntz")
    return inc.filter((F.col("first_seen_at") <= t + F.expr(f"INTERVAL {skew_min} MINUTES")) & (F.col("last_seen_at") >= t - F.expr(f"INTERVAL {slack_min} MINUTES")))
