"""New listings, merges, sightings, geocoding queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dispatchlake.functions.causes import AGENCIES


def filter_new(listings: DataFrame, index: DataFrame) -> DataFrame:
    """JN-01: listings whose id and content key are both unseen, the first (by pos) of each key in the batch."""
    fresh = listings.join(index.select("incident_number").distinct(), "incident_number", "left_anti").join(index.select("content_key").distinct(), "content_key", "left_anti")
    first = Window.partitionBy("content_key").orderBy("pos", "incident_number")
    return fresh.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")


def merge_ignore(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """JN-02, SNK-07: insert where the key doesn't exist."""
    return current.unionByName(new.join(current.select(*key), key, "left_anti").dropDuplicates(key), allowMissingColumns=True)


def seed_from_archive(current: DataFrame, archive: DataFrame, key: str = "incident_number") -> DataFrame:
    """SNK-07: the working table with archive rows whose key it doesn't have; the archive's other columns are dropped."""
    return merge_ignore(current, archive.select(*[c for c in archive.columns if c in current.columns]), [key])


def merge_add(current: DataFrame, new: DataFrame, key: list[str], counts: list[str]) -> DataFrame:
    """JN-02: insert, or add to the counters."""
    return current.select(*key, *counts).unionByName(new.select(*key, *counts)).groupBy(*key).agg(*[F.sum(c).alias(c) for c in counts])


def merge_replace(current: DataFrame, new: DataFrame, key: list[str], keep: Column | None = None) -> DataFrame:
    """JN-02: insert or replace; rows of ``current`` for which ``keep`` holds are not replaced."""
    held = current.filter(keep) if keep is not None else current.limit(0)
    rows = new.join(held.select(*key), key, "left_anti")
    return current.join(rows.select(*key), key, "left_anti").unionByName(rows)


def touch_observations(inc: DataFrame, sweep: DataFrame, at: Column) -> DataFrame:
    """JN-03: incidents seen in a sweep, by id or content key, once each: last_seen_at and observation_count go on,
    an empty first_seen_at is filled."""
    by_id = inc.select("incident_number").join(sweep.select("incident_number"), "incident_number", "left_semi")
    by_key = inc.select("incident_number", "content_key").join(sweep.select("content_key"), "content_key", "left_semi").select("incident_number")
    seen = by_id.union(by_key).distinct().withColumn("seen", F.lit(True))
    out = inc.join(seen, "incident_number", "left")
    hit = F.coalesce("seen", F.lit(False))
    out = out.withColumn("first_seen_at", F.when(hit, F.coalesce("first_seen_at", at)).otherwise(F.col("first_seen_at"))).withColumn("last_seen_at", F.when(hit, at).otherwise(F.col("last_seen_at")))
    return out.withColumn("observation_count", F.coalesce("observation_count", F.lit(0)) + hit.cast("int")).drop("seen")


def track_sightings(listings: DataFrame) -> DataFrame:
    """JN-03 over a history of sweeps: first and last sighting and the number of sweeps of each incident."""
    return listings.groupBy("incident_number").agg(F.min("sweep_ts").alias("first_seen_at"), F.max("sweep_ts").alias("last_seen_at"), F.count_distinct("sweep_ts").alias("observation_count"))


def accumulate_agencies(listings: DataFrame) -> DataFrame:
    """JN-04, STR-04: one change row for each agency that a later sweep adds; agencies are never removed.

    Agencies are told by their patterns (PRJ-15), so ``FIRE DEPT`` is one; each counts from the first sweep that names it.
    """
    text = F.upper(F.coalesce("assisting", F.lit("")))
    agencies = F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in AGENCIES.items()]))
    named = listings.select("incident_number", "sweep_ts", F.explode(agencies).alias("agency"))
    first = named.groupBy("incident_number", "agency").agg(F.min("sweep_ts").alias("changed_at"))
    begin = listings.groupBy("incident_number").agg(F.min("sweep_ts").alias("begin"))
    return first.join(begin, "incident_number").filter("changed_at > begin").drop("begin")


def change_stats(changes: DataFrame) -> DataFrame:
    """AGG-14: since when, incidents with changes, changes, and those that added the fire department."""
    return changes.agg(F.date_format(F.min("changed_at"), "yyyy-MM-dd HH:mm:ss").alias("since"), F.count_distinct("incident_number").alias("tracked"), F.count(F.lit(1)).alias("added"), F.count_if(F.col("agency") == "fire").alias("fire_added"))


def active_set_changes(listings: DataFrame) -> DataFrame:
    """STR-03: appeared and left events between consecutive sweeps of the feed (left: not in the next sweep)."""
    sweeps = listings.select("sweep_ts").distinct()
    order = Window.orderBy("sweep_ts")  # sweeps: one row every five minutes
    sweeps = sweeps.withColumn("next", F.lead("sweep_ts").over(order)).withColumn("no", F.row_number().over(order))
    rows = listings.select("incident_number", "sweep_ts").distinct().join(sweeps, "sweep_ts")
    mine = Window.partitionBy("incident_number").orderBy("no")
    rows = rows.withColumn("prev_no", F.lag("no").over(mine)).withColumn("next_no", F.lead("no").over(mine))
    came = rows.filter("prev_no IS NULL OR prev_no < no - 1").select("incident_number", F.col("sweep_ts").alias("at"), F.lit("appeared").alias("event"))
    left = rows.filter("next IS NOT NULL AND (next_no IS NULL OR next_no > no + 1)").select("incident_number", F.col("next").alias("at"), F.lit("left").alias("event"))
    return came.unionByName(left)


def presence_events(listings: DataFrame, sweep_min: int = 5) -> DataFrame:
    """STR-02 over a history of sweeps: appeared and left events of each incident with its sightings up to then.

    An incident has left when the sweep ``sweep_min`` minutes later doesn't list it; a leave at the newest sweep is open.
    """
    rows = listings.select("incident_number", F.col("sweep_ts").cast("timestamp_ntz").alias("t")).distinct()
    newest = rows.agg(F.max("t").alias("newest"))
    mine = Window.partitionBy("incident_number").orderBy("t")  # the sweeps of one incident
    step = F.expr(f"INTERVAL {sweep_min} MINUTES")
    rows = rows.select("incident_number", "t", F.lag("t").over(mine).alias("prev"), F.lead("t").over(mine).alias("next"), F.first("t").over(mine).alias("first_seen_at"), F.row_number().over(mine).alias("observation_count")).join(F.broadcast(newest))  # one row
    came = rows.filter(F.col("prev").isNull() | (F.col("t") > F.col("prev") + step)).withColumn("event", F.lit("appeared")).withColumn("at", F.col("t"))
    left = rows.filter((F.col("next").isNull() | (F.col("next") > F.col("t") + step)) & (F.col("t") + step < F.col("newest"))).withColumn("event", F.lit("left")).withColumn("at", F.col("t") + step)
    return came.unionByName(left).select("incident_number", "event", "at", "first_seen_at", F.col("t").alias("last_seen_at"), "observation_count")


def with_in_feed(inc: DataFrame, sweep: DataFrame) -> DataFrame:
    """JN-18: in_feed, whether the id is in the last successful sweep."""
    return inc.join(sweep.select("incident_number", F.lit(True).alias("in_feed")).distinct(), "incident_number", "left").withColumn("in_feed", F.coalesce("in_feed", F.lit(False)))


def reuse_coords(inc: DataFrame) -> DataFrame:
    """JN-05: position of rows without one: from a row at exactly the same location, else at the same folded one.

    The smallest incident number decides among several.
    """
    known = inc.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    pick = lambda c, name: known.groupBy(c).agg(F.min_by(F.struct("latitude", "longitude"), "incident_number").alias(name))
    out = inc.join(pick("location", "exact"), "location", "left").join(pick("location_key", "near"), "location_key", "left")
    p = F.coalesce(F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.struct("latitude", "longitude")), "exact", "near")
    how = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), "own").when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "normalised").otherwise("none")
    return out.withColumn("coord_source", how).withColumn("latitude", p["latitude"]).withColumn("longitude", p["longitude"]).drop("exact", "near")


def failure_history(inc: DataFrame, least: int = 3) -> DataFrame:
    """AGG-12: most attempts of each address without a position, from ``least``."""
    rows = inc.filter("(latitude IS NULL OR longitude IS NULL) AND location_key <> ''")
    return rows.groupBy("location_key").agg(F.max("geocode_attempts").alias("attempts"), F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("last_attempt")).filter(F.col("attempts") >= least)


def skippable_addresses(failures: DataFrame, now: str, least: int = 3, days: int = 7) -> DataFrame:
    """JN-06: addresses that failed often and lately."""
    return failures.filter((F.col("attempts") >= least) & (F.col("last_attempt").cast("timestamp_ntz") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))).select("location_key")


def record_outcomes(attempted: DataFrame, resolved: DataFrame, failures: DataFrame) -> DataFrame:
    """JN-07: failures after a batch: one more for each address attempted in vain, none for those that were resolved."""
    failed = attempted.join(resolved.select("location_key"), "location_key", "left_anti").select("location_key").distinct().withColumn("attempts", F.lit(1))
    kept = failures.select("location_key", "attempts").join(resolved.select("location_key"), "location_key", "left_anti")
    return merge_add(kept, failed, ["location_key"], ["attempts"])


def fallback_points(inc: DataFrame, k: int = 8) -> DataFrame:
    """AGG-11: exact positions that at least ``k`` different locations share."""
    rows = inc.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    return rows.groupBy("latitude", "longitude").agg(F.count_distinct("location_key").alias("places"), F.count(F.lit(1)).alias("n")).filter(F.col("places") >= k)


def budget(requests: DataFrame, now: str, cap: int, want: int) -> DataFrame:
    """AGG-09: requests of the last 24 hours, what is left of the cap, and how many of ``want`` are approved."""
    end = F.lit(now).cast("timestamp_ntz")
    used = F.count_if((F.col("requested_at") > end - F.expr("INTERVAL 24 HOURS")) & (F.col("requested_at") <= end))
    return requests.agg(used.alias("used")).withColumn("left", F.greatest(F.lit(cap) - F.col("used"), F.lit(0))).withColumn("approved", F.least(F.lit(want), F.col("left")))


def estimate_lookups(inc: DataFrame, known: DataFrame, skip: DataFrame) -> DataFrame:
    """AGG-10: distinct addresses without a position that are neither known nor skipped."""
    rows = inc.filter("(latitude IS NULL OR longitude IS NULL) AND location_key <> ''").select("location_key").distinct()
    return rows.join(known.select("location_key"), "location_key", "left_anti").join(skip.select("location_key"), "location_key", "left_anti").agg(F.count(F.lit(1)).alias("n"))


def retry_plan(inc: DataFrame, skip: DataFrame, requests: DataFrame, now: str, batch: int = 25, cap: int = 100, reserve: int = 25) -> DataFrame:
    """AGG-53: the newest rows to try again, at most a batch and never more than the budget above the reserve."""
    allowed = budget(requests, now, cap - reserve, batch).select("approved")
    rows = inc.filter("(latitude IS NULL OR longitude IS NULL) AND coalesce(geocode_attempts, 0) < 3").join(skip.select("location_key"), "location_key", "left_anti")
    rows = rows.select("incident_number", "location_key", "created_at").orderBy(F.desc("created_at"), "incident_number").limit(batch)
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("created_at"), "incident_number")))  # at most a batch
    return rows.join(F.broadcast(allowed)).filter("rank <= approved").select("rank", "incident_number", "location_key")


def bump_attempts(inc: DataFrame, attempted: DataFrame) -> DataFrame:
    """JN-23: one more attempt for rows whose address was tried and that still have no position."""
    tried = attempted.select("location_key", F.lit(1).alias("tried")).distinct()
    more = F.when(F.col("latitude").isNull() | F.col("longitude").isNull(), F.coalesce("tried", F.lit(0))).otherwise(0)
    return inc.join(tried, "location_key", "left").withColumn("geocode_attempts", F.coalesce("geocode_attempts", F.lit(0)) + more).drop("tried")


def retire(inc: DataFrame, skip: DataFrame, cap: int = 3) -> DataFrame:
    """JN-23: rows at skipped addresses count as tried to the cap."""
    out = inc.join(skip.select("location_key", F.lit(True).alias("gone")).distinct(), "location_key", "left")
    unplaced = F.col("latitude").isNull() | F.col("longitude").isNull()
    n = F.coalesce("geocode_attempts", F.lit(0))
    return out.withColumn("geocode_attempts", F.when(F.col("gone") & unplaced, F.greatest(n, F.lit(cap))).otherwise(n)).drop("gone")


def attach_state(archive: DataFrame, state: DataFrame) -> DataFrame:
    """JN-19: archive rows with attempts and sightings of the state table, defaults where it has none."""
    own = state.select("incident_number", "geocode_attempts", "first_seen_at", "last_seen_at", "observation_count")
    out = archive.drop("geocode_attempts", "first_seen_at", "last_seen_at", "observation_count").join(own, "incident_number", "left")
    return out.withColumn("geocode_attempts", F.coalesce("geocode_attempts", F.lit(0))).withColumn("observation_count", F.coalesce("observation_count", F.lit(1)))


def backfill_coords(archive: DataFrame, resolved: DataFrame) -> DataFrame:
    """SNK-05: positions from ``resolved`` where the archive has none."""
    new = resolved.select("incident_number", F.col("latitude").alias("new_lat"), F.col("longitude").alias("new_lon"))
    out = archive.join(new, "incident_number", "left")
    open_ = F.col("latitude").isNull() | F.col("longitude").isNull()
    return out.withColumn("lat", F.when(open_, F.col("new_lat")).otherwise(F.col("latitude"))).withColumn("lon", F.when(open_, F.col("new_lon")).otherwise(F.col("longitude"))).drop("latitude", "longitude", "new_lat", "new_lon").withColumnsRenamed({"lat": "latitude", "lon": "longitude"})


def location_state(df: DataFrame) -> DataFrame:
    """PRJ-34: located, locating, or unmappable after three attempts."""
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return df.withColumn("location_state", F.when(placed, "located").when(F.coalesce("geocode_attempts", F.lit(0)) >= 3, "unmappable").otherwise("locating"))


def grade_geocodes(results: DataFrame, south: float = 29.9, north: float = 30.5, west: float = -92.4, east: float = -91.7) -> DataFrame:
    """PRJ-27: label (exact, approximate, rejected) and reason of geocoding results.

    Towns and regions are too coarse; places outside the parish towns or the bounds are wrong; rooftops and street
    addresses are exact, the rest approximate.
    """
    towns = ["Lafayette", "Scott", "Broussard", "Youngsville", "Carencro", "Duson", "Milton", "Maurice"]
    reason = F.when(~F.col("place").isin(towns), "place").when(~(F.col("latitude").between(south, north) & F.col("longitude").between(west, east)), "bounds").when(F.col("result_type").isin("locality", "postal_code", "administrative_area"), "precision").when((F.col("location_type") == "APPROXIMATE") & ~F.col("result_type").isin("street_address", "intersection"), "precision")
    exact = F.col("location_type").isin("ROOFTOP", "RANGE_INTERPOLATED") | (F.col("result_type") == "intersection")
    out = results.withColumn("reason", F.coalesce(reason, F.lit("ok")))
    return out.withColumn("label", F.when(F.col("reason") != "ok", "rejected").when(exact, "exact").otherwise("approximate"))
