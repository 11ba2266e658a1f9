"""Episodes of repeated listings and collapsed control calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dispatchlake.functions.causes import severity
from dispatchlake.functions.text import folded
from dispatchlake.sources.scratch import stored


def _chained(inc: DataFrame, window_min: int) -> DataFrame:
    """Rows that may belong to an episode, with location_key, severity and the number ``no`` of their episode there.

    A record joins the one before it at the same place if the gap is at most the window. Rows are chained within a place
    and a day; how a day follows on the days before it is found on one summary row for each of them, so a place with very
    many rows is spread over as many tasks as it has days.
    """
    rows = inc.withColumn("location_key", folded(F.col("location"))).withColumn("severity", severity(F.col("cause")))
    rows = rows.filter((F.col("location_key") != "") & F.col("reported_ts").isNotNull() & (F.upper(F.trim("cause")) != "TRAFFIC CONTROL")).withColumn("day", F.to_date("reported_ts"))
    rows = stored(rows, "episodes")  # read twice below; what parsed the times isn't run again
    apart = lambda early, late: F.timestamp_diff("SECOND", early, late) > window_min * 60 if window_min > 0 else F.lit(True)
    keys = ["location_key", "day"]
    by_time = Window.partitionBy(*keys).orderBy("reported_ts", "incident_number")
    before = F.lag("reported_ts").over(by_time)
    starts = F.when(before.isNotNull() & apart(before, F.col("reported_ts")), 1).otherwise(0)  # the day's first row is dealt with below
    days = rows.select(*keys, "reported_ts", "incident_number").withColumn("starts", starts).groupBy(*keys).agg(F.min("reported_ts").alias("lo"), F.max("reported_ts").alias("hi"), F.sum("starts").alias("starts"))
    over_days = Window.partitionBy("location_key").orderBy("day")
    last = F.lag("hi").over(over_days)
    days = days.withColumn("opens", F.when(last.isNull() | apart(last, F.col("lo")), 1).otherwise(0))
    first_no = F.sum(F.col("opens") + F.col("starts")).over(over_days.rowsBetween(Window.unboundedPreceding, 0)) - F.col("starts")
    rows = rows.withColumn("starts", starts).withColumn("no", F.sum("starts").over(by_time.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")
    return rows.join(days.select(*keys, first_no.alias("first_no")), keys).withColumn("no", F.col("no") + F.col("first_no")).drop("first_no", "day")


def episodes(inc: DataFrame, window_min: int = 15) -> DataFrame:
    """AGG-01: one row for each episode: its primary record, and the others as ``extras`` in order of time.

    ``inc`` has reported_ts. The primary is located if any is, then the most severe, then the first; the window is
    held between 0 (no folding) and 120 minutes.
    """
    rows = _chained(inc, max(0, min(120, window_min)))
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    packed = F.struct(*[c for c in ("reported_ts", "incident_number", "cause", "reported", "severity") if c in rows.columns])
    best = F.struct(~located, -F.col("severity"), "reported_ts", "incident_number", packed)
    own = [c for c in inc.columns if c != "severity"]
    out = rows.groupBy("location_key", "no").agg(
        F.min_by(F.struct(*own, "severity", packed.alias("packed")), best).alias("p"),
        F.sort_array(F.collect_list(packed)).alias("listings"),
        F.count(F.lit(1)).alias("n_listings"),
        F.min("reported_ts").alias("first_ts"),
        F.max("reported_ts").alias("last_ts"),
    )
    at = F.array_position("listings", F.col("p.packed")).cast("int")
    extras = F.concat(F.slice("listings", F.lit(1), at - 1), F.slice("listings", at + 1, F.size("listings")))
    return out.select(*[F.col(f"p.{c}") for c in (*own, "severity")], "location_key", extras.alias("extras"), "n_listings", "first_ts", "last_ts")


def secondary_ids(ep: DataFrame) -> DataFrame:
    """Listings folded into another one."""
    return ep.select(F.explode("extras").alias("x")).select("x.incident_number")


#: What folding needs of a listing.
FOLDING = ["incident_number", "location", "cause", "reported_ts", "latitude", "longitude"]


def folded_ids(inc: DataFrame, window_min: int = 15) -> DataFrame:
    """Listings that are folded into another one, from the columns that this takes alone."""
    return secondary_ids(episodes(inc.select(*FOLDING), window_min))


def drop_secondaries(df: DataFrame, ep: DataFrame) -> DataFrame:
    """JN-22: rows that are no episode's secondary."""
    return df.join(secondary_ids(ep), "incident_number", "left_anti")


def collapse_control(inc: DataFrame, days: int = 30) -> DataFrame:
    """AGG-02: located traffic-control calls as one row for each place, with counts of the last active days."""
    rows = inc.filter((F.upper(F.trim("cause")) == "TRAFFIC CONTROL") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).withColumn("location_key", folded(F.col("location")))
    daily = rows.groupBy("location_key", F.to_date("reported_ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("latitude").alias("lat"), F.sum("longitude").alias("lon"), F.min("reported_ts").alias("lo"), F.max("reported_ts").alias("hi"), F.min(F.struct("incident_number", "location", "assisting")).alias("first")
    )
    out = daily.groupBy("location_key").agg(
        F.sum("n").alias("n_calls"), (F.sum("lat") / F.sum("n")).alias("latitude"), (F.sum("lon") / F.sum("n")).alias("longitude"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"), F.min("first").alias("first"),
        F.sort_array(F.collect_list(F.when(F.col("day").isNotNull(), F.struct("day", "n")))).alias("history"),
    )
    history = F.when(F.size("history") > days, F.slice("history", F.lit(-days), F.lit(days))).otherwise(F.col("history"))
    return out.withColumn("history", history).select("location_key", F.col("first.incident_number").alias("incident_number"), F.col("first.location").alias("location"), F.col("first.assisting").alias("assisting"), "n_calls", "latitude", "longitude", "first_ts", "last_ts", "history")
