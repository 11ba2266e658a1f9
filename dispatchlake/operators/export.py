"""The unified export, path simplification and resolution of typed road names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.functions import causes, roads, text, times
from dispatchlake.operators.episodes import collapse_control, episodes, secondary_ids


def export_incidents(inc: DataFrame, active: DataFrame, window_min: int = 15) -> DataFrame:
    """SNK-03: located incidents other than control calls, with derived fields and the listings folded into them, and
    the collapsed control groups. ``inc`` has reported_ts; ``active`` the ids of the last sweep."""
    ep = episodes(inc, window_min)
    located = inc.filter("latitude IS NOT NULL AND longitude IS NOT NULL").filter(F.upper(F.trim("cause")) != "TRAFFIC CONTROL")
    rows = located.join(secondary_ids(ep), "incident_number", "left_anti")
    folded = ep.select("incident_number", F.transform("extras", lambda x: F.struct(x["incident_number"].alias("id"), x["cause"].alias("cause"), x["reported_ts"].alias("reported_ts"))).alias("folded"))
    rows = rows.join(folded, "incident_number", "left").join(active.select("incident_number", F.lit(True).alias("in_feed")).distinct(), "incident_number", "left")
    rows = roads.with_incident_corridors(causes.with_agencies(times.with_time_context(rows)))
    rows = rows.select(
        "incident_number", F.trim(F.regexp_replace("location", r"(?U)\s+", " ")).alias("location"), "cause", causes.category(F.col("cause")).alias("category"), "reported_ts", "latitude", "longitude", "assisting", "agency_mask", "hour_of_day", "day_of_week", "is_rush_hour",
        "corridors", "folded", F.coalesce("in_feed", F.lit(False)).alias("in_feed"), F.lit(1).cast("long").alias("n_calls"),
    )
    control = collapse_control(inc).select("incident_number", "location", F.lit("TRAFFIC CONTROL").alias("cause"), F.lit("control").alias("category"), F.col("last_ts").alias("reported_ts"), "latitude", "longitude", "assisting", "n_calls", "history")
    return rows.unionByName(control, allowMissingColumns=True)


def simplify_paths(df: DataFrame, tolerance_m: float = 10.0) -> DataFrame:
    """AGG-52: paths (path_id, path of lat/lng) with the points that keep every other within ``tolerance_m`` metres of
    the line (Douglas-Peucker). Each path is one row; paths of up to two points stay as they are."""
    import math

    def keep(p: list[dict]) -> list[dict]:
        k = math.cos(math.radians(p[0]["lat"])) * 111_320.0
        xy = [(q["lng"] * k, q["lat"] * 111_320.0) for q in p]
        held, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
        while todo:
            a, z = todo.pop()
            (ax, ay), (bx, by) = xy[a], xy[z]
            dx, dy = bx - ax, by - ay
            size = dx * dx + dy * dy
            far, at = -1.0, -1
            for i in range(a + 1, z):
                t = max(0.0, min(1.0, ((xy[i][0] - ax) * dx + (xy[i][1] - ay) * dy) / size)) if size else 0.0
                d = math.hypot(xy[i][0] - ax - t * dx, xy[i][1] - ay - t * dy)
                if d > far:
                    far, at = d, i
            if far > tolerance_m:
                held.add(at)
                todo += [(a, at), (at, z)]
        return [p[i] for i in sorted(held)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [keep(p) if p and len(p) > 2 else p for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("lat", pa.float64()), ("lng", pa.float64())])))], names=["path_id", "path"])

    kind = f"path_id {df.schema['path_id'].dataType.simpleString()}, path array<struct<lat:double,lng:double>>"
    return df.select("path_id", "path").mapInArrow(run, kind)


def resolve_road(typed: DataFrame, known: DataFrame) -> DataFrame:
    """JN-21: the shortest known road (ties: first by name) that begins with each typed name, after normalisation.

    Known names are posted under all their prefixes, so it is an equi-join.
    """
    names = known.select("road").distinct()
    posts = names.select("road", F.explode(F.transform(F.sequence(F.lit(1), F.length("road")), lambda n: F.substring(F.col("road"), F.lit(1), n))).alias("prefix"))
    rows = typed.select("typed").distinct().withColumn("prefix", text.folded(F.col("typed"))).withColumn("plain", roads.normalize_road(F.col("typed")))
    both = rows.select("typed", F.explode(F.array_distinct(F.array("prefix", "plain"))).alias("prefix")).filter("prefix <> ''").join(posts, "prefix")
    best = both.groupBy("typed").agg(F.min(F.struct(F.length("road").alias("n"), "road")).alias("b"))
    return rows.select("typed").join(best, "typed", "left").select("typed", F.col("b.road").alias("road"))
