"""Lengths and traffic of roads, nearest edges, and points along lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dispatchlake.functions import geo
from dispatchlake.functions.roads import normalize_road
from dispatchlake.sources.scratch import stored


def overlap_segments(roads: DataFrame, counts: DataFrame) -> DataFrame:
    """JN-11: overlaps (in miles) of road and traffic segments of the same route."""
    a = roads.select("route_id", "full_name", F.col("from_mi").alias("lo"), F.col("to_mi").alias("hi"))
    b = counts.filter("aadt IS NOT NULL").select(F.col("route_id").alias("rid"), F.col("from_mi").alias("a_lo"), F.col("to_mi").alias("a_hi"), "aadt")
    return _meet(a, b)


def _meet(a: DataFrame, b: DataFrame) -> DataFrame:
    out = a.join(b, (F.col("route_id") == F.col("rid")) & (F.col("lo") < F.col("a_hi")) & (F.col("a_lo") < F.col("hi")))
    return out.withColumn("overlap", F.least("hi", "a_hi") - F.greatest("lo", "a_lo")).drop("rid")


def overlap_totals(roads: DataFrame, counts: DataFrame, keys: tuple[str, ...] = ("route_id",)) -> DataFrame:
    """JN-11 summed up by ``keys`` (columns of the road segments): overlaps (n), their miles (counted) and miles times
    traffic (traffic), without pairing the segments.

    Equal segments go together. Along each route the traffic segments add up to totals at their ends and those of the
    road segments, in one sweep over its distinct mile points; a road segment takes the difference between its two ends.
    Segments that don't run forward are few; they are paired.
    """
    a = roads.groupBy(*{*keys, "route_id"}, F.col("from_mi").alias("lo"), F.col("to_mi").alias("hi")).agg(F.count(F.lit(1)).alias("k"))
    b = counts.filter("aadt IS NOT NULL").groupBy(F.col("route_id").alias("rid"), F.col("from_mi").alias("a_lo"), F.col("to_mi").alias("a_hi")).agg(F.count(F.lit(1)).alias("m"), F.sum("aadt").alias("w"))
    point = lambda x, m, w, begins, ends: F.struct(F.col(x).alias("x"), m.alias("m"), w.alias("w"), begins.alias("begins"), ends.alias("ends"))
    m, w, no, none = F.col("m"), F.col("w"), F.lit(0).cast("long"), F.lit(0.0)
    marks = b.filter("a_lo < a_hi").select("rid", F.explode(F.array(point("a_lo", m, w, m, no), point("a_hi", -m, -w, no, m))).alias("p"))
    marks = marks.unionByName(a.filter("lo < hi").select(F.col("route_id").alias("rid"), F.explode(F.array(point("lo", no, none, no, no), point("hi", no, none, no, no))).alias("p")))
    marks = marks.groupBy("rid", F.col("p.x").alias("x")).agg(*[F.sum(f"p.{c}").alias(c) for c in ("m", "w", "begins", "ends")])
    order = Window.partitionBy("rid").orderBy("x")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    step = marks.withColumn("len", F.lead("x").over(order) - F.col("x"))
    step = step.select("rid", "x", (F.sum("m").over(upto) * F.col("len")).alias("m"), (F.sum("w").over(upto) * F.col("len")).alias("w"), F.coalesce(F.sum("begins").over(before), no).alias("begun"), F.sum("ends").over(upto).alias("ended"))
    step = step.select("rid", "x", F.coalesce(F.sum("m").over(before), none).alias("m"), F.coalesce(F.sum("w").over(before), none).alias("w"), "begun", "ended")
    at = lambda end: step.select(F.col("rid").alias("route_id"), F.col("x").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("m", "w", "begun", "ended")])
    k = F.col("k")
    swept = a.filter("lo < hi").join(at("lo"), ["route_id", "lo"]).join(at("hi"), ["route_id", "hi"])
    swept = swept.select(*keys, (k * (F.col("hi_begun") - F.col("lo_ended"))).alias("n"), (k * (F.col("hi_m") - F.col("lo_m"))).alias("counted"), (k * (F.col("hi_w") - F.col("lo_w"))).alias("traffic")).filter("n > 0")
    rest = _meet(a.filter("lo >= hi"), b).unionByName(_meet(a.filter("lo < hi"), b.filter("a_lo >= a_hi")))
    rest = rest.select(*keys, (k * m).alias("n"), (k * m * F.col("overlap")).alias("counted"), (k * F.col("overlap") * w).alias("traffic"))
    return swept.unionByName(rest).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "counted", "traffic")])


def road_stats(roads: DataFrame, counts: DataFrame, least_share: float = 0.6, least_miles: float = 0.05) -> DataFrame:
    """AGG-47: miles and vehicle-miles a day of each road.

    Ramps (third part of the route id other than 1) and proposed roads are dropped. Of the two directions of a divided
    road (second part) the longer length and the larger traffic count. Traffic is weighted by overlap; if at least
    ``least_share`` of the length was counted it is scaled to the whole, otherwise it is 0.
    """
    part = F.split("route_id", "_")
    own = roads.filter((F.element_at(part, -2) == "1") & ~F.lower("full_name").contains("proposed"))
    # the name rules are long: they run once for each distinct name (the second grouping keeps them from being copied)
    names = own.select("full_name").distinct().groupBy("full_name").agg(F.first(normalize_road(F.col("full_name"))).alias("road"))
    own = own.join(names, "full_name").filter("road <> ''")
    miles = own.groupBy("road", "route_id").agg(F.sum(F.col("to_mi") - F.col("from_mi")).alias("miles"))
    laps = overlap_totals(own, counts, ("road", "route_id")).drop("n")
    rows = miles.join(laps, ["road", "route_id"], "left").withColumn("base", F.regexp_replace("route_id", r"_[^_]+_[^_]+_[^_]+$", ""))
    pair = rows.groupBy("road", "base").agg(F.max("miles").alias("miles"), F.max(F.coalesce("traffic", F.lit(0.0))).alias("traffic"), F.max(F.coalesce("counted", F.lit(0.0))).alias("counted"))
    out = pair.groupBy("road").agg(F.sum("miles").alias("miles"), F.sum("traffic").alias("traffic"), F.sum("counted").alias("counted")).filter(F.col("miles") >= least_miles)
    scaled = F.when(F.col("counted") >= least_share * F.col("miles"), F.col("traffic") / F.col("counted") * F.col("miles")).otherwise(0.0)
    return out.select("road", F.round("miles", 3).alias("miles"), F.round(scaled, 1).alias("vehicle_miles"))


def _edges_around(points: DataFrame, net: DataFrame, metres: float) -> DataFrame:
    """Edges whose box shares a cell with the surroundings of a point. A network may go far beyond the points; only this
    part of it is posted to the small cells of the search."""
    side = metres / geo.DEGREE_M * 1.2  # the widest cells of the search
    cell = lambda c: F.floor(F.col(c) / side)
    about = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    cells = points.select(cell("latitude").alias("y0"), cell("longitude").alias("x0")).distinct()
    cells = cells.select(about("y0").alias("y"), "x0").select("y", about("x0").alias("x")).distinct()
    box = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / side), F.floor(F.greatest(a, b) / side)))
    posted = net.withColumn("y", box("u_lat", "v_lat")).withColumn("x", box("u_lon", "v_lon"))
    return posted.join(cells, ["y", "x"], "left_semi").drop("y", "x").distinct()


RINGS = (16, 4, 1)  # parts of the widest reach that are searched, one after another


def snap_to_node(points: DataFrame, edges: DataFrame, nodes: DataFrame, metres: float = 800.0, min_degree: int = 3) -> DataFrame:
    """JN-16: nearest edge of each point within ``metres``, and its end with more streets, if that is an intersection.

    The search widens ring by ring: distinct points meet the edges of cells as wide as the ring, and only those without
    an edge within it go on to the next, wider one. So where edges are dense, a point meets the few around it, and where
    they are sparse, few cells are posted. Ties go to the smaller edge.
    """
    degree = edges.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    n = nodes.join(degree, "node_id", "left")
    end = lambda k: n.select(F.col("node_id").alias(k), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon"), F.col("degree").alias(f"{k}_degree"))
    net = edges.join(end("u"), "u").join(end("v"), "v")
    left = stored(points.select("latitude", "longitude").filter("latitude IS NOT NULL AND longitude IS NOT NULL").distinct(), "points")
    net = stored(_edges_around(left, net, metres), "edges")
    found = []
    for reach in (metres / k for k in RINGS):
        side = reach / geo.DEGREE_M * 1.2  # at this latitude a degree of longitude is shorter
        cells = lambda a, b, side=side: F.sequence(F.floor(F.least(a, b) / side) - 1, F.floor(F.greatest(a, b) / side) + 1)
        e = net.withColumn("y", F.explode(cells("u_lat", "v_lat"))).withColumn("x", F.explode(cells("u_lon", "v_lon")))
        off, _ = geo.seg_dist_m((F.col("y") + 0.5) * side, (F.col("x") + 0.5) * side, F.col("u_lat"), F.col("u_lon"), F.col("v_lat"), F.col("v_lon"))
        e = e.filter(off <= 2 * 1.2 * reach)  # a slanting edge passes few cells of its bounding box
        p = left.withColumn("y", F.floor(F.col("latitude") / side)).withColumn("x", F.floor(F.col("longitude") / side))
        d, _ = geo.seg_dist_m(F.col("latitude"), F.col("longitude"), F.col("u_lat"), F.col("u_lon"), F.col("v_lat"), F.col("v_lon"))
        near = p.join(e, ["y", "x"]).withColumn("d", F.round(d, 3)).filter(F.col("d") <= reach)
        best = near.groupBy("latitude", "longitude").agg(F.min(F.struct("d", "u", "v", "road_class", "u_degree", "v_degree")).alias("b"))
        found.append(stored(best.select("latitude", "longitude", "b.*"), "nearest"))
        left = left.join(found[-1].select("latitude", "longitude"), ["latitude", "longitude"], "left_anti")
    best = found[0]
    for x in found[1:]:
        best = best.unionByName(x)
    node, top = F.when(F.col("u_degree") >= F.col("v_degree"), F.col("u")).otherwise(F.col("v")), F.greatest("u_degree", "v_degree")
    return best.select("latitude", "longitude", F.col("d").alias("metres"), "u", "v", "road_class", F.when(top >= min_degree, node).alias("node_id"))


def road_class_by_edge(inc: DataFrame, snapped: DataFrame) -> DataFrame:
    """JN-17: incidents whose road class differs from that of their nearest edge."""
    out = inc.join(snapped.select("latitude", "longitude", "road_class"), ["latitude", "longitude"])
    return out.filter(~F.col("road_type").eqNullSafe(F.col("road_class"))).select("incident_number", F.col("road_type").alias("old_class"), F.col("road_class").alias("new_class"))


def intersection_counts(inc: DataFrame, snapped: DataFrame, top_n: int = 100) -> DataFrame:
    """AGG-06: incidents of each intersection."""
    rows = inc.join(snapped.filter("node_id IS NOT NULL").select("latitude", "longitude", "node_id"), ["latitude", "longitude"])
    return rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node_id").limit(top_n)


def path_segments(routes: DataFrame) -> DataFrame:
    """Segments of each route's path (array of lat, lng) with the metres before them."""
    seg = routes.select("route_id", F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path") - 1).alias("b"))).alias("no", "s"))
    seg = seg.select("route_id", "no", F.col("s.a.lat").alias("a_lat"), F.col("s.a.lng").alias("a_lon"), F.col("s.b.lat").alias("b_lat"), F.col("s.b.lng").alias("b_lon"))
    seg = seg.withColumn("len", geo.dist_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    before = Window.partitionBy("route_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return seg.withColumn("before", F.coalesce(F.sum("len").over(before), F.lit(0.0)))


def near_path(inc: DataFrame, routes: DataFrame, radius: float = 150.0) -> DataFrame:
    """JN-13: (route_id, incident_number, metres, along) of incidents within ``radius`` of a route's path.

    Segments are posted to the cells around them and incidents to their own cell.
    """
    side = max(radius, 200.0) / geo.DEGREE_M * 1.2
    cells = lambda a, b: F.sequence(F.floor(F.least(a, b) / side) - 1, F.floor(F.greatest(a, b) / side) + 1)
    seg = path_segments(routes).withColumn("y", F.explode(cells("a_lat", "b_lat"))).withColumn("x", F.explode(cells("a_lon", "b_lon")))
    p = inc.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select("incident_number", "latitude", "longitude").withColumn("y", F.floor(F.col("latitude") / side)).withColumn("x", F.floor(F.col("longitude") / side))
    d, t = geo.seg_dist_m(F.col("latitude"), F.col("longitude"), F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    near = p.join(seg, ["y", "x"]).withColumn("metres", F.round(d, 3)).withColumn("along", F.round(F.col("before") + t * F.col("len"), 3)).filter(F.col("metres") <= radius)
    best = near.groupBy("route_id", "incident_number").agg(F.min(F.struct("metres", "along")).alias("b"))
    return best.select("route_id", "incident_number", "b.metres", "b.along")


def route_roads(inc: DataFrame, routes: DataFrame, radius: float = 150.0, span: float = 400.0) -> DataFrame:
    """AGG-48: roads that a path runs along: incidents near it named by the road spread over ``span`` metres, or a third
    of the path if that is less (rows have corridors)."""
    total = path_segments(routes).groupBy("route_id").agg(F.sum("len").alias("total"))
    rows = near_path(inc, routes, radius).join(inc.select("incident_number", F.explode("corridors").alias("road")), "incident_number")
    out = rows.groupBy("route_id", "road").agg((F.max("along") - F.min("along")).alias("spread"), F.count(F.lit(1)).alias("n")).join(total, "route_id")
    return out.filter(F.col("spread") >= F.least(F.lit(span), F.col("total") / 3)).select("route_id", "road", "n", F.round("spread", 1).alias("spread"))
