"""Incidents on saved routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dispatchlake.functions.roads import corridors
from dispatchlake.operators.episodes import episodes
from dispatchlake.operators.roadstats import near_path
from dispatchlake.sources.scratch import stored

_DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def with_route_schedule(routes: DataFrame) -> DataFrame:
    """PRJ-32: day_numbers (Monday 0) of ``days`` such as ``mon-fri``, ``sat,sun``, ``fri-mon``, ``daily``, ``weekends``;
    depart_minutes of ``depart`` (H:MM)."""
    no = lambda c: (F.array_position(F.array(*map(F.lit, _DAYS)), F.substring(F.trim(c), 1, 3)) - 1).cast("int")

    def span(p):
        a, z = no(F.substring_index(p, "-", 1)), no(F.substring_index(p, "-", -1))
        run = F.transform(F.sequence(a, z + F.when(z < a, 7).otherwise(0)), lambda d: F.pmod(d, F.lit(7)))
        return F.when((a >= 0) & (z >= 0), run).otherwise(F.array().cast("array<int>"))

    text = F.lower(F.trim(F.coalesce("days", F.lit("daily"))))
    text = F.when(text.isin("daily", "all", ""), "mon-sun").when(text == "weekends", "sat-sun").when(text == "weekdays", "mon-fri").otherwise(text)
    out = routes.withColumn("day_numbers", F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(text, r"\s*,\s*"), span)))))
    clock = r"^(\d{1,2}):(\d{2})$"
    minutes = F.regexp_extract("depart", clock, 1).try_cast("int") * 60 + F.regexp_extract("depart", clock, 2).try_cast("int")
    return out.withColumn("depart_minutes", F.when(minutes < 1440, minutes))


def effective_routes(base: DataFrame, override: DataFrame) -> DataFrame:
    """JN-24: routes by slot; an override replaces what it gives and keeps the rest; slots without path and roads go."""
    names = [c for c in base.columns if c != "route_id"]
    b, o = base.alias("b"), override.alias("o")
    out = b.join(o, "route_id", "full_outer").select("route_id", *[F.coalesce(F.col(f"o.{c}"), F.col(f"b.{c}")).alias(c) for c in names])
    return out.filter((F.coalesce(F.size("path"), F.lit(0)) >= 2) | (F.coalesce(F.size("corridors"), F.lit(0)) > 0))


def on_route_roads(inc: DataFrame, routes: DataFrame) -> DataFrame:
    """JN-14: (route_id, incident_number) of incidents on a road of a route; both have ``corridors``."""
    a = inc.select("incident_number", F.explode("corridors").alias("road"))
    return a.join(routes.select("route_id", F.explode("corridors").alias("road")), "road").select("route_id", "incident_number").distinct()


#: Fields of a route definition; fixed values.
FIELDS = ["NAME", "CORRIDORS", "PATH", "RADIUS_M", "DEPART", "DAYS", "DEPART_MON", "DEPART_TUE", "DEPART_WED", "DEPART_THU", "DEPART_FRI", "DEPART_SAT", "DEPART_SUN", "DELETE"]


def parse_route_lines(messages: DataFrame) -> DataFrame:
    """SRC-09: (message_id, route_id, fields) of route definitions in the text of messages (message_id, body).

    A line ``..._ROUTE_n_FIELD=value`` sets a field of slot n; reply quotes are ignored, a line without ``=`` goes on with
    the value before it, and a blank, unknown or foreign line ends it. The last value of a field counts.
    """
    lines = messages.select("message_id", F.posexplode(F.split("body", r"\r?\n|\r")).alias("no", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace(F.trim("line"), r"^(?:>\s*)+", "")))
    form = r"^(?:[A-Z0-9]+_)?ROUTE_(\d{1,2})_([A-Z_]+)\s*=\s*(.*)$"
    field = F.regexp_extract("line", form, 2)
    lines = lines.select("message_id", "no", F.when(field.isin(FIELDS), F.regexp_extract("line", form, 1)).cast("int").alias("route_id"), F.when(field.isin(FIELDS), field).alias("field"), F.when(field.isin(FIELDS), F.trim(F.regexp_extract("line", form, 3))).otherwise(F.col("line")).alias("value"))
    ends = F.col("field").isNotNull() | (F.col("value") == "") | F.contains("value", F.lit("="))
    run = Window.partitionBy("message_id").orderBy("no")
    lines = lines.withColumn("run", F.sum(ends.cast("int")).over(run))
    runs = lines.groupBy("message_id", "run").agg(F.min_by("route_id", "no").alias("route_id"), F.min_by("field", "no").alias("field"), F.sort_array(F.collect_list(F.struct("no", "value"))).alias("v"))  # the lines of one value
    runs = runs.filter("field IS NOT NULL").withColumn("value", F.trim(F.array_join(F.col("v.value"), " ")))
    last = runs.groupBy("message_id", "route_id", "field").agg(F.max_by("value", "run").alias("value"))
    return last.groupBy("message_id", "route_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))  # at most FIELDS


def apply_route_edits(current: DataFrame, edits: DataFrame) -> DataFrame:
    """SRC-09: (route_id, fields) after edits in the order of their message_id.

    DELETE takes a slot away. An edit with a path or roads replaces the slot; one without changes only what it names. What
    would not be a route (no departure, or neither path nor roads) changes nothing.
    """
    given = edits.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("message_id", F.map_entries("fields").alias("f")))).alias("edits"))  # one slot's messages
    both = given.join(current.select("route_id", F.col("fields").alias("old")), "route_id", "full_outer")
    have = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit("")) != ""
    empty = F.expr("cast(map() AS map<string, string>)")

    def step(state: Column, edit: Column) -> Column:
        new = F.map_from_entries(edit["f"])
        gone = F.lower(F.coalesce(F.try_element_at(new, F.lit("DELETE")), F.lit(""))).isin("1", "true", "yes")
        partial = (F.size(state) > 0) & ~have(new, "PATH") & ~have(new, "CORRIDORS")
        merged = F.when(partial, F.map_concat(F.map_filter(state, lambda k, _: ~F.map_contains_key(new, k)), new)).otherwise(new)
        valid = F.try_element_at(merged, F.lit("DEPART")).rlike(r"^\s*([01]?\d|2[0-3]):[0-5]?\d\s*$") & (have(merged, "PATH") | have(merged, "CORRIDORS"))
        return F.when(gone, empty).when(F.coalesce(valid, F.lit(False)), merged).otherwise(state)

    state = F.aggregate(F.coalesce("edits", F.expr("cast(array() AS array<struct<message_id:bigint,f:array<struct<key:string,value:string>>>>)")), F.coalesce("old", empty), step)
    return both.select("route_id", state.alias("fields")).filter(F.size("fields") > 0)


def routes_from_fields(slots: DataFrame) -> DataFrame:
    """SRC-09: the route table of slots: name, path, corridors, radius_m (50 to 2000, else 100), days and depart."""
    f = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    point = lambda p: F.transform(F.split(F.trim(p), ","), lambda x: F.trim(x).try_cast("double"))
    points = F.filter(F.transform(F.split(f("PATH"), ";"), point), lambda p: (F.size(p) == 2) & p[0].between(-90, 90) & p[1].between(-180, 180))
    labels = F.filter(F.transform(F.split(f("CORRIDORS"), "[|\n]"), F.trim), lambda x: x != "")
    radius = F.coalesce(F.trim(f("RADIUS_M")).try_cast("int"), F.lit(100))
    return slots.select("route_id", F.when(f("NAME") != "", F.trim(f("NAME"))).otherwise(F.concat(F.lit("Route "), F.col("route_id").cast("string"))).alias("name"), F.transform(points, lambda p: F.struct(p[0].alias("lat"), p[1].alias("lng"))).alias("path"), F.array_distinct(F.flatten(F.transform(labels, corridors))).alias("corridors"), F.greatest(F.lit(50), F.least(F.lit(2000), radius)).alias("radius_m"), F.when(f("DAYS") != "", f("DAYS")).otherwise("mon-fri").alias("days"), f("DEPART").alias("depart"))


#: Paths times incidents that a task measures, and rows that a task makes of shapes and incidents, about.
PAIRS_OF_TASK, ROWS_OF_TASK = 50_000, 1_000_000


def _met(inc: DataFrame, routes: DataFrame, last_sweep: str | None, now: str, window_min: int, max_hours: int, radius: float, wide: float, fold_min: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``route_incidents`` says, for each kind of routes: (found, with the column kind; route_id and kind; listings).

    Routes of one path and the same roads have a shape in common; incidents are met with shapes only. Routes of one shape
    and radius are of one kind, and every route of a kind has the same rows.
    """
    t = F.lit(now).cast("timestamp_ntz")
    late = [c for c in ("reported_ts", "first_seen_at", "created_at") if c in inc.columns]
    rows = inc.withColumn("reported_ts", F.coalesce(*[F.col(c).cast("timestamp_ntz") for c in late]))
    if last_sweep is not None:
        stale = F.timestamp_diff("MINUTE", F.lit(last_sweep).cast("timestamp_ntz"), t) > 20
        status = F.when(stale, "unknown").when(F.col("in_feed"), "active").otherwise("cleared")
        listed = F.col("in_feed")
    else:
        slack = F.expr("INTERVAL 6 MINUTES")
        hidden = F.col("last_seen_at").isNull() | (F.coalesce("first_seen_at", "last_seen_at") > t + slack)
        status = F.when(hidden, "unknown").when(F.col("last_seen_at") >= t - slack, "active").otherwise("cleared")
        listed = status == "active"
    rows = rows.withColumn("age", F.timestamp_diff("MINUTE", F.col("reported_ts"), t)).withColumn("status", status)
    rows = rows.filter((F.col("age") >= -5) & (F.col("age") <= max_hours * 60) & ((F.col("age") <= window_min) | listed))
    # The candidates of the last hours are few; they are read and parsed once, and stored for all that follows.
    columns = [c for c in ("incident_number", "location", "cause", "reported", "reported_ts", "latitude", "longitude", "corridors", "severity", "age", "status") if c in rows.columns]
    rows = stored(rows.select(*columns), "candidates")
    if fold_min:
        ep = episodes(rows, fold_min).filter(F.size("extras") > 0).select("incident_number", F.col("extras.incident_number").alias("more"))
        told = ep.select("incident_number", "more", F.lit(False).alias("merged")).unionByName(ep.select(F.explode("more").alias("incident_number"), F.lit(None).cast("array<string>").alias("more"), F.lit(True).alias("merged")))
        rows = rows.join(told, "incident_number", "left")
    else:
        rows = rows.withColumn("more", F.lit(None).cast("array<string>")).withColumn("merged", F.lit(None).cast("boolean"))
    rows = stored(rows.select("incident_number", F.concat(F.array("incident_number"), F.coalesce("more", F.array().cast("array<string>"))).alias("ids"), F.coalesce("merged", F.lit(False)).alias("merged"), "status", "age", "severity", "latitude", "longitude", "corridors"), "incidents")
    alone = rows.filter("NOT merged")
    own = F.coalesce(F.col("radius_m").cast("double"), F.lit(radius)) if "radius_m" in routes.columns else F.lit(radius)
    plan = routes.select("route_id", own.alias("radius"), F.when(F.size("path") >= 2, F.col("path")).alias("path"), "corridors")
    shapes = stored(plan.groupBy("path", "corridors").agg(F.count(F.lit(1)).alias("n")).withColumn("shape", F.monotonically_increasing_id()), "shapes")
    same = F.col("r.path").eqNullSafe(F.col("s.path")) & F.col("r.corridors").eqNullSafe(F.col("s.corridors"))
    of_shape = plan.alias("r").join(shapes.alias("s"), same).select("route_id", "shape", "radius")
    kinds = stored(of_shape.groupBy("shape", "radius").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.monotonically_increasing_id()), "kinds")
    members = stored(of_shape.join(kinds, ["shape", "radius"]).select("route_id", "kind"), "members")
    widest = kinds.agg(F.max("radius")).first()[0] or radius
    shaped = shapes.select(F.col("shape").alias("route_id"), "path", "corridors")
    paths = stored(shaped.filter("path IS NOT NULL").groupBy("path").agg(F.count(F.lit(1)).alias("n")).withColumn("path_id", F.monotonically_increasing_id()), "paths")
    alone = alone.repartition(1 + alone.count() * paths.count() // PAIRS_OF_TASK)
    near = near_path(alone, paths.select(F.col("path_id").alias("route_id"), "path"), max(3 * wide, 3 * widest)).withColumnRenamed("route_id", "path_id")
    near = near.join(shaped.join(paths, "path").select("path_id", "route_id"), "path_id").select("route_id", "incident_number", "metres", "along")
    named = on_route_roads(alone, shaped).withColumn("named", F.lit(True))
    met = near.unionByName(named, allowMissingColumns=True).groupBy("route_id", "incident_number").agg(F.max("metres").alias("metres"), F.max("along").alias("along"), F.max("named").alias("named"))
    met = stored(met, "met")
    total = met.groupBy("route_id").count().join(shapes.select(F.col("shape").alias("route_id"), "n"), "route_id").agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0
    met = met.repartition(1 + total // ROWS_OF_TASK).withColumnRenamed("route_id", "shape")  # each row becomes one for each route of its shape
    met = met.join(alone.select("incident_number", "ids", "status", "age", "severity", F.col("latitude").isNotNull().alias("located")), "incident_number")
    met = met.join(kinds.drop("n").join(shapes.select("shape", F.col("path").isNotNull().alias("has_path")), "shape"), "shape")
    on = F.coalesce("named", F.lit(False))
    side = on & (F.col("metres") <= F.greatest(F.lit(wide), 2 * F.col("radius")))
    match = F.when((F.col("metres") <= F.col("radius")) | side, "path").when(on & ~F.col("has_path"), "road").when(on & ~F.col("located"), "approximate")
    met = met.withColumn("match", match).filter(F.col("match").isNotNull() | on | (F.col("metres") <= F.greatest(F.lit(wide * 3), 3 * F.col("radius"))))
    verdict = F.when(F.col("match").isNull(), "skipped").when(F.col("status") == "cleared", "cleared").otherwise("alert")
    reason = F.when(F.col("match").isNotNull(), "on route").when(F.col("metres").isNotNull(), "too far").otherwise("elsewhere on the road")
    return met.select("kind", "incident_number", "status", "match", verdict.alias("verdict"), reason.alias("reason"), "metres", "along", "age", "severity", "ids"), members, rows


def route_incidents(inc: DataFrame, routes: DataFrame, last_sweep: str | None, now: str, window_min: int = 90, max_hours: int = 12, radius: float = 150.0, wide: float = 400.0, fold_min: int = 0) -> DataFrame:
    """AGG-49: every candidate near a route or on one of its roads, with status, match, verdict and reason.

    ``inc`` has reported_ts (without one, first_seen_at and created_at count), corridors, severity. A candidate was
    reported within ``window_min`` or is still listed within ``max_hours``. Status: active, cleared (left the feed) or
    unknown. With ``last_sweep`` it comes from in_feed, and is unknown when that sweep is older than 20 minutes; without
    it (replay) from first_seen_at and last_seen_at, with six minutes of slack. Within ``fold_min`` minutes the listings
    of one place are one incident: the others get the verdict ``merged``, and ``ids`` names them all.

    Matches: path (within the route's radius_m or ``radius``, or ``wide``, at least twice the radius, if its road is on
    the route), road (no path on the route), approximate (no position but the road). The verdict is alert, cleared,
    skipped or merged. Rows are in no order; ``in_route_order`` gives that of a list.
    """
    found, members, rows = _met(inc, routes, last_sweep, now, window_min, max_hours, radius, wide, fold_min)
    columns = [c for c in found.columns if c != "kind"]
    out = found.join(members, "kind").select("route_id", *columns)
    if fold_min:
        none = [F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns]
        given = {"incident_number": F.col("incident_number"), "verdict": F.lit("merged").alias("verdict"), "reason": F.lit("another listing of an incident").alias("reason")}
        out = out.unionByName(rows.filter("merged").select(*[given.get(c, n) for c, n in zip(out.columns, none, strict=True)]))
    return out


def in_route_order(found: DataFrame) -> DataFrame:
    """AGG-49: by route, what isn't cleared first, then the most severe and the latest."""
    return found.orderBy("route_id", F.col("status") == "cleared", F.desc("severity"), "age", "incident_number")


def _states(found: DataFrame, key: str) -> DataFrame:
    on = F.col("match").isNotNull()
    out = found.groupBy(key).agg(F.count_if(on & (F.col("status") == "active")).alias("active"), F.count_if(on & (F.col("status") == "cleared")).alias("cleared"), F.count_if(F.col("match") == "approximate").alias("approximate"), F.count_if(on & (F.col("status") == "unknown")).alias("unknown"))
    return out.withColumn("state", F.when(F.col("active") > 0, "alert").when(F.col("unknown") > 0, "unverified").otherwise("clear"))


def route_state(found: DataFrame) -> DataFrame:
    """AGG-54: alert, unverified or clear, with counts, of each route."""
    return _states(found.filter("route_id IS NOT NULL"), "route_id")


def route_states(inc: DataFrame, routes: DataFrame, last_sweep: str | None, now: str, window_min: int = 90, max_hours: int = 12, radius: float = 150.0, wide: float = 400.0, fold_min: int = 0) -> DataFrame:
    """AGG-54: ``route_state`` of ``route_incidents``, counted once for all routes of the same path, roads and radius."""
    found, members, _ = _met(inc, routes, last_sweep, now, window_min, max_hours, radius, wide, fold_min)
    states = _states(found, "kind")
    return members.filter("route_id IS NOT NULL").join(states, "kind").select("route_id", *[c for c in states.columns if c != "kind"])


def near_misses(found: DataFrame, radius: float = 150.0) -> DataFrame:
    """AGG-55: candidates off the route but within three times the radius."""
    return found.filter(F.col("match").isNull() & (F.col("metres") <= 3 * radius))


def route_replay(inc: DataFrame, routes: DataFrame, at: str, lead_min: int = 20, radius: float = 150.0, window_min: int = 90, max_hours: int = 12, wide: float = 400.0, fold_min: int = 0) -> DataFrame:
    """AGG-55: one row for each route as it would have been at a moment: whether its day is one of the route's
    (``routes`` has day_numbers and depart_minutes), when the alert would go out, incidents and cleared ones, and up to
    three near misses (nearest first). Routes of the same path, roads and radius are counted once."""
    found, members, _ = _met(inc, routes, None, at, window_min, max_hours, radius, wide, fold_min)
    place = F.row_number().over(Window.partitionBy("kind").orderBy("metres", "incident_number"))
    missed = near_misses(found, radius).withColumn("place", place).filter("place <= 3").groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("place", "incident_number"))).alias("near"))  # at most three
    counts = found.groupBy("kind").agg(F.count_if(F.col("verdict") == "alert").alias("incidents"), F.count_if(F.col("verdict") == "cleared").alias("cleared")).join(missed, "kind", "left")
    counts = members.join(counts, "kind").drop("kind")
    out = routes.select("route_id", F.array_contains("day_numbers", F.weekday(F.lit(at).cast("timestamp_ntz"))).alias("scheduled"), F.greatest(F.lit(0), F.col("depart_minutes") - lead_min).alias("send_minutes")).join(counts, "route_id", "left")
    none = F.array().cast("array<string>")
    return out.select("route_id", "scheduled", "send_minutes", F.coalesce("incidents", F.lit(0)).alias("incidents"), F.coalesce("cleared", F.lit(0)).alias("cleared"), F.coalesce(F.col("near.incident_number"), none).alias("near_misses"))


ROUTES = 100_000  # routes that are broadcast at most
ALERT_STATE = "route_id int, day date, sent_at int, known array<string>, followups int"


def advance_alerts(checks: DataFrame, routes: DataFrame, state: DataFrame, lead_min: int = 20, followup_min: int = 30, most: int = 3) -> DataFrame:
    """STR-09: (route_id, day, sent_at, known, followups, alerts) after the checks of some days, from an earlier state.

    A check (route_id, at, found) lists the incidents on a route at a moment, each with ids and status. The first check
    from ``lead_min`` minutes before departure until departure sends the departure alert and remembers the ids of all it
    found. For ``followup_min`` minutes after it, a check with incidents that aren't cleared and share no id with those
    sends a follow-up, at most ``most`` a day. ``alerts`` has at, kind and ids of what was sent now.
    """
    plan = routes.select("route_id", "day_numbers", "depart_minutes").filter("depart_minutes IS NOT NULL")
    plan = F.broadcast(plan) if plan.limit(ROUTES + 1).count() <= ROUTES else plan
    rows = checks.withColumn("at", F.col("at").cast("timestamp_ntz")).withColumn("day", F.to_date("at")).join(plan, "route_id").filter(F.array_contains("day_numbers", F.weekday("day")))
    rows = rows.withColumn("minute", F.hour("at") * 60 + F.minute("at"))
    days = rows.groupBy("route_id", "day").agg(F.first("depart_minutes").alias("depart"), F.sort_array(F.collect_list(F.struct("at", "minute", "found"))).alias("checks"))  # one day of a route
    days = days.join(state, ["route_id", "day"], "left")
    new = "filter(c.found, x -> x.status <> 'cleared' AND NOT arrays_overlap(x.ids, s.known))"
    go = f"s.sent_at IS NULL AND c.minute >= depart - {lead_min} AND c.minute < depart"
    more = f"s.sent_at IS NOT NULL AND c.minute >= s.sent_at AND c.minute <= s.sent_at + {followup_min} AND s.followups < {most} AND size({new}) > 0"
    ids = "array_sort(array_distinct(flatten(transform({}, x -> x.ids))))"
    step = f"""aggregate(checks, named_struct('sent_at', sent_at, 'known', coalesce(known, cast(array() AS array<string>)), 'followups', coalesce(followups, 0), 'alerts', cast(array() AS array<struct<at:timestamp_ntz,kind:string,ids:array<string>>>)),
      (s, c) -> CASE WHEN {go} THEN named_struct('sent_at', c.minute, 'known', {ids.format('c.found')}, 'followups', 0, 'alerts', array_append(s.alerts, named_struct('at', c.at, 'kind', 'departure', 'ids', {ids.format('c.found')})))
        WHEN {more} THEN named_struct('sent_at', s.sent_at, 'known', array_union(s.known, {ids.format(new)}), 'followups', s.followups + 1, 'alerts', array_append(s.alerts, named_struct('at', c.at, 'kind', 'follow-up', 'ids', {ids.format(new)})))
        ELSE s END)"""
    return days.withColumn("s", F.expr(step)).select("route_id", "day", "s.sent_at", "s.known", "s.followups", "s.alerts")


def route_alerts(checks: DataFrame, routes: DataFrame, **how) -> DataFrame:
    """STR-09 over a history of checks: (route_id, at, kind, ids) of every alert."""
    nothing = checks.sparkSession.createDataFrame([], ALERT_STATE)
    out = advance_alerts(checks, routes, nothing, **how)
    return out.select("route_id", F.explode("alerts").alias("a")).select("route_id", "a.at", "a.kind", "a.ids")
