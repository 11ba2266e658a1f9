"""Routes of the same path, roads and radius are met with the incidents once."""

import datetime as dt

from pyspark.sql import functions as F

from dispatchlake.operators import routes

AT = "2024-01-01 10:00:00"


def tables(spark, n):
    """n routes of eight kinds, and incidents near them, further off, on their roads, without a position and folded."""
    one = lambda k: dt.datetime(2024, 1, 1, 9, 0) + dt.timedelta(minutes=k % 60)
    rows = [(f"I{k}", f"{k % 23} OAK ST", "ACCIDENT MINOR", "", one(k), one(k), one(k + 9), ["OAK ST"] if k % 3 else ["ELM ST"], 50, None if k % 7 == 0 else 30.17, -92.05 + k * 1e-4) for k in range(60)]
    inc = spark.createDataFrame(rows, "incident_number string, location string, cause string, reported string, reported_ts timestamp_ntz, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, corridors array<string>, severity int, latitude double, longitude double")
    no = F.col("id")
    path = F.when(no % 2 == 0, F.array(*[F.struct(F.lit(y).alias("lat"), F.lit(-92.05).alias("lng")) for y in (30.16, 30.22)]))
    road = F.when(no % 8 < 6, F.array(F.when(no % 4 < 2, "OAK ST").otherwise("ELM ST")))
    return inc, spark.range(0, n, 1, 2).select(no.cast("int").alias("route_id"), path.alias("path"), road.alias("corridors"), F.when(no % 8 > 1, 200).alias("radius_m"), F.array(F.lit(0)).alias("day_numbers"), no.cast("int").alias("depart_minutes"))


def test_incidents_are_met_with_shapes_of_routes(spark, monkeypatch):
    kept, write = {}, routes.stored
    monkeypatch.setattr(routes, "stored", lambda df, name: kept.setdefault(name, write(df, name)))
    inc, many = tables(spark, 400)
    found = routes.route_incidents(inc, many, None, AT, fold_min=15)
    assert kept["shapes"].count() == 6 and kept["kinds"].count() == 8 and kept["met"].count() < 300 < 10_000 < found.count()


def test_every_route_has_what_it_has_alone(spark):
    inc, many = tables(spark, 16)
    found = [tuple(r) for r in routes.route_incidents(inc, many, None, AT, fold_min=15).collect()]
    states = {r.route_id: r for r in routes.route_states(inc, many, None, AT, fold_min=15).collect()}
    replays = {r.route_id: r for r in routes.route_replay(inc, many, AT, fold_min=15).collect()}
    assert states == {r.route_id: r for r in routes.route_state(routes.route_incidents(inc, many, None, AT, fold_min=15)).collect()}
    assert len(replays) == 16
    for k in range(8):  # route k + 8 is of the same kind
        alone = many.filter(F.col("route_id") == k)
        own = routes.route_incidents(inc, alone, None, AT, fold_min=15)
        rows = [tuple(r) for r in own.filter("route_id IS NOT NULL").collect()]
        for route in (k, k + 8):
            assert sorted((route, *r[1:]) for r in rows) == sorted(r for r in found if r[0] == route)
            near = sorted((r[6], r[1]) for r in rows if r[3] is None and r[6] is not None and r[6] <= 450)[:3]
            got = replays[route]
            assert (got.incidents, got.cleared, got.near_misses) == (sum(r[4] == "alert" for r in rows), sum(r[4] == "cleared" for r in rows), [x for _, x in near])
