"""Operators on literal rows with results known by hand."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from dispatchlake.functions import causes, roads, sql, times, weather
from dispatchlake.operators import episodes as ep
from dispatchlake.operators import hourly, ingest, roadstats, routes
from dispatchlake.sources import feed, sinks
from dispatchlake.streaming import jobs

ROADS = {
    "3500 AMBASSADOR CAFFERY PKWY": ["AMBASSADOR CAFFERY PKWY"], "4500 AMBASSADOR CAFFERY": ["AMBASSADOR CAFFERY PKWY"], "JOHNSTON ST & JOHNSTON ST": ["JOHNSTON ST"],
    "AMBASSADOR CAFFERY PKWY AT KALISTE SALOOM RD": ["AMBASSADOR CAFFERY PKWY", "KALISTE SALOOM RD"], "I-10 E & MILE MARKER 103": ["I-10"], "600 E BROUSSARD/DUHON RD": ["E BROUSSARD RD", "DUHON RD"],
    "MOSS STREET LAFAYETTE LA": ["MOSS ST"], "LAFAYETTE LA": [], "W SCOTT": [], "US HWY 90 EAST": ["US 90"], "INTERSTATE 10 LAFAYETTE LA": ["I-10"], "100 WEST CONGRESS STREET APT 4": ["W CONGRESS ST"],
    "200-300 BLK OF OAK AVENUE NB": ["OAK AVE"], "": [], "3500": [], "W PINHOOK RD": ["PINHOOK RD"], "LA HWY 182": ["LA 182"],
}


def test_roads(spark):
    df = spark.createDataFrame([(x,) for x in ROADS], "location string")
    assert {r.location: r.corridors for r in roads.with_corridors(df).collect()} == ROADS
    one = spark.createDataFrame([("3142 AMBASSADOR CAFFERY PKWY/CURRAN PKWY",)], "location string")
    assert roads.with_incident_corridors(one).first().corridors == ["AMBASSADOR CAFFERY PKWY"]


def test_reported_times(spark):
    cases = {"11/13/2026 08:32": (2026, 11, 13, 8, 32), "1/2/69 3:04 PM": (2069, 1, 2, 15, 4), "1/2/70 12:00 AM": (1970, 1, 2, 0, 0), "at 01/02/2024": (2024, 1, 2, 0, 0), "2024-03-04 05:06": (2024, 3, 4, 5, 6), "02/30/2024 10:00": None, "N/A": None, "1/2/2024 10:11:59": (2024, 1, 2, 10, 11)}
    df = spark.createDataFrame([(x,) for x in cases], "reported string")
    got = {r.reported: r.reported_ts for r in times.with_reported_ts(df).collect()}
    assert got == {k: v and dt.datetime(*v) for k, v in cases.items()}
    strict = {r.reported: r.reported_ts for r in times.with_reported_ts(df, "strict4").collect()}
    assert strict["1/2/2024 10:11:59"] == dt.datetime(2024, 1, 2, 10, 11, 59) and strict["1/2/69 3:04 PM"] is None
    assert [r.reported for r in times.with_reported_ts(df, "timed").filter("reported_ts IS NULL AND reported = 'at 01/02/2024'").collect()] == ["at 01/02/2024"]


def _listing(rows):
    return [(i, loc, cause, dt.datetime(2024, 1, 1, *t), 30.0 if located else None, -92.0 if located else None) for i, loc, cause, t, located in rows]


KIND = "incident_number string, location string, cause string, reported_ts timestamp_ntz, latitude double, longitude double"


def test_episodes(spark):
    rows = _listing([("A", "X ST", "TRAFFIC ACCIDENT MINOR", (8, 2), True), ("B", "x  st", "HIT AND RUN", (8, 5), True), ("C", "Y", "TRAFFIC ACCIDENT MAJOR", (9, 0), False), ("D", "Y", "TRAFFIC ACCIDENT MINOR", (9, 3), True), ("E", "Z", "STALLED", (8, 0), True), ("F", "Z", "STALLED", (8, 15), True), ("G", "Z", "STALLED", (8, 31), True), ("H", "Z", "TRAFFIC CONTROL", (8, 0), True)])
    out = ep.episodes(spark.createDataFrame(rows, KIND))
    assert {r.incident_number: [x.incident_number for x in r.extras] for r in out.collect()} == {"B": ["A"], "D": ["C"], "E": ["F"], "G": []}
    alone = ep.episodes(spark.createDataFrame(rows[:2], KIND), window_min=0)
    assert alone.count() == 2


def test_control_calls_collapse(spark):
    rows = [(f"I{k}", "100 SCHOOL RD", "TRAFFIC CONTROL", dt.datetime(2026, 1, d, 8), 30.0, -92.0, "") for k, d in enumerate((15, 15, 16))]
    out = ep.collapse_control(spark.createDataFrame(rows, KIND + ", assisting string")).first()
    assert out.n_calls == 3 and [(h.day.day, h.n) for h in out.history] == [(15, 2), (16, 1)]


def test_condition_codes_and_hours(spark):
    cases = [(0.0, 10.0, "", "d"), (0.05, 5.0, "", "r"), (0.42, 2.0, "+RA", "h"), (0.0, 10.0, "-RA", "r"), (0.001, 0.5, "FG", "f"), (None, None, "", "-")]
    df = spark.createDataFrame(cases, "precip_in double, visibility_mi double, wx string, want string")
    assert weather.with_condition_code(df).filter("code <> want").count() == 0
    rows = [("2026-11-12 00:53", "70", "0", "10", "5", ""), ("2026-11-12 01:20", "68", "0.05", "5", "8", "-RA"), ("2026-11-12 01:53", "67", "0.42", "2.0", "10", "+RA"), ("2026-11-12 02:53", "66", "T", "0.50", "M", "FG"), ("2026-11-12 03:53", "M", "M", "M", "M", "M")]
    obs = feed.parse_station_csv(spark.createDataFrame(rows, "valid string, tmpf string, p01i string, vsby string, sknt string, wxcodes string"))
    merged = {r.hour.hour: r for r in hourly.merge_hours(obs).collect()}
    assert (merged[1].precip_in, merged[1].visibility_mi, merged[1].temp_f, merged[1].wx) == (0.42, 2.0, 67.0, "+RA -RA")
    few = spark.createDataFrame([(dt.datetime(2026, 11, 12, 0), 0.0, 10.0, ""), (dt.datetime(2026, 11, 12, 1), 0.42, 2.0, ""), (dt.datetime(2026, 11, 12, 4), 0.0, 10.0, "")], "hour timestamp_ntz, precip_in double, visibility_mi double, wx string")
    assert hourly.export_weather_hours(few).first() == ("2026-11-12T00", "dh--d")


def test_holidays_and_school_days(spark):
    days = {"2021-07-05": (True, False), "2021-12-24": (True, False), "2024-11-28": (True, True), "2024-11-29": (False, True), "2023-11-24": (False, False), "2024-05-27": (True, True), "2024-09-03": (False, True), "2024-08-14": (False, False)}
    df = spark.createDataFrame([(d,) for d in days], "d string").withColumn("t", F.col("d").cast("timestamp_ntz"))
    got = {r.d: (r.h, r.s) for r in df.select("d", times.holiday(F.col("t")).alias("h"), times.school_day(F.col("t")).alias("s")).collect()}
    assert got == days
    cal = {(r.event, str(r.date)) for r in times.event_calendar(spark, 2024, 2025).collect()}
    assert {("Easter", "2024-03-31"), ("Easter", "2025-04-20"), ("Mardi Gras", "2025-03-04")} <= cal


def test_road_stats(spark):
    seg = "route_id string, from_mi double, to_mi double, full_name string"
    cnt = "route_id string, from_mi double, to_mi double, aadt double"
    roads_ = spark.createDataFrame([("055_R1_1_1_010", 0.0, 2.0, "Oak Street"), ("055_R1_2_1_010", 0.0, 1.9, "Oak Street"), ("055_R2_1_1_010", 0.0, 1.0, "Elm Street"), ("055_R3_1_A_010", 0.0, 1.0, "Ramp Rd"), ("055_R4_1_1_010", 0.0, 1.0, "Proposed Rd")], seg)
    counts = spark.createDataFrame([("055_R1_1_1_010", 0.0, 1.0, 40000.0), ("055_R1_1_1_010", 1.0, 2.0, 20000.0), ("055_R2_1_1_010", 0.0, 0.2, 9000.0)], cnt)
    assert {r.road: (r.miles, r.vehicle_miles) for r in roadstats.road_stats(roads_, counts).collect()} == {"OAK ST": (2.0, 60000.0), "ELM ST": (1.0, 0.0)}


def test_budget(spark):
    rows = [(dt.datetime(2024, 1, 1, 12),)] * 60
    b = lambda want, n: tuple(ingest.budget(spark.createDataFrame(rows * n, "requested_at timestamp_ntz"), "2024-01-01 13:00:00", 75, want).first())
    assert b(30, 1) == (60, 15, 15) and b(30, 2) == (120, 0, 0)


def test_agencies_and_groups(spark):
    df = spark.createDataFrame([("lpd acadian",), (None,), ("FIRE SHERIFF",)], "assisting string")
    assert [(r.agency_mask, r.agencies) for r in causes.with_agencies(df).collect()] == [(9, ["police", "ems"]), (16, []), (6, ["sheriff", "fire"])]


def test_snapshots(spark):
    table = "<table><tr><th>Location</th></tr><tr><td> A ST </td><td>FIRE</td><td>1/1/2024 1:00</td><td>POLICE <b>FIRE</b></td></tr><tr><td>x</td></tr></table>"
    rows = [("2024-01-01 00:00:00", json.dumps({"success": True, "data": table})), ("2024-01-01 00:05:00", json.dumps({"success": False, "data": table})), ("2024-01-01 00:10:00", "broken")]
    out = feed.parse_snapshots(spark.createDataFrame(rows, "sweep_ts string, payload string")).collect()
    assert [(r.location, r.cause, r.assisting) for r in out] == [("A ST", "FIRE", "POLICE FIRE")]


def test_forecast_and_alerts(spark):
    grid = json.dumps({"properties": {"temperature": {"uom": "wmoUnit:degC", "values": [{"validTime": "2024-01-01T00:00:00+00:00/PT2H", "value": 10.0}, {"validTime": "2024-01-01T02:00:00+00:00/P1DT1H", "value": 12.0}]}}})
    got = feed.explode_forecast(spark.createDataFrame([(grid,)], "payload string")).collect()
    assert [(r.variable, (r.end - r.start).total_seconds() / 3600, r.value) for r in got] == [("temperature", 2, 10.0), ("temperature", 25, 12.0)]
    alerts = json.dumps({"features": [{"properties": {"event": "Flash Flood Warning"}}, {"properties": {"event": "Heat Advisory"}}]})
    r = feed.summarise_alerts(spark.createDataFrame([(alerts,), ("{}",)], "payload string")).collect()
    assert (r[0].nws_flash_flood_warning, r[0].nws_tornado_watch, r[0].nws_active_alert_count) == (True, False, 2) and r[1].nws_active_alert_count == 0


def test_sinks(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    path = f"{tmp_path}/t"
    assert sinks.write_if_changed(df, path) and not sinks.write_if_changed(df.orderBy(F.desc("id")), path) and sinks.write_if_changed(df.limit(4), path)
    rows = spark.createDataFrame([("A", "  ", "nan"), ("B", "X ST", "30.1")], "incident_number string, location string, latitude string")
    rows.write.option("header", True).csv(f"{tmp_path}/c")
    got = {r.incident_number: (r.location, r.latitude, r.cause) for r in feed.read_archive_csv(spark, f"{tmp_path}/c").collect()}
    assert got == {"A": (None, None, None), "B": ("X ST", 30.1, None)}
    sinks.append_archive(rows, f"{tmp_path}/a")
    assert feed.read_archive(spark, f"{tmp_path}/a").count() == 2


@pytest.mark.parametrize("files", [1, 3])
def test_streams_equal_batch(spark, tmp_path, files):
    """The final state doesn't depend on how the rows are cut into batches."""
    import os

    rows = [(f"I{k % 5}", dt.datetime(2024, 1, 1, 0, 5 * (k // 5)), "POLICE" if k < 8 else "POLICE FIRE") for k in range(15)]
    kind = "incident_number string, sweep_ts timestamp, assisting string"
    for n in range(files):
        spark.createDataFrame(rows[n * 15 // files : (n + 1) * 15 // files], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for n, p in enumerate(sorted((p for p in os.scandir(f"{tmp_path}/in") if p.name.endswith("parquet")), key=lambda p: p.stat().st_mtime)):
        os.utime(p.path, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = jobs.track_observations(stream).writeStream.outputMode("update").format("memory").queryName(f"seen{files}").start()
    q.processAllAvailable()
    q.stop()
    last = spark.table(f"seen{files}").groupBy("incident_number").agg(F.max("observation_count").alias("n"))
    batch = ingest.track_sightings(spark.createDataFrame(rows, kind)).select("incident_number", F.col("observation_count").alias("n"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))


def test_every_query_without_the_corpus_part_is_registered():
    from dispatchlake import registry

    assert len(registry.QUERIES) > 100 and set(registry.ORACLES) <= set(registry.QUERIES)


def _route_rows(spark):
    kind = "incident_number string, location string, reported_ts timestamp_ntz, in_feed boolean, corridors array<string>, severity int, latitude double, longitude double"
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [
        ("A", "x", at(9, 30), True, ["OAK ST"], 70, 30.17, -92.05), ("B", "x", at(9, 40), False, ["ELM ST"], 50, 30.18, -92.0502), ("C", "x", at(9, 50), True, ["OAK ST"], 50, 30.18, -92.0525),
        ("D", "x", at(9, 55), True, ["OAK ST"], 50, None, None), ("E", "x", at(7, 0), True, ["OAK ST"], 50, 30.16, -92.05), ("F", "x", at(7, 0), False, ["OAK ST"], 50, 30.16, -92.05), ("G", "x", at(9, 50), True, ["ELM ST"], 50, 30.18, -92.0535),
    ]
    return spark.createDataFrame(rows, kind)


def test_route_incidents(spark):
    routes_df = spark.sql("SELECT 1 AS route_id, array(named_struct('lat', 30.16D, 'lng', -92.05D), named_struct('lat', 30.22D, 'lng', -92.05D)) AS path, array('OAK ST') AS corridors")
    found = routes.route_incidents(_route_rows(spark), routes_df, "2024-01-01 09:58:00", "2024-01-01 10:00:00")
    got = {r.incident_number: (r.status, r.match) for r in found.collect()}
    assert got == {"A": ("active", "path"), "B": ("cleared", "path"), "C": ("active", "path"), "D": ("active", "approximate"), "E": ("active", "path"), "G": ("active", None)}
    state = routes.route_state(found).first()
    assert (state.state, state.active, state.cleared, state.approximate) == ("alert", 4, 1, 1)
    assert [r.incident_number for r in routes.near_misses(found).collect()] == ["G"]
    late = routes.route_incidents(_route_rows(spark), routes_df, "2024-01-01 09:00:00", "2024-01-01 10:00:00")
    assert {r.status for r in late.collect()} == {"unknown"}


def test_route_schedule_and_overrides(spark):
    df = spark.createDataFrame([(1, "mon-fri", "7:30"), (2, "fri-mon", "25:00"), (3, "daily", None), (4, "Sat, wed", "0:05"), (5, "weekends", "x")], "route_id int, days string, depart string")
    got = {r.route_id: (r.day_numbers, r.depart_minutes) for r in routes.with_route_schedule(df).collect()}
    assert got == {1: ([0, 1, 2, 3, 4], 450), 2: ([0, 4, 5, 6], None), 3: (list(range(7)), None), 4: ([2, 5], 5), 5: ([5, 6], None)}
    base = spark.sql("SELECT 1 AS route_id, 'a' AS name, array(named_struct('lat', 1D, 'lng', 2D), named_struct('lat', 1D, 'lng', 3D)) AS path, cast(null AS array<string>) AS corridors UNION ALL SELECT 2, 'gone', null, null")
    over = spark.sql("SELECT 1 AS route_id, 'b' AS name, cast(null AS array<struct<lat:double,lng:double>>) AS path, cast(null AS array<string>) AS corridors")
    out = routes.effective_routes(base, over).collect()
    assert [(r.route_id, r.name, len(r.path)) for r in out] == [(1, "b", 2)]


def test_sql_functions(spark):
    sql.register(spark)
    df = spark.sql("SELECT content_key('a  b', 'c', null) AS k, condition_code(0.5D, null, '') AS c, cause_severity('hit & run') AS s, location_key(' x ') AS l")
    assert tuple(df.first()) == ("A B|C|", "h", 80, "X")
    assert "Python" not in df._jdf.queryExecution().toString()


def test_sql_times_and_distances_equal_the_columns(spark):
    from dispatchlake.functions import geo, times

    sql.register(spark)
    texts = ["1/2/2024", "01/02/24 3:04 pm", "x 1/2/2024 13:04:05 y", "1/2/2024 13:04 PM", "2024-1-2", "2024-01-02T03:04", "2024-13-02", "1/2/70 00:00", "02/30/2024 1:00", "a|b 1/2/2024", None, "", "1/2/2024 12:30 am", "N/A"]
    df = spark.createDataFrame([(t, 30.0 + k / 100, -92.0, 30.0, -92.0, 30.05 if k % 2 else 30.0, -91.98 if k % 2 else -92.0) for k, t in enumerate(texts)], "t string, lat double, lon double, a double, b double, c double, d double")
    out = df.select("t", F.expr("reported_ts(t)").alias("x"), times.reported_ts(F.col("t")).alias("y"), F.expr("seg_dist_m(lat, lon, a, b, c, d)").alias("m"), geo.seg_dist_m(*map(F.col, ("lat", "lon", "a", "b", "c", "d")))[0].alias("n")).collect()
    assert [(r.t, r.x) for r in out] == [(r.t, r.y) for r in out] and sum(r.x is not None for r in out) == 8
    assert all(abs(r.m - r.n) < 1e-6 for r in out)


def test_simplified_paths_and_typed_roads(spark):
    from dispatchlake.operators.export import resolve_road, simplify_paths

    path = [(30.0, -92.0), (30.001, -92.00001), (30.002, -92.0), (30.002, -91.99)]
    df = spark.createDataFrame([(1, [{"lat": a, "lng": o} for a, o in path]), (2, None)], "path_id int, path array<struct<lat:double,lng:double>>")
    got = {r.path_id: r.path for r in simplify_paths(df).collect()}
    assert [(p.lat, p.lng) for p in got[1]] == [path[0], path[2], path[3]] and got[2] is None
    known = spark.createDataFrame([("JOHNSTON ST",), ("JOHNSON RD",), ("KALISTE SALOOM RD",)], "road string")
    typed = spark.createDataFrame([("john",), ("Johnston Street",), ("nowhere",)], "typed string")
    assert {r.typed: r.road for r in resolve_road(typed, known).collect()} == {"john": "JOHNSON RD", "Johnston Street": "JOHNSTON ST", "nowhere": None}
