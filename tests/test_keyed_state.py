"""Jobs on keyed state equal their batch twins for one and several files, over restarts, and forget what is over."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from dispatchlake import registry
from dispatchlake.operators import ingest, panels, routes
from dispatchlake.streaming import jobs, stateful
from dispatchlake.streaming.state import failure_state

T0 = dt.datetime(2024, 1, 1, 6, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def put(spark, tmp_path, parts, kind, start=0):
    """One file for each part, in order of time."""
    os.makedirs(f"{tmp_path}/in", exist_ok=True)
    for n, rows in enumerate(parts, start):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/p{n}")
        (one,) = [p for p in os.scandir(f"{tmp_path}/p{n}") if p.name.endswith("parquet")]
        os.rename(one.path, f"{tmp_path}/in/{n}.parquet")
        os.utime(f"{tmp_path}/in/{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))


def stream(spark, tmp_path, kind):
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def cut(rows, files, same=lambda a, b: False):
    """Rows in so many parts; rows that are the ``same`` stay together."""
    bounds = [n * len(rows) // files for n in range(files + 1)]
    for k in range(1, files):
        while 0 < bounds[k] < len(rows) and same(rows[bounds[k] - 1], rows[bounds[k]]):
            bounds[k] += 1
    return [rows[a:b] for a, b in zip(bounds, bounds[1:], strict=False) if rows[a:b]]


LISTING = "incident_number string, sweep_ts timestamp_ntz, assisting string"
SWEEPS = [("A", at(0), "POLICE"), ("B", at(0), ""), ("A", at(5), "POLICE FIRE DEPT"), ("C", at(5), "SHERIFF"), ("A", at(10), "POLICE"), ("C", at(10), "SHERIFF"), ("C", at(10), "SHERIFF"), ("B", at(15), "FIRE"), ("C", at(15), "SHERIFF POLICE"), ("C", at(20), ""), (None, at(20), "FIRE"), ("A", at(40), "SHERIFF"), ("A", at(45), None), ("Z", at(60), "")]


@pytest.mark.parametrize("files", [1, 4])
def test_presence_and_agencies(spark, tmp_path, files):
    put(spark, tmp_path, cut(SWEEPS, files, lambda a, b: a[1] == b[1]), LISTING)
    table = spark.createDataFrame(SWEEPS, LISTING)
    got = stateful.drain(stateful.presence(stream(spark, tmp_path, LISTING)), f"{tmp_path}/out", f"{tmp_path}/check")
    assert rows_of(got) == rows_of(ingest.presence_events(table)) and got.filter("event = 'left'").count() == 6
    a = sorted((r.at, r.event, r.observation_count) for r in got.collect() if r.incident_number == "A")
    assert a == [(at(0), "appeared", 1), (at(15), "left", 3), (at(40), "appeared", 4), (at(50), "left", 5)]
    log = stateful.drain(stateful.agency_log(stream(spark, tmp_path, LISTING)), f"{tmp_path}/log", f"{tmp_path}/check2")
    assert rows_of(log) == rows_of(ingest.accumulate_agencies(table)) and ("A", "sheriff", at(40)) in rows_of(log)


def test_a_leave_at_the_newest_sweep_is_open(spark, tmp_path):
    """A timer that the watermark has just reached isn't due: the sweep of that moment may still list the incident."""
    rows = [("A", at(0), ""), ("B", at(0), ""), ("B", at(5), ""), ("C", at(10), "")]
    put(spark, tmp_path, [rows], LISTING)
    got = stateful.drain(stateful.presence(stream(spark, tmp_path, LISTING)), f"{tmp_path}/out", f"{tmp_path}/check")
    assert rows_of(got) == rows_of(ingest.presence_events(spark.createDataFrame(rows, LISTING)))
    assert [r.incident_number for r in got.filter("event = 'left'").collect()] == ["A"]  # B would leave at the newest sweep
    put(spark, tmp_path, [[("C", at(15), "")]], LISTING, 1)
    got = stateful.drain(stateful.presence(stream(spark, tmp_path, LISTING)), f"{tmp_path}/out", f"{tmp_path}/check")
    assert sorted((r.incident_number, r.at) for r in got.filter("event = 'left'").collect()) == [("A", at(5)), ("B", at(10))]


def test_presence_by_buckets_equals_that_by_incidents(spark, tmp_path):
    """Many incidents in a few keys of the state, over restarts: those that stay, leave, return, are listed twice or never named."""
    rows = sorted(((f"I{k}" if k else None, at(5 * n), "") for k in range(40) for n in range(60) if (k * 7 + n * n) % 11 % (2 + k % 5) == 0), key=lambda r: r[1])
    rows = [*rows[:50], *rows[30:50], ("I1", None, ""), (None, None, ""), *rows[50:]]
    table = spark.createDataFrame(rows, LISTING).filter("sweep_ts IS NOT NULL")
    want = rows_of(ingest.presence_events(table))
    job = lambda buckets: stateful.presence(stream(spark, tmp_path, LISTING), buckets=buckets)
    for n, part in enumerate(cut(rows, 3, lambda a, b: a[1] == b[1] or None in (a[1], b[1]) or b[1] < a[1])):
        put(spark, tmp_path, [part], LISTING, n)
        got = stateful.drain(job(3), f"{tmp_path}/out", f"{tmp_path}/check")
    assert rows_of(got) == want and len(want) > 500 and got.filter("incident_number IS NULL").count() > 5
    state = spark.read.format("statestore").option("stateVarName", "state").load(f"{tmp_path}/check")
    assert state.count() <= 3 and sorted(n or "" for r in state.collect() for n in json.loads(r.value.incidents)) == sorted({n or "" for n, _, _ in rows})
    assert rows_of(stateful.drain(job(None), f"{tmp_path}/out1", f"{tmp_path}/check1")) == want


def test_presence_of_a_bucket_forgets_each_incident_at_its_time(spark, tmp_path):
    """All incidents share a bucket: one goes on over the time of another, which is forgotten and appears as a new one."""
    job = lambda: stateful.presence(stream(spark, tmp_path, LISTING), keep_days=2, buckets=1)
    parts = [[("A", at(0), ""), ("B", at(0), "")], [("A", at(DAY), ""), ("A", at(DAY + 5), "")], [("C", at(2 * DAY + 5), "")], [("B", at(2 * DAY + 10), ""), ("A", at(2 * DAY + 10), "")], [("C", at(9 * DAY), "")], [("A", at(9 * DAY + 5), ""), ("C", at(9 * DAY + 5), "")]]
    seen = []
    for n, part in enumerate(parts):  # a restart for each file
        put(spark, tmp_path, [part], LISTING, n)
        got = stateful.drain(job(), f"{tmp_path}/out", f"{tmp_path}/check")
        seen.append({x for r in spark.read.format("statestore").option("stateVarName", "state").load(f"{tmp_path}/check").collect() for x in json.loads(r.value.incidents)})
    assert seen == [{"A", "B"}, {"A", "B"}, {"A", "C"}, {"A", "B", "C"}, {"C"}, {"A", "C"}]
    events = {x: [(r.event, r.at, r.first_seen_at, r.observation_count) for r in got.orderBy("at").collect() if r.incident_number == x] for x in "AB"}
    assert events["A"] == [("appeared", at(0), at(0), 1), ("left", at(5), at(0), 1), ("appeared", at(DAY), at(0), 2), ("left", at(DAY + 10), at(0), 3), ("appeared", at(2 * DAY + 10), at(0), 4), ("left", at(2 * DAY + 15), at(0), 4), ("appeared", at(9 * DAY + 5), at(9 * DAY + 5), 1)]
    assert events["B"] == [("appeared", at(0), at(0), 1), ("left", at(5), at(0), 1), ("appeared", at(2 * DAY + 10), at(2 * DAY + 10), 1), ("left", at(2 * DAY + 15), at(2 * DAY + 10), 1)]


def test_the_query_keeps_presence_in_buckets(spark, tmp_path, monkeypatch):
    """The keys of its state don't grow with the incidents."""
    seen, drain = [], stateful.drain
    monkeypatch.setattr(stateful, "PRESENCE_BUCKETS", 2)
    monkeypatch.setattr(stateful, "drain", lambda out, path, check, mode: seen.append(check) or drain(out, path, check, mode))
    rows = spark.range(60).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 100).cast("timestamp_ntz").alias("ts"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    assert registry.QUERIES["str_02_presence"](spark, str(tmp_path)).filter("event = 'appeared'").count() == 60
    assert spark.read.format("statestore").option("stateVarName", "state").load(seen[0]).count() == 2


@pytest.mark.parametrize("buckets", [None, 2])
def test_presence_of_incidents_without_a_time(spark, tmp_path, buckets):
    """They appear once, without a time; for others such a sighting says nothing, before or after they are known."""
    parts = [[("A", at(0), ""), ("A", None, ""), ("B", None, ""), ("B", None, ""), ("C", None, ""), (None, None, "")], [("A", None, ""), ("C", at(10), "")]]
    put(spark, tmp_path, parts, LISTING)
    got = stateful.drain(stateful.presence(stream(spark, tmp_path, LISTING), buckets=buckets), f"{tmp_path}/out", f"{tmp_path}/check")
    bare = [(x, "appeared", None, None, None, 1) for x in ("B", "C", None)]
    assert rows_of(got) == sorted([*bare, ("A", "appeared", at(0), at(0), at(0), 1), ("A", "left", at(5), at(0), at(0), 1), ("C", "appeared", at(10), at(10), at(10), 1)], key=str)


def test_presence_of_years_that_pandas_cannot_hold(spark, tmp_path):
    rows = [("A", at(0), ""), ("B", dt.datetime(3000, 1, 1), ""), ("B", dt.datetime(3000, 1, 2), "")]
    put(spark, tmp_path, [rows], LISTING)
    got = stateful.drain(stateful.presence(stream(spark, tmp_path, LISTING)), f"{tmp_path}/out", f"{tmp_path}/check")
    assert [(r.event, r.at) for r in got.filter("incident_number = 'B'").orderBy("at").collect()] == [("appeared", dt.datetime(3000, 1, 1)), ("left", dt.datetime(3000, 1, 1, 0, 5)), ("appeared", dt.datetime(3000, 1, 2))]


def test_presence_goes_on_after_a_restart_and_forgets(spark, tmp_path):
    parts = cut(SWEEPS, 4, lambda a, b: a[1] == b[1])
    job = lambda: stateful.presence(stream(spark, tmp_path, LISTING), keep_days=1)
    for n, part in enumerate(parts):  # a new query from the checkpoint for each file
        put(spark, tmp_path, [part], LISTING, n)
        got = stateful.drain(job(), f"{tmp_path}/out", f"{tmp_path}/check")
    assert rows_of(got) == rows_of(ingest.presence_events(spark.createDataFrame(SWEEPS, LISTING)))
    put(spark, tmp_path, [[("Y", at(3 * 1440), "")], [("A", at(3 * 1440 + 5), "")], [("Y", at(3 * 1440 + 60), "")]], LISTING, len(parts))
    got = stateful.drain(job(), f"{tmp_path}/out", f"{tmp_path}/check")
    again = [r for r in got.collect() if r.incident_number == "A" and r.at == at(3 * 1440 + 5)]
    assert [(r.event, r.observation_count, r.first_seen_at) for r in again] == [("appeared", 1, at(3 * 1440 + 5))]
    state = spark.read.format("statestore").option("stateVarName", "state").load(f"{tmp_path}/check")
    assert {r.key.incident_number for r in state.collect()} == {"A", "Y"}


DAY = 24 * 60
TRIES = [("X", at(0), False), ("Y", at(1), False), ("X", at(DAY), False), ("Y", at(DAY), True), ("Z", at(DAY), False), (None, at(DAY + 1), False), ("X", at(2 * DAY), False), ("Z", at(9 * DAY), False), ("X", at(9 * DAY), False), ("X", at(9 * DAY), False), ("Y", at(9 * DAY), False)]
TRY = "location_key string, at timestamp_ntz, ok boolean"


@pytest.mark.parametrize("files", [1, 3])
def test_negative_cache(spark, tmp_path, files):
    put(spark, tmp_path, cut(TRIES, files), TRY)
    job = lambda: stateful.negative_cache(stream(spark, tmp_path, TRY))
    got = stateful.latest(stateful.drain(job(), f"{tmp_path}/out", f"{tmp_path}/check", "update"), ["location_key"]).filter("attempts > 0")
    assert rows_of(got) == rows_of(failure_state(spark.createDataFrame(TRIES, TRY), "2024-01-10 06:00:00")) == [("X", 5, at(9 * DAY)), ("Y", 1, at(9 * DAY)), ("Z", 1, at(9 * DAY))]
    # an address without input goes when the time has come, and only then
    put(spark, tmp_path, [[("W", at(16 * DAY - 1), True)]], TRY, 10)
    assert stateful.latest(stateful.drain(job(), f"{tmp_path}/out", f"{tmp_path}/check", "update"), ["location_key"]).filter("attempts > 0").count() == 3
    put(spark, tmp_path, [[("W", at(16 * DAY + 1), True)]], TRY, 11)
    assert stateful.latest(stateful.drain(job(), f"{tmp_path}/out", f"{tmp_path}/check", "update"), ["location_key"]).filter("attempts > 0").count() == 0
    assert spark.read.format("statestore").option("stateVarName", "state").load(f"{tmp_path}/check").count() == 0


def test_a_failure_counts_to_the_end_of_its_last_moment(spark, tmp_path):
    rows = [("X", at(0), False), ("Y", at(1), False), ("Z", at(7 * DAY), False)]
    put(spark, tmp_path, [rows], TRY)
    got = stateful.latest(stateful.drain(stateful.negative_cache(stream(spark, tmp_path, TRY)), f"{tmp_path}/out", f"{tmp_path}/check", "update"), ["location_key"]).filter("attempts > 0")
    assert rows_of(got) == rows_of(failure_state(spark.createDataFrame(rows, TRY), "2024-01-08 06:00:00")) and got.count() == 3


def test_negative_cache_with_the_stores_own_lifetime(spark, tmp_path):
    put(spark, tmp_path, [TRIES], TRY)
    stateful.use_keyed_state(spark)
    out = stateful.negative_cache(stream(spark, tmp_path, TRY), clock="wall")
    q = out.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")).option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="1 second").start()
    until = time.time() + 60  # such a job goes on by the clock
    while q.isActive and not os.path.exists(f"{tmp_path}/out/batch=0/_SUCCESS") and time.time() < until:
        time.sleep(0.5)
    q.stop()
    got = spark.read.parquet(f"{tmp_path}/out").filter("batch = 0 AND attempts > 0 AND location_key IS NOT NULL").drop("batch")
    assert rows_of(got) == [("X", 5, at(9 * DAY)), ("Y", 1, at(9 * DAY)), ("Z", 1, at(9 * DAY))]


CHECK = "route_id int, at timestamp_ntz, found array<struct<ids:array<string>,status:string>>"


def checks():
    rows = [(1, at(5 * k), [([f"I{k // 2}"], "active" if k % 5 else "cleared")]) for k in range(24)]
    rows += [(1, at(DAY + 5 * k), [([f"J{k}"], "unknown")]) for k in range(12)]
    rows += [(2, at(18 * 60 - 30 + 5 * k), [([f"K{k}", "K"], "active"), ([f"L{k}"], "active" if k % 2 else "cleared")]) for k in range(20)]  # over midnight
    rows += [(3, at(5 * k), [([f"M{k}"], "active")]) for k in range(8)] + [(9, at(0), [(["N"], "active")])]
    return sorted(rows, key=lambda r: (r[1], r[0]))


PLAN = [(1, [0, 1, 2, 3, 4], 390), (2, [0], 1435), (3, [5, 6], 380), (4, [0], 380)]


@pytest.mark.parametrize("files", [1, 5])
def test_route_alerts(spark, tmp_path, files):
    rows, plan = checks(), spark.createDataFrame(PLAN, "route_id int, day_numbers array<int>, depart_minutes int")
    for n, part in enumerate(cut(rows, files)):  # restarts between departure and follow-up
        put(spark, tmp_path, [part], CHECK, n)
        got = stateful.drain(stateful.route_alert_stream(stream(spark, tmp_path, CHECK), plan), f"{tmp_path}/out", f"{tmp_path}/check")
    assert rows_of(got) == rows_of(routes.route_alerts(spark.createDataFrame(rows, CHECK), plan))
    kinds = [(r.route_id, r.kind) for r in got.collect()]
    assert kinds.count((1, "departure")) == 2 and kinds.count((2, "departure")) == 1 and kinds.count((1, "follow-up")) == 6 and not [k for k in kinds if k[0] > 2]


INC = "incident_number string, cause string, assisting string, created_at timestamp, latitude double, longitude double, geocode_attempts int, weather_precip_prob double, weather_precip_in double, nws_flash_flood_warning boolean, nws_severe_thunderstorm_warning boolean, nws_tornado_watch boolean, folded boolean, corridors array<string>, reported_ts timestamp"


@pytest.mark.parametrize("files", [1, 3])
def test_rolling_digest(spark, tmp_path, files):
    rows = [(f"I{k}", ["ACCIDENT MINOR", "STALLED VEHICLE", None][k % 3], ["POLICE FIRE", None][k % 2], at(37 * k), 30.0 if k % 4 else None, -92.0, k % 5, 10.0 * (k % 4), None if k % 3 else 0.2, k % 6 == 0, None, k % 7 == 0, [True, False, None][k % 3], [["A ST"], ["A ST", "B ST"], []][k % 3], at(37 * k)) for k in range(150)]
    parts = [*cut(rows, files), [("END", "X", "", at(40_000), None, None, 0, None, None, None, None, None, None, [], None)]]
    put(spark, tmp_path, parts, INC)
    df = lambda: stream(spark, tmp_path, INC)
    got = {r.until: r for r in stateful.drain(jobs.rolling_digest(df()), f"{tmp_path}/d", f"{tmp_path}/c1").collect()}
    roads = jobs.top_roads(stateful.drain(jobs.rolling_roads(df()), f"{tmp_path}/r", f"{tmp_path}/c2")).orderBy("rank").collect()
    used = {r.until: r for r in stateful.drain(jobs.rolling_budget(df().select(F.col("created_at").alias("requested_at")), cap=30), f"{tmp_path}/b", f"{tmp_path}/c3").collect()}
    assert len(got) == len({r[3].replace(minute=0) + dt.timedelta(hours=h) for r in rows for h in range(1, 49)})
    table = spark.createDataFrame(rows, INC)
    folded = table.filter("folded").select("incident_number")
    for hours in (1, 24, 30, 60, 92, 120):
        end = T0 + dt.timedelta(hours=hours)
        want = panels.digest(table.drop("folded"), str(end), folded).first().asDict()
        assert {k: v for k, v in want.items() if k != "archive_total"} == {k: v for k, v in got[end].asDict().items() if k != "until"}
        assert [tuple(r) for r in panels.digest_roads(table, str(end)).collect()] == [(r.road, r.n) for r in roads if r.until == end]
        n = sum(end - dt.timedelta(hours=24) <= r[3] < end for r in rows)
        assert (used[end].used, used[end].left) == (n, max(0, 30 - n)) if n else end not in used


def test_agency_log_keeps_incidents_in_buckets(spark, tmp_path):
    """One state row for each bucket, so that its price doesn't grow with the incidents; the log is that of the batch twin."""
    names = ["POLICE", "POLICE FIRE", "", None, "SHERIFF", "EMS POLICE", "FIRE SHERIFF MEDIC"]
    rows = sorted(((f"I{k % 120}", at(5 * (k // 100)), names[k * 7 % 11 % 7]) for k in range(1500)), key=lambda r: r[1])
    rows += [(None, at(80), "FIRE"), (None, at(80), ""), ("I1", None, "EMS"), (None, at(85), "FIRE POLICE"), (None, at(85), "LPSO")]
    put(spark, tmp_path, cut(rows, 3, lambda a, b: a[1] == b[1] or a[1] is None), LISTING)
    log = stateful.drain(stateful.agency_log(stream(spark, tmp_path, LISTING), buckets=7), f"{tmp_path}/log", f"{tmp_path}/check")
    table = spark.createDataFrame(rows, LISTING).filter("sweep_ts IS NOT NULL").fillna("I none", "incident_number")  # null is an incident here, the twin's join drops it
    want = rows_of(ingest.accumulate_agencies(table))
    assert rows_of(log.fillna("I none", "incident_number")) == want and len(want) > 200 and ("I none", "sheriff", at(85)) in want
    state = spark.read.format("statestore").option("stateVarName", "state").load(f"{tmp_path}/check")
    assert state.count() <= 7 and sorted(n or "" for r in state.collect() for n in r.value.incidents) == sorted({n or "" for n, _, _ in rows})


def test_agency_log_of_a_bucket_forgets_each_incident_at_its_time(spark, tmp_path):
    """All incidents share a bucket: one goes on over the time of another, which ends and starts anew."""
    job = lambda: stateful.agency_log(stream(spark, tmp_path, LISTING), keep_days=2, buckets=1)
    known = lambda: {n for r in spark.read.format("statestore").option("stateVarName", "state").load(f"{tmp_path}/check").collect() for n in r.value.incidents}
    parts = [[("A", at(0), "POLICE"), ("B", at(0), "POLICE")], [("A", at(DAY), "POLICE FIRE")], [("C", at(2 * DAY), "")], [("A", at(3 * DAY), "EMS")], [("C", at(3 * DAY + 60), "FIRE")], [("B", at(4 * DAY), "FIRE"), ("A", at(4 * DAY), "FIRE")], [("B", at(4 * DAY + 5), "POLICE")], [("Z", at(9 * DAY), "")]]
    seen = []
    for n, part in enumerate(parts):  # a restart for each file
        put(spark, tmp_path, [part], LISTING, n)
        log = stateful.drain(job(), f"{tmp_path}/log", f"{tmp_path}/check")
        seen.append(known())
    assert seen == [{"A", "B"}, {"A", "B"}, {"A", "B", "C"}, {"A", "C"}, {"A", "C"}, {"A", "B", "C"}, {"A", "B", "C"}, {"Z"}]
    assert rows_of(log) == sorted([("A", "fire", at(DAY)), ("A", "ems", at(3 * DAY)), ("C", "fire", at(3 * DAY + 60)), ("B", "police", at(4 * DAY + 5))], key=str)


def test_agency_log_of_years_that_pandas_cannot_hold(spark, tmp_path):
    rows = [("A", at(0), "POLICE"), ("A", at(5), "FIRE"), ("B", dt.datetime(3000, 1, 1), ""), ("B", dt.datetime(3000, 1, 2), "EMS")]
    put(spark, tmp_path, [rows], LISTING)
    log = stateful.drain(stateful.agency_log(stream(spark, tmp_path, LISTING)), f"{tmp_path}/log", f"{tmp_path}/check")
    assert rows_of(log) == [("A", "fire", at(5)), ("B", "ems", dt.datetime(3000, 1, 2))]
