"""Stateful streams give the rows of their batch twins, however the input is cut, and again if a batch is repeated."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from dispatchlake.operators import ingest, routes
from dispatchlake.streaming import jobs, state

T0 = dt.datetime(2024, 1, 1, 6, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def run(spark, tmp_path, rows, kind, files, each):
    """Feeds rows in so many files, in order, to a foreachBatch function; each batch is delivered twice."""
    for n in range(files):
        spark.createDataFrame(rows[n * len(rows) // files : (n + 1) * len(rows) // files], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{n}")
    for n in range(files):
        for p in os.scandir(f"{tmp_path}/in{n}"):
            if p.name.endswith("parquet"):
                os.makedirs(f"{tmp_path}/in", exist_ok=True)
                os.rename(p.path, f"{tmp_path}/in/{n}.parquet")
                os.utime(f"{tmp_path}/in/{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))

    def twice(batch, number):
        each(batch, number)
        each(batch, number)

    q = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.foreachBatch(twice).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


LISTING = "incident_number string, sweep_ts timestamp_ntz, assisting string"
SWEEPS = [("A", at(0), "POLICE"), ("B", at(0), ""), ("A", at(5), "POLICE FIRE DEPT"), ("C", at(5), "SHERIFF"), ("A", at(10), "POLICE"), ("C", at(10), "SHERIFF"), ("B", at(15), "FIRE"), ("C", at(15), "SHERIFF POLICE"), ("C", at(20), "")]


@pytest.mark.parametrize("files", [1, 3])
def test_sightings_changes_and_agencies(spark, tmp_path, files):
    rows = spark.createDataFrame(SWEEPS, LISTING)
    tables = [state.StateTable(spark, f"{tmp_path}/s{k}", x) for k, x in enumerate((state.SEEN, state.ACTIVE, state.AGENCY))]
    jobs_ = [state.observations_with_leaving(tables[0]), state.active_changes(tables[1], f"{tmp_path}/events"), state.agency_log(tables[2], f"{tmp_path}/log")]

    def each(batch, number):
        for j in jobs_:
            j(batch, number)

    # a sweep is never cut: files end between sweeps
    cuts = {1: [9], 3: [4, 6, 9]}[files]
    parts, last = [], 0
    for c in cuts:
        parts.append(SWEEPS[last:c])
        last = c
    for n, part in enumerate(parts):
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        spark.createDataFrame(part, LISTING).coalesce(1).write.parquet(f"{tmp_path}/p{n}")
        for p in os.scandir(f"{tmp_path}/p{n}"):
            if p.name.endswith("parquet"):
                os.rename(p.path, f"{tmp_path}/in/{n}.parquet")
                os.utime(f"{tmp_path}/in/{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))

    def twice(batch, number):
        each(batch, number)
        each(batch, number)

    q = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.foreachBatch(twice).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    seen = {tuple(r)[:4]: r.in_feed for r in tables[0].latest().collect()}
    assert set(seen) == {tuple(r) for r in ingest.track_sightings(rows).collect()} and {k[0] for k, v in seen.items() if v} == {"C"}
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/events").drop("batch").collect())) == sorted(map(tuple, ingest.active_set_changes(rows).collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/log").drop("batch").collect())) == sorted((r.incident_number, r.agency, r.changed_at) for r in ingest.accumulate_agencies(rows).collect()) == [("A", "fire", at(5)), ("B", "fire", at(15)), ("C", "police", at(15))]


@pytest.mark.parametrize("files", [1, 3])
def test_negative_cache(spark, tmp_path, files):
    day = 24 * 60
    rows = [("X", at(0), False), ("Y", at(1), False), ("X", at(day), False), ("Y", at(day), True), ("Z", at(day), False), ("X", at(2 * day), False), ("Z", at(9 * day), False), ("X", at(9 * day), False), ("Y", at(9 * day), False)]
    kind = "location_key string, at timestamp_ntz, ok boolean"
    table = state.StateTable(spark, f"{tmp_path}/s", state.FAILURES)
    run(spark, tmp_path, rows, kind, files, state.negative_cache(table))
    got = sorted(map(tuple, table.latest().collect()))
    assert got == sorted(map(tuple, state.failure_state(spark.createDataFrame(rows, kind), "2024-01-10 06:00:00").collect())) == [("X", 4, at(9 * day)), ("Y", 1, at(9 * day)), ("Z", 1, at(9 * day))]


@pytest.mark.parametrize("files", [1, 4])
def test_route_alert_stream(spark, tmp_path, files):
    kind = "route_id int, at timestamp_ntz, found array<struct<ids:array<string>,status:string>>"
    rows = [(1, at(5 * k), [{"ids": [f"I{k // 2}"], "status": "active" if k % 5 else "cleared"}]) for k in range(24)] + [(1, at(24 * 60 + 5 * k), [{"ids": [f"J{k}"], "status": "unknown"}]) for k in range(12)]
    plan = spark.createDataFrame([(1, [0, 1, 2, 3, 4], 390)], "route_id int, day_numbers array<int>, depart_minutes int")
    table = state.StateTable(spark, f"{tmp_path}/s", routes.ALERT_STATE)
    run(spark, tmp_path, rows, kind, files, state.route_alert_stream(table, plan, f"{tmp_path}/alerts"))
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/alerts").drop("batch").collect()))
    want = sorted(map(tuple, routes.route_alerts(spark.createDataFrame(rows, kind), plan).collect()))
    assert got == want and [x[2] for x in got].count("departure") == 2 and len(got) == 8


@pytest.mark.parametrize("files", [1, 3])
def test_weather_log(spark, tmp_path, files):
    kind = "obs_ts timestamp_ntz, temp_f double, precip_in double, visibility_mi double, wind_mph double, wx string, source string"
    rows = [(at(m), 60.0 + m, r, 10.0, 5.0, wx, src) for m, r, wx, src in ((0, 0.5, "RA", "live"), (10, 0.1, "", "archive"), (20, 0.9, "TS", "live"), (60, 0.2, "", "live"), (70, 0.4, "FG", "live"), (120, 0.0, "", "live"), (130, 0.3, "", "archive"))]
    rows.append((None, 1.0, 1.0, 1.0, 1.0, "RA", "live"))
    table = state.weather_log(spark, f"{tmp_path}/log")
    run(spark, tmp_path, rows, kind, files, state.weather_stream(table, 2))
    got = {r.hour: (r.precip_in, r.temp_f, r.wx, r.archived) for r in state.resolve_hours(table.read()).collect()}
    assert got == {at(0): (0.1, 70.0, "", True), at(60): (0.4, 130.0, "FG", False), at(120): (0.3, 190.0, "", True)}
    assert table.read().count() == 4  # each once, and no live ones beside an archived hour
    other = spark.createDataFrame([(at(60 * 24 * 40), 50.0, 0.0, 10.0, 5.0, "", "live"), (at(15), 99.0, 9.0, 1.0, 9.0, "RA", "live")], kind)
    before = table.manifest()["folders"]
    state.weather_stream(table)(other.limit(1), 90)
    after = table.manifest()["folders"]
    assert sorted(after) == ["2024-01", "2024-02"] and after["2024-01"] == before["2024-01"]  # only the month it falls into
    state.weather_stream(table)(other, 91)  # late and live
    assert {r.hour: r.precip_in for r in state.resolve_hours(table.read(["2024-01"])).collect()} == {k: v[0] for k, v in got.items()}


def test_sessions_and_digest_windows(spark, tmp_path):
    kind = "incident_number string, location string, cause string, assisting string, reported_ts timestamp, created_at timestamp, latitude double, longitude double, geocode_attempts int"
    rows = [(f"I{k}", "A ST" if k % 2 else "B ST", "ACCIDENT MAJOR" if k == 5 else "ACCIDENT MINOR", "POLICE", at(4 * k), at(4 * k), 30.0 if k % 3 else None, -92.0, k % 5) for k in range(8)] + [("END", "C ST", "X", "", at(6000), at(6000), None, None, 0)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    for name, df in (("sessions", jobs.episodes_stream(stream())), ("windows", jobs.rolling_24h(stream()))):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    got = {r.location_key: (r.incident_number, r.extras, r.n_listings) for r in spark.table("sessions").collect()}
    assert got == {"A ST": ("I5", ["I1", "I3", "I7"], 4), "B ST": ("I2", ["I0", "I4", "I6"], 4)}
    whole = [r for r in spark.table("windows").collect() if r.n == 8]
    assert whole and all((r.n_accidents, r.agency_police, r.located, r.locating, r.unmappable) == (8, 8, 5, 2, 1) for r in whole)
