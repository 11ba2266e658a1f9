"""Route definitions, verdicts and alerts."""

import datetime as dt

from dispatchlake.operators import routes

BODY = """Hello,
> > ABC_ROUTE_1_NAME=To work
ABC_ROUTE_1_PATH=30.16,-92.05; 30.19,-92.05;
  30.22,-92.05; junk; 100,0
ABC_ROUTE_1_DEPART = 07:20
ABC_ROUTE_1_DAYS=mon-fri

this line ends nothing
ROUTE_2_CORRIDORS=Johnston Street | W Pinhook Rd
ROUTE_2_COLOR=red
not a value
ROUTE_2_DEPART=17:00
ROUTE_2_DEPART=17:30
x = y
ROUTE_3_NAME=no time"""


def fields(spark, *bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "message_id long, body string")
    return routes.parse_route_lines(df)


def test_route_lines(spark):
    got = {r.route_id: r.fields for r in fields(spark, BODY).collect()}
    assert got[1] == {"NAME": "To work", "PATH": "30.16,-92.05; 30.19,-92.05; 30.22,-92.05; junk; 100,0", "DEPART": "07:20", "DAYS": "mon-fri"}
    assert got[2] == {"CORRIDORS": "Johnston Street | W Pinhook Rd", "DEPART": "17:30"} and got[3] == {"NAME": "no time"}


def test_edits_in_order(spark):
    none = spark.createDataFrame([], "route_id int, fields map<string,string>")
    edits = fields(spark, BODY, "ROUTE_1_DEPART=08:00", "ROUTE_2_DELETE=true", "ROUTE_1_DEPART=99:00", "ROUTE_4_DELETE=yes")
    got = routes.apply_route_edits(none, edits)
    table = routes.with_route_schedule(routes.routes_from_fields(got)).collect()
    assert [(r.route_id, r.name, len(r.path), r.radius_m, r.depart_minutes, r.day_numbers, r.corridors) for r in table] == [(1, "To work", 3, 100, 480, [0, 1, 2, 3, 4], [])]
    again = routes.apply_route_edits(got, fields(spark, "ROUTE_2_CORRIDORS=Johnston Street\nROUTE_2_DEPART=6:00\nROUTE_2_RADIUS_M=9"))
    assert sorted((r.route_id, r.corridors, r.radius_m) for r in routes.routes_from_fields(again).collect()) == [(1, [], 100), (2, ["JOHNSTON ST"], 50)]


def test_listings_of_one_place_are_one_incident(spark):
    kind = "incident_number string, location string, cause string, reported string, reported_ts timestamp_ntz, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, corridors array<string>, severity int, latitude double, longitude double"
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [("A", "1 OAK ST", "ACCIDENT MINOR", "", at(9, 40), at(9, 40), at(10, 0), ["OAK ST"], 50, 30.17, -92.05), ("B", "1 OAK ST", "ACCIDENT MAJOR", "", at(9, 45), at(9, 45), at(9, 50), ["OAK ST"], 70, 30.17, -92.05), ("C", "2 OAK ST", "ACCIDENT", "", None, at(9, 55), at(10, 0), ["OAK ST"], 45, None, None), ("D", "3 ELM ST", "ACCIDENT", "", at(9, 50), at(9, 50), at(10, 0), ["ELM ST"], 45, 30.18, -92.0535), ("E", "4 OAK ST", "ACCIDENT", "", at(9, 50), at(10, 30), at(10, 40), ["OAK ST"], 45, 30.18, -92.05)]
    inc = spark.createDataFrame(rows, kind)
    plan = spark.sql("SELECT 1 AS route_id, array(named_struct('lat', 30.16D, 'lng', -92.05D), named_struct('lat', 30.22D, 'lng', -92.05D)) AS path, array('OAK ST') AS corridors, array(0, 1) AS day_numbers, 620 AS depart_minutes")
    got = {r.incident_number: (r.status, r.match, r.verdict, r.ids) for r in routes.route_incidents(inc, plan, None, "2024-01-01 10:00:00", fold_min=15).collect()}
    assert got == {"B": ("cleared", "path", "cleared", ["B", "A"]), "A": (None, None, "merged", None), "C": ("active", "approximate", "alert", ["C"]), "D": ("active", None, "skipped", ["D"]), "E": ("unknown", "path", "alert", ["E"])}
    r = routes.route_replay(inc, plan, "2024-01-01 10:00:00", fold_min=15).first()
    assert (r.scheduled, r.send_minutes, r.incidents, r.cleared, r.near_misses) == (True, 600, 2, 1, ["D"])


def checks(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 7, 0) + dt.timedelta(minutes=m)
    one = lambda *x: [{"ids": list(i), "status": s} for i, s in x]
    rows = [(0, one(("A", "active"))), (5, one(("A", "active"), ("B", "active"))), (10, one(("AC", "active"))), (15, one(("C", "cleared"))), (20, one(("D", "active"))), (25, one(("E", "unknown"))), (30, one(("F", "active"))), (35, one(("GH", "active"))), (50, one(("J", "active")))]
    rows = [(r, at(m), f) for m, f in rows for r in (1, 2)] + [(1, at(24 * 60 * d), one(("A", "active"))) for d in (1, 5)]
    return spark.createDataFrame(rows, "route_id int, at timestamp_ntz, found array<struct<ids:array<string>,status:string>>")


def plan_of(spark):
    return spark.createDataFrame([(1, [0, 1, 2, 3, 4], 425), (2, [1], 425)], "route_id int, day_numbers array<int>, depart_minutes int")


def test_alerts_once_a_day_then_new_incidents(spark):
    got = [(r.route_id, r.at.day, r.at.minute, r.kind, r.ids) for r in routes.route_alerts(checks(spark), plan_of(spark)).orderBy("at").collect()]
    assert got == [(1, 1, 0, "departure", ["A"]), (1, 1, 5, "follow-up", ["B"]), (1, 1, 20, "follow-up", ["D"]), (1, 1, 25, "follow-up", ["E"]), (1, 2, 0, "departure", ["A"])]  # F would be a fourth
