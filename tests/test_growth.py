"""What must hold so that work and memory grow with the input."""

from pyspark.sql import functions as F

from dispatchlake.operators import insights, roadstats
from dispatchlake.plans import bindings, catalog_streams
from dispatchlake.streaming import state, stateful


def crashes(spark, path, n=400):
    """n crashes on disk, a minute apart at a few places, so that the planner sizes them by their files."""
    rows = spark.range(n).select(F.concat(F.lit("C"), F.col("id")).alias("incident_number"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).cast("timestamp_ntz").alias("reported_ts"), (30.15 + F.col("id") % 7 * 0.004).alias("latitude"), (-92.1 + F.col("id") % 5 * 0.004).alias("longitude"))
    rows.write.parquet(path)
    return spark.read.parquet(path)


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_followers_never_broadcast_posted_rows(spark, tmp_path):
    plan = plan_of(insights.followers(crashes(spark, f"{tmp_path}/c"), shifts=(0, 7)))
    assert "SortMergeJoin [shift" in plan and "BroadcastHashJoin [shift" not in plan


def test_follow_on_share_never_broadcasts_the_followers(spark, tmp_path):
    plan = plan_of(insights.follow_on_share(crashes(spark, f"{tmp_path}/c")))
    assert "SortMergeJoin [incident_number" in plan and "BroadcastHashJoin [incident_number" not in plan


def test_snapping_leaves_the_far_network_out(spark, monkeypatch):
    """Of a road over many degrees only what is near the points is kept for the search."""
    kept = {}

    def stored(df, name):
        kept.setdefault(name, df.count())
        return df

    monkeypatch.setattr(roadstats, "stored", stored)
    nodes = spark.range(2000).select(F.col("id").alias("node_id"), (30 + F.col("id") * 0.005).alias("lat"), F.lit(-92.0).alias("lon"))
    edges = spark.range(1999).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit("primary").alias("road_class"))
    points = spark.createDataFrame([(30.0012, -92.0051), (31.0, -92.0082), (32.0, -92.0090)], "latitude double, longitude double")
    rows = roadstats.snap_to_node(points, edges, nodes).collect()
    assert sorted((r.u, r.v, r.metres) for r in rows) == [(0, 1, 491.664), (199, 200, 782.443)]  # the third is 866 m away
    assert kept["edges"] < 30


def test_overlap_totals_are_those_of_the_pairs(spark):
    """Many, equal, touching, empty and backward segments of two routes and one without counts, against all pairs."""
    roads = spark.range(300).select(F.when(F.col("id") % 3 == 0, "A").when(F.col("id") % 50 == 1, "C").otherwise("B").alias("route_id"), F.lit("OAK ST").alias("full_name"), (F.col("id") * 7 % 40 / 10).alias("from_mi"), ((F.col("id") * 7 % 40 + F.col("id") % 9 - 1) / 10).alias("to_mi"))
    counts = spark.range(200).select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("route_id"), (F.col("id") * 11 % 30 / 5).alias("from_mi"), ((F.col("id") * 11 % 30 + F.col("id") % 6 - 1) / 5).alias("to_mi"), F.when(F.col("id") % 13 > 0, F.col("id") * 10.0).alias("aadt"))
    pairs = roadstats.overlap_segments(roads, counts).groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("overlap"), 6).alias("counted"), F.round(F.sum(F.col("overlap") * F.col("aadt")), 4).alias("traffic"))
    totals = roadstats.overlap_totals(roads, counts).select("route_id", "n", F.round("counted", 6).alias("counted"), F.round("traffic", 4).alias("traffic"))
    want = sorted(map(tuple, pairs.collect()))
    assert len(want) == 2 and sorted(map(tuple, totals.collect())) == want
    stats = roadstats.road_stats(roads.withColumn("route_id", F.concat("route_id", F.lit("_1_1_010"))), counts.withColumn("route_id", F.concat("route_id", F.lit("_1_1_010"))))
    assert "a_lo" not in stats.columns and stats.count() == 1


def test_streams_of_events_take_files_whose_times_overlap(spark, tmp_path):
    """Each file has rows from before the end of the others; none is late."""
    rows = spark.range(30).select("id", F.timestamp_seconds(1_700_000_000 + F.col("id") * 600).cast("timestamp_ntz").alias("ts"))
    for k in range(3):
        rows.filter(F.col("id") % 3 == k).select(F.col("id").alias("event_id"), "ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    stream = bindings.listings(spark, str(tmp_path), bindings.event_stream(spark, str(tmp_path)))
    out = stateful.drain(stateful.presence(stream), f"{tmp_path}/out", f"{tmp_path}/check")
    assert out.filter("event = 'appeared'").count() == 30


def test_only_checks_that_may_be_sent_reach_the_route_watch(spark, tmp_path):
    """Of a day of checks every minute, those of the departure window and the watch after it."""
    found = F.array(F.struct(F.array(F.concat(F.lit("I"), F.col("id"))).alias("ids"), F.lit("active").alias("status")))
    checks = spark.range(1440).select(F.lit(1).alias("route_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 60).cast("timestamp_ntz").alias("at"), found.alias("found"))
    checks.write.parquet(f"{tmp_path}/checks")
    plan = spark.createDataFrame([(1, [0, 1, 2, 3, 4, 5, 6], 600)], "route_id int, day_numbers array<int>, depart_minutes int")
    out = stateful.route_alert_stream(spark.readStream.schema(checks.schema).parquet(f"{tmp_path}/checks"), plan)
    assert "Filter (runs" in out._jdf.queryExecution().analyzed().toString()
    rows = stateful.drain(out, f"{tmp_path}/out", f"{tmp_path}/check").orderBy("at").collect()
    assert [(r.kind, r.ids) for r in rows] == [("departure", ["I580"]), ("follow-up", ["I581"]), ("follow-up", ["I582"]), ("follow-up", ["I583"])]


def test_a_large_month_of_the_weather_log_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "MONTH_ROWS", 1000, raising=False)
    rows = spark.range(20000).select(F.timestamp_seconds(1_704_067_200 + F.col("id") * 60).cast("timestamp_ntz").alias("obs_ts"), *[F.rand(1).alias(c) for c in ("temp_f", "precip_in", "visibility_mi", "wind_mph")], F.lit("").alias("wx"), F.lit("live").alias("source"))
    table = state.weather_log(spark, f"{tmp_path}/log")
    for n in range(2):
        state.weather_stream(table)(rows, n)
    assert table.read().count() == 20000 and len(table.read(["2024-01"]).inputFiles()) > 4


def test_parts_are_fed_in_files_of_their_tasks(spark):
    """Each part is one batch, in its order, whatever number of files it has."""
    seen = []
    parts = [spark.range(k * 100, k * 100 + 100, 1, 3) for k in range(3)]
    catalog_streams._fed(spark, parts, lambda batch, n: seen.append((n, batch.count(), batch.agg(F.min("id")).first()[0])))
    assert seen == [(0, 100, 0), (1, 100, 100), (2, 100, 200)]
