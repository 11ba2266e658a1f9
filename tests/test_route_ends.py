"""Incidents past the ends of the route, but within the radius, belong to it."""

from pyspark.sql import functions as F

from dispatchlake import registry


def test_incidents_past_the_ends_count(spark, tmp_path):
    user = lambda y: next(u for u in range(97 * 89 * 10) if u % 97 == y and u % 89 == 50 and u % 10 == 3)
    rows = {1: user(30), 4: user(70), 5: user(71), 3: user(9)}  # inside, 1 m and 113 m past one end, 111 m before the other
    far = {7: user(72), 8: user(8)}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(u).alias("u")) for i, u in (rows | far).items()]))
    out = events.limit(1).withColumn("p", pairs).withColumn("event_id", F.col("p.i").cast(events.schema["event_id"].dataType)).withColumn("user_id", F.col("p.u").cast(events.schema["user_id"].dataType)).select(events.columns)
    out.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.incident_number: (r.metres, r.along) for r in registry.QUERIES["jn_13_near_path"](spark, str(tmp_path)).collect()}
    assert got.keys() == {f"INC{i}" for i in rows}
    assert abs(got["INC5"][0] - 0.00102 * 111320) < 0.01 and abs(got["INC5"][1] - 0.06 * 111320) < 0.1
    assert abs(got["INC3"][0] - 0.001 * 111320) < 0.01 and got["INC3"][1] == 0
    roads = [(r.road, r.n) for r in registry.QUERIES["agg_48_route_roads"](spark, str(tmp_path)).collect()]
    assert roads == [("KALISTE SALOOM RD", 4)]
