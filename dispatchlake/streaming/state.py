"""State kept between micro-batches as a versioned table, for jobs whose rule needs more than built-in state.

Each micro-batch reads the version before it and writes its own; a batch that is repeated writes the same version again,
so results don't depend on failures. Versions older than the one before are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispatchlake.functions.causes import AGENCIES
from dispatchlake.operators import hourly, routes
from dispatchlake.operators.ingest import active_set_changes
from dispatchlake.sources.versioned import VersionedTable

Each = Callable[[DataFrame, int], None]


class StateTable:
    """Versions of a table under a path, by the number of the batch that wrote them."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, T.StructType.fromDDL(schema)

    def before(self, batch: int) -> DataFrame:
        """The last version older than a batch; empty for the first."""
        if not self._exists(self.path):
            return self.spark.createDataFrame([], self.schema)
        whole = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("version", T.LongType())])).parquet(self.path).filter(F.col("version") < batch)
        last = whole.agg(F.max("version")).first()[0]
        return (whole.filter(F.col("version") == last) if last is not None else whole.limit(0)).drop("version")

    def save(self, df: DataFrame, batch: int) -> None:
        df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.mode("overwrite").parquet(f"{self.path}/version={batch}")
        old = f"{self.path}/version={batch - 2}"
        if batch > 1 and self._exists(old):
            self._fs(old).delete(self._at(old), True)

    def latest(self) -> DataFrame:
        return self.before(1 << 62)

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._at(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs(path).exists(self._at(path))


def append_once(df: DataFrame, path: str, batch: int) -> None:
    """Appends the rows of a batch; a repeated batch replaces its own rows."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


SEEN = "incident_number string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, observation_count long, in_feed boolean"


def observations_with_leaving(state: StateTable, keep_days: int = 30) -> Each:
    """STR-02: sightings of each incident and whether the newest sweep still lists it (batch: track_sightings, JN-18).

    Sweeps come in order. Incidents that left ``keep_days`` before the newest sweep go, so state stays bounded.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select("incident_number", F.col("sweep_ts").cast("timestamp_ntz").alias("sweep_ts")).distinct()
        new = rows.groupBy("incident_number").agg(F.min("sweep_ts").alias("first_seen_at"), F.max("sweep_ts").alias("last_seen_at"), F.count(F.lit(1)).alias("observation_count"))
        old = state.before(number)
        both = old.select(*new.columns).unionByName(new).groupBy("incident_number").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("observation_count").alias("observation_count"))
        newest = both.agg(F.max("last_seen_at").alias("newest"))
        out = both.join(F.broadcast(newest)).withColumn("in_feed", F.col("last_seen_at") == F.col("newest"))  # one row
        state.save(out.filter(F.col("last_seen_at") >= F.col("newest") - F.expr(f"INTERVAL {keep_days} DAYS")), number)

    return each


ACTIVE = "incident_number string, sweep_ts timestamp_ntz"


def active_changes(state: StateTable, out: str) -> Each:
    """STR-03: appeared and left events between consecutive sweeps (batch: active_set_changes). State: the last sweep."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select("incident_number", F.col("sweep_ts").cast("timestamp_ntz").alias("sweep_ts")).distinct()
        old = state.before(number)
        known = old.agg(F.max("sweep_ts").alias("known"))
        both = old.unionByName(rows)
        changes = active_set_changes(both).join(F.broadcast(known))  # one row
        append_once(changes.filter("known IS NULL OR at > known").select("incident_number", "at", "event"), out, number)
        newest = both.agg(F.max("sweep_ts").alias("newest"))
        state.save(both.join(F.broadcast(newest)).filter(F.col("sweep_ts") == F.col("newest")), number)

    return each


AGENCY = "incident_number string, begin timestamp_ntz, last timestamp_ntz, agencies array<string>"


def agency_log(state: StateTable, out: str, keep_days: int = 30) -> Each:
    """STR-04: agencies that a later sweep adds to an incident (batch: accumulate_agencies on agency names).

    Agencies are told by their patterns, so ``FIRE DEPT`` is one. Incidents unseen for ``keep_days`` leave the state.
    """

    def each(batch: DataFrame, number: int) -> None:
        text = F.upper(F.coalesce("assisting", F.lit("")))
        named = F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in AGENCIES.items()]))
        rows = batch.select("incident_number", F.col("sweep_ts").cast("timestamp_ntz").alias("sweep_ts"), named.alias("named"))
        old = state.before(number)
        seen = rows.groupBy("incident_number").agg(F.min("sweep_ts").alias("lo"), F.max("sweep_ts").alias("hi"))
        first = rows.select("incident_number", "sweep_ts", F.explode("named").alias("agency")).groupBy("incident_number", "agency").agg(F.min("sweep_ts").alias("changed_at"))
        both = seen.join(old, "incident_number", "full_outer").select("incident_number", F.coalesce("begin", "lo").alias("begin"), F.coalesce("hi", "last").alias("last"), F.coalesce("agencies", F.array().cast("array<string>")).alias("agencies"))
        fresh = first.join(both, "incident_number").filter(~F.array_contains("agencies", F.col("agency")))
        append_once(fresh.filter("changed_at > begin").select("incident_number", "agency", "changed_at"), out, number)
        more = fresh.groupBy("incident_number").agg(F.collect_set("agency").alias("more"))  # at most len(AGENCIES)
        newest = both.agg(F.max("last").alias("newest"))
        now = both.join(more, "incident_number", "left").join(F.broadcast(newest)).withColumn("agencies", F.array_union("agencies", F.coalesce("more", F.array().cast("array<string>"))))  # one row
        state.save(now.filter(F.col("last") >= F.col("newest") - F.expr(f"INTERVAL {keep_days} DAYS")), number)

    return each


FAILURES = "location_key string, attempts int, last_at timestamp_ntz"


def advance_failures(tries: DataFrame, state: DataFrame, days: int = 7) -> DataFrame:
    """STR-08: (location_key, attempts, last_at) of addresses after some tries (location_key, at, ok), from a state.

    A success clears an address; failures more than ``days`` apart don't add up.
    """
    rows = tries.groupBy("location_key").agg(F.sort_array(F.collect_list(F.struct("at", "ok"))).alias("tries"))  # of one address in one batch
    both = rows.join(state, "location_key", "full_outer")
    step = f"""aggregate(coalesce(tries, cast(array() AS array<struct<at:timestamp_ntz,ok:boolean>>)), named_struct('n', coalesce(attempts, 0), 'last', last_at),
      (s, t) -> CASE WHEN t.ok THEN named_struct('n', 0, 'last', cast(NULL AS timestamp_ntz)) WHEN s.last IS NOT NULL AND t.at <= s.last + INTERVAL {days} DAYS THEN named_struct('n', s.n + 1, 'last', t.at) ELSE named_struct('n', 1, 'last', t.at) END)"""
    return both.select("location_key", F.expr(step).alias("s")).select("location_key", F.col("s.n").alias("attempts"), F.col("s.last").alias("last_at")).filter("attempts > 0")


def failure_state(tries: DataFrame, now: str, days: int = 7) -> DataFrame:
    """STR-08 over a history of tries: addresses whose failures still count at a moment."""
    nothing = tries.sparkSession.createDataFrame([], FAILURES)
    return advance_failures(tries, nothing, days).filter(F.col("last_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def negative_cache(state: StateTable, days: int = 7) -> Each:
    """STR-08: the failures of addresses as a stream (batch: failure_state). Entries past their time go with each batch."""

    def each(batch: DataFrame, number: int) -> None:
        tries = batch.select("location_key", F.col("at").cast("timestamp_ntz").alias("at"), "ok")
        out = advance_failures(tries, state.before(number), days)
        newest = tries.agg(F.max("at").alias("newest"))
        state.save(out.join(F.broadcast(newest)).filter(F.col("newest").isNull() | (F.col("last_at") >= F.col("newest") - F.expr(f"INTERVAL {days} DAYS"))), number)  # one row

    return each


def route_alert_stream(state: StateTable, route_table: DataFrame, out: str, keep_days: int = 2, **how) -> Each:
    """STR-09: alerts of routes from a stream of checks (batch: route_alerts). State: what each route sent on its last days."""

    def each(batch: DataFrame, number: int) -> None:
        old = state.before(number)
        done = routes.advance_alerts(batch, route_table, old, **how)
        append_once(done.select("route_id", F.explode("alerts").alias("a")).select("route_id", "a.at", "a.kind", "a.ids"), out, number)
        rest = old.join(done.select("route_id", "day"), ["route_id", "day"], "left_anti").unionByName(done.drop("alerts"))
        newest = rest.agg(F.max("day").alias("newest"))
        state.save(rest.join(F.broadcast(newest)).filter(F.datediff("newest", "day") < keep_days), number)  # one row

    return each


def resolve_hours(log: DataFrame) -> DataFrame:
    """STR-10: one row for each hour of a log of observations (source archive or live): if the archive has the hour, from
    its observations alone, else from the live ones."""
    ranked = log.withColumn("hour", F.date_trunc("HOUR", "obs_ts"))
    archived = ranked.filter("source = 'archive'").select("hour").distinct()
    live = ranked.filter("source <> 'archive'").join(archived, "hour", "left_anti").withColumn("archived", F.lit(False))
    kept = ranked.filter("source = 'archive'").withColumn("archived", F.lit(True)).unionByName(live)
    flags = kept.groupBy("hour").agg(F.max("archived").alias("archived"))
    return hourly.merge_hours(kept.drop("hour", "archived")).join(flags, "hour")


OBSERVATION = "obs_ts timestamp_ntz, temp_f double, precip_in double, visibility_mi double, wind_mph double, wx string, source string"


def weather_log(spark: SparkSession, path: str) -> VersionedTable:
    """The log of observations, by month."""
    return VersionedTable(spark, path, OBSERVATION, ["obs_ts", "source"], "month")


MONTH_ROWS = 1 << 19  # observations of a month that one task writes, or about


def _settled(have: DataFrame, new: DataFrame) -> DataFrame:
    """Observations of some months, each once; live ones only of hours that the archive doesn't have."""
    rows = have.unionByName(new.select(*have.columns)).distinct().withColumn("hour", F.date_trunc("HOUR", "obs_ts"))
    archived = rows.filter("source = 'archive'").select("hour").distinct()
    live = rows.filter("source <> 'archive'").join(archived, "hour", "left_anti")
    # by month, so that there are few files; a month of more than MONTH_ROWS rows goes to several tasks
    months = have.select("month").unionAll(new.select("month")).groupBy("month").count().agg(F.max("count").alias("most"), F.sum("count").alias("total")).first()
    spread, tasks = -(-months["most"] // MONTH_ROWS), max(-(-months["total"] // MONTH_ROWS), int(have.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.filter("source = 'archive'").unionByName(live).drop("hour").repartition(tasks, "month", F.pmod(F.xxhash64("obs_ts"), F.lit(spread)))


def weather_stream(log: VersionedTable, vacuum_every: int = 16) -> Each:
    """STR-10: merges observations into the log; ``resolve_hours`` reads it, or those months that are asked for. A late
    archive hour replaces the live one, a late live value never replaces an archived hour, whatever the order of the batches.

    A batch rewrites only the months that it falls into; one that comes again changes nothing. An observation without a
    time is left out.
    """

    def each(batch: DataFrame, number: int) -> None:
        log.merge(batch.filter("obs_ts IS NOT NULL").withColumn("month", F.date_format("obs_ts", "yyyy-MM")), _settled)
        if number % vacuum_every == vacuum_every - 1:
            log.vacuum()

    return each
