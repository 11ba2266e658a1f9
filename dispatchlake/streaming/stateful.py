"""Streaming jobs on Spark's keyed state: value state in the state store, event-time timers, time-to-live.

Each job's work follows the rows of its batch and the timers that are due; the other keys of the state aren't touched
(keys are incidents, addresses or routes, in the agency log and in presence of very many incidents buckets of them).
State is kept and restored with the query's checkpoint, so a restart goes on where the last batch ended, and no row counts
twice. Moments are microseconds (long) inside the processors, so a worker's time zone doesn't matter.

All jobs take an event-time watermark of ``delay``: rows that are late by more are dropped, timers fire once the newest
moment seen is later than theirs by ``delay``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from dispatchlake.functions.causes import AGENCIES
from dispatchlake.operators.routes import ROUTES

MINUTE, DAY = 60_000_000, 86_400_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Sets the state store that these jobs need, for queries that are started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _moment(c: str) -> Column:
    """Back from microseconds, in the session's time zone."""
    return F.timestamp_micros(c).cast("timestamp_ntz").alias(c)


class _Timed(StatefulProcessor):
    """A processor with one value state and at most one timer for each key."""

    schema = ""
    ttl_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema, self.ttl_ms)

    def _wake(self, old_us: int | None, new_us: int | None) -> None:
        """Moves the key's timer. Spark fires one that the watermark has just reached, so it is set to the millisecond after."""
        if old_us == new_us:
            return
        if old_us is not None:
            self.handle.deleteTimer(old_us // 1000 + 1)
        if new_us is not None:
            self.handle.registerTimer(new_us // 1000 + 1)

    def close(self) -> None:
        pass


# ---------------------------------------------------------------- STR-08

class NegativeCache(_Timed):
    """Failures of one address: attempts and the last one. A success clears them, ``keep`` without a failure ends them."""

    schema = "attempts int, last_at long"

    def __init__(self, keep: int, ttl: bool):
        self.keep, self.ttl_ms, self.timed = keep, keep // 1000 if ttl else None, not ttl

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        old = self.state.get() if self.state.exists() else None
        n, last = (old[0], old[1]) if old else (0, None)
        for r in sorted(rows, key=lambda r: (r.at, r.ok)):
            if r.ok:
                n, last = 0, None
            elif last is not None and r.at <= last + self.keep:
                n, last = n + 1, max(last, r.at)
            else:
                n, last = 1, r.at
        if self.timed:
            self._wake(old[1] + self.keep if old else None, last + self.keep if n else None)
        if n:
            self.state.update((n, last))
        elif old:
            self.state.clear()
        yield Row(location_key=key[0], attempts=n, last_at=last)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        yield Row(location_key=key[0], attempts=0, last_at=None)


def negative_cache(tries: DataFrame, days: int = 7, delay: str = "0 seconds", clock: str = "event") -> DataFrame:
    """STR-08: (location_key, attempts, last_at), a row whenever an address changes; attempts 0: it may be tried again.

    ``tries`` has location_key, at, ok (batch: ``state.failure_state``). Entries end ``days`` after the last failure, with
    ``clock`` event by a timer (so a replay of a history gives what it gave then), with ``clock`` wall by the state
    store's own time-to-live, without a row (such a job goes on by the clock, so it doesn't end by itself). Update mode. Null addresses are an address; equal tries count each.
    """
    rows = tries.select("location_key", F.col("at").cast("timestamp").alias("__at"), _us("at").alias("at"), F.coalesce("ok", F.lit(False)).alias("ok"))
    timed = clock == "event"
    rows = (rows.withWatermark("__at", delay) if timed else rows).groupBy("location_key")
    out = rows.transformWithState(NegativeCache(days * DAY, not timed), "location_key string, attempts int, last_at long", "update", "eventTime" if timed else "processingTime")
    return out.select("location_key", "attempts", _moment("last_at"))


# ---------------------------------------------------------------- STR-04

BUCKETS = 1 << 14  # of incidents; some 2,000 in each at 36 million


class AgencyLog(_Timed):
    """Agencies named so far for the incidents of one bucket; one that a later sweep adds to an incident is a change.

    The timer ends the incidents that are over, at most once a day, so one may be kept for a day after its time.
    """

    schema = "due long, incidents array<string>, begin array<long>, last array<long>, agencies array<int>"

    def __init__(self, keep: int):
        self.keep = keep

    def _load(self) -> tuple[int | None, dict]:
        due, *columns = self.state.get() or (None, [], [], [], [])
        return due, {number: seen for number, *seen in zip(*columns, strict=True)}

    def _save(self, old_due: int | None, seen: dict) -> None:
        due = (min(last for _, last, _ in seen.values()) + self.keep) // DAY * DAY + DAY
        self._wake(old_due, due)
        self.state.update((due, list(seen), *map(list, zip(*seen.values(), strict=True))))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        sweeps: dict = {}
        for pdf in rows:
            for number, at, named in zip(pdf["incident_number"].tolist(), pdf["at"].tolist(), pdf["named"].tolist(), strict=True):
                mine = sweeps.setdefault(number if isinstance(number, str) else None, {})
                mine[at] = mine.get(at, 0) | named
        due, seen = self._load()
        changes = []
        for number, mine in sweeps.items():
            begin, last, known = seen.get(number, (None, None, 0))
            for at, named in sorted(mine.items()):
                if last is not None and at > last + self.keep:  # its timer may not have fired yet
                    begin, known = None, 0
                begin, last = at if begin is None else begin, at if last is None else max(last, at)
                if at > begin and named & ~known:
                    changes += [(number, name, at) for k, name in enumerate(AGENCIES) if named & ~known & 1 << k]
                known |= named
            seen[number] = (begin, last, known)
        self._save(due, seen)
        if changes:
            yield pd.DataFrame(changes, columns=["incident_number", "agency", "changed_at"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        seen = {number: x for number, x in self._load()[1].items() if x[1] + self.keep >= now}
        if seen:
            self._save(None, seen)  # the timer that fired goes by itself
        else:
            self.state.clear()
        return iter([])


def agency_log(listings: DataFrame, keep_days: int = 30, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """STR-04: (incident_number, agency, changed_at) of agencies that a later sweep adds (batch: ``ingest.accumulate_agencies``).

    Agencies are told by their patterns. Sweeps come in order; an incident that wasn't seen for ``keep_days`` starts anew.
    Incidents are kept in ``buckets`` by a hash of their number, as each key costs Python some round trips to the state
    store. A bucket that a batch names is read and written whole, so there should be one for some thousand incidents of
    ``keep_days`` at most; the number is fixed with the checkpoint. Rows without a time are left out; for the watermark, years
    after 2261 count as that year's end.
    """
    text = F.upper(F.coalesce("assisting", F.lit("")))
    named = reduce(lambda a, b: a + b, [F.when(text.rlike(p), 1 << k).otherwise(0) for k, p in enumerate(AGENCIES.values())])
    bucket = F.pmod(F.xxhash64("incident_number"), F.lit(buckets)).cast("int")
    clock = F.least(F.col("sweep_ts").cast("timestamp"), F.lit("2262-01-01").cast("timestamp"))  # pandas holds no later ones
    rows = listings.filter("sweep_ts IS NOT NULL").select(bucket.alias("bucket"), "incident_number", clock.alias("__at"), _us("sweep_ts").alias("at"), named.alias("named"))
    out = rows.withWatermark("__at", delay).groupBy("bucket").transformWithStateInPandas(AgencyLog(keep_days * DAY), "incident_number string, agency string, changed_at long", "append", "eventTime")
    return out.select("incident_number", "agency", _moment("changed_at"))


# ---------------------------------------------------------------- STR-02

PRESENCE_BUCKETS = 1 << 12  # of incidents; some 9,000 in each at 36 million
NEVER = -1 << 63  # the moment of a sighting without a time


class Presence(_Timed):
    """Sightings of the incidents of one key. A timer one sweep after an incident's last one says that it left, without a
    row of its own.

    The state and what a batch brings are worked on as columns, a place in them for each incident; an incident with count 0
    is new. They are kept as a JSON list and as bytes of arrays, since lists are converted value by value on their way.
    """

    schema = "due long, incidents string, first binary, last binary, count binary, listed binary"
    types = (np.int64, np.int64, np.int32, bool)
    events = "incident_number string, event string, at long, first_seen_at long, last_seen_at long, observation_count int"

    def __init__(self, sweep: int, keep: int):
        self.sweep, self.keep = sweep, keep

    def _load(self) -> tuple:
        due, incidents, *columns = self.state.get() or (None, "[]", b"", b"", b"", b"")
        return due, json.loads(incidents), *[np.frombuffer(c, t).copy() for c, t in zip(columns, self.types, strict=True)]

    def _due(self, last: np.ndarray, listed: np.ndarray) -> np.ndarray:
        return last + np.where(listed, self.sweep, self.keep)

    def _save(self, old_due: int | None, incidents: list, first: np.ndarray, last: np.ndarray, count: np.ndarray, listed: np.ndarray) -> None:
        due = int(self._due(last, listed).min())
        self._wake(old_due, due)
        self.state.update((due, json.dumps(incidents), *[c.tobytes() for c in (first, last, count, listed)]))

    def _rows(self, event: str, incidents: np.ndarray, at: np.ndarray | None, first: np.ndarray | None, last: np.ndarray | None, count: np.ndarray | int) -> pd.DataFrame:
        return pd.DataFrame({"incident_number": incidents, "event": event, "at": at, "first_seen_at": first, "last_seen_at": last, "observation_count": count})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        due, incidents, first, last, count, listed = self._load()
        places = {number: k for k, number in enumerate(incidents)}
        who, at = [], []
        for pdf in rows:
            who.append(np.array([places.setdefault(n if isinstance(n, str) else None, len(places)) for n in pdf["incident"].tolist()]))
            at.append(pdf["at"].to_numpy())
        who, at = np.concatenate(who), np.concatenate(at)
        first, last, count, listed = (np.concatenate([c, np.zeros(len(places) - len(c), c.dtype)]) for c in (first, last, count, listed))

        names = np.array([*places], object)
        bare = np.setdiff1d(who[at == NEVER], who[at != NEVER])
        bare = bare[bare >= len(incidents)]
        if len(bare):  # listed, but in no sweep that is known
            yield self._rows("appeared", names[bare], None, None, None, 1)
        who, at = who[at != NEVER], at[at != NEVER]

        order = np.lexsort((at, who))
        who, at = who[order], at[order]
        new = (count[who] == 0) | (at > last[who])  # other sweeps were counted
        new[1:] &= (who[1:] != who[:-1]) | (at[1:] != at[:-1])
        who, at = who[new], at[new]
        if not len(at):
            return
        begin = np.append(True, who[1:] != who[:-1])  # an incident's first sighting of this batch
        before = np.where(begin, last[who], np.append(0, at[:-1]))
        had = ~begin | (count[who] > 0)
        on = had & (~begin | listed[who])  # listed by then
        back = had & (at > before + self.sweep)
        anew = ~had | (at > before + self.keep)  # its timer may not have fired yet
        here = np.arange(len(at))
        since = np.maximum.accumulate(np.where(begin | anew, here, 0))
        n = np.where(anew, 0, count[who])[since] + here - since + 1
        start = np.where(anew, at, first[who])[since]

        gone, came = on & back, ~on | back
        if gone.any():
            old_start, old_n = np.where(begin, first[who], np.append(0, start[:-1])), np.where(begin, count[who], np.append(0, n[:-1]))
            yield self._rows("left", names[who[gone]], before[gone] + self.sweep, old_start[gone], before[gone], old_n[gone])
        if came.any():
            yield self._rows("appeared", names[who[came]], at[came], start[came], at[came], n[came])
        end = np.append(begin[1:], True)
        first[who[end]], last[who[end]], count[who[end]], listed[who[end]] = start[end], at[end], n[end], True
        kept = count > 0
        self._save(due, names[kept].tolist(), first[kept], last[kept], count[kept], listed[kept])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        _, incidents, first, last, count, listed = self._load()
        names = np.array(incidents, object)
        gone = listed & (self._due(last, listed) // 1000 < now)
        if gone.any():
            yield self._rows("left", names[gone], last[gone] + self.sweep, first[gone], last[gone], count[gone])
        listed &= ~gone
        kept = listed | (self._due(last, listed) // 1000 >= now)
        if kept.any():
            self._save(None, names[kept].tolist(), first[kept], last[kept], count[kept], listed[kept])  # the timer that fired goes by itself
        else:
            self.state.clear()


def presence(listings: DataFrame, sweep_min: int = 5, keep_days: int = 30, delay: str = "0 seconds", buckets: int | None = None) -> DataFrame:
    """STR-02: appeared and left events of each incident with its sightings up to then (batch: ``ingest.presence_events``).

    A sweep lists what is on the feed every ``sweep_min`` minutes. An incident that the next one doesn't list has left; if
    it returns, it appears again and its count goes on. What left ``keep_days`` ago is forgotten. Append mode. For the
    watermark, years after 2261 count as that year's end. Rows without a time count nothing; an incident that isn't known
    and that a batch lists only by them appears without a time, and isn't kept.

    Each incident is a key of the state, which costs Python some round trips to the state store and a frame. With
    ``buckets`` a hash of incidents is the key, for feeds that list very many: a bucket that a batch names or that has a
    leave is read and written whole, so there should be one for some thousand incidents of ``keep_days`` at most. It is
    fixed with the checkpoint.
    """
    clock = F.least(F.col("sweep_ts").cast("timestamp"), F.lit("2262-01-01").cast("timestamp"))  # pandas holds no later ones
    key = F.pmod(F.xxhash64("incident_number"), F.lit(buckets)).cast("int").alias("bucket") if buckets else F.col("incident_number")
    clock = F.when(F.col("sweep_ts").isNotNull(), clock)  # least() passes nulls over
    rows = listings.select(key, F.col("incident_number").alias("incident"), clock.alias("__at"), F.coalesce(_us("sweep_ts"), F.lit(NEVER)).alias("at"))
    out = rows.withWatermark("__at", delay).groupBy("bucket" if buckets else "incident_number").transformWithStateInPandas(Presence(sweep_min * MINUTE, keep_days * DAY), Presence.events, "append", "eventTime")
    return out.select("incident_number", "event", _moment("at"), _moment("first_seen_at"), _moment("last_seen_at"), "observation_count")


# ---------------------------------------------------------------- STR-09

class RouteWatch(_Timed):
    """One route's day: waiting for its departure window, then watching for new incidents, then over.

    The timer ends the day: at departure if nothing was sent, else when the watch is over.
    """

    schema = "day long, sent_at int, known array<string>, followups int, due long"

    def __init__(self, lead: int, followup: int, most: int):
        self.lead, self.followup, self.most = lead, followup, most

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        old = self.state.get() if self.state.exists() else None
        day, sent, known, followups, due = (old[0], old[1], set(old[2]), old[3], old[4]) if old else (None, None, set(), 0, None)
        before = due
        for r in sorted(rows, key=lambda r: r.at):
            if r.depart is None or not r.runs:
                continue
            if r.day != day:
                if day is not None and r.day < day:
                    continue
                day, sent, known, followups = r.day, None, set(), 0
                due = r.midnight + (r.depart + 1) * MINUTE
            if sent is None:
                if r.depart - self.lead <= r.minute < r.depart:
                    known, sent = {i for x in r.found for i in x["ids"]}, r.minute
                    due = r.midnight + (max(r.depart, sent + self.followup) + 1) * MINUTE
                    yield Row(route_id=key[0], at=r.at, kind="departure", ids=sorted(known))
            elif sent <= r.minute <= sent + self.followup and followups < self.most:
                fresh = {i for x in r.found if x["status"] != "cleared" and not known & set(x["ids"]) for i in x["ids"]}
                if fresh:
                    known, followups = known | fresh, followups + 1
                    yield Row(route_id=key[0], at=r.at, kind="follow-up", ids=sorted(fresh))
        if day is not None:
            self._wake(before, due)
            self.state.update((day, sent, sorted(known), followups, due))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter([])


def route_alert_stream(checks: DataFrame, routes: DataFrame, lead_min: int = 20, followup_min: int = 30, most: int = 3, delay: str = "0 seconds") -> DataFrame:
    """STR-09: (route_id, at, kind, ids) of the alerts of routes (batch: ``routes.route_alerts``). Append mode.

    A check (route_id, at, found) lists the incidents on a route at a moment. ``routes`` (route_id, day_numbers,
    depart_minutes) is a static table; it is broadcast if it is counted to have at most ROUTES rows.
    """
    plan = routes.select("route_id", "day_numbers", "depart_minutes")
    plan = F.broadcast(plan) if plan.limit(ROUTES + 1).count() <= ROUTES else plan
    local = F.col("at").cast("timestamp_ntz")
    rows = checks.withColumn("__at", F.col("at").cast("timestamp")).withWatermark("__at", delay).join(plan, "route_id")
    day = F.datediff(local, F.lit("1970-01-01"))
    rows = rows.select("route_id", "__at", _us("at").alias("at"), day.cast("long").alias("day"), F.unix_micros(F.date_trunc("DAY", "__at")).alias("midnight"), (F.hour(local) * 60 + F.minute(local)).alias("minute"), F.col("depart_minutes").alias("depart"), F.array_contains("day_numbers", F.weekday(local)).alias("runs"), F.col("found"))
    # only what may be sent on goes to the processor: checks from the departure window to the end of the longest watch
    rows = rows.filter(F.col("runs") & F.col("minute").between(F.col("depart") - lead_min, F.col("depart") + followup_min))
    kind = "route_id int, at long, kind string, ids array<string>"
    out = rows.groupBy("route_id").transformWithState(RouteWatch(lead_min, followup_min, most), kind, "append", "eventTime")
    return out.select("route_id", _moment("at"), "kind", "ids")


# ---------------------------------------------------------------- running a job over what is there

def drain(out: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a job over all input that is there and returns its rows so far; a second call goes on from the checkpoint.

    Update mode writes each batch's rows with their batch number (column ``batch``), append mode through the file sink.
    """
    spark = out.sparkSession
    use_keyed_state(spark)
    if mode == "append":
        q = out.writeStream.format("parquet").option("path", path)
    else:
        q = out.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    q = q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(out.schema if mode == "append" else out.schema.add("batch", "long")).parquet(path)


def latest(updates: DataFrame, key: Iterable[str]) -> DataFrame:
    """The last row of each key of an update job's rows."""
    cols = [c for c in updates.columns if c not in (*key, "batch")]
    return updates.groupBy(*key).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in cols])
