"""Sharding through fixed virtual slots (DataFrame functions only).

Records are hashed into some thousand slots. The slots never change; a versioned table says which shard holds which
slot, and rebalancing edits that table: added shards are filled from those above the mean, and beyond that slots only move
while shards differ by more than a tolerance.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

SLOTS = 4096
PARTS = 8  # numbering units within a slot
TOLERANCE = 0.01  # of the mean: shards of a kept map that differ by no more are left alone
_MAP = "version int, vslot int, shard int"


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot, part) of each row: size is the text's UTF-8 bytes (null: none) plus 8."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    h = F.xxhash64("doc_id", "text_crc32")
    return out.withColumn("vslot", F.pmod(h, F.lit(slots)).cast("int")).withColumn("part", F.pmod(F.shiftright(h, 40), F.lit(PARTS)).cast("int"))


def slot_bytes(rows: DataFrame) -> dict[int, int]:
    """Bytes of each slot: at most ``slots`` numbers, summed before they come to the driver."""
    return {r["vslot"]: r["bytes"] for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()}


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    return [v % shards for v in range(slots)]


def _excess(slots: list[tuple[int, int]], excess: float) -> list[tuple[int, int]]:
    """Few slots (weight, slot) that hold about ``excess`` bytes: large ones while they fit, then the one that comes closest."""
    left, out = sorted(slots), []
    while left:
        k = bisect.bisect_right(left, (excess, len(left) << 32))
        near = min(left[max(0, k - 1) : k + 1], key=lambda x: (abs(x[0] - excess), x))
        if abs(near[0] - excess) >= abs(excess):
            break
        left.remove(near)
        out.append(near)
        excess -= near[0]
    return out


def rebalance(current: list[int], weight: dict[int, int], shards: int, tolerance: float = 0.0) -> list[int]:
    """Edits a slot map.

    Added shards (those without a slot) are filled first, from the shards above the mean: each gives the slots that come
    closest to what it has too much. Then slots move from the fullest shard to the emptiest (or are exchanged), but only
    while the two are more than ``tolerance`` (of the mean) apart. Each such step narrows a gap, so they come to an end.
    """
    out = list(current)
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for v, s in enumerate(out):
        load[s] += weight.get(v, 0)
        held[s].append((weight.get(v, 0), v))
    mean = sum(load) / shards

    def move(x: tuple[int, int], a: int, b: int) -> None:
        held[a].remove(x)
        held[b].append(x)
        out[x[1]] = b
        load[a] -= x[0]
        load[b] += x[0]

    added = [s for s in range(shards) if not held[s]]
    if 0 < len(added) < shards:
        given = [(x, a) for a in range(shards) if load[a] > mean for x in _excess(held[a], load[a] - mean)]
        for x, a in sorted(given, key=lambda g: (-g[0][0], g[0][1])):
            move(x, a, min(added, key=lambda s: (load[s], s)))
    while True:
        a, b = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[a] - load[b]
        if gap <= tolerance * mean:
            return out
        nothing = (0, -1)  # a move, or an exchange where no slot alone is small enough
        fit = [(x, nothing) for x in held[a] if 0 < x[0] < gap] or [(x, y) for x in held[a] for y in held[b] if 0 < x[0] - y[0] < gap]
        if not fit:
            return out
        x, y = min(fit, key=lambda p: (abs(p[0][0] - p[1][0] - gap / 2), p))
        move(x, a, b)
        if y != nothing:
            move(y, b, a)


def map_table(spark: SparkSession, versions: dict[int, list[int]]) -> DataFrame:
    """Rows (version, vslot, shard) of slot maps."""
    text = lambda m: F.split(F.lit(",".join(map(str, m))), ",")
    all_of = F.array(*[F.struct(F.lit(n).alias("version"), text(m).alias("shards")) for n, m in versions.items()])
    rows = spark.range(1, numPartitions=1).select(F.explode(all_of).alias("m")).select("m.version", F.posexplode("m.shards").alias("vslot", "shard"))
    return rows.select("version", "vslot", F.col("shard").cast("int").alias("shard"))


def read_map(slot_map: DataFrame) -> tuple[int, list[int]]:
    """(version, shard of each slot) of the last version of a stored map; a map has ``slots`` rows a version."""
    last = slot_map.agg(F.max("version")).first()[0]
    rows = slot_map.filter(F.col("version") == last).select("vslot", "shard").distinct().collect()
    out = dict(map(tuple, rows))
    if sorted(out) != list(range(len(rows))):
        raise ValueError("the slot map doesn't name one shard for each slot")
    return last, [out[v] for v in range(len(out))]


def place(rows: DataFrame, slot_map: DataFrame, version: int) -> DataFrame:
    """Adds shard and slot, the row's number in its shard, gapless from 0.

    Rows are numbered within (slot, part), and each such unit begins where the units before it in its shard end; the
    table of these beginnings has at most slots * PARTS rows, which is its broadcast bound.
    """
    now = slot_map.filter(F.col("version") == version).select("vslot", "shard")
    units = rows.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(now), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    begins = units.select("vslot", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    at = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("at", at).join(F.broadcast(begins), ["vslot", "part"]).withColumn("slot", (F.col("begin") + F.col("at")).cast("long")).drop("at", "begin", "part")


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", previous: DataFrame | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed rows, slot map with all versions).

    ``previous`` is a map kept from an earlier run: its last version is edited (slots move into added shards, else only
    while shards differ by more than TOLERANCE), and the edit is appended as the next version. Without it, version 1 deals the
    slots in turn and version 2 is balanced by bytes. ``path`` is where the map with its history is written to be kept,
    a new folder of this version; without it the map is an intermediate table.

    Equal texts under different ids go to different slots, so a large group of copies is spread. Repeated rows keep
    one slot and get a number each. Null texts have no bytes, null ids hash as one id. Texts are only measured, so long
    ones cost nothing. Other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    if previous is None:
        version, current, history = 1, first_map(shards, slots), None
    else:
        version, current = read_map(previous)
        history, slots = previous.select("version", "vslot", "shard"), len(current)
        if max(current) >= shards:
            raise ValueError("slots can't be taken from shards that are gone; give at least as many shards as the map has")
    rows = C.store(records(docs, id_col, text_col, slots), "records")
    now = rebalance(current, slot_bytes(rows), shards, 0.0 if previous is None else TOLERANCE)
    new = map_table(spark, {version: current, version + 1: now} if history is None else {version + 1: now})
    whole = new if history is None else history.unionByName(new)
    if path is None:
        slot_map = C.store(whole.coalesce(1), "slot-map")
    else:
        whole.coalesce(1).write.parquet(path)
        slot_map = spark.read.schema(_MAP).parquet(path)
    return place(rows, slot_map, version + 1), slot_map
