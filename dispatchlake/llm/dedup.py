"""Near-duplicate documents: MinHash coordinates in an inverted join, links confirmed on whole shingle sets.

Plan (``near_duplicates``):

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit fingerprint of the set
   and ``coordinates`` MinHash values. Equal sets collapse to one class at once, so copies never form pairs.
2. Every class posts under each (coordinate, value). Postings are counted; a class that shares fewer than
   ``min_matches`` of its coordinates with anyone can have no partner and leaves.
3. Prefix: two classes with ``min_matches`` common coordinates must meet in the ``coordinates - min_matches + 1``
   rarest of either one, so only these are joined; the long lists are skipped, and the collisions of a met pair are
   counted on the two signatures.
4. Each list is joined as a star (its most central class with all others), never as all pairs. Pairs above the match
   threshold are confirmed on the full sets, and components are formed. Classes in lists that still hold several
   components get an exact second pass over the full sets (``_across``), in which only members of *different*
   components can meet, so no link between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

COORDINATES = 64
#: P(fewer common coordinates) for a pair of similarity 0.8 is below 1e-6.
MIN_MATCHES = 34
SHINGLE = 4
BITS = 1024  # of the bitmaps that prune the second pass
SALTS = 64  # tasks that share the pairs of a hot pivot
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = np.random.default_rng(8).integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of the rows, and where each row's begin (length rows + 1).

    A row with fewer words than ``width`` has its whole sequence as its one shingle; a row without words has none.
    """
    rows = len(offsets) - 1
    starts, ends, row = C.ascii_words(raw, offsets)
    h = C.word_hashes(raw, starts, ends, C.FOLDED_CODES)
    words = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(words)))
    n = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    begin = np.concatenate(([0], np.cumsum(n)))
    total = int(begin[-1])
    at = np.arange(total) - np.repeat(begin[:-1], n) + np.repeat(first[:-1], n)
    left = np.repeat(np.minimum(words, width), n)
    out = left.astype(np.uint64)
    padded = np.concatenate((h, np.zeros(width, np.uint64)))
    for k in range(width):
        out += np.where(k < left, padded[at + k], np.uint64(0)) * C.PLACES[k]
    return C.mix(out), begin


def distinct_by_row(h: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    return [np.unique(h[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]


def sketch(batches: Iterator[pa.RecordBatch], width: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, set fingerprint, signature) of each text."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for lo, hi, raw, offsets in C.text_chunks(batch, "text"):
            h, begin = shingle_hashes(raw, offsets, width)
            sets = distinct_by_row(h, begin)
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            prints, sigs = [None] * (hi - lo), [None] * (hi - lo)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                at = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                a, b = np.add.reduceat(C.mix(flat), at), np.add.reduceat(C.mix(flat ^ C.PLACES[9]), at)
                sig = np.stack([np.minimum.reduceat((flat ^ _MASKS[k]) * _FACTORS[k], at) for k in range(COORDINATES)], 1)
                sig = C.mix(sig + C.PLACES[:COORDINATES][None, :])
                for j, i in enumerate(full):
                    prints[i], sigs[i] = a[j].tobytes() + b[j].tobytes(), sig[j].view(np.int64)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "fp", "sig"])


def _jaccard(min_percent: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of texts -> pairs whose full shingle sets reach the threshold. The pivot's set is kept while it repeats."""
        last, kept = None, None
        for batch in batches:
            cols = batch.to_pydict()
            u, v = [], []
            for a, b, ta, tb in zip(cols["a"], cols["b"], cols["text_a"], cols["text_b"], strict=True):
                if a != last:
                    last, kept = a, _set_of(ta, width)
                other = _set_of(tb, width)
                common = len(np.intersect1d(kept, other, assume_unique=True))
                if 100 * common >= min_percent * (len(kept) + len(other) - common):
                    u.append(a)
                    v.append(b)
            yield C.record_batch({"a": u, "b": v}, "a long, b long")

    return run


def _set_of(text: str | None, width: int) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return np.unique(shingle_hashes(raw, np.array([0, len(raw)]), width)[0])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) with root the smallest node of the component, for edges (a, b) of longs.

    Alternating large-star and small-star steps until a round changes nothing, which happens after some log^2 rounds.
    Neighbours are reduced by min() and joined back apart for hubs, so the edges of one hub are never gathered in one
    task. Every step is written to the shared folder, so no plan holds more than one.
    """
    now = C.store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state, seen = _state(now), None
    while state != seen:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _join(both, low, ["a"], 2 * state[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = C.store(large, "large")  # it is read three times below
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _join(large, low, ["a"], 2 * state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        now, seen = C.store(small, "edges"), state
        state = _state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _join(left: DataFrame, right: DataFrame, on: list[str], total: int, count: str = "n", how: str = "inner") -> DataFrame:
    """``C.join_keyed`` with ``right`` written first: it is read several times there, and the plans joined here would double
    at every step. Without hot keys it is one join."""
    right = C.store(right, "keys")
    if not right.filter(F.col(count) > C.hot_rows(total)).isEmpty():
        return C.join_keyed(left, right, on, total, count, how)
    more = [c for c in right.columns if c not in (*on, count)] if how != "left_semi" else []
    return left.join(right.drop(count), on, how).select(*left.columns, *more)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def near_duplicates(docs: DataFrame, min_percent: int = 80, min_matches: int = MIN_MATCHES, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Null and empty texts (or only white space) have 0 shingles and link with nothing. Repeated rows link with each
    other as equal sets do. An id that occurs with several texts gives one row per occurrence. Other columns of docs
    are ignored, whatever their names. An empty table gives an empty result. Texts of any length are compared whole, ties
    go to the smallest id. Shingles have ``width`` words. Ids must not be null; ``keep_first`` takes rows without one.
    """
    C.prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = C.store(texts.mapInArrow(lambda x: sketch(x, width), "doc_id long, n_shingles long, fp binary, sig array<long>"), "sketches")
    classes = sketches.filter("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.any_value("sig").alias("sig"))
    classes = C.store(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    comp = _link(texts, sketches, classes, min_percent, min_matches, width)
    # The smallest document of each component, by way of its classes.
    named = classes.select("cid", "fp", "low", "copies").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    names = named.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = _join(named, names, ["root"], C.rows_of(classes)).select("fp", "component_id", "copies")
    out = _join(sketches.select("doc_id", "n_shingles", "fp"), named, ["fp"], C.rows_of(sketches), "copies", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _link(texts: DataFrame, sketches: DataFrame, classes: DataFrame, min_percent: int, min_matches: int, width: int) -> DataFrame:
    total = COORDINATES * C.rows_of(classes)
    posts = classes.select("cid", F.explode("sig").alias("key"))
    shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    mine = _join(posts, shared.withColumn("n", F.col("df")), ["key"], total).groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("own"))  # at most one entry per coordinate
    mine = mine.filter(F.size("own") >= min_matches)
    mine = mine.withColumn("weight", F.aggregate("own", F.lit(0).cast("long"), lambda n, x: n + x["df"]))
    lists = C.store(mine.select("cid", "weight", F.explode(F.expr(f"slice(own, 1, size(own) - {min_matches} + 1)")).alias("p")).select("cid", "weight", F.col("p.key").alias("key")), "prefixes")
    # The pivot is the class whose coordinates are the most common ones: in a group of near copies that is its centre.
    stars = lists.groupBy("key").agg(F.max(F.struct("weight", (-F.col("cid")).alias("no"))).alias("p"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "n", (-F.col("p.no")).alias("pivot"))
    pairs = _join(lists, stars, ["key"], total).filter("cid <> pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct()
    active = lists.select("cid").distinct()
    sigs = C.store(classes.join(active, "cid", "left_semi").select("cid", "low", "sig", "fp"), "active")
    # One text of each active class: the row whose id is the class's smallest and whose set is the class's.
    wanted = sigs.select("cid", F.col("low").alias("doc_id"))
    bodies = C.store(texts.join(wanted, "doc_id").select("cid", "text"), "bodies")
    if not bodies.groupBy("cid").count().filter("count > 1").isEmpty():  # an id occurs more than once: keep the text with the class's own set
        checked = bodies.select(F.col("cid").alias("doc_id"), "text").mapInArrow(_fingerprints(width), "cid long, fp binary, text string")
        bodies = C.store(checked.join(sigs.select("cid", "fp"), ["cid", "fp"], "left_semi").dropDuplicates(["cid"]).select("cid", "text"), "bodies")
    edges = _confirm(pairs, sigs, bodies, min_percent, min_matches, width)
    comp = connected_components(edges)
    labelled = lists.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    split = labelled.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("n")).filter("r0 < r1").select("key", "n")
    live = C.store(_join(labelled, split, ["key"], total, how="left_semi").select("cid", "root").distinct(), "live")
    if live.isEmpty():
        return comp
    more = _confirm(_across(bodies.join(live, "cid"), min_percent, width), None, bodies, min_percent, min_matches, width)
    if more.isEmpty():
        return comp
    return connected_components(edges.union(more))


def _across(live: DataFrame, min_percent: int, width: int) -> DataFrame:
    """Candidate pairs (a, b) of different components among (cid, text, root), without loss.

    Exact prefix filter on the sets: shingles stand in order of rarity; two sets that reach the threshold share one
    within the first fifth (at 80 %) of the larger set and the first ninth of the smaller, and enough shingles must
    be left behind that place in both. Shingles of one set only need no posting. A bitmap of each set travels with its
    postings: where the bitmaps differ the sets do, which bounds the overlap from above, so pairs that can't reach the
    threshold are left out inside the join.
    """
    sets = C.store(live.select("cid", "root", "text").mapInArrow(lambda x: _shingles(x, width), "cid long, root long, n long, shingles array<long>, bits array<long>"), "sets")
    posts = sets.select("cid", F.explode("shingles").alias("h"))
    shared = posts.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = posts.join(shared, "h").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("own")).join(sets.select("cid", "root", "n", "bits"), "cid")
    probe = f"cast(floor(n * {100 - min_percent} / 100) as int)"  # last place that can still lead to the threshold
    near = f"cast(floor(n * {100 - min_percent} / {100 + min_percent}) as int)"  # the same for the smaller of two sets
    own = own.withColumn("alone", (F.col("n") - F.size("own")).cast("int")).withColumn("own", F.expr(f"slice(own, 1, greatest({probe} - alone + 1, 0))"))
    prefix = C.store(own.select("cid", "root", "n", "bits", "alone", F.expr(f"{near}").alias("near"), F.posexplode("own").alias("i", "e")).select("cid", "root", "n", "bits", "near", (F.col("alone") + F.col("i")).alias("place"), F.col("e.h").alias("h")), "prefix")
    small = prefix.filter("place <= near").select("h", F.col("cid").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("bits").alias("bb"), F.col("place").alias("pb"))
    fits = (F.col("root") != F.col("rb")) & ((F.col("n") > F.col("nb")) | ((F.col("n") == F.col("nb")) & (F.col("cid") > F.col("b")))) & (F.col("nb") * 100 >= F.col("n") * min_percent)
    fits &= F.least(F.col("n") - F.col("place"), F.col("nb") - F.col("pb")) * (100 + min_percent) >= (F.col("n") + F.col("nb")) * min_percent
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bb")[k])) for k in range(BITS // 64)])
    fits &= (F.col("n") + F.col("nb") - differ) * (100 + min_percent) >= (F.col("n") + F.col("nb")) * (2 * min_percent)
    large = prefix.withColumnRenamed("h", "h2")
    met = large.join(small, (F.col("h2") == F.col("h")) & fits)
    return met.select(F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b")).distinct()


def _shingles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, offsets in C.text_chunks(batch, "text"):
            sets = distinct_by_row(*shingle_hashes(raw, offsets, width))
            n = np.array([len(x) for x in sets], np.int64)
            marks = np.zeros((hi - lo, BITS), np.uint8)
            marks[np.repeat(np.arange(hi - lo), n), (np.concatenate(sets) % np.uint64(BITS)).astype(np.int64)] = 1
            bits = np.packbits(marks, axis=1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            maps = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * (BITS // 64), pa.int32()), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), lists, maps], names=["cid", "root", "n", "shingles", "bits"])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = pa.Table.from_batches(list(sketch(iter([batch]), width))).combine_chunks()
            yield pa.RecordBatch.from_arrays([done["doc_id"].combine_chunks(), done["fp"].combine_chunks(), batch.column(1)], names=["cid", "fp", "text"])

    return run


def _confirm(pairs: DataFrame, sigs: DataFrame | None, bodies: DataFrame, min_percent: int, min_matches: int, width: int) -> DataFrame:
    """Pairs with enough common coordinates whose full sets reach the threshold."""
    met = pairs
    if sigs is not None:
        own = sigs.select("cid", "sig")
        both = pairs.join(own.select(F.col("cid").alias("a"), F.col("sig").alias("sa")), "a").join(own.select(F.col("cid").alias("b"), F.col("sig").alias("sb")), "b")
        met = both.filter(F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x)) >= min_matches).select("a", "b")
    met = C.store(met, "met")
    # The pairs of a hot pivot are dealt over SALTS tasks, each with a copy of the pivot's text.
    hot = met.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > C.hot_rows(C.rows_of(met))).select("a", F.lit(SALTS).alias("salts"))
    met = met.join(F.broadcast(hot), "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1)))).drop("salts")
    pivots = bodies.select(F.col("cid").alias("a"), F.col("text").alias("text_a")).join(F.broadcast(hot), "a", "left")
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1))).drop("salts")
    texts = met.join(bodies.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b").join(pivots, ["a", "salt"])
    return C.store(texts.select("a", "b", "text_a", "text_b").mapInArrow(_jaccard(min_percent, width), "a long, b long"), "links")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """docs without near copies: of each component one row stays, that with the smallest id.

    Rows are judged by their own texts: where an id occurs several times, only its copies go, and a row with a null id
    (which counts as above all others) goes only if it is a near copy of another row. Repeated rows leave one.
    """
    ids = how.get("id_col", "doc_id")
    given = F.col(ids).cast("long")
    row = C.fresh("row", docs.columns)
    if docs.groupBy(given.alias("id")).count().filter("count > 1 OR id IS NULL").isEmpty():
        gone = C.store(near_duplicates(docs, **how).filter("NOT kept").select(F.col("doc_id").alias(row)), "copies")
        return C.without(docs, gone, given == F.col(row))
    keyed = C.store(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    found = near_duplicates(keyed, **how | {"id_col": row}).select(F.col("doc_id").alias(row), "component_id")
    ranked = keyed.select(row, given.alias("given")).join(found, row)
    kept = ranked.groupBy("component_id").agg(F.min(F.struct(F.col("given").isNull().alias("none"), "given", row)).alias("first")).select(F.col(f"first.{row}").alias(row))
    return keyed.join(kept, row, "left_semi").drop(row)
