"""Operator 13: collocations of two to four words from a weighted de Bruijn graph.

Nodes are three-word phrases, edges four-word phrases between overlapping nodes, weighed by their occurrences. Shorter
phrases aren't counted in the texts: a phrase occurs as often as flow leaves it (the weights of its one-word extensions)
plus as often as a piece ends in it. Every block of texts builds its graph and derives its counts, and since both are
sums, the buckets of the hash range add them up to the counts of the whole table. A block goes through the phrase lengths
one by one, from edges down to words, and holds the phrases of two lengths at most.

Phrases that are frequent enough are spelled out by the first block that has them. There, runs of overlapping edges of
equal weight (unary paths) are compacted into one row for a path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import common as C

LONGEST = 4
LEAST = 30  # occurrences of a candidate
TOP = 2000
SCALE = 2_000_000
COVERED = 80  # percent of a candidate's occurrences that drop it, if they lie in one longer candidate
BROADCAST = 64 << 20  # bytes of spelling orders that are broadcast at most
SALT = 64  # parts of a language that are ranked before their best are ranked together
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_WORD = re.compile(rb"[^\x20\x09]+")
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(_SEPARATORS)] = True
_INSIDE = ~_SEPARATOR
_INSIDE[[0x20, 0x09]] = False


def piece_tail(part: bytes) -> tuple[bytes, bool]:
    """The last words of a part's unended piece, as many as a node has, and whether these are all of the part."""
    start = max(part.rfind(bytes([x])) for x in _SEPARATORS) + 1
    found = _WORD.findall(part, start)
    return b" ".join(found[-(LONGEST - 1) :]), not start and len(found) < LONGEST


@dataclass
class Graph:
    """A block's words, from which its phrases derive. Spark's strings have less than 2 GB, so words are numbered in 32 bits."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: np.ndarray
    own: np.ndarray  # the word isn't context of a text's earlier part
    ended: np.ndarray  # a piece ends with the word
    place: np.ndarray  # of the word in its piece, LONGEST - 1 at most
    words: dict[str, int]  # of each language

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """From edges down to words, of each phrase length: the distinct phrases (ascending hashes), their counts in this
        block, and the word at which one occurrence ends."""
        n = len(self.hashes)
        g = {1: self.hashes}
        for k in range(2, LONGEST + 1):
            g[k] = np.zeros(n, np.uint64)
            g[k][1:] = C.mix(g[k - 1][:-1] * C.ODD + self.hashes[1:])
        to = np.flatnonzero((self.place >= LONGEST - 1) & self.own).astype(np.int32)
        found = _merged(g.pop(LONGEST)[to], np.ones(len(to), np.int32), to)
        yield LONGEST, *found
        for k in range(LONGEST - 1, 0, -1):  # what leaves a phrase, and the pieces that end in it
            _, flow, to = found
            stop = np.flatnonzero(self.ended & (self.place >= k - 1)).astype(np.int32)
            places = np.concatenate((to - 1, stop))
            found = _merged(g.pop(k)[places], np.concatenate((flow, np.ones(len(stop), np.int32))), places)
            yield k, *found


def _merged(keys: np.ndarray, weights: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, weights, places
    by = np.argsort(keys, kind="stable")
    ranked = keys[by]
    at = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    return ranked[at], np.add.reduceat(weights[by], at, dtype=np.int32), places[by[at]]


def graph(rows: B.Rows) -> Graph:
    raw, offsets = C.FOLDED_CODES[rows.raw], rows.offsets
    starts, ends, row = C.runs(_INSIDE[raw], offsets)
    n = len(starts)
    langs = [x if x is not None else "und" for x in rows.columns["lang"]]
    seeds = {x: np.uint64(int.from_bytes(C.digest8(x), "little")) for x in set(langs)}
    h = C.mix(C.word_hashes(raw, starts, ends) ^ np.array([seeds[x] for x in langs], np.uint64)[row])
    own = starts >= (offsets[:-1] + rows.skip)[row]
    until = np.append(starts[1:], 0)
    last = np.append(row[1:] != row[:-1], True) if n else np.zeros(0, bool)  # of its row
    until[last] = offsets[1:][row[last]]
    marks = np.flatnonzero(_SEPARATOR[raw])
    parted = np.searchsorted(marks, until) > np.searchsorted(marks, ends)  # a separator follows
    ended = parted | last & rows.closed[row]
    first = np.append(True, (parted | last)[:-1]) if n else np.zeros(0, bool)
    place = np.zeros(n, np.uint8)
    for k in range(1, LONGEST):
        place[k:] += ~first[k:] & (place[k - 1 : -1] == k - 1)
    per_row = np.bincount(row[own], minlength=len(langs))
    words: dict[str, int] = {}
    for x, c in zip(langs, per_row.tolist(), strict=True):
        words[x] = words.get(x, 0) + c
    return Graph(starts.astype(np.int32), ends.astype(np.int32), row.astype(np.int32), h, own, ended, place, words)


LANGS = 1024  # groups of languages


def _ask(buckets: B.Buckets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in B.read(batch, ["lang"]):
                made = graph(rows)
                for k, u, c, _ in made.phrases():
                    yield buckets.requests(rows.block, {k: (u, c)})
                langs = list(made.words)
                yield C.record_batch({"grp": [-1 - int.from_bytes(C.digest8(x), "little") % LANGS for x in langs], "block": [rows.block] * len(langs), "hashes": [x.encode() for x in langs], "counts": [str(made.words[x]).encode() for x in langs]}, B.REQUEST)

    return run


ORDERS = "block long, grp long, entries binary, counts binary, lang string, n long"


def _frequent(buckets: B.Buckets, least: int):
    """Adds up a bucket; each frequent phrase becomes a spelling order for the first block that has it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        grp = table["grp"][0].as_py()
        rows = []
        if grp < 0:
            words: dict[bytes, int] = {}
            for x, n in zip(table["hashes"].to_pylist(), table["counts"].to_pylist(), strict=True):
                words[x] = words.get(x, 0) + int(n)
            rows = [(None, grp, None, None, x.decode(), n) for x, n in words.items()]
        else:
            _, total, first, _, lengths = B.summed(table, buckets.base(grp & (1 << 40) - 1))
            often = total >= least
            total, first = total[often], first[often]
            by = np.argsort(first)
            total, first = total[by], first[by]
            base = np.cumsum([0, *lengths])
            which = np.searchsorted(base, first, "right") - 1
            blocks = table["block"].to_pylist()
            for i in np.unique(which).tolist():
                own = which == i
                rows.append((blocks[i], grp, B.squeeze(first[own] - base[i]), B.squeeze(total[own]), None, None))
        return pa.Table.from_batches([C.record_batch(dict(zip([x.split()[0] for x in ORDERS.split(", ")], [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 6, strict=True)), ORDERS)])

    return run


PATHS = "lang string, words long, path string, f long"
SPELLED = 1 << 14  # paths that are spelled at once


def _spell(buckets: B.Buckets):
    """Spelling orders of each block -> its phrases: rows (language, phrase length, words of a path, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders = batch.column(batch.schema.get_field_index("orders")).to_pylist()
            for rows, own in zip(B.read(batch, ["lang"]), orders, strict=True):
                made = graph(rows)
                data = C.FOLDED_CODES[rows.raw].tobytes()
                for k, u, _, places in made.phrases():
                    begin = {b: a for b, a, _ in buckets.slices(u)}
                    mine = [x for x in own if x["grp"] >> 40 == k]
                    if not mine:
                        continue
                    at = np.concatenate([B.expand(x["entries"]) + begin[x["grp"] & (1 << 40) - 1] for x in mine])
                    f, end = np.concatenate([B.expand(x["counts"]) for x in mine]), places[at]
                    by = np.argsort(end)
                    f, end = f[by], end[by]
                    # an edge goes on with the one before, if it overlaps it in the text and weighs the same
                    new = np.ones(len(end), bool)
                    if k == LONGEST:
                        new[1:] = (end[1:] != end[:-1] + 1) | (f[1:] != f[:-1])
                    head = np.flatnonzero(new)
                    first, last = end[head] - k + 1, end[np.append(head[1:], len(end)) - 1]
                    for lo in range(0, len(head), SPELLED):
                        out = []
                        for i, j, a in zip(first[lo : lo + SPELLED].tolist(), last[lo : lo + SPELLED].tolist(), f[head[lo : lo + SPELLED]].tolist(), strict=True):
                            text = b" ".join(data[s:e] for s, e in zip(made.starts[i : j + 1].tolist(), made.ends[i : j + 1].tolist(), strict=True))
                            lang = rows.columns["lang"][made.row[j]]
                            out.append((lang if lang is not None else "und", k, text.decode(), a))
                        yield C.record_batch(dict(zip([x.split()[0] for x in PATHS.split(", ")], [list(x) for x in zip(*out, strict=True)], strict=True)), PATHS)

    return run


def frequent_paths(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text", size: int = B.BLOCK) -> tuple[DataFrame, DataFrame]:
    """Stored paths (lang, words, path, f) that spell every phrase of at most four words that occurs ``least`` times or
    more in its language, and the languages' words (lang, n). A path of length 4 holds one phrase for each of its words
    from the fourth on."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    stored = B.blocks(rows, {"lang": "string"}, piece_tail, size)
    buckets = B.buckets_for(stored)
    asked = stored.mapInArrow(_ask(buckets), B.REQUEST)
    found = C.store(asked.groupBy("grp").applyInArrow(_frequent(buckets, least), ORDERS), "frequent")
    orders = found.filter("grp >= 0").groupBy("block").agg(F.collect_list(F.struct("grp", "entries", "counts")).alias("orders"))
    small = (found.agg(F.sum(F.length("entries") + F.length("counts") + 64)).first()[0] or 0) <= BROADCAST
    met = stored.join(F.broadcast(orders) if small else orders, "block")
    return C.store(met.mapInArrow(_spell(buckets), PATHS), "paths"), found.filter("grp < 0").select("lang", "n")


def phrases_of(paths: DataFrame) -> DataFrame:
    """(lang, words, phrase, ws, f): the phrases of the paths, ``ws`` as an array."""
    ws = paths.withColumn("all", F.split("path", " ", -1))
    slots = ws.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("all") - F.col("words").cast("int") + 1)))
    one = slots.withColumn("ws", F.expr("slice(all, i, cast(words AS int))"))
    return one.select("lang", "words", F.array_join("ws", " ").alias("phrase"), "ws", "f")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text", size: int = B.BLOCK) -> DataFrame:
    """Each language's ``top`` collocations: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, null languages ``und``. Words are compared without ASCII case, within pieces between
    separators. Ranks are by score, a (both descending) and phrase. Repeated rows count each time; an empty table gives
    no rows; other columns aren't read. Counts are exact at any size, and scores are computed in decimals.
    """
    paths, totals = frequent_paths(docs, least, lang_col, text_col, size)
    every = C.store(phrases_of(paths), "phrases")
    part = every.select("lang", "phrase", "f")
    cuts = every.filter("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)))
    cuts = cuts.select("lang", "words", "phrase", F.col("f").alias("a"), "k", F.array_join(F.expr("slice(ws, 1, k)"), " ").alias("left"), F.array_join(F.expr("slice(ws, k + 1, size(ws) - k)"), " ").alias("right"))
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr(f"(CAST(a AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(7, 0))) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))"))
    least_cut = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "words", "phrase", "a").agg(least_cut)
    inner = every.filter("words > 2").withColumn("w", F.explode(F.sequence(F.lit(2), F.size("ws") - 1))).withColumn("i", F.explode(F.expr("sequence(1, size(ws) - w + 1)")))
    inner = inner.groupBy("lang", F.array_join(F.expr("slice(ws, i, w)"), " ").alias("phrase")).agg(F.max("f").alias("longer"))
    left = scored.join(inner, ["lang", "phrase"], "left").filter(f"longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {COVERED}")
    by = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    best = salted.withColumn("of_salt", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*by))).filter(F.col("of_salt") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))
