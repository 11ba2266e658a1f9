"""Operator 11: language-model scores of whole texts by a weighted backoff automaton.

States are the n-gram contexts of the training texts, arcs its n-grams, and each state but the root has a failure arc to
its longest shorter context. Counts are exact sums over all training texts; no part of the model is cut or sampled.

Smoothing: the root has add-a-half unigrams with one class for unknown words. Above it, with c the n-gram's count and C
that of its context, P(w|h) = (1 - b) c/C + b P(w|h'), and the failure arc of h weighs b = D * C^(beta - 1): the share that
absolute discounting leaves, with the number of a context's different followers taken from Heaps' law, C^beta. D comes
from the counts of counts, beta is set so that the followers of all contexts add up to the number of n-grams.

The automaton is never held whole. Texts lie in blocks; each block asks the buckets of the n-gram table for its own
n-grams and walks its texts through the part of the automaton that they can reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import common as C

ORDER = 2  # length of the longest n-grams
LANE = 512  # words that one lane of a block's traversal walks
BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x2545F4914F6CDD1D)  # hashes of the marks around a text
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
GRID = np.linspace(0, 1, 33)  # exponents at which the sums for Heaps' law are taken


@dataclass(frozen=True)
class Model:
    """Figures of the whole training part: words, distinct words, and of each length above 1 the discount and exponent."""

    words: int
    vocabulary: int
    discount: dict[int, float]
    heaps: dict[int, float]


@dataclass
class Tokens:
    """The words of a block with a begin mark before and an end mark behind each text."""

    hashes: np.ndarray
    row: np.ndarray
    first: np.ndarray  # place of the row's first token
    own: np.ndarray  # not a begin mark, and not context of an earlier part


def last_words(count: int):
    """The last ``count`` words of a part, and whether these are all it has."""

    def context(part: bytes) -> tuple[bytes, bool]:
        found = _WORD.findall(part)
        return b" ".join(found[max(0, len(found) - count) :]) if count else b"", len(found) <= count

    return context


def tokens(rows: B.Rows) -> Tokens:
    starts, ends, row = C.ascii_words(rows.raw, rows.offsets)
    h = C.word_hashes(rows.raw, starts, ends, C.FOLDED_CODES)
    n = len(rows.offsets) - 1
    words = np.bincount(row, minlength=n)
    size = words + rows.begins + rows.closed
    first = np.cumsum(size) - size
    out, own = np.empty(size.sum(), np.uint64), np.ones(size.sum(), bool)
    at = np.arange(len(h)) + (first + rows.begins - np.cumsum(words) + words)[row]
    out[at], own[at] = h, starts >= (rows.offsets[:-1] + rows.skip)[row]
    out[first[rows.begins]] = BEGIN
    own[first[rows.begins]] = False
    out[(first + size - 1)[rows.closed]] = END
    of = np.repeat(np.arange(n), size)
    return Tokens(out, of, first[of], own)


def grams(t: Tokens, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length: hashes of the n-grams that end at each token, and which of them lie within their text."""
    place = np.arange(len(t.hashes)) - t.first
    out = {1: (t.hashes, np.ones(len(t.hashes), bool))}
    for n in range(2, order + 1):
        g = np.zeros(len(t.hashes), np.uint64)
        g[1:] = C.mix(out[n - 1][0][:-1] * C.ODD + t.hashes[1:])
        out[n] = g, place >= n - 1
    return out


def _ask(order: int, buckets: B.Buckets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in B.read(batch, ["held"]):
                t = tokens(rows)
                begin = (t.hashes == BEGIN) & (np.arange(len(t.hashes)) == t.first) & (rows.skip[t.row] == 0)  # counts as a context
                learn = (t.own | begin) & ~np.array(rows.columns["held"], bool)[t.row]
                asked = {}
                for n, (g, valid) in grams(t, order).items():
                    u, _ = B.distinct(np.sort(g[valid]))
                    seen, c = B.distinct(np.sort(g[valid & learn]))
                    count = np.zeros(len(u), np.int64)
                    count[np.searchsorted(u, seen)] = c
                    asked[n] = u, count
                yield buckets.requests(rows.block, asked)

    return run


ANSWER = "grp long, block long, counts binary, words long, types long, once long, twice long, powers array<double>"


def _answer(buckets: B.Buckets):
    """Sends each request the sums of its n-grams, and one row (block -1) with the bucket's figures for the model."""

    def run(table: pa.Table) -> pa.Table:
        grp = table["grp"][0].as_py()
        base = buckets.base(grp & (1 << 40) - 1)
        number, total, first, _, lengths = B.summed(table, base)
        each = total[number]
        parts = np.split(each, np.cumsum(lengths)[:-1])
        seen = total > 0
        if grp >> 40 == 1:
            hashes = np.concatenate([B.unpack(x.as_py(), base) for x in table["hashes"]])[first]
            seen &= hashes != BEGIN
            contexts = total[(total > 0) & (hashes != END)]
        else:
            contexts = total[seen]
        values, often = B.distinct(np.sort(contexts))
        powers = (values[None, :].astype(float) ** GRID[:, None] * often).sum(1).tolist()
        rows = [(grp, b, B.squeeze(x), 0, 0, 0, 0, None) for b, x in zip(table["block"].to_pylist(), parts, strict=True)]
        rows.append((grp, -1, b"", int(total[seen].sum()), int(seen.sum()), int((total[seen] == 1).sum()), int((total[seen] == 2).sum()), powers))
        kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.list_(pa.float64())]
        return pa.table([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ANSWER.split(", ")])

    return run


def _model(answers: DataFrame, order: int) -> Model:
    """The model's figures: a handful of sums for each length."""
    per = answers.filter("block = -1").groupBy(F.shiftright("grp", 40).alias("n"))
    found = {r["n"]: r for r in per.agg(*[F.sum(c).alias(c) for c in ("words", "types", "once", "twice")], F.array(*[F.sum(F.col("powers")[i]) for i in range(len(GRID))]).alias("powers")).collect()}
    discount, heaps = {}, {}
    for n in range(2, order + 1):
        if n not in found or n - 1 not in found or not found[n]["types"]:
            discount[n], heaps[n] = 0.5, 0.5
            continue
        r = found[n]
        discount[n] = min(0.95, max(0.05, r["once"] / (r["once"] + 2 * r["twice"]))) if r["once"] else 0.5
        heaps[n] = float(np.interp(np.log(r["types"]), np.log(np.maximum(found[n - 1]["powers"], 1e-9)), GRID))
    one = found.get(1)
    return Model(one["words"] if one else 0, one["types"] if one else 0, discount, heaps)


class Automaton:
    """The part of the automaton that one block's texts can reach.

    ``number[n]`` names the n-gram that ends at each token. As an arc, n-gram i of length n has ``weight[n][i]`` (log10)
    where ``known[n][i]``; as a state, it fails to its shorter suffix with ``failure[n][i]``.
    """

    def __init__(self, found: dict[int, tuple[np.ndarray, np.ndarray]], counts: dict[int, np.ndarray], model: Model):
        self.order = max(found)
        self.number, self.known, self.weight, self.failure = {}, {}, {}, {}
        below = None
        for n, (g, valid) in found.items():
            place = np.flatnonzero(valid)
            by = np.argsort(g[place], kind="stable")
            ranked = g[place][by]
            new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, bool)
            number = np.full(len(g), -1, np.int64)
            number[place[by]] = np.cumsum(new) - 1
            at, c = place[by][new], counts[n]  # a place of each n-gram; the counts came in the order of the hashes
            if n == 1:
                chance = (c + 0.5) / (model.words + 0.5 * (model.vocabulary + 1))
            else:
                context = counts[n - 1][self.number[n - 1][at - 1]]
                left = self._left(context, n, model)
                chance = (1 - left) * c / np.maximum(context, 1) + left * below[self.number[n - 1][at]]
            self.number[n], self.known[n] = number, c > 0
            with np.errstate(divide="ignore"):
                self.weight[n] = np.log10(chance)
            if n < self.order:
                self.failure[n] = np.log10(self._left(c, n + 1, model))
            below = chance

    @staticmethod
    def _left(context: np.ndarray, n: int, model: Model) -> np.ndarray:
        """What a context leaves to its shorter one (all, if it was never seen)."""
        return np.where(context > 0, model.discount[n] * np.maximum(context, 1) ** (model.heaps[n] - 1), 1.0)

    def traverse(self, begin: np.ndarray, own: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log10 probability of each lane: a stretch of tokens from ``own`` to ``end``, all lanes one token a step.

        A lane starts at the root, reads the tokens from ``begin`` on only for their state, and then carries its state
        (the length of the context it is in) along: the arc of the next word if the state has one, else the failure arc,
        until a shorter state or the root has one.
        """
        by = np.argsort(begin - end, kind="stable")
        begin, own, end = begin[by], own[by], end[by]
        longest_first = end - begin
        state, total = np.zeros(len(by), np.int64), np.zeros(len(by))
        for step in range(int(longest_first[0]) if len(by) else 0):
            m = int(np.searchsorted(-longest_first, -step, "left"))
            at = begin[:m] + step
            here, gain = state[:m].copy(), np.zeros(m)
            reached = np.full(m, -1, np.int64)  # length of the n-gram whose arc was taken
            for n in range(self.order - 1, 0, -1):
                tried = np.flatnonzero((here == n) & (reached < 0))
                if not len(tried):
                    continue
                arc = self.number[n + 1][at[tried]]
                some = self.known[n + 1][arc]
                hit, miss = tried[some], tried[~some]
                gain[hit] += self.weight[n + 1][arc[some]]
                reached[hit] = n + 1
                gain[miss] += self.failure[n][self.number[n][at[miss] - 1]]
                here[miss] = n - 1
            rest = np.flatnonzero(reached < 0)
            word = self.number[1][at[rest]]
            gain[rest] += self.weight[1][word]
            reached[rest] = self.known[1][word]
            state[:m] = np.minimum(reached, self.order - 1)
            total[:m] += np.where(at >= own[:m], gain, 0)
        out = np.empty(len(by))
        out[by] = total
        return out


def lanes(t: Tokens, order: int, width: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of at most ``width`` own tokens: where their context begins, where they begin and end, and their row."""
    places = np.flatnonzero(t.own)
    if not len(places):
        return (np.zeros(0, np.int64),) * 4
    new = np.concatenate(([True], t.row[places][1:] != t.row[places][:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
    head = np.flatnonzero((np.arange(len(places)) - start) % width == 0)
    own, end = places[head], places[np.append(head[1:], len(places)) - 1] + 1
    return np.maximum(t.first[own], own - (order - 1)), own, end, t.row[own]


SCORED = "key string, doc_id long, held boolean, n_tokens long, n_known long, base_score double, score double"


def _walk(order: int, buckets: B.Buckets, model: Model):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answers = sorted(zip(right["grp"].to_pylist(), right["counts"].to_pylist(), strict=True))
        counts = {n: np.concatenate([np.zeros(0, np.int64), *[B.expand(x) for g, x in answers if g >> 40 == n]]) for n in range(1, order + 1)}
        for batch in left.to_batches():
            for rows in B.read(batch, ["doc_id", "held"]):
                t = tokens(rows)
                machine = Automaton(grams(t, order), counts, model)
                begin, own, end, of = lanes(t, order)
                n = len(rows.offsets) - 1
                word, row = machine.number[1][t.own], t.row[t.own]
                add = lambda where, x: np.bincount(where, weights=x, minlength=n)
                columns = {"key": rows.key, "doc_id": rows.columns["doc_id"], "held": rows.columns["held"], "n_tokens": np.bincount(row, minlength=n), "n_known": add(row, machine.known[1][word]).astype(np.int64), "base_score": add(row, machine.weight[1][word]), "score": add(of, machine.traverse(begin, own, end))}
                out.append(C.record_batch(columns, SCORED))
        return pa.Table.from_batches(out, C.record_batch({x.split()[0]: [] for x in SCORED.split(", ")}, SCORED).schema)

    return run


def score(docs: DataFrame, held: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", size: int = B.BLOCK) -> DataFrame:
    """Scores every row of ``docs`` by a model of the rows for which ``held`` isn't true.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score: base_score sums log10 of the
    add-a-half unigrams, score the automaton's log10 probabilities. A null or empty text is its end mark alone; repeated
    rows count, and are returned, each; an empty table gives none; null ids are kept. Texts above ``size`` bytes are
    walked in parts, each from the state in which the one before ended, and their sums added. Only the named columns are
    read, so the names of others don't matter.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    stored = B.blocks(rows, {"doc_id": "long", "held": "boolean"}, last_words(order - 1), size)
    buckets = B.buckets_for(stored)
    asked = stored.mapInArrow(_ask(order, buckets), B.REQUEST)
    answers = C.store(asked.groupBy("grp").applyInArrow(_answer(buckets), ANSWER), "ngrams", codec="none")
    model = _model(answers, order)
    walked = stored.groupBy("block").cogroup(answers.filter("block >= 0").select("block", "grp", "counts").groupBy("block")).applyInArrow(_walk(order, buckets, model), SCORED)
    scored = C.store(walked, "scores")
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    parts = scored.filter("key IS NOT NULL").groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("held").alias("held"), *sums).select(*scored.columns)
    return scored.filter("key IS NULL").unionByName(parts).select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(model.words).cast("long").alias("train_tokens"), "base_score", "score")
