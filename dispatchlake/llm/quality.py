"""Quality classifier: gradient-boosted trees with histograms over statistics of the whole text.

The trees are learned on a bounded sample of labelled documents and kept as flat arrays (feature, threshold, children,
value), so that scoring is a few array look-ups for all rows of a chunk at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 20_000  # labelled documents used for learning, at most
FEATURES = [
    "log_bytes", "log_words", "upper", "digits", "signs", "marks", "blank", "not_ascii", "newlines", "word_length", "word_length_sd", "longest_word",
    "distinct_words", "same_as_before", "top_word", "repeated_shingles", "shingle_twice", "repeated_lines", "words_end_in_sign", "sign_words", "upper_words", "words_per_line", "words_per_stop",
]
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~"]] = 3
_KIND[[ord(c) for c in "!\"'(),-.:;?[]"]] = 4
_KIND[[32, 9, 10, 11, 12, 13]] = 5
_KIND[128:] = 6
_HARD = np.isin(np.arange(256), [ord(c) for c in "!#$%&*+/<=>@\\^_`{|}~"])


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(x)))[bounds]).astype(np.float64)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Feature matrix (rows x FEATURES) of a chunk of texts."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    per_byte = 1 / np.maximum(size, 1)
    kind = _KIND[raw]
    f = dict.fromkeys(FEATURES, np.zeros(rows))
    f["log_bytes"] = np.log1p(size)
    for k, name in enumerate(("upper", "digits", "signs", "marks", "blank", "not_ascii"), 1):
        f[name] = _sums(kind == k, offsets) * per_byte
    f["newlines"] = _sums(raw == 10, offsets) * per_byte
    starts, ends, row = C.ascii_words(raw, offsets)
    n = np.bincount(row, minlength=rows).astype(np.float64)
    first = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
    each = 1 / np.maximum(n, 1)
    h = C.word_hashes(raw, starts, ends, C.FOLDED_CODES)
    length = (ends - starts).astype(np.float64)
    f["log_words"] = np.log1p(n)
    mean = _sums(length, first) * each
    f["word_length"] = mean
    f["word_length_sd"] = np.sqrt(np.maximum(_sums(length * length, first) * each - mean * mean, 0))
    pairs = np.zeros(len(h), bool)
    if len(h) > 1:
        pairs[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    f["same_as_before"] = _sums(pairs, first) * each
    f["words_end_in_sign"] = _sums(_HARD[raw[ends - 1]] if len(ends) else pairs, first) * each
    f["sign_words"] = _sums((length == 1) & _HARD[raw[starts]] if len(starts) else pairs, first) * each
    ups = np.concatenate(([0], np.cumsum(kind == 1)))
    f["upper_words"] = _sums((ups[ends] - ups[starts] >= 2) if len(ends) else pairs, first) * each
    f["words_per_line"] = np.log1p(n / (1 + _sums(raw == 10, offsets)))
    f["words_per_stop"] = np.log1p(n / (1 + _sums(raw == 46, offsets)))
    longest, distinct, top, again, lines = (np.zeros(rows) for _ in range(5))
    shingle, at = _shingles(h, first)
    line_start, line_end, line_row = C.runs(raw != 10, offsets)
    line_hash = C.word_hashes(raw, line_start, line_end)
    line_first = np.concatenate(([0], np.cumsum(np.bincount(line_row, minlength=rows))))
    twice = np.zeros(rows)
    for i in range(rows):
        a, b = first[i], first[i + 1]
        if b > a:
            longest[i] = length[a:b].max()
            _, c = np.unique(h[a:b], return_counts=True)
            distinct[i], top[i] = len(c) / (b - a), c.max() / (b - a)
            a, b = at[i], at[i + 1]
            _, c = np.unique(shingle[a:b], return_counts=True)
            again[i], twice[i] = 1 - len(c) / (b - a), (c == 2).sum() / len(c)
        a, b = line_first[i], line_first[i + 1]
        if b - a > 1:
            lines[i] = 1 - len(np.unique(line_hash[a:b])) / (b - a)
    f |= {"longest_word": np.log1p(longest), "distinct_words": distinct, "top_word": top, "repeated_shingles": again, "shingle_twice": twice, "repeated_lines": lines}
    return np.stack([f[k] for k in FEATURES], 1).astype(np.float32)


def _shingles(h: np.ndarray, first: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)
    m = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(m)))
    i = np.arange(at[-1]) - np.repeat(at[:-1], m) + np.repeat(first[:-1], m)
    padded = np.concatenate((h, np.zeros(width, np.uint64)))
    return sum((padded[i + k] * C.PLACES[k] for k in range(width)), np.zeros(len(i), np.uint64)), at


@dataclass
class Trees:
    """Flattened trees: node i sends a row to left[i] if its feature is at most cut[i], else to right[i]; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.repeat(self.roots[None, :], len(x), 0)
        which = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[which, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss; splits are found on histograms of quantile bins."""
    n, m = x.shape
    p0 = min(1 - 1e-3, max(1e-3, float(y.mean()))) if n else 1 - 1e-3
    base = float(np.log(p0 / (1 - p0)))
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
        code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1)
        flat = code + np.arange(m) * bins
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, w = p - y, np.maximum(p * (1 - p), 1e-6)

            def grow(rows: np.ndarray, level: int, g=g, w=w) -> int:
                me = len(feature)
                for part, v in ((feature, 0), (cut, 0.0), (left, me), (right, me), (value, -rate * g[rows].sum() / (w[rows].sum() + ridge))):
                    part.append(v)
                if level == depth or len(rows) < 2 * least:
                    margin[rows] += value[me]
                    return me
                own = flat[rows].ravel()
                hist = [np.bincount(own, None if v is None else np.repeat(v[rows], m), m * bins).reshape(m, bins).cumsum(1) for v in (g, w, None)]
                gl, wl, cl = hist
                gt, wt, ct = gl[:, -1:], wl[:, -1:], cl[:, -1:]
                gain = gl**2 / (wl + ridge) + (gt - gl) ** 2 / (wt - wl + ridge) - gt**2 / (wt + ridge)
                gain[(cl < least) | (ct - cl < least)] = 0
                j, k = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[j, k] <= 1e-6 or k >= len(edges[j]):
                    margin[rows] += value[me]
                    return me
                low = code[rows, j] <= k
                value[me], feature[me], cut[me] = 0.0, int(j), float(edges[j][k])
                left[me] = grow(rows[low], level + 1)
                right[me] = grow(rows[~low], level + 1)
                return me

            roots.append(grow(np.arange(n), 0))
    return Trees(np.array(feature, np.int32), np.array(cut, np.float32), np.array(left, np.int32), np.array(right, np.int32), np.array(value), np.array(roots, np.int32), depth, base)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, offsets in C.text_chunks(batch, "text"):
            x = statistics(raw, offsets)
            own = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([own.column(0).cast(pa.int64()), own.column(1), pa.array(x.tolist(), pa.list_(pa.float32()))], names=["id", "y", "x"])


def held_out(ids: Column) -> Column:
    """Whether a document belongs to the fifth that nothing is learned from."""
    return F.crc32(ids.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees from at most ``sample`` labelled documents outside the held-out fifth: those whose ids have the smallest hashes.

    The choice depends on the ids alone. The chosen ids are at most ``sample`` rows and are broadcast; their statistics
    (some 20 numbers a document) come to the driver. An id with several labels has the larger one; of an id with several
    texts one is taken, by its statistics. Without labels or documents every score is near 1.
    """
    C.prepare(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(target).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL").filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(known), "id").select("id", "y", "text").mapInArrow(_features, "id long, y int, x array<float>")
    rows = found.groupBy("id", "y").agg(F.min("x").alias("x")).select("y", "x").toArrow()
    x = np.array(rows["x"].to_pylist(), np.float32).reshape(-1, len(FEATURES))
    y = rows["y"].to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # the same trees whatever order the rows come in
    return fit(x[order], y[order])


def score(docs: DataFrame, trees: Trees, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the column ``out``: probability of label 1.

    Null texts count as empty, and texts of any length are read whole. Every row is scored by its own text, so repeated
    rows get the same score; an empty table gives no rows. A column named ``out`` is replaced, all others pass through.
    """
    C.prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    body_col = C.fresh("body", docs.columns)
    body = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias(body_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [trees.score(statistics(raw, offsets)) for _, _, raw, offsets in C.text_chunks(batch, body_col)]
            found = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*kept, out])

    kind = body.drop(body_col).withColumn(out, F.lit(0.0)).schema
    return body.mapInArrow(run, kind)
