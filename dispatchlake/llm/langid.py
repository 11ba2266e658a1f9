"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. An n-gram's vector is the elementwise product of its letters'
vectors, each rotated by its place; a text's is the sum over its n-grams. Languages are such sums over labelled texts.
A text gets the language whose profile has the largest cosine with its vector.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DIMENSIONS = 1024
GRAM = 3
SYMBOLS = 128  # 0 is any run of other characters; letters share the rest
BLOCK = 32_768  # n-grams whose vectors are in memory at once
SAMPLE = 20_000  # labelled texts that the profiles are learned from, at most


class Letters:
    """Symbols of characters and their random vectors."""

    def __init__(self, dimensions: int = DIMENSIONS):
        rng = np.random.default_rng(41)
        vectors = rng.integers(0, 2, (SYMBOLS, dimensions), dtype=np.int8) * 2 - 1
        self.rotated = [np.ascontiguousarray(np.roll(vectors, k, axis=1)) for k in range(GRAM)]
        self.table = np.zeros(0x110000, np.uint8)
        for cp in range(0x3000):
            c = chr(cp)
            if unicodedata.category(c)[0] == "L":
                low = ord(c.lower()[0])
                self.table[cp] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
        for cp in range(0x3000, 0x110000):  # other scripts: letters by Unicode category
            if unicodedata.category(chr(cp))[0] == "L":
                self.table[cp] = 27 + cp % (SYMBOLS - 27)

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct n-grams (as numbers) of a text and their counts; None without a letter."""
        s = self.table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        if not s.any():
            return None
        s = np.concatenate(([0], s, [0]))
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))].astype(np.int64)  # one blank between words
        s = np.concatenate((s, np.zeros(max(0, GRAM - len(s)), np.int64)))
        code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
        return np.unique(code, return_counts=True)

    def bind(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = codes // (SYMBOLS * SYMBOLS), codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
        return self.rotated[2][a] * self.rotated[1][b] * self.rotated[0][c]


def _groups(grams: Iterator) -> Iterator[list]:
    """Texts' n-grams in runs of at most about BLOCK, so that their vectors fit in memory."""
    held, n = [], 0
    for g in grams:
        if g and len(g[0]) > BLOCK:  # alone
            if held:
                yield held
            yield [g]
            held, n = [], 0
            continue
        held.append(g)
        n += len(g[0]) if g else 0
        if n >= BLOCK:
            yield held
            held, n = [], 0
    if held:
        yield held


def _vectors(space: Letters, found: list) -> Iterator[np.ndarray | None]:
    """Vector of each text of a run; n-grams that texts share are bound once, those of one huge text block by block."""
    full = [x for x in found if x]
    if len(full) > 1 or full and len(full[0][0]) <= BLOCK:
        codes, where = np.unique(np.concatenate([x[0] for x in full]), return_inverse=True)
        bound = space.bind(codes).astype(np.float32)
    at = 0
    for x in found:
        if x is None:
            yield None
        elif len(full) == 1 and len(x[0]) > BLOCK:
            yield sum(x[1][k : k + BLOCK].astype(np.float32) @ space.bind(x[0][k : k + BLOCK]).astype(np.float32) for k in range(0, len(x[0]), BLOCK))
        else:
            n = len(x[0])
            yield x[1].astype(np.float32) @ bound[where[at : at + n]]
            at += n


_letters: dict[int, Letters] = {}


def letters(dimensions: int) -> Letters:
    if dimensions not in _letters:
        _letters[dimensions] = Letters(dimensions)
    return _letters[dimensions]


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit profiles of the languages named in docs, from about ``sample`` of its labelled texts at most.

    Each language gets an equal part of the sample, so a rare one is learned from all its texts. The texts are chosen by
    a hash of id and text: the choice is stable, and copies under different ids don't enter together. Each task sums its
    texts' n-grams by language; only these sums (one vector for a task and language) are moved, and the driver gets one
    for a language. Rows without text or language teach nothing.
    """
    C.prepare(docs.sparkSession)
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not sizes:
        return {}
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / len(sizes) / n))])
    labelled = labelled.filter(F.pmod(F.col("h"), F.lit(1_000_003)) < shares[F.col("lang")] * 1_000_003).select("text", "lang")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = letters(dimensions), {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found := space.grams(text):
                    codes, n = found
                    v = n.astype(np.float32) @ space.bind(codes).astype(np.float32)
                    sums[lang] = sums.get(lang, 0) + (v / max(1e-9, np.linalg.norm(v))).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = labelled.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "x"))
    total = parts.groupBy("lang", "k").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v"))
    profiles = {r["lang"]: np.array([x["x"] for x in r["v"]]) for r in total.collect()}
    return {k: v / max(1e-9, np.linalg.norm(v)) for k, v in sorted(profiles.items())}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the nearest profile and the cosine, 0 to 1.

    ``und`` and 0 for texts that are null or have no letter, and for all texts if there is no profile. Ties go to the
    first language by name. Texts are read whole, those with very many n-grams block by block. Repeated rows are each
    predicted, an empty table gives no rows. Only the two columns are read, so the names of others don't matter.
    """
    C.prepare(docs.sparkSession)
    names = list(profiles)
    matrix = np.stack([profiles[k] for k in names], 1).astype(np.float32) if names else np.zeros((DIMENSIONS, 0), np.float32)
    dimensions = matrix.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = letters(dimensions)
        for batch in batches:
            lang, score = [], []
            texts = batch.column(1).to_pylist()
            for found in _groups(space.grams(t) if t else None for t in texts):
                for v in _vectors(space, found):
                    cos = v @ matrix / max(1e-9, float(np.linalg.norm(v))) if v is not None and names else None
                    best = int(np.argmax(cos)) if cos is not None else -1
                    lang.append("und" if cos is None else names[best])
                    score.append(0.0 if cos is None else float(min(1.0, max(0.0, cos[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
