"""License scans: winnowed fingerprints find candidate templates, a banded alignment measures them.

Templates are cut into words; hashes of word k-grams are winnowed (the smallest of each window) into an inverted index
of fingerprint -> (template, place), which is small and goes to every task. A text's fingerprints that meet the index
name a template and a diagonal; around each the words of both are aligned within a band, which allows for inserted,
lost and replaced words, until nothing more is found there, so copies close together are each reported with the matched
part of the template and the span in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .license_texts import TEMPLATES

GRAM = 3
WINDOW = 2  # any GRAM + WINDOW - 1 common words in a row are found
BAND = 8
COVERAGE = 0.75
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of letters and digits, without regard to case): starts, ends, row, hash."""
    starts, ends, row = C.runs(_WORD[raw], offsets)
    return starts, ends, row, C.word_hashes(raw, starts, ends, C.FOLDED_CODES)


def fingerprints(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the winnowed k-grams of word hashes; rows begin at ``first``. Short rows keep their one k-gram."""
    if len(h) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = C.mix(sum((h[k : len(h) - GRAM + 1 + k] * C.PLACES[k] for k in range(1, GRAM)), h[: len(h) - GRAM + 1] * C.PLACES[0]))
    row = np.searchsorted(first, np.arange(len(g)), "right") - 1
    inside = np.arange(len(g)) + GRAM <= first[row + 1]
    g = np.where(inside, g, np.uint64(2**64 - 1))
    keep = np.zeros(len(g), bool)
    near = np.stack([np.concatenate((g[k:], np.full(k, 2**64 - 1, np.uint64))) for k in range(WINDOW)], 1)
    whole = np.arange(len(g)) + WINDOW - 1 + GRAM <= first[row + 1]
    at = np.arange(len(g)) + near.argmin(1)
    keep[at[whole]] = True
    lone = (first[1:] - first[:-1] >= GRAM) & (first[1:] - first[:-1] < GRAM + WINDOW - 1)
    for a, b in zip(first[:-1][lone], first[1:][lone], strict=True):
        keep[a : b - GRAM + 1] = True
    keep &= inside
    return np.flatnonzero(keep), g[keep]


def align(text: list[int], template: list[int], shift: int, taken: bytearray, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, end) of the best alignment of a template with a text near the diagonal ``shift``.

    Cells further than ``band`` from the diagonal and words that are ``taken`` are not visited; a match scores 2, any
    edit -1, and the alignment may begin and end anywhere.
    """
    best, above = (0, 0, 0, 0), {}
    for i in range(len(template)):
        here: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, shift + i - band), min(len(text), shift + i + band + 1)):
            if taken[j]:
                continue
            s, m, a = above.get(j - 1, (0, 0, j))
            cell = (s + 2, m + 1, a) if text[j] == template[i] else (s - 1, m, a)
            cell = max([cell, *((x[0] - 1, x[1], x[2]) for x in (above.get(j), here.get(j - 1)) if x)], key=lambda x: x[0])
            if cell[0] > 0:
                here[j] = cell
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], j + 1)
        above = here
    return best[1], best[2], best[3]


def extend(text: list[int], template: list[int], band: int = BAND) -> tuple[int, int]:
    """(matched words, text words) of the best alignment that begins with the first words of both."""
    best, above = (0, 0, 0), {j: (-j, 0) for j in range(min(len(text), band) + 1)}
    for i in range(1, len(template) + 1):
        here: dict[int, tuple[int, int]] = {}
        for j in range(max(0, i - band), min(len(text), i + band) + 1):
            ways = [(x[0] - 1, x[1]) for x in (above.get(j), here.get(j - 1)) if x]
            if j and j - 1 in above:
                s, m = above[j - 1]
                ways.append((s + 2, m + 1) if text[j - 1] == template[i - 1] else (s - 1, m))
            here[j] = max(ways, key=lambda x: x[0])
            if here[j][0] > best[0]:
                best = (*here[j], j)
        above = here
    return best[1], best[2]


def through(text: list[int], template: list[int], p: int, q: int) -> tuple[int, int, int]:
    """As align, for the best alignment that lays the text's k-gram at ``p`` on the template's at ``q``."""
    far = len(template) + BAND
    left = extend(text[max(0, p - far) : p][::-1], template[:q][::-1])
    right = extend(text[p + GRAM : p + GRAM + far], template[q + GRAM :])
    return left[0] + GRAM + right[0], p - left[1], p + GRAM + right[1]


class Index:
    """Fingerprints of the templates -> (template, place)."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.words, at = list(templates), [], {}
        for t, text in enumerate(templates.values()):
            raw = np.frombuffer(text.encode(), np.uint8)
            h = words(raw, np.array([0, len(raw)]))[3]
            self.words.append(h.tolist())
            for p, g in zip(*fingerprints(h, np.array([0, len(h)])), strict=True):
                at.setdefault(int(g), []).append((t, int(p)))
        self.at = at
        self.arrays = [np.array(x, np.uint64) for x in self.words]
        self.keys = np.array(sorted(at), np.uint64)

    def scan(self, h: np.ndarray, places: np.ndarray, prints: np.ndarray, coverage: float) -> list[tuple[str, int, int, int, int]]:
        """(template, matched, template words, first word, end word) of a text's best, non-overlapping matches."""
        text = h.tolist()
        far = max(map(len, self.words)) + BAND
        padded = np.concatenate((np.zeros(far, np.uint64), h, np.zeros(2 * far, np.uint64)))

        @cache
        def could(t: int, shift: int) -> bool:
            """Whether enough of a template's words stand within the band of a diagonal, wherever in it."""
            template, there = self.arrays[t], np.zeros(len(self.words[t]), bool)
            for d in range(-BAND, BAND + 1):
                there |= padded[far + shift + d : far + shift + d + len(template)] == template
            return np.count_nonzero(there) >= coverage * len(template)

        lays: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for p, g in zip(places.tolist(), prints.tolist(), strict=True):
            for t, q in self.at[g]:
                lays.setdefault((t, p - q), []).append((p, q))
        found, met = set(), {t: bytearray(len(text)) for t, _ in lays}
        possible = {x for x in lays if could(*x)}
        for t, shift in possible:  # every diagonal; what was found near it is taken, and the rest aligned again
            need, taken = coverage * len(self.words[t]), bytearray(len(text))
            while (x := align(text, self.words[t], shift, taken))[0] >= need:
                found.add((x[0], t, *x[1:]))
                for seen in (taken, met[t]):
                    seen[x[1] : x[2]] = b"\1" * (x[2] - x[1])
        for (t, _), hits in lays.items():  # a damaged copy may stand beside a better one or a long fragment
            for p, q in hits:
                if not all(met[t][p : p + GRAM]) and could(t, p - q):
                    m, a, b = through(text, self.words[t], p, q)
                    if m >= coverage * len(self.words[t]):
                        found.add((m, t, a, b))
                        met[t][a:b] = b"\1" * (b - a)
        out, used = [], bytearray(len(text))
        for m, t, a, b in sorted(found, key=lambda x: (-x[0], -x[0] / len(self.words[x[1]]), x[1], x[2])):
            if not any(used[a:b]):
                out.append((m, t, a, b))
                used[a:b] = b"\1" * (b - a)
        return [(self.names[t], m, len(self.words[t]), a, b) for m, t, a, b in sorted(out, key=lambda x: x[2])]


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, matched, template_words, coverage, first_word, end_word, start_byte, end_byte) of each match.

    Of overlapping matches the one with most words counts, at a tie the one that covers more of its template, then the
    template given first. Null and empty texts have none; repeated rows are each reported, null ids too. Whole texts are
    scanned, however long; an empty table has no matches. Only the two columns are read, so the names of others don't
    matter. Each license is told by all its words: BSD texts of two and three clauses, or GNU versions, by the best.
    """
    C.prepare(docs.sparkSession)
    given = templates or TEMPLATES
    kind = "doc_id long, license string, matched long, template_words long, coverage double, first_word long, end_word long, start_byte long, end_byte long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(given)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, raw, offsets in C.text_chunks(batch, "text"):
                starts, ends, row, h = words(raw, offsets)
                first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=hi - lo)))).astype(np.int64)
                places, prints = fingerprints(h, first)
                hit = np.isin(prints, index.keys)
                places, prints = places[hit], prints[hit]
                owner = np.searchsorted(first, places, "right") - 1
                rows = []
                for i in np.unique(owner):
                    a, b = first[i], first[i + 1]
                    mine = owner == i
                    for name, m, n, x, y in index.scan(h[a:b], places[mine] - a, prints[mine], coverage):
                        rows.append((ids[lo + i], name, m, n, m / n, x, y, int(starts[a + x] - offsets[i]), int(ends[a + y - 1] - offsets[i])))
                if rows:
                    yield C.record_batch(dict(zip([x.split()[0] for x in kind.split(", ")], map(list, zip(*rows, strict=True)), strict=True)), kind)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kind)
