"""Packing of tokenised documents into fixed windows by best-fit decreasing.

Every document becomes ids plus an end id. One longer than a window is first cut into full windows; what is left is
packed. Pieces are dealt by a hash of their number into groups of some thousand, and each group is packed on its own:
longest first, each into the open window with the least room that holds it. A segment tree over the remaining
capacities finds that window in a few steps. A group leaves at most a few windows half open, so the padding lost to
grouping is well below a tenth of a percent; groups grow in number, not in size, with the corpus.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 2048
END_ID = 1
GROUP = 4000  # pieces packed together
LONG = 8 << 20  # bytes of a text beyond which it is encoded in blocks
_ASCII_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_LETTER, _NUMBER, _SPACE = 1, 2, 3
_FAST_BELOW = 0x3000  # texts with later code points go to the tokenizer whole
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


class WordPieces:
    """Ids of many texts at once by a byte-level BPE tokenizer.

    Such a tokenizer cuts a text into words before it merges bytes, so equal words have equal ids wherever they stand.
    The words of a whole chunk are found with array operations, and only words not seen before go to the tokenizer.
    """

    def __init__(self, path: str, capacity: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.capacity = capacity
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        #: Added tokens are cut out before words are. Those that also take blanks beside them, want a free-standing
        #: place or are looked for in normalised text are left to the tokenizer.
        plain = [t for t in added if not (t.lstrip or t.rstrip or t.single_word or t.normalized and self.tokenizer.normalizer)]
        self.literals = _any_of([t.content for t in plain])
        self.others = _any_of([t.content for t in added if t not in plain])
        self._clear()
        self.classes = np.zeros(_FAST_BELOW + 1, np.uint8)
        for cp in range(_FAST_BELOW):
            self.classes[cp] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(cp))[0], 0)
        self.classes[_WHITE] = _SPACE

    def _clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _word_starts(self, cp: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where words begin: a word is a run of letters, of numbers or of signs with the one blank before it, a
        contraction, or white space without the last character before a word."""
        k = self.classes[np.minimum(cp, _FAST_BELOW)]
        n = len(cp)
        edge = np.zeros(n + 1, bool)
        edge[rows] = True
        edge[n] = True
        begin = edge[:n].copy()
        begin[1:] |= k[1:] != k[:-1]
        gap_end = np.flatnonzero((k[:-1] == _SPACE) & (k[1:] != _SPACE) & ~edge[1:n]) + 1
        begin[gap_end - 1] = True
        begin[gap_end[cp[gap_end - 1] == 32]] = False
        quote = np.flatnonzero((cp == 39) & begin)
        quote = quote[~edge[quote + 1]]
        quote = quote[k[quote + 1] == _LETTER]
        one = np.isin(cp[quote + 1], [ord(c) for c in "stmd"])
        room = ~edge[quote + 1] & (quote + 2 < n)
        nxt = np.where(room, cp[np.minimum(quote + 2, n - 1)], 0)
        room &= ~edge[np.minimum(quote + 2, n)]
        a = cp[quote + 1]
        two = room & (((a == ord("r")) | (a == ord("v"))) & (nxt == ord("e")) | (a == ord("l")) & (nxt == ord("l")))
        begin[quote[one | two] + 1] = False
        after = np.concatenate((quote[one] + 2, quote[two] + 3))
        begin[after[after < n]] = True
        return np.flatnonzero(begin)

    def _known(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slot of each span's ids."""
        h = C.word_hashes(raw, starts, ends)
        keys, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.slots) > self.capacity:
            self._clear()
        slot = np.array([self.slots.get(x, -1) for x in keys.tolist()], np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            data = raw.tobytes()
            words = [data[starts[i] : ends[i]].decode() for i in where[new]]
            found = [x.ids for k in range(0, len(words), 4096) for x in self.tokenizer.encode_batch_fast(words[k : k + 4096], add_special_tokens=False)]
            first, n = len(self.slots), np.array([len(x) for x in found], np.int64)
            while self.used + n.sum() > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            while first + len(new) > len(self.start):
                self.start, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.count))
            self.flat[self.used : self.used + n.sum()] = np.concatenate([np.array(x, np.uint32) for x in found])
            self.start[first : first + len(new)] = self.used + np.cumsum(n) - n
            self.count[first : first + len(new)] = n
            self.used += int(n.sum())
            slot[new] = first + np.arange(len(new))
            self.slots.update(zip(keys[new].tolist(), slot[new].tolist(), strict=True))
        return slot[back]

    def long(self, raw: np.ndarray, size: int | None = None) -> np.ndarray:
        """Ids of one long text, block by block: it is cut before a blank between two ASCII letters, where a word begins
        whatever follows. Without such a place for ``size`` bytes, the block goes on to the next one."""
        size = size or LONG // 2
        letter = _ASCII_LETTER[raw]
        safe = np.flatnonzero((raw[1:-1] == 32) & letter[:-2] & letter[2:]) + 1
        taken = [m.span() for m in (self.literals.finditer(raw.tobytes()) if self.literals else ())]
        if taken:  # not within an added token
            taken = np.array(taken)
            k = np.searchsorted(taken[:, 0], safe, "left") - 1
            safe = safe[(k < 0) | (safe >= taken[np.maximum(k, 0), 1])]
        if self.others and self.others.search(raw.tobytes()):
            safe = safe[:0]
        out, a = [], 0
        while a < len(raw):
            k = int(np.searchsorted(safe, a + size))
            b = int(safe[k]) if k < len(safe) else len(raw)
            out += self.rows(raw[a:b], np.array([0, b - a]))
            a = b
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def rows(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a chunk of UTF-8."""
        n = len(offsets) - 1
        lead = (raw & 0xC0) != 0x80
        chars = np.concatenate(([0], np.cumsum(lead)))[offsets]
        at = np.append(np.flatnonzero(lead), len(raw))  # byte of each character
        data = raw.tobytes()
        cp = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        slow = np.zeros(n, bool)
        if len(cp) and cp.max() >= _FAST_BELOW:
            odd = np.concatenate(([0], np.cumsum(cp >= _FAST_BELOW)))[chars]
            slow = np.diff(odd) > 0
        for m in self.others.finditer(data) if self.others else ():
            slow[np.searchsorted(offsets, m.start(), "right") - 1] = True
        spans = [m.span() for m in self.literals.finditer(data)] if self.literals else []
        spans = np.searchsorted(at, np.array([x for x in spans if offsets[np.searchsorted(offsets, x[0], "right")] >= x[1]], np.int64).reshape(-1, 2))
        edges = np.union1d(chars[:-1], spans)
        starts = self._word_starts(cp, edges[edges < len(cp)]) if len(cp) else np.zeros(0, np.int64)
        if len(spans):  # an added token is one word
            inside = np.searchsorted(spans[:, 0], starts, "left") - 1
            starts = starts[(inside < 0) | (starts >= spans[np.maximum(inside, 0), 1])]
        ends = np.append(starts[1:], len(cp)) if len(starts) else starts
        row = np.searchsorted(chars, starts, "right") - 1
        fast = ~slow[row] if len(row) else np.zeros(0, bool)
        starts, ends, row = starts[fast], ends[fast], row[fast]
        ids = np.zeros(0, np.uint32)
        per_row = np.zeros(n, np.int64)
        if len(starts):
            slot = self._known(raw, at[starts], at[ends])
            count = self.count[slot]
            per_row = np.bincount(row, weights=count, minlength=n).astype(np.int64)
            total = int(count.sum())
            first = np.cumsum(count) - count
            ids = self.flat[np.repeat(self.start[slot] - first, count) + np.arange(total)]
        out = np.split(ids, np.cumsum(per_row)[:-1])
        for i in np.flatnonzero(slow):
            out[i] = self.encode(data[offsets[i] : offsets[i + 1]].decode())
        return out


def _any_of(contents: list[str]) -> re.Pattern | None:
    return re.compile(b"|".join(re.escape(x.encode()) for x in sorted(contents, key=len, reverse=True))) if contents else None


_loaded: dict[str, WordPieces] = {}


def word_pieces(path: str) -> WordPieces:
    """The worker's encoder of a tokenizer file; tasks that follow on the same worker find its words."""
    if path not in _loaded:
        _loaded[path] = WordPieces(path)
    return _loaded[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _cut(path: str | None, window: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_pieces(path or default_tokenizer())
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            doc_ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for lo, _, raw, offsets in C.text_chunks(batch, "text", 1 << 19):
                out: dict = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                found = words.rows(raw, offsets) if len(offsets) > 2 or len(raw) <= LONG else [words.long(raw)]
                for i, own in enumerate(found):
                    ids = np.concatenate((own, end)).astype("<u4")
                    for a in range(0, len(ids), window):
                        piece = ids[a : a + window]
                        for k, v in (("doc_id", doc_ids[lo + i]), ("start", a), ("length", len(piece)), ("ids_crc32", zlib.crc32(piece.tobytes())), ("doc_tokens", len(ids)), ("ids", piece.astype(np.int32) if with_ids else None)):
                            out[k].append(v)
                cols = [pa.array(out[k], pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.array(out["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens[, ids]) of at most ``window`` ids.

    A null or empty text has its end id only. Ids are those that the tokenizer's file gives, added tokens included.
    Very long texts are encoded in blocks; a task holds some 4 bytes an id of its longest text and the arrays of one
    block. Repeated rows and null ids give their own pieces, an empty table none. Only the two columns are read, so
    the names of others don't matter.
    """
    C.prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return texts.mapInArrow(_cut(tokenizer, window, with_ids), kind)


class Capacities:
    """Segment tree over remaining capacities 0 .. window-1: each leaf holds the open windows with that much room."""

    def __init__(self, window: int):
        self.size = 1 << max(1, (window - 1).bit_length())
        self.open = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, room: int, which: int) -> None:
        self.at[room].append(which)
        i = room + self.size
        while i:
            self.open[i] += 1
            i >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the open window with the least room of at least ``need``: (room, window)."""
        i = need + self.size
        if not self.open[i]:
            while i > 1 and (i & 1 or not self.open[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.open[2 * i] else 2 * i + 1
        room = i - self.size
        which = self.at[room].pop()
        while i:
            self.open[i] -= 1
            i >>= 1
        return room, which


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece; lengths are in descending order."""
    tree, used, number, offset = Capacities(window), 0, [], []
    for n in lengths:
        found = tree.tightest(n) if n < window else None
        room, which = found or (window, used)
        used += found is None
        number.append(which)
        offset.append(window - room)
        if room > n:
            tree.put(room - n, which)
    return number, offset


def _place(window: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("piece", "ascending")])
        number, offset = best_fit_decreasing(table["length"].to_pylist(), window)
        group = table["grp"][0].as_py()
        table = table.drop_columns(["piece", "grp"])
        table = table.append_column("sequence_id", pa.array(np.array(number, np.int64) + (group << 32)))
        return table.append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack(cut: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces; offsets in a sequence are gapless from 0.

    The pieces are written once, so that their numbers, and with them the groups, come out the same if a task is
    repeated. An empty table gives an empty result; repeated documents are packed once each.
    """
    cut = C.store(cut, "pieces")
    groups = max(1, round(C.rows_of(cut) / group))
    dealt = cut.withColumn("piece", F.monotonically_increasing_id()).withColumn("grp", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("grp").applyInArrow(_place(window), kind)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Padded windows (sequence_id, ids, n_ids) of packed pieces with their ids; each holds at most ``window`` ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    padded = F.concat(F.col("ids"), F.array_repeat(F.lit(pad_id), (F.lit(window) - F.size("ids")).cast("int")))
    return parts.select("sequence_id", ids.alias("ids")).select("sequence_id", padded.alias("ids"), F.size("ids").alias("n_ids"))
