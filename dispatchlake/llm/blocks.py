"""Blocks of whole texts, and exact sums over n-grams of all blocks.

A block is one stored row with at most 7 MB of text, so a task can hold it and its n-grams. Each block sends its distinct
n-grams once, as sorted hashes in packed runs, to buckets of the hash range. A bucket sees each n-gram at most once for
each block, so a frequent n-gram is no hot key.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK = 7 << 20  # bytes of text in a block
PORTIONS = 16  # a block is filled by portions of rows, so it isn't left far from full
GRAMS = 1 << 20  # n-grams of one length in a bucket
_BLANK = re.compile(rb"[ \t]")


@dataclass
class Rows:
    """The rows of one block: texts (with ``skip`` bytes of context before those of a text's later parts) back to back."""

    block: int
    raw: np.ndarray
    offsets: np.ndarray
    skip: np.ndarray
    begins: np.ndarray  # the row starts where its text starts
    closed: np.ndarray  # the row ends where its text ends
    key: list
    columns: dict[str, list]


def _zstd(data: bytes, level: int = 3) -> bytes:
    return pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def _unzstd(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, decompressed_size=size, asbytes=True) if size else b""


def cut(text: bytes, size: int, context: Callable[[bytes], tuple[bytes, bool]]) -> Iterator[tuple[bytes, int, bool, bool]]:
    """Parts of a long text, cut at a blank after some ``size`` bytes: (bytes, bytes of context in front (none for the first
    only), whether it starts where the text starts, whether it ends where the text ends). ``context`` gives what the next
    part needs of a part, and whether that is all of it."""
    at, lead, begins = 0, b"", True
    while True:
        m = _BLANK.search(text, at + size) if at + size < len(text) else None
        end = m.start() if m else len(text)
        part = lead + text[at:end]
        yield part, len(lead), begins, end == len(text)
        if end == len(text):
            return
        lead, whole = context(part)
        lead, begins, at = b" " + lead, begins and whole, end


def blocks(docs: DataFrame, keep: dict[str, str], context: Callable[[bytes], tuple[bytes, bool]], size: int = BLOCK) -> DataFrame:
    """Stored blocks of the rows of ``docs`` (column ``text``, null as empty, and those of ``keep`` with their types).

    A block has at most ``size`` bytes. Texts of more are cut at blanks; their parts share a ``key`` (null for other
    texts), and are blocks of their own. Only they may be longer, by a word and the words carried over from the part before.
    """
    C.prepare(docs.sparkSession)
    kinds = {"block": "long", **{c: f"array<{t}>" for c, t in keep.items()}, "key": "array<string>", "skip": "array<long>", "begins": "array<boolean>", "closed": "array<boolean>", "ends": "array<long>", "n_bytes": "long", "data": "binary"}
    lists = {c: pa.list_(C.arrow_type(t)) for c, t in keep.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, held = TaskContext.get().partitionId(), 0, []  # held: (bytes, ends, skip, begins, closed, key, columns)

        def flush() -> pa.RecordBatch:
            nonlocal seq
            data = b"".join(x[0] for x in held)
            base = np.cumsum([0, *[len(x[0]) for x in held]])
            ends = np.concatenate([x[1] + b for x, b in zip(held, base, strict=False)])
            own = [[v for x in held for v in x[k]] for k in range(2, 6)]
            cols = [[v for x in held for v in x[6][c]] for c in keep]
            row = [pa.array([task << 24 | seq], pa.int64()), *[pa.array([v], lists[c]) for c, v in zip(keep, cols, strict=True)], pa.array([own[3]], pa.list_(pa.string())), pa.array([own[0]], pa.list_(pa.int64())), pa.array([own[1]], pa.list_(pa.bool_())), pa.array([own[2]], pa.list_(pa.bool_())), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([len(data)], pa.int64()), pa.array([_zstd(data)], pa.binary())]
            seq += 1
            held.clear()
            return pa.RecordBatch.from_arrays(row, names=list(kinds))

        filled = long = 0
        for batch in batches:
            other = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in keep}
            for lo, hi, raw, offs in C.text_chunks(batch, "text", max(1, size // PORTIONS)):
                n = hi - lo
                if n == 1 and len(raw) > size:
                    for part, skip, begins, closed in cut(raw.tobytes(), size, context):
                        if held:
                            yield flush()
                        held.append((part, np.array([len(part)]), [skip], [begins], [closed], [f"{task}-{long}"], {c: other[c][lo:hi] for c in keep}))
                    long += 1
                    filled = size
                else:
                    if held and filled + len(raw) > size:
                        yield flush()
                        filled = 0
                    held.append((raw.tobytes(), offs[1:], [0] * n, [True] * n, [True] * n, [None] * n, {c: other[c][lo:hi] for c in keep}))
                    filled += len(raw)
                if filled >= size:
                    yield flush()
                    filled = 0
        if held:
            yield flush()

    made = docs.select("text", *keep).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items()))
    path = C.new_path(docs.sparkSession, "blocks")
    # the texts are compressed already; row groups are kept small, as a reader holds one
    made.write.option("compression", "none").option("parquet.block.size", 32 << 20).option("parquet.block.size.row.check.min", 4).option("parquet.page.size.row.check.min", 1).parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def read(batch: pa.RecordBatch, keep: list[str]) -> Iterator[Rows]:
    """The blocks of an Arrow batch."""
    col = lambda c, i: batch.column(batch.schema.get_field_index(c))[i].as_py()
    for i in range(batch.num_rows):
        raw = np.frombuffer(_unzstd(col("data", i), col("n_bytes", i)), np.uint8)
        offsets = np.concatenate(([0], np.array(col("ends", i), np.int64)))
        yield Rows(col("block", i), raw, offsets, np.array(col("skip", i), np.int64), np.array(col("begins", i), bool), np.array(col("closed", i), bool), col("key", i), {c: col(c, i) for c in keep})


# ---------------------------------------------------------------- runs of hashes

def pack(hashes: np.ndarray, base: int) -> bytes:
    """Ascending hashes as differences: six bytes each where they fit, else eight."""
    steps = np.diff(hashes, prepend=np.uint64(base))
    wide = bool(len(steps)) and int(steps.max()) >> 48
    raw = steps.astype("<u8").view(np.uint8).reshape(-1, 8)
    return (b"\x08" + raw.tobytes()) if wide else (b"\x06" + np.ascontiguousarray(raw[:, :6]).tobytes())


def unpack(data: bytes, base: int) -> np.ndarray:
    width = data[0]
    raw = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(raw.view("<u8")[:, 0], dtype=np.uint64) + np.uint64(base)


def squeeze(numbers: np.ndarray) -> bytes:
    """Non-negative integers, compressed."""
    kind = np.uint8 if not len(numbers) or numbers.max() < 256 else np.int64
    return bytes([np.dtype(kind).itemsize]) + len(numbers).to_bytes(8, "little") + _zstd(numbers.astype(kind).tobytes(), 1)


def expand(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[1:9], "little")
    return np.frombuffer(_unzstd(data[9:], n * data[0]), np.uint8 if data[0] == 1 else np.int64).astype(np.int64)


@dataclass(frozen=True)
class Buckets:
    """Buckets of the hash range by its first ``bits`` bits, for each n-gram length."""

    bits: int

    def base(self, bucket: int) -> int:
        return bucket << (64 - self.bits) if self.bits else 0

    def slices(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, first, end) of ascending hashes, without empty buckets."""
        if not len(hashes):
            return
        if not self.bits:
            yield 0, 0, len(hashes)
            return
        own = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(hashes)], strict=True):
            yield int(own[a]), a, b

    def requests(self, block: int, grams: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """Rows (grp, block, hashes, counts) of one block's distinct n-grams and their counts."""
        rows = [(n << 40 | k, block, pack(u[a:b], self.base(k)), squeeze(c[a:b])) for n, (u, c) in grams.items() for k, a, b in self.slices(u)]
        return C.record_batch(dict(zip(("grp", "block", "hashes", "counts"), [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 4, strict=True)), REQUEST)


REQUEST = "grp long, block long, hashes binary, counts binary"


def buckets_for(stored: DataFrame, size: int = GRAMS) -> Buckets:
    """As many buckets as hold some ``size`` n-grams of one length each (a word has six bytes, about)."""
    total = stored.agg(F.sum("n_bytes")).first()[0] or 0
    return Buckets(max(0, min(30, (total // 6 // size).bit_length())))


def summed(table: pa.Table, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Of the requests of one bucket, in the order of their blocks: for each entry the number of its n-gram, the sum of
    each n-gram, the entry at which each n-gram comes first, each entry's count, and the rows' lengths."""
    keys = [unpack(x.as_py(), base) for x in table["hashes"]]
    counts = np.concatenate([expand(x.as_py()) for x in table["counts"]])
    lengths = [len(x) for x in keys]
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    at = np.flatnonzero(new)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, np.add.reduceat(counts[order], at), order[at], counts, lengths


def distinct(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of an ascending array and how often each stands there."""
    if not len(ranked):
        return ranked, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    return ranked[at], np.diff(np.append(at, len(ranked)))
