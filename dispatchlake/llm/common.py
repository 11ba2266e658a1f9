"""Helpers shared by the corpus operators: shared scratch tables and vectorised text hashing."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when only the driver's sys.path has the repository, and bounds the bytes of
    an Arrow batch, unless the session's bound is lower."""
    if int(spark.conf.get(_BATCH, "67108864b").lower().rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)
    env = spark.sparkContext.environment
    if _REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_REPO, env.get("PYTHONPATH")) if x)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``.

    Where that is unset, a local master (tests, a notebook) gets a new folder of its own; a cluster gets an error,
    because its executors share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scope:
    """Intermediate tables of one piece of work; ``release`` deletes them once its result has been written.

    >>> with Scope(spark) as tables:
    ...     near_duplicates(docs).write.parquet(path)

    Scopes nest, and each thread has its own, so jobs side by side never delete each other's tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scope:
        self._outer = _scope.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _scope.reset(self._outer)
        self.release()

    def release(self) -> None:
        for path in self.paths:
            _file(self.spark, path).delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        self.paths = []


_scope: ContextVar[Scope | None] = ContextVar("scope", default=None)


def _file(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str, scoped: bool = True) -> str:
    """A fresh path in the shared folder. It goes with the innermost scope (if ``scoped``), or with the application."""
    path = f"{scratch_root(spark)}/corpus/{name}-{uuid.uuid4().hex}"
    _file(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    if scoped and (scope := _scope.get()):
        scope.paths.append(path)
    return path


def store(df: DataFrame, name: str, codec: str = "zstd", scoped: bool = True) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name, scoped)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that none of ``taken`` has (Spark doesn't tell cases apart)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def rows_of(df: DataFrame) -> int:
    """Number of rows (read from Parquet footers where df is a plain scan)."""
    return df.select(F.count(F.lit(1))).first()[0]


def fits(df: DataFrame, bound: int) -> bool:
    """Whether df has at most ``bound`` rows; reads no more than it must."""
    return df.limit(bound + 1).count() <= bound


HOT_KEYS = 4096  # keys that may be treated as hot, at most
HOT_ROWS = 256  # rows that a hot key has, at least


def hot_rows(total: int) -> int:
    """Rows above which a key is hot; at most HOT_KEYS keys of ``total`` rows can be."""
    return max(HOT_ROWS, total // HOT_KEYS)


def join_keyed(left: DataFrame, right: DataFrame, on: list[str], total: int, count: str = "n", how: str = "inner") -> DataFrame:
    """left joined (inner, left or left_semi) with ``right``, which has one row for each key and, in ``count``, the
    key's rows in left.

    Rows of a hot key stay where they are and meet its row by broadcast, so no task gets all rows of one key. There are
    at most HOT_KEYS such rows, because their counts add up to no more than ``total``. ``count`` isn't in the result.
    """
    hot = right.filter(F.col(count) > hot_rows(total)).select(*on, F.struct(*[c for c in right.columns if c not in (*on, count)], F.lit(True).alias("hot")).alias("__row"))
    cold = right.filter(F.col(count) <= hot_rows(total)).drop(count)
    met = left.join(F.broadcast(hot), on, "left")
    more = [c for c in right.columns if c not in (*on, count)] if how != "left_semi" else []
    now = met.filter(F.col("__row").isNotNull()).select(*left.columns, *[F.col("__row")[c].alias(c) for c in more])
    rest = met.filter(F.col("__row").isNull()).drop("__row").join(cold, on, how)
    return now.unionByName(rest.select(*left.columns, *more))


DROPPED = 1_000_000  # keys of dropped rows that are broadcast at most


def without(docs: DataFrame, gone: DataFrame, on: Column) -> DataFrame:
    """docs but for the rows that meet a row of ``gone`` (ids and hashes, stored). Up to DROPPED of these go to the docs
    by broadcast, so no text is moved; beyond it the join shuffles."""
    return docs.join(F.broadcast(gone) if fits(gone, DROPPED) else gone, on, "left_anti")


# ---------------------------------------------------------------- Arrow text chunks

def text_chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch into row ranges of about ``limit`` bytes: (first row, end row, bytes, row offsets in the bytes).

    A null text counts as empty. One longer text forms a range of its own.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


# ---------------------------------------------------------------- hashing

_rng = np.random.default_rng(20240229)
#: Random odd multipliers of the places in a shingle.
PLACES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes with A-Z as a-z.
FOLDED_CODES = np.arange(256, dtype=np.uint8)
FOLDED_CODES[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


HASH_BLOCK = 1 << 21  # bytes hashed at once
WIDE = 64  # longer words are hashed whole, by XXH3
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k bytes


def _lane_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span: its 8-byte lanes go through the finaliser one after another, its length first."""
    padded = np.zeros(len(part) + 8, np.uint8)
    padded[: len(part)] = part
    lanes = np.ndarray((len(part) + 1,), "<u8", padded.data, strides=(1,))
    n = ends - starts
    h = mix(mix(n.astype(np.uint64) * ODD) ^ (lanes[starts] & _LOW[np.minimum(n, 8)]))
    for k in range(8, WIDE, 8):
        more = np.flatnonzero(n > k)
        if not len(more):
            break
        h[more] = mix(h[more] * ODD ^ (lanes[starts[more] + k] & _LOW[np.minimum(n[more] - k, 8)]))
    for i in np.flatnonzero(n > WIDE):
        h[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : ends[i]].tobytes(), 20240229)
    return h


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal bytes wherever they stand. Spans are in order, without overlaps.
    ``codes`` maps bytes first (FOLDED_CODES: without regard to ASCII case).

    Every lane passes a non-linear finaliser, so there are no word families that collide by their structure, as there
    are for polynomials modulo a power of two.
    """
    n = len(starts)
    out = np.zeros(n, np.uint64)
    i = 0
    while i < n:
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + HASH_BLOCK, "right")))  # a longer span is a block of its own
        part = raw[a : ends[j - 1]]
        out[i:j] = _lane_hashes(part if codes is None else codes[part], starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def digest8(text: str) -> bytes:
    """Eight bytes of a string's BLAKE2b."""
    return hashlib.blake2b(text.encode(), digest_size=8).digest()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def runs(inside: np.ndarray, row_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a row: starts, ends and their row."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[row_offsets[:-1][row_offsets[:-1] < n]] = True
    first[n] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(row_offsets, starts, "right") - 1


def ascii_words(raw: np.ndarray, row_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row: starts, ends, row."""
    return runs(~_SPACE[raw], row_offsets)


def arrow_type(kind: str) -> pa.DataType:
    return {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[kind]


def record_batch(columns: dict, schema: str) -> pa.RecordBatch:
    """A batch with the types of a Spark DDL string of simple types."""
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[k], pa.Array) else pa.array(c, arrow_type(t)) for k, t in fields], names=[k for k, _ in fields])
