"""Operator 12: conversation structure repair by a rank-convergence parallel Viterbi.

A conversation's rows, in order, are symbols; edits (Delete, Insert, Keep, Rerole) turn them into a sequence of role
initials that a four-state automaton accepts. The Viterbi runs backward over costs to go, as those alone lead a forward
trace to the cheapest edits and, letter by letter, to the ASCII-least audit.

Most conversations lie in one chunk and are solved there. A long one is cut into chunks of the global order:

1. every chunk runs from speculative cost vectors (one for each end state), which also tell its transfer matrix;
2. fix-up passes hand each chunk the vector of the one behind it, until no vector changes by more than a constant. A chunk
   whose vectors agree but for constants needs no other chunk; spans of those that don't are doubled, so the passes are
   at most logarithmic in the number of chunks, whatever the rows;
3. the rows are rerun from the true vector until it is parallel to the speculative one, and from there on kept;
4. chunks trace their edits for each entry state, the entries are stitched in the same way, and the pieces joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

CHUNK = 1024  # rows of a chunk
CHUNK_BYTES = 4 << 20  # bytes of its texts, about
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Where an initial leads, or -1.
STEP = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
FREE = (2, 2, 3, 2)  # where the one role that a state allows by Insert or Rerole leads
FREE_ROLE = ("user", "user", "assistant", "user")
END_COSTS = (0, 4, 2, 0)
#: Costs to go differ by less between states, so vectors that are FAR but for one state make up every other one.
FAR = 8
DROP = -1  # symbol of a row that must go; others are 2 * initial + truncated
INITIALS = ("s", "u", "a", "")
_WHITE = " \t\n\x0b\x0c\r"


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by a hash of conversation and turn; nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    out = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), how.alias("__how")).filter("__how <> 0")
    text = F.when(F.col("__how") == 1, "").when(F.col("__how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__how") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("__how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("__copy")).drop("__copy")


# ---------------------------------------------------------------- one chunk

def symbol(role: str, text: str, seen: bool) -> tuple[int, str]:
    """Symbol of a row and its first fault."""
    bare = text.rstrip(_WHITE)
    if not bare:
        return DROP, "blank"
    if seen:
        return DROP, "duplicate"
    cut = bare[-1] not in ".!?"
    return 2 * INITIALS.index(role[:1] if role[:1] in ("s", "u", "a") else "") + cut, "truncated" if cut else ""


def _closed(v: list[int]) -> tuple[int, ...]:
    """Costs to go when rows may be inserted before what comes."""
    b2, b3 = min(v[2], 2 + v[3]), min(v[3], 2 + v[2])
    return min(v[0], 2 + b2), min(v[1], 2 + b2), b2, b3


def before(after: tuple[int, ...], sym: int) -> tuple[int, ...]:
    """Costs to go before a row, from those behind it."""
    if sym == DROP:
        return _closed([3 + x for x in after])
    cut, step = sym & 1, STEP.get(INITIALS[sym >> 1])
    out = []
    for q in range(4):
        best = min(3 + after[q], 2 + cut + after[FREE[q]])
        if step and step[q] >= 0:
            best = min(best, cut + after[step[q]])
        out.append(best)
    return _closed(out)


def level(v: tuple[int, ...]) -> tuple[int, ...]:
    """A vector without its constant; two that differ by a constant only are equal then."""
    low = min(v)
    return tuple(x - low for x in v)


def backward(symbols: list[int], end: tuple[int, ...], known: list[tuple[int, ...]] | None = None) -> list[tuple[int, ...]]:
    """Levelled costs to go before each row and at the end. With ``known`` vectors of another run, it stops where its
    own are parallel to them: from there on they hold."""
    out = [level(end)]
    for i in range(len(symbols) - 1, -1, -1):
        out.append(level(before(out[-1], symbols[i])))
        if known is not None and out[-1] == known[i]:
            return known[:i] + out[::-1]
    return out[::-1]


def transfer(symbols: list[int]) -> list[tuple[int, ...]]:
    """For each state at the end (at no cost, the others FAR from it), the costs to go before the first row."""
    out = []
    for q in range(4):
        v = _closed([0 if k == q else FAR for k in range(4)])
        for s in reversed(symbols):
            v = before(v, s)
        out.append(v)
    return out


def apply(matrix: list, v: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a stretch, from those behind it."""
    return level(tuple(min(matrix[k][q] + v[k] for k in range(4)) for q in range(4)))


def trace(symbols: list[int], vectors: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, int]:
    """ASCII-least cheapest edits from an entry state on, and the state behind them; ``last``: the conversation ends."""
    out, memo = [], {}
    for i, s in enumerate(symbols):
        key = vectors[i + 1], s, state
        if key not in memo:
            now, letters, q = before(vectors[i + 1], s), [], state
            while True:
                cut, step = s & 1, STEP.get(INITIALS[s >> 1]) if s != DROP else None
                if 3 + vectors[i + 1][q] == now[q]:
                    letters.append("D")
                elif 2 + now[FREE[q]] == now[q]:
                    letters.append("I")
                    q = FREE[q]
                    continue
                elif step and step[q] >= 0 and cut + vectors[i + 1][step[q]] == now[q]:
                    letters.append("K")
                    q = step[q]
                else:
                    letters.append("R")
                    q = FREE[q]
                break
            memo[key] = "".join(letters), q
        got, state = memo[key]
        out.append(got)
    while last and state not in (0, 3):
        out.append("I")
        state = FREE[state]
    return "".join(out), state


def repaired(audit: str, rows: Iterator[tuple[str, str]], state: int, symbols: list[int]) -> list[str]:
    """Lines ``role:text`` that the edits leave, from an entry state on."""
    out, at = [], iter(zip(rows, symbols, strict=True))
    for letter in audit:
        if letter == "I":
            out.append(f"{FREE_ROLE[state]}:")
            state = FREE[state]
            continue
        (role, text), s = next(at)
        if letter == "K":
            out.append(f"{role}:{text}")
            state = STEP[INITIALS[s >> 1]][state]
        elif letter == "R":
            out.append(f"{FREE_ROLE[state]}:{text}")
            state = FREE[state]
    return out


def cost(audit: str, symbols: list[int]) -> int:
    at, total = iter(symbols), 0
    for letter in audit:
        s = DROP if letter == "I" else next(at)
        total += {"D": 3, "I": 2, "K": 0, "R": 2}[letter] + (letter in "KR" and s != DROP and s & 1)
    return total


# ---------------------------------------------------------------- chunks of the global order

CHUNKS = "part long, chunk long, whole boolean, conv_id long, turn array<long>, role array<string>, text array<string>, copies array<long>"


def _rows(columns: list, kinds: str) -> pa.RecordBatch:
    """A batch of tuples with the types of a DDL string (simple types and arrays of them)."""
    fields = [x.split(" ", 1) for x in kinds.split(", ")]
    kind = lambda t: pa.list_(C.arrow_type(t[6:-1])) if t.startswith("array<") else C.arrow_type(t)
    cols = list(zip(*columns, strict=True)) if columns else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind(t)) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _chunked(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows of one range -> chunks. The first and the last conversation of a range may go on elsewhere; the
        chunks of such ones are numbered within the range."""
        part, number, first, held, conv, size, pieces = TaskContext.get().partitionId(), 0, True, [], None, 0, 0

        def flush(whole: bool) -> pa.RecordBatch:
            nonlocal number, held, size, pieces
            row = (part, -1 if whole else number, whole, conv, *[[x[k] for x in held] for k in range(4)])
            number += not whole
            held, size, pieces = [], 0, pieces + 1
            return _rows([row], CHUNKS)

        for batch in batches:
            for c, turn, role, text, copies in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if held and c != conv:
                    yield flush(not first and not pieces)
                    first, pieces = False, 0
                elif len(held) >= limit or size >= CHUNK_BYTES:
                    yield flush(False)
                conv = c
                held.append((turn, role, text, copies))
                size += len(text)
        if held:
            yield flush(False)

    return run


def chunks(rows: DataFrame, limit: int = CHUNK) -> DataFrame:
    """Stored chunks of ``rows`` in the order of conversation, turn (nulls first), role and text. Equal rows are one, with
    their number in ``copies``, so that they don't make a range that can't be split."""
    C.prepare(rows.sparkSession)
    same = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    dealt = same.repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 32))
    ordered = dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return C.store(ordered.mapInArrow(_chunked(limit), CHUNKS), "chunks")


def _mark(conv: int | None, role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{conv}\0{len(role)}\0{role}{text}".encode(), digest_size=16).digest()


SOLVED = "conv_id long, seq long, symbols array<long>, matrix array<long>, blank long, duplicate long, truncated long, illegal long, first string, last_initial string, low long, high long, turns long, first_turn long, last_turn long"


def _symbols(conv: int | None, turns: list, roles: list[str], texts: list[str], copies: list[int], gone: set[bytes]) -> tuple[list[int], list[tuple[str, str]], tuple]:
    """Symbols and rows of a chunk with its copies put in, and its figures. ``gone``: rows that were seen in an earlier chunk."""
    seen, symbols, rows, faults = set(), [], [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    for role, text, n in zip(roles, texts, copies, strict=True):
        again = (role, text) in seen or bool(gone) and _mark(conv, role, text) in gone
        seen.add((role, text))
        for k in range(n):
            s, fault = symbol(role, text, again or k > 0)
            symbols.append(s)
            faults[fault] += 1
        rows += [(role, text)] * n
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    known = sorted({t for t in turns if t is not None})
    low, high = (known[0], known[-1]) if known else (None, None)
    return symbols, rows, (faults["blank"], faults["duplicate"], faults["truncated"], illegal, initials[0], initials[-1], low, high, len(known))


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            symbols, rows, (blank, duplicate, truncated, illegal, _, _, low, high, turns) = _symbols(r["conv_id"], r["turn"], r["role"], r["text"], r["copies"], set())
            audit, _ = trace(symbols, backward(symbols, END_COSTS), 0, True)
            text = "\n".join(repaired(audit, iter(rows), 0, symbols))
            gaps = high - low + 1 - turns if turns else 0
            out.append((r["conv_id"], gaps, blank, duplicate, truncated, illegal, cost(audit, symbols), audit, hashlib.sha256(text.encode()).hexdigest()))
        yield _rows(out, RESULT)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            marks = {_mark(r["conv_id"], role, text) for role, text in zip(r["role"], r["text"], strict=True)}
            yield _rows([(r["seq"], m) for m in marks], "seq long, mark binary")


def _speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            symbols, _, figures = _symbols(r["conv_id"], r["turn"], r["role"], r["text"], r["copies"], set(r["gone"] or ()))
            turns = [t for t in r["turn"] if t is not None]
            yield _rows([(r["conv_id"], r["seq"], symbols, [x for v in transfer(symbols) for x in v], *figures, turns[0] if turns else None, turns[-1] if turns else None)], SOLVED)


def _stitched(table: DataFrame, out: str, following: int) -> DataFrame:
    """Resolves ``out`` (null where a row depends on what is behind it) along the chain of sequence numbers.

    ``table`` has seq, conv_id, map (how a row's value follows from the one it depends on) and the value ``out``.
    Each pass lets an unresolved row ask the one that its span ends at: a resolved one gives it its value, an unresolved
    one doubles the span. ``following``: 1 if a row depends on the next one, -1 if on the one before.
    """
    C.prepare(table.sparkSession)
    state = C.store(table.withColumn("ask", F.col("seq") + following), "stitch")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out == "vector":
                    m = [tuple(r["map"][4 * k : 4 * k + 4]) for k in range(4)]
                    if r["other_value"] is not None:
                        r[out] = list(apply(m, tuple(r["other_value"])))
                    else:
                        o = [tuple(r["other_map"][4 * k : 4 * k + 4]) for k in range(4)]
                        r["map"] = [min(o[e][k] + m[k][q] for k in range(4)) for e in range(4) for q in range(4)]
                        r[out] = agreed(r["map"])
                elif r["other_value"] is not None:
                    r[out] = r["map"][r["other_value"]]
                else:
                    r["map"] = [r["map"][q] for q in r["other_map"]]
                    r[out] = r["map"][0] if len(set(r["map"])) == 1 else None
                r["ask"] = r["other_ask"]
                rows.append(tuple(r[f] for f in names))
            yield _rows(rows, kind.replace("bigint", "long"))

    names = state.columns
    while state.filter(F.col(out).isNull()).limit(1).count():
        other = state.select(F.col("seq").alias("ask"), F.col("map").alias("other_map"), F.col(out).alias("other_value"), F.col("ask").alias("other_ask"))
        met = state.filter(F.col(out).isNull()).join(other, "ask").mapInArrow(meet, kind)
        state = C.store(state.filter(F.col(out).isNotNull()).unionByName(met), "stitch")
    return state


def agreed(matrix: list[int]) -> list[int] | None:
    """The vector before a stretch, if it is the same but for a constant whatever is behind the stretch."""
    found = {level(tuple(matrix[4 * k : 4 * k + 4])) for k in range(4)}
    return list(found.pop()) if len(found) == 1 else None


PIECES = "conv_id long, seq long, audit string, lines binary, n_lines long, cost long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each entry state, the state in which a chunk's trace ends."""
    for batch in batches:
        for r in batch.to_pylist():
            vectors = _true_vectors(r)
            exits = [trace(r["symbols"], vectors, q, r["last"])[1] for q in range(4)]
            alone = exits[0] if r["head"] or len(set(exits)) == 1 else None
            yield _rows([(r["seq"], exits, alone)], "seq long, map array<long>, exit long")


def _true_vectors(r: dict) -> list[tuple[int, ...]]:
    speculative = backward(r["symbols"], (0, 0, 0, 0))
    return backward(r["symbols"], tuple(r["behind"]), speculative)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            audit, _ = trace(r["symbols"], _true_vectors(r), r["entry"], r["last"])
            rows = [x for x, n in zip(zip(r["role"], r["text"], strict=True), r["copies"], strict=True) for _ in range(n)]
            lines = repaired(audit, iter(rows), r["entry"], r["symbols"])
            yield _rows([(r["conv_id"], r["seq"], audit, "\n".join(lines).encode(), len(lines), cost(audit, r["symbols"]))], PIECES)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of conversation and place -> results; a piece's text is hashed as it passes and not kept."""
    now, have = None, False

    def result() -> pa.RecordBatch:
        gaps = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
        return _rows([(now["conv_id"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"], "".join(now["audits"]), now["sha"].hexdigest())], RESULT)

    for batch in batches:
        for r in batch.to_pylist():
            if have and r["conv_id"] != now["conv_id"]:
                yield result()
                have = False
            if not have:
                now, have = {**r, "audits": [], "sha": hashlib.sha256(), "lines_in": 0}, True
            else:
                for k in ("blank", "duplicate", "truncated", "cost"):
                    now[k] += r[k]
                now["illegal"] += r["illegal"] + (now["last"] + r["first"] not in ("su", "ua", "au"))
                if r["turns"]:
                    now["turns"] += r["turns"] - (bool(now["turns"]) and now["last_turn"] == r["first_turn"])
                    now["low"] = r["low"] if now["low"] is None else min(now["low"], r["low"])
                    now["high"] = r["high"] if now["high"] is None else max(now["high"], r["high"])
                    now["last_turn"] = r["last_turn"]
                now["last"] = r["last"]
            now["audits"].append(r["audit"])
            if r["n_lines"]:
                now["sha"].update((b"\n" if now["lines_in"] else b"") + r["lines"])
                now["lines_in"] += r["n_lines"]
    if have:
        yield result()


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Repairs conversations of rows (conv_id, turn, role, text; none of role and text null).

    One row for each conversation with rows: RESULT. Ties of a turn are in order of role and text, rows of a null turn
    come first, those of a null conversation make one of their own, equal rows stand side by side (all but one are
    duplicates). A chunk and the audit of one conversation are held by a task; texts pass as a stream. An empty table
    gives none; columns of other names aren't read.
    """
    cut = chunks(rows.select("conv_id", "turn", "role", "text"), chunk)
    whole = cut.filter("whole").mapInArrow(_whole, RESULT)
    split = cut.filter("NOT whole")
    # a running number over all chunks that may go on elsewhere; there is one row for each range
    first = split.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    first = first.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    split = C.store(split.join(F.broadcast(first), "part").withColumn("seq", F.col("base") + F.col("chunk")).drop("base", "part", "chunk", "whole"), "split")
    names = split.select("seq", "conv_id")
    beside = lambda k: names.select((F.col("seq") - k).alias("seq"), F.col("conv_id").alias("c"), F.lit(True).alias("there"))
    ends = ~(F.coalesce("there", F.lit(False)) & F.col("c").eqNullSafe(F.col("conv_id")))
    edges = names.join(beside(-1), "seq", "left").select("seq", "conv_id", ends.alias("head")).join(beside(1), "seq", "left").select("seq", "head", ends.alias("last"))
    edges = C.store(edges, "edges")
    # rows that an earlier chunk of the conversation has
    marks = split.mapInArrow(_firsts, "seq long, mark binary")
    earliest = marks.groupBy("mark").agg(F.min("seq").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    gone = marks.join(earliest, "mark").filter("seq > least").groupBy("seq").agg(F.collect_list("mark").alias("gone"))
    solved = C.store(split.join(gone, "seq", "left").mapInArrow(_speculate, SOLVED), "solved").join(edges, "seq")
    end = F.array(*[F.lit(x).cast("long") for x in END_COSTS])
    column = lambda k: F.slice("matrix", 4 * k + 1, 4)
    levelled = lambda c: F.transform(c, lambda x: x - F.array_min(c))
    agree = F.when((levelled(column(0)) == levelled(column(1))) & (levelled(column(1)) == levelled(column(2))) & (levelled(column(2)) == levelled(column(3))), levelled(column(0)))
    at_end = levelled(F.array(*[F.array_min(F.array(*[F.col("matrix")[4 * k + q] + END_COSTS[k] for k in range(4)])) for q in range(4)]))
    vectors = _stitched(solved.select("seq", "conv_id", F.col("matrix").alias("map"), F.when(F.col("last"), at_end).otherwise(agree).alias("vector")), "vector", 1)
    behind = vectors.select((F.col("seq") - 1).alias("seq"), F.col("vector").alias("next"))
    ready = solved.join(behind, "seq", "left").withColumn("behind", F.when(F.col("last"), end).otherwise(F.col("next"))).drop("next")
    ready = C.store(ready, "ready")
    exits = _stitched(ready.select("seq", "symbols", "behind", "last", "head").mapInArrow(_runs, "seq long, map array<long>, exit long"), "exit", -1)
    entry = exits.select((F.col("seq") + 1).alias("seq"), F.col("exit").alias("before"))
    traced = ready.join(entry, "seq", "left").withColumn("entry", F.when(F.col("head"), F.lit(0).cast("long")).otherwise(F.col("before"))).select("seq", "symbols", "behind", "last", "entry")
    pieces = split.join(traced, "seq").select("conv_id", "seq", "role", "text", "copies", "symbols", "behind", "last", "entry").mapInArrow(_pieces, PIECES)
    figures = ready.select("seq", "blank", "duplicate", "truncated", "illegal", "first", F.col("last_initial").alias("last"), "low", "high", "turns", "first_turn", "last_turn")
    ordered = pieces.join(figures, "seq").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "seq")
    return whole.unionByName(ordered.mapInArrow(_joined, RESULT))
