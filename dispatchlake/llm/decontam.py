"""Benchmark decontamination with spaced seeds (DataFrame functions only).

A seed hashes the tokens that a fixed mask selects in a window, so a replaced token that falls on an ignored place
does not change it. Seeds of all windows of all documents are joined with those of the benchmark; around each hit the
document and the item are laid side by side, and the best stretch (+1 for an equal token, -3 for another) decides, or
the share of the item's tokens that are equal there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Places that the masks select in windows of SPAN tokens.
MASKS = ((0, 1, 3, 6, 7), (0, 2, 3, 4, 7))
SPAN = 8
SHORTEST = 4  # items of fewer tokens would be found everywhere: they match texts that consist of nothing else
MIN_SCORE = 10
SHARE = 75  # percent of an item's tokens on one diagonal that count whatever the stretch's score
SEED_BOUND = 2_000_000  # benchmark seeds that are broadcast at most; beyond it the join shuffles
LAY_BOUND = 500_000  # texts with hits whose places are broadcast at most; beyond it their texts are shuffled
SALTS = 16  # parts of a frequent seed in the shuffled join
#: Blocks of scripts written without blanks (Thai and Lao, Tibetan and Myanmar, Khmer, Chinese and Japanese): each character, with its marks, is a token.
_ALONE = r"\u0E00-\u0EFF\u0F00-\u109F\u1780-\u17FF\u2E80-\u2FDF\u3005-\u3007\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, marks and digits; single characters in the scripts that set no blanks."""
    low = F.lower(F.coalesce(text, F.lit("")))
    apart = F.when((F.octet_length(low) > F.length(low)) & low.rlike(f"[{_ALONE}]"), F.regexp_replace(low, rf"([{_ALONE}]\p{{M}}*)", " $1 ")).otherwise(low)
    return F.array_remove(F.split(apart, r"[^\p{L}\p{M}\p{N}]+"), "")


def _windows(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each token: its place and the hashes of it and of the following ones (null past the end)."""
    h = df.select(*keep, F.size("words").alias("tokens"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    rest = [F.col("h")] + [F.when(F.size("h") > k, F.slice("h", k + 1, F.greatest(F.size("h") - k, F.lit(0)))) for k in range(1, SPAN)]
    rest = rest[:1] + [F.coalesce(x, F.array().cast("array<bigint>")) for x in rest[1:]]
    zipped = F.arrays_zip(*[x.alias(f"h{k}") for k, x in enumerate(rest)])
    return h.select(*keep, "tokens", F.posexplode(zipped).alias("at", "w"))


def _seeds(windows: DataFrame, keep: list[str], short: list[int], whole_only: bool) -> DataFrame:
    """(keep, at, seed) of every window under every mask, and of whole short runs.

    ``short``: lengths of items below SPAN tokens, whose one seed takes all tokens. With ``whole_only`` (items) such a
    run must be the whole of its text; without it (documents) only runs of less than SHORTEST tokens must be.
    """
    w = [F.col(f"w.h{k}") for k in range(SPAN)]
    all_of = [F.when(w[m[-1]].isNotNull(), F.xxhash64(F.lit(n), *[w[k] for k in m])) for n, m in enumerate(MASKS)]
    for n in short:
        there = F.col("tokens") == n if whole_only or n < SHORTEST else w[n - 1].isNotNull()
        all_of.append(F.when(there & ((F.col("at") == 0) | F.lit(not whole_only and n >= SHORTEST)), F.xxhash64(F.lit(100 + n), *w[:n])))
    return windows.select(*keep, "at", F.explode(F.array(*all_of)).alias("seed")).filter("seed is not null")


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_score: int = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, doc_start, doc_end, matched, score, item_tokens): the best stretch of each item in each document.

    A stretch counts with a score of at least ``min_score``, or two thirds of the item's tokens if that is less. A hit
    whose stretch is too weak counts if SHARE percent of the whole item's tokens are equal; then the places are those of
    the first and last equal token and ``matched`` is the number of equal ones. Items below SPAN tokens must occur
    whole, and those below SHORTEST must be all that the text says. doc_start and doc_end are token numbers.

    Null and empty texts and items match nothing; repeated rows give one result; ids that occur with several texts (as
    null ids may) are reported with the best of them. Long texts are used whole. Empty tables give an empty result.
    Only the named columns are read, so the names of others don't matter.
    """
    out = _matches(docs, benchmark, min_score, id_col, text_col, item_col, item_text)
    out = out.groupBy("doc_id", "item_id").agg(F.max("r").alias("r"))
    return out.select("doc_id", "item_id", (-F.col("r.neg")).cast("long").alias("doc_start"), F.col("r.doc_end").cast("long").alias("doc_end"), F.col("r.matched").cast("long").alias("matched"), F.col("r.score").cast("long").alias("score"), F.col("r.item_tokens").cast("long").alias("item_tokens"))


def _matches(docs: DataFrame, benchmark: DataFrame, min_score: int, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(doc_id, version, item_id, r) of each stretch that counts; version is the text's hash."""
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("words")).filter(F.size("words") > 0).dropDuplicates(["item_id", "words"])
    items = C.store(items.withColumn("item_tokens", F.size("words")).withColumn("no", F.monotonically_increasing_id()), "items")
    short = sorted(r[0] for r in items.filter(F.col("item_tokens") < SPAN).select("item_tokens").distinct().collect())  # below SPAN values
    item_seeds = _seeds(_windows(items, ["no"]), ["no"], short, True)
    item_seeds = item_seeds.select("seed", "no", F.col("at").alias("place")).distinct()
    small = C.fits(item_seeds, SEED_BOUND)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null").withColumn("version", F.xxhash64("text"))
    found = _seeds(_windows(texts.select("doc_id", "version", tokens(F.col("text")).alias("words")), ["doc_id", "version"]), ["doc_id", "version"], short, False)
    if small:
        hits = found.join(F.broadcast(item_seeds), "seed")
    else:  # a passage that many documents share is dealt over SALTS tasks
        salted = item_seeds.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        hits = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "version", F.lit(1)), F.lit(SALTS)).cast("int")).join(salted, ["seed", "salt"])
    lays = hits.select("doc_id", "version", "no", (F.col("at") - F.col("place")).alias("shift")).distinct()
    # At most two lays for each token of the text and each item with the token's seed.
    lays = C.store(lays.groupBy("doc_id", "version").agg(F.collect_list(F.struct("no", "shift")).alias("lays")), "lays")
    lays = lays.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "lays")
    # Only texts with a hit are looked at again. Where they are few, texts stay where they are.
    again = F.broadcast(lays) if C.fits(lays, LAY_BOUND) else lays
    near = texts.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))).select("doc_id", "version", tokens(F.col("text")).alias("words"), F.explode("lays").alias("lay"))
    own = items.select("no", "item_id", F.col("words").alias("item"), "item_tokens")
    near = near.withColumn("no", F.col("lay.no")).withColumn("lo", F.greatest(F.col("lay.shift"), F.lit(0))).withColumn("shift", F.col("lay.shift"))
    both = near.join(F.broadcast(own) if small else own, "no")
    n = "least(item_tokens - (lo - shift), size(words) - lo)"
    equal = f"zip_with(slice(words, lo + 1, {n}), slice(item, lo - shift + 1, {n}), (a, b) -> a = b)"
    best = f"""aggregate({equal}, named_struct('at', 0, 'cur', 0, 'from', 0, 'eq', 0, 'score', 0, 'lo', 0, 'hi', 0, 'matched', 0, 'all', 0, 'first', 0, 'last', 0), (s, e) -> named_struct(
        'at', s.at + 1,
        'cur', greatest(0, s.cur + if(e, 1, -3)),
        'from', if(s.cur + if(e, 1, -3) <= 0, s.at + 1, s.from),
        'eq', if(s.cur + if(e, 1, -3) <= 0, 0, s.eq + if(e, 1, 0)),
        'score', greatest(s.score, s.cur + if(e, 1, -3)),
        'lo', if(s.cur + if(e, 1, -3) > s.score, s.from, s.lo),
        'hi', if(s.cur + if(e, 1, -3) > s.score, s.at + 1, s.hi),
        'matched', if(s.cur + if(e, 1, -3) > s.score, s.eq + 1, s.matched),
        'all', s.all + if(e, 1, 0),
        'first', if(e and s.all = 0, s.at, s.first),
        'last', if(e, s.at + 1, s.last)))"""
    out = both.select("doc_id", "version", "item_id", "item_tokens", "lo", F.expr(best).alias("b"))
    need = F.when(F.col("item_tokens") < SPAN, F.col("item_tokens")).otherwise(F.least(F.lit(min_score), F.ceil(F.col("item_tokens") * 2 / 3)))
    strong = F.col("b.score") >= need
    out = out.filter(strong | (F.col("b.all") * 100 >= F.col("item_tokens") * SHARE))
    pick = lambda stretch, whole: F.when(strong, F.col(stretch)).otherwise(F.col(whole))
    return out.select("doc_id", "version", "item_id", F.struct(F.col("b.score").alias("score"), (-(F.col("lo") + pick("b.lo", "b.first"))).alias("neg"), (F.col("lo") + pick("b.hi", "b.last")).alias("doc_end"), pick("b.matched", "b.all").alias("matched"), "item_tokens").alias("r"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_score: int = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text holds a benchmark item. Each row is judged by its own text, whatever its id."""
    found = _matches(docs, benchmark, min_score, id_col, text_col, item_col, item_text).select("doc_id", "version").distinct()
    key, version = C.fresh("leak_id", docs.columns), C.fresh("leak_text", docs.columns)
    found = C.store(found.select(F.col("doc_id").alias(key), F.col("version").alias(version)), "leaks")
    return C.without(docs, found, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text_col)) == F.col(version)))
