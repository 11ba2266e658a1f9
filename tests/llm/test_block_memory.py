"""Blocks are no larger than their size, and what a task holds for one follows from it."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from dispatchlake.llm import blocks, phrases


@pytest.mark.parametrize("words", [3, 40, 190])
def test_no_block_of_whole_texts_exceeds_its_size(spark, words):
    size = 4096
    texts = [" ".join(f"w{(i * j) % 97:03d}" for j in range(i % words + 1)) for i in range(900)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)
    found = blocks.blocks(df, {"id": "long"}, phrases.piece_tail, size).select("n_bytes", "ends", "id").collect()
    assert max(r["n_bytes"] for r in found) <= size
    assert sorted(x for r in found for x in r["id"]) == list(range(900)) and sum(r["n_bytes"] for r in found) == sum(map(len, texts))
    assert len(found) <= 2 * sum(map(len, texts)) / size + 1


def test_a_block_of_phrases_is_asked_for_in_little_memory(spark):
    rng, size = np.random.default_rng(5), 1 << 20
    texts = [" ".join(f"{x:05d}" for x in rng.integers(0, 1 << 16, 2000)) for _ in range(300)]
    df = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").coalesce(1)
    stored = blocks.blocks(df, {"lang": "string"}, phrases.piece_tail, size).toArrow()
    batch = stored.combine_chunks().to_batches()[0].slice(0, 1)
    run = phrases._ask(blocks.Buckets(4))
    for _ in run(iter([batch])):  # what is made once
        pass
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * size


def test_paths_are_spelled_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SPELLED", 7)
    texts = [" ".join(f"{'abcdefgh'[i % 8]}{j % (5 + i)}" for j in range(60)) for i in range(8)]
    df = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").coalesce(1)
    stored = blocks.blocks(df, {"lang": "string"}, phrases.piece_tail)
    buckets = blocks.Buckets(0)
    asked = [b for b in phrases._ask(buckets)(iter(stored.toArrow().to_batches())) if b.num_rows and b["grp"][0].as_py() >= 0]
    table = pa.Table.from_batches(asked)
    found = [r for g in table["grp"].unique() for r in phrases._frequent(buckets, 2)(table.filter(pc.equal(table["grp"], g))).to_pylist()]
    orders = spark.createDataFrame([tuple(r.values()) for r in found], phrases.ORDERS).groupBy("block").agg(F.collect_list(F.struct("grp", "entries", "counts")).alias("orders"))
    out = list(phrases._spell(buckets)(iter(stored.join(orders, "block").toArrow().to_batches())))
    assert max(b.num_rows for b in out) == 7
    every = [(r["words"], r["path"]) for b in out for r in b.to_pylist()]
    assert len(set(every)) == len(every) > 100
