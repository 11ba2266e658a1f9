"""Plans of the component rounds stay small, with and without hubs."""

import pytest

from pyspark.sql import functions as F

from dispatchlake.llm import common as C
from dispatchlake.llm import dedup


@pytest.mark.parametrize("hub", [0, 700])
def test_a_round_is_written_in_small_plans(spark, monkeypatch, hub):
    """A chain of 40 nodes and a hub of 700 (a hot key), or none: the same roots, no step with more than a few exchanges."""
    C.prepare(spark)
    sizes, write = [], C.store

    def store(df, *a, **k):
        sizes.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        return write(df, *a, **k)

    monkeypatch.setattr(C, "store", store)
    edges = spark.range(39).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = edges.union(spark.range(hub).select(F.lit(1000).cast("long").alias("a"), (F.col("id") + 1001).alias("b")))
    got = {r.node: r.root for r in dedup.connected_components(edges).collect()}
    assert got == {k: 0 for k in range(1, 40)} | {1001 + k: 1000 for k in range(hub)}
    assert max(sizes) <= 8
