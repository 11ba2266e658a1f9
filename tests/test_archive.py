"""The exact archive: whatever the cut of the input, repeated and interrupted batches, bounded files, pruned lookups."""

import os

import pytest
from pyspark.sql import functions as F

from dispatchlake.sources.runs import RunTable
from dispatchlake.streaming import archive as ar

KIND = "incident_number string, location string, cause string, reported string, pos int"
ROWS = [("1", "A ST", "X", "t1", 0), ("2", "a  st", "x", "t1", 1), ("3", "B ST", "X", "t1", 2), ("1", "C ST", "X", "t2", 3), ("4", "D ST", "X", "t2", 4), ("5", "D ST", "X", "t2", 5), ("6", "E ST", "X", "t3", 6), ("3", "B ST", "X", "t1", 7), ("7", "E ST", "Y", "t3", 8), (None, "F ST", "Z", None, 9), (None, "f st", "z", "", 10)]


def plain(batches):
    """Brute force: (id, pos) of what each batch adds."""
    fold = lambda r: "|".join(" ".join((c or "").upper().split()) for c in r[1:4])
    ids, keys, out = set(), set(), []
    for batch in batches:
        first = {}
        for r in sorted(batch, key=lambda r: (r[4], r[0] or "")):
            if r[0] not in ids and fold(r) not in keys:
                first.setdefault(fold(r), r)
        out += [(r[0], r[4]) for r in first.values()]
        ids |= {r[0] for r in first.values() if r[0] is not None}
        keys |= set(first)
    return sorted(out, key=str)


def got(table):
    return sorted(((r.incident_number, r.pos) for r in table.read().collect()), key=str)


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_brute_force(spark, tmp_path, files):
    cuts = [ROWS[k * len(ROWS) // files : (k + 1) * len(ROWS) // files] for k in range(files)]
    os.makedirs(f"{tmp_path}/in")
    for k, part in enumerate(cuts):
        spark.createDataFrame(part, KIND).coalesce(1).write.parquet(f"{tmp_path}/raw{k}")
        (one,) = [p.path for p in os.scandir(f"{tmp_path}/raw{k}") if p.name.endswith("parquet")]
        os.rename(one, f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    table = ar.Archive(spark, f"{tmp_path}/archive", KIND)
    take = ar.archive_stream(table)

    def twice(batch, number):
        take(batch, number)
        take(batch, number)

    q = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.foreachBatch(twice).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    assert got(table) == plain(cuts)


def test_batch_that_died_between_rows_and_index(spark, tmp_path, monkeypatch):
    table = ar.Archive(spark, f"{tmp_path}/archive", KIND)
    table.take(spark.createDataFrame(ROWS[:4], KIND), 0)
    with monkeypatch.context() as m:
        m.setattr(ar.KeyIndex, "add", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.take(spark.createDataFrame(ROWS[4:], KIND), 1)
    table.take(spark.createDataFrame(ROWS[4:], KIND), 1)
    assert got(table) == plain([ROWS[:4], ROWS[4:]])


def test_empty_batches_leave_no_run(spark, tmp_path):
    table = ar.Archive(spark, f"{tmp_path}/archive", KIND)
    for n in range(3):
        table.take(spark.createDataFrame([], KIND), n)
    assert got(table) == [] and table.rows.runs() == {} and table.index.runs.runs() == {}


def test_runs_and_files_stay_few(spark, tmp_path):
    runs = RunTable(spark, f"{tmp_path}/runs", "k long", ["k"], fan=3)
    for n in range(20):
        runs.compact(n)
        runs.add(n, spark.range(n * 10, n * 10 + 10).withColumnRenamed("id", "k"), 10)
    assert sorted(r.k for r in runs.read().collect()) == list(range(200))
    assert len(runs.runs()) <= 2 * 4 + 1 and sum(runs.table.manifest()["info"].values()) == 200
    assert len(os.listdir(f"{tmp_path}/runs/data")) <= 3 * 4 + 3
    assert len([f for f in os.listdir(f"{tmp_path}/runs/manifests") if not f.startswith(".")]) <= 2 * 3 + 2


def test_run_of_a_batch_is_replaced_and_the_own_one_is_not_merged(spark, tmp_path):
    runs = RunTable(spark, f"{tmp_path}/runs", "k long", ["k"], fan=2)
    one = lambda *k: spark.createDataFrame([(x,) for x in k], "k long")
    runs.add(0, one(1), 1)
    runs.add(1, one(2), 1)
    assert runs.compact(1) == 0  # batch 1 may come again
    runs.add(1, one(3, 4), 2)
    assert sorted(r.k for r in runs.read().collect()) == [1, 3, 4] and [r.k for r in runs.read(1).collect()] == [1]
    assert runs.compact(2) == 1 and list(runs.runs()) == ["1/0/1"]
    runs.add(2, one(), 0)
    assert sorted(r.k for r in runs.read().collect()) == [1, 3, 4]


def test_large_runs_are_cut_into_files_by_order(spark, tmp_path):
    runs = RunTable(spark, f"{tmp_path}/runs", "k long", ["k"], file_rows=100)
    runs.add(0, spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), 1000)
    spans = runs.read().groupBy(F.input_file_name().alias("f")).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo").collect()
    assert len(spans) == 10 and all(a.hi < b.lo for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("probe", [5, 4096])
def test_lookup_by_literals_and_by_join(spark, tmp_path, monkeypatch, probe):
    monkeypatch.setattr(ar, "PROBE", probe)
    index = ar.KeyIndex(spark, f"{tmp_path}/index")
    index.add(0, spark.range(20_000).select(F.concat(F.lit("v"), "id").alias("value")), 20_000)
    index.add(1, spark.range(20_000, 20_010).select(F.concat(F.lit("v"), "id").alias("value")), 10)
    asked = spark.createDataFrame([(f"v{k}",) for k in (3, 3, 19_999, 20_005, 20_010, 77_777, 88_888)] + [(None,)], "value string")
    assert sorted(r.value for r in index.known(asked).collect()) == ["v19999", "v20005", "v3"]
    assert sorted(r.value for r in index.known(asked, 1).collect()) == ["v19999", "v3"]


def test_lookup_of_many_values_in_several_reads(spark, tmp_path):
    index = ar.KeyIndex(spark, f"{tmp_path}/index")
    index.add(0, spark.range(6000).select(F.concat(F.lit("v"), "id").alias("value")), 6000)
    asked = spark.range(4000, 4000 + ar.PROBE).select(F.concat(F.lit("v"), "id").alias("value"))
    assert {r.value for r in index.known(asked).collect()} == {f"v{k}" for k in range(4000, 6000)}


def test_bloom_filters_pass_over_unknown_values(spark, tmp_path):
    index = ar.KeyIndex(spark, f"{tmp_path}/index")
    index.add(0, spark.range(50_000).select(F.concat(F.lit("v"), "id").alias("value")), 50_000)

    def rows_read(values):
        hashes = [r[0] for r in spark.createDataFrame([(v,) for v in values], "value string").select(F.xxhash64("value")).collect()]
        df = index.runs.read(None, index.prober).filter(F.col("h").isin(hashes))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        return next(p for p in (plan.collectLeaves().apply(k) for k in range(plan.collectLeaves().size()))).metrics().apply("numOutputRows").value()

    assert rows_read([f"w{k}" for k in range(12)]) == 0  # within the range of hashes, but in no filter
    assert rows_read(["v1"]) > 0
