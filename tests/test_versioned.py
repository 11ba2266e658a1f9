"""Versioned tables: writers that die, repeat or meet; only touched parts are rewritten."""

import pytest
from pyspark.sql import functions as F

from dispatchlake.sources import feed, sinks
from dispatchlake.sources.versioned import Conflict, VersionedTable

KIND = "id string, n int"


def rows(spark, *what):
    return spark.createDataFrame(list(what), f"{KIND}, part string")


def content(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def test_insert_and_upsert_touch_their_parts_only(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", KIND, ["id"])
    assert t.read().count() == 0 and t.versions() == []
    assert t.insert_missing(rows(spark, ("a", 1, "2024-01"), ("b", 2, "2024-02"), ("b", 2, "2024-02"))) == 0
    assert t.insert_missing(rows(spark, ("a", 9, "2024-01"), ("b", 9, "2024-02"))) == 0  # nothing new
    before = t.manifest()["folders"]
    assert t.upsert(rows(spark, ("a", 5, "2024-01"), ("c", 3, "2024-01"))) == 1
    after = t.manifest()["folders"]
    assert after["2024-02"] == before["2024-02"] and after["2024-01"] != before["2024-01"]
    assert content(t) == [("a", 5, "2024-01"), ("b", 2, "2024-02"), ("c", 3, "2024-01")]
    assert sorted(map(tuple, t.read(version=0).collect())) == [("a", 1, "2024-01"), ("b", 2, "2024-02")]
    assert t.upsert(rows(spark)) == 1
    t.insert_missing(rows(spark, ("d", 1, "a=b/c %")))
    assert ("d", 1, "a=b/c %") in content(t) and len(content(t)) == 4


@pytest.mark.parametrize("dies_at", ["before", "after"])
def test_a_writer_that_dies_leaves_the_table_and_can_be_repeated(spark, tmp_path, monkeypatch, dies_at):
    t = VersionedTable(spark, f"{tmp_path}/t", KIND, ["id"])
    t.insert_missing(rows(spark, ("a", 1, "x")))
    publish = VersionedTable._publish

    def die(self, manifest):
        if dies_at == "after":
            publish(self, manifest)
        raise OSError("killed")

    monkeypatch.setattr(VersionedTable, "_publish", die)
    with pytest.raises(OSError):
        t.insert_missing(rows(spark, ("b", 2, "x")))
    assert len(content(t)) == (1 if dies_at == "before" else 2)
    monkeypatch.setattr(VersionedTable, "_publish", publish)
    t.insert_missing(rows(spark, ("b", 2, "x")))
    assert content(t) == [("a", 1, "x"), ("b", 2, "x")]
    t.vacuum(1)
    assert content(t) == [("a", 1, "x"), ("b", 2, "x")] and len(t.versions()) == 1


def test_of_two_writers_one_gives_way(spark, tmp_path, monkeypatch):
    one, two = (VersionedTable(spark, f"{tmp_path}/t", KIND, ["id"]) for _ in range(2))
    one.insert_missing(rows(spark, ("a", 1, "x")))
    seen = one.manifest()
    monkeypatch.setattr(one, "manifest", lambda version=None: seen)  # has read the table before the other wrote
    two.insert_missing(rows(spark, ("b", 2, "x")))
    with pytest.raises(Conflict):
        one.insert_missing(rows(spark, ("c", 3, "x")))
    assert content(two) == [("a", 1, "x"), ("b", 2, "x")]


def test_archive_and_changed_table_survive_a_crash(spark, tmp_path, monkeypatch):
    inc = spark.createDataFrame([("1", "A ST", "2024-01-05 10:00:00"), ("2", "B ST", "2024-02-05 10:00:00"), ("3", None, None)], "incident_number string, location string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    path = f"{tmp_path}/archive"
    for _ in range(2):
        sinks.append_archive(inc, path)
    sinks.upsert_archive(inc.filter("incident_number = '2'").withColumn("location", F.lit("C ST")), path)
    assert sorted((r.incident_number, r.location) for r in feed.read_archive(spark, path).collect()) == [("1", "A ST"), ("2", "C ST"), ("3", None)]
    table = f"{tmp_path}/t"
    assert sinks.write_if_changed(inc, table) and not sinks.write_if_changed(inc, table)
    publish = VersionedTable._publish
    monkeypatch.setattr(VersionedTable, "_publish", lambda self, m: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        sinks.write_if_changed(inc.limit(1), table)
    monkeypatch.setattr(VersionedTable, "_publish", publish)
    assert sinks.changed_table(inc, table).read().count() == 3 and not sinks.write_if_changed(inc, table)
    assert sinks.write_if_changed(inc.limit(1), table) and sinks.changed_table(inc, table).read().count() == 1
