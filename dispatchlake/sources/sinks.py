"""Writers: the archive, and tables that are only rewritten when they changed. Both survive a writer that dies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.sources.feed import ARCHIVE, conform
from dispatchlake.sources.versioned import VersionedTable


def archive_table(spark: SparkSession, path: str) -> VersionedTable:
    """The archive under a path, by month of collection."""
    return VersionedTable(spark, path, ARCHIVE, ["incident_number"], "month")


def with_month(df: DataFrame) -> DataFrame:
    return conform(df, ARCHIVE).withColumn("month", F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("unknown")))


def append_archive(df: DataFrame, path: str) -> int:
    """SNK-01: adds incidents to the archive in its column order; those that their month has already are left out, so a
    repeated call adds nothing. Returns the archive's version."""
    return archive_table(df.sparkSession, path).insert_missing(with_month(df))


def upsert_archive(df: DataFrame, path: str) -> int:
    """JN-02: replaces incidents of the archive by number and adds the others; other months keep their files."""
    return archive_table(df.sparkSession, path).upsert(with_month(df))


def content_hash(df: DataFrame) -> tuple[int, str]:
    """Rows and an order-free hash of a table."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
    return row[0], row[1]


def changed_table(df: DataFrame, path: str) -> VersionedTable:
    return VersionedTable(df.sparkSession, path, df.schema, [], "part")


def write_if_changed(df: DataFrame, path: str, version: int = 1) -> bool:
    """SNK-04: writes the table unless rows, hash and schema version are those of its manifest.

    Table and manifest become visible in one step; a call that dies before it leaves the old ones, and is made again.
    """
    now = dict(zip(("rows", "hash", "schema"), (*content_hash(df), version), strict=True))
    table = changed_table(df, path)
    if table.manifest()["info"] == now:
        return False
    table.replace(df.withColumn("part", F.lit("all")), now)
    return True
