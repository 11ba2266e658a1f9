"""STR-01, exact: an archive in which no id and no content key comes twice, however long the stream has run."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispatchlake.functions.text import with_content_key
from dispatchlake.operators.ingest import filter_new
from dispatchlake.sources.runs import RunTable

#: Values up to which a batch is looked up by literals; they are also the most that the driver gathers.
PROBE = 4096
#: Literals of one read: the readers take a list of them as a chain of conditions, which is as deep as it is long.
LITERALS = 128


class KeyIndex:
    """Every value that was ever added, sorted by hash in merged runs.

    A lookup of few values goes to the files as a list of hashes: row groups are passed over by their range and by their
    Bloom filter, so its work is that of the values and the number of runs, not of the index. More values than ``PROBE``
    are joined with the index.
    """

    def __init__(self, spark: SparkSession, path: str, fan: int = 8):
        self.runs = RunTable(spark, path, "h long, value string", ["h"], ("h",), fan)
        self.prober = spark.newSession()  # a session of its own for the setting
        self.prober.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", LITERALS)

    def known(self, values: DataFrame, without: int | None = None) -> DataFrame:
        """Those of the values (value) that the index has, but for what one batch added; each once."""
        asked = values.filter("value IS NOT NULL").select(F.xxhash64("value").alias("h"), "value").distinct()
        few = asked.limit(PROBE + 1).collect()
        if len(few) > PROBE:
            return self.runs.read(without).join(asked, ["h", "value"], "left_semi").select("value").distinct()
        want, hashes = {r.value for r in few}, sorted({r.h for r in few})  # so that each read has a narrow range
        rows = self.runs.read(without, self.prober)
        reads = [rows.filter(F.col("h").isin(hashes[k : k + LITERALS])).select("value") for k in range(0, len(hashes), LITERALS)]
        hits = reduce(DataFrame.unionAll, reads).collect() if reads else []
        return self.runs.spark.createDataFrame([(v,) for v in sorted({r.value for r in hits} & want)], "value string")

    def add(self, batch: int, values: DataFrame, at_most: int) -> int:
        return self.runs.add(batch, values.filter("value IS NOT NULL").select(F.xxhash64("value").alias("h"), "value"), at_most)


class Archive:
    """Listings that were new when they came, with the index of their ids and content keys beside them."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, fan: int = 8):
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        full = T.StructType([*[f for f in kind.fields if f.name != "content_key"], T.StructField("content_key", T.StringType())])
        self.rows = RunTable(spark, f"{path.rstrip('/')}/rows", full, ["content_key"], (), fan)
        self.index = KeyIndex(spark, f"{path.rstrip('/')}/index", fan)

    def read(self) -> DataFrame:
        return self.rows.read()

    def take(self, batch: DataFrame, number: int) -> None:
        """Adds the listings of a batch whose id and content key the archive has never had (batch: ``filter_new``).

        A batch that comes again, after whatever part of it was done, gives the same archive. A listing without an id is
        told by its content key alone, of which the first in the batch by (pos, id) counts.
        """
        rows = with_content_key(batch).persist()
        try:
            self.rows.compact(number)
            self.index.runs.compact(number)
            n = rows.count()
            known = self.index.known(_values(rows), number)
            tail = lambda mark: known.filter(F.col("value").startswith(mark)).select(F.substr("value", F.lit(len(mark) + 1)).alias("v"))
            seen = tail("id:").select(F.col("v").alias("incident_number"), F.lit(None).cast("string").alias("content_key")).unionByName(tail("key:").select(F.lit(None).cast("string").alias("incident_number"), F.col("v").alias("content_key")))
            self.rows.add(number, filter_new(rows, seen), n)
            added = self.rows.run(number)
            self.index.add(number, _values(added), 2 * n)
        finally:
            rows.unpersist()


def _values(rows: DataFrame) -> DataFrame:
    """Ids and content keys as one column; a null id gives a null."""
    return rows.select(F.explode(F.array(F.concat(F.lit("id:"), "incident_number"), F.concat(F.lit("key:"), "content_key"))).alias("value"))


def archive_stream(archive: Archive) -> Callable[[DataFrame, int], None]:
    """STR-01: for ``foreachBatch``."""
    return archive.take
