"""Tables that only grow, as sorted runs that are merged level by level.

Each batch adds one run. When ``fan`` runs of a level have gathered, they become one run of the next level, so after n
batches there are at most some ``fan * log(n)`` runs, and each row is rewritten once a level. The live runs are named by a
manifest that is swapped in one step (``VersionedTable``): a batch that is delivered again replaces its own run, and a
writer that dies leaves the table as it was. Only runs of earlier batches are merged, never that of the batch at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispatchlake.sources.versioned import VersionedTable


class RunTable:
    """Rows of a schema in runs, each sorted by ``order``; ``blooms`` are columns with Bloom filters in the files."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, order: list[str], blooms: tuple[str, ...] = (), fan: int = 8, file_rows: int = 1 << 20):
        self.spark, self.path, self.order, self.blooms, self.fan, self.file_rows = spark, path.rstrip("/"), order, blooms, fan, file_rows
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.table = VersionedTable(spark, path, self.schema, order)

    def runs(self) -> dict[str, str]:
        """Folders of the live runs by ``level/first batch/last batch``."""
        return self.table.manifest()["folders"]

    def read(self, without: int | None = None, spark: SparkSession | None = None) -> DataFrame:
        """All rows, or those of all batches but one."""
        return self._read([f for n, f in self.runs().items() if n != f"0/{without}/{without}"], spark or self.spark)

    def run(self, batch: int) -> DataFrame:
        """Rows that a batch added (before it is merged)."""
        return self._read([f for n, f in self.runs().items() if n == f"0/{batch}/{batch}"], self.spark)

    def _read(self, folders: list[str], spark: SparkSession) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def _write(self, rows: DataFrame, at_most: int) -> str:
        """Writes a run as sorted files that don't overlap, one for each ``file_rows`` of ``at_most`` rows."""
        files = max(1, -(-at_most // self.file_rows))
        cast = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        cut = cast.repartitionByRange(files, *self.order) if files > 1 else cast.coalesce(1)
        writer = cut.sortWithinPartitions(*self.order).write
        for c in self.blooms:
            # small row groups: a filter for each, and a probe reads little; without a dictionary, which would stand in for it
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", "65536").option(f"parquet.enable.dictionary#{c}", "false").option("parquet.block.size", str(4 << 20))
        folder = self.table.new_folder()
        writer.parquet(f"{self.path}/data/{folder}")
        return folder

    def add(self, batch: int, rows: DataFrame, at_most: int) -> int:
        """Adds the rows of a batch (no more than ``at_most``), in place of what it added before. Returns their number."""
        old, name = self.table.manifest(), f"0/{batch}/{batch}"
        folder = self._write(rows, at_most)
        n = self._read([folder], self.spark).count()  # from the footers
        folders = {k: v for k, v in old["folders"].items() if k != name} | ({name: folder} if n else {})
        counts = {k: v for k, v in old["info"].items() if k in folders} | ({name: n} if n else {})
        self.table.swap(old, folders, counts)
        return n

    def compact(self, before: int) -> int:
        """Merges full levels of runs of batches before one; returns how many merges were made. Files of merged runs stay
        for readers of the version before and go at the next compaction."""
        merges, level = 0, 0
        while True:
            old = self.table.manifest()
            mine = [n for n in old["folders"] if n.startswith(f"{level}/") and int(n.split("/")[2]) < before]
            if len(mine) < self.fan:
                if not any(int(n.split("/")[0]) > level for n in old["folders"]):
                    break
                level += 1
                continue
            n = sum(old["info"][k] for k in mine)
            folder = self._write(self._read([old["folders"][k] for k in mine], self.spark), n)
            name = f"{level + 1}/{min(int(k.split('/')[1]) for k in mine)}/{max(int(k.split('/')[2]) for k in mine)}"
            rest = {k: v for k, v in old["folders"].items() if k not in mine}
            self.table.swap(old, rest | {name: folder}, {k: v for k, v in old["info"].items() if k in rest} | {name: n})
            merges += 1
        if merges:
            self.table.vacuum(merges + 1)
        return merges
