"""Tables of immutable folders under a manifest that is swapped in one step.

A table has folders ``data/<part value>/<revision>`` that are never written again, and manifests ``manifests/<number>``
that name the folder of each part. A writer first writes new folders for the parts it touches, and then publishes the next
manifest by a rename that fails if another writer was faster. A reader follows the newest manifest. So a writer that dies
at any point leaves the table as it was, the same call can be made again, and two writers never mix their rows.

Parts (months of an archive) bound the work of a write: only the parts that new rows fall into are read and rewritten.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer published a version meanwhile."""


class VersionedTable:
    """One table under a path, with ``schema`` (without the part column) and rows keyed by ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: list[str], part: str = "part"):
        self.spark, self.path, self.key, self.part = spark, path.rstrip("/"), key, part
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    # ---- files
    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    @property
    def _fs(self):
        return self._at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the published versions, oldest first."""
        folder = self._at(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [str(s.getPath().getName()) for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The newest (or a given) manifest; version -1 without folders if there is none."""
        found = self.versions()
        number = version if version is not None else found[-1] if found else -1
        if number < 0:
            return {"version": -1, "folders": {}, "info": {}}
        stream = self._fs.open(self._at(f"{self.path}/manifests/{number:012d}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Makes a manifest the newest one, in one step."""
        draft = self._at(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        target = self._at(f"{self.path}/manifests/{manifest['version']:012d}")
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise Conflict(f"version {manifest['version']} exists")

    # ---- reading
    def read(self, parts: list[str] | None = None, version: int | None = None) -> DataFrame:
        """Rows of the newest (or a given) version, of all or some parts, with the part column."""
        folders = self.manifest(version)["folders"]
        names = [f for p, f in folders.items() if parts is None or p in parts]
        full = T.StructType([*self.schema.fields, T.StructField(self.part, T.StringType())])
        if not names:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(*[f"{self.path}/data/{n}" for n in names])

    # ---- writing
    def _write(self, rows: DataFrame, old: dict, touched: list[str], info: dict) -> int:
        """Writes new folders for the touched parts and publishes them beside the others."""
        revision = self.new_folder()
        # the part is also a column of the files, so a folder's name isn't parsed for it
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], self.part, F.col(self.part).alias("__part")).write.partitionBy("__part").parquet(f"{self.path}/data/{revision}")
        folders = {p: f for p, f in old["folders"].items() if p not in touched}
        for s in self._fs.listStatus(self._at(f"{self.path}/data/{revision}")):
            name = str(s.getPath().getName())
            if name.startswith("__part="):
                folders[self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name[7:])] = f"{revision}/{name}"
        return self.swap(old, folders, info)

    def new_folder(self) -> str:
        """A name under ``data`` that was never used."""
        return uuid.uuid4().hex

    def swap(self, old: dict, folders: dict[str, str], info: dict) -> int:
        """Publishes a version after ``old`` with these folders, which are written under ``data``."""
        self._publish({"version": old["version"] + 1, "folders": folders, "info": info})
        return old["version"] + 1

    def merge(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], info: dict | None = None) -> int:
        """Merges rows (with the part column): ``how(current, new)`` gives the rows of the parts that ``new`` touches.

        Returns the version, which stays as it is if ``new`` is empty. A part's name is its value; the values of one call
        are gathered (months of a batch).
        """
        old = self.manifest()
        touched = [r[0] for r in new.select(self.part).distinct().collect()]
        if not touched:
            return old["version"]
        return self._write(how(self.read(touched, old["version"]) if old["version"] >= 0 else self.read(), new), old, touched, info or {})

    def insert_missing(self, new: DataFrame) -> int:
        """SNK-01, JN-02: adds rows whose key their part doesn't have, one for each key. Repeating a call adds nothing."""
        old = self.manifest()
        touched = [r[0] for r in new.select(self.part).distinct().collect()]
        if not touched:
            return old["version"]
        have = self.read(touched, old["version"]) if old["version"] >= 0 else self.read()
        fresh = new.join(have.select(*self.key, self.part), [*self.key, self.part], "left_anti").dropDuplicates([*self.key, self.part])
        if old["version"] >= 0 and fresh.limit(1).count() == 0:
            return old["version"]
        return self._write(have.unionByName(fresh.select(*have.columns)), old, touched, {})

    def upsert(self, new: DataFrame) -> int:
        """JN-02: replaces rows of a key, adds the others; only the parts that ``new`` falls into are rewritten."""
        one = new.dropDuplicates([*self.key, self.part])
        return self.merge(one, lambda have, rows: have.join(rows.select(*self.key, self.part), [*self.key, self.part], "left_anti").unionByName(rows.select(*have.columns)))

    def replace(self, rows: DataFrame, info: dict | None = None) -> int:
        """The whole table anew."""
        old = self.manifest()
        return self._write(rows, old, list(old["folders"]), info or {})

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests before the last ``keep`` and the folders and drafts that no manifest names any more."""
        found = self.versions()
        named = {f.split("/")[0] for v in found[-keep:] for f in self.manifest(v)["folders"].values()}
        for v in found[:-keep]:
            self._fs.delete(self._at(f"{self.path}/manifests/{v:012d}"), False)
        gone = 0
        data = self._at(f"{self.path}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if str(s.getPath().getName()) not in named:
                self._fs.delete(s.getPath(), True)
                gone += 1
        self._fs.delete(self._at(f"{self.path}/drafts"), True)
        return gone
