"""Tables with numbered versions in a shared folder.

Each change writes its rows as Parquet in a folder of their own and then a manifest, a small
JSON file that lists the folders of the new version. Readers are pinned to a manifest, so
queries that start from one version agree, whatever writers do meanwhile, and lost tasks read
the same files again. A manifest is created only if its number is free, so of two writers one
gets VersionConflict. A change may carry the name of its batch: a batch that the table holds
already changes nothing.

Manifests grow with the number of changes, not of rows or files; ``replace`` starts a new list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class VersionConflict(RuntimeError):
    """Another writer has made the next version meanwhile."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), partition_by

    # -- reading

    def latest(self) -> int:
        """The number of the newest version; 0 before the first."""
        fs, folder = self._at("versions")
        if not fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the one that is newest now."""
        at = self._manifest(self.latest() if version is None else version)
        schema = StructType.fromJson(at["schema"])
        if not at["parts"]:
            return self.spark.createDataFrame([], schema)
        columns = schema.fieldNames()
        parts = [f"{self.path}/parts/part={p}" for p in at["parts"]]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/parts").parquet(*parts).select(*columns)

    def holds(self, batch: str) -> bool:
        n = self.latest()
        return n > 0 and batch in self._manifest(n)["batches"]

    # -- writing

    def append(self, rows: DataFrame, batch: str | None = None) -> int:
        return self._change(lambda _: rows, batch, keep=True)

    def replace(self, rows: DataFrame, batch: str | None = None) -> int:
        return self._change(lambda _: rows, batch, keep=False)

    def insert_new(self, rows: DataFrame, keys: list[str], batch: str | None = None) -> int:
        """Append rows whose keys the table lacks, one for each key."""
        return self._change(lambda held: _lacking(rows, held, keys), batch, keep=True)

    def update(self, change: Callable[[DataFrame | None], DataFrame], batch: str | None = None) -> int:
        """The next version is change(rows of the newest, None before the first)."""
        return self._change(change, batch, keep=False)

    def _change(self, rows_of: Callable[[DataFrame | None], DataFrame], batch: str | None, keep: bool) -> int:
        n = self.latest()
        at = self._manifest(n) if n else {"parts": [], "batches": [], "schema": None}
        if batch is not None and batch in at["batches"]:
            return n
        rows = rows_of(self.read(n) if n else None)
        part = uuid.uuid4().hex
        rows.write.partitionBy(*self.partition_by).parquet(f"{self.path}/parts/part={part}")
        empty = self.spark.read.schema(rows.schema).parquet(f"{self.path}/parts/part={part}").isEmpty()
        if empty and keep and n and batch is None:
            return n  # nothing is new
        now = {
            "parts": [*(at["parts"] if keep else []), *([] if empty else [part])],
            "batches": [*at["batches"], *([] if batch is None else [batch])],
            "schema": at["schema"] if keep and at["schema"] else json.loads(rows.schema.json()),
        }
        self._create(n + 1, now)
        return n + 1

    # -- files, by Spark's own file system layer

    def _at(self, *names: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifest(self, version: int) -> dict:
        if version <= 0:
            raise ValueError("the table has no version yet")
        text = self.spark.read.text(f"{self.path}/versions/{version:09d}", wholetext=True).first()
        return json.loads(text[0])

    def _create(self, version: int, content: dict) -> None:
        fs, p = self._at("versions", f"{version:09d}")
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                raise VersionConflict(f"version {version} of {self.path} is there already") from e
            raise
        out.write(bytearray(json.dumps(content).encode()))
        out.close()


def _lacking(rows: DataFrame, held: DataFrame | None, keys: list[str]) -> DataFrame:
    once = rows.dropDuplicates(keys)
    return once if held is None else once.join(held.select(*keys), keys, "left_anti")


def pinned(tables: dict[str, VersionedTable]) -> dict[str, DataFrame]:
    """One version of each table, for all queries that are to agree with each other."""
    versions = {name: t.latest() for name, t in tables.items()}
    return {name: t.read(versions[name]) for name, t in tables.items()}
