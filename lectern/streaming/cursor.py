"""A streaming source of the event log by cursor.

Events have ids in commit order, so a reader's place is one number. Each read takes at most
``limit`` events behind it, by id; a restarted query goes on where its checkpoint says, and a
new one from the larger of the client's ``after`` and the last id it has seen. With
``aggregates`` only the events of these come, as for one aggregate and its jobs.

    spark.dataSource.register(EventCursor)
    spark.readStream.format("event_cursor").schema(...).options(path=..., after=120, aggregates="7,31").load()

With ``catch_up`` a micro-batch reaches to the end of the log instead: executors read it, a
task a row group, and hand on ``limit`` rows at a time; nothing passes through the driver.

The log is a folder or file of Parquet (any place that pyarrow reaches); row groups below the
cursor are skipped by their statistics, and no read holds more than ``limit`` rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.errors import PySparkNotImplementedError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

LIMIT = 200


class EventCursor(DataSource):
    """Options: path, after (0), last_event_id (0), limit (200), id (event_id), aggregate (aggregate_id), aggregates, catch_up (false)."""

    @classmethod
    def name(cls) -> str:
        return "event_cursor"

    def schema(self) -> str:
        raise ValueError("give the schema of the events by .schema()")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        if self.options.get("catch_up", "false").lower() != "true":
            raise PySparkNotImplementedError(errorClass="NOT_IMPLEMENTED", messageParameters={"feature": "streamReader"})  # then Spark takes the simple one
        return _CatchUp(self.options, schema.fieldNames())

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(self.options, schema.fieldNames())


class _Log:
    """The options, and which events of the log they mean."""

    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.options, self.names = dict(options), names
        self.id, self.limit = options.get("id", "event_id"), int(options.get("limit") or LIMIT)

    def initialOffset(self) -> dict:
        return {"after": max(int(self.options.get("after") or 0), int(self.options.get("last_event_id") or 0))}

    def log(self) -> ds.Dataset:
        return ds.dataset(self.options["path"], format="parquet")

    def wanted(self, after: int, until: int | None) -> pc.Expression:
        out = pc.field(self.id) > after
        if until is not None:
            out &= pc.field(self.id) <= until
        if self.options.get("aggregates"):
            own = self.log().schema.field(self.options.get("aggregate", "aggregate_id")).type
            ids = pa.array(self.options["aggregates"].split(",")).cast(own)
            out &= pc.field(self.options.get("aggregate", "aggregate_id")).isin(ids)
        return out


class _Reader(_Log, SimpleDataSourceStreamReader):
    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = list(self._rows(start["after"], None))
        at = self.names.index(self.id)
        return iter(rows), {"after": rows[-1][at] if rows else start["after"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(start["after"], end["after"])

    def _rows(self, after: int, until: int | None) -> Iterator[tuple]:
        """The first events behind the cursor, in order of their ids."""
        limit, at = self.limit, self.names.index(self.id)
        first: list[tuple] = []
        for batch in self.log().to_batches(columns=self.names, filter=self.wanted(after, until)):
            if batch.num_rows:
                keep = batch.take(pc.select_k_unstable(batch, limit, [(self.id, "ascending")]))
                first = heapq.nsmallest(limit, [*first, *zip(*(c.to_pylist() for c in keep.columns))], key=lambda r: r[at])
        return iter(first)


@dataclass
class _Group(InputPartition):
    """One row group of a file of the log, and the cursors around it."""

    file: int
    group: int
    after: int
    until: int


class _CatchUp(_Log, DataSourceStreamReader):
    def latestOffset(self) -> dict:
        """The log's last id, by the statistics of its row groups where they have them."""
        last = self.initialOffset()["after"]
        for _, part in self._groups():
            known = (part.row_groups[0].statistics or {}).get(self.id)
            if known is not None:
                last = max(last, known["max"])
            else:
                last = max([last, *(pc.max(b.column(0)).as_py() or last for b in part.to_batches(columns=[self.id]))])
        return {"after": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        reach = self.wanted(start["after"], end["after"])
        return [_Group(n, g.id, start["after"], end["after"]) for n, part in self._groups(reach) for g in part.row_groups]

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        part = list(self.log().get_fragments())[partition.file].subset(row_group_ids=[partition.group])
        wanted = self.wanted(partition.after, partition.until)
        for batch in part.to_batches(columns=self.names, filter=wanted, batch_readahead=1):
            for first in range(0, batch.num_rows, self.limit):
                yield batch.slice(first, self.limit)

    def _groups(self, reach: pc.Expression | None = None) -> Iterator[tuple[int, ds.ParquetFileFragment]]:
        """(number of the file, fragment of one row group) of the log, without groups that statistics rule out."""
        for n, file in enumerate(self.log().get_fragments()):
            for part in file.split_by_row_group(reach, schema=self.log().schema) if reach is not None else file.split_by_row_group():
                yield n, part


def members(aggregate: int, jobs: DataFrame, key: str = "aggregate_id", job: str = "job_id") -> str:
    """An aggregate and its jobs, as the option ``aggregates``: few ids by nature."""
    ids = [r[0] for r in jobs.where(F.col(key) == aggregate).select(job).distinct().orderBy(job).collect()]
    return ",".join(map(str, dict.fromkeys([aggregate, *ids])))

