"""The live event feed with Structured Streaming.

The log is append-only in cursor order, so a file or table source with a checkpoint resumes
where it stopped, as a client does with the last event id. Windowed counts with watermarks
are an extra of this engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lectern.operators.events import event_label, event_stage, event_state, event_summary
from lectern.session import new_shared_path


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def described(events: DataFrame) -> DataFrame:
    """Events with stage, state, label and summary; payload (JSON) and aggregate_label are used where they exist."""
    kind = F.col("event_type")
    payload, name = (F.col(c) if c in events.columns else F.lit(None).cast("string") for c in ("payload", "aggregate_label"))
    return events.withColumns(
        {"stage": event_stage(kind), "state": event_state(kind, payload), "label": event_label(kind), "summary": event_summary(kind, payload, name)}
    )


def resolved(events: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Stream-static join that names the aggregate of each event."""
    return events.join(aggregates, "aggregate_id", "left")


def latest_state(events: DataFrame, key: str) -> DataFrame:
    """Latest event per key; in update mode a row comes out whenever a key has news."""
    return events.groupBy(key).agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


def once(events: DataFrame, keys: list[str], at: str = "ts", late: str = "1 day") -> DataFrame:
    """The first event of each key; keys are remembered for as long as events may be late."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, at: str = "ts", late: str = "10 minutes", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return events.withWatermark(at, late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def session_counts(events: DataFrame, key: str, at: str = "ts", late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))


def follow(df: DataFrame, checkpoint: str, sink, mode: str = "append", every: str = "1 second") -> StreamingQuery:
    """Hand each micro-batch to ``sink(batch, id)``; the checkpoint makes the feed resumable."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(sink).start()


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its result.

    Executors write the rows of each micro-batch to the shared folder, so none pass through the
    driver; in complete mode the last micro-batch is the result.
    """
    path, parts = new_shared_path(df.sparkSession, name), []

    def keep(batch: DataFrame, n: int) -> None:
        part = f"{path}/rows" if mode == "complete" else f"{path}/rows-{n}"
        batch.write.mode("overwrite").parquet(part)
        parts[:] = dict.fromkeys([*parts, part])

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/at").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(*parts) if parts else df.sparkSession.createDataFrame([], df.schema)
