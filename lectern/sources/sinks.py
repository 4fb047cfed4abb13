"""Writing: content-addressed blobs, JSON, CSV, keyset batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from lectern.operators.relational import keyset_page
from lectern.sources.versions import VersionedTable


def blob_store(spark: SparkSession, path: str) -> VersionedTable:
    """Contents by their sha256, in folders by its first two digits."""
    return VersionedTable(spark, path, partition_by=("prefix",))


def write_blobs(df: DataFrame, content: str, path: str) -> int:
    """Store each content that the store lacks, once; the number of contents written.

    What is stored is found by hash within its prefix; length and a second hash tell two
    contents of one sha256 apart without reading them (ValueError).
    """
    store = blob_store(df.sparkSession, path)
    raw = F.col(content).cast("binary")
    digest = F.sha2(raw, 256)
    own = df.where(F.col(content).isNotNull()).select(digest.alias("sha256"), F.octet_length(raw).cast("long").alias("bytes"), F.xxhash64(raw).alias("other"), F.col(content).alias("content"), F.substring(digest, 1, 2).alias("prefix"))
    told = own.select("prefix", "sha256", "bytes", "other").distinct()
    before = store.latest()
    held = store.read(before).select("prefix", "sha256", "bytes", "other") if before else told.limit(0)
    several = told.unionByName(held).distinct().groupBy("prefix", "sha256").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    if not several.isEmpty():
        raise ValueError("two contents share a sha256")
    after = store.insert_new(own, ["prefix", "sha256"])
    if after == before:
        return 0
    return store.read(after).count() - (store.read(before).count() if before else 0)


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def csv_ready(df: DataFrame) -> DataFrame:
    """Nested columns as JSON cells."""
    nested = (ArrayType, MapType, StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


#: The columns of a result export, in order; those of them that hold JSON.
EXPORT_COLUMNS = [
    "run_item_id", "model_response_id", "question_id", "question_revision", "retrieval_mode", "blind_id", "display_name", "provider_key", "model_id", "state",
    "score_profile_snapshot_provenance", "scoring_engine_version", "scoring_engine_content_hash", "scoring_engine_snapshot_provenance", "question_text", "answer_text",
    "scoring_criteria", "evidence_mode", "question_evidence", "retrieval_audit_id", "retrieval_root_audit_id", "retrieval_query", "retrieval_embedding_model",
    "retrieval_embedding_profile_hash", "retrieval_vector_space_id", "retrieval_candidate_scope", "retrieval_selected_chunks", "retrieval_graph_trace", "retrieval_config_snapshot",
    "retrieval_config_hash", "retrieval_rendered_context", "retrieval_context_hash", "retrieval_shared_snapshot_key", "retrieval_shared_from_retrieval_id", "provider_request_id",
    "model_snapshot", "raw_response", "response_text", "normalized_text", "finish_reason", "retry_history", "input_tokens", "output_tokens", "latency_ms", "cost_native",
    "cost_currency", "cost_krw", "scores", "judge_invocation_ids", "judge_invocation_states", "judge_request_hashes", "judge_invocations",
]
BOM, LINE_END = "\ufeff", "\r\n"


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180: quotes doubled, CRLF, a header in every part."""
    csv_ready(df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=False, lineSep=LINE_END, encoding="UTF-8")


def export_columns(df: DataFrame) -> DataFrame:
    """The columns of a result export in their order; those that df lacks are empty."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in EXPORT_COLUMNS])


def csv_lines(df: DataFrame) -> DataFrame:
    """One column ``line``: each row as a CSV line; a cell is quoted if it holds a quote, comma or line break."""

    def cell(name: str) -> F.Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    flat = csv_ready(df)
    return flat.select(F.concat_ws(",", *[cell(c) for c in flat.columns]).alias("line"))


def csv_parts(df: DataFrame, keys: list[str], path: str, rows_per_part: int = 250_000) -> None:
    """An export as numbered text parts in key order, which make one CSV file when put together.

    The parts are ranges of the keys, written at once by the executors; the BOM and the header
    are a part of their own, ``header``, so that no row needs to know that it is the first.
    """
    n = max(1, -(-df.count() // rows_per_part))
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    csv_lines(ordered).write.mode("overwrite").option("lineSep", LINE_END).text(f"{path}/rows")
    head = df.sparkSession.createDataFrame([(BOM + ",".join(df.columns),)], "line string")
    head.coalesce(1).write.mode("overwrite").option("lineSep", LINE_END).text(f"{path}/header")


def keyset_batches(df: DataFrame, keys: list[str], size: int = 50) -> Iterator[list[Row]]:
    """Pages of a small table for a client that asks for them one by one, each read after the last key of the one before.

    Whole tables leave through csv_parts or write_json, which read once.
    """
    after = None
    while True:
        rows = keyset_page(df, keys, after, size).collect()
        yield rows[:size]
        if len(rows) <= size:
            return
        after = tuple(rows[size - 1][k] for k in keys)
