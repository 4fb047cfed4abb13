"""Sharding by jump consistent hashing.

``shard_of`` maps a stable 64-bit key to one of n buckets without any table: when n grows
to n+1, a key either stays or moves to bucket n, and about 1/(n+1) of the keys move
(Lamping and Veach, 2014). The law that holds is therefore ``key``.

Edge cases: a null key counts as key 0; repeated keys, and whole repeated rows, land in the
same shard and get different slots, in an order of no meaning where they tie; null text has
size 8 and the crc32 of the empty string, very long texts are only measured; an empty table
gives an empty result. Columns that have the name of an added one are replaced; all others
pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import crc32, free_names, small, without, written
from lectern.session import ship

#: Rows that one slot block is meant to hold; blocks are numbered in one window each.
BLOCK_ROWS = 20_000


def jump_hash(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Jump consistent hash of each uint64 key into ``buckets`` buckets, all keys at once."""
    if buckets < 1:
        raise ValueError("buckets must be positive")
    state = keys.astype(np.uint64, copy=True)
    # the generator's first outputs for small consecutive keys are correlated; mix them first
    state ^= state >> np.uint64(33)
    state *= np.uint64(0xFF51AFD7ED558CCD)
    state ^= state >> np.uint64(33)
    where = np.zeros(len(state), dtype=np.int64)
    jump = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while len(live):
        where[live] = jump[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[live] = ((where[live] + 1) * (float(1 << 31) / step)).astype(np.int64)
        live = live[jump[live] < buckets]
    return where.astype(np.int32)


def with_shards(df: DataFrame, key: str, shards: int, shard_col: str = "shard", grown_col: str | None = None) -> DataFrame:
    """Add the shard of a long key column, and the shard it would have with one more shard."""

    ship(df.sparkSession)

    @F.pandas_udf(f"{shard_col} int, {grown_col or '_grown'} int")
    def place(keys):
        import pandas as pd

        raw = keys.fillna(0).astype("int64").to_numpy().view(np.uint64)
        return pd.DataFrame({shard_col: jump_hash(raw, shards), grown_col or "_grown": jump_hash(raw, shards + 1)})

    out = without(df, shard_col, *([grown_col] if grown_col else [])) if key.lower() not in (shard_col.lower(), (grown_col or "").lower()) else df
    (placed,) = free_names(out.columns, "place")
    out = out.withColumn(placed, place(F.coalesce(F.col(key).cast("long"), F.lit(0))))
    both = {shard_col: F.col(f"{placed}.{shard_col}")} | ({grown_col: F.col(f"{placed}.{grown_col}")} if grown_col else {})
    return out.withColumns(both).drop(placed)


def with_slots(df: DataFrame, shard_col: str, order: list[str], slot_col: str = "slot", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number the rows of every shard from 0 without gaps.

    A window over a whole shard would run in as many tasks as there are shards. Rows are
    first dealt to hash blocks of about ``block_rows`` rows; each block is numbered by
    itself and starts at the row count of the shard's earlier blocks. The table of block
    counts has rows/block_rows rows. df is written once, with a number of its own for every
    row, which enters the hash: equal rows are dealt to different blocks, and everything
    else is read from the written table.
    """
    row, block, n, start, at = free_names([*df.columns, slot_col], "row", "block", "n", "start", "at")
    kept = written(without(df, slot_col).withColumn(row, F.monotonically_increasing_id()), "slots")
    rows, shards = kept.agg(F.count(F.lit(1)), F.count_distinct(shard_col)).first()
    blocks = max(1, -(-rows // (block_rows * max(1, shards))))
    cut = kept.withColumn(block, F.pmod(F.xxhash64(*order, row), F.lit(blocks)))
    counts = cut.groupBy(shard_col, block).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(shard_col).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard_col, block, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(shard_col, block).orderBy(*order, row)
    numbered = cut.withColumn(at, F.row_number().over(inside) - 1).join(small(starts), [shard_col, block])
    return numbered.withColumn(slot_col, (F.col(start) + F.col(at)).cast("long")).select(*[c for c in kept.columns if c != row], slot_col)


def write_shards(df: DataFrame, shard_col: str, path: str, files_per_shard: int = 1) -> None:
    """Write one folder per shard; several files share a shard so that no task takes a whole one."""
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != shard_col]), F.lit(files_per_shard))
    df.repartition(F.col(shard_col), salt).write.partitionBy(shard_col).parquet(path)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.col("text")
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        crc32(text).cast("long").alias("text_crc32"),
    )
    placed = with_shards(slim, "doc_id", shards, "shard", "grown_shard").withColumn("law", F.lit("key"))
    out = with_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
