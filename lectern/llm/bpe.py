"""BPE encoding and decoding of a text column by forced-boundary splitting (see fragments).

Edge cases: null text counts as empty and has no ids; special strings inside a text become
their special token, as the tokenizers library does by default; very long texts are cut
into fragments before anything is encoded, so a merge never sees a whole text; repeated rows
and rows with a null key are encoded one by one; an empty table gives an empty result.
A column that has the name of an added one (ids, decoded) is replaced; others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lectern.llm import fragments
from lectern.llm.common import map_batches, without

#: Text bytes that are turned into ids before a batch is handed on.
OUT_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text."""
    sizes = np.cumsum([0, *(x or 0 for x in pc.binary_length(batch.column(column)).to_pylist())])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def encode(docs: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.json", path: str | None = None) -> DataFrame:
    """docs with the column ids array<int>."""
    path = path or public_tokenizers.path(vocabulary)
    docs = without(docs, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = fragments.loaded(path)
        for whole in batches:
            for batch in slices(whole, text):
                blobs, ends = [], [0]
                for t in batch.column(text).cast(pa.binary()).to_pylist():
                    blob = b"".join(map(coder.cache.__getitem__, coder.fragments(t))) if t else b""
                    blobs.append(blob)
                    ends.append(ends[-1] + len(blob) // 4)
                flat = pa.array(np.frombuffer(b"".join(blobs), "<i4"))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return map_batches(docs, run, StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.json", path: str | None = None) -> DataFrame:
    """encoded with the column decoded: the text that its ids stand for."""
    path = path or public_tokenizers.path(vocabulary)
    encoded = without(encoded, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = fragments.loaded(path)
        table = np.array(coder.bytes_of, dtype=object)
        for batch in batches:
            col = batch.column("ids")
            flat = table[col.flatten().to_numpy(zero_copy_only=False)]
            ends = np.cumsum([0, *pc.list_value_length(col).fill_null(0).to_pylist()])
            texts = [b"".join(flat[i:j]).decode(errors="replace") for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return map_batches(encoded, run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def bpe_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    out = decode(encode(docs.select("doc_id", "text")).drop("text"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
