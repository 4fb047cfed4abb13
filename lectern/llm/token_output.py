"""Token ids as binary files: frequency-ranked ids in byte-aligned codes with control bytes.

Every file is written by one task and stands alone. Its header lists the ids that occur in
it by falling frequency (counted over all ids of all its documents; ties by id); an id is
stored as its rank in that list, little-endian in 1 to 4 bytes, so the 256 most frequent ids
take one byte. The byte lengths stand apart from the data, four to a control byte, which
lets a reader turn control bytes into lengths by one table lookup and gather all values
with numpy.

File layout, integers little-endian::

    8 bytes  magic "LECTOK01"
    u32 documents, u32 distinct ids, u64 ids
    u32 x distinct    ids by rank
    i64 x documents   doc_id (the smallest i64 stands for null)
    u32 x documents   ids of each document, its end id included
    blocks of BLOCK ids (the last may be shorter):
        u32 ids, u32 data bytes, control bytes, data bytes

Files are numbered in ascending doc_id order, documents ascend within a file, and rows with
the same doc_id are ordered by their text's hash. A task that runs again overwrites its
own files with the same bytes (written aside, then moved), so lost executors do no harm.

Edge cases: null text has no ids but the end id; an empty table writes no file; repeated
rows are written each, ties in doc_id and text in any order; null ids come first; extra
columns are ignored, whatever their names. Very long texts are written whole: a single
document's ids must fit into a worker's memory (4 bytes each).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import fragments
from lectern.llm.common import map_batches, new_path, small, written

MAGIC, BLOCK = b"LECTOK01", 1 << 18
#: Ids gathered before a file is closed (4 bytes each in the worker, twice while it is written).
FILE_IDS = 1 << 24
#: Text bytes meant for one task: as few as the first while there are idle cores, never more than the second.
TASK_BYTES = (16 << 20, 1 << 30)
#: Tasks whose files are summed up in one group.
PARTS = 1000
NULL_ID = -(1 << 63)
#: Lengths of the four values behind each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    n = len(values)
    raw = values.astype("<u4").view(np.uint8).reshape(n, 4)
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = raw[np.arange(4) < lengths[:, None]]
    code = np.zeros(-(-n // 4) * 4, np.uint8)
    code[:n] = lengths - 1
    code = code.reshape(-1, 4)
    return (code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).tobytes(), data.tobytes()


def unpack(n: int, control: bytes, data: bytes) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.zeros((n, 4), np.uint8)
    raw[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return raw.reshape(-1).view("<u4")


def file_bytes(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> Iterator[bytes]:
    """The parts of one file."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(counts)
    by_rank = used[np.lexsort((used, -counts[used]))].astype("<u4")
    rank = np.zeros(len(counts), "<u4")
    rank[by_rank] = np.arange(len(by_rank), dtype="<u4")
    yield MAGIC + np.array([len(doc_ids), len(by_rank)], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    yield by_rank.tobytes()
    yield np.array([NULL_ID if d is None else d for d in doc_ids], "<i8").tobytes()
    yield np.array(sizes, "<u4").tobytes()
    for at in range(0, len(ids), BLOCK):
        part = rank[ids[at : at + BLOCK]]
        control, data = pack(part)
        yield np.array([len(part), len(data)], "<u4").tobytes() + control + data


def read_file(stream) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of an open file, block by block."""
    if stream.read(8) != MAGIC:
        raise ValueError("not a token file")
    docs, distinct = np.frombuffer(stream.read(8), "<u4").tolist()
    stream.read(8)
    by_rank = np.frombuffer(stream.read(4 * distinct), "<u4")
    doc_ids = np.frombuffer(stream.read(8 * docs), "<i8").tolist()
    sizes = np.frombuffer(stream.read(4 * docs), "<u4").tolist()
    rest = np.zeros(0, "<u4")
    for doc_id, size in zip(doc_ids, sizes):
        parts, have = [rest], len(rest)
        while have < size:
            n, length = np.frombuffer(stream.read(8), "<u4").tolist()
            parts.append(by_rank[unpack(n, stream.read(-(-n // 4)), stream.read(length))])
            have += n
        joined = np.concatenate(parts) if len(parts) > 1 else parts[0]
        yield (None if doc_id == NULL_ID else doc_id), joined[:size]
        rest = joined[size:]


def _open(path: str):
    return pyarrow.fs.FileSystem.from_uri(path)


def write_tokens(
    docs: DataFrame,
    path: str,
    end_id: int,
    text: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    task_bytes: tuple[int, int] = TASK_BYTES,
) -> DataFrame:
    """Write the files below ``path`` (a URI all executors can write to).

    Returns a table of the files: file, part, seq, docs, ids. It is written before it is
    returned, so files are made once.
    """
    vocab = public_tokenizers.path(vocabulary)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = slim.select(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(task_bytes[1], max(task_bytes[0], total // (4 * docs.sparkSession.sparkContext.defaultParallelism)))
    ordered = (
        slim.withColumn("h", F.xxhash64("text"))
        .repartitionByRange(max(1, -(-total // share)), "doc_id", "h")
        .sortWithinPartitions("doc_id", "h")
        .drop("h")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = fragments.loaded(vocab)
        part = TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        fs, root = _open(path)
        fs.create_dir(root, recursive=True)
        end = np.array([end_id], "<u4")
        seq = 0
        doc_ids, sizes, parts, have = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal seq, doc_ids, sizes, parts, have
            name = f"part-{part:06d}-{seq:04d}.tok"
            with fs.open_output_stream(f"{root}/_{name}.{attempt}") as out:
                for x in file_bytes(doc_ids, sizes, np.concatenate(parts)):
                    out.write(x)
            fs.move(f"{root}/_{name}.{attempt}", f"{root}/{name}")
            row = pa.RecordBatch.from_pydict(
                {"file": [name], "part": [part], "seq": [seq], "docs": [len(doc_ids)], "ids": [have]}, schema=files
            )
            seq += 1
            doc_ids, sizes, parts, have = [], [], [], 0
            return row

        for batch in batches:
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = coder.encode(t.as_py()) if t.is_valid else end[:0]
                doc_ids.append(doc_id)
                sizes.append(len(ids) + 1)
                parts += [ids, end]
                have += len(ids) + 1
                if have >= FILE_IDS:
                    yield close()
        if doc_ids:
            yield close()

    files = pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())])
    return written(map_batches(ordered, run, "file string, part int, seq int, docs long, ids long"), "tokenfiles")


def read_tokens(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit, binary).

    The starts of the files are sums over one small row per file, in groups of parts.
    """
    group = F.floor(F.col("part") / PARTS)
    grouped = files.withColumn("group", group)
    ahead = lambda *by: Window.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("group").agg(F.sum("ids").alias("n"))  # one row for PARTS tasks
    begun = groups.select("group", F.coalesce(F.sum("n").over(ahead(["group"])), F.lit(0)).alias("begin"))
    inside = F.coalesce(F.sum("ids").over(ahead("group", ["part", "seq"])), F.lit(0))
    todo = grouped.withColumn("inside", inside).join(small(begun), "group").select("file", (F.col("begin") + F.col("inside")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_stream(f"{root}/{name}") as stream:
                    rows: list[list] = [[], [], [], []]
                    size = 0
                    for doc_id, ids in read_file(stream):
                        for col, x in zip(rows, (doc_id, start, len(ids), ids.tobytes())):
                            col.append(x)
                        start += len(ids)
                        size += 4 * len(ids)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)
                            rows, size = [[], [], [], []], 0
                    if rows[0]:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)

    names, kinds = ["doc_id", "start", "n_tokens", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    n = max(1, min(files.count(), 100_000))
    return map_batches(todo.repartition(n, "file"), run, "doc_id long, start long, n_tokens long, ids binary")


def token_file_digest(docs: DataFrame, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files written and read again."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    files = write_tokens(docs, path, end_id)
    back = read_tokens(spark, path, files)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
