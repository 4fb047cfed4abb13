"""Line dedup by overlapping chunks of lines.

Two neighbouring lines with words, and blank lines between them, are a chunk; each line of
``LONE_WORDS`` words is a chunk as well. With ``min_words`` a chunk goes on until it has so
many words, forward from every line and backward from every line. So a chunk depends on its
own lines only, and whatever stands before and after a repeated passage, its first chunk
begins with its first line and its last one ends with its last line: every passage of two
lines is covered from its first to its last line with words.

This is the densest case of content-defined chunks. Boundaries chosen by a rolling hash over
line hashes resist shifts as well, but the chunks at both ends of a passage then hold lines
of its neighbourhood, so that short passages were missed (see the README).

Chunks whose 128-bit hash occurs more than once in the corpus are gathered with their bytes,
grouped by the bytes themselves, and of every group all but the first occurrence are
repeated: the one in the row of the smallest doc_id and text hash, and in it the earliest.
Lines of repeated chunks are removed. A line's first occurrence in the corpus is in no
repeated chunk, so one copy of every line stays.

Passes over the text: hashes only; bytes of candidate chunks; rebuilding. Only hashes and
candidates are shuffled; decisions reach the documents by a broadcast of measured size, or by
a join when there are too many.

Edge cases: null text has no lines and stays null; blank lines at the ends of a passage and
single lines of fewer than ``LONE_WORDS`` words are left alone; very long texts are cut like
others; rows with a null doc_id come first, ordered by the hash of their text like rows that
share a doc_id; repeated rows (same doc_id and text) share their decisions; an empty table
gives an empty result. Columns that have the name of an added one are replaced, or ``names``
gives others; all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lectern.llm.common import Scratch, free_names, map_batches, release, small, without, written

#: Words that a chunk must have besides its two lines.
MIN_WORDS = 0
#: A line of so many words is a chunk by itself.
LONE_WORDS = 50
_MASK = (1 << 64) - 1


def chunks_of(data: bytes) -> list[tuple[int, int, bytes]]:
    """(line, line + 1, bytes) of each line: the smallest pieces, of which texts are rebuilt."""
    return [(k, k + 1, line) for k, line in enumerate(data.split(b"\n"))]


def spans_of(lines: list[bytes], min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(first line, end line) of each chunk that is compared, in order; chunks overlap.

    Blank lines begin and end no chunk, so no line is in more than 2 * max(min_words, 2) + 1 chunks.
    """
    enough = max(min_words, LONE_WORDS)
    worded = [(k, n) for k, line in enumerate(lines) if (n := len(line.split(None, enough)))]
    out = {(k, k + 1) for k, n in worded if n >= LONE_WORDS}
    for way in (worded, worded[::-1]):
        size = last = 0
        for at, (k, n) in enumerate(way):
            while last < len(way) and (size < min_words or last - at < 2):
                size += way[last][1]
                last += 1
            if size < min_words or last - at < 2:
                break
            out.add((min(k, way[last - 1][0]), max(k, way[last - 1][0]) + 1))
            size -= n
    return sorted(out)


def compared(data: bytes, min_words: int = MIN_WORDS) -> Iterator[tuple[int, bytes]]:
    """(number, bytes with inner line feeds) of each chunk that is compared."""
    lines = data.split(b"\n")
    starts = [0, *accumulate(len(line) + 1 for line in lines)]
    for k, (first, end) in enumerate(spans_of(lines, min_words)):
        yield k, data[starts[first] : starts[end] - 1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chunk_table(docs: DataFrame, with_body: bool, min_words: int = MIN_WORDS) -> DataFrame:
    """Candidate chunks: doc_id, text_hash, chunk, again (seen before in this text), h1, h2[, body]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, th, t in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text")):
                if not t.is_valid:
                    continue
                seen: set[bytes] = set()
                for k, body in compared(t.as_py().encode(), min_words):
                    h = xxhash.xxh3_128_intdigest(body)
                    row = (doc_id, th, k, body in seen, _signed(h >> 64), _signed(h & _MASK))
                    rows.append((*row, body) if with_body else row)
                    if with_body:
                        seen.add(body)
                        size += len(body)
                if size > 4 << 20:
                    yield _batch(rows, kinds)
                    rows, size = [], 0
            yield _batch(rows, kinds)

    kinds = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("chunk", pa.int32()), ("again", pa.bool_()), ("h1", pa.int64()), ("h2", pa.int64())]
    schema = "doc_id long, text_hash long, chunk int, again boolean, h1 long, h2 long"
    if with_body:
        kinds, schema = [*kinds, ("body", pa.binary())], schema + ", body binary"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return map_batches(slim, run, schema)


def _batch(rows: list[tuple], kinds) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds)], names=[n for n, _ in kinds])


def repeated_chunks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, drop (numbers of the chunks to remove) of documents that lose chunks."""
    scratch = Scratch(docs.sparkSession)
    hashes = chunk_table(docs, False, min_words).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hashes = scratch.written(hashes.select("h1", "h2"), "chunkhashes")
    found = scratch.written(chunk_table(docs, True, min_words).join(small(hashes), ["h1", "h2"]), "chunks")
    release(docs.sparkSession)
    groups = found.groupBy("h1", "h2", "body").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    # written, so that the join deals both sides anew and can split the rows of a hot chunk
    groups = scratch.written(groups, "chunkgroups")
    judged = found.join(groups, ["h1", "h2", "body"]).where(F.col("again") | ~F.struct("doc_id", "text_hash").eqNullSafe(F.col("first")))
    drops = written(judged.select("doc_id", "text_hash", "chunk").distinct().groupBy("doc_id", "text_hash").agg(F.collect_list("chunk").alias("drop")), "drops")
    scratch.clear()
    return drops


#: Columns that line_dedup adds: the text kept, and four counts.
NAMES = ("kept_text", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, names: tuple[str, ...] = NAMES) -> DataFrame:
    """docs with kept_text, what is left of the text, and the counts n_lines, n_chunks, n_removed_*."""
    docs = without(docs, *names)
    d, h, drop, key, th = free_names([*docs.columns, *names], "d", "h", "drop", "key", "th")
    drops = repeated_chunks(docs, min_words).toDF(d, h, drop)
    named = docs.withColumns({key: F.col("doc_id").cast("long"), th: F.xxhash64("text")})
    joined = named.join(small(drops), F.col(key).eqNullSafe(F.col(d)) & (F.col(th) == F.col(h)), "left").drop(d, h, key, th)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, stats = [], [[], [], [], []]
            for t, gone_chunks in zip(batch.column("text"), batch.column(drop).to_pylist()):
                data = t.as_py().encode() if t.is_valid else None
                parts = chunks_of(data) if data is not None else []
                spans = spans_of([b for _, _, b in parts], min_words)
                gone = {line for k in gone_chunks or () for line in range(*spans[k])}
                kept.append(b"\n".join([b for k, _, b in parts if k not in gone]).decode() if data is not None else None)
                for col, x in zip(stats, (len(parts), len(spans), len(gone_chunks or ()), len(gone))):
                    col.append(x)
            own = [n for n in batch.schema.names if n != drop]
            added = [pa.array(kept, pa.string()), *(pa.array(c, pa.int64()) for c in stats)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in own), *added], names=[*own, *names])

    fields = [*docs.schema.fields, StructField(names[0], StringType()), *(StructField(n, LongType()) for n in names[1:])]
    return map_batches(joined, run, StructType(fields))


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """Per document: line and chunk counts, what was removed, and the digest of the text kept."""
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", *NAMES[1:],
        F.coalesce(F.length("kept_text"), F.lit(0)).cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"),
        (F.col("n_removed_chunks") > 0).alias("repeats"),
    )
