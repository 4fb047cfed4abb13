"""Similarity self-join of word n-gram sets with filters under several global token orders.

Two documents link when 100 * |A & B| >= threshold * |A | B|. If they link, they share a
token among the first n - ceil(t n) + 1 tokens of both sets, under every total order of the
tokens. Three orders are used. All put frequent tokens last (by a count sketch over the
whole corpus), and each orders the others by a hash of its own:

1. Equal sets are collapsed to one representative, the smallest doc_id.
2. The prefixes under the first order make lists of documents by token. Lists with the same
   members are kept once.
3. Each list is compared with its pivot, the member whose prefix tokens are shared most.
   Candidate pairs must also share a prefix token under the second and the third order;
   then whole texts are compared. Links so far give components.
4. Lists that still hold several components give the pairs across components, except those
   that sizes, the spread of the tokens' hashes, or the triangle inequality of the Jaccard
   distance (with the pivot) rule out.
   These are verified in the same way, and their links added.

A pair inside one component needs no comparison, as it can't change the result, so a group
of m near copies costs about m comparisons; no other pair is dropped, so components are
exact. Sketch errors only change the orders, never the result.

Edge cases: null or wordless text has no shingles and is linked with nothing; fewer words
than n are one shingle; rows with the same doc_id count as one document; rows with a null
doc_id are measured but not linked (component_id null); repeated rows get equal results; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, free_names, map_batches, release, small, written
from lectern.llm.components import connected_components

#: Words of a shingle, and the percentage of common shingles from which two documents link.
WORDS, PERCENT = 5, 80
#: Counters of the frequency sketch: 2**bits, growing with the number of documents. A task
#: holds 4 bytes for each; the levels made of them, 1 byte each, are broadcast.
SKETCH_BITS = (12, 26)
#: Counters of the sketch that travel in one row, and groups in which rows are added first.
SKETCH_BLOCK, SKETCH_WAYS = 1 << 11, 256
#: Hash ranges in which a set's tokens are counted, to rule out pairs: 2**bits, counts up to 127.
FINE_BITS = 8
CACHE_WORDS = 250_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_SEEDS = np.array([0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h
        return h


_HASHES = _WordHash()


def shingle_hashes(data: bytes | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    words = words_of(data) if data else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if len(words) < n:
        h = np.concatenate([h, np.repeat(np.uint64(len(words)), n - len(words))])
    acc = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        acc = (acc ^ h[k : len(h) - n + 1 + k]) * _ODD[k % 4] + np.uint64(k)
        acc ^= acc >> np.uint64(29)
    return np.unique(mix(acc))


def shingle_set(data: bytes, n: int = WORDS) -> set[tuple[bytes, ...]]:
    """The n-grams themselves, for the exact check."""
    words = words_of(data)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(n))))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def frequency_levels(docs: DataFrame, bits: int, words: int = WORDS) -> np.ndarray:
    """Level (0 for usual counts, else up to 63) of each of 2**bits hash buckets of shingles.

    Documents are counted by bucket over the whole table. Rare tokens fill buckets evenly,
    with a spread of the root of the mean; what stands out by six times that holds a frequent
    token, and the level grows with the count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        for batch in batches:
            held, size = [], 0
            for t in batch.column("text"):
                if t.is_valid:
                    held.append(shingle_hashes(t.as_py().encode(), words) >> np.uint64(64 - bits))
                    size += len(held[-1])
                if size > 1 << 20:
                    np.add.at(counts, np.concatenate(held).astype(np.int64), 1)
                    held, size = [], 0
            if held:
                np.add.at(counts, np.concatenate(held).astype(np.int64), 1)
        if counts.any():
            part = TaskContext.get().partitionId() % SKETCH_WAYS
            for block in np.flatnonzero(counts.reshape(-1, SKETCH_BLOCK).any(axis=1)).tolist():
                yield _block_row(block, part, counts[block * SKETCH_BLOCK : (block + 1) * SKETCH_BLOCK])

    def add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_BLOCK, np.int64)
        for x in rows.column("counts"):
            total += np.frombuffer(x.as_py(), "<i8")
        return pa.Table.from_batches([_block_row(key[0].as_py(), 0, total)])

    # a task's counters travel in blocks, and are added up in two steps so that no group grows with the tasks
    kind, scratch = "block int, part int, counts binary, total long", Scratch(docs.sparkSession)
    sums = map_batches(docs.select("text"), run, kind).groupBy("block", "part").applyInArrow(add, kind).groupBy("block").applyInArrow(add, kind)
    sums = scratch.written(sums, "sketch")
    mean = (sums.agg(F.sum("total")).first()[0] or 0) / (1 << bits)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [levels_of(np.frombuffer(x.as_py(), "<i8"), mean).tobytes() for x in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], names=["block", "levels"])

    got = map_batches(sums.select("block", "counts"), level, "block int, levels binary").toArrow()
    out = np.zeros(1 << bits, np.uint8)
    for block, levels in zip(got.column("block").to_pylist(), got.column("levels").to_pylist()):
        out[block * SKETCH_BLOCK : (block + 1) * SKETCH_BLOCK] = np.frombuffer(levels, np.uint8)
    scratch.clear()
    return out


def _block_row(block: int, part: int, counts: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([counts.astype("<i8").tobytes()], pa.binary()), pa.array([int(counts.sum())], pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["block", "part", "counts", "total"])


def levels_of(counts: np.ndarray, mean: float) -> np.ndarray:
    usual = mean + 6 * np.sqrt(mean) + 8
    return np.where(counts > usual, np.minimum(63, 1 + (4 * np.log2(np.maximum(counts, 1) / usual)).astype(np.int64)), 0).astype(np.uint8)


def prefixes(h: np.ndarray, level: np.ndarray, percent: int = PERCENT) -> list[np.ndarray]:
    """The prefix tokens under each order; ``level`` by token."""
    p = prefix_size(len(h), percent)
    out = []
    for seed in _SEEDS:
        rank = (level.astype(np.uint64) << np.uint64(58)) | (mix(h ^ seed) >> np.uint64(6))
        out.append(h[np.argpartition(rank, p - 1)[:p]])
    return out


def signatures(docs: DataFrame, levels: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, s1, s2 (fingerprint of the set), first (tokens), second, third (token hashes), fine.

    fine counts the tokens in ranges of their hash.
    """
    bits = int(len(levels)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at in range(0, batch.num_rows, 512):
                rows = []
                for doc_id, t in zip(ids[at : at + 512], batch.column("text")[at : at + 512]):
                    h = shingle_hashes(t.as_py().encode() if t.is_valid else None, words)
                    if not len(h):
                        rows.append((doc_id, 0, None, None, [], [], [], []))
                        continue
                    f = xxhash.xxh3_128_digest(h.tobytes())
                    s1, s2 = np.frombuffer(f, "<i8").tolist()
                    a, b, c = prefixes(h, levels[(h >> np.uint64(64 - bits)).astype(np.int64)], percent)
                    rows.append((doc_id, len(h), s1, s2, a.view(np.int64), _low(b), _low(c), fine(h)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int8())]
    names = ["doc_id", "n", "s1", "s2", "first", "second", "third", "fine"]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(slim, run, "doc_id long, n long, s1 long, s2 long, first array<long>, second array<int>, third array<int>, fine array<tinyint>")


def fine(h: np.ndarray) -> np.ndarray:
    """Counts cut at 127, which brings two sets no farther apart."""
    return np.minimum(127, np.bincount((h >> np.uint64(64 - FINE_BITS)).astype(np.int64), minlength=1 << FINE_BITS)).astype(np.int8)


def _close(n1, n2, spread1, spread2, percent: int):
    """Whether sizes and spreads allow a link.

    The spreads differ by no more than the sets do; linked sets differ in at most
    (100 - t) / (100 + t) of their summed sizes.
    """
    apart = F.aggregate(F.zip_with(spread1, spread2, lambda a, b: F.abs(a.cast("int") - b.cast("int"))), F.lit(0), lambda s, x: s + x)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * apart.cast("long") <= (100 - percent) * (n1 + n2))


def _low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def least_size(percent: int) -> int:
    """Sets smaller than this link only with equal sets: with one token more or less they are too far apart."""
    return -(-100 // (100 - percent)) - 1 if percent < 100 else 1 << 62


def token_lists(sig: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """token, d, n, pivot: members of every prefix list with two or more of them, equal lists once.

    The pivot is the member whose tokens are shared most, in proportion to its size.
    """
    posts = sig.where(F.col("n") >= least_size(percent)).select(F.explode("first").alias("token"), F.col("doc_id").alias("d"), "n")
    kinds = posts.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("d")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "d")).alias("y"))
    once = kinds.where("m > 1").groupBy("m", "x", "y").agg(F.min("token").alias("token")).select("token", "m")
    once = scratch.written(once, "once")
    release(sig.sparkSession)
    lists = scratch.written(posts.join(small(once), "token"), "lists")
    release(sig.sparkSession)
    weight = scratch.written(lists.groupBy("d").agg((F.sum("m") / F.first("n")).alias("weight")), "weights")
    pivots = lists.join(small(weight), "d").groupBy("token").agg(F.max_by("d", F.struct("weight", -F.col("d"))).alias("pivot"))
    pivots = scratch.written(pivots, "pivots")  # so that the join deals both sides anew and can split a hot token
    return scratch.written(lists.select("token", "d", "n").join(small(pivots), "token"), "stars")


def verify(pairs: DataFrame, docs: DataFrame, scratch: Scratch, words: int = WORDS) -> DataFrame:
    """a, b, both (tokens in common), any (tokens in either), by the whole texts of a and b."""
    ids = scratch.written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = scratch.written(texts.join(small(ids), "id", "left_semi"), "texts")
    one = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            ids = [batch.column(c).to_pylist() for c in ("a", "b")]
            both, either = [], []
            for x, y in zip(batch.column("text_a"), batch.column("text_b")):
                x = x.as_py()
                if x != last:
                    last, own = x, shingle_set(x.encode(), words)
                other = shingle_set(y.as_py().encode(), words)
                k = len(own & other)
                both.append(k)
                either.append(len(own) + len(other) - k)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*ids, both, either)], names=["a", "b", "both", "any"])

    return map_batches(two.select("a", "b", "text_a", "text_b"), run, "a long, b long, both long, any long")


def _share_prefixes(pairs: DataFrame, sig: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs that are close and also share a prefix token under the second and the third order.

    The short counts are compared first, so that prefixes travel for few pairs only.
    """
    pairs = scratch.written(pairs, "candidates")
    near = _close(F.col("n_a"), F.col("n_b"), F.col("fine_a"), F.col("fine_b"), percent)
    close = scratch.written(_beside(pairs, sig, scratch, ["n", "fine"]).where(near).select("a", "b"), "close")
    both = _beside(close, sig, scratch, ["second", "third"])
    return both.where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b")


def _beside(pairs: DataFrame, sig: DataFrame, scratch: Scratch, columns: list[str]) -> DataFrame:
    """Pairs with columns of both documents, of which only those in a pair are shuffled."""
    ids = scratch.written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    near = sig.join(small(ids), "doc_id", "left_semi")
    side = lambda c: near.select(F.col("doc_id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns])
    return pairs.join(side("b"), "b").join(side("a"), "a")


def near_duplicate_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, rep of every row; links a-b between representatives that keep components exact)."""
    spark = docs.sparkSession
    base, tables = Scratch(spark), Scratch(spark)
    rows = docs.count()
    bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], rows.bit_length() + 1))
    sig = base.written(signatures(docs, frequency_levels(docs, bits, words), words, percent), "signatures")
    reps = sig.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    reps = tables.written(reps, "reps")  # so that the join deals both sides anew and can split a hot set
    member = written(
        sig.select("doc_id", "n", "s1", "s2").join(reps, ["n", "s1", "s2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")),
        "members",
    )
    copies = member.where("rep <> doc_id").select("doc_id").distinct()
    own = sig.where("n > 0 and doc_id is not null").join(small(copies), "doc_id", "left_anti")
    stars = token_lists(own, tables, percent)
    release(spark)
    first = stars.where(F.col("d") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("d").alias("b")).distinct()
    first = tables.written(_share_prefixes(first, own, tables, percent), "pairs")
    release(spark)
    known = base.written(verify(first, docs, tables, words), "verified")
    release(spark)
    linked = 100 * F.col("both") >= percent * F.col("any")
    links = known.where(linked).select("a", "b")
    roots = base.written(connected_components(links), "roots")

    # lists whose members are not all in one component yet
    apart = known.groupBy(F.col("a").alias("pivot"), F.col("b").alias("d")).agg(F.max(1 - F.col("both") / F.col("any")).alias("apart"))
    placed = (
        stars.join(roots.select(F.col("node").alias("d"), "root"), "d", "left")
        .join(roots.select(F.col("node").alias("pivot"), F.col("root").alias("main")), "pivot", "left")
        .withColumns({"root": F.coalesce("root", "d"), "main": F.coalesce("main", "pivot")})
    )
    open_ = placed.where("root <> main").select("token").distinct()
    left = placed.join(open_, "token", "left_semi").join(apart, ["pivot", "d"], "left").join(own.select(F.col("doc_id").alias("d"), "fine"), "d")
    left = base.written(left.withColumn("apart", F.when(F.col("d") == F.col("pivot"), 0.0).otherwise(F.col("apart"))), "open")
    tables.clear()
    release(spark)
    x = left.where("root <> main").select("token", F.col("d").alias("x"), F.col("n").alias("xn"), F.col("root").alias("xr"), F.col("apart").alias("xa"), F.col("fine").alias("xf"))
    y = left.select("token", F.col("d").alias("y"), F.col("n").alias("yn"), F.col("root").alias("yr"), F.col("apart").alias("ya"), F.col("fine").alias("yf"), "pivot", (F.col("root") == F.col("main")).alias("inner"))
    far = F.coalesce(F.abs(F.col("xa") - F.col("ya")) <= 1 - percent / 100 + 1e-9, F.lit(True))
    near = _close(F.col("xn"), F.col("yn"), F.col("xf"), F.col("yf"), percent)
    pairs = (
        x.join(y, "token")
        .where((F.col("xr") != F.col("yr")) & (F.col("inner") | (F.col("x") < F.col("y"))) & (F.col("y") != F.col("pivot")) & far & near)
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    second = tables.written(_share_prefixes(pairs, own, tables, percent), "pairs")
    more = verify(second, docs, tables, words).where(linked).select("a", "b")
    links = written(links.union(more), "links")
    tables.clear()
    base.clear()
    release(spark)
    return member, links


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    member, links = near_duplicate_links(docs.select("doc_id", "text"), words, percent)
    same_doc = member.where("rep is not null and rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    several = member.where("rep is not null").select("doc_id", "rep").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    same_doc = same_doc.join(several.select(F.col("doc_id").alias("a")), "a", "left_semi")
    roots = connected_components(links.union(same_doc))
    root = F.coalesce("root", "rep", "doc_id")
    out = member.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), root).alias("component_id"))


def keep_one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that are linked with a row of smaller doc_id (null last).

    Every row counts by itself: docs are written once with a number for each row, and the
    numbers take the place of doc_id. Of rows with equal ids the one of the smaller number stays.
    """
    scratch = Scratch(docs.sparkSession)
    (row,) = free_names(docs.columns, "row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = components(numbered.select(F.col(row).alias("doc_id"), "text"), words, percent)
    found = scratch.written(found.select(F.col("doc_id").alias("row"), "component_id").where("n_shingles > 0"), "components")
    several = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("component_id")
    ids = numbered.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    groups = scratch.written(found.join(several, "component_id").join(ids, "row"), "groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")).select("component_id", F.col("first.row").alias("first"))
    gone = written(groups.join(first, "component_id").where("row <> first").select(F.col("row").alias(row)), "copies")
    scratch.clear()
    return numbered.join(small(gone), row, "left_anti").select(*docs.columns)


def ngram_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id by 4-word shingles and links from 85 in a hundred."""
    return components(docs, 4, 85)
