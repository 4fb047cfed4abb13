"""Near duplicates by min-max hashing of word shingles.

Each permutation of the hash values gives two entries of the signature, the smallest and the
largest value of the set, so half as many permutations have to be evaluated. Two sets agree in
either entry with a probability equal to their Jaccard similarity, and as both entries can't
fall on the same token (of two or more), the estimate varies less than one from as many
independent minima.

1. Equal sets are collapsed to one representative, the smallest doc_id.
2. Bands of ``ROWS`` entries, all minima or all maxima of different permutations, make lists of
   documents that agree in a whole band. Lists with the same members are kept once.
3. Each list is compared with its pivot: sizes and the spread of the hashes first, then the
   full sets. Links so far give components.
4. Lists that still hold several components are compared across components, as far as sizes,
   spreads, and the triangle inequality of the Jaccard distance (with the pivot) leave a link
   possible. The pairs of a large list are dealt to several tasks.

Every pair that shares a band is thus compared, ruled out by an exact bound, or inside one
component already; a group of m copies costs about m comparisons. Two sets at exactly 85 in a
hundred share none of the ``BANDS`` bands with a probability of (1 - 0.85**5)**26 = 2.4e-7,
closer sets with less; for percentages below 80 take more bands.

Edge cases: null or wordless text has no shingles and is linked with nothing; fewer words
than a shingle are one; rows with a null doc_id are measured but not linked (component_id null, kept); repeated rows get equal results;
rows with one doc_id and different texts are linked with each other; texts of any length
count whole; doc_id must be an integer; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, map_batches, release, small, written
from lectern.llm.components import connected_components
from lectern.llm.ngram_join import _close as close_sets
from lectern.llm.ngram_join import fine, mix, shingle_hashes, token_lists, verify

WORDS, PERCENT = 3, 85
ROWS, BANDS = 5, 26
#: Permutations; each gives two entries.
PERMUTATIONS = ROWS * BANDS // 2
#: Tokens that are permuted at once.
BLOCK = 4096
#: Pairs of a list that one task compares.
PAIRS = 1 << 20


def multipliers(n: int = PERMUTATIONS) -> np.ndarray:
    """Odd numbers: multiplication by one is a permutation of the 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_ODD = multipliers()


def min_max(h: np.ndarray, odd: np.ndarray = _ODD) -> np.ndarray:
    """All minima, then all maxima, of the set under the permutations."""
    low, high = np.full(len(odd), ~np.uint64(0)), np.zeros(len(odd), np.uint64)
    for at in range(0, len(h), BLOCK):
        moved = odd[:, None] * h[None, at : at + BLOCK]
        np.minimum(low, moved.min(1), out=low)
        np.maximum(high, moved.max(1), out=high)
    return np.concatenate([low, high])


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band; the number of the band is part of it."""
    cut = signature[: len(signature) // rows * rows].reshape(-1, rows)
    key = mix(np.arange(1, len(cut) + 1, dtype=np.uint64))
    for k in range(rows):
        key = mix(key ^ cut[:, k]) + np.uint64(k)
    return key


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """The unbiased estimate of the similarity: the share of equal entries."""
    return float((a == b).mean())


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n, s1, s2 (fingerprint of the set), bands, fine (tokens by range of their hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at in range(0, batch.num_rows, 512):
                rows = []
                for doc_id, t in zip(ids[at : at + 512], batch.column("text")[at : at + 512]):
                    h = shingle_hashes(t.as_py().encode() if t.is_valid else None, words)
                    if len(h):
                        s1, s2 = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), "<i8").tolist()
                        rows.append((doc_id, len(h), s1, s2, bands(min_max(h)).view(np.int64), fine(h)))
                    else:
                        rows.append((doc_id, 0, None, None, [], []))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.int8())]
    names = ["doc_id", "n", "s1", "s2", "bands", "fine"]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(slim, run, "doc_id long, n long, s1 long, s2 long, bands array<long>, fine array<tinyint>")


def _compared(pairs: DataFrame, own: DataFrame, docs: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """a, b, both, any of the pairs whose sizes and spreads allow a link."""
    side = lambda c: own.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("fine").alias(f"fine_{c}"))
    pairs = scratch.written(pairs, "candidates")
    near = close_sets(F.col("n_a"), F.col("n_b"), F.col("fine_a"), F.col("fine_b"), percent)
    close = pairs.join(side("b"), "b").join(side("a"), "a").where(near).select("a", "b").distinct()
    return verify(scratch.written(close, "close"), docs, scratch, words)


def _across(stars: DataFrame, own: DataFrame, known: DataFrame, roots: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """a, b: pairs of one list in different components for which no bound rules a link out."""
    apart = known.groupBy(F.col("a").alias("pivot"), F.col("b").alias("d")).agg(F.when(F.count(F.lit(1)) == 1, F.max(1 - F.col("both") / F.col("any"))).alias("apart"))  # no bound for a doc_id with several texts
    placed = (
        stars.join(roots.select(F.col("node").alias("d"), "root"), "d", "left")
        .join(roots.select(F.col("node").alias("pivot"), F.col("root").alias("main")), "pivot", "left")
        .withColumns({"root": F.coalesce("root", "d"), "main": F.coalesce("main", "pivot")})
    )
    placed = scratch.written(placed.join(apart, ["pivot", "d"], "left"), "placed")
    # a list's pairs are dealt to as many tasks as they need: every y once, every x to all of them
    sizes = placed.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("root") != F.col("main"), 1)).alias("out")).where("out > 0")
    ways = scratch.written(sizes.select("token", (1 + F.col("m") * F.col("out") / PAIRS).cast("int").alias("ways")), "ways")
    left = placed.where("d <> pivot").join(small(ways), "token").join(own.select(F.col("doc_id").alias("d"), "fine"), "d")
    left = scratch.written(left, "open")
    side = lambda c: [F.col(k).alias(f"{c}{k}") for k in ("d", "n", "root", "apart", "fine")]
    x = left.where("root <> main").withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).select("token", "way", *side("x"))
    y = left.withColumn("way", F.pmod(F.xxhash64("d"), "ways").cast("int")).select("token", "way", *side("y"), (F.col("root") == F.col("main")).alias("inner"))
    far = F.coalesce(F.abs(F.col("xapart") - F.col("yapart")) <= 1 - percent / 100 + 1e-9, F.lit(True))
    near = close_sets(F.col("xn"), F.col("yn"), F.col("xfine"), F.col("yfine"), percent)
    other = (F.col("xroot") != F.col("yroot")) & (F.col("inner") | (F.col("xd") < F.col("yd")))
    return x.join(y, ["token", "way"]).where(other & far & near).select(F.least("xd", "yd").alias("a"), F.greatest("xd", "yd").alias("b")).distinct()


def near_duplicate_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, rep of every row; links a-b between representatives that keep components exact)."""
    spark = docs.sparkSession
    base, tables = Scratch(spark), Scratch(spark)
    sig = base.written(signatures(docs, words), "signatures")
    reps = tables.written(sig.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "reps")
    rep = F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")
    member = written(sig.select("doc_id", "n", "s1", "s2").join(reps, ["n", "s1", "s2"], "left").select("doc_id", "n", "s1", "s2", rep), "members")
    copies = member.where("rep <> doc_id").select("doc_id", "s1", "s2").distinct()
    own = sig.where("n > 0 and doc_id is not null").join(small(copies), ["doc_id", "s1", "s2"], "left_anti")
    again = tables.written(member.where("rep is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id"), "again")
    once = own.join(small(again), "doc_id", "left_semi").dropDuplicates(["doc_id", "s1", "s2"])
    own = base.written(own.join(small(again), "doc_id", "left_anti").unionByName(once), "own")
    stars = base.written(token_lists(own.select("doc_id", "n", F.col("bands").alias("first")), tables, percent), "stars")
    tables.clear()
    release(spark)
    first = stars.where(F.col("d") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("d").alias("b")).distinct()
    known = base.written(_compared(first, own, docs, tables, words, percent), "verified")
    tables.clear()
    release(spark)
    linked = 100 * F.col("both") >= percent * F.col("any")
    links = known.where(linked).select("a", "b")
    roots = base.written(connected_components(links), "roots")
    pairs = tables.written(_across(stars, own, known, roots, tables, percent), "pairs")
    more = _compared(pairs, own, docs, tables, words, percent).where(linked).select("a", "b")
    links = written(links.union(more), "links")
    tables.clear()
    base.clear()
    release(spark)
    return member.select("doc_id", "n", "rep"), links


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    member, links = near_duplicate_links(docs.select("doc_id", "text"), words, percent)
    # rows of one doc_id with different texts belong together
    same_doc = member.where("rep is not null and rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    several = member.where("rep is not null").select("doc_id", "rep").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    same_doc = same_doc.join(several.select(F.col("doc_id").alias("a")), "a", "left_semi")
    roots = written(connected_components(links.union(same_doc)), "roots")
    out = member.join(small(roots.withColumnRenamed("node", "rep")), "rep", "left")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(root == F.col("doc_id"), F.lit(True)).alias("kept"))
