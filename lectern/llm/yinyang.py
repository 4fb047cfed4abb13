"""Exact k-means in integers with Yinyang filters.

The first pass measures every vector against every centroid. The first centroids are dealt
into groups once. From then on a vector carries its cluster, an upper bound of the distance to
its own centroid and one lower bound per group: no other centroid of the group is nearer than
that. After centroids have moved, a pass

1. widens the bounds by the moves: the upper one by that of the vector's own centroid, a
   group's lower one by those of its centroids,
2. filters globally: where the least lower bound is above the upper bound, also after the
   upper bound has been measured anew, the vector keeps its cluster,
3. filters by group: groups whose lower bound is above the distance to the nearest centroid
   found so far are left out; in the others centroids are left out by their own moves,
4. measures the centroids that survive, exactly, in integers, and renews the bounds.

Bounds are floating-point numbers with a margin of ``MARGIN`` of the largest distance possible,
far more than rounding can add up to; distances and ties are decided in integers. So filters
only save measurements and never change a result. ``scanned`` counts the measurements of a
vector in all passes: without filters it would be passes * k.

Vectors stay in their partitions: a pass is one mapInArrow over the state written before, and
the new centroids are one aggregate of the state (k rows). The driver holds k centroids.

Edge cases: vectors that are null, have another number of components, or have a null or
non-finite component are left out, as are those with a component above 2**27 in size after
scaling, whose squared distances no long could hold; rows with a null or repeated key count
one by one (a null key is never a first centroid while others are there); with fewer vectors
than k there are fewer centroids; equal distances go to the smaller number; a cluster without
vectors keeps its centroid; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from lectern.llm.common import Scratch, map_batches, written

K, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
#: Centroids of a group.
GROUP_SIZE = 4
#: Rows that are measured at once.
BLOCK = 4096
MARGIN = 1e-9
#: Largest component in size: (2 * 2**27)**2 * 64 components fit a long.
LARGEST = 1 << 27


def quantised(vectors: DataFrame, key: str, vector: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """key, q: floor(scale * component) of the vectors that count."""
    x = F.col(vector).cast("array<double>")
    fits = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < LARGEST / scale))  # false for NaN, which is above all
    return vectors.where(F.coalesce(fits, F.lit(False))).select(F.col(key).alias("key"), F.transform(x, lambda v: F.floor(v * scale).cast("int")).alias("q"))


def first_centroids(points: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose keys have the smallest digests, in that order."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("key").cast("string")), 256)
    rows = points.select("q", digest.alias("digest")).orderBy(F.asc_nulls_last("digest"), "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to one centroid."""
    diff = x - c
    return np.einsum("ij,ij->i", diff, diff)


def grouped(centroids: np.ndarray, size: int = GROUP_SIZE) -> np.ndarray:
    """The group of each centroid: a few rounds of clustering among the centroids themselves."""
    k = len(centroids)
    n = max(1, -(-k // size))
    middles = centroids[np.linspace(0, k - 1, n).astype(int)].astype(float)
    for _ in range(5):
        group = np.argmin(((centroids[:, None, :] - middles[None]) ** 2).sum(2), axis=1)
        for g in range(n):
            if (group == g).any():
                middles[g] = centroids[group == g].mean(0)
    return np.unique(group, return_inverse=True)[1]


@dataclass
class Step:
    """Centroids, how far each has moved since the pass before (None in the first pass), and their groups."""

    centroids: np.ndarray
    moved: np.ndarray | None
    group: np.ndarray
    #: The last pass measures the distance to the own centroid of every vector, as it is a result.
    last: bool = False

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """cluster, squared distance, upper, lower (rows by groups), measurements."""
        m, k = len(x), len(self.centroids)
        at = np.arange(m)
        largest = np.sqrt(float(x.shape[1])) * float(max(np.abs(x).max(initial=0), np.abs(self.centroids).max(initial=0)) * 2 + 1)
        slack = MARGIN * largest
        if self.moved is None:
            exact = np.stack([squared(x, c) for c in self.centroids], 1)
            near = np.sqrt(exact.astype(float))
            cluster = exact.argmin(1)  # the first of equals, so the smaller number
            best = exact[at, cluster]
            return cluster, best, np.sqrt(best.astype(float)), self._lower(near, cluster), np.full(m, k)
        # no centroid but the own one is nearer than this
        near = lower[:, self.group] - self.moved[None]
        upper = upper + self.moved[cluster]
        near[at, cluster] = np.inf
        bound = self._lower(near, cluster)
        least = bound.min(1)
        measured = self.last | (least <= upper + slack)  # the others pass the global filter as they are
        best, scanned = np.full(m, -1, np.int64), measured.astype(np.int64)
        for c in range(k):
            own = np.flatnonzero(measured & (cluster == c))
            best[own] = squared(x[own], self.centroids[c])
        reach = np.where(measured, np.sqrt(np.maximum(best, 0).astype(float)), upper)
        near[at, cluster] = reach
        open_ = np.flatnonzero(measured & (least <= reach + slack))
        found = cluster.copy()
        for g in range(bound.shape[1]):
            rows = open_[bound[open_, g] <= reach[open_] + slack]
            for c in np.flatnonzero(self.group == g):
                left = rows[(near[rows, c] <= reach[rows] + slack) & (cluster[rows] != c)]
                if not len(left):
                    continue
                d = squared(x[left], self.centroids[c])
                near[left, c] = np.sqrt(d.astype(float))
                scanned[left] += 1
                wins = (d < best[left]) | ((d == best[left]) & (c < found[left]))
                won = left[wins]
                best[won], found[won] = d[wins], c
                reach[won] = near[won, c]
        return found, best, reach, self._lower(near, found), scanned

    def _lower(self, near: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Per group the least entry of near, the own centroid's left out."""
        others = near.copy()
        others[np.arange(len(near)), cluster] = np.inf
        return np.stack([others[:, self.group == g].min(1) for g in range(self.group.max() + 1)], 1)


def _pass(state: DataFrame, step: Step) -> DataFrame:
    """The state after one assignment: key, q, cluster, distance, upper, lower, scanned."""
    first = step.moved is None
    dims = step.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                x = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
                old = [None] * 3
                if not first:
                    lower = batch.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                    old = [batch.column("cluster").to_numpy().astype(np.int64), batch.column("upper").to_numpy(), lower]
                cluster, best, upper, lower, scanned = step.assign(x, *old)
                if not first:
                    scanned = scanned + batch.column("scanned").to_numpy()
                offsets = np.arange(len(x) + 1, dtype=np.int32) * lower.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key"), batch.column("q"), pa.array(cluster, pa.int32()), pa.array(best, pa.int64()), pa.array(upper, pa.float64()),
                        pa.ListArray.from_arrays(offsets, pa.array(lower.ravel(), pa.float64())), pa.array(scanned, pa.int32()),
                    ],
                    names=["key", "q", "cluster", "distance", "upper", "lower", "scanned"],
                )

    added = [
        StructField("cluster", IntegerType()), StructField("distance", LongType()), StructField("upper", DoubleType()),
        StructField("lower", ArrayType(DoubleType())), StructField("scanned", IntegerType()),
    ]
    return map_batches(state, run, StructType([state.schema["key"], state.schema["q"], *added]))


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) by component; a cluster without vectors keeps its centroid."""
    sums = [F.sum(F.get("q", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # k rows
        out[row.cluster] = [s // row.n for s in row[2:]]
    return out


def yinyang(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: int = SCALE,
    salt: str = "1:",
    group_size: int = GROUP_SIZE,
) -> tuple[DataFrame, np.ndarray]:
    """(key, q, cluster, distance, scanned of every vector that counts; the final centroids)."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    points = scratch.written(quantised(vectors, key, vector, dims, scale), "points")
    centroids = first_centroids(points, k, salt)
    if not len(centroids):
        scratch.clear()
        return spark.createDataFrame([], StructType([points.schema["key"], points.schema["q"], StructField("cluster", IntegerType()), StructField("distance", LongType()), StructField("scanned", IntegerType())])), centroids
    step = Step(centroids, None, grouped(centroids, group_size))
    state = points
    for turn in range(rounds):
        past, scratch_next = scratch, Scratch(spark)
        state = scratch_next.written(_pass(state, step), "state")
        past.clear()
        scratch = scratch_next
        now = moved_centroids(state, step.centroids)
        # a little more than the move, so that rounding can't shorten it
        moved = np.sqrt(np.array([float(squared(a[None], b)[0]) for a, b in zip(now, step.centroids)])) * (1 + 1e-12)
        step = Step(now, moved, step.group, last=turn == rounds - 1)
    out = written(_pass(state, step).select("key", "q", "cluster", "distance", "scanned"), "clusters")
    scratch.clear()
    return out, step.centroids


def cluster_digest(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that counts."""
    spark = vectors.sparkSession
    out, centroids = yinyang(vectors)
    sums = {r.cluster: r.d for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    rows = [(c, sums[c], sum(sums.values()), ",".join(map(str, centroids[c].tolist()))) for c in sorted(sums)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, components string")
    about = about.select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    joined = out.join(F.broadcast(about), "cluster")  # k rows
    return joined.select(F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
