"""Paired tests and checks of distributions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mcnemar_counts(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Discordant pairs of two binary scores and the exact two-sided p value."""
    out = pairs.groupBy(*keys).agg(
        F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("a_only"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("b_only")
    )
    n = F.col("a_only") + F.col("b_only")
    return out.withColumn("n", n).withColumn("p_value", mcnemar_p(F.least("a_only", "b_only"), n))


def mcnemar_p(k: Column, n: Column) -> Column:
    """min(1, 2 * sum of C(n,i) / 2^n for i up to k): the lower tail of a binomial with p = 1/2.

    The tail is the regularised incomplete beta function at 1/2, taken by its continued
    fraction, which needs some ten terms for small counts and a few roots of n for large ones.
    """

    @F.pandas_udf("double")
    def tail(ks: pd.Series, ns: pd.Series) -> pd.Series:
        k, n = ks.to_numpy(np.float64), ns.to_numpy(np.float64)
        return pd.Series(np.where(n == 0, 1.0, np.minimum(1.0, 2.0 * half_beta(np.maximum(n - k, 1), k + 1))))

    return tail(k, n)


def half_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """I_x(a, b) at x = 1/2, by the modified Lentz form of the continued fraction."""
    flip = a < b  # where the fraction converges slowly, 1 - I(b, a) is taken
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    tiny, x = 1e-300, 0.5
    c, d = np.ones_like(p), 1 / _off_zero(1 - (p + q) * x / (p + 1), tiny)
    h = d.copy()
    for m in range(1, 100_000):
        even = m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / _off_zero(1 + even * d, tiny), _off_zero(1 + even / c, tiny)
        h *= d * c
        odd = -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / _off_zero(1 + odd * d, tiny), _off_zero(1 + odd / c, tiny)
        h *= d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) - (p + q) * math.log(2)) / p
    return np.where(flip, 1 - front * h, front * h)


def _off_zero(x: np.ndarray, tiny: float) -> np.ndarray:
    return np.where(np.abs(x) < tiny, tiny, x)


#: Of 2**16 equal cases, those in which a pair enters a resample not at all, once, twice, and so on:
#: Poisson with mean 1, rounded so that the mean is exactly 1.
_CASES = 1 << 16


def poisson_cases(kinds: int = 9) -> list[int]:
    cases = [round(_CASES * math.exp(-1) / math.factorial(k)) for k in range(kinds)]
    cases[1] += _CASES - sum(k * n for k, n in enumerate(cases))
    cases[0] = _CASES - sum(cases[1:])
    return cases


#: Pairs of a group that one task weighs, pairs weighed at once, and samples taken at once.
ROWS, BATCH_ROWS, BATCH_SAMPLES = 1 << 18, 1024, 2048
_GOLDEN = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def resample_weights(ids: np.ndarray, first: int, samples: int, seed: int) -> np.ndarray:
    """How often each pair enters each of the samples first, first + 1, ... (a multiple of 4): pairs by samples.

    A function of the pair's number, the sample's and the seed, so any task can compute it.
    """
    table = np.repeat(np.arange(len(poisson_cases()), dtype=np.uint8), poisson_cases())
    own = _mixed(ids.astype(np.int64).view(np.uint64) * np.uint64(_GOLDEN) + np.uint64(seed))
    turns = np.arange(first // 4, (first + samples + 3) // 4, dtype=np.uint64)
    drawn = _mixed(own[:, None] + turns[None] * np.uint64(_GOLDEN))
    return table[drawn.view("<u2").reshape(len(ids), -1)[:, :samples]]


def paired_bootstrap(pairs: DataFrame, key: str, samples: int = 10_000, level: float = 0.95, seed: int = 42, row_id: str | None = None) -> DataFrame:
    """Mean difference a - b with a percentile interval of resampled pairs, per group.

    A Poisson bootstrap: each pair enters a resample 0, 1, 2, ... times, drawn by the hash of
    its number (``row_id``, a long; without it rows are numbered as they lie), so the sums of a
    resample are sums over tasks. A group's pairs are dealt to tasks of ``ROWS``, each of which
    keeps two sums for every sample and no pair; the sums meet by sample. Pairs with a NULL
    in a or b don't count; a resample without any pair has no mean and is left out.
    """
    if samples % 4:
        raise ValueError("samples must be a multiple of 4")
    number = F.monotonically_increasing_id() if row_id is None else F.col(row_id).cast("long")
    d = pairs.where("a is not null and b is not null").select(F.col(key).alias("k"), number.alias("id"), (F.col("a").cast("double") - F.col("b").cast("double")).alias("d"))
    groups = d.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("total"))
    ways = groups.where(F.col("n") > ROWS).select(F.col("k").alias("large"), F.ceil(F.col("n") / ROWS).cast("int").alias("ways"))
    dealt = d.join(ways, F.col("k").eqNullSafe(F.col("large")), "left").withColumn("way", F.pmod(F.xxhash64("id"), F.coalesce("ways", F.lit(1))))
    dealt = dealt.select("k", "way", "id", "d").repartition("k", "way").sortWithinPartitions("k", "way")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, sums, sizes = None, None, None
        for batch in batches:
            keys, ways_ = batch.column("k"), batch.column("way").to_numpy(zero_copy_only=False)
            ids, own = batch.column("id").to_numpy(zero_copy_only=False), batch.column("d").to_numpy(zero_copy_only=False)
            codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False) if keys.null_count == 0 else np.array([hash(x) for x in keys.to_pylist()])
            edges = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (ways_[1:] != ways_[:-1])) + 1).tolist(), len(codes)] if len(codes) else [0]
            for low, high in zip(edges, edges[1:]):
                at = (keys[low].as_py(), int(ways_[low]))
                if at != open_:
                    if open_ is not None:
                        yield _sums(open_, sums, sizes, keys.type)
                    open_, sums, sizes = at, np.zeros(samples), np.zeros(samples, np.int64)
                for r in range(low, high, BATCH_ROWS):
                    rows = slice(r, min(high, r + BATCH_ROWS))
                    for s in range(0, samples, BATCH_SAMPLES):
                        some = slice(s, min(samples, s + BATCH_SAMPLES))
                        w = resample_weights(ids[rows], s, some.stop - s, seed)
                        sums[some] += own[rows] @ w.astype(np.float64)
                        sizes[some] += w.sum(0, dtype=np.int64)
        if open_ is not None:
            yield _sums(open_, sums, sizes, keys.type)

    kind = d.schema["k"].dataType.simpleString()
    parts = dealt.mapInArrow(weigh, f"k {kind}, sums array<double>, sizes array<long>")
    each = parts.select("k", F.posexplode(F.arrays_zip("sums", "sizes")).alias("sample", "x"))
    each = each.groupBy("k", "sample").agg(F.sum("x.sums").alias("sum"), F.sum("x.sizes").alias("size")).where("size > 0")
    means = each.groupBy("k").agg(F.sort_array(F.collect_list(F.col("sum") / F.col("size"))).alias("means"))  # one for each sample
    out = groups.alias("g").join(means.withColumnRenamed("k", "k_"), F.col("g.k").eqNullSafe(F.col("k_")))
    tail = (1 - level) / 2
    at = lambda p: F.get("means", F.least(F.size("means") - 1, F.floor(F.size("means") * F.lit(p)).cast("int")))
    return out.select(F.col("g.k").alias(key), (F.col("total") / F.col("n")).alias("difference"), at(tail).alias("low"), at(1 - tail).alias("high"), "n")


def _sums(at: tuple, sums: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at[0]], kind), pa.array([sums], pa.list_(pa.float64())), pa.array([sizes], pa.list_(pa.int64()))], names=["k", "sums", "sizes"])


def answer_imbalance(answers: DataFrame, key: str, answer: str, options: list[str]) -> DataFrame:
    """Options whose share of the answers is off: |count - n/k| > max(2, 20 % of n/k)."""
    counts = answers.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(answer) == o).alias(f"n_{o}") for o in options])
    want = F.col("n") / len(options)
    off = [F.abs(F.col(f"n_{o}") - want) > F.greatest(F.lit(2.0), want * 0.2) for o in options]
    return counts.withColumn("imbalanced", reduce(lambda x, y: x | y, off))
