"""Yinyang clustering against plain Lloyd rounds in integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import yinyang


def plain_lloyd(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [q for _, q in order[:k]]
    for turn in range(rounds + 1):
        got = [min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centroids)) for _, q in kept]
        if turn < rounds:
            for j in range(len(centroids)):
                own = [q for (_, q), (_, at) in zip(kept, got) if at == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((i, j, d) for (i, _), (d, j) in zip(kept, got)), centroids


def blobs(n, dims, seed, middles=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (middles, dims))
    return (middle[rng.integers(0, middles, n)] + rng.normal(0, 0.2, (n, dims))).round(3)


@pytest.mark.parametrize("k,rounds,dims,group_size", [(16, 3, 8, 4), (16, 3, 8, 1), (7, 6, 3, 3), (20, 4, 2, 20), (1, 2, 4, 4)])
def test_equals_plain_rounds(spark, k, rounds, dims, group_size):
    rows = [(i, v.tolist()) for i, v in enumerate(blobs(300, dims, k + dims))]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # copies: ties between equal centroids
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out, centroids = yinyang.yinyang(df, k=k, rounds=rounds, dims=dims, group_size=group_size)
    want, middles = plain_lloyd(rows, k, rounds, dims)
    assert sorted((r.key, r.cluster, r.distance) for r in out.collect()) == want
    assert centroids.tolist() == middles


def test_filters_leave_measurements_out(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(blobs(2000, 16, 3, 16))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, _ = yinyang.yinyang(df, rounds=5, dims=16)
    scanned = out.agg(F.avg("scanned")).first()[0]
    assert 16 + 1 <= scanned < 0.6 * 6 * 16  # the first pass measures all, the others far fewer


def test_every_bound_holds():
    rng = np.random.default_rng(5)
    x = rng.integers(-500, 500, (400, 6))
    c = x[:12].copy()
    step = yinyang.Step(c, None, yinyang.grouped(c))
    cluster, best, upper, lower, _ = step.assign(x, None, None, None)
    for _ in range(6):
        now = c + rng.integers(-40, 40, c.shape) * (rng.random((12, 1)) < 0.5)
        moved = np.sqrt(((now - c) ** 2).sum(1).astype(float)) * (1 + 1e-12)
        c = now
        step = yinyang.Step(c, moved, step.group, last=True)
        cluster, best, upper, lower, scanned = step.assign(x, cluster, upper, lower)
        true = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (true.argmin(1) == cluster).all() and (true.min(1) == best).all() and (scanned <= 12).all()
        for g in range(step.group.max() + 1):
            others = np.where((step.group == g)[None] & (np.arange(12)[None] != cluster[:, None]), np.sqrt(true.astype(float)), np.inf).min(1)
            assert (lower[:, g] <= others + 1e-6).all()


def test_edges(spark):
    good = [0.5] * 64
    rows = [
        (1, good, "a"), (1, good, "b"), (None, good, "c"), (2, None, "d"), (3, [0.5] * 63, "e"), (4, [float("nan")] + good[1:], "f"),
        (5, [float("inf")] + good[1:], "g"), (6, [None] + good[1:], "h"), (7, [-0.001] + good[1:], "i"), (8, [1e300] + good[1:], "j"), (9, [], "k"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    got = yinyang.cluster_digest(df).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "7", "None"]
    assert {r.inertia for r in got} == {0} and {r.distance for r in got} == {0}
    third = next(r for r in got if r.vec_id == 7)
    assert third.centroid_sha256 == hashlib.sha256(",".join(["-1"] + ["32"] * 63).encode()).hexdigest()
    empty = yinyang.cluster_digest(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
