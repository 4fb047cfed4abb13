"""Min-max hashing against all pairs."""

import random

import numpy as np
import pytest

from lectern.llm import minmax
from lectern.llm.ngram_join import mix, shingle_set


def plain_components(rows, words=3, percent=85):
    sets = {}
    for doc_id, text in rows:
        sets.setdefault(doc_id, []).append(shingle_set((text or "").encode(), words))
    low = {d: d for d in sets if d is not None}

    def find(d):
        while low[d] != d:
            d = low[d]
        return d

    ids = sorted(low)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    out = []
    for doc_id, text in rows:
        c = None if doc_id is None else find(doc_id)
        out.append((doc_id, len(shingle_set((text or "").encode(), words)), c, doc_id is None or c == doc_id))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minmax.near_duplicates(df).collect()], key=str)


def corpus(seed, groups=25):
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 4, 8, 9, 40, 120]))
        for _ in range(rng.choice([1, 2, 3, 6])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(4)
    assert got(df) == plain_components(rows)


def test_edges(spark):
    long_ = " ".join(f"a{i}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one"), (None, "one two"), (None, None), (7, long_), (8, long_ + " b"), (8, long_ + " b"),
        (9, "x y z " * 30), (9, long_ + " c"), (10, "x y z " * 40), (11, "x y z q r s t u v w"), (11, "x y z q r s t u v w"), (12, "x y z q r s t u v w"),
    ]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain_components(rows)
    assert minmax.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_groups_of_copies_and_chains(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base)) for i in range(300)]
    text = list(base)
    for k in range(60):  # a chain: neighbours are near, its ends are far apart
        text[(7 * k) % 100] = f"v{k}"
        rows.append((1000 + k, " ".join(text)))
    rows += [(2000 + i, " ".join([*base, f"u{i}", rng.choice("abc")])) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(df) == plain_components(rows)


def test_pairs_of_a_list_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(minmax, "PAIRS", 3)
    rows = corpus(7, 40)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain_components(rows)


def test_estimate_is_unbiased_and_varies_less_than_minima():
    rng, errors, minima = np.random.default_rng(1), [], []
    for _ in range(300):
        x = mix(rng.integers(0, 1 << 63, 30, np.uint64))
        a, b = minmax.min_max(x[:22]), minmax.min_max(x[8:])  # 14 of 30
        errors.append(minmax.estimate(a, b) - 14 / 30)
        half = len(a) // 2
        minima.append(minmax.estimate(a[:half], b[:half]) - 14 / 30)
    assert abs(np.mean(errors)) < 0.01
    # both entries of half as many permutations: at most the variance of as many independent minima
    n = minmax.ROWS * minmax.BANDS
    assert np.var(errors) < 1.15 * (14 / 30) * (16 / 30) / n < 0.75 * np.var(minima)


def test_min_max_by_blocks():
    h = mix(np.arange(10_000, dtype=np.uint64))
    want = minmax.multipliers(5)[:, None] * h[None]
    assert (minmax.min_max(h, minmax.multipliers(5)) == np.concatenate([want.min(1), want.max(1)])).all()
    assert len(minmax.bands(minmax.min_max(h))) == minmax.BANDS == len(set(minmax.bands(np.zeros(130, np.uint64)).tolist()))
