"""Suffix-sigma against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lectern.llm import collocations as co
from lectern.llm.common import Scratch


def plain_counts(rows, max_n=4):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, max_n + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    return counts, totals


def plain_collocations(rows, least=30, top=2000, max_n=4):
    counts, totals = plain_counts(rows, max_n)
    found = {}
    for (lang, w), a in counts.items():
        if len(w) > 1 and a >= least:
            cuts = [(2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found[lang, w] = (a, counts[lang, w[:k]], counts[lang, w[k:]], score)
    out = []
    for lang in {x for x, _ in found}:
        own = {w: v for (x, w), v in found.items() if x == lang}
        gone = {w[i : i + m] for w in own for m in range(2, len(w)) for i in range(len(w) - m + 1) if w[i : i + m] in own and 100 * own[w][0] >= 80 * own[w[i : i + m]][0]}
        ranked = sorted(((-s, -a, " ".join(w).encode(), a, l, r, s) for w, (a, l, r, s) in own.items() if w not in gone))
        out += [(lang, k + 1, p.decode(), a, l, r, totals[lang], s) for k, (_, _, p, a, l, r, s) in enumerate(ranked[:top])]
    return sorted(out)


def corpus(seed, docs=120, words="the of and a House tree\x01 x\x00y z\x0e é 中文 \x1f".split(" ")):
    rng = random.Random(seed)
    out = []
    for _ in range(docs):
        text = "".join(rng.choices(words, range(len(words), 0, -1))[0] + rng.choice([" "] * 8 + ["\t", ". ", ",", "\n", " ;", "\r\n", "  "]) for _ in range(rng.choice([0, 3, 60, 300])))
        out.append((rng.choice(["en", "en", "en", None, "und", "", "l\n1"]), text))
    return out + [("en", None), (None, ""), ("xx", " .,;"), ("en", out[0][1]), ("en", out[0][1])]


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("seed,least,top", [(1, 30, 2000), (2, 2, 2000), (3, 5, 7)])
def test_equals_plain_counting(spark, seed, least, top):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, *r, 9) for i, r in enumerate(rows)], "doc_id long, lang string, text string, `rank` int").repartition(5)
    got = rows_of(co.collocations(df, least=least, top=top))
    assert got == plain_collocations(rows, least, top) and got


def test_without_the_set_of_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(co, "FREQUENT_BYTES", 0)
    monkeypatch.setattr(co, "HELD", 5)
    monkeypatch.setattr(co, "POSITIONS", 100)
    rows = corpus(4, 40)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert rows_of(co.collocations(df, least=4)) == plain_collocations(rows, 4)


def test_hot_first_words_are_split(spark):
    rows = [("en", "the " + " the ".join(f"w{i % 7} v{i % 11}" for i in range(400))) for _ in range(5)]
    rows += [("en", "of the " + " of the ".join(f"x{i % 5} y{i % 3}" for i in range(300))) for _ in range(30)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    phrases, _ = co.phrase_counts(df, least=10)
    words = Counter({k[1][0]: n for k, n in plain_counts(rows)[0].items() if len(k[1]) == 1})
    assert max(words.values()) > sum(words.values()) // 8  # one of them is over half a partition's share
    found = {tuple(r.word.split("\n")[1:]) for r in co.word_counts(df, 4).collect()}
    assert ("of", "the") in found  # and this pair is dealt by all that follows it
    assert {r.split for r in co.prefix_counts(co.suffixes(df, None, {b"en\nof": 3, b"en\nof\nthe": 4}).sortWithinPartitions(F.desc("suffix")), 4, 10).collect()} == {True, False}
    want = {(lang, " ".join(w), n) for (lang, w), n in plain_counts(rows)[0].items() if n >= 10}
    assert {(r.lang, r.phrase, r.f) for r in phrases.collect()} == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, text string")
    out = co.collocations(df)
    assert out.count() == 0 and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_products_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    df = spark.createDataFrame([("x", "a b", 2, big // 2), ("x", "a", 1, big // 2 + 5), ("x", "b", 1, big - 7), ("x", "a b c", 3, big // 3), ("x", "c", 1, big // 3), ("x", "b c", 2, big // 3)], "lang string, phrase string, size int, f long")
    got = {r.phrase: (r.score, r.l, r.r) for r in co.scored(df, Scratch(spark)).collect()}
    assert got["a b"][0] == 2_000_000 * (big // 2) // (big // 2 + 5 + big - 7)
    cuts = [(2_000_000 * (big // 3) // (x + y), x, y) for x, y in ((big // 2 + 5, big // 3), (big // 2, big // 3))]
    assert got["a b c"] == min(cuts, key=lambda c: c[0])
    kept = {r.phrase for r in co.uncovered(co.scored(df, Scratch(spark)), df).collect()}
    assert kept == {"a b", "a b c"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("ab"), min_size=1, max_size=3), st.integers(1, 5)), min_size=1, max_size=25), st.integers(1, 6))
def test_stack_over_batches(rows, batch):
    rows = sorted((("\n".join(["l", *w]), n) for w, n in rows), reverse=True)
    stack, got = co.PrefixStack(3, 4), []
    for at in range(0, len(rows), batch):
        part = rows[at : at + batch]
        got += stack.push(pa.array([s for s, _ in part]), np.zeros(len(part), np.int32), np.array([n for _, n in part]))
    got += stack.close()
    want = Counter()
    for s, n in rows:
        words = s.split("\n")[1:]
        for k in range(1, len(words) + 1):
            want[" ".join(words[:k])] += n
    assert Counter({p.decode(): f for _, p, _, f, _ in got}) == Counter({p: n for p, n in want.items() if n >= 4}) and len({p for _, p, *_ in got}) == len(got)
