"""Corpus operators against plain versions on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import chat_format, decontaminate, fertility, language_id, line_dedup, ngram_join, sharding
from lectern.llm.components import connected_components

# -- decontamination ------------------------------------------------------------------------


def plain_hits(words, items, window):
    hit, found = [0] * len(words), set()
    for k, w in enumerate(items):
        size = min(window, len(w))
        for a in range(len(w) - size + 1 if w else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == w[a : a + size]:
                    found.add(k)
                    hit[at : at + size] = [1] * size
    return hit, found


LETTERS = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)


@settings(max_examples=400, deadline=None)
@given(st.lists(LETTERS, max_size=5), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=30), st.integers(1, 5))
def test_automaton_equals_plain_matching(items, words, window):
    spans, found = decontaminate.SuffixAutomaton(list(enumerate(items)), window).match(words)
    hit = [0] * len(words)
    for a, b in spans:
        hit[a:b] = [1] * (b - a)
    assert (hit, found) == plain_hits(words, items, window)


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "Short ITEM!"), (3, None), (4, "--"), (2, "Short ITEM!")], "item_id long, text string")
    d = spark.createDataFrame(
        [(1, "x one two three four five six seven eight nine ten y", 1, "k"), (2, None, 2, "k"), (3, "", 3, None), (4, "a short-item here " + "and more words " * 3, 4, "k"), (5, "clean", 5, "k"), (5, "clean", 5, "k")],
        "doc_id long, text string, n_chars long, n_words string",
    )
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination_digest(d, bench).collect()}
    assert got == {1: (12, 10, 1, True), 2: (0, 0, 0, False), 3: (0, 0, 0, False), 4: (13, 2, 1, True), 5: (1, 0, 0, False)}
    kept = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.decontaminate(d, bench, max_span_words=0).collect()}
    assert 1 not in kept and kept[2] == (None, 2) and kept[4][0].startswith("a  here and") and kept[4][1] == len(kept[4][0])
    assert decontaminate.contamination_digest(d, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination_digest(d.limit(0), bench).count() == 0
    odd = d.withColumns({"hit_spans": F.lit("own"), "Cut": F.lit(7), "cut_": F.lit(8)})
    kept = decontaminate.decontaminate(odd, bench)
    assert kept.columns == odd.columns and {(r.n_words, r.hit_spans, r.Cut, r.cut_) for r in kept.collect()} == {("k", "own", 7, 8), (None, "own", 7, 8)}
    assert dict(decontaminate.find_hits(odd, bench).dtypes)["n_words"] == "bigint"
    blocks = decontaminate.find_hits(d, bench, max_words=5)
    assert {r.doc_id: len(r.hit_items) for r in blocks.collect()} == {1: 1, 2: 0, 3: 0, 4: 1, 5: 0}


def test_blocks_hold_every_window_and_no_more_words(spark):
    rng = random.Random(4)
    items = [(k, [rng.choice("abc") for _ in range(rng.randrange(0, 60))]) for k in range(9)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    blocks = list(decontaminate._blocks(bench, 4, 20))
    assert all(sum(len(w) for _, w in b) <= 20 for b in blocks) and len(blocks) > 3
    windows = lambda parts: {(int(k), tuple(x.encode() if isinstance(x, str) else x for x in w[a : a + 4])) for k, w in parts for a in range(max(len(w) - 3, min(1, len(w))))}
    assert windows(x for b in blocks for x in b) == windows(items)
    docs = spark.createDataFrame([(k, " ".join(rng.choice("abc") for _ in range(40))) for k in range(6)], "doc_id long, text string")
    one, many = ({r.doc_id: ([tuple(s) for s in r.hit_spans], r.hit_items) for r in decontaminate.find_hits(docs, bench, 4, n).collect()} for n in (1000, 20))
    assert one == many


def test_short_spans_stay(spark):
    bench = spark.createDataFrame([(1, "common word"), (2, "five words that are rare")], "item_id long, text string")
    d = spark.createDataFrame([(1, "a common word here and there and everywhere"), (2, "see five words that are rare in this text of mine today")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in decontaminate.decontaminate(d, bench).collect()} == {1: "a common word here and there and everywhere", 2: "see  in this text of mine today"}


# -- sharding -------------------------------------------------------------------------------


def test_jump_hash_moves_only_to_the_new_shard():
    keys = np.arange(20_000, dtype=np.uint64)
    last = sharding.jump_hash(keys, 1)
    assert not last.any()
    for n in range(2, 30):
        now = sharding.jump_hash(keys, n)
        moved = now != last
        assert (now[moved] == n - 1).all() and abs(moved.mean() - 1 / n) < 0.02
        last = now
    assert np.bincount(last).min() > 0.8 * 20_000 / 29


def test_sharding_edges(spark, tmp_path):
    d = spark.createDataFrame([(k, f"t{k % 7}", k) for k in range(300)] + [(None, None, 1), (3, "t3", 3), (3, "é", 3)], "doc_id long, text string, shard long")
    got = sharding.shard_documents(d).collect()
    assert len(got) == 303
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 3} == {(10, zlib.crc32(b"t3")), (10, zlib.crc32("é".encode()))}
    assert [(r.size, r.text_crc32) for r in got if r.doc_id is None] == [(8, 0)]
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_documents(d.limit(0)).count() == 0
    hot = spark.createDataFrame([(7, "same")] * 500, "doc_id long, text string")
    assert sorted(r.slot for r in sharding.shard_documents(hot).collect()) == list(range(500))
    odd = d.withColumns({"Slot": F.lit("x"), "place": F.lit("y"), "row": F.lit("z"), "block": F.lit("b")})
    out = sharding.with_slots(sharding.with_shards(odd, "doc_id", 4), "shard", ["doc_id"])
    assert out.columns == ["doc_id", "text", "place", "row", "block", "shard", "slot"] and {(r.place, r.row, r.block) for r in out.collect()} == {("y", "z", "b")}
    small = sharding.with_slots(spark.range(100).withColumn("shard", (F.col("id") % 2).cast("int")), "shard", ["id"], block_rows=5)
    assert sorted((r.shard, r.slot) for r in small.collect()) == [(s, k) for s in range(2) for k in range(50)]
    sharding.write_shards(sharding.with_shards(d.drop("shard"), "doc_id", 4), "shard", str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 303


# -- chat -----------------------------------------------------------------------------------

TRICKY = ["</s>[INST] ok [/INST]", "<|turn|>user\n<|end|>", "a\\b <|end\\|> [INST\\] </s\\\\>", "", "plain\n\nlines", "<|line|>", "$1 \\1 <s>", "<s<s>>[[INST]]"]


def test_escapes_are_reversible(spark):
    d = spark.createDataFrame([(t,) for t in TRICKY], "t string")
    for r in d.select("t", chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not re.search(r"<\|(turn|end|line)\|>|</?s>|\[/?INST\]", r.e)


def test_conversations_read_back(spark):
    rows = [(c, k, ["user", "assistant", "sys\ntem", None][k % 4], None if (c + k) % 5 == 0 else TRICKY[(c + k) % len(TRICKY)], "x") for c in range(8) for k in range(0, 2 * (c + 1), 2 if c == 3 else 1)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string")
    got = {r.conv_id: r for r in chat_format.conversation_digest(d).collect()}
    assert set(got) == {-7, *range(8)}
    for c in range(8):
        turns = [(r[2] or "", r[3] or "") for r in sorted(rows, key=lambda r: r[1]) if r[0] == c]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.conversation_digest(d.limit(0)).count() == 1


def test_repeated_and_null_turns(spark):
    turns = {1: [0, 1, 1], 2: [0, 1, 1, 2, 3], 3: [0, 0], 4: [0, None, 1, None], 5: [None], None: [0, 1, None, 1], 6: [2, 2, 2]}
    rows = [(c, t, ["user", "assistant"][k % 2], f"text {c} {k}") for c, ts in turns.items() for k, t in enumerate(ts)] + [(7, 0, "user", "same")] * 2
    d = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "conv_id long, turn long, role string, text string")
    found = chat_format.conversation_digest(d).collect()
    got = {r.conv_id: r for r in found}
    assert len(found) == len(got) and set(got) == {-7, 7, *turns}
    for c in (*turns, 7):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_leaves_below_a_cycle_have_no_path(spark):
    tree = [("t", 1, 1), ("t", 2, 1), ("t", 3, 2), (None, 1, None), (None, 2, 1), ("u", 1, 2), ("u", 2, 1), ("u", 3, 2), ("u", 4, None)]
    d = spark.createDataFrame(tree, "tree string, node long, parent long")
    assert {tuple(r) for r in chat_format.root_to_leaf_paths(d).collect()} == {(None, 2, 2, 0), (None, 2, 1, 1), ("u", 4, 4, 0)}


def test_branches_of_a_tree(spark):
    tree = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "good", 9.0), ("t", 3, 1, "assistant", "bad", 1.0), ("t", 4, 3, "user", "why", 1.0), ("t", 8, 9, "user", "loop", 0.0), ("t", 9, 8, "user", "loop", 0.0), ("u", 1, 77, "user", "orphan", None)]
    d = spark.createDataFrame(tree, "tree string, node long, parent long, role string, text string, score double")
    out = chat_format.format_conversations(d, score="score").orderBy("tree", "branch_rank").collect()
    assert [(r.tree, r.leaf, r.branch_rank) for r in out] == [("t", 2, 1), ("t", 4, 2), ("u", 1, 1)]
    assert out[0].formatted == "<|turn|>user\nq<|end|><|turn|>assistant\ngood<|end|>"
    assert [tuple(s) for s in out[0].loss_spans] == [(39, 4)]
    best = chat_format.format_conversations(d, score="score", branches=1).collect()
    assert {(r.tree, r.leaf) for r in best} == {("t", 2), ("u", 1)}


# -- line dedup -----------------------------------------------------------------------------


def plain_line_dedup(docs, min_words=line_dedup.MIN_WORDS):
    gone = repeated_lines([(d, t) for d, t in docs if t is not None], min_words)
    return {d: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in docs}


def test_line_dedup_equals_plain(spark):
    rng = random.Random(1)
    lines = [f"line {k} of the shared boilerplate with several words" for k in range(40)]
    block = "\n".join(lines)
    docs = [(d, "\n".join(f"own {d} {k} words of this document only" for k in range(rng.randrange(6))) + "\n" + (block if d % 3 == 0 else "tail " * d)) for d in range(40)] + [(40, None), (41, ""), (42, "\n\n\n"), (43, "one line"), (44, "one line")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, chunk string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    want = plain_line_dedup(docs)
    assert {d: r.kept_text for d, r in got.items()} == want
    shared = [d for d in range(3, 40, 3)]
    assert all(got[d].n_removed_lines >= 30 for d in shared) and got[0].n_removed_lines == 0
    assert all(got[d].n_removed_lines == 0 for d in range(40) if d % 3)
    assert line_dedup.line_dedup_digest(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, block), (1, block), (None, block), (None, "x")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_removed_lines) for r in line_dedup.line_dedup_digest(twice).collect()) == [(False, 40), (False, 40), (True, 0), (True, 0)]
    apart = spark.createDataFrame([(None, block + "\na"), (None, block + "\nb"), (3, block), (3, "x\n" + block)], "doc_id long, text string")
    assert sorted(r.n_removed_lines for r in line_dedup.line_dedup_digest(apart).collect()) == [0, 40, 40, 40]
    odd = df.withColumns({"N_Lines": F.lit("x"), "drop": F.lit("y"), "key": F.lit("z"), "h": F.lit("w")})
    out = line_dedup.line_dedup(odd)
    assert out.columns == ["doc_id", "text", "chunk", "drop", "key", "h", *line_dedup.NAMES] and {(r.drop, r.key, r.h) for r in out.collect()} == {("y", "z", "w")}


def repeated_lines(docs, min_words=line_dedup.MIN_WORDS):
    """Lines to remove by brute force: of every line run of any length, all but its first occurrence."""
    first, gone = {}, {d: set() for d, _ in docs}
    for d, t in docs:
        lines = t.split("\n")
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = lines[a:b]
                if not run[0].split() or not run[-1].split():
                    continue
                if len(" ".join(run).split()) < (line_dedup.LONE_WORDS if b == a + 1 else min_words):
                    continue
                if first.setdefault(tuple(run), (d, a)) != (d, a):
                    gone[d].update(range(a, b))
    return gone


def test_line_dedup_removes_short_passages_whole(spark):
    rng, docs, shared = random.Random(3), [], {}
    own = lambda d: [f"own {d} {rng.random()} " + "w " * rng.choice([0, 1, 9, 60]) for _ in range(rng.randrange(1, 6))]
    passages = [[f"passage {p} line {k} " + "word " * max(rng.choice([0, 2, 20]), 60 // n) for k in range(n)] for p, n in enumerate([2, 3, 4, 5] * 4)]
    passages += [[f"p{p} {k}" for k in range(5)] for p in range(4)] + [["a heading", "and a longer line of many words after it", "", "end"]]
    for d in range(80):
        p = passages[d % len(passages)]
        head, tail = own(d), own(d)
        docs.append((d, "\n".join([*head, *p, *tail])))
        shared[d] = set(range(len(head), len(head) + len(p))) if d >= len(passages) else set()
    lone = "alone " + "word " * 60
    docs += [(80, f"before it\n{lone}\nafter it"), (81, f"other\n{lone}\nmore"), (82, "x\nshort line\ny"), (83, "z\nshort line\nv"), (84, "a b c d\ne f g h\n" * 4), (85, "two\nlines\n0"), (86, "1\ntwo\n\nlines\n2"), (87, "3\ntwo\nlines")]
    want = repeated_lines(docs)
    assert all(want[d] == lines for d, lines in shared.items())
    assert (want[81], want[83], want[84], want[86], want[87]) == ({1}, set(), set(range(2, 8)), set(), {1, 2})
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, t in docs:
        assert got[d].kept_text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d])
        assert got[d].n_removed_lines == len(want[d])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", "a", "b c d", "e f g h i", "j k l m n o p q r"]), min_size=1, max_size=9), max_size=5))
@pytest.mark.parametrize("min_words", [0, 8])
def test_chunks_cover_every_repeated_run(min_words, texts):
    docs, seen, got = [(d, "\n".join(x)) for d, x in enumerate(texts)], set(), {}
    for d, t in docs:
        got[d] = set()
        spans = line_dedup.spans_of([x.encode() for x in t.split("\n")], min_words)
        for k, body in line_dedup.compared(t.encode(), min_words):
            if body in seen:
                got[d].update(range(*spans[k]))
            seen.add(body)
    assert got == repeated_lines(docs, min_words)


# -- quality --------------------------------------------------------------------------------


def plain_base(text):
    """The base figures by their definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(tri)
    cover = {p for k, x in enumerate(tri) if n[x] > 1 for p in (k, k + 1, k + 2)}
    failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(cover), failed


def test_base_rules(spark):
    good = "The quick brown fox jumps over a lazy dog while many other animals are watching it from far away. " * 1 + " ".join(f"Word{k} follows number {k * 7}" for k in range(20))
    rows = [(1, good, "en"), (2, None, "en"), (3, "", None), (4, "a b c " * 30, "en"), (5, " ".join(chr(0x13000 + k) * 3 for k in range(60)), "xx"), (6, "x#*\n \nx#*\nx#* $", "en"), (7, "long text of words " * 9000, "en"), (1, good, "en"), (None, good, None), (None, "\u3000 \u2028x", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"n_words": F.lit("x"), "In_Band": F.lit(1), "script": F.lit(2), "band_of_lang": F.lit(3)})
    found = fertility.quality_digest(d).collect()
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert got == sorted((i or -1, *plain_base(t)) for i, t, _ in rows)
    assert all(r.kept == (not r.base_failed) for r in found), [(r.doc_id, r.chars_per_token, r.entropy_bits) for r in found]
    assert fertility.quality_digest(spark.createDataFrame([(1, "x")], "doc_id long, text string")).count() == 1
    assert fertility.quality_digest(d.limit(0)).count() == 0
    measured = fertility.measure_quality(d)
    assert "n_words" in measured.columns and dict(measured.dtypes)["script"] == "string"
    judged = fertility.with_verdict(measured, fertility.fit_bands(measured))
    assert "in_band" in judged.columns and "band_of_lang" in judged.columns and judged.count() == len(rows)


ALPHABETS = {"Latin": range(97, 123), "Cyrillic": range(0x430, 0x450), "Greek": range(0x3B1, 0x3CA), "Arabic": range(0x627, 0x64B), "Hebrew": range(0x5D0, 0x5EB), "Devanagari": range(0x904, 0x93A), "Han": range(0x4E00, 0x5E00), "Hangul": range(0xAC00, 0xD700), "Thai": range(0xE01, 0xE2F)}


def test_gibberish_is_out_of_band_and_clean_text_is_kept(spark):
    """Per script, invented prose of 400 words that follow Zipf's law, and runs of random letters."""
    rng, rows = random.Random(6), []
    for script, span in ALPHABETS.items():
        letters = [chr(c) for c in span if chr(c).isalpha()]
        often = rng.sample(letters, min(12, len(letters)))
        lexicon = ["".join(rng.choice(often) for _ in range(rng.randrange(2, 7))) for _ in range(400)]
        weights = [1 / (k + 2) for k in range(400)]
        for _ in range(80):
            rows.append((len(rows), " ".join(rng.choices(lexicon, weights, k=rng.randrange(120, 500))), script, "clean"))
        for kind in range(3):
            words = {
                0: lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))),
                1: lambda: rng.choice(letters) * rng.randrange(9, 40),
                2: lambda: "%08x" % rng.getrandbits(32) + rng.choice(letters),
            }[kind]
            rows.append((len(rows), " ".join(words() for _ in range(300)), script, f"junk{kind}"))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, kind string")
    got = fertility.quality_digest(d).join(d.select("doc_id", "kind", "lang"), "doc_id").collect()
    assert not any(r.base_failed for r in got if r.kind == "clean")
    clean = [r.kept for r in got if r.kind == "clean"]
    assert sum(clean) >= 0.99 * len(clean)
    junk = [(r.lang, r.kind) for r in got if r.kind.startswith("junk") and r.kept]
    assert not junk
    # without a language, the script's band holds
    bare = fertility.quality_digest(d.drop("lang")).join(d.select("doc_id", "kind"), "doc_id").collect()
    assert not any(r.kept for r in bare if r.kind.startswith("junk"))


def test_labelled_junk_is_rejected_by_bands(spark):
    """Of what passes the base rules, most labelled junk goes and clean documents stay."""
    sf = "/root/testdata/sf0.01"
    q = fertility.quality_digest(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    kept = {r.quality: r.share for r in q.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[0] < 0.3 and kept[1] > 0.99


def test_refitted_bands_shed_what_widens_them(spark):
    """A tenth of junk just inside the first bands is outside those fitted without the rest of it."""
    rng, rows = np.random.default_rng(5), []
    for k in range(1000):
        far = [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.35, 0.6, 0.9][k % 10] * (k % 2)
        rows.append((k, "en", "Latin", 800, float(2.2 + rng.normal() * 0.05 + far), 0.0, 8.0, 200, 0))
    d = spark.createDataFrame(rows, "doc_id long, lang string, script string, n_tokens long, chars_per_token double, byte_share double, entropy_bits double, n_words long, n_repeat_words long")
    kept = lambda bands: {r.doc_id for r in fertility.with_verdict(d, bands).where("in_band").collect()}
    first, last = kept(fertility.fit_bands(d)), kept(fertility.fit_stable_bands(d))
    clean = {k for k in range(1000) if not (k % 2 and k % 10 in (7, 9))}
    assert last <= first and len(clean - last) <= 5 and len(last - clean) <= len(first - clean)
    assert kept(fertility.fit_stable_bands(d, refits=0)) == first
    assert fertility.fit_stable_bands(d.limit(0)).count() == 0


def test_whole_query_equals_plain_measures(spark):
    """Every column of the registered query's base rules and measures, over a whole table, by plain Python and the library."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in fertility.quality_digest(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) > 0
    for doc_id, text in rows:
        text, r = text or "", got[doc_id]
        words = re.findall("[^\x20\x09-\x0d]+", text)
        seen = Counter(zip(words, words[1:], words[2:]))
        again = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words)) and not (r.base_failed and r.kept)
        ids = [i for w in words for i in model.encode(w)]
        assert r.n_tokens == len(ids)
        if ids:
            share = np.array(list(Counter(ids).values())) / len(ids)
            assert abs(r.chars_per_token - r.word_chars / len(ids)) < 1e-9 and abs(r.entropy_bits + (share * np.log2(share)).sum()) < 1e-9 and abs(r.byte_share - sum(map(model.is_byte, ids)) / len(ids)) < 1e-12


def test_verdict_equals_plain(spark):
    """in_band against the same statistics by numpy."""
    rng, rows = np.random.default_rng(3), []
    for k in range(300):
        n = int(rng.integers(60, 3000))
        rows.append((k, ["en", "fr"][k % 2], "Latin", n, float(2.2 + rng.normal() * 0.06 * (3 if k % 29 == 0 else 1)), 0.0, float(3 + 0.4 * np.log2(n) + rng.normal() * 0.1 * (9 if k % 31 == 0 else 1)), 200, 0))
    d = spark.createDataFrame(rows, "doc_id long, lang string, script string, n_tokens long, chars_per_token double, byte_share double, entropy_bits double, n_words long, n_repeat_words long")
    got = {r.doc_id: r.in_band for r in fertility.with_verdict(d, fertility.fit_bands(d)).collect()}
    low = lambda x: np.sort(x)[(len(x) - 1) // 2]
    want = {}
    for g in ("en", "fr"):
        own = [r for r in rows if r[1] == g]
        n, per, bits = (np.array([r[k] for r in own], float) for k in (3, 4, 6))
        slope = np.cov(np.log2(n), bits, bias=True)[0, 1] / np.var(np.log2(n))
        shrink = np.minimum(1, np.sqrt(n / low(n)))
        a, b = (per - low(per)) * shrink, (bits - bits.mean() - slope * (np.log2(n) - np.log2(n).mean())) * shrink
        ok = (np.abs(a) <= 5 * max(0.02, 1.4826 * low(np.abs(a)))) & (np.abs(b) <= 5 * max(0.05, 1.4826 * low(np.abs(b)))) & (per >= 1.6) & (bits >= 3)
        want |= {r[0]: bool(x) for r, x in zip(own, ok)}
    assert got == want and 0 < sum(not x for x in want.values()) < 30


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25))
def test_repeated_words(ids):
    tri = list(zip(ids, ids[1:], ids[2:]))
    n, cover = Counter(tri), set()
    for k, x in enumerate(tri):
        if n[x] > 1:
            cover |= {k, k + 1, k + 2}
    assert fertility.repeated_words(np.array(ids, np.int64)) == len(cover)


# -- language -------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    lattice = language_id.Lattice(["▁", "▁a", "a", "b", "ab", "ba", "aba"])
    prob = np.zeros((8, 1))
    prob[:7, 0] = [0.1, 0.2, 0.3, 0.05, 0.15, 0.1, 0.1]
    p = dict(zip(lattice.pieces, prob[:, 0]))

    def total(s):
        return 1.0 if not s else sum((p.get(s[:k], language_id.RARE if k == 1 else 0.0)) * total(s[k:]) for k in range(1, len(s) + 1))

    words = ["a", "ab", "aba", "abab", "cab", "bbc", "ab" * 40, "abcab" * 7]

    def by_places(s):  # the same sum for long words
        out = [1.0]
        for j in range(1, len(s) + 1):
            out.append(sum(out[j - k] * p.get(s[j - k : j], language_id.RARE if k == 1 else 0.0) for k in range(1, min(4, j) + 1)))
        return out[-1]

    assert np.allclose([total("▁" + w) for w in words[:6]], [by_places("▁" + w) for w in words[:6]])
    assert np.allclose(lattice.log_scores(words, prob)[:, 0], [np.log(by_places("▁" + w)) for w in words])


@pytest.mark.parametrize("span", [3, 4096])
def test_expected_counts_and_long_words(span, monkeypatch):
    monkeypatch.setattr(language_id, "SPAN", span)
    rng = random.Random(8)
    lattice = language_id.Lattice(["▁", "▁a", "a", "b", "ab", "ba", "aba", "abababab"])
    prob = np.random.default_rng(1).random((9, 2)) / 9
    prob[8] = 0
    words = ["a", "ab", "abab", "bcba"] + ["".join(rng.choice("abc") for _ in range(30)) for _ in range(4)]
    counts = np.random.default_rng(2).integers(0, 5, (len(words), 2)).astype(float)
    want = np.zeros((9, 2))
    for g in range(2):
        p = dict(zip(lattice.pieces, prob[:, g]))
        for w, n in zip(words, counts[:, g]):
            s = "▁" + w
            cell = lambda i, j: p.get(s[i:j], language_id.RARE if j - i == 1 else 0.0)
            a, b = [1.0], [0.0] * len(s) + [1.0]
            for j in range(1, len(s) + 1):
                a.append(sum(a[i] * cell(i, j) for i in range(max(0, j - 8), j)))
            for i in range(len(s) - 1, -1, -1):
                b[i] = sum(b[j] * cell(i, j) for j in range(i + 1, min(len(s), i + 8) + 1))
            for i in range(len(s)):
                for j in range(i + 1, min(len(s), i + 8) + 1):
                    if s[i:j] in p:
                        want[lattice.pieces.index(s[i:j]), g] += n * a[i] * cell(i, j) * b[j] / a[-1]
    assert np.allclose(lattice.expected(words, counts, prob)[:8], want[:8])
    huge = "abcab" * 4000
    score = lattice.log_scores([huge, huge + "a", "abc" * 11], prob)
    assert np.isfinite(score).all() and (np.abs(score[1] - score[0]) < 10).all()
    monkeypatch.setattr(language_id, "RESCALE", 3)
    assert np.allclose(lattice.log_scores([huge], prob), score[:1])


def test_letters():
    assert language_id.words_of("½ ² ① Ⅷ 12") == []
    assert language_id.words_of("Ab½c d'É x²") == ["ab", "c", "d", "é", "x"]
    assert language_id.words_of("x" * 90) == ["x" * 90]
    assert max(map(len, language_id.vocabulary_pieces(public_tokenizers.path("piece_bpe_32k.model")))) > 12


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id")
    r = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] >= 0.98 and 0 <= r[1] <= r[2] <= 1


def test_language_edges(spark):
    texts = [["the cat and the dog", "der hund und die katze"][k % 2] + " " + "xyz"[: k % 3] for k in range(40)]
    rows = [(k, t, ["en", "de"][k % 2], k) for k, t in enumerate(texts)] + [(50, None, "en", 0), (51, "123 ! ½ ² ①", None, 0), (52, "the dog", None, 0), (None, "und die", None, 0), (None, "und die", "de", 0), (53, "the " + "und" * 30_000, None, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").withColumn("Lang_Pred", F.lit("own"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_digest(d).collect()}
    assert got[50] == ("und", 0.0) and got[51] == ("und", 0.0) and got[52][0] == "en" and got[None][0] == "de"
    unlabelled = d.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.language_digest(unlabelled).collect()} == {"und"}
    assert language_id.language_digest(d.limit(0)).count() == 0
    out = language_id.identify(d, language_id.train(d))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]


# -- n-gram join ----------------------------------------------------------------------------


def plain_components(docs, words=4, percent=85):
    sets = {d: ngram_join.shingle_set(t.encode(), words) if t else set() for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies(rng, n):
    vocabulary = [f"w{k}" for k in range(300)]
    docs = []
    for d in range(n):
        kind = rng.random()
        if docs and kind < 0.55:
            words = docs[rng.randrange(len(docs)) if kind < 0.3 else 0][1].split()
            for _ in range(rng.randrange(0, 5)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append((d, " ".join(words)))
        elif kind < 0.65:
            docs.append((d, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 9)))))
        else:
            docs.append((d, "a line that very many of the texts share word for word " * (kind < 0.85) + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(20, 120)))))
    return docs


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 4, 85), (2, 4, 85), (3, 5, 80), (4, 2, 60), (5, 4, 100)])
def test_components_equal_all_pairs(spark, seed, words, percent):
    docs = near_copies(random.Random(seed), 160)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, rep string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(df, words, percent).collect()}
    assert got == plain_components(docs, words, percent)


def test_small_sets_link_from_the_least_size(spark):
    """Sets of four and five tokens have a similarity of 0.8."""
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "a b c d e f g"), (4, "q r s")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.components(d).collect()} == {k: v[1] for k, v in plain_components(rows, 5, 80).items()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert [ngram_join.least_size(p) for p in (50, 80, 85, 90)] == [1, 4, 6, 9]


def test_one_row_of_each_group_stays(spark):
    long, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(12, "x y z"), (12, long), (3, long), (None, long), (None, other), (None, other), (7, other + " more"), (8, ""), (8, ""), (None, None), (5, "x y z"), (12, "x y z"), (3, long)]
    d = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, Row long")
    kept = ngram_join.keep_one_of_each(d)
    assert kept.columns == d.columns
    got = sorted((r.doc_id or -1, r.text or "") for r in kept.collect())
    assert got == sorted([(3, long), (5, "x y z"), (7, other + " more"), (8, ""), (8, ""), (-1, "")])
    assert ngram_join.keep_one_of_each(d.limit(0)).count() == 0


def test_ngram_edges(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(5, long), (3, long.upper()), (8, None), (9, ""), (10, "a b"), (11, "A  b"), (None, long), (3, long.upper()), (12, "x y z"), (12, long)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect())
    assert got == [(-1, 57, None), (3, 57, 3), (3, 57, 3), (5, 57, 3), (8, 0, 8), (9, 0, 9), (10, 1, 10), (11, 1, 10), (12, 1, 3), (12, 57, 3)]
    assert ngram_join.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, 2), (3, 2), (9, 9)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 1: 1, 2: 1, 3: 1}
