"""Tokenising operators against the libraries themselves."""

import hashlib
import io
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import bpe, fragments, token_count, token_output

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
PIECES = st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "'s", "'", "'ll", "zq", "Q", "é", "ß", "漢", " ", " ", "　", "\u0085", "\x1c", "1", "23", "!", "!!'", "<|endoftext|>", "<|", "é", "́", "😀", "—", "’s", "İ", "Σ", "\r\n"])
TEXTS = st.lists(PIECES, max_size=30).map("".join) | st.text(max_size=60)


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_fragments_give_the_library_ids(text):
    lib, coder = _BYTE, _CODER
    ids = lib.encode(text, add_special_tokens=False).ids
    assert coder.encode(text).tolist() == ids
    assert coder.decode(ids) == lib.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(2, 12), st.integers(1, 6))
def test_counts_in_overlapping_chunks(text, chunk, overlap):
    for lib, counter in ((_WORD, _COUNTER), (_BYTE, _BYTE_COUNTER)):
        assert counter.count(text, chunk, overlap) == len(lib.encode(text, add_special_tokens=False).ids)


_BYTE, _WORD = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
_CODER, _COUNTER, _BYTE_COUNTER = fragments.ForcedBoundaries(BYTE), token_count.Counter(WORD), token_count.Counter(BYTE)


def test_huge_texts():
    text = ("word and other things, 12 of them\n" * 6000) + "x" * 70_000 + " end " + "é" * 1000
    assert _COUNTER.count(text) == len(_WORD.encode(text, add_special_tokens=False).ids)
    assert _BYTE_COUNTER.count(text) == len(_BYTE.encode(text, add_special_tokens=False).ids)
    assert _CODER.encode(text).tolist() == _BYTE.encode(text, add_special_tokens=False).ids


def test_ordinary_texts_are_spliced(monkeypatch):
    """A text of a few thousand characters takes several chunks, each of them bounded."""
    seen, text = [], " ".join(f"Word{k % 97}'s {k}" for k in range(900))
    whole = _COUNTER.encode
    monkeypatch.setattr(_COUNTER, "encode", lambda t: seen.append(len(t)) or whole(t))
    assert _COUNTER.count(text) == len(_WORD.encode(text, add_special_tokens=False).ids)
    assert len(seen) >= len(text) // 4096 and max(seen) <= 4096


@pytest.mark.parametrize("counter,lib", [(_COUNTER, _WORD), (_BYTE_COUNTER, _BYTE)])
@pytest.mark.parametrize("chunk", [0, 1, 2, 5])
def test_counts_are_those_of_the_chunk_encodings(monkeypatch, counter, lib, chunk):
    """One token less in any chunk, between its splices, is one token less in the count."""
    text = " ".join(f"Word{k % 97}'s {k}" for k in range(3000))
    whole, calls = counter.encode, []

    def changed(t):
        got = whole(t)
        calls.append(t)
        if len(calls) - 1 == chunk:
            keep = np.arange(len(got.ids)) != len(got.ids) // 2
            got = token_count.Encoding(*(x[keep] for x in got))
        return got

    monkeypatch.setattr(counter, "encode", changed)
    assert counter.count(text) == len(lib.encode(text, add_special_tokens=False).ids) - 1
    assert len(calls) >= len(text) // 4096


def test_piece_encodings_are_those_of_the_library():
    for text in ("The  Cat's é漢 hat\n\n😀 12 <|endoftext|>x \t İ ", "ASCII Words, and. more!? 'd.. x1. A's: ... .a", "<|ENDOFTEXT|> Up.", "é. é́. Σ. ß!", "12. 3,4 a.b.c. "):
        want = _WORD.encode(text, add_special_tokens=False)
        got = _COUNTER.encode(text)
        assert (got.ids.tolist(), list(zip(got.begin.tolist(), got.end.tolist()))) == (want.ids, want.offsets)


def test_unknown_tokenizers_are_refused(tmp_path):
    import json

    spec = json.loads(open(WORD, encoding="utf-8").read())
    spec["normalizer"] = {"type": "NFKC"}
    with pytest.raises(ValueError):
        token_count.kind_of(spec)


def test_pack_and_unpack():
    v = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    for n in range(len(v) + 1):
        control, data = token_output.pack(v[:n])
        assert token_output.unpack(n, control, data).tolist() == v[:n].tolist()


def test_file_round_trip_with_blocks(monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK", 5)
    docs = [(None, [3]), (1, [9, 9, 9, 70000, 2]), (1, [2]), (5, list(range(40, 60)))]
    ids = np.concatenate([np.array(x, "<u4") for _, x in docs])
    raw = b"".join(token_output.file_bytes([d for d, _ in docs], [len(x) for _, x in docs], ids))
    assert [(d, x.tolist()) for d, x in token_output.read_file(io.BytesIO(raw))] == docs


DOCS = [(5, "hello there", "x"), (2, None, None), (None, "no id", "y"), (7, "", "z"), (2, "again <|endoftext|> 's", "x"), (9, "long " * 3000, "y"), (5, "hello there", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, ids string")


def test_bpe_query(spark, docs):
    want = sorted((d or -1, hashlib.sha256(",".join(map(str, _BYTE.encode(t or "", add_special_tokens=False).ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in DOCS)
    got = bpe.bpe_digest(docs).collect()
    assert sorted((r.doc_id or -1, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.bpe_digest(docs.limit(0)).count() == 0


def test_clashing_columns(spark, docs):
    odd = docs.withColumn("decoded", docs.doc_id).withColumn("N_tokens", docs.doc_id)
    out = bpe.decode(bpe.encode(odd))
    assert out.columns == ["doc_id", "text", "N_tokens", "ids", "decoded"] and sorted(r.decoded for r in out.collect()) == sorted(t or "" for _, t, _ in DOCS)
    assert token_count.count_tokens(odd).columns == ["doc_id", "text", "ids", "decoded", "n_tokens"]


def test_token_files_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(token_output, "PARTS", 3)
    d = spark.range(400).selectExpr("id AS doc_id", "repeat('word ', CAST(id % 50 AS INT)) AS text")
    path = token_output.new_path(spark, "many")
    files = token_output.write_tokens(d, path, 2, task_bytes=(2000, 3000))
    assert files.count() > 10
    got, start = sorted(token_output.read_tokens(spark, path, files).collect(), key=lambda r: r.start), 0
    for k, r in enumerate(got):
        assert (r.doc_id, r.start) == (k, start)
        start += r.n_tokens


def test_count_query(spark, docs):
    got = token_count.token_count_digest(docs).collect()
    want = sorted((d or -1, len((t or "").encode()), len(_WORD.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in DOCS)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert sum(r.over_limit for r in got) == 1


def test_token_files(spark, docs):
    got = sorted(token_output.token_file_digest(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 2, 2, 5, 5, 7, 9]
    start = 0
    by_key = {}
    for d, t, _ in DOCS:
        by_key.setdefault(d, set()).add(tuple(_BYTE.encode(t or "", add_special_tokens=False).ids + [2]))
    for r in got:
        assert r.start == start
        start += r.n_tokens
        assert r.ids_crc32 in {zlib.crc32(np.array(x, "<u4").tobytes()) for x in by_key[r.doc_id]}
    assert token_output.token_file_digest(docs.limit(0)).count() == 0
