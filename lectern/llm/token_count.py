"""Token counts with overlap resynchronisation for huge documents.

A text is encoded in chunks of ``chunk_chars`` characters that overlap by ``overlap_chars``,
each with the offsets of its tokens; a text of one chunk is a text without a splice. The
overlap is thus encoded twice, as the end of the left chunk and as the beginning of the right
one, and the chunks are spliced at a character p of the overlap that is proven stable:

* p is a natural cut of this kind of tokenizer: see ``Counter.cut``,
* both encodings begin a token at p, and
* the tokens from p on agree in id and offsets, ``agree`` of them or as many as end in a word
  that the left chunk holds whole.

The first point is the proof: no pattern, merge or normalisation of the tokenizer reaches
over such a cut, so the left part has the same tokens whatever follows, and the right part
whatever precedes. The others guard it, as a chunk may begin or end inside a word. Where an
overlap holds no such character it is widened to twice its length, in the end to the whole
chunk, and then the chunk is made longer. The count is the sum of the tokens of each chunk's
encoding between its two splices.

Where the tokenizer drops white space, a chunk's encoding is put together from those of its
white-space pieces, ids and offsets, which a bounded cache holds; else the library encodes
the whole chunk.

Edge cases: null text counts as empty (0 tokens); special strings inside a text count as
their special token; texts of any length are counted whole, chunk by chunk; repeated rows,
ties and rows with a null key are counted one by one; an empty table gives an empty result.
A column named n_tokens is replaced; others pass through. A vocabulary without known cuts
raises ValueError, so no count is ever approximate.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lectern.llm.common import map_batches, without

CHUNK_CHARS, OVERLAP_CHARS, AGREE = 4096, 128, 4
#: The cache of pieces is emptied beyond so many, or so many characters in all.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 4_000_000
_BLANKS = " \n"
_MARKS = ".,;:!?"


class Encoding(NamedTuple):
    """Ids of a chunk's tokens and where they begin and end, in characters of the chunk."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray


class Counter:
    """Token counts of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        #: "after": cuts come behind a blank that is dropped; "before": in front of a single blank
        self.kind = kind_of(spec)
        self.pieces = _Pieces(self.lib)

    def cut(self, text: str, p: int) -> bool:
        """Whether nothing in the tokenizer reaches over the place before character p.

        A tokenizer that drops white space is cut behind a blank or line feed and in front of
        a character that is none. A byte-level tokenizer that binds a blank to the word behind
        it is cut in front of a single blank between two words.
        """
        if self.kind == "after":
            return text[p - 1] in _BLANKS and text[p] not in _BLANKS
        return text[p] == " " and p + 1 < len(text) and not text[p - 1].isspace() and not text[p + 1].isspace()

    def encode(self, text: str) -> Encoding:
        if self.kind == "before":
            return Encoding(*np.array(_tokens(self.lib, text), np.int32).reshape(3, -1))
        flat = text.replace("\n", " ")
        if flat.isascii() and "<|" not in flat:
            flat = flat.lower()  # as the tokenizer does; only special tokens are matched before
        pieces = flat.split(" ")
        self.pieces.learn(pieces)
        got = list(map(self.pieces.__getitem__, pieces))
        *joined, n = zip(*got)
        ids, begin, end = (np.frombuffer(b"".join(x), np.int32) for x in joined)
        if not len(ids):
            return Encoding(ids, begin, end)
        size = np.fromiter(map(len, pieces), np.int32, len(pieces))
        first = np.cumsum(size + 1, dtype=np.int32) - size - 1
        first = np.repeat(first, np.fromiter(n, np.int32, len(n)))
        return Encoding(ids, begin + first, end + first)

    def count(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, agree: int = AGREE) -> int:
        """The left chunk is [at, to); its tokens before number ``begin`` are counted already."""
        total, at, to, begin = 0, 0, min(len(text), chunk), 0
        left = self.encode(text[:to])
        while to < len(text):
            stable = at + int(left.begin[begin]) if begin < len(left.ids) else at  # where the count has come to
            wide = min(overlap, to - stable)
            while True:
                start = to - wide
                end = min(len(text), start + max(chunk, 2 * wide))
                right = self.encode(text[start:end])
                found = self._splice(text, left, at, right, start, to, agree)
                if found is not None or start <= stable:
                    break
                wide = min(2 * wide, to - stable)
            if found is None:
                # no stable place in the whole chunk: make it longer
                at, to, begin = stable, min(len(text), stable + 2 * (to - stable)), 0
                left = self.encode(text[at:to])
                continue
            i, j = found
            total += i - begin
            left, at, to, begin = right, start, end, j
        return total + len(left.ids) - begin

    def _splice(self, text: str, left: Encoding, at: int, right: Encoding, start: int, to: int, agree: int) -> tuple[int, int] | None:
        """The tokens of left [at, to) and of right [start, ...) that begin at the stable place nearest to the middle of [start, to)."""
        low, high = np.searchsorted(left.begin, start + 1 - at), np.searchsorted(right.begin, to - start)
        both, i, j = np.intersect1d(left.begin[low:] + at, right.begin[:high] + start, return_indices=True)
        i += low
        for k in np.argsort(np.abs(both - (start + to) // 2), kind="stable"):
            p, a, b = int(both[k]), int(i[k]), int(j[k])
            if start < p < to and self.cut(text, p) and self._begins(left, a) and self._begins(right, b) and self._agree(text, left, at, a, right, start, b, to, agree):
                return a, b
        return None

    @staticmethod
    def _begins(encoding: Encoding, token: int) -> bool:
        """Whether the token shares no character with the one before."""
        return token == 0 or encoding.end[token - 1] <= encoding.begin[token]

    @staticmethod
    def _agree(text: str, left: Encoding, at: int, a: int, right: Encoding, start: int, b: int, to: int, agree: int) -> bool:
        whole = 0
        for k in range(agree):
            if a + k >= len(left.ids):
                break
            end = int(left.end[a + k]) + at
            if all(text.find(c, end, to) < 0 for c in _BLANKS):
                break  # its word may go on behind the left chunk
            whole += 1
            if b + k >= len(right.ids) or left.ids[a + k] != right.ids[b + k] or left.begin[a + k] + at != right.begin[b + k] + start or end != right.end[b + k] + start:
                return False
        return whole > 0


def _tokens(lib, text: str) -> tuple[list[int], list[int], list[int]]:
    got = lib.encode(text, add_special_tokens=False)
    begin, end = zip(*got.offsets) if got.ids else ((), ())
    return got.ids, list(begin), list(end)


def kind_of(spec: dict) -> str:
    """How a vocabulary of the tokenizers library treats white space; ValueError if no cut is known for it."""
    added_ok = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or any(c.isspace() for c in x["content"])) for x in spec["added_tokens"])
    split, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if added_ok and spec["model"]["type"] == "BPE" and spec["model"].get("dropout") is None:
        steps = split.get("pretokenizers", [])
        known = {"NFC", "Lowercase", "Replace"}  # none composes over a blank or line feed
        plain = norm.get("type") == "Sequence" and all(n["type"] in known and (n["type"] != "Replace" or n["pattern"] == {"Regex": r"\s+"}) for n in norm["normalizers"])
        # what the pattern does not match, white space, is removed; each match is merged by itself
        drops = steps and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and r"[^\s" in steps[0]["pattern"].get("Regex", "")
        if plain and drops and all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in steps[1:]):
            return "after"
        if split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not norm:
            return "before"
    raise ValueError("no cut is known for this tokenizer")


class _Pieces(dict):
    """piece -> the bytes of its tokens' ids, begins and ends, and their number; emptied when full."""

    def __init__(self, lib) -> None:
        super().__init__()
        self.lib, self.chars = lib, 0

    def learn(self, pieces: list[str]) -> None:
        """Make sure of all pieces: those unknown are encoded together.

        Marks behind a letter are a piece of their own: the pattern splits letters from marks,
        each match is merged by itself, and no mark composes with what precedes.
        """
        if len(self) > CACHE_ENTRIES or self.chars > CACHE_CHARS:
            self.clear()
            self.chars = 0
        new = {p for p in set(pieces) if p not in self}
        if not new:
            return
        parts = {}
        for p in new:
            core = p.rstrip(_MARKS)
            if core and len(core) < len(p) and core[-1].isalpha():
                parts[p] = core, p[len(core) :]
        alone = [p for p in {*new.difference(parts), *(x for both in parts.values() for x in both)} if p not in self]
        ids, begin, end = (np.array(x, np.int32) for x in _tokens(self.lib, " ".join(alone)))
        first = np.cumsum([0, *(len(p) + 1 for p in alone)])
        cuts = np.searchsorted(begin, first)
        base = np.repeat(first[:-1], np.diff(cuts)).astype(np.int32)
        data = ids.tobytes(), (begin - base).tobytes(), (end - base).tobytes()
        cuts = cuts.tolist()
        for p, low, high in zip(alone, cuts, cuts[1:]):
            own = slice(4 * low, 4 * high)
            self[p] = data[0][own], data[1][own], data[2][own], high - low
            self.chars += len(p)
        moved: dict[tuple[str, int], tuple[bytes, bytes]] = {}
        for p, (core, marks) in parts.items():
            a, b, at = self[core], self[marks], (marks, len(core))
            if at not in moved:
                moved[at] = tuple((np.frombuffer(x, np.int32) + len(core)).astype(np.int32).tobytes() for x in b[1:3])
            self[p] = a[0] + b[0], a[1] + moved[at][0], a[2] + moved[at][1], a[3] + b[3]
            self.chars += len(p)


_LOADED: dict[str, Counter] = {}


def loaded(path: str) -> Counter:
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def count_tokens(
    docs: DataFrame,
    text: str = "text",
    vocabulary: str = "word_bpe_49k.json",
    path: str | None = None,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """docs with the column n_tokens."""
    path = path or public_tokenizers.path(vocabulary)
    loaded(path)  # an unknown kind fails here rather than in a task
    docs = without(docs, "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for batch in batches:
            n = [counter.count(t.as_py() or "", chunk_chars, overlap_chars) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n_tokens"])

    return map_batches(docs, run, StructType([*docs.schema.fields, StructField("n_tokens", LongType())]))


def token_count_digest(docs: DataFrame, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    slim = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(slim)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
