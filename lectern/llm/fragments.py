"""BPE by forced boundaries.

A byte pair that occurs inside no vocabulary token can never lie inside one token of an
encoding, so a merge never crosses it: what stands left and right of such a pair is merged
independently. ``ForcedBoundaries`` cuts a text there, encodes the fragments one by one
(each distinct fragment once, in a bounded cache) and concatenates the ids.

A cut must also leave the splitting before the merges unchanged. The byte-level pattern
looks at most at the following character, and only from white space, and it has
alternatives that begin with an apostrophe. A cut is therefore taken only where
(1) the pair of bytes occurs in no token, added tokens included,
(2) it lies between two characters,
(3) the character before it is no white space (for characters beyond ASCII: cannot be), and
(4) the byte after it is no apostrophe.
Under these rules the concatenated ids equal those of the whole text; tests compare both.
"""

from __future__ import annotations

import base64
import json

import numpy as np

#: Entries kept by one worker's cache before it is emptied.
CACHE_ENTRIES = 250_000
#: Longer fragments are not kept in the cache.
CACHE_BYTES = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: visible Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def token_bytes(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level BPE file, added tokens included."""
    spec = json.loads(open(path, encoding="utf-8").read())
    alphabet = byte_alphabet()
    out = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
    out |= {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
    return [out.get(i, b"") for i in range(max(out) + 1)]


def _added_and_ranks(path: str, bytes_of: list[bytes]):
    """Added tokens, and the vocabulary as ranks where ids follow the order of the merges.

    The ranks encode short fragments with less overhead than a call of the library per
    fragment; without them, or with an added token inside, the library does it.
    """
    import public_tokenizers
    import tiktoken

    spec = json.loads(open(path, encoding="utf-8").read())
    added = [x["content"].encode() for x in spec["added_tokens"]]
    vocab = spec["model"]["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    split = spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or made != sorted(made):
        return added, None
    ranks = {b: i for i, b in enumerate(bytes_of) if b and b not in added}
    return added, tiktoken.Encoding("fragments", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class ForcedBoundaries:
    """Encoder and decoder of one byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.bytes_of = token_bytes(path)
        self.added, self.ranks = _added_and_ranks(path, self.bytes_of)
        inside = np.zeros(1 << 16, dtype=bool)
        for t in self.bytes_of:
            a = np.frombuffer(t, np.uint8).astype(np.uint16)
            inside[(a[:-1] << 8) | a[1:]] = True
        first, second = np.arange(1 << 16) >> 8, np.arange(1 << 16) & 255
        free = ~inside & ((second < 0x80) | (second >= 0xC0)) & (second != ord("'"))
        space = (first == 0x20) | ((first >= 0x09) & (first <= 0x0D)) | ((first >= 0x1C) & (first <= 0x1F))
        self.free = free & ~space & (first < 0x80)
        self.free_high = free & (first >= 0x80)
        self.cache = _Encoded(self)

    def cuts(self, data: bytes) -> list[int]:
        """Ends of the fragments, the end of the data last."""
        a = np.frombuffer(data, np.uint8)
        pair = (a[:-1].astype(np.uint16) << 8) | a[1:]
        cut = self.free[pair]
        high = np.flatnonzero(self.free_high[pair])
        if len(high):
            # white space beyond ASCII begins with C2, E1, E2 or E3; keep clear of all such characters
            one, two = a[np.maximum(high - 1, 0)], a[np.maximum(high - 2, 0)]
            maybe = (one == 0xC2) | np.isin(two, (0xE1, 0xE2, 0xE3))
            cut[high[~maybe]] = True
        return [*(np.flatnonzero(cut) + 1).tolist(), len(data)]

    def fragments(self, data: bytes) -> list[bytes]:
        if not data:
            return []
        ends = self.cuts(data)
        return [data[i:j] for i, j in zip([0, *ends], ends)]

    def encode_fragment(self, fragment: bytes) -> list[int]:
        if self.ranks is not None and len(fragment) <= CACHE_BYTES and not any(t in fragment for t in self.added):
            return self.ranks.encode_ordinary(fragment.decode())
        return self.lib.encode(fragment.decode(), add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return np.frombuffer(b"".join(map(self.cache.__getitem__, self.fragments(text.encode()))), "<u4")

    def decode(self, ids) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode(errors="replace")


class _Encoded(dict):
    """fragment -> its ids as bytes, emptied when full."""

    def __init__(self, owner: ForcedBoundaries) -> None:
        super().__init__()
        self.owner = owner

    def __missing__(self, fragment: bytes) -> bytes:
        out = np.array(self.owner.encode_fragment(fragment), "<u4").tobytes()
        if len(fragment) <= CACHE_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[fragment] = out
        return out


_LOADED: dict[str, ForcedBoundaries] = {}


def loaded(path: str) -> ForcedBoundaries:
    """One encoder per worker process and vocabulary."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = ForcedBoundaries(path)
    return _LOADED[path]


def rank_file(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
