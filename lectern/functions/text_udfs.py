"""Arrow functions for what Spark has no expression for."""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from functools import lru_cache
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(fn, kind: str = "string"):
    """An Arrow function of one text column; NULL stays NULL."""

    def apply(column: Column) -> Column:
        return F.pandas_udf(lambda s: s.map(fn, na_action="ignore"), kind)(column)

    return apply


def bigrams(text: str) -> list[str]:
    flat = "".join(text.lower().split())
    return list(map(add, flat, flat[1:]))


@lru_cache(1 << 17)
def _hashed(bigram: str) -> int:
    return int.from_bytes(hashlib.sha256(bigram.encode()).digest()[:4], "big")


def bigram_vector(text: str, dims: int) -> list[float]:
    """Unit vector of hashed character bigrams: a local stand-in for an embedding service."""
    v = np.zeros(dims)
    for g, n in Counter(bigrams(text)).items():
        v[_hashed(g) % dims] += n
    norm = np.linalg.norm(v)
    return (v / norm if norm else v).tolist()


def bigram_share(query: str | None, text: str | None) -> float:
    """Share of the query's distinct bigrams that the text has."""
    own = set(bigrams(query or ""))
    return len(own & set(bigrams(text or ""))) / len(own) if own else 0.0


nfc = _each(lambda x: unicodedata.normalize("NFC", x))
nfkc = _each(lambda x: unicodedata.normalize("NFKC", x))


def bigram_embedding(dims: int = 64):
    return _each(lambda x: bigram_vector(x, dims), "array<float>")


def bigram_coverage(query: Column, text: Column) -> Column:
    return F.pandas_udf(lambda q, t: pd.Series([bigram_share(a, b) for a, b in zip(q, t)]), "double")(query, text)
