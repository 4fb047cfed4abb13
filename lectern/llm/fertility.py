"""Quality rules with tokeniser fertility.

Words are runs of non-white-space. The base rules count words, symbols, repeated lines and
repeated 3-word windows. The method's own rule measures how a public vocabulary with byte
fallback takes to the words of a text: characters per token, share of byte tokens, and
entropy of the token distribution. Each must lie in a band. There are two kinds of bands:

* ``LIMITS`` by script (the script of most letters), which hold everywhere; they bar what no
  writing in that script looks like: random letters, encoded data, runs of one letter.
* Bands of the corpus by language, or by script for rows of no or a rare language. ``fit_bands``
  takes them from all rows that pass the base rules: centre and spread are median and median
  absolute deviation of the group, and the band reaches ``WIDTH`` spreads either way. They
  are fitted again without the rows outside them, until those stay the same. Medians of groups
  of over 10,000 rows are sketches, whose last digits may depend on the order of merging. Short
  texts vary more, so their band is wider by the root of the median size over their own.
  The entropy of a text grows with its length; its centre is a line over the logarithm of
  the number of tokens. A group of fewer than ``LEAST_ROWS`` rows has no band of its own.

Each word is encoded by itself, as the library encodes it as a text of its own.

Edge cases: null text has no words and is rejected by the base rule, as is an empty text;
a null language takes its script's bands, a script without limits those of ``*``; a tie
between scripts goes to the name that sorts last; repeated rows and rows with a null doc_id
are measured one by one and count in the statistics one by one; very long texts are measured
whole; an empty table gives an empty result. A table without ``lang`` works too. Columns
that have the name of an added one are replaced; all others pass through.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from lectern.llm.common import Scratch, free_names, map_batches, small, without, written

CACHE_ENTRIES, CACHE_BYTES = 250_000, 64
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"


class Band(NamedTuple):
    """Accepted ranges, ends included."""

    chars_per_token: tuple[float, float]
    byte_share: tuple[float, float]
    entropy_bits: tuple[float, float]


#: Limits by script under a vocabulary of 32,000 pieces that knows Latin words best; ``*`` for the
#: rest. Random letters of the Latin script make 1.5 characters a token, base64 1.2, a hex dump 1.0.
LIMITS = {
    "Latin": Band((1.6, 10.0), (0.0, 0.2), (3.0, 15.0)),
    "Cyrillic": Band((1.05, 10.0), (0.0, 0.3), (3.0, 15.0)),
    "Greek": Band((0.7, 8.0), (0.0, 0.4), (3.0, 15.0)),
    "Han": Band((0.3, 4.0), (0.0, 0.93), (3.0, 15.0)),
    "*": Band((0.2, 8.0), (0.0, 1.0), (3.0, 15.0)),
}
#: Spreads to either side of the centre; rows that a group needs; the least spread of each measure.
WIDTH, LEAST_ROWS = 5.5, 30
#: How often bands are fitted again without what lies outside them.
REFITS = 5
LEAST_SPREAD = (0.02, 0.02, 0.05)
#: Base rules: words at least, and repeated words in a hundred at most.
MIN_WORDS, MAX_REPEATED = 50, 50
SCRIPTS = {
    "Latin": "LATIN", "Cyrillic": "CYRILLIC", "Greek": "GREEK", "Arabic": "ARABIC", "Hebrew": "HEBREW",
    "Devanagari": "DEVANAGARI", "Han": "CJK", "Hiragana": "HIRAGANA", "Katakana": "KATAKANA", "Hangul": "HANGUL", "Thai": "THAI",
}
_NOT_ASCII_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")


def script_of(text: str) -> str:
    """The script of most letters; ``*`` without letters or for other scripts."""
    counts = {"Latin": len(text.encode().translate(None, _NOT_ASCII_LETTER))}
    for c, n in Counter("".join(_BEYOND_ASCII.findall(text))).items():
        if c.isalpha():
            s = _script_of_letter(c)
            counts[s] = counts.get(s, 0) + n
    best = max(counts, key=lambda k: (counts[k], k))
    return best if counts[best] else "*"


@lru_cache(65536)
def _script_of_letter(c: str) -> str:
    head = unicodedata.name(c, "").split(" ", 1)[0]
    return next((k for k, v in SCRIPTS.items() if v == head), "*")


class Fertility:
    """Word-wise encoder of one sentencepiece model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.lib.is_byte(i) for i in range(self.lib.get_piece_size())])
        self.cache = _Ids(self)

    def measure(self, words: list[bytes], times: np.ndarray) -> tuple[int, int, float]:
        """Tokens, byte tokens and entropy in bits of distinct words that occur ``times`` times."""
        blobs = list(map(self.cache.__getitem__, words))
        ids = np.frombuffer(b"".join(blobs), "<u2")
        weight = np.repeat(times, [len(b) // 2 for b in blobs])
        n = int(weight.sum())
        if not n:
            return 0, 0, 0.0
        order = np.argsort(ids, kind="stable")
        ids, weight = ids[order], weight[order]
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        p = np.add.reduceat(weight, starts) / n
        return n, int(weight[self.is_byte[ids]].sum()), float(max(0.0, -(p * np.log2(p)).sum()))


class _Ids(dict):
    def __init__(self, owner: Fertility) -> None:
        super().__init__()
        self.owner = owner

    def __missing__(self, word: bytes) -> bytes:
        out = np.array(self.owner.lib.encode(word.decode()), "<u2").tobytes()
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = out
        return out


def repeated_words(ids: np.ndarray) -> int:
    """Positions inside 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    m = int(ids.max()) + 1
    pair = ids[:-1].astype(np.int64) * m + ids[1:]
    if m > 1 << 20:  # keep the product within 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair[:-1] * m + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(ids), bool)
    cover[:-2] |= again
    cover[1:-1] |= again
    cover[2:] |= again
    return int(cover.sum())


_LOADED: dict[str, Fertility] = {}


def loaded(path: str) -> Fertility:
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Fertility(path)
    return _LOADED[path]


_FIELDS = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("n_tokens", "long"), ("chars_per_token", "double"), ("byte_share", "double"), ("entropy_bits", "double"), ("script", "string"),
]


def measure_quality(docs: DataFrame, text: str = "text", vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """docs with the base counts and the vocabulary's measures."""
    path = public_tokenizers.path(vocabulary)
    kinds = {"long": LongType(), "double": DoubleType(), "string": StringType()}
    arrow = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    docs = without(docs, *(n for n, _ in _FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            rows = [_row(model, t.as_py() or "") for t in batch.column(text)]
            cols = [pa.array(c, arrow[k]) for c, (_, k) in zip(zip(*rows) if rows else [[]] * len(_FIELDS), _FIELDS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *(n for n, _ in _FIELDS)])

    return map_batches(docs, run, StructType([*docs.schema.fields, *(StructField(n, kinds[k]) for n, k in _FIELDS)]))


def _row(model: Fertility, text: str) -> tuple:
    data = text.encode()
    words = data.split()
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    tokens, in_bytes, entropy = model.measure(list(index), np.bincount(ids, minlength=len(index)))
    per, share = (chars / tokens, in_bytes / tokens) if tokens else (0.0, 0.0)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(ids), tokens, per, share, entropy, script_of(text)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def within_limits(limits: dict[str, Band] = LIMITS) -> Column:
    """Whether the measures lie in the limits of the row's script."""

    def fits(band: Band) -> Column:
        return reduce(Column.__and__, [F.col(n).between(a, b) for n, (a, b) in zip(Band._fields, band)])

    named = [s for s in limits if s != "*"]
    out = F.when(~F.col("script").isin(*named), fits(limits["*"]))
    for s in named:
        out = out.when(F.col("script") == s, fits(limits[s]))
    return out


_CENTRES = ("size", "per", "share", "slope", "base")
_SPREADS = ("per_spread", "share_spread", "bits_spread")


def fit_bands(measured: DataFrame, lang: str | None = "lang", least_rows: int = LEAST_ROWS) -> DataFrame:
    """kind (lang or script), name, n and the band of every group of at least ``least_rows`` rows.

    ``measured``, a written table, is read twice: for the centres and for the spreads about
    them. Both are sketches of fixed size by group, made before the shuffle.
    """
    log = F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))
    good = measured.where(~base_failed() & (F.col("n_tokens") > 0))
    names = {"script": F.col("script")} | ({"lang": F.col(lang).cast("string")} if lang in measured.columns else {})
    groups = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("name")) for k, c in names.items()]))
    rows = good.select(groups.alias("g"), "n_tokens", "chars_per_token", "byte_share", "entropy_bits", log.alias("log")).select("g.kind", "g.name", "*").where("name is not null")
    middle = lambda c: F.percentile_approx(c, F.lit(0.5), F.lit(10_000))
    slope = F.coalesce(F.regr_slope("entropy_bits", "log"), F.lit(0.0))
    centres = rows.groupBy("kind", "name").agg(
        F.count(F.lit(1)).alias("n"), middle(F.col("n_tokens").cast("double")).alias("size"), middle(F.col("chars_per_token")).alias("per"),
        middle(F.col("byte_share")).alias("share"), slope.alias("slope"), (F.avg("entropy_bits") - slope * F.avg("log")).alias("base"),
    ).where(F.col("n") >= least_rows)
    apart = rows.join(small(centres), ["kind", "name"]).select(
        "kind", "name", *_deviations(F.col("log"), {c: F.col(c) for c in _CENTRES})
    )
    spreads = apart.groupBy("kind", "name").agg(*[(1.4826 * middle(F.abs(d))).alias(s) for d, s in zip(("per_off", "share_off", "bits_off"), _SPREADS)])
    return centres.join(spreads, ["kind", "name"])


def fit_stable_bands(measured: DataFrame, lang: str | None = "lang", least_rows: int = LEAST_ROWS, refits: int = REFITS) -> DataFrame:
    """Bands fitted again without the rows that lie outside them, until these no longer change (``refits`` times at most).

    Junk among the rows widens the spreads at first; what it hides inside them comes out in later rounds.
    """
    scratch, last = Scratch(measured.sparkSession), None
    bands = written(fit_bands(measured, lang, least_rows), "bands")
    for _ in range(refits):
        inside = with_verdict(measured, bands, lang).where("in_band").drop("in_band")
        n = inside.where(~base_failed()).count()
        if n == last:
            break
        last = n
        bands = scratch.written(fit_bands(inside, lang, least_rows), "bands")
    out = written(bands, "bands")
    scratch.clear()
    return out


def _deviations(log: Column, c: dict[str, Column]) -> list[Column]:
    """Distances from a group's centre, those of short texts shrunk by the root of their share of the usual size."""
    shrink = F.least(F.lit(1.0), F.sqrt(F.col("n_tokens") / c["size"]))
    return [
        ((F.col("chars_per_token") - c["per"]) * shrink).alias("per_off"),
        ((F.col("byte_share") - c["share"]) * shrink).alias("share_off"),
        ((F.col("entropy_bits") - c["base"] - c["slope"] * log) * shrink).alias("bits_off"),
    ]


def with_verdict(measured: DataFrame, bands: DataFrame, lang: str | None = "lang", width: float = WIDTH, limits: dict[str, Band] = LIMITS) -> DataFrame:
    """measured with in_band: within the limits of its script, and in the band of its language or else script."""
    measured = without(measured, "in_band")
    own, other = free_names(measured.columns, "band_of_lang", "band_of_script")
    cols = ("n", *_CENTRES, *_SPREADS)
    side = lambda kind, out: bands.where(F.col("kind") == kind).select(F.col("name").alias(out + "_name"), F.struct(*cols).alias(out))
    out = measured.join(small(side("script", other)), F.col("script") == F.col(other + "_name"), "left")
    if lang in measured.columns:
        out = out.join(small(side("lang", own)), F.col(lang).cast("string") == F.col(own + "_name"), "left")
        band = F.coalesce(F.col(own), F.col(other))
    else:
        band = F.col(other)
    log = F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))
    fits = within_limits(limits)
    for off, spread, floor in zip(_deviations(log, {c: band[c] for c in _CENTRES}), _SPREADS, LEAST_SPREAD):
        fits = fits & F.coalesce(F.abs(off) <= width * F.greatest(band[spread], F.lit(floor)), F.lit(True))
    return out.withColumn("in_band", fits).select(*measured.columns, "in_band")


def quality_digest(docs: DataFrame) -> DataFrame:
    """Base counts and verdict of every document."""
    cols = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    measured = Scratch(docs.sparkSession).written(measure_quality(docs.select(*cols)).drop("text"), "measures")
    out = with_verdict(measured, fit_stable_bands(measured))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & F.col("in_band")).alias("kept"),
        "n_tokens", "chars_per_token", "byte_share", "entropy_bits", "script",
    )
