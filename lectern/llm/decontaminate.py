"""Benchmark decontamination with a generalised suffix automaton over words.

All benchmark items are normalised to words and put into one automaton. Each document's
words are streamed through it; the state and the matched length give, at every word, the
longest stretch ending there that occurs in some item. A stretch of at least ``window``
words is a hit as a whole (every window inside it is a window of an item), as is an item
shorter than the window that occurs entire. Work is linear in the words of a document.

The automaton is broadcast in blocks of at most ``MAX_BLOCK_WORDS`` item words; an item with
more words is dealt to several blocks that overlap by a window less one word, which hold the
same windows. Usually there is one block; with more, documents pass through the blocks one
after the other and the hits of all blocks are merged, so any size of benchmark gives whole
results.

Normalisation works on UTF-8 bytes: A-Z become a-z, every other ASCII character that is
not a digit or letter separates words, all other bytes belong to words.

Edge cases: null text has no words and stays null; null items and items without words are
never found; repeated items (ties) all count; repeated documents and rows with a null doc_id
are treated one by one and get equal results; very long texts are streamed whole, in time
linear in their words; an empty benchmark leaves every document clean, and an empty table
gives an empty result. find_hits replaces columns that have the names of its own (n_words,
hit_spans, hit_items); decontaminate returns all columns of docs as they are, but for text
and n_chars.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import free_names, map_batches, without, written
from lectern.session import ship

WINDOW = 10
#: Item words in one broadcast automaton: about 400 bytes each in every Python worker, 100 MB at the most.
MAX_BLOCK_WORDS = 250_000
#: Spans of more words are removed; a document is dropped beyond this share of hit words.
#: Items of one to four words are figures of speech rather than passages and stay.
MAX_SPAN_WORDS, MAX_COVERAGE = 4, 0.5
#: Columns that find_hits adds.
NAMES = ("n_words", "hit_spans", "hit_items")

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items behind every window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends = []
        for _, words in items:
            at = 0
            for w in words:
                at = self._extend(at, w)
            ends.append(at)
        n = len(self.step)
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        #: by state: the shortest state of its suffix chain that still holds a whole window
        holder = [0] * n
        for s in by_length:
            if self.length[s] >= window:
                up = self.link[s]
                holder[s] = s if self.length[up] < window else holder[up]
        #: items that contain the last ``window`` words of the state's strings, by holder
        owners: dict[int, set[int]] = {}
        for k, (_, words) in enumerate(items):
            at = 0
            for w in words:
                at = self.step[at][w]
                if holder[at]:
                    owners.setdefault(holder[at], set()).add(k)
        whole: dict[int, list[int]] = {}
        for k, (_, words) in enumerate(items):
            if 0 < len(words) < window:
                whole.setdefault(ends[k], []).append(k)
        #: shortest match that can be a hit
        self.least = min([window, *(len(w) for _, w in items if w)])
        self.ids = [i for i, _ in items]
        #: by state: items with the last ``window`` words; and (length, items) of short items that end here
        self.window_items: list[tuple[int, ...]] = [()] * n
        self.short: list[tuple[tuple[int, tuple[int, ...]], ...]] = [()] * n
        for s in by_length:
            up = self.link[s]
            if holder[s] == s:
                self.window_items[s] = tuple(owners.get(s, ()))
            elif holder[s]:
                self.window_items[s] = self.window_items[holder[s]]
            here = ((self.length[s], tuple(whole[s])),) if s in whole else ()
            self.short[s] = here + self.short[up]

    def _extend(self, last: int, w: bytes) -> int:
        step, link, length = self.step, self.link, self.length
        if w in step[last]:
            q = step[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in step[p]:
            step[p][w] = cur
            p = link[p]
        if p != -1:
            q = step[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: bytes, q: int) -> int:
        step, link, length = self.step, self.link, self.length
        clone = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p != -1 and step[p].get(w) == q:
            step[p][w] = clone
            p = link[p]
        return clone

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged hit spans [start, end) over words, and the numbers of the items found."""
        step, link, length, least, window = self.step, self.link, self.length, self.least, self.window
        at = size = 0
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for i, w in enumerate(words):
            to = step[at].get(w)
            if to is None:
                while at and w not in step[at]:
                    at = link[at]
                size = length[at]
                to = step[at].get(w)
                if to is None:
                    size = 0
                    continue
            at = to
            size += 1
            if size < least:
                continue
            begin = i + 1
            if size >= window:
                begin = i + 1 - size
                found.update(self.window_items[at])
            for n, items in self.short[at]:
                if n <= size:
                    begin = min(begin, i + 1 - n)
                    found.update(items)
            if begin <= i:
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, i + 1))
        return spans, found


def _blocks(benchmark: DataFrame, window: int, max_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items in blocks of at most ``max_words`` words, streamed to the driver one block at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null and item_id is not null")
    held: list[tuple[object, list[bytes]]] = []
    size, most = 0, max(max_words, window)
    for r in rows.toLocalIterator():
        words = words_of(r.text.encode())
        for at in range(0, max(len(words) - window + 1, min(1, len(words))), most - window + 1):
            part = words[at : at + most]
            if held and size + len(part) > most:
                yield held
                held, size = [], 0
            held.append((r.item_id, part))
            size += len(part)
    yield held


def find_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_BLOCK_WORDS, names: tuple[str, str, str] = NAMES
) -> DataFrame:
    """docs with n_words, hit_spans (array of [start, end) words) and hit_items (sorted ids), or ``names``."""
    spark = docs.sparkSession
    empty = (F.lit(0).cast("long"), F.array().cast("array<struct<start:long,end:long>>"), F.array().cast("array<string>"))
    out = without(docs, *names).withColumns(dict(zip(names, empty)))
    blocks = _blocks(benchmark, window, max_words)
    items = next(blocks)
    while items is not None:
        out = map_batches(out, _matcher(spark.sparkContext.broadcast((items, window)), names), out.schema)
        items = next(blocks, None)
        if items is not None:
            out = written(out, "decontaminate")
    return out


#: The automaton of this worker process, by the key of its broadcast.
_BUILT: dict[str, SuffixAutomaton] = {}


def _matcher(shared, names: tuple[str, str, str]):
    key = uuid.uuid4().hex
    words_col, spans_col, items_col = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = SuffixAutomaton(*shared.value)
        automaton = _BUILT[key]
        ids = automaton.ids
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            spans_in, items_in = batch.column(spans_col).to_pylist(), batch.column(items_col).to_pylist()
            n_words, all_spans, all_items = [], [], []
            for t, spans0, items0 in zip(texts, spans_in, items_in):
                words = words_of(t.as_py()) if t.is_valid else []
                spans, found = automaton.match(words)
                if spans0:
                    spans = merge_spans(spans + [(s["start"], s["end"]) for s in spans0])
                n_words.append(len(words))
                all_spans.append([{"start": a, "end": b} for a, b in spans])
                all_items.append(sorted({*items0, *(ids[k] for k in found)}) if found or items0 else [])
            cols = []
            for f in batch.schema:
                if f.name == words_col:
                    cols.append(pa.array(n_words, pa.int64()))
                elif f.name == spans_col:
                    cols.append(pa.array(all_spans, f.type))
                elif f.name == items_col:
                    cols.append(pa.array(all_items, f.type))
                else:
                    cols.append(batch.column(f.name))
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans; what separates the rest stays."""
    data = text.encode()
    folded = data.translate(_FOLD)
    out, keep_from, at, n = [], 0, 0, 0
    bounds = []
    size = len(folded)
    while at < size and n < spans[-1][1]:
        while at < size and folded[at] == 32:
            at += 1
        end = folded.find(b" ", at)
        end = size if end < 0 else end
        if at < end:
            bounds.append((at, end))
            n += 1
        at = end
    for a, b in spans:
        out.append(data[keep_from : bounds[a][0]])
        keep_from = bounds[b - 1][1]
    out.append(data[keep_from:])
    return b"".join(out).decode()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_span_words: int = MAX_SPAN_WORDS,
    max_coverage: float = MAX_COVERAGE,
) -> DataFrame:
    """Documents with too long spans cut out, without those whose coverage is too large.

    A hit span of more than ``max_span_words`` words goes; a document of whose words more
    than ``max_coverage`` are hit goes as a whole. Columns stay those of ``docs``; n_chars
    follows the text where it exists.
    """

    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        return pd.Series(
            [cut_words(t, [(s["start"], s["end"]) for s in sp]) if t is not None and len(sp) else t for t, sp in zip(texts, spans)]
        )

    names = free_names(docs.columns, *NAMES, "cut")
    n_words, spans, _, cut_text = names
    hits = find_hits(docs, benchmark, window, names=tuple(names[:3]))
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s.end - s.start)
    kept = hits.where((F.size(spans) == 0) | (covered <= F.lit(max_coverage) * F.col(n_words)))
    kept = kept.withColumn(spans, F.filter(spans, lambda s: s.end - s.start > max_span_words))
    dirty = F.size(spans) > 0
    kept = kept.withColumn(cut_text, F.when(dirty, cut(F.when(dirty, F.col("text")), spans)).otherwise(F.col("text")))
    out = {"text": F.col(cut_text)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(dirty, F.length(cut_text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumns(out).select(*docs.columns)


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    hits = find_hits(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + s.end - s.start)
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
