"""Phrase collocations by suffix sorting (suffix-sigma).

1. Words are counted by language. This gives n, the words too rare to be part of a candidate,
   and the first words so frequent that their suffixes must be dealt to several tasks; pairs
   that begin with such a word are counted besides.
2. Every position of a piece gives one suffix of up to ``max_n`` words, with the language in
   front. Suffixes end before a rare word, since no candidate reaches over it. Equal suffixes
   are summed in the task that reads them.
3. Suffixes are shuffled by language and first word and sorted in reverse order. One stack
   with a slot for each word of the last suffix counts all prefixes: a prefix is complete when
   the next suffix no longer begins with it. Suffixes of a frequent first word are dealt on by
   the second word, those of a frequent pair by all that follows; prefixes of which several
   tasks then hold a part are added up afterwards.
4. The counts of a candidate's two parts are joined to it for each cut.

The stack works on Arrow batches: numpy finds where neighbouring suffixes part, and each slot
is summed between such places; slots stay open from batch to batch, so memory is that of a
batch and ``max_n`` words.

The set of frequent words is broadcast while it measures at most ``FREQUENT_BYTES``; else
suffixes are not shortened, which changes the size of the shuffle and no count. The broadcast
of frequent first words and pairs has a number of entries in proportion to the shuffle
partitions. Which they are decides the dealing only.

Edge cases: null texts and texts without words count as empty; a null language counts as
``und``; rows count one by one, repeated or not, and keys are not looked at; texts and pieces
of any length count whole; words may hold control characters; equal scores are ordered by
count and phrase; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, map_batches, release, small, written

MAX_N, LEAST, TOP = 4, 30, 2000
#: Scores are ratios times this, cut to whole numbers.
UNIT = 2_000_000
#: A phrase goes if a longer candidate around it has so many hundredths of its count.
COVERED = 80
#: Size up to which the set of frequent words is broadcast.
FREQUENT_BYTES = 8 << 20
#: Distinct words, and positions, that a task sums before it sends them on.
HELD = 300_000
POSITIONS = 1 << 20
#: A first word or pair is dealt on when it has more than the share of so many tasks for each shuffle partition.
FINER = 4
#: Groups in which a language's candidates are ranked before the last ranking.
RANK_WAYS = 128
_ENDS = b".,;:!?\n\x0b\x0c\r"
_END = b"\x00"  # as a word: the end of a piece; in words it is escaped
_FOLD = bytes(0 if b in _ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Characters that sort before the separator, or mark an escape, are escaped.
_LOW = bytes([*range(9), 14])
_OTHERS = bytes(b for b in range(256) if b not in _LOW)


def escaped(data: bytes, low: bytes = _LOW) -> bytes:
    """data with the low characters as \\x0e and a character 16 above, so that a line feed sorts before all."""
    if not data.translate(None, _OTHERS) and low == _LOW:
        return data
    return b"".join(bytes([14, b + 16]) if b in low else bytes([b]) for b in data)


def plain(data: bytes) -> bytes:
    if b"\x0e" not in data:
        return data
    first, *rest = data.split(b"\x0e")
    return first + b"".join(bytes([x[0] - 16]) + x[1:] for x in rest)


def words_of(data: bytes) -> list[bytes]:
    """All words, folded and escaped, with ``_END`` between pieces."""
    return escaped(data).translate(_FOLD).replace(_END, b" \x00 ").split()  # of the white space only blanks are left


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    """(language with its separator, text) of each row with a text."""
    for lang, text in zip(batch.column("lang"), batch.column("text")):
        if text.is_valid:
            yield escaped(lang.as_py().encode(), bytes(range(15))) + b"\n", text.as_py().encode()


def word_counts(docs: DataFrame, partitions: int) -> DataFrame:
    """word (language, line feed, word), n; and as word also frequent pairs (language, word, word, with line feeds)."""
    rare = 2 * FINER * partitions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, Counter] = {}
        pairs: dict[bytes, Counter] = {}
        hot: dict[bytes, set[bytes]] = {}
        seen = looked = 0
        for batch in batches:
            for head, data in _texts(batch):
                if seen > 2 * looked:
                    looked, hot = seen, {head: {w for w, n in own.items() if n * rare > seen} for head, own in counts.items()}
                words = words_of(data)
                counts.setdefault(head, Counter()).update(words)
                seen += len(words)
                if many := hot.get(head):
                    pairs.setdefault(head, Counter()).update([x for x in zip(words, words[1:]) if x[0] in many])
            if sum(map(len, counts.values())) > HELD:
                yield _rows(counts, pairs, seen)
                counts, pairs, seen, looked = {}, {}, 0, 0
        yield _rows(counts, pairs, seen)

    def _rows(counts: dict[bytes, Counter], pairs: dict[bytes, Counter], seen: int) -> pa.RecordBatch:
        rows = [(head + w, n) for head, own in counts.items() for w, n in own.items() if w != _END]
        rows += [(head + b"\n".join(x), n) for head, own in pairs.items() for x, n in own.items() if n * rare > seen and _END not in x]
        keys, n = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    return map_batches(docs, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Numbers of a language's words within a task; 0 for the end of a piece and words that don't count."""

    def __init__(self, kept: list[bytes] | None, hot: dict[bytes, int]) -> None:
        self.closed, self.hot = kept is not None, hot
        self.ids = {_END: 0} | {w: k + 1 for k, w in enumerate(kept or ())}
        self.made = 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if self.closed:
            return np.fromiter(map(self.ids.get, words, repeat(0)), np.int64, len(words))
        ids = self.ids
        return np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int64, len(words))

    def tables(self) -> tuple[pa.Array, np.ndarray, np.ndarray, dict[int, int]]:
        """Words, their hashes, the parts of hot first words, the parts of hot pairs, by number."""
        if self.made != len(self.ids):
            self.made, words = len(self.ids), list(self.ids)
            ways = np.zeros(len(words), np.int64)
            pairs = {}
            for key, n in self.hot.items():
                first, _, second = key.partition(b"\n")
                if first in self.ids and not second:
                    ways[self.ids[first]] = n
                elif first in self.ids and second in self.ids:
                    pairs[self.ids[first] << 32 | self.ids[second]] = n
            self.held = pa.array(words, pa.binary()).cast(pa.string()), np.array([xxhash.xxh3_64_intdigest(w) >> 1 for w in words], np.int64), ways, pairs
        return self.held


def counted_suffixes(ids: np.ndarray, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes (rows of max_n numbers, 0 behind the end) of a row of words with zeros between pieces, and their counts."""
    long_ = np.concatenate([ids, np.zeros(max_n, np.int64)])
    grid = np.stack([long_[k : k + len(ids)] for k in range(max_n)], 1)
    grid = grid[grid[:, 0] > 0]
    grid[np.logical_or.accumulate(grid == 0, axis=1)] = 0
    if not len(grid):
        return grid, np.zeros(0, np.int64)
    packed = [grid[:, k] << 32 | (grid[:, k + 1] if k + 1 < max_n else 0) for k in range(0, max_n, 2)]
    order = np.lexsort(packed[::-1])
    packed = [x[order] for x in packed]
    new = np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in packed])])
    starts = np.flatnonzero(new)
    return grid[order[starts]], np.diff(np.append(starts, len(grid)))


def suffixes(docs: DataFrame, frequent: list[bytes] | None, hot: dict[bytes, int], max_n: int = MAX_N) -> DataFrame:
    """suffix (language and up to max_n words), part, n.

    frequent: language and word of all that count, or None; hot: language and first word or
    pair -> parts. part is 0 in groups that stay whole, above 0 in those dealt by the second
    word, below 0 in those dealt by all that follows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((None if frequent is None else _by_lang(frequent), _by_lang(hot)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, parts = shared.value
        known: dict[bytes, Vocabulary] = {}
        held: dict[bytes, list[np.ndarray]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for head, ids in held.items():
                yield from _suffix_rows(head, np.concatenate(ids), known[head], max_n)
            held.clear()
            for head in [h for h, v in known.items() if not v.closed and len(v.ids) > HELD]:
                del known[head]

        for batch in batches:
            for head, data in _texts(batch):
                if head not in known:
                    own = {w: n for w, n in parts.get(head, [])}
                    known[head] = Vocabulary(None if kept is None else [w for w, _ in kept.get(head, [])], own)
                ids = np.append(known[head].numbers(words_of(data)), 0)
                held.setdefault(head, []).append(ids)
                size += len(ids)
                if size > POSITIONS:
                    yield from rows()
                    size = 0
        yield from rows()

    return map_batches(docs, run, "suffix string, part int, n long")


def _suffix_rows(head: bytes, ids: np.ndarray, known: Vocabulary, max_n: int) -> Iterator[pa.RecordBatch]:
    grid, n = counted_suffixes(ids, max_n)
    words, digest, ways, pairs = known.tables()
    second = grid[:, 1] if max_n > 1 else np.zeros(len(grid), np.int64)
    own = ways[grid[:, 0]]
    part = np.where(own > 0, 1 + digest[second] % np.maximum(own, 1), 0)
    if pairs:
        key = grid[:, 0] << 32 | second
        for at in np.flatnonzero(np.isin(key, list(pairs))).tolist():
            part[at] = -1 - hash(tuple(digest[grid[at, 1:]].tolist())) % pairs[int(key[at])]
    length = (grid > 0).sum(1)
    for size in range(1, max_n + 1):
        rows = np.flatnonzero(length == size)
        for at in range(0, len(rows), 1 << 17):
            some = rows[at : at + (1 << 17)]
            columns = [words.take(pa.array(grid[some, k])) for k in range(size)]
            keys = pc.binary_join_element_wise(head[:-1].decode(), *columns, "\n")
            yield pa.RecordBatch.from_arrays([keys, pa.array(part[some], pa.int32()), pa.array(n[some], pa.int64())], names=["suffix", "part", "n"])


def _by_lang(words: list[bytes] | dict[bytes, int]) -> dict[bytes, list[tuple[bytes, int]]]:
    """language with its separator -> [(word or pair, number or 0)]."""
    out: dict[bytes, list[tuple[bytes, int]]] = {}
    for x in words:
        head, _, word = x.partition(b"\n")
        out.setdefault(head + b"\n", []).append((word, words[x] if isinstance(words, dict) else 0))
    return out


class PrefixStack:
    """The open prefixes of the last suffix seen: a word and a count for each slot, the language at the bottom."""

    def __init__(self, max_n: int, least: int) -> None:
        self.depth, self.least = max_n + 1, least
        self.words: list[bytes] = []
        self.counts: list[int] = []
        self.part = 0

    def push(self, suffix: pa.Array, part: np.ndarray, n: np.ndarray) -> list[tuple[bytes, bytes, int, int, bool]]:
        """Take sorted suffixes; (language, phrase, words, count, split) of the prefixes they close."""
        if not len(suffix):
            return []
        lists = pc.split_pattern(suffix.cast(pa.string()), "\n")
        offsets, flat = lists.offsets.to_numpy(), lists.values
        codes = flat.dictionary_encode().indices.to_numpy()
        length = np.diff(offsets)
        grid = np.full((len(suffix), self.depth), -1, np.int64)
        at = np.arange(self.depth)[None] < length[:, None]
        grid[at] = codes[offsets[0] : offsets[-1]]
        same = (grid[1:] == grid[:-1]) & (grid[1:] >= 0)
        common = np.concatenate([[0], np.logical_and.accumulate(same, axis=1).sum(1)])
        first = [flat[k].as_py().encode() for k in range(offsets[0], offsets[1])]
        while common[0] < min(len(first), len(self.words)) and first[common[0]] == self.words[common[0]]:
            common[0] += 1
        out = self._closed(int(common[0]))
        last = int(length[-1])
        words, counts = [flat[k].as_py().encode() for k in range(offsets[-2], offsets[-1])], [0] * last
        for slot in range(1, self.depth):
            rows = np.flatnonzero(length > slot)
            if not len(rows):
                continue
            opens = np.flatnonzero(common[rows] <= slot)
            starts = opens if len(opens) and opens[0] == 0 else np.concatenate([[0], opens])
            sums = np.add.reduceat(n[rows], starts)
            if not len(opens) or opens[0] != 0:  # goes on with the slot that is open
                sums[0] += self.counts[slot]
            # the last prefix stays open if the last suffix begins with it
            stays = last > slot
            if stays:
                counts[slot] = int(sums[-1])
            begin = rows[starts]
            closing = np.arange(len(starts)) < len(starts) - stays
            split = self._split(slot, part[begin])
            closing &= (sums >= self.least) | split
            for row, total, shared in zip(begin[closing].tolist(), sums[closing].tolist(), split[closing].tolist()):
                own = flat.slice(offsets[row], slot + 1).to_pylist()
                out.append(self._row([w.encode() for w in own], total, shared))
        self.words, self.counts, self.part = words, counts, int(part[-1])
        return out

    def _split(self, slot: int, part):
        """Whether other tasks may hold a part of the prefix: a frequent first word, or a frequent pair unless the suffix is full."""
        return (part != 0) if slot == 1 else (part < 0) & (slot < self.depth - 1)

    def close(self) -> list[tuple[bytes, bytes, int, int, bool]]:
        return self._closed(0)

    def _closed(self, depth: int) -> list[tuple[bytes, bytes, int, int, bool]]:
        """Rows of the slots that close when only ``depth`` words go on."""
        slots = range(max(1, depth), len(self.words))
        split = [bool(self._split(slot, self.part)) for slot in slots]
        return [self._row(self.words[: k + 1], self.counts[k], x) for k, x in zip(slots, split) if self.counts[k] >= self.least or x]

    @staticmethod
    def _row(words: list[bytes], total: int, split: bool) -> tuple[bytes, bytes, int, int, bool]:
        return plain(words[0]), plain(b" ".join(words[1:])), len(words) - 1, total, split


def prefix_counts(sorted_suffixes: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """lang, phrase, size, f, split: the prefixes from ``least`` on, and the parts of those that several tasks share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = PrefixStack(max_n, least)
        for batch in batches:
            yield _rows(stack.push(batch.column("suffix"), batch.column("part").to_numpy(), batch.column("n").to_numpy()))
        yield _rows(stack.close())

    def _rows(rows) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[]] * 5
        kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.bool_()]
        arrays = [pa.array(c, t) for c, t in zip(cols, kinds)]
        return pa.RecordBatch.from_arrays([arrays[0].cast(pa.string()), arrays[1].cast(pa.string()), *arrays[2:]], names=["lang", "phrase", "size", "f", "split"])

    return map_batches(sorted_suffixes, run, "lang string, phrase string, size int, f long, split boolean")


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f of all phrases from ``least`` on; lang, n: all word occurrences). Both are written."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    slim = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = scratch.written(word_counts(slim, partitions), "words")
    feeds = F.length("word") - F.length(F.replace("word", F.lit("\n")))
    single = words.where(feeds == 1)
    totals = written(single.groupBy(F.substring_index("word", "\n", 1).alias("head")).agg(F.sum("n").alias("n")), "totals")
    rows = totals.agg(F.sum("n")).first()[0] or 0
    usual = single.where(F.col("n") >= least)
    size = usual.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    frequent = [w.encode() for w in usual.select("word").toArrow().column(0).to_pylist()] if size <= FREQUENT_BYTES else None
    share = max(1, rows // (FINER * partitions))
    hot = {r.word.encode(): -(-r.n // share) for r in words.where(F.col("n") > share).collect()}  # two for each share at most
    dealt = suffixes(slim, frequent, hot, max_n).repartition(F.substring_index("suffix", "\n", 2), "part")
    counted = scratch.written(prefix_counts(dealt.sortWithinPartitions(F.desc("suffix")), max_n, least), "prefixes")
    release(spark)
    added = counted.where("split").groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    out = written(counted.where("not split").select("lang", "phrase", "size", "f").union(added), "phrases")
    scratch.clear()
    lang = map_batches(totals, _plain_heads, "lang string, n long")
    return out, lang


def _plain_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = [plain(x.as_py().encode()).decode() for x in batch.column("head")]
        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), batch.column("n")], names=["lang", "n"])


def scored(phrases: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, phrase, size, a, score, l, r of every candidate, by its lowest cut."""
    long_ = phrases.where("size >= 2").withColumn("w", F.split("phrase", " "))
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = long_.select("lang", "phrase", "size", F.col("f").alias("a"), "w", cut)
    join = lambda begin, length: F.array_join(F.slice("w", begin, length), " ")
    cuts = cuts.select("lang", "phrase", "size", "a", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = scratch.written(cuts, "cuts")  # so that the joins deal both sides anew and can split a part of many phrases
    part = lambda name, count: small(phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count)))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr(f"cast({UNIT} as decimal(10, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    both = both.withColumn("score", score.cast("long"))
    best = both.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "size", "a", "best.score", "best.l", "best.r")


def uncovered(found: DataFrame, phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """Candidates whose words lie in no longer candidate of nearly their count."""
    longer = phrases.where("size >= 3").withColumn("w", F.split("phrase", " "))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda at: F.array_join(F.slice("w", at, m), " "))))
    inner = longer.select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f")
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    out = found.join(most, ["lang", "phrase"], "left")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return out.where(F.col("most").isNull() | (100 * wide("most") < covered * wide("a"))).drop("most")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    scratch = Scratch(docs.sparkSession)
    phrases, totals = phrase_counts(docs, max_n, least)
    found = scratch.written(uncovered(scored(phrases, scratch), phrases, covered), "found")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # ranked in groups first: no task gets all candidates of a language
    way = F.pmod(F.xxhash64("phrase"), F.lit(RANK_WAYS))
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", way).orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = written(ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    scratch.clear()
    return out
