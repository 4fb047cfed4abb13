"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by a forward pass; a text's
score in a language is the summed log probability of its words. Piece probabilities are
fitted by expectation maximisation, where the same lattice gives expected piece counts over
all segmentations (forward-backward). Every round is a Spark job over the words' counts; the
driver only sees sums by piece and language.

Words are runs of letters (Unicode categories L*) of the lower-cased text, marked at their
start, of any length: the passes are rescaled as they go, so nothing underflows. All letter
pieces of the vocabulary take part. A letter without a piece has the same small probability
in every language.

The model is fitted on a bounded sample of labelled rows: about ``SAMPLE_DOCS`` documents per
language, chosen by a hash of doc_id and text, each text once; all words of these count.
Prediction reads nothing but the text. The model's size is pieces x languages.

Edge cases: null text, and text without letters, is ``und`` with score 0; so is everything
if there is no labelled row; rows with a null language are not learned from; ties go to the
language that sorts first; very long texts and very long words are scored whole; repeated
rows and rows with a null doc_id get equal results; an empty table gives an empty result.
Columns that have the name of an added one are replaced, or ``names`` gives others; all
others pass through.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lectern.llm.bpe import slices
from lectern.llm.common import Scratch, map_batches, without

SAMPLE_DOCS, ROUNDS = 1500, 4
RARE, SMOOTH = 1e-8, 0.01
CACHE_WORDS = 300_000
#: Positions between two rescalings, and positions whose pieces are looked up at once.
RESCALE, SPAN = 8, 4096
#: Columns that identify adds.
NAMES = ("lang_pred", "score")
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    out = _LETTERS.findall(text.lower())
    if not "".join(out).isalpha() and out:  # numerals such as fractions are no letters
        out = "".join(c if c.isalpha() else " " for c in " ".join(out)).split(" ")
        out = [w for w in out if w]
    return out


def vocabulary_pieces(path: str) -> list[str]:
    """Lower-case letter pieces of a sentencepiece vocabulary; U+2581 marks a word's start."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    out = set()
    for i in range(lib.get_piece_size()):
        p = lib.id_to_piece(i)
        core = p.removeprefix("▁")
        if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i)):
            if p == "▁" or (core.isalpha() and core == core.lower()):
                out.add(p)
    return sorted(out)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of equally long words, the start mark first."""
    return np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


class Lattice:
    """Pieces of a vocabulary by hash, and the passes over words of one length."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pieces
        self.lengths = sorted({1, *map(len, pieces)})
        self.longest = self.lengths[-1]
        with np.errstate(over="ignore"):
            hashes = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
            self.power = np.cumprod(np.r_[np.uint64(1), np.repeat(_BASE, self.longest)], dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.uint64(0)
        for c in piece:
            h = h * _BASE + np.uint64(ord(c))
        return h

    def edges(self, codes: np.ndarray) -> Iterator[list[tuple[int, np.ndarray]]]:
        """For every end 1, 2, ... the (length, piece index by word) of its edges; len(pieces) is no piece."""
        none = len(self.pieces)
        last = [np.zeros(len(codes), np.uint64)]  # hashes of the word up to here, as far back as pieces reach
        for at in range(0, codes.shape[1], SPAN):
            part = codes[:, at : at + SPAN].astype(np.uint64)
            for j in range(part.shape[1]):
                last.append(last[-1] * _BASE + part[:, j])
            prefix = np.stack(last, axis=1)
            known, n = len(last) - 1 - part.shape[1], prefix.shape[1]
            found = {}
            for size in self.lengths:
                if size >= n:
                    break
                h = prefix[:, size:] - prefix[:, : n - size] * self.power[size]
                k = np.searchsorted(self.hashes, h)
                k[k == none] = 0
                piece = np.where(self.hashes[k] == h, self.order[k], none) if none else np.full(h.shape, 0)
                found[size] = piece, (piece != none).any(axis=0)
            for j in range(known + 1, n):
                yield [(size, p[:, j - size]) for size, (p, some) in found.items() if size <= j and (size == 1 or some[j - size])]
            last = last[-self.longest :]

    def _share(self, prob: np.ndarray, size: int, piece: np.ndarray) -> np.ndarray:
        p = prob[piece]
        return np.where((piece == len(self.pieces))[:, None], RARE, p) if size == 1 else p

    def log_total(self, codes: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations [word, language]; prob has a row of zeros last."""
        shape = (len(codes), prob.shape[1])
        ring, scale = [np.ones(shape)], np.zeros(shape)
        for j, here in enumerate(self.edges(codes), 1):
            a = np.zeros(shape)
            for size, piece in here:
                a += ring[-size] * self._share(prob, size, piece)
            ring = [*ring[-self.longest + 1 :], a] if self.longest > 1 else [a]
            if j % RESCALE == 0:
                m = np.max(ring, axis=0)
                ring, scale = [x / m for x in ring], scale + np.log(m)
        return np.log(ring[-1]) + scale

    def _pass(self, steps: list[list[tuple[int, np.ndarray]]], prob: np.ndarray, shape: tuple[int, int], ahead: bool) -> tuple[list, list]:
        """alpha (ahead) or beta by place, and the log of what each is to be multiplied with."""
        n = len(steps)
        out, scale = [np.zeros(shape) for _ in range(n + 1)], [np.zeros(shape)] * (n + 1)
        out[0 if ahead else n] = np.ones(shape)
        for k in range(1, n + 1):
            if ahead:
                for size, piece in steps[k - 1]:
                    out[k] += out[k - size] * self._share(prob, size, piece)
                done = range(max(0, k - self.longest + 1), k + 1)
            else:
                end = n - k + 1
                for size, piece in steps[end - 1]:
                    out[end - size] += out[end] * self._share(prob, size, piece)
                # places that later steps read or add to
                done = range(max(0, end - self.longest), end)
            if k % RESCALE == 0 and k < n:
                m = np.max([out[x] for x in done], axis=0)
                held = scale[k if ahead else end - 1] + np.log(m)
                for x in done:
                    out[x], scale[x] = out[x] / m, held
            if ahead and k < n:
                scale[k + 1] = scale[k]
            elif not ahead:
                for x in range(max(0, end - 1 - self.longest), end - 1):
                    scale[x] = scale[end - 1]
        return out, scale

    def expected(self, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected piece counts [pieces + 1, languages] over all segmentations of the words, counts [words, languages]."""
        none, langs = len(self.pieces), counts.shape[1]
        total = np.zeros((none + 1, langs))
        for ks, codes in self.by_length(words):
            steps, shape = list(self.edges(codes)), (len(codes), langs)
            alpha, up = self._pass(steps, prob, shape, True)
            beta, down = self._pass(steps, prob, shape, False)
            whole = np.log(alpha[-1]) + up[-1]
            for j, here in enumerate(steps, 1):
                for size, piece in here:
                    hit = np.flatnonzero(piece != none)
                    i = j - size
                    factor = np.exp(up[i][hit] + down[j][hit] - whole[hit])
                    mass = counts[ks[hit]] * factor * alpha[i][hit] * prob[piece[hit]] * beta[j][hit]
                    for k in range(langs):
                        total[:, k] += np.bincount(piece[hit], mass[:, k], none + 1)
        return total

    def by_length(self, words: list[str], most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of the words, their codes), equally long words together."""
        groups = defaultdict(list)
        for k, w in enumerate(words):
            groups[len(w)].append(k)
        for ks in groups.values():
            for at in range(0, len(ks), most):
                part = ks[at : at + most]
                yield np.array(part), _codes([words[k] for k in part])

    def start(self, langs: int) -> np.ndarray:
        """Equal probabilities of all pieces."""
        prob = np.zeros((len(self.pieces) + 1, langs))
        prob[:-1] = 1.0 / max(1, len(self.pieces))
        return prob

    def improved(self, total: np.ndarray) -> np.ndarray:
        """Probabilities from expected counts."""
        prob = np.zeros_like(total)
        prob[:-1] = total[:-1] + SMOOTH
        return prob / np.maximum(prob.sum(axis=0), 1e-300)

    def log_scores(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), prob.shape[1]))
        for ks, codes in self.by_length(words):
            out[ks] = self.log_total(codes, prob)
        return out


class Model:
    """What prediction needs: languages, pieces, probabilities. Its size is vocabulary x languages."""

    def __init__(self, langs: list[str], pieces: list[str], prob: np.ndarray) -> None:
        self.langs, self.pieces, self.prob = langs, pieces, prob


def train(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    vocabulary: str = "piece_bpe_32k.model",
    sample_docs: int = SAMPLE_DOCS,
    rounds: int = ROUNDS,
) -> Model:
    """Fit the model on a bounded sample of the rows with a language (see above)."""
    pieces = vocabulary_pieces(public_tokenizers.path(vocabulary))
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(F.col(key), F.col(text)).alias("place")
    )
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)))
    limit = F.element_at(F.create_map(*[F.lit(x) for g in langs for x in (g, int((1 << 20) * min(1.0, sample_docs / sizes[g])))]), F.col("lang"))
    # a text that many rows share counts once, so that it can't swell the sample
    chosen = labelled.where(F.pmod("place", F.lit(1 << 20)) < limit).dropDuplicates(["lang", "h"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for g, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                seen[g].update(words_of(t))
            rows = [(g, w, n) for g, c in seen.items() for w, n in c.items()]
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "word", "n"]
            )

    number = F.element_at(F.create_map(*[F.lit(x) for k, g in enumerate(langs) for x in (g, k)]), F.col("lang"))
    words = map_batches(chosen.select("lang", "text"), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = words.groupBy("word").agg(F.collect_list(number).alias("langs"), F.collect_list("n").alias("ns"))
    scratch = Scratch(docs.sparkSession)
    prob = _fit(scratch.written(words, "words"), pieces, len(langs), rounds)
    scratch.clear()
    return Model(langs, pieces, prob)


def _fit(words: DataFrame, pieces: list[str], langs: int, rounds: int) -> np.ndarray:
    """Expectation maximisation over (word, langs, ns): expected counts in tasks, sums by piece and language here."""
    lattice, sc = Lattice(pieces), words.sparkSession.sparkContext
    prob = lattice.start(langs)
    for _ in range(rounds):
        shared = sc.broadcast((pieces, prob))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, now = shared.value
            lattice, total = Lattice(own), np.zeros_like(now)
            for batch in batches:
                counts = np.zeros((batch.num_rows, now.shape[1]))
                for k, (gs, ns) in enumerate(zip(batch.column("langs").to_pylist(), batch.column("ns").to_pylist())):
                    counts[k, gs] = ns
                total += lattice.expected(batch.column("word").to_pylist(), counts, now)
            at = np.nonzero(total[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((*at, total[at]), (pa.int32(), pa.int32(), pa.float64()))], names=["piece", "lang", "mass"])

        got = map_batches(words, run, "piece int, lang int, mass double").groupBy("piece", "lang").agg(F.sum("mass").alias("mass")).toArrow()
        total = np.zeros_like(prob)
        total[got.column("piece").to_numpy(), got.column("lang").to_numpy()] = got.column("mass").to_numpy()
        prob = lattice.improved(total)
        shared.destroy()
    return prob


class _Rows(dict):
    """word -> row of the score table; new words wait in ``pending``."""

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.pending.append(word)
        return n


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.lattice = model, Lattice(model.pieces)
        self._reset()

    def _reset(self) -> None:
        self.rows = _Rows()
        self.table = np.zeros((0, len(self.model.langs)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.rows) > CACHE_WORDS:
            self._reset()
        at = [np.fromiter(map(self.rows.__getitem__, words_of(t) if t else ()), np.int64) for t in texts]
        if self.rows.pending:
            self.table = np.concatenate([self.table, self.lattice.log_scores(self.rows.pending, self.model.prob)])
            self.rows.pending = []
        langs, scores = [], []
        for ids in at:
            if not len(ids) or not self.model.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.table[ids].sum(axis=0)
            best = int(total.argmax())
            langs.append(self.model.langs[best])
            scores.append(round(float(1.0 / np.exp(total - total[best]).sum()), 9))
        return langs, scores


_LOADED: dict[str, Scorer] = {}


def identify(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = NAMES) -> DataFrame:
    """docs with lang_pred and score, the posterior of that language under equal priors."""
    import uuid

    docs = without(docs, *names)
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((model.langs, model.pieces, model.prob))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Scorer(Model(*shared.value))
        scorer = _LOADED[key]
        for whole in batches:
            for batch in slices(whole, text):
                langs, scores = scorer.predict(batch.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *names]
                )

    fields = [*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]
    return map_batches(docs, run, StructType(fields))


def held_out(key: F.Column) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text"))
    out = identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
