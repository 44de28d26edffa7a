"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of two lexicons (a fixed list of insults, and words
and word beginnings that training rows show to mark toxic texts), hits found only after
undoing character substitutions, hits near a second-person pronoun, capitals,
words in capitals, exclamation and question marks, other punctuation, words that mix letters
with digits or symbols, digits, mean word length and log length.  All are
taken with NumPy over whole batches; texts are read whole.

Labels are learned from a bounded sample, ``FIT_ROWS`` rows at most, drawn by a seeded hash of the id and split in three:
lexicon, trees, calibration.  Their texts are read whole, on executors: terms are counted there, and only
chosen terms and one row of features a text come to the driver.  Null and empty texts have all-zero features and are
scored like any other.  With fewer than ``MIN_CLASS`` ids of a class every
text scores the base rate.  Rows are scored one by one; repeated rows score alike.  An id that repeats is learned from
once.  An empty table gives no rows.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .folds import fold, labelled_sample
from .scratch import staged

FIT_ROWS = 8000
MIN_CLASS = 6
THRESHOLD = 0.5
FOLDS, HELD_OUT = 5, 0
NEAR = 5
PREFIXES = (3, 4, 5, 6, 7, 8, 9)  # bytes

#: Fixed lists of common knowledge.
INSULTS = "asshole bastard bitch clown creep cretin crap damn disgusting dumb fool freak fuck garbage hate idiot imbecile jerk kill loser lunatic moron pathetic pig scum shit shut stupid sucker trash ugly vermin wanker worthless arschloch dumm dummkopf hurensohn scheisse abschaum connard crétin débile imbécile salaud merde basura estúpido idiota imbécil mierda asqueroso".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()

_LEET = {0x30: 0x6F, 0x31: 0x69, 0x33: 0x65, 0x34: 0x61, 0x35: 0x73, 0x37: 0x74, 0x40: 0x61, 0x24: 0x73, 0x21: 0x69}
NAMES = ("insults", "learned", "prefixes", "disguised", "near_you", "capitals", "shouted", "marks", "punctuation", "mixed", "digits", "word_length", "log_words")


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    plain = tx.byte_table(alnum=True)
    loose = tx.byte_table(lower=True)  # words by white space
    leet = plain.copy()
    for a, b in _LEET.items():
        leet[a] = b
    return plain, loose, leet


_PLAIN, _LOOSE, _DELEET = _tables()


def codes(words: list[str]) -> np.ndarray:
    """Sorted hashes of words, as :mod:`.text` gives them."""
    if not words:
        return np.zeros(0, np.uint64)
    column = pa.array([w.encode() for w in words], pa.large_binary())
    return np.unique(np.concatenate([w.hash for w in tx.tokenise(column, np.arange(256, dtype=np.uint8))]))


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), bool)
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return known[at] == hashes


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _heads(w: tx.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words have at least n bytes, and the hashes of their first n bytes."""
    long = np.flatnonzero(w.end - w.start >= n)
    at = w.start[long]
    packed = np.zeros(len(long), np.uint64)
    for i in range(n):
        packed = packed * np.uint64(0x100000001B3) + w.data[at + i].astype(np.uint64) + np.uint64(1)
    return long, tx.mix(packed)


def _head_codes(heads: list[bytes]) -> dict[int, np.ndarray]:
    out: dict[int, list[int]] = {}
    for h in heads:
        packed = 0
        for b in h:
            packed = (packed * 0x100000001B3 + b + 1) & (2**64 - 1)
        out.setdefault(len(h), []).append(packed)
    return {n: np.unique(tx.mix(np.array(x, dtype=np.uint64))) for n, x in out.items()}


class Lexicon:
    def __init__(self, words: list[str], heads: list[bytes]):
        self.fixed, self.you = codes(INSULTS), codes(SECOND_PERSON)
        self.learned, self.heads = codes(words), _head_codes(heads)

    def features(self, column: pa.Array) -> np.ndarray:
        """One row of NAMES for each text."""
        offsets, data = tx.binary_parts(column)
        out = np.zeros((len(offsets) - 1, len(NAMES)))
        loose = tx.tokenise(column, _LOOSE, hashed=False)
        leet = tx.tokenise(column, _DELEET)
        for w, v, x in zip(tx.tokenise(column, _PLAIN), loose, leet, strict=True):
            rows = slice(w.row, w.row + len(w.first) - 1)
            bounds = offsets[w.row : w.row + len(w.first)] - offsets[w.row]
            raw = data[offsets[w.row] : offsets[w.row] + bounds[-1]]
            n = np.maximum(np.diff(w.first), 1)
            size = np.maximum(np.diff(bounds), 1)
            insult, learned = _among(w.hash, self.fixed), _among(w.hash, self.learned)
            head = np.zeros(len(w.hash), bool)
            for k, known in self.heads.items():
                at, h = _heads(w, k)
                head[at[_among(h, known)]] = True
            hit = insult | learned | head
            you = np.zeros(len(hit) + 1, np.int64)
            np.cumsum(_among(w.hash, self.you), out=you[1:])
            at = np.flatnonzero(hit)
            owner = np.searchsorted(w.first, at, side="right") - 1
            near = np.zeros(len(hit), bool)
            near[at] = you[np.minimum(at + NEAR + 1, w.first[owner + 1])] > you[np.maximum(at - NEAR, w.first[owner])]
            every = np.maximum(_sums(_among(x.hash, self.fixed) | _among(x.hash, self.learned), x.first) - _sums(insult | learned, w.first), 0)
            upper = (raw >= 65) & (raw <= 90)
            letter = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
            digit = (raw >= 48) & (raw <= 57)
            mark = (raw == 33) | (raw == 63)
            other = ~letter & ~digit & ~mark & (raw > 32)
            word = lambda f: np.add.reduceat(f.astype(np.int64), v.start) if len(v.start) else np.zeros(0, np.int64)
            letters, uppers, odd = word(letter), word(upper), word(digit | other)
            loose_n = np.maximum(np.diff(v.first), 1)
            out[rows] = np.column_stack(
                [
                    _sums(insult, w.first) / n,
                    _sums(learned, w.first) / n,
                    _sums(head, w.first) / n,
                    every / n,
                    _sums(near, w.first) / n,
                    _sums(upper, bounds) / size,
                    _sums((uppers > 1) & (uppers == letters), v.first) / loose_n,
                    _sums(mark, bounds) / size,
                    _sums(other, bounds) / size,
                    _sums((letters > 1) & (odd > 1), v.first) / loose_n,
                    _sums(digit, bounds) / size,
                    _sums(w.end - w.start, w.first) / n,
                    np.log1p(np.diff(w.first)),
                ]
            )
        return out


def _terms(text: bytes) -> set[bytes]:
    words = set(text.translate(_PLAIN.tobytes()).split())
    return {b"=" + w for w in words if len(w) > 2} | {w[:n] for w in words for n in PREFIXES if len(w) >= n}


def learn_lexicon(rows: DataFrame, n_bad: int, n_good: int, least: int = 4, odds: float = 12.0) -> Lexicon:
    """Words and word beginnings far more frequent in toxic texts, by documents that hold them.  rows: (text, label)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[y].update(_terms(text or b""))
        terms = list(found[0].keys() | found[1].keys())
        for low in range(0, len(terms), 100_000):
            piece = terms[low : low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.binary()), *[pa.array([found[y][t] for t in piece], pa.int64()) for y in (1, 0)]], names=["term", "bad", "good"])

    counts = rows.select("text", "label").mapInArrow(count, "term binary, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rate = (F.col("bad") / max(1, n_bad)) / ((F.col("good") + 0.5) / max(1, n_good))
    chosen = [bytes(r[0]) for r in counts.where((F.col("bad") >= least) & (rate >= odds)).select("term").collect()]
    words = [t[1:].decode("utf-8", "replace") for t in chosen if t[:1] == b"="]
    heads = sorted((t for t in chosen if t[:1] != b"="), key=len)
    short: set[bytes] = set()
    for h in heads:  # a beginning that holds a chosen one adds nothing
        if not any(h[:n] in short for n in range(1, len(h))):
            short.add(h)
    return Lexicon(words, sorted(short))


class Trees:
    """Boosted regression trees on logistic loss, over quantile bins."""

    def __init__(self, n_trees: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 32, least: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least = n_trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c[c > 0] if (c > 0).any() else c, np.linspace(0, 1, self.bins))) for c in x.T]
        b = self._binned(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = math.log(p / (1 - p))
        f = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            tree = []
            for level in range(self.depth):
                splits = [self._split(b, g, h, node == k) for k in range(1 << level)]
                tree.append(splits)
                feature, cut = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
                node = 2 * node + (b[np.arange(len(y)), feature[node]] > cut[node])
            k = 1 << self.depth
            leaf = np.bincount(node, g, k) / (np.bincount(node, h, k) + self.least) * self.rate
            self.trees.append((tree, leaf))
            f += leaf[node]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, col, side="right") for c, col in zip(self.cuts, x.T, strict=True)])

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[int, int]:
        best = (0.0, 0, 1 << 30)
        if rows.sum() >= 4:
            for j in range(b.shape[1]):
                n = len(self.cuts[j]) + 1
                gs, hs = np.cumsum(np.bincount(b[rows, j], g[rows], n)), np.cumsum(np.bincount(b[rows, j], h[rows], n))
                score = gs**2 / (hs + self.least) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + self.least) - gs[-1] ** 2 / (hs[-1] + self.least)
                k = int(np.argmax(score))
                if score[k] > best[0] + 1e-9:
                    best = (float(score[k]), j, k)
        return best[1], best[2]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out, every = self._binned(x), np.full(len(x), self.start), np.arange(len(x))
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for splits in tree:
                feature, cut = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
                node = 2 * node + (b[every, feature[node]] > cut[node])
            out += leaf[node]
        return out


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (knots, values) of the best non-decreasing fit, shrunk by half a row of either class."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(z[order], y[order], strict=True):
        blocks.append([float(b), 1.0, float(a), float(a)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    values = np.array([v for b in blocks for v in [(b[0] + 0.25) / (b[1] + 0.5)] * 2])
    return knots, np.maximum.accumulate(values)


class Model:
    def __init__(self, lexicon: Lexicon | None, trees: Trees | None, knots: np.ndarray, values: np.ndarray, base: float):
        self.lexicon, self.trees, self.knots, self.values, self.base = lexicon, trees, knots, values, base

    def score(self, column: pa.Array) -> np.ndarray:
        if self.trees is None or self.lexicon is None:
            return np.full(len(column), self.base)
        return np.clip(np.interp(self.trees.raw(self.lexicon.features(column)), self.knots, self.values), 0.0, 1.0)


def _features(rows: DataFrame, lexicon: Lexicon) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Features and labels of parts 1 and 2, in the same order in any run.  rows: (doc_id, text, label, part)."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shared.value.features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "part", "x"])

    found = rows.where("part > 0").select("doc_id", "text", "label", "part").mapInArrow(run, "doc_id long, label int, part int, x array<double>").collect()
    found.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[3]))
    return {p: (np.array([r[3] for r in found if r[2] == p]).reshape(-1, len(NAMES)), np.array([r[1] for r in found if r[2] == p], dtype=float)) for p in (1, 2)}


def toxicity_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    rows = labelled_sample(docs, labels, "toxic", (FOLDS, HELD_OUT), fit_rows)
    rows = staged(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "label"), "toxicity-rows")
    found = [(r[0], r[1]) for r in rows.select("doc_id", "label").collect()]
    found.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))  # the same order in any run
    y = np.array([k for _, k in found], dtype=float)
    base = float((y.sum() + 0.5) / (len(y) + 1))
    if min(sum(k == c for _, k in found) for c in (0, 1)) < MIN_CLASS:
        return Model(None, None, np.zeros(1), np.zeros(1), base)
    parts, dealt = {}, [0, 0]
    for doc_id, k in found:  # each class is dealt 2 : 2 : 1
        parts[doc_id] = (0, 1, 0, 1, 2)[dealt[k] % 5]
        dealt[k] += 1
    dealt_rows = docs.sparkSession.createDataFrame(list(parts.items()), "doc_id long, part int")
    rows = rows.join(F.broadcast(dealt_rows), "doc_id")
    first = [k for doc_id, k in found if parts[doc_id] == 0]
    lexicon = learn_lexicon(rows.where("part = 0"), sum(first), len(first) - sum(first))
    x = _features(rows, lexicon)
    trees = Trees().fit(*x[1])
    knots, values = isotonic(trees.raw(x[2][0]), x[2][1])
    return Model(lexicon, trees, knots, values, base)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tens of KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            values = own.score(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64()), pa.array((values >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    body = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return body.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
