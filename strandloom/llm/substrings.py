"""Removal of repeated passages with FM-indexes.

A window is 35 consecutive words of a text; a word goes if a window that covers it also
starts anywhere else in the corpus.

*Dealing.*  Among the 28 eight-word grams of a window, the leftmost one with the smallest hash
is its minimiser.  Equal windows have equal minimisers, so windows dealt by minimiser
meet.  Consecutive windows with the same minimiser are one segment, and each window
is in one segment only.  Segments whose minimiser occurs once in the corpus hold no
repeated window and go no further.  Equal segments are sent once, with their number.

*Index.*  A shard, a range of minimisers, numbers the words of its segments and builds the
suffix array, the Burrows-Wheeler transform and a wavelet matrix with popcount ranks: an
FM-index.  Each segment is streamed through it by backward search; from an end the match is
extended leftwards as long as the suffix-array interval stands for two occurrences or more (equal
segments count as often as they occur).  These matching statistics give the intervals of
35 words or more that repeat.  Words are compared as themselves there, so that the result does
not rest on hashes.

*Hot minimisers.*  A minimiser with more than ``HOT`` different segments (a
passage in very many different surroundings) has its segments cut into single windows, which are dealt by
the hash of the window, so that no shard depends on how often a passage occurs.

Null texts have no words.  Repeated rows are documents of their own and repeat each
other, also under one id or none.  Texts of fewer than 35 words stay whole; very long ones are read whole.  An empty table gives
no rows.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import staged

WINDOW = 35
GRAM = 8
HOT = 20_000
SHARD_BYTES = 6 << 20
_TABLE = tx.byte_table()


class Segments(NamedTuple):
    first: np.ndarray  # first window's first word
    last: np.ndarray  # last window's first word
    key: np.ndarray  # minimiser hash
    doc: np.ndarray  # row in the chunk


def segments(w: tx.Words) -> Segments:
    """Segments of the texts of a chunk; word places count through the chunk."""
    n_docs = len(w.first) - 1
    grams = tx.windows(w.hash, GRAM)
    reach = WINDOW - GRAM + 1
    count = len(w.hash) - WINDOW + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return Segments(none, none, np.zeros(0, np.uint64), none)
    value, place, width = grams, np.arange(len(grams)), 1
    while width < reach:
        step = min(width, reach - width)
        n = len(value) - step
        right = value[step : step + n] < value[:n]
        place = np.where(right, place[step : step + n], place[:n])
        value = np.where(right, value[step : step + n], value[:n])
        width += step
    doc = np.searchsorted(w.first, np.arange(count), side="right") - 1
    ok = np.arange(count) + WINDOW <= w.first[np.minimum(doc + 1, n_docs)]
    at = np.flatnonzero(ok)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Segments(none, none, np.zeros(0, np.uint64), none)
    new = np.concatenate([[True], (np.diff(at) != 1) | (place[at[1:]] != place[at[:-1]])])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(at)]]) - 1
    return Segments(at[begin], at[end], grams[place[at[begin]]], doc[at[begin]])


class WaveletMatrix:
    """Ranks of symbols in a sequence, for arrays of queries at once."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.levels = len(symbols), max(1, int(sigma - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))[:-1]]).astype(np.int32)
            self.bits.append(packed)
            self.before.append(ones)
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.start = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][word] + np.bitwise_count(self.bits[k][word] & below)
            up = (symbol >> (self.levels - 1 - k)) & 1 == 1
            at = np.where(up, self.zeros[k] + ones, at - ones).astype(np.int64)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in front of each place."""
        return self._walk(symbol, at) - self.start[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes not yet told apart are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    heads = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    start = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = start
    step = 1
    while True:
        group_end = np.concatenate([heads[1:], [True]])
        open_ = np.flatnonzero(~(heads & group_end))
        if not len(open_):
            return order
        suffixes = order[open_]
        second = rank[np.minimum(suffixes + step, n)]
        by = np.lexsort((second, start[open_]))
        order[open_] = suffixes[by]
        g, s = start[open_], second[by]
        differs = np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])])
        heads[open_] = differs
        start = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
        rank[order[open_]] = start[open_]
        step *= 2


class FMIndex:
    """Over segments of words, each counted ``weight`` times."""

    def __init__(self, words: np.ndarray, first: np.ndarray, weight: np.ndarray, sigma: int):
        """words: numbers from 1 to sigma - 1; first: bounds of the segments."""
        m, n = len(first) - 1, len(words)
        owner = np.repeat(np.arange(m), np.diff(first))
        text = np.empty(n + m, np.int64)
        text[np.arange(n) + owner] = words + m  # separators are smaller than words and differ
        text[first[1:] + np.arange(m)] = np.arange(m)
        order = suffix_order(text)
        before = text[order - 1]
        self.matrix = WaveletMatrix(np.where(before < m, 0, before - m), sigma)
        counts = np.bincount(words, minlength=sigma)
        counts[0] = m
        self.below = np.concatenate([[0], np.cumsum(counts)])
        owners = np.searchsorted(first[1:] + np.arange(m), order)
        self.weights = np.concatenate([[0], np.cumsum(weight[owners])])
        self.word_weight = np.bincount(words, weights=weight[owner], minlength=sigma)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for each (symbol, interval)."""
        return self.below[symbol] + self.matrix.rank(symbol, low), self.below[symbol] + self.matrix.rank(symbol, high)

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weights[high] - self.weights[low]


def repeated(texts: list[bytes], weight: np.ndarray) -> list[list[int]]:
    """For each segment the runs of repeated windows as [first, last, first, last, ...] window places."""
    numbers: dict[bytes, int] = {}
    parts = [np.fromiter((numbers.setdefault(x, len(numbers) + 1) for x in t.split(b" ")), np.int64) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    words = np.concatenate(parts)
    sigma = len(numbers) + 1
    index = FMIndex(words, first, weight, sigma)
    # A word that occurs once in the shard ends every match: stretches between such words are searched.
    single = index.word_weight[words] < 2
    single_at = np.flatnonzero(single)
    bounds = np.unique(np.concatenate([first, single_at, single_at + 1]))
    low_end, high_end = bounds[:-1], bounds[1:]
    keep = (high_end - low_end >= WINDOW) & ~single[low_end]
    floor, end = low_end[keep], high_end[keep].copy()
    flags = np.zeros(len(words) + 1, np.int64)
    n = len(index.weights) - 1
    while len(end):
        place = end.copy()
        low, high = np.zeros(len(end), np.int64), np.full(len(end), n, np.int64)
        active = np.arange(len(end))
        while len(active):
            lo, hi = index.extend(words[place[active] - 1], low[active], high[active])
            good = index.occurrences(lo, hi) >= 2
            active, lo, hi = active[good], lo[good], hi[good]
            low[active], high[active] = lo, hi
            place[active] -= 1
            active = active[place[active] > floor[active]]
        long = end - place >= WINDOW
        np.add.at(flags, place[long], 1)
        np.subtract.at(flags, end[long] - WINDOW + 1, 1)
        end = np.where(long, place + WINDOW - 1, end - 1)
        more = end - floor >= WINDOW
        floor, end = floor[more], end[more]
    hit = np.concatenate([[False], np.cumsum(flags[:-1]) > 0, [False]])
    begin, stop = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
    out: list[list[int]] = [[] for _ in texts]
    for s, b, z in zip(np.searchsorted(first, begin, side="right") - 1, begin, stop, strict=True):
        out[s] += [int(b - first[s]), int(z - 1 - first[s])]
    return out


def _keys(docs: DataFrame) -> DataFrame:
    """(uid, keys): the minimisers of each text's segments, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in tx.tokenise(batch.column(1), _TABLE):
                s = segments(w)
                n = len(w.first) - 1
                bounds = np.searchsorted(s.doc, np.arange(n + 1))
                keys = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(s.key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.row, n), keys], names=["uid", "keys"])

    return docs.select("uid", F.col("text").cast("binary").alias("text")).mapInArrow(run, "uid long, keys array<long>")


_SEGMENT = "digest binary, key long, uid long, first int, body binary"
_KINDS = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], names=["digest", "key", "uid", "first", "body"])


def _cut(chosen: DataFrame) -> DataFrame:
    """(digest, key, uid, first, body) of the segments that ``places`` names in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, chosen_at = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for w in tx.tokenise(batch.column(1), _TABLE):
                s = segments(w)
                bounds = np.searchsorted(s.doc, np.arange(len(w.first)))
                raw = w.data.tobytes()
                rows: list[tuple] = []
                for i in range(len(w.first) - 1):
                    base = w.first[i]
                    here = slice(base, w.first[i + 1])
                    text = [raw[a:b] for a, b in zip(w.start[here].tolist(), w.end[here].tolist(), strict=True)]
                    for k in chosen_at[w.row + i]:
                        j = bounds[i] + k
                        a, z = int(s.first[j] - base), int(s.last[j] - base)
                        body = b" ".join(text[a : z + WINDOW])
                        rows.append((xxhash.xxh3_128_digest(body), int(s.key[j].view(np.int64)), uids[w.row + i], a, body))
                yield _batch(rows)

    return chosen.select("uid", F.col("text").cast("binary").alias("text"), "places").mapInArrow(run, _SEGMENT)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment as its single windows, keyed by their content."""
    for batch in batches:
        rows = []
        for uid, first, body in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
            words = body.as_buffer().to_pybytes().split(b" ")
            for p in range(len(words) - WINDOW + 1):
                part = b" ".join(words[p : p + WINDOW])
                digest = xxhash.xxh3_128_digest(part)
                rows.append((digest, int.from_bytes(digest[:8], "big", signed=True), uid, first + p, part))
        yield _batch(rows)


def _without_hot(cut: DataFrame) -> DataFrame:
    """``cut`` with the segments of minimisers that have more than HOT different segments as windows."""
    hot = staged(cut.select("digest", "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"), "fm-hot")
    if not hot.limit(1).count():
        return cut
    split = cut.join(hot, "key", "left_semi").select("digest", "key", "uid", "first", "body").mapInArrow(_windows, _SEGMENT)
    return staged(cut.join(hot, "key", "left_anti").select(*split.columns).unionByName(split), "fm-split")


def _search(table: pa.Table) -> pa.Table:
    runs = repeated(table.column("body").to_pylist(), np.array(table.column("n").to_pylist(), dtype=np.int64))
    got = [i for i, r in enumerate(runs) if r]
    return pa.table({"digest": table.column("digest").take(pa.array(got, pa.int64())), "runs": pa.array([runs[i] for i in got], pa.list_(pa.int32()))})


def intervals(docs: DataFrame) -> DataFrame:
    """(uid, runs) of texts with repeated windows.  docs: (uid, text), uids differ."""
    keys = staged(_keys(docs), "fm-keys")
    rows = keys.select("uid", F.posexplode("keys").alias("place", "key"))
    # Written first: a join with a plain table can split the rows of a hot minimiser over tasks.
    several = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "fm-several")
    chosen = rows.join(several, "key", "left_semi").groupBy("uid").agg(F.sort_array(F.collect_list("place")).alias("places"))
    chosen = staged(chosen, "fm-chosen")
    cut = _without_hot(staged(_cut(docs.join(chosen, "uid")), "fm-segments"))
    counted = cut.groupBy("digest").agg(F.first("key").alias("key"), F.first("body").alias("body"), F.count(F.lit(1)).alias("n"))
    size = cut.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(1, -(-int(size) // SHARD_BYTES))
    found = counted.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(_search, "digest binary, runs array<int>")
    found = staged(found, "fm-runs")
    placed = cut.select("digest", "uid", "first").join(found, "digest")
    shifted = F.transform("runs", lambda x: x + F.col("first"))
    return staged(placed.select("uid", shifted.alias("runs")).groupBy("uid").agg(F.flatten(F.collect_list("runs")).alias("runs")), "fm-intervals")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by blanks), one row a document."""
    base = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    ids = base.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.max(F.col("doc_id").isNull().cast("int"))).first()
    if (ids[0] or 1) > 1 or ids[1]:
        base = staged(base.withColumn("uid", F.monotonically_increasing_id()), "fm-rows")
    else:
        base = base.withColumn("uid", F.col("doc_id").cast("long"))
    found = intervals(base.select("uid", "text"))
    both = base.join(found, "uid", "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n_words.append(len(words))
                if runs:
                    gone = np.zeros(len(words) + 1, np.int64)
                    pairs = np.array(runs, dtype=np.int64).reshape(-1, 2)
                    np.add.at(gone, pairs[:, 0], 1)
                    np.subtract.at(gone, np.minimum(pairs[:, 1] + WINDOW, len(words)), 1)
                    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    words = [words[i] for i in stay]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

