"""Benchmark decontamination with suffix arrays over the training texts.

Each batch of documents is a shard with a suffix array of its own: its words become
numbers of the benchmark's vocabulary (others break a match), and the suffixes
that can begin a match (a run of benchmark word pairs as long as the shortest
window) are sorted to the depth of a window.  Every benchmark window, a suffix of
an item cut at 13 words, or a whole item of fewer, is then searched by bisection;
its interval of the array holds all its places in the shard.  Windows found at
consecutive places of document and item join to the longest verbatim matches.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text, made one at a time from rows
that a hash deals to them.  With more than one block, a filter first: one pass over all documents looks up the
hash of each window in a bit table of all benchmark windows (``FILTER_BITS`` at most), and only
documents with a hit, which are written, are searched, once a block.  Driver and workers hold one block at a
time, so that no size of the benchmark asks for more memory.

The stage of the pipeline removes each document with 13 consecutive words of an item, however long its
text, and what the report calls ``contaminated``: hits on a share of the words.  So an item of fewer words, which may
be a common phrase, removes only documents of which it is such a share.

Null texts have no words.  Items without words or with a null id match nothing.
Rows of an item id that repeats are one item.  An empty benchmark leaves all
documents clean.  Repeated document rows are judged row by row.  Very long texts are
read whole.  Rows travel packed in one column, so their columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .scratch import staged

WINDOW = 13
PERCENT = 5
BLOCK_BYTES = 8 << 20
FILTER_BITS = 1 << 28  # 32 MB
_PAGE = 1 << 16
_TABLE = tx.byte_table(lower=True, alnum=True)


class Block(NamedTuple):
    """Benchmark windows: rows of vocabulary numbers, padded with 0."""

    vocabulary: np.ndarray  # sorted hashes; number = place + 1
    pairs: np.ndarray  # sorted codes of word pairs
    windows: np.ndarray  # (m, WINDOW) int32
    length: np.ndarray  # (m,) words of the window
    item: np.ndarray  # (m,) index in ids
    place: np.ndarray  # (m,) first word in the item
    ids: list[str]


def block(items: list[tuple[object, bytes]]) -> Block:
    ids = sorted({str(k) for k, _ in items if k is not None})
    index = {k: i for i, k in enumerate(ids)}
    column = pa.array([t or b"" for _, t in items], pa.large_binary())
    words = [w.hash[a:b] for w in tx.tokenise(column, _TABLE) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    vocabulary = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
    rows, length, item, place, pairs = [], [], [], [], [np.zeros(0, np.int64)]
    for (key, _), hashes in zip(items, words, strict=True):
        if key is None or not len(hashes):
            continue
        n = (np.searchsorted(vocabulary, hashes) + 1).astype(np.int32)
        size = min(WINDOW, len(n))
        view = np.lib.stride_tricks.sliding_window_view(n, size)
        rows.append(np.pad(view, ((0, 0), (0, WINDOW - size))))
        length.append(np.full(len(view), size))
        item.append(np.full(len(view), index[str(key)]))
        place.append(np.arange(len(view)))
        pairs.append(n[:-1].astype(np.int64) * (len(vocabulary) + 1) + n[1:])
    empty = np.zeros(0, np.int64)
    return Block(vocabulary, np.unique(np.concatenate(pairs)), np.concatenate([*rows, np.zeros((0, WINDOW), np.int32)]), np.concatenate([*length, empty]), np.concatenate([*item, empty]), np.concatenate([*place, empty]), ids)


def _member(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return at, (sorted_values[at] == x) if len(sorted_values) else np.zeros(len(x), bool)


def suffix_array(numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in order, their first WINDOW numbers): the suffixes at ``starts``, sorted."""
    padded = np.concatenate([numbers, np.zeros(WINDOW, np.int32)])
    heads = padded[starts[:, None] + np.arange(WINDOW)]
    dead = np.cumsum(heads == 0, axis=1) > 0  # nothing matches beyond an unknown word
    heads[dead] = 0
    order = np.lexsort(heads.T[::-1])
    return starts[order], heads[order]


def _bound(heads: np.ndarray, windows: np.ndarray, mask: np.ndarray, after: bool) -> np.ndarray:
    """For each window the first row of ``heads`` that is not below it (after: that is above it), as far as it goes."""
    low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(heads), np.int64)
    every = np.arange(len(windows))
    while (low < high).any():
        middle = (low + high) // 2
        part = heads[np.minimum(middle, len(heads) - 1)] - windows
        part[mask] = 0
        first = np.argmax(part != 0, axis=1)
        sign = part[every, first]
        right = ((sign < 0) | (after & (sign == 0))) & (low < high)
        low = np.where(right, middle + 1, low)
        high = np.where(right, high, np.minimum(high, np.maximum(middle, low)))
    return low


def search(b: Block, numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of each occurrence.  numbers: words of a shard; ends: where the row of each word ends."""
    none = np.zeros(0, np.int64)
    if not len(b.windows) or not len(numbers):
        return none, none
    shortest = int(b.length.min())
    alive = numbers > 0
    if shortest > 1:
        two = np.flatnonzero(alive[:-1] & alive[1:] & (ends[:-1] == ends[1:]))
        _, ok = _member(b.pairs, numbers[two].astype(np.int64) * (len(b.vocabulary) + 1) + numbers[two + 1])
        pair = np.zeros(len(numbers), bool)
        pair[two[ok]] = True
        # Words after which the chain of known pairs goes on for shortest - 1 pairs.
        breaks = np.flatnonzero(~pair)
        known = np.flatnonzero(pair)
        starts = known[breaks[np.searchsorted(breaks, known)] - known >= shortest - 1]
    else:
        starts = np.flatnonzero(alive)
    if not len(starts):
        return none, none
    # Rows are kept apart by a gap of unknown words behind each: places are spread.
    row = np.cumsum(np.concatenate([[0], (ends[1:] != ends[:-1]).astype(np.int64)]))
    spread = np.zeros(len(numbers) + int(row[-1] + 1) * 1, np.int32)
    spread[np.arange(len(numbers)) + row] = numbers
    places, heads = suffix_array(spread, starts + row[starts])
    mask = np.arange(WINDOW) >= b.length[:, None]
    low, high = _bound(heads, b.windows, mask, False), _bound(heads, b.windows, mask, True)
    n = high - low
    window = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    spots = places[at]
    back = np.zeros(len(spread), np.int64)
    back[np.arange(len(numbers)) + row] = np.arange(len(numbers))
    return window, back[spots]


class Found(NamedTuple):
    n_words: int
    start: list[int]  # spans of hit words
    end: list[int]
    items: list[str]
    longest: int


def shard(b: Block, column: pa.Array) -> list[Found]:
    """What is found in each text of a batch, which is one shard."""
    parts, counts, base = [], [], 0
    for w in tx.tokenise(column, _TABLE):
        at, ok = _member(b.vocabulary, w.hash)
        parts.append(np.where(ok, at + 1, 0).astype(np.int32))
        counts.append(np.diff(w.first))
        base += len(w.hash)
    numbers = np.concatenate([*parts, np.zeros(0, np.int32)])
    count = np.concatenate([*counts, np.zeros(0, np.int64)])
    last = np.cumsum(count)
    window, place = search(b, numbers, np.repeat(last, count))
    length, item = b.length[window], b.item[window]
    row = np.searchsorted(last, place, side="right")
    out = [Found(int(n), [], [], [], 0) for n in count]
    if not len(window):
        return out
    cover = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(cover, place, 1)
    np.subtract.at(cover, place + length, 1)
    hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
    begin, end = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
    # A run of hit words may pass a row's end only where two rows are hit there: cut it.
    diagonal = place - b.place[window]
    order = np.lexsort((place, diagonal, item, row))
    r, i, d, p, size = row[order], item[order], diagonal[order], place[order], length[order]
    once = np.concatenate([[True], (r[1:] != r[:-1]) | (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1])])
    r, i, d, p, size = r[once], i[once], d[once], p[once], size[once]  # rows of an item may repeat
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)])
    run = np.cumsum(new) - 1
    lengths = np.bincount(run) - 1 + size[new]
    longest = np.zeros(len(count), np.int64)
    np.maximum.at(longest, r[new], lengths)
    first = last - count
    both = np.unique(row * np.int64(len(b.ids)) + item)
    names: dict[int, list[str]] = {}
    for k in both:
        names.setdefault(int(k) // len(b.ids), []).append(b.ids[int(k) % len(b.ids)])
    for k in names:
        a = np.searchsorted(end, first[k], side="right")
        z = np.searchsorted(begin, last[k], side="left")
        out[k] = Found(int(count[k]), [int(max(x, first[k]) - first[k]) for x in begin[a:z]], [int(min(x, last[k]) - first[k]) for x in end[a:z]], names[k], int(longest[k]))
    return out


def _sized(items: DataFrame, text: str) -> tuple[DataFrame, int, int]:
    """(item rows, their bytes, blocks of them)."""
    sized = items.select(F.col("item_id").cast("string").alias("k"), F.col(text).cast("binary").alias("t")).where("k IS NOT NULL")
    total = int(sized.agg(F.sum(F.length("t") + 16)).first()[0] or 0)
    return sized, total, max(1, -(-total // BLOCK_BYTES))


def _blocks(sized: DataFrame, n: int) -> Iterator[Block]:
    """Benchmark blocks, one at a time on the driver; rows of an item share a block."""
    for i in range(n):
        part = sized if n == 1 else sized.where(F.pmod(F.xxhash64("k"), F.lit(n)) == i)
        yield block([(k, bytes(t) if t is not None else b"") for k, t in part.toLocalIterator()])


def _places(hashes: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Places in the bit table of each window of ``size`` words."""
    return (tx.windows(hashes, size) % np.uint64(bits)).astype(np.int64)


def _filter(sized: DataFrame, total: int) -> tuple[np.ndarray, list[int]]:
    """A bit for the hash of each benchmark window, and the lengths of windows that occur."""
    bits = min(FILTER_BITS, 1 << max(16, (4 * total).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in tx.tokenise(batch.column(0), _TABLE):
                found, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                    if b > a:
                        found.append(_places(w.hash[a:b], min(WINDOW, b - a), bits))
                        sizes.append(np.full(len(found[-1]), min(WINDOW, b - a)))
                place, size = np.concatenate(found), np.concatenate(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(size.astype(np.int32))], names=["place", "size"])

    windows = staged(sized.select("t").mapInArrow(run, "place long, size int"), "decontam-windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # WINDOW at most

    def page(group: pa.Table) -> pa.Table:
        own = np.zeros(_PAGE, bool)
        own[group.column("place").to_numpy() % _PAGE] = True
        return pa.table({"page": pa.array([group.column("place")[0].as_py() // _PAGE], pa.int64()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    # Pages of the table come back, not windows: its size bounds them.
    pages = windows.select("place").distinct().groupBy(F.floor(F.col("place") / _PAGE).alias("g")).applyInArrow(page, "page long, bits binary")
    table = np.zeros(bits // 8, np.uint8)
    for number, part in pages.toLocalIterator():
        table[number * _PAGE // 8 :][: _PAGE // 8] = np.frombuffer(bytes(part), np.uint8)
    return table, sizes


def _suspects(packed: DataFrame, table: np.ndarray, sizes: list[int]) -> DataFrame:
    """``packed`` with n_words and suspect: whether any window of the text has its bit set."""
    shared = packed.sparkSession.sparkContext.broadcast(table)
    at = packed.columns.index("body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            n_words, suspect = [], []
            for w in tx.tokenise(batch.column(at), _TABLE):
                hit = np.zeros(len(w.hash) + 1, bool)
                row_end = np.repeat(w.first[1:], np.diff(w.first))
                for size in sizes:
                    place = _places(w.hash, size, 8 * len(bits))
                    inside = np.arange(len(place)) + size <= row_end[: len(place)]
                    hit[: len(place)] |= inside & ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1)
                upto = np.concatenate([[0], np.cumsum(hit[:-1])])
                n_words.append(np.diff(w.first))
                suspect.append(upto[w.first[1:]] > upto[w.first[:-1]])
            columns = [pa.array(np.concatenate([*n_words, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(np.concatenate([*suspect, np.zeros(0, bool)]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "n_words", "suspect"])

    schema = T.StructType([*packed.schema, T.StructField("n_words", T.LongType()), T.StructField("suspect", T.BooleanType())])
    return packed.mapInArrow(run, schema)


def _joined(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap made one."""

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["first"].alias("first"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (last["stop"] >= s["first"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast(_SPAN), add)


_SPAN = "array<struct<first:bigint,stop:bigint>>"


def found(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """``docs`` packed in ``row``, and n_words, spans (first, stop), items, longest for each row."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("binary").alias("body"))
    sized, total, n = _sized(items, item_text)
    if n == 1:
        return _pass(packed, next(_blocks(sized, 1)))
    packed = staged(_suspects(packed, *_filter(sized, total)).withColumn("uid", F.monotonically_increasing_id()), "decontam-rows")
    suspects = packed.where("suspect").select("uid", "body")
    whole = None
    for b in _blocks(sized, n):
        part = staged(_pass(suspects, b).where(F.size("items") > 0).drop("n_words"), "decontam-found")
        whole = part if whole is None else whole.unionByName(part)
    merged = whole.groupBy("uid").agg(_joined(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
    return packed.drop("body", "suspect").join(merged, "uid", "left").select(
        "row", "n_words", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("longest", F.lit(0).cast("long")).alias("longest")
    )


def _pass(packed: DataFrame, b: Block) -> DataFrame:
    """The columns of ``packed`` but ``body``, and what block ``b`` has in it."""
    shared = packed.sparkSession.sparkContext.broadcast(b)
    fields = [f for f in packed.schema if f.name != "body"]
    names, at = [f.name for f in fields], packed.columns.index("body")
    spans = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
    schema = packed.drop("body").schema
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("stop", T.LongType())])
    for n, kind in (("n_words", T.LongType()), ("spans", T.ArrayType(span)), ("items", T.ArrayType(T.StringType())), ("longest", T.LongType())):
        schema = schema.add(n, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            got = shard(own, batch.column(at))
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            extra = [pa.array([g.n_words for g in got], pa.int64()), pa.array([[{"first": a, "stop": z} for a, z in zip(g.start, g.end, strict=True)] for g in got], spans), pa.array([g.items for g in got], pa.list_(pa.string())), pa.array([g.longest for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, *extra], names=[*names, "n_words", "spans", "items", "longest"])

    return packed.mapInArrow(run, schema)


def judged(df: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``found`` rows with n_hit (words in spans, which don't overlap) and contaminated."""
    zero = F.lit(0).cast("long")
    df = df.withColumn("n_hit", F.aggregate("spans", zero, lambda n, s: n + s["stop"] - s["first"]))
    return df.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * F.lit(100 // percent) >= F.col("n_words")))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row a document: counts, digest of the items found, verdict, longest verbatim match in words, and the places of
    the hit words (``hit_spans``: first-stop, counted from 0, stop excluded)."""
    df = judged(found(docs.select("doc_id", "text"), items))
    places = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"], s["stop"])), ",")
    return df.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.col("longest").alias("longest_match"), places.alias("hit_spans"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated and have no ``WINDOW`` consecutive words of an item, all columns."""
    return judged(found(docs, items)).where(~F.col("contaminated") & (F.col("longest") < WINDOW)).select("row.*")
