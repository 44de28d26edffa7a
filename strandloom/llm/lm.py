"""Scores of a gated recurrent language model.

*Corpus counts.*  Each batch of documents is a block: its distinct words (64-bit hashes), how often
each stands in training rows, and in which documents, cut in hash ranges.  A range
meets in one task, which adds up the counts and sends each block its own words' back; ranges are
sized by the input.  Words of all documents are counted, and a frequent word is one entry a block.

*Model.*  The most frequent training words (the head) are dealt to classes by rank; all other
words belong to tail classes by their form (length, script, digits).  A gated recurrent
unit reads the words; its state gives a softmax over classes, and within a head class
one over words.  Within a tail class a word has its smoothed share of the class's training
count, one share being that of all unseen words.  The model is so a distribution over the training words and
one unknown word a tail class.

*Training.*  Truncated backpropagation in NumPy over windows of 32 words, state carried on and reset at
the ends of texts.  All training texts are read whole, at every size: a seeded hash deals them to workers of about
``WORKER_TOKENS`` words, whose number grows with the corpus.
The first words of one worker warm up the model; all workers then go on from there on all their own texts, and their
weights are averaged, in two levels.

Each text is turned into numbers once, in a written table that training and scoring both read.

*Scoring.*  Whole texts, one behind the other in many lanes, in windows between which the state is carried.

Null texts are empty: one end token.  Repeated rows count and are scored one by one.  Where ids repeat or are
null, rows are told apart by a number of their own, and which worker a text trains depends on it: the score may then differ
slightly with the partitions, the counts and the base score do not.  Without
training rows all counts are 0 and the model stays at its start.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .folds import fold
from .scratch import staged

FOLDS, HELD_OUT = 7, 2
HEAD, CLASSES, EMBED, HIDDEN = 2048, 46, 24, 24
TAILS = 24
RANGE_BYTES = 16 << 20  # of text for each hash range
WORKER_TOKENS = 1_800_000
WARM_TOKENS, WARM_LANES = 300_000, 64  # the warm-up, which all workers wait for
LANES, STEPS, RATE = 256, 32, 0.15
SCORE_LANES = 256
SCORE_WORDS = 4_000_000  # scored at a time, or one text
_TABLE = tx.byte_table(lower=True)
_END = np.uint64(0x2B992DDFA23249D6)  # the end token's code

_FORM = np.zeros(256, np.uint8)  # 1: beyond ASCII, 2: neither that nor a letter
_FORM[:] = 2
_FORM[97:123] = 0
_FORM[128:] = 1
_FORM[0x20] = 0  # blanks behind a word don't count
_LENGTHS = np.array([3, 5, 7, 9, 11, 14, 19])


def tails(w: tx.Words) -> np.ndarray:
    """The tail class of each word by its form."""
    if not len(w.start):
        return np.zeros(0, np.uint8)
    kind = np.maximum.reduceat(_FORM[w.data], w.start)
    return (np.searchsorted(_LENGTHS, w.end - w.start, side="right") * 3 + kind).astype(np.uint8)


class Block(NamedTuple):
    """Tokens of a batch, the end tokens included: code, tail class, text; ``bounds`` of texts."""

    code: np.ndarray
    tail: np.ndarray
    bounds: np.ndarray


def block(column: pa.Array) -> Block:
    codes, kinds, counts = [], [], []
    for w in tx.tokenise(column, _TABLE):
        n = np.diff(w.first)
        at = w.first[1:]  # an end token behind each text's words
        codes.append(np.insert(w.hash, at, _END))
        kinds.append(np.insert(tails(w), at, 0))
        counts.append(n + 1)
    count = np.concatenate([*counts, np.zeros(0, np.int64)])
    return Block(np.concatenate([*codes, np.zeros(0, np.uint64)]), np.concatenate([*kinds, np.zeros(0, np.uint8)]), np.concatenate([[0], np.cumsum(count)]))


_COUNTED = "part int, block long, uids binary, codes binary, kinds binary, train binary, first binary, texts binary, times binary"


def _count_blocks(docs: DataFrame, parts: int) -> DataFrame:
    """One row a block and hash range, and one (part -1) with the block's texts."""
    shift = np.uint64(64 - max(1, (parts - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low in range(0, max(len(batch), 1), 60_000):
                piece = batch.slice(low, 60_000)
                b = block(piece.column(2))
                texts = np.repeat(np.arange(len(piece), dtype=np.int64), np.diff(b.bounds))
                trains = np.asarray(piece.column(1).to_numpy(zero_copy_only=False), bool)
                word, inverse = np.unique(b.code, return_inverse=True)
                kind = np.zeros(len(word), np.uint8)
                kind[inverse] = b.tail
                train = np.bincount(inverse[trains[texts]], minlength=len(word)).astype(np.uint32)
                pair, times = np.unique(inverse.astype(np.int64) * (1 << 16) + texts, return_counts=True)
                over = np.maximum(1, -(-times // 255))
                pair, left = np.repeat(pair, over), np.repeat(times, over)
                place = np.arange(len(pair)) - np.repeat(np.cumsum(over) - over, over)
                times = np.minimum(255, left - 255 * place).astype(np.uint8)
                first = np.searchsorted(pair >> 16, np.arange(len(word) + 1)).astype(np.uint32)
                part = (word >> shift).astype(np.int64) if parts > 1 else np.zeros(len(word), np.int64)
                starts = np.searchsorted(part, np.arange(parts + 1))
                uids = np.asarray(piece.column(0).to_numpy(zero_copy_only=False), np.int64)
                rows = [(-1, number, np.concatenate([uids, np.diff(b.bounds)]).tobytes(), b"", b"", b"", b"", b"", b"")]
                for p in np.flatnonzero(np.diff(starts)):
                    s, e = starts[p], starts[p + 1]
                    f = first[s : e + 1]
                    rows.append((int(p), number, b"", word[s:e].tobytes(), kind[s:e].tobytes(), train[s:e].tobytes(), (f - f[0]).tobytes(), (pair[f[0] : f[-1]] & 0xFFFF).astype(np.uint16).tobytes(), times[f[0] : f[-1]].tobytes()))
                number += 1
                kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 7)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _COUNTED.split(", ")])

    return docs.select("uid", "trains", "body").mapInArrow(run, _COUNTED)


def _sum_range(table: pa.Table) -> pa.Table:
    """Counts of a hash range, back to each block; and the range's own figures (block -1)."""
    codes = [np.frombuffer(x, np.uint64) for x in table.column("codes").to_pylist()]
    train = [np.frombuffer(x, np.uint32) for x in table.column("train").to_pylist()]
    kinds = [np.frombuffer(x, np.uint8) for x in table.column("kinds").to_pylist()]
    word, first, inverse = np.unique(np.concatenate(codes), return_index=True, return_inverse=True)
    count = np.bincount(inverse, weights=np.concatenate(train), minlength=len(word)).astype(np.int64)
    kind = np.concatenate(kinds)[first]
    bounds = np.cumsum([0, *map(len, codes)])
    top = np.lexsort((word, -count))[: HEAD + 1]
    top = top[count[top] > 0]
    mass = np.bincount(kind[count > 0], weights=(count + 1)[count > 0].astype(float), minlength=TAILS)
    figures = np.concatenate([[count.sum(), (count > 0).sum()], mass]).astype(np.float64).tobytes()
    part = table.column("part")[0].as_py()
    blocks = table.column("block").to_pylist()
    counts = [count[inverse[bounds[i] : bounds[i + 1]]].astype(np.uint64).tobytes() for i in range(len(codes))]
    n = len(blocks)
    return pa.table(
        {
            "part": pa.array([part] * (n + 1), pa.int32()),
            "block": pa.array([-1, *blocks], pa.int64()),
            "counts": pa.array([figures, *counts], pa.binary()),
            "codes": pa.array([word[top].tobytes(), *[None] * n], pa.binary()),
            "kinds": pa.array([kind[top].tobytes(), *[None] * n], pa.binary()),
            "tops": pa.array([count[top].tobytes(), *[None] * n], pa.binary()),
        }
    )


class Vocabulary(NamedTuple):
    """Head words by hash, and what else the corpus counts give."""

    codes: np.ndarray  # sorted
    number: np.ndarray  # rank by frequency of each of codes
    counts: np.ndarray  # by rank
    mass: np.ndarray  # of the tail classes, without head words
    tokens: int
    words: int

    def ids(self, code: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Head words by rank, others HEAD + tail class."""
        out = HEAD + tail.astype(np.int32)
        if len(self.codes):
            # Codes are hashes: hardly two head words begin with the same 16 bits, and only for those that do is there a search.
            begin = (code >> np.uint64(48)).astype(np.uint16)
            head = (self.codes >> np.uint64(48)).astype(np.uint16)
            shared = np.bincount(head, minlength=1 << 16) > 1
            at = np.searchsorted(head, np.arange(1 << 16)).astype(np.int32)
            at[at == len(head)] = 0
            at = at[begin]
            more = np.flatnonzero(shared[begin])
            at[more] = np.minimum(np.searchsorted(self.codes, code[more]), len(head) - 1)
            out = np.where(self.codes[at] == code, self.number[at], out)
        return out


def _vocabulary(sums: DataFrame) -> Vocabulary:
    """From each range's figures: at most HEAD words a range come to the driver, in a bounded reduction."""
    own = sums.where("block = -1")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [np.frombuffer(b"".join(x.to_pylist()), t) for x, t in ((batch.column(0), np.int64), (batch.column(1), np.uint8), (batch.column(2), np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1].astype(np.int32)), pa.array(c[2])], names=["code", "kind", "n"])

    tops = own.select("codes", "kinds", "tops").mapInArrow(explode, "code long, kind int, n long")
    best = tops.orderBy(F.desc("n"), "code").limit(HEAD).collect()

    def figure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + TAILS)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total = total + np.frombuffer(x, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "x"])

    total = np.zeros(2 + TAILS)
    for i, x in own.select("counts").mapInArrow(figure, "i int, x double").groupBy("i").agg(F.sum("x")).collect():
        total[i] = x
    code = np.array([r[0] for r in best], np.int64).view(np.uint64)
    counts = np.array([r[2] for r in best], np.int64)
    mass = total[2:].copy()
    np.subtract.at(mass, np.array([r[1] for r in best], np.int64), counts + 1.0)
    order = np.argsort(code)
    return Vocabulary(code[order], order.astype(np.int32), counts, np.maximum(mass, 0) + 1.0, int(total[0]), int(total[1]))


def _text_sums(table_a: pa.Table, table_b: pa.Table, head: np.ndarray) -> pa.Table:
    """Per text of a block: tokens, known tokens, sums of log10(count + 1) over all and over tail words."""
    uids = np.frombuffer(next(x for p, x in zip(table_a.column("part").to_pylist(), table_a.column("uids").to_pylist(), strict=True) if p == -1), np.int64)
    n = len(uids) // 2
    known, every, tail = np.zeros(n), np.zeros(n), np.zeros(n)
    counts = dict(zip(table_b.column("part").to_pylist(), table_b.column("counts").to_pylist(), strict=True))
    rows = sorted(zip(table_a.column("part").to_pylist(), *[table_a.column(c).to_pylist() for c in ("codes", "first", "texts", "times")], strict=True), key=lambda r: r[0])
    for part, codes, first, texts, times in rows:
        if part == -1:
            continue
        code, start = np.frombuffer(codes, np.uint64), np.frombuffer(first, np.uint32)
        count = np.frombuffer(counts[part], np.uint64).astype(np.int64)
        text, n_times = np.frombuffer(texts, np.uint16), np.frombuffer(times, np.uint8).astype(float)
        size = np.diff(start)
        value = np.log10(count + 1.0)
        at = np.searchsorted(head, code)
        at[at == len(head)] = 0
        is_tail = head[at] != code if len(head) else np.ones(len(code), bool)
        for out, per_word in ((every, value), (tail, value * is_tail), (known, (count > 0).astype(float))):
            out += np.bincount(text, weights=n_times * np.repeat(per_word, size), minlength=n)
    return pa.table({"uid": uids[:n], "n_tokens": uids[n:], "n_known": known.round().astype(np.int64), "log_all": every, "log_tail": tail})


# --- the network -----------------------------------------------------------

_SHAPES = {"table": (HEAD + TAILS, EMBED), "inward": (EMBED, 3 * HIDDEN), "inward_b": (3 * HIDDEN,), "loop": (HIDDEN, 3 * HIDDEN), "class_w": (HIDDEN, CLASSES + TAILS), "class_b": (CLASSES + TAILS,), "word_w": (HEAD, HIDDEN), "word_b": (HEAD,)}
_SIZE = sum(math.prod(s) for s in _SHAPES.values())
_PER_CLASS = -(-HEAD // CLASSES)
Net = dict[str, np.ndarray]


def unpack(flat: np.ndarray) -> Net:
    out, at = {}, 0
    for k, shape in _SHAPES.items():
        out[k] = flat[at : at + math.prod(shape)].reshape(shape)
        at += math.prod(shape)
    return out


def start(v: Vocabulary, seed: int = 7) -> np.ndarray:
    """Small random weights, and biases at the corpus frequencies."""
    rng = np.random.default_rng(seed)
    flat = (rng.standard_normal(_SIZE) * 0.08).astype(np.float32)
    net = unpack(flat)
    counts = np.zeros(HEAD)
    counts[: len(v.counts)] = v.counts
    net["word_b"][:] = np.log(counts + 0.01)
    by_class = np.add.reduceat(counts, np.arange(0, HEAD, _PER_CLASS))
    total = np.concatenate([np.pad(by_class, (0, CLASSES - len(by_class))), v.mass])
    net["class_b"][:] = np.log((total + 0.5) / (total.sum() + 1))
    net["class_w"][:] *= 0.2
    net["word_w"][:] *= 0.2
    net["table"][:] *= 3
    net["inward"][:] *= 2
    net["inward_b"][:] = 0
    return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def _inward(net: Net, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of ids (time, lane) and a last 1, what they bring to the gates), the latter with lanes next to each other in memory."""
    drawn = np.concatenate([net["table"], np.ones((len(net["table"]), 1), np.float32)], axis=1).take(ids, axis=0)
    weights = np.concatenate([net["inward"], net["inward_b"][None]])
    return drawn, (weights.T @ drawn.transpose(0, 2, 1)).transpose(0, 2, 1)


def _by_lane(t: int, lanes: int, k: int) -> np.ndarray:
    """Empty (t, lanes, k) with lanes next to each other in memory, so that a gate of all lanes is one piece."""
    return np.empty((t, k, lanes), np.float32).transpose(0, 2, 1)


def _step(net: Net, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
    k = HIDDEN
    a = (net["loop"].T @ h.T).T
    gates = _sigmoid(x[:, : 2 * k] + a[:, : 2 * k])
    z, r = gates[:, :k], gates[:, k:]
    n = r * a[:, 2 * k :]
    n += x[:, 2 * k :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, (z, r, n, a[:, 2 * k :])


def _soften(x: np.ndarray, at: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(entries at the flat places ``at``, sums of the rows' exponentials, by which they are to be divided); x becomes its
    exponentials, in place.  No entry is beyond ``reach``, which tells whether rows are brought down to 0 first."""
    if not reach < 60:
        x -= x.max(axis=1, keepdims=True)
    own = x.reshape(-1)[at]
    np.exp(x, out=x)
    return own, x @ np.ones(x.shape[1], np.float32)


def _classes(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < HEAD, ids // _PER_CLASS, ids - HEAD + CLASSES)


def outputs(net: Net, h: np.ndarray, ids: np.ndarray, grad: Net | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probability of the class, and of the word in a head class; with ``grad``, the loss gradient by h too."""
    k = h.shape[1]
    kind = _classes(ids).astype(np.uint8)
    order = np.argsort(kind, kind="stable")
    kind = kind[order]
    cuts = np.searchsorted(kind, np.arange(CLASSES + 1))
    heads = cuts[CLASSES]  # rows of head classes; those of tail classes stand behind them
    h = np.concatenate([h, np.ones((len(h), 1), np.float32)], axis=1).take(order, axis=0)  # the last column meets the biases
    class_w = np.concatenate([net["class_w"], net["class_b"][None]])
    word_w = np.concatenate([net["word_w"], net["word_b"][:, None]], axis=1)
    most = max(1.0, float(h.max(initial=0)), -float(h.min(initial=0)))
    reach = most * np.abs(word_w).sum(axis=1)
    x = h @ class_w
    at = np.arange(len(x)) * x.shape[1] + kind
    own, total = _soften(x, at, most * float(np.abs(class_w).sum(axis=0).max()))
    out = (own - np.log(total)).astype(np.float64)
    if grad is not None:
        # With the row's sum taken off its own entry, exponentials over the sum are the gradient.
        x.reshape(-1)[at] -= total
        scale = np.float32(1) / total[:, None]
        made = (h * scale).T @ x
        grad["class_w"] += made[:k]
        grad["class_b"] += made[k]
        back = x @ net["class_w"].T
        back *= scale
        made, inner = np.zeros_like(word_w), np.empty((heads, k), np.float32)
    own, total = np.empty(heads, np.float32), np.empty(heads, np.float32)
    place = ids[order[:heads]] - kind[:heads].astype(np.int64) * _PER_CLASS  # in the class
    for c in range(CLASSES):
        a, z = cuts[c], cuts[c + 1]
        if a == z:
            continue
        low, high = c * _PER_CLASS, min(HEAD, (c + 1) * _PER_CLASS)
        x = h[a:z] @ word_w[low:high].T
        at = np.arange(0, x.size, high - low) + place[a:z]
        own[a:z], total[a:z] = _soften(x, at, reach[low:high].max())
        if grad is not None:
            x.reshape(-1)[at] -= total[a:z]
            made[low:high] = x.T @ (h[a:z] / total[a:z, None])
            np.matmul(x, net["word_w"][low:high], out=inner[a:z])
    out[:heads] += own - np.log(total)
    value = np.empty_like(out)
    value[order] = out
    if grad is None:
        return value, None
    grad["word_w"] += made[:, :k]
    grad["word_b"] += made[:, k]
    inner /= total[:, None]
    back[:heads] += inner
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return value, back.take(rank, axis=0)


def train(flat: np.ndarray, stream: np.ndarray, end: int, lanes: int = LANES, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """One pass of truncated backpropagation over a stream of ids (texts, each closed by ``end``)."""
    flat = flat.astype(np.float32).copy()
    net = unpack(flat)
    lanes = max(1, min(lanes, len(stream) // (2 * steps)))
    length = -(-len(stream) // lanes)
    if length < 2:
        return flat
    # The last lane is filled up with empty texts, so that no word is left out.
    grid = np.concatenate([stream, np.full(lanes * length - len(stream), end, stream.dtype)]).reshape(lanes, length)
    grid = np.concatenate([np.full((lanes, 1), end, grid.dtype), grid], axis=1)
    power = np.full(_SIZE, 1e-3, np.float32)
    h = np.zeros((lanes, HIDDEN), np.float32)
    k = HIDDEN
    for at in range(0, length, steps):
        x_ids, y_ids = grid[:, at : min(at + steps, length)], grid[:, at + 1 : min(at + steps, length) + 1]
        t_max = x_ids.shape[1]
        flat_grad = np.zeros(_SIZE, np.float32)
        grad = unpack(flat_grad)
        words = np.ascontiguousarray(x_ids.T)
        drawn, x = _inward(net, words)
        alive = (words != end).astype(np.float32)[:, :, None]
        states, starts = _by_lane(t_max, lanes, k), _by_lane(t_max, lanes, k)
        kept = []
        for t in range(t_max):
            np.multiply(h, alive[t], out=starts[t])
            h, saved = _step(net, x[t], starts[t])
            states[t] = h
            kept.append(saved)
        _, back = outputs(net, states.reshape(-1, k), y_ids.T.reshape(-1), grad)
        spread = _by_lane(t_max, lanes, k)
        spread[:] = back.reshape(t_max, lanes, k)
        dh = np.zeros((k, lanes), np.float32).T
        da, dx = _by_lane(t_max, lanes, 3 * k), x  # x is not read any more
        for t in range(t_max - 1, -1, -1):
            z, r, n, an = kept[t]
            dh += spread[t]
            rest = 1 - z
            by_z = starts[t] - n
            by_z *= z
            by_z *= rest
            np.multiply(dh, by_z, out=da[t, :, :k])
            rest *= 1 - n * n
            dn = np.multiply(dh, rest, out=dx[t, :, 2 * k :])
            np.multiply(dn, r, out=da[t, :, 2 * k :])
            by_r = 1 - r
            by_r *= da[t, :, 2 * k :]
            np.multiply(by_r, an, out=da[t, :, k : 2 * k])
            dh *= z
            dh += (net["loop"] @ da[t].T).T
            dh *= alive[t]
        dx[:, :, : 2 * k] = da[:, :, : 2 * k]
        grad["loop"] += (starts.transpose(0, 2, 1) @ da).sum(axis=0)
        made = (drawn.transpose(0, 2, 1) @ dx).sum(axis=0)
        grad["inward"] += made[:-1]
        grad["inward_b"] += made[-1]
        words = words.reshape(-1).astype(np.uint16)
        order = np.argsort(words, kind="stable")
        words = words[order]
        first = np.flatnonzero(np.diff(words, prepend=words[0] + np.uint16(1)))
        grad["table"][words[first]] += np.add.reduceat((dx @ net["inward"].T).reshape(-1, EMBED).take(order, axis=0), first)
        flat_grad /= lanes * t_max / 32
        np.clip(flat_grad, -5, 5, out=flat_grad)
        power += flat_grad * flat_grad
        flat_grad *= np.float32(rate)
        flat_grad /= np.sqrt(power)
        flat -= flat_grad
    return flat


def _lanes(size: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts dealt to lanes of about equal length: (texts lane by lane, lengths of the lanes), longest lane first."""
    lane_of, loads = np.zeros(len(size), np.int64), [(0, i) for i in range(lanes)]
    for t in np.argsort(-size, kind="stable").tolist():
        load, lane = loads[0]
        lane_of[t] = lane
        heapq.heapreplace(loads, (load + int(size[t]), lane))
    load = np.bincount(lane_of, weights=size, minlength=lanes).astype(np.int64)
    rank = np.empty(lanes, np.int64)
    rank[np.argsort(-load, kind="stable")] = np.arange(lanes)
    return np.argsort(rank[lane_of], kind="stable"), np.sort(load)[::-1]


def score(flat: np.ndarray, ids: np.ndarray, bounds: np.ndarray, end: int, tail_log: np.ndarray, lanes: int = SCORE_LANES, steps: int = STEPS) -> np.ndarray:
    """Log10-probability of each text, but for the tail words' counts: ``tail_log`` is taken off for each tail class.

    Texts stand one behind the other in lanes; the state starts anew with each text.
    """
    net = unpack(flat)
    size = np.diff(bounds)
    out = np.zeros(len(size))
    if not len(ids):
        return out
    texts, load = _lanes(size, max(1, min(lanes, len(size))))
    text = np.repeat(texts, size[texts])
    begin = np.cumsum(size[texts]) - size[texts]
    words = ids[np.arange(len(ids)) - np.repeat(begin - bounds[texts], size[texts])]
    before = np.concatenate([[end], words[:-1]])
    before[begin[size[texts] > 0]] = end
    carried = np.ones(len(ids), np.float32)
    carried[begin[size[texts] > 0]] = 0
    lane_at = np.cumsum(load) - load
    h = np.zeros((len(load), HIDDEN), np.float32)
    for at in range(0, int(load[0]), steps):
        active = int(np.searchsorted(-load, -at, side="left"))  # lanes longer than at
        left = load[:active] - at
        wide = min(steps, int(left[0]))
        inside = np.arange(wide)[:, None] < left
        places = np.minimum(lane_at[:active] + at + np.arange(wide)[:, None], len(ids) - 1)
        _, x = _inward(net, before[places])
        alive = carried[places][:, :, None]
        h = h[:active]
        states = _by_lane(wide, active, HIDDEN)
        for t in range(wide):  # lanes that have ended go on without effect
            h, _ = _step(net, x[t], h * alive[t])
            states[t] = h
        places = places[inside]
        y = words[places]
        value, _ = outputs(net, states.reshape(-1, HIDDEN)[inside.reshape(-1)], y)
        value = value / math.log(10)
        is_tail = y >= HEAD
        value[is_tail] -= tail_log[y[is_tail] - HEAD]
        out += np.bincount(text[places], weights=value, minlength=len(out))
    return out


# --- on the corpus ----------------------------------------------------------


def _average(rows: DataFrame) -> np.ndarray:
    """Mean of the workers' weights, added up in two levels.  rows: (worker, weights)."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float64) for x in table.column("weights").to_pylist()], axis=0)
        return pa.table({"worker": pa.array([table.column("worker")[0].as_py() // 32], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64())})

    while rows.count() > 32:
        rows = staged(rows.groupBy(F.floor(F.col("worker") / 32).alias("g")).applyInArrow(add, "worker long, weights binary, n long"), "lm-sums")
    found = rows.orderBy("worker").collect()
    total = np.sum([np.frombuffer(r["weights"], np.float64) for r in found], axis=0)
    return (total / sum(r["n"] for r in found)).astype(np.float32)


def _end(v: Vocabulary) -> int:
    return int(v.ids(np.array([_END]), np.zeros(1, np.uint8))[0])


def _streams(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(uid, doc_id, held_out, trains, ids, worker): each text's words by number, two bytes each, for training and scoring."""
    shared = docs.sparkSession.sparkContext.broadcast(v)
    workers = max(1, round(v.tokens / WORKER_TOKENS))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            b = block(batch.column(4))
            raw = pa.py_buffer(words.ids(b.code, b.tail).astype(np.uint16))
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer((2 * b.bounds).astype(np.int64)), raw]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], ids], names=["uid", "doc_id", "held_out", "trains", "ids"])

    kinds = docs.select("uid", "doc_id", "held_out", "trains").schema.add("ids", "binary")
    streams = docs.select("uid", "doc_id", "held_out", "trains", "body").mapInArrow(encode, kinds)
    return staged(streams.withColumn("worker", F.pmod(F.xxhash64("uid", F.lit(13)), F.lit(workers))), "lm-streams")


def _trained(streams: DataFrame, v: Vocabulary) -> np.ndarray:
    """Weights of the model, from all rows that train."""
    spark = streams.sparkSession
    first = start(v)
    if not v.tokens:
        return first
    workers = max(1, round(v.tokens / WORKER_TOKENS))
    end = _end(v)
    streams = streams.where("trains").select("uid", "ids", "worker")

    def fitter(weights: np.ndarray, lanes: int, most: int | None = None):
        base = spark.sparkContext.broadcast(weights)

        def fit(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("uid").to_numpy(), kind="stable")
            texts = table.column("ids").to_pylist()
            stream = np.frombuffer(b"".join(texts[i] for i in order), np.uint16).astype(np.int64)
            made = train(base.value, stream[:most], end, lanes=lanes)
            return pa.table({"worker": pa.array([table.column("worker")[0].as_py()], pa.int64()), "weights": pa.array([made.astype(np.float64).tobytes()], pa.binary()), "n": pa.array([1], pa.int64())})

        return fit

    kind = "worker long, weights binary, n long"
    lowest = streams.agg(F.min("worker")).first()[0]
    warm = streams.where(F.col("worker") == lowest).groupBy("worker").applyInArrow(fitter(first, WARM_LANES, WARM_TOKENS), kind).collect()
    if not warm:
        return first
    weights = np.frombuffer(warm[0]["weights"], np.float64).astype(np.float32)
    return _average(staged(streams.repartition(workers, "worker").groupBy("worker").applyInArrow(fitter(weights, LANES), kind), "lm-weights"))


def scored(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row a document."""
    spark = docs.sparkSession
    base = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col(text).cast("binary").alias("body"))
    ids = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.max(F.col("doc_id").isNull().cast("int"))).first()
    if (ids[0] or 1) > 1 or ids[1]:
        base = staged(base.withColumn("uid", F.monotonically_increasing_id()), "lm-rows")
    else:
        base = base.withColumn("uid", F.col("doc_id").cast("long"))
    rows = base.withColumn("trains", ~F.col("held_out"))
    size = base.agg(F.sum(F.length("body"))).first()[0] or 0
    parts = 1 << max(0, math.ceil(math.log2(max(1, size / RANGE_BYTES))))
    counted = staged(_count_blocks(rows, parts), "lm-blocks")
    sums = counted.where("part >= 0").select("part", "block", "codes", "kinds", "train").groupBy("part").applyInArrow(_sum_range, "part int, block long, counts binary, codes binary, kinds binary, tops binary")
    sums = staged(sums, "lm-counts")
    v = _vocabulary(sums)
    head = v.codes

    def per_text(a: pa.Table, b: pa.Table) -> pa.Table:
        return _text_sums(a, b, head)

    sides = [counted.select("part", "block", "uids", "codes", "first", "texts", "times"), sums.where("block >= 0").select("part", "block", "counts")]
    plain = sides[0].groupBy("block").cogroup(sides[1].groupBy("block")).applyInArrow(per_text, "uid long, n_tokens long, n_known long, log_all double, log_tail double")
    streams = _streams(rows, v)
    model = spark.sparkContext.broadcast((_trained(streams, v), np.log10(v.mass)))  # under 1 MB
    end = _end(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, tail_log = model.value
        for batch in batches:
            bounds, raw = tx.binary_parts(batch.column(3))
            cuts = [0, *(np.flatnonzero(np.diff((bounds[1:] - bounds[0]) // (2 * SCORE_WORDS))) + 1).tolist(), len(batch)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                ids = raw[bounds[low] : bounds[high]].view(np.uint16).astype(np.int64)
                values = score(flat, ids, (bounds[low : high + 1] - bounds[low]) // 2, end, tail_log)
                yield pa.RecordBatch.from_arrays([*[c.slice(low, high - low) for c in batch.columns[:3]], pa.array(values)], names=["uid", "doc_id", "held_out", "gated"])

    gated = streams.select("uid", "doc_id", "held_out", "ids").mapInArrow(run, streams.select("uid", "doc_id", "held_out").schema.add("gated", "double"))
    out = gated.join(plain, "uid")
    whole = math.log10(v.tokens + v.words + 1)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("log_all") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("gated") + F.col("log_tail")).alias("score"))
