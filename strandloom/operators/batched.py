"""Distances of one sequence to many at a time.

Sequences lie one behind the other in long integers, a bit a letter and at least one spare bit behind each, so that a
carry never reaches the next one.  Edit distance follows Myers' bit vectors.  Global scores for match 1, mismatch -1 and
gap -1 keep the four values of a vertical difference in unary, and two additions carry horizontal ones along runs.
Local scores need the values themselves: NumPy diagonals over all sequences of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ..functions.sequences import ALPHABET

#: Bits of a block of sequences, how many it has at most, and cells of a block of local alignments.
BLOCK_BITS, BLOCK_ROWS, LOCAL_CELLS = 1 << 15, 256, 1 << 14
RESULT_ROWS = 200_000  # pairs sent on at a time
FAR = np.iinfo(np.int64).max


def letters(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode("utf-32-le"), np.uint32)


def letter_counts(seqs: list[str]) -> np.ndarray:
    """(sequences x 5): how often each base occurs, and all other letters."""
    out = np.array([[s.count(c) for c in ALPHABET] for s in seqs], np.int32).reshape(len(seqs), len(ALPHABET))
    rest = np.array([len(s) for s in seqs], np.int32) - out.sum(1)
    return np.column_stack([out, rest])


def _integer(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


class Block:
    """Sequences of similar length; ``rows`` are their places in the list they come from."""

    def __init__(self, rows: list[int], seqs: list[str]):
        self.rows, self.seqs = np.array(rows), seqs
        self.length = np.array([len(s) for s in seqs], np.int64)
        self.counts = letter_counts(seqs)
        self._codes = self._masks = None

    def _bits(self) -> None:
        width = self.length // 8 + 1
        self.starts = np.concatenate([[0], np.cumsum(width)[:-1]])
        self.bytes = int(width.sum())
        where = np.repeat(8 * self.starts - (np.cumsum(self.length) - self.length), self.length) + np.arange(self.length.sum())
        text, used, low = letters("".join(self.seqs)), np.zeros(8 * self.bytes, bool), np.zeros(8 * self.bytes, bool)
        used[where], low[8 * self.starts] = True, True
        self.every, self.used, self.low = (1 << 8 * self.bytes) - 1, _integer(used), _integer(low)
        self._masks = {}
        for c in np.unique(text):
            mine = np.zeros(8 * self.bytes, bool)
            mine[where[text == c]] = True
            self._masks[chr(c)] = _integer(mine)

    def _ones(self, x: int) -> np.ndarray:
        """Bits set in each sequence's part."""
        return np.add.reduceat(np.bitwise_count(np.frombuffer(x.to_bytes(self.bytes, "little"), np.uint8)).astype(np.int64), self.starts)

    def edit(self, text: str) -> np.ndarray:
        if self._masks is None:
            self._bits()
        every, used, low, mask = self.every, self.used, self.low, self._masks.get
        up, down = used, 0  # where the vertical difference is 1 or -1
        for c in text:
            eq = mask(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = ((down | (every ^ (xh | up))) << 1) | low
            up, down = (((up & xh) << 1) | (every ^ (xv | ph))) & used, ph & xv
        return len(text) + self._ones(up) - self._ones(down)

    def aligned(self, text: str) -> np.ndarray:
        """Global scores; differences are kept from 0 (a gap) to 3."""
        if self._masks is None:
            self._bits()
        every, used, mask = self.every, self.used, self._masks.get
        a1 = a2 = a3 = 0  # vertical difference at least 1, 2, 3
        b1 = b2 = b3 = used  # the contrary
        for c in text:
            eq = mask(c, 0)
            seed = eq & b1
            h3 = (seed + b1) ^ b1 ^ seed  # horizontal difference above: 3, at least 2, at least 1
            top = eq | h3
            seed = top & b2
            run = seed | b1
            h2 = (seed + run) ^ run ^ seed
            h1 = (b1 | (b2 & (eq | h2)) | (b3 & top)) << 1
            n1, n2, n3 = every ^ (h1 & every), every ^ h2, every ^ h3
            best, good = eq | a3, eq | a2
            a1, a2, a3 = (n1 | (n2 & good) | (n3 & best)) & used, ((best & n2) | (a2 & n1)) & used, best & n1 & used
            b1, b2, b3 = used ^ a1, used ^ a2, used ^ a3
        return self._ones(a1) + self._ones(a2) + self._ones(a3) - len(text) - self.length

    def loose(self, text: str) -> np.ndarray:
        """Places that differ, and the longer length where lengths differ."""
        out = np.maximum(self.length, len(text))
        same = np.flatnonzero(self.length == len(text))
        if len(same) and text:
            rows = letters("".join(self.seqs[i] for i in same)).reshape(len(same), len(text))
            out[same] = (rows != letters(text)).sum(axis=1)
        return out

    def together(self) -> int:
        """How many texts fill a block of local alignments."""
        return max(1, LOCAL_CELLS // max(1, int(self.length.max(initial=0)) * len(self.seqs)))

    def local(self, texts: list[str]) -> np.ndarray:
        """(texts x sequences): local scores, by diagonals of all pairs at once; a letter is a bit of its own."""
        n, m, many = int(self.length.max(initial=0)), max(map(len, texts)), len(self.seqs) * len(texts)
        if not n or not m:
            return np.zeros((len(texts), len(self.seqs)), np.int64)
        if self._codes is None:
            known = sorted(set("".join(self.seqs)))
            kind = np.int16 if len(known) <= 13 and n < 32000 else np.int64
            if len(known) > 61:
                raise ValueError("too many different letters")
            self._known = {c: 2 << i for i, c in enumerate(known)}
            self._codes = np.zeros((n, len(self.seqs)), kind)
            for i, s in enumerate(self.seqs):
                self._codes[: len(s), i] = [self._known[c] for c in s]
        codes, kind = np.tile(self._codes, (1, len(texts))), self._codes.dtype
        turned = np.zeros((m, len(texts)), kind)
        for i, text in enumerate(texts):
            turned[m - len(text) :, i] = [self._known.get(c, 0) for c in reversed(text)]
        turned = np.repeat(turned, len(self.seqs), axis=1)
        # Row i + 1 of a diagonal is the cell of letter i; row 0 is the border.
        before, last, new = (np.zeros((n + 1, many), kind) for _ in range(3))
        best, room = np.zeros((n, many), kind), np.empty((n, many), kind)
        one, two, zero = kind.type(1), np.full((n, many), 2, kind), np.zeros((n, many), kind)  # NumPy's minimum is slow with scalars
        for t in range(n + m - 1):
            low, high = max(0, t - m + 1), min(n, t + 1)
            x, out = room[low:high], new[low + 1 : high + 1]
            np.bitwise_and(codes[low:high], turned[m - 1 - t + low : m - 1 - t + high], out=x)
            np.minimum(x, two[low:high], out=x)
            np.add(x, before[low:high], out=x)
            np.maximum(x, last[low:high], out=x)
            np.maximum(x, last[low + 1 : high + 1], out=x)
            np.subtract(x, one, out=x)
            np.maximum(x, zero[low:high], out=out)
            np.maximum(best[low:high], out, out=best[low:high])
            before, last, new = last, new, before
            new[: low + 1] = 0  # what is left of older diagonals
            new[high + 1 : high + 2] = 0
        return best.max(axis=0).astype(np.int64).reshape(len(texts), len(self.seqs))


def blocks(seqs: list[str], cells: int) -> list[Block]:
    """Blocks by length, the longest at most a third and 16 letters longer than the shortest."""
    order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
    out, part, size = [], [], 0
    for i in order:
        if part and (size + len(seqs[i]) + 8 > cells or len(part) == BLOCK_ROWS or 3 * len(seqs[i]) > 4 * len(seqs[part[0]]) + 48):
            out.append(Block(part, [seqs[j] for j in part]))
            part, size = [], 0
        part.append(i)
        size += len(seqs[i]) + 8
    return [*out, Block(part, [seqs[j] for j in part])] if part else out


class Measure:
    """``kind``: edit, loose (Hamming, or the longer length), global or local; alignments as scores, or as the longer length less the score."""

    def __init__(self, kind: str, as_distance: bool = True):
        self.kind, self.as_distance = kind, as_distance
        self.cells = LOCAL_CELLS if kind == "local" else BLOCK_BITS

    def together(self, block: Block) -> int:
        """How many texts are best given at a time."""
        return block.together() if self.kind == "local" else 1

    def of(self, block: Block, texts: list[str]) -> np.ndarray:
        """(texts x sequences)"""
        if self.kind in ("edit", "loose"):
            one = block.edit if self.kind == "edit" else block.loose
            return np.array([one(text) for text in texts])
        score = np.array([block.aligned(text) for text in texts]) if self.kind == "global" else block.local(texts)
        return np.maximum(block.length, np.array([len(x) for x in texts])[:, None]) - score if self.as_distance else score

    def bound(self, block: Block, counts: np.ndarray) -> np.ndarray:
        """(texts x sequences): a lower bound from common letters; of the longer sequence all others are changed or left
        out, which costs 1, or 2 in a global score; a local score is at most the common letters."""
        common = np.zeros((len(counts), len(block.seqs)), np.int32)
        for i in range(counts.shape[1]):
            common += np.minimum(counts[:, i, None], block.counts[None, :, i])
        size = counts.sum(1)[:, None]
        longer = np.maximum(size, block.length[None, :])
        if self.kind == "loose":
            return np.where(size == block.length[None, :], longer - common, longer)
        return (longer - common) * (2 if self.kind == "global" else 1)

    def product(self, fixed: list[str], texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, place in fixed, d) of all pairs, in parts."""
        parts = blocks(fixed, self.cells)
        rows = np.concatenate([b.rows for b in parts]) if parts else np.zeros(0, np.int64)
        step = max(1, RESULT_ROWS // max(1, len(fixed)))
        for low in range(0, len(texts) if parts else 0, step):
            some = texts[low : low + step]
            d = np.hstack([np.vstack([self.of(b, some[i : i + n]) for n in [self.together(b)] for i in range(0, len(some), n)]) for b in parts])
            yield np.repeat(np.arange(low, low + len(some)), len(rows)), np.tile(rows, len(some)), d.ravel().astype(float)


class Nearest:
    """The k nearest of each query by (d, id), as references come by in batches.

    A block of queries meets the references of a batch from the least bound on, until none can be among the k nearest.
    """

    def __init__(self, measure: Measure, seqs: list[str], k: int):
        self.measure, self.k = measure, k
        self.blocks = blocks(seqs, measure.cells)
        self.state = [(np.full((len(b.seqs), k), FAR), np.full((len(b.seqs), k), FAR), np.full((len(b.seqs), k), -1)) for b in self.blocks]

    def add(self, ids: np.ndarray, seqs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place in the batch, d) of what a batch adds to the nearest."""
        counts, out = letter_counts(seqs), []
        for block, (best, who, row) in zip(self.blocks, self.state, strict=True):
            lower = self.measure.bound(block, counts)
            least = lower.min(axis=1)
            limit = best.max(axis=1)
            last = np.where(best == limit[:, None], who, -1).max(axis=1)
            order, at, size = np.lexsort((ids, least)), 0, self.measure.together(block)
            while at < len(order):
                some: list[int] = []
                while at < len(order) and len(some) < size and least[order[at]] <= limit.max():
                    if ((lower[order[at]] < limit) | ((lower[order[at]] == limit) & (ids[order[at]] < last))).any():
                        some.append(int(order[at]))
                    at += 1
                if not some:
                    break
                for r, d in zip(some, self.measure.of(block, [seqs[r] for r in some]), strict=True):
                    hit = np.flatnonzero((d < limit) | ((d == limit) & (ids[r] < last)))
                    if not len(hit):
                        continue
                    place = np.where(best[hit] == limit[hit, None], who[hit], -FAR).argmax(axis=1)
                    best[hit, place], who[hit, place], row[hit, place] = d[hit], ids[r], r
                    limit[hit] = best[hit].max(axis=1)
                    last[hit] = np.where(best[hit] == limit[hit, None], who[hit], -FAR).max(axis=1)
            q, place = np.nonzero(row >= 0)
            out.append((block.rows[q], row[q, place], best[q, place].astype(float)))
            row[:] = -1
        return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))
