"""Gapped k-mer kernels: for two sequences, the sum over pairs of L-mers within d mismatches.

    raw(a, b) = sum over L-mers x of a and y of b and of its reverse complement, of w[h(x, y)] * pw(x) * pw(y)
    K(a, b)   = raw(a, b) / sqrt(raw(a, a) * raw(b, b)), 0 if either is 0

The kernel sees a sequence as its distinct L-mer codes with summed weights.  Sums over
pairs run in one of three ways:

* ``broadcast``: reference codes of a checked size go to every task, spread over their neighbours once;
  a query is a row-local product, nothing shuffles.
* ``neighbours``: reference codes are exploded into all codes within d changes, and pre-aggregated; an equi-join on the code follows.
* ``blocks``: codes are cut in d + 1 blocks, one of which must agree; an equi-join on
  (block, letters), a check of the distance, and each pair is kept for its lowest agreeing block.

Norms are row-local for whole sequences.  Lower case is accepted, other letters raise.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import mismatches, window_starts
from ..functions.weights import POSITIONAL, TRANSFORMS, mismatch_weights, positional_weight, transformed
from .encoders import Batch, array_rc, deltas, grouped, positional_lmers

#: Entries of a reference table that are broadcast at a time, and how many such blocks, each a pass over the queries.
BLOCK_ENTRIES, MAX_BLOCKS = 4_000_000, 16
RESULT_ROWS = 1_000_000  # pairs sent on at a time
#: Below the k-th largest value by so much a pair is still sent on, so that values may be rounded to six decimals later.
SLACK = 2e-6
DENSE_ROWS = 128  # queries of a matrix product with a dense table
NEIGHBOURS = 5000
#: Numbers of codes up to which a sequence is a dense vector of counts.
DENSE_CODES = 1 << 14


def _sum_duplicates(code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(code, return_inverse=True)
    return own, np.bincount(at, weights=weight, minlength=len(own))


def pair_sum(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray, weights: np.ndarray, step: int = 1 << 20) -> float:
    """Sum over code pairs within len(weights) - 1 mismatches, in blocks."""
    table = np.zeros(65)
    table[: len(weights)] = weights
    total, rows = 0.0, max(1, step // max(1, len(b)))
    for low in range(0, len(a), rows):
        x = a[low : low + rows, None] ^ b[None, :]
        h = np.bitwise_count((x | x >> 1) & 0x5555555555555555)
        total += float(wa[low : low + rows] @ table[h] @ wb)
    return total


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the length is a power of two."""
    rows, n = x.shape
    step = 1
    while step < n:
        x = x.reshape(rows, n // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(rows, n)


def _spectrum(L: int, weights: np.ndarray) -> np.ndarray:
    """Eigenvalues of the matrix w[h(x, y)] over all codes: it is a convolution on the bits of x ^ y.

    For a character that is trivial at all but t bases, the value is the sum over h of w[h] times the
    coefficient of z**h in (1 - z)**t * (1 + 3z)**(L - t).
    """
    by_t = []
    for t in range(L + 1):
        poly = np.array([1.0])
        for i in range(L):
            poly = np.convolve(poly, [1.0, -1.0] if i < t else [1.0, 3.0])
        by_t.append(float(poly[: len(weights)] @ weights))
    codes = np.arange(4**L)
    return np.array(by_t)[np.bitwise_count((codes | codes >> 1) & 0x5555555555555555)]


def neighbour_count(L: int, d: int) -> int:
    return sum(math.comb(L, j) * 3**j for j in range(d + 1))


def spread_table(row: np.ndarray, code: np.ndarray, n: np.ndarray, rows: int, L: int, weights: np.ndarray) -> np.ndarray:
    """(codes x rows): what each code gets from each row's codes, by its mismatches; a convolution by transforms."""
    values, out = _spectrum(L, weights) / 4**L, np.empty((4**L, rows))
    step = max(1, (1 << 20) // 4**L)
    for low in range(0, rows, step):
        high = min(rows, low + step)
        mine = (row >= low) & (row < high)
        dense = np.bincount((row[mine] - low) * 4**L + code[mine], weights=n[mine], minlength=(high - low) * 4**L).reshape(high - low, 4**L)
        out[:, low:high] = _hadamard(_hadamard(dense) * values).T
    out[np.abs(out) < 1e-9] = 0.0  # sums without terms
    return out


def self_sums(row: np.ndarray, code: np.ndarray, n: np.ndarray, rows: int, L: int, weights: np.ndarray, use_rc: bool) -> np.ndarray:
    """raw(a, a) of each sequence of a batch, from its (row, code, count), sorted by row."""
    out = np.zeros(rows)
    cuts = np.searchsorted(row, np.arange(rows + 1))
    if 4**L > DENSE_CODES:
        for i in range(rows):
            c, w = code[cuts[i] : cuts[i + 1]], n[cuts[i] : cuts[i + 1]].astype(float)
            both, wb = _sum_duplicates(np.concatenate([c, array_rc(c, L)]), np.concatenate([w, w])) if use_rc else (c, w)
            out[i] = pair_sum(c, w, both, wb, weights)
        return out
    values, turned = _spectrum(L, weights) / 4**L, array_rc(np.arange(4**L), L)
    step = max(1, (1 << 18) // 4**L)
    for low in range(0, rows, step):
        high = min(rows, low + step)
        part = slice(cuts[low], cuts[high])
        dense = np.zeros((high - low, 4**L))
        dense[row[part] - low, code[part]] = n[part]
        forward = _hadamard(dense)
        both = _hadamard(dense + dense[:, turned]) if use_rc else forward
        out[low:high] = (forward * both) @ values
    return out


def dense_product(cuts: np.ndarray, code: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(sequences x references): counts of each sequence times the (codes x references) table."""
    rows = len(cuts) - 1
    out = np.empty((rows, table.shape[1]))
    for low in range(0, rows, DENSE_ROWS):
        high = min(rows, low + DENSE_ROWS)
        part = slice(cuts[low], cuts[high])
        counts = np.zeros((high - low, len(table)))
        counts[np.repeat(np.arange(high - low), np.diff(cuts[low : high + 1])), code[part]] = n[part]
        np.matmul(counts, table, out=out[low:high])
    return out


class Largest:
    """Of rows that come by in batches, those that can be among the k largest of a column."""

    def __init__(self, k: int, columns: int):
        self.best = np.full((k, columns), -np.inf)

    def add(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of what a batch adds; ties with the k-th are all kept."""
        k = len(self.best)
        self.best = np.partition(np.vstack([self.best, values]), len(values), axis=0)[-k:]
        return np.nonzero(values >= self.best.min(axis=0) - SLACK)


class _Sides:
    """Both L-mer sides of a set of sequences: ``forward`` and ``both`` as (seq_id, by..., code, n)."""

    def __init__(self, rows: DataFrame, by: list[str], use_rc: bool):
        """rows: (seq_id, by..., code, rc_code, pw)."""
        key = ["seq_id", *by, "code"]
        self.by = by
        self.forward = rows.groupBy(*key).agg(F.sum("pw").alias("n"))
        strands = rows.select(*key, "pw")
        if use_rc:
            strands = strands.unionByName(rows.select("seq_id", *by, F.col("rc_code").alias("code"), "pw"))
        self.both = strands.groupBy(*key).agg(F.sum("pw").alias("n"))


def neighbour_table(spark, L: int, d: int, weights: list[float]) -> DataFrame:
    x, h = deltas(L, d)
    return spark.createDataFrame([(int(a), float(weights[b])) for a, b in zip(x, h, strict=True)], "x long, w double")


def raw_by_neighbours(q: DataFrame, r: DataFrame, by: list[str], L: int, d: int, weights: list[float], same: bool = False) -> DataFrame:
    """(q_id, r_id, by..., raw); with ``same``, of each sequence with itself only."""
    table = F.broadcast(neighbour_table(q.sparkSession, L, d, weights))  # a few thousand rows (auto), or as many as were asked for
    spread = r.crossJoin(table).select("seq_id", *by, F.col("code").bitwiseXOR(F.col("x")).alias("code"), (F.col("n") * F.col("w")).alias("m"))
    spread = spread.groupBy("seq_id", *by, "code").agg(F.sum("m").alias("m"))
    left = q.withColumnRenamed("seq_id", "q_id")
    if same:
        right = spread.withColumnRenamed("seq_id", "q_id")
        return left.join(right, ["q_id", *by, "code"]).groupBy("q_id", *by).agg(F.sum(F.col("n") * F.col("m")).alias("raw"))
    right = spread.withColumnRenamed("seq_id", "r_id")
    return left.join(right, [*by, "code"]).groupBy("q_id", "r_id", *by).agg(F.sum(F.col("n") * F.col("m")).alias("raw"))


def raw_by_blocks(q: DataFrame, r: DataFrame, by: list[str], L: int, d: int, weights: list[float], same: bool = False) -> DataFrame:
    cuts = [L * i // (d + 1) for i in range(d + 2)]

    def parts(df: DataFrame) -> DataFrame:
        pieces = [F.struct(F.lit(i).alias("block"), F.shiftright("code", 2 * (L - cuts[i + 1])).bitwiseAND(F.lit(4 ** (cuts[i + 1] - cuts[i]) - 1)).alias("letters")) for i in range(d + 1)]
        return df.select("*", F.explode(F.array(*pieces)).alias("p")).select("*", "p.block", "p.letters").drop("p")

    left = parts(q).select(F.col("seq_id").alias("q_id"), *by, F.col("code").alias("x"), F.col("n").alias("nx"), "block", "letters")
    right = parts(r).select(F.col("seq_id").alias("q_id" if same else "r_id"), *by, F.col("code").alias("y"), F.col("n").alias("ny"), "block", "letters")
    pairs = left.join(right, [*(["q_id"] if same else []), *by, "block", "letters"])
    agree = [F.shiftright(F.col("x").bitwiseXOR(F.col("y")), 2 * (L - cuts[i + 1])).bitwiseAND(F.lit(4 ** (cuts[i + 1] - cuts[i]) - 1)) == 0 for i in range(d + 1)]
    lowest = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(agree)])
    h = mismatches(F.col("x"), F.col("y"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (h + 1).cast("int"))
    pairs = pairs.where(lowest == F.col("block")).where(h <= d)
    key = ["q_id", *by] if same else ["q_id", "r_id", *by]
    return pairs.groupBy(*key).agg(F.sum(F.col("nx") * F.col("ny") * w).alias("raw"))


def _check_padding(padding: int | tuple[int, int] | None, window: int, L: int) -> tuple[int, int]:
    if padding is None:
        padding = 0
    left, right = (padding, padding) if isinstance(padding, int) else padding
    if not isinstance(left, int) or not isinstance(right, int):
        raise ValueError("padding is a number or a pair of numbers")
    if max(left, right) > 0 and window - max(left, right) < L:
        raise ValueError("padding must leave L letters in a window")
    return left, right


class BaseGKMKernel:
    """Parameters, references and the common steps of the kernels."""

    def __init__(self, L: int = 10, k: int = 6, d: int = 3, *, kernel_type: str = "full", use_rc: bool = False, transform: str | None = None, transform_gamma: float = 1.0, transform_coef0: float = 0.0, transform_degree: float = 3.0, transform_radius: float = 0.0, strategy: str = "auto"):
        if not 2 <= L <= 12:
            raise ValueError("L must be from 2 to 12")
        if not 1 <= k <= L:
            raise ValueError("k must be from 1 to L")
        if not 0 <= d <= L - k:
            raise ValueError("d must be from 0 to L - k")
        if transform not in TRANSFORMS:
            raise ValueError(f"unknown transform {transform!r}")
        if strategy not in ("auto", "broadcast", "neighbours", "blocks"):
            raise ValueError(f"unknown strategy {strategy!r}")
        self.L, self.k, self.d, self.kernel_type, self.use_rc, self.strategy = L, k, d, kernel_type, use_rc, strategy
        self._weights = mismatch_weights(L, k, d, kernel_type)
        self._transform = (transform, transform_gamma, transform_coef0, transform_degree, transform_radius)
        self._refs: DataFrame | None = None

    def weights(self) -> list[float]:
        return list(self._weights)

    def set_references(self, refs: DataFrame) -> BaseGKMKernel:
        """refs: (seq_id, seq); none shorter than L, not empty."""
        n, short = refs.agg(F.count(F.lit(1)), F.min(F.length("seq"))).first()
        if not n:
            raise ValueError("there are no references")
        if short is None or short < self.L:
            raise ValueError("a reference is shorter than L")
        self._refs, self.n_references = refs.select("seq_id", "seq"), n
        return self

    @property
    def reference_sequences(self) -> DataFrame:
        return self._need()

    def _need(self) -> DataFrame:
        if self._refs is None:
            raise RuntimeError("the kernel has no references; call set_references first")
        return self._refs

    def _queries(self, queries: DataFrame, least: int, what: str) -> DataFrame:
        seq = F.when(F.length("seq") >= least, F.col("seq")).otherwise(F.raise_error(F.lit(f"a query is shorter than {what}")))
        return queries.select("seq_id", seq.alias("seq"))

    def _lmers(self, df: DataFrame) -> DataFrame:
        return positional_lmers(df, self.L).withColumn("pw", F.lit(1.0))

    def _step(self):
        """The way to join codes: over neighbours if there are few, or as asked."""
        few = neighbour_count(self.L, self.d) <= NEIGHBOURS
        return raw_by_neighbours if (self.strategy in ("auto", "broadcast") and few) or self.strategy == "neighbours" else raw_by_blocks

    def _raw(self, q: _Sides, r: _Sides, same: bool = False) -> DataFrame:
        step = self._step()
        return step(q.forward, r.both, q.by, self.L, self.d, self._weights, same)

    def _norms(self, sides: _Sides) -> DataFrame:
        raw = self._raw(sides, sides, same=True)
        return raw.select(F.col("q_id").alias("seq_id"), *sides.by, F.sqrt(F.greatest(F.lit(0.0), "raw")).alias("norm"))

    def _normalised(self, raw: DataFrame, qn: DataFrame, rn: DataFrame, by: list[str], rn_by: list[str], apply_transform: bool) -> DataFrame:
        """All pairs of queries and references that have windows, with K; pairs without a common L-mer are 0."""
        grid = qn.select(F.col("seq_id").alias("q_id"), *by, F.col("norm").alias("qn"))
        right = rn.select(F.col("seq_id").alias("r_id"), *rn_by, F.col("norm").alias("rn"))
        # The result has a row for each pair, so this product is its size.
        grid = grid.join(right, rn_by) if rn_by else grid.crossJoin(right)
        both = grid.join(raw, ["q_id", "r_id", *by], "left")
        value = F.when((F.col("qn") > 0) & (F.col("rn") > 0), F.coalesce("raw", F.lit(0.0)) / (F.col("qn") * F.col("rn"))).otherwise(F.lit(0.0))
        if apply_transform:
            kind, gamma, coef0, degree, radius = self._transform
            value = transformed(value, kind, gamma, coef0, degree, radius)
        return both.select("q_id", "r_id", *by, value.alias("k"))

    def __repr__(self) -> str:
        return f"{type(self).__name__}(L={self.L}, k={self.k}, d={self.d}, kernel_type={self.kernel_type!r}, use_rc={self.use_rc})"


class GKMKernel(BaseGKMKernel):
    """Kernel of whole sequences."""

    def norms(self, df: DataFrame) -> DataFrame:
        """(seq_id, norm), row by row; sequences shorter than L have norm 0."""
        L, use_rc, weights = self.L, self.use_rc, np.array(self._weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b = Batch(batch.column(0), batch.column(1), 0)
                out = np.sqrt(np.maximum(0.0, self_sums(*grouped(*b.windows(L), 4**L), len(batch), L, weights, use_rc)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["seq_id", "norm"])

        rows = df.select(F.col("seq_id").cast("long"), F.upper(F.col("seq")).cast("binary"))
        return rows.mapInArrow(run, "seq_id long, norm double")

    def _sides(self, df: DataFrame) -> _Sides:
        return _Sides(self._lmers(df), [], self.use_rc)

    def _blocks(self, refs: DataFrame) -> int:
        """How many blocks of references are broadcast one by one: of dense tables of counts or sparse ones, as is less."""
        size = refs.agg(F.sum(F.length("seq"))).first()[0] or 0
        sparse = 2 * size * neighbour_count(self.L, self.d)
        dense = 4**self.L * self.n_references if 4**self.L <= DENSE_CODES else sparse
        return max(1, -(-min(sparse, dense) // BLOCK_ENTRIES))

    def kernel(self, *, X_query: DataFrame | None = None, X_ref: DataFrame | None = None, apply_transform: bool = True, keep: int | None = None) -> DataFrame:
        """(q_id, r_id, k): of the references with themselves, or of queries with references.

        With ``keep``, pairs that cannot be among that many largest of a reference may be left out.
        """
        if keep is not None and (keep < 1 or (apply_transform and self._transform[0] is not None)):
            raise ValueError("keep is at least 1, and for values without a transform")
        if X_ref is not None:
            self.set_references(X_ref)
        refs = self._need()
        queries = refs if X_query is None else self._queries(X_query, self.L, "L")
        blocks = self._blocks(refs) if self.strategy in ("auto", "broadcast") else MAX_BLOCKS + 1
        if self.strategy == "broadcast" or blocks <= MAX_BLOCKS:
            parts = [refs if blocks == 1 else refs.where(F.pmod(F.xxhash64("seq_id"), F.lit(blocks)) == i) for i in range(blocks)]
            return functools.reduce(DataFrame.unionByName, [self._by_broadcast(queries, part, apply_transform, keep) for part in parts])
        raw = self._raw(self._sides(queries), self._sides(refs)).select("q_id", "r_id", "raw")
        return self._normalised(raw, self.norms(queries), self.norms(refs), [], [], apply_transform)

    def _by_broadcast(self, queries: DataFrame, refs: DataFrame, apply_transform: bool, keep: int | None = None) -> DataFrame:
        """Row-local: reference codes, spread over their neighbours, meet each query's codes in its own task."""
        L, weights, use_rc = self.L, np.array(self._weights), self.use_rc
        found = refs.orderBy("seq_id").collect()  # of a checked size
        norms = {r[0]: r[1] for r in self.norms(refs).collect()}
        b = Batch(None, pa.array([r["seq"].upper().encode() for r in found], pa.large_binary()), 0)
        row, code, n = grouped(*b.windows(L), 4**L)
        n = n.astype(float)
        if use_rc:
            row, code, n = np.concatenate([row, row]), np.concatenate([code, array_rc(code, L)]), np.concatenate([n, n])
        dense, key, value = None, np.zeros(0, np.int64), np.zeros(0)
        fits = 4**L <= DENSE_CODES and 4**L * len(found) <= 2 * BLOCK_ENTRIES
        if fits and len(code) * neighbour_count(L, self.d) > BLOCK_ENTRIES:
            dense = spread_table(row, code, n, len(found), L, weights)
        elif len(found):
            x, h = deltas(L, self.d)
            key, value = _sum_duplicates(((code[:, None] ^ x) * len(found) + row[:, None]).ravel(), (n[:, None] * weights[h]).ravel())
            if fits:
                dense = np.zeros(4**L * len(found))
                dense[key] = value
                dense = dense.reshape(4**L, len(found))
                key = value = key[:0]
        shared = refs.sparkSession.sparkContext.broadcast((dense, key // max(1, len(found)), key % max(1, len(found)), value, [r[0] for r in found], np.array([norms[r[0]] for r in found])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dense, codes, owner, value, ids, rn = shared.value
            m = len(ids)
            step = max(1, RESULT_ROWS // max(1, m))
            largest = None if keep is None else Largest(keep, m)
            for whole in batches:
                for batch in (whole.slice(low, step) for low in range(0, len(whole), step)):
                    q = Batch(batch.column(0), batch.column(1), 0)
                    row, code, n = grouped(*q.windows(L), 4**L)
                    cuts = np.searchsorted(row, np.arange(len(batch) + 1))
                    qn = np.sqrt(np.maximum(0.0, self_sums(row, code, n, len(batch), L, weights, use_rc)))
                    raw = np.zeros((len(batch), m)) if dense is None else dense_product(cuts, code, n, dense)
                    for i in range(len(batch) if dense is None else 0):
                        c, w = code[cuts[i] : cuts[i + 1]], n[cuts[i] : cuts[i + 1]].astype(float)
                        low, high = np.searchsorted(codes, c), np.searchsorted(codes, c, side="right")
                        size = high - low
                        at = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
                        raw[i] = np.bincount(owner[at], weights=value[at] * np.repeat(w, size), minlength=m)
                    scale = np.outer(qn, rn)
                    k = np.divide(raw, scale, out=np.zeros_like(raw), where=scale > 0)
                    at, who = (x.ravel() for x in np.indices(k.shape)) if largest is None else largest.add(k)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.array(ids, np.int64)[who]), pa.array(k[at, who])], names=["q_id", "r_id", "k"])

        rows = queries.select(F.col("seq_id").cast("long"), F.upper(F.col("seq")).cast("binary"))
        out = rows.mapInArrow(run, "q_id long, r_id long, k double")
        kind, gamma, coef0, degree, radius = self._transform
        return out.withColumn("k", transformed(F.col("k"), kind, gamma, coef0, degree, radius)) if apply_transform else out

    def sliding_window_query_kernel(self, X_query: DataFrame, *, window: int, shift: int, padding: int | tuple[int, int] | None = None, apply_transform: bool = True) -> DataFrame:
        """(q_id, r_id, window_idx, k): each window of a query against whole references."""
        if window < self.L or shift < 1:
            raise ValueError("window must be L or more and shift 1 or more")
        left, right = _check_padding(padding, window, self.L)
        refs = self._need()
        queries = self._queries(X_query, window, "window")
        q = _Sides(_windowed(self._lmers(queries), window, shift, left, right, self.L), ["window_idx"], self.use_rc)
        r = self._sides(refs)
        # Windows are told apart by an id of their own, so that the join is that of whole sequences.
        step = self._step()
        table = step(q.forward.withColumn("seq_id", F.struct("seq_id", "window_idx")).select("seq_id", "code", "n"), r.both, [], self.L, self.d, self._weights)
        raw = table.select(F.col("q_id.seq_id").alias("q_id"), F.col("q_id.window_idx").alias("window_idx"), "r_id", "raw")
        return self._normalised(raw, self._norms(q), self.norms(refs), ["window_idx"], [], apply_transform)


def _windowed(lmers: DataFrame, window: int, shift: int, left: int, right: int, L: int) -> DataFrame:
    """L-mers of each window they lie in: (seq_id, window_idx, first, stop, pos, code, rc_code, n_lmers)."""
    spans = F.explode(window_starts(F.col("n_lmers") + (L - 1), window, shift, left, right))
    rows = lmers.select("*", spans.alias("s"))
    return rows.where((F.col("pos") >= F.col("s.first")) & (F.col("pos") + L <= F.col("s.stop"))).select("*", F.col("s.idx").alias("window_idx"), F.col("s.first").alias("first"), F.col("s.stop").alias("stop")).drop("s")


def _same_length(df: DataFrame) -> int:
    low, high = df.agg(F.min(F.length("seq")), F.max(F.length("seq"))).first()
    if low != high:
        raise ValueError("sequences must have the same length")
    return low


class WGKMKernel(BaseGKMKernel):
    """Whole sequences of one length, L-mers weighted by their distance from a centre.

    ``offsets`` of ``kernel``: None for the centre offset of the object, a number, or a list of numbers, one
    centre each (then rows carry ``center_idx``).  ``weight_peak`` is accepted and cancels out.
    """

    def __init__(self, L: int = 10, k: int = 6, d: int = 3, *, weight_kernel: str = "triangular", weight_gamma: float = 1.0, weight_sigma: float = 50.0, weight_peak: float = 50.0, center_offset: float = 0.0, **rest):
        super().__init__(L, k, d, **rest)
        if weight_kernel not in POSITIONAL:
            raise ValueError(f"unknown positional kernel {weight_kernel!r}")
        if weight_peak <= 0:
            raise ValueError("weight_peak must be above 0")
        self._position = (weight_kernel, weight_gamma, weight_sigma)
        self.center_offset = center_offset

    def _centres(self, offsets, length: int) -> list[float]:
        if isinstance(offsets, slice):
            return [j + (self.L - 1) / 2 for j in range(*offsets.indices(length - self.L + 1))]
        if offsets is None:
            offsets = self.center_offset
        return [(length - 1) / 2 + x for x in (offsets if isinstance(offsets, (list, tuple)) else [offsets])]

    def _weighted(self, df: DataFrame, centres: list[float]) -> _Sides:
        spots = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(c)).alias("c")) for i, c in enumerate(centres)]))
        kind, gamma, sigma = self._position
        rows = positional_lmers(df, self.L).select("*", spots.alias("s"))
        pw = positional_weight(kind, F.col("pos") + (self.L - 1) / 2 - F.col("s.c"), gamma, sigma)
        return _Sides(rows.select("seq_id", F.col("s.i").alias("center_idx"), "code", "rc_code", pw.alias("pw")), ["center_idx"], self.use_rc)

    def kernel(self, *, X_query: DataFrame | None = None, X_ref: DataFrame | None = None, offsets=None, apply_transform: bool = True) -> DataFrame:
        """(q_id, r_id, k), with ``center_idx`` where there are several centres."""
        if X_ref is not None:
            self.set_references(X_ref)
        refs = self._need()
        length = _same_length(refs)
        if X_query is not None and _same_length(X_query) != length:
            raise ValueError("queries and references must have the same length")
        centres = self._centres(offsets, length)
        r = self._weighted(refs, centres)
        q = r if X_query is None else self._weighted(X_query, centres)
        out = self._normalised(self._raw(q, r), self._norms(q), self._norms(r), ["center_idx"], ["center_idx"], apply_transform)
        return out.drop("center_idx") if len(centres) == 1 else out

    def sliding_window_query_kernel(self, *args, **kwargs) -> DataFrame:
        raise NotImplementedError("weighted kernels have no sliding scan")


class WindowedGKMKernel(BaseGKMKernel):
    """Window w of one sequence against window w of the other: (q_id, r_id, window_idx, k)."""

    def __init__(self, L: int = 10, k: int = 6, d: int = 3, *, window: int, shift: int, padding: int | tuple[int, int] | None = 0, **rest):
        super().__init__(L, k, d, **rest)
        if window < L or shift < 1:
            raise ValueError("window must be L or more and shift 1 or more")
        self.window, self.shift, self.padding = window, shift, _check_padding(padding, window, L)

    def _pw(self):
        return F.lit(1.0)

    def _sides(self, df: DataFrame) -> _Sides:
        rows = _windowed(positional_lmers(df, self.L), self.window, self.shift, *self.padding, self.L)
        return _Sides(rows.withColumn("pw", self._pw()).select("seq_id", "window_idx", "code", "rc_code", "pw"), ["window_idx"], self.use_rc)

    def kernel(self, *, X_query: DataFrame | None = None, X_ref: DataFrame | None = None, apply_transform: bool = True) -> DataFrame:
        if X_ref is not None:
            self.set_references(X_ref)
        refs = self._need()
        length = _same_length(refs)
        if X_query is not None and _same_length(X_query) != length:
            raise ValueError("queries and references must have the same length")
        r = self._sides(refs)
        q = r if X_query is None else self._sides(X_query)
        return self._normalised(self._raw(q, r), self._norms(q), self._norms(r), ["window_idx"], ["window_idx"], apply_transform)


class WindowedWGKMKernel(WindowedGKMKernel):
    """Windowed, with positional weights about each window's middle.

    ``legacy_center`` measures the centre in whole-sequence coordinates and L-mers from the
    window's start, as the older implementation does.
    """

    def __init__(self, L: int = 10, k: int = 6, d: int = 3, *, window: int, shift: int, padding=0, weight_kernel: str = "triangular", weight_gamma: float = 1.0, weight_sigma: float = 50.0, weight_peak: float = 50.0, center_offset: float = 0.0, legacy_center: bool = False, **rest):
        super().__init__(L, k, d, window=window, shift=shift, padding=padding, **rest)
        if weight_kernel not in POSITIONAL:
            raise ValueError(f"unknown positional kernel {weight_kernel!r}")
        if weight_peak <= 0:
            raise ValueError("weight_peak must be above 0")
        self._position, self.center_offset, self.legacy_center = (weight_kernel, weight_gamma, weight_sigma), center_offset, legacy_center

    def _pw(self):
        kind, gamma, sigma = self._position
        place = F.col("pos") - F.col("first") + (self.L - 1) / 2
        middle = F.col("window_idx") * self.shift - self.padding[0] + (self.window - 1) / 2 + self.center_offset
        return positional_weight(kind, place - (middle if self.legacy_center else middle - F.col("first")), gamma, sigma)

    def kernel(self, *, X_query: DataFrame | None = None, X_ref: DataFrame | None = None, apply_transform: bool = True) -> DataFrame:
        if X_query is not None:
            raise NotImplementedError("weighted windowed kernels have no cross form")
        return super().kernel(X_ref=X_ref, apply_transform=apply_transform)
