"""Count encoders: sequences to (seq_id, col, feature, cnt).

Counts are local to a sequence, so the encoders are one Arrow pass over the rows and
never shuffle.  Features that do not occur have no row.  Sequences that are too short
have no rows and are not validated; otherwise letters outside A, C, G, T raise.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import code_to_kmer

OUT = "seq_id long, col int, feature string, cnt long"
#: Encoders of at most so many columns name them all at the start of a task.
NAMED_COLUMNS = 1 << 14
#: Rows and letters that are counted at a time: a row may give a result row for each column.
SLICE_ROWS, SLICE_LETTERS = 256, 1 << 17
_CODE = np.full(256, 255, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _i


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in parts of at most SLICE_ROWS rows and SLICE_LETTERS letters, or a row of more."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < len(batch):
            done = size[low - 1] if low else 0
            high = max(low + 1, min(low + SLICE_ROWS, int(np.searchsorted(size, done + SLICE_LETTERS, side="right"))))
            yield batch.slice(low, high - low)
            low = high


class Batch:
    """The sequences of an Arrow column as one array of base codes, with the row of each base."""

    def __init__(self, ids: pa.Array, seqs: pa.Array, shortest: int):
        if seqs.null_count:
            raise ValueError("a sequence is null")
        seqs = seqs.cast(pa.large_binary())
        _, where, data = seqs.buffers()
        offsets = np.frombuffer(where, np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.ids = ids
        self.bounds = offsets - offsets[0]
        self.length = np.diff(self.bounds)
        self.base = _CODE[raw]
        self.row = np.repeat(np.arange(len(seqs)), self.length)
        bad = (self.base == 255) & (self.length[self.row] >= shortest)
        if bad.any():
            raise ValueError("a sequence has letters outside ACGT")
        self.base = np.where(self.base == 255, 0, self.base)

    def windows(self, length: int, positions: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, code) of each window; positions: which of its letters are packed."""
        n = len(self.base) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = np.zeros(n, np.int64)
        for p in positions if positions is not None else range(length):
            code = code * 4 + self.base[p : p + n]
        inside = self.row[:n] == self.row[length - 1 :]
        return self.row[:n][inside], code[inside]

    def starts(self, length: int) -> np.ndarray:
        """The place in its own sequence of each window that ``windows`` gives."""
        n = len(self.base) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        inside = self.row[:n] == self.row[length - 1 :]
        return (np.arange(n) - self.bounds[self.row[:n]])[inside]


def array_rc(code: np.ndarray, k: int) -> np.ndarray:
    out, rest = np.zeros_like(code), code.copy()
    for _ in range(k):
        out = out * 4 + 3 - (rest & 3)
        rest >>= 2
    return out


def grouped(row: np.ndarray, code: np.ndarray, width: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of each pair; codes are below ``width``."""
    if weight is None:  # a plain sort, which is vectorised, and the lengths of its runs
        key = np.sort(row * width + code)
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        key, n = key[first], np.diff(np.concatenate([first, [len(key)]]))
        return key // width, key % width, n
    key, inverse = np.unique(row * width + code, return_inverse=True)
    n = np.bincount(inverse, weights=weight, minlength=len(key)).astype(np.int64)
    return key // width, key % width, n


def canonical_codes(k: int) -> np.ndarray:
    every = np.arange(4**k, dtype=np.int64)
    return every[every <= array_rc(every, k)]


class Encoder:
    """fit / transform / fit_transform over a DataFrame (seq_id, seq)."""

    def columns(self) -> int:
        raise NotImplementedError

    def feature_name(self, col: int) -> str:
        raise NotImplementedError

    def count(self, b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, count) of a batch."""
        raise NotImplementedError

    shortest = 1

    @property
    def n_features_(self) -> int:
        return self.columns()

    def fit(self, df: DataFrame | None = None) -> Encoder:
        return self

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def get_feature_names_out(self) -> list[str]:
        return [self.feature_name(i) for i in range(self.columns())]

    def dimension(self, spark: SparkSession) -> DataFrame:
        """(col, feature) of every column, made where it is needed."""
        name = self.feature_name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(cols, pa.int32()), pa.array([name(c) for c in cols], pa.string())], names=["col", "feature"])

        return spark.range(self.columns()).mapInArrow(run, "col int, feature string")

    def transform(self, df: DataFrame) -> DataFrame:
        """(seq_id, col, feature, cnt) of each feature of each sequence."""
        count, name, shortest, width = self.count, self.feature_name, self.shortest, self.columns()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every = pa.array([name(c) for c in range(width)], pa.string()) if width <= NAMED_COLUMNS else None
            names: dict[int, str] = {}
            for batch in slices(batches):
                row, col, n = count(Batch(batch.column(0), batch.column(1), shortest))
                if every is not None:
                    labels = every.take(pa.array(col))
                else:
                    seen, at = np.unique(col, return_inverse=True)
                    labels = pa.array([names.get(c) or names.setdefault(c, name(c)) for c in seen.tolist()], pa.string()).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(col.astype(np.int32)), labels, pa.array(n.astype(np.int64))], names=["seq_id", "col", "feature", "cnt"])

        return df.select(F.col("seq_id").cast("long"), F.col("seq").cast("binary")).mapInArrow(run, OUT)

    def arrays(self, df: DataFrame) -> DataFrame:
        """(seq_id, cols, cnts): one row a sequence, its columns in order; row-local, and far fewer rows than ``transform``."""
        count, shortest = self.count, self.shortest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                row, col, n = count(Batch(batch.column(0), batch.column(1), shortest))
                order = np.lexsort((col, row))
                cuts = pa.array(np.searchsorted(row[order], np.arange(len(batch) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x[order].astype(kind))) for x, kind in ((col, np.int32), (n, np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["seq_id", "cols", "cnts"])

        return df.select(F.col("seq_id").cast("long"), F.col("seq").cast("binary")).mapInArrow(run, "seq_id long, cols array<int>, cnts array<long>")

    def vectors(self, df: DataFrame) -> DataFrame:
        """(seq_id, features) with a sparse vector for each sequence, empty ones included; no shuffle."""
        return self.arrays(df).select("seq_id", sparse_vector(F.col("cols"), F.col("cnts"), self.columns()).alias("features"))


def sparse_vector(cols, cnts, size: int):
    from pyspark.ml.linalg import SparseVector, VectorUDT
    from pyspark.sql.functions import udf

    return udf(lambda c, n: SparseVector(size, c, [float(x) for x in n]), VectorUDT())(cols, cnts)


def _check_k(k: int, low: int = 1, high: int = 12) -> int:
    if not low <= k <= high:
        raise ValueError(f"k must be from {low} to {high}")
    return k


class SpectrumEncoder(Encoder):
    """Counts of all k-mers; with canonical_rc each window counts for the smaller of itself and its reverse complement."""

    def __init__(self, k: int = 6, canonical_rc: bool = False):
        self.k, self.canonical_rc = _check_k(k), canonical_rc
        self.shortest = k
        self._canonical = canonical_codes(k) if canonical_rc else None

    def columns(self) -> int:
        return len(self._canonical) if self.canonical_rc else 4**self.k

    def feature_name(self, col: int) -> str:
        return code_to_kmer(int(self._canonical[col]) if self.canonical_rc else col, self.k)

    def count(self, b: Batch):
        row, code = b.windows(self.k)
        if self.canonical_rc:
            code = np.searchsorted(self._canonical, np.minimum(code, array_rc(code, self.k)))
        return grouped(row, code, self.columns())


def deltas(k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(xor, mismatches) of all changes of at most m of k bases: sum of C(k, j) * 3**j of them."""
    out, dist = [], []
    for j in range(m + 1):
        for places in itertools.combinations(range(k), j):
            for change in itertools.product((1, 2, 3), repeat=j):
                out.append(sum(c << 2 * p for c, p in zip(change, places, strict=True)))
                dist.append(j)
    return np.array(out, np.int64), np.array(dist, np.int64)


class MismatchEncoder(Encoder):
    """Each window adds 1 to all k-mers within m substitutions.

    canonical_rc collapses a k-mer with its reverse complement; ``legacy_drop`` drops those that
    are not canonical instead.
    """

    def __init__(self, k: int, m: int, canonical_rc: bool = False, legacy_drop: bool = False):
        self.k, self.m, self.canonical_rc, self.legacy_drop = _check_k(k), m, canonical_rc, legacy_drop
        if not 0 <= m <= k:
            raise ValueError("m must be from 0 to k")
        self.shortest = k
        self._canonical = canonical_codes(k) if canonical_rc else None
        self._deltas = deltas(k, m)[0]

    columns = SpectrumEncoder.columns
    feature_name = SpectrumEncoder.feature_name

    def count(self, b: Batch):
        row, code, n = grouped(*b.windows(self.k), 4**self.k)
        parts = []
        for low in range(0, max(len(row), 1), 1 << 14):  # bounded by the number of neighbours a step
            r, c, w = (x[low : low + (1 << 14)] for x in (row, code, n))
            near = (c[:, None] ^ self._deltas).ravel()
            r, w = np.repeat(r, len(self._deltas)), np.repeat(w, len(self._deltas))
            if self.canonical_rc:
                if self.legacy_drop:
                    keep = near <= array_rc(near, self.k)
                    r, near, w = r[keep], near[keep], w[keep]
                else:
                    near = np.minimum(near, array_rc(near, self.k))
                near = np.searchsorted(self._canonical, near)
            parts.append(grouped(r, near, self.columns(), w))
        r, c, w = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return grouped(r, c, self.columns(), w)

    def window_total(self) -> int:
        return sum(comb(self.k, j) * 3**j for j in range(self.m + 1))


def generate_masks(L_min: int, L_max: int, g_min: int = 0, g_max: int | None = None) -> list[str]:
    """Masks of lengths L_min to L_max with g_min to g_max gaps between a first and a last ``*``."""
    out = []
    for length in range(max(2, L_min), L_max + 1):
        inner = length - 2
        for g in range(g_min, (inner if g_max is None else min(g_max, inner)) + 1):
            for gaps in itertools.combinations(range(1, length - 1), g):
                out.append("".join("-" if i in gaps else "*" for i in range(length)))
    return out


def _check_masks(masks: list[str]) -> None:
    if not 1 <= len(masks) <= 1024:
        raise ValueError("there must be 1 to 1024 masks")
    for m in masks:
        if not m or set(m) - {"*", "-"} or len(m) > 32 or not 1 <= m.count("*") <= 15 or m[0] == "-" or m[-1] == "-":
            raise ValueError(f"bad mask {m!r}")


class GappyEncoder(Encoder):
    """For each mask, counts of the letters under its ``*``; columns are mask by mask, names ``<mask>_<letters>``.

    canonical_rc takes of a mask and its mirror image the smaller one, and collapses patterns of
    masks that are their own mirror image; only the given strand is read.
    """

    def __init__(self, masks: list[str] | None = None, *, L: int | None = None, g_min: int = 0, g_max: int | None = None, canonical_rc: bool = False):
        if (masks is None) == (L is None):
            raise ValueError("give masks or L")
        if L is not None:
            masks = generate_masks(L, L, g_min, g_max)
        _check_masks(masks)
        if canonical_rc:
            masks = list(dict.fromkeys(min(m, m[::-1]) for m in masks))
        self.masks, self.canonical_rc = masks, canonical_rc
        self.shortest = 0
        self._sizes = [m.count("*") for m in masks]
        self._own = [canonical_codes(s) if canonical_rc and m == m[::-1] else None for m, s in zip(masks, self._sizes, strict=True)]
        self._base = np.cumsum([0, *[4**s if own is None else len(own) for own, s in zip(self._own, self._sizes, strict=True)]])

    def columns(self) -> int:
        return int(self._base[-1])

    def feature_name(self, col: int) -> str:
        i = int(np.searchsorted(self._base, col, side="right")) - 1
        code = col - int(self._base[i])
        if self._own[i] is not None:
            code = int(self._own[i][code])
        return f"{self.masks[i]}_{code_to_kmer(code, self._sizes[i])}"

    def count(self, b: Batch):
        parts = []
        for i, mask in enumerate(self.masks):
            row, code = b.windows(len(mask), [p for p, c in enumerate(mask) if c == "*"])
            if self._own[i] is not None:
                code = np.searchsorted(self._own[i], np.minimum(code, array_rc(code, self._sizes[i])))
            parts.append(grouped(row, code + self._base[i], self.columns()))
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def positional_lmers(df: DataFrame, length: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(seq_id, keep..., pos, code, rc_code, n_lmers): the windows of ``length`` letters; lower case is accepted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            b = Batch(batch.column(0), batch.column(1), 0)
            row, code = b.windows(length)
            take = pa.array(row)
            n = np.maximum(b.length - length + 1, 0)[row]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *[c.take(take) for c in batch.columns[2:]], pa.array(b.starts(length).astype(np.int32)), pa.array(code), pa.array(array_rc(code, length)), pa.array(n.astype(np.int32))], names=["seq_id", *keep, "pos", "code", "rc_code", "n_lmers"])

    kinds = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in keep)
    rows = df.select(F.col("seq_id").cast("long"), F.upper(F.col("seq")).cast("binary"), *keep)
    return rows.mapInArrow(run, f"seq_id long{kinds}, pos int, code long, rc_code long, n_lmers int")


