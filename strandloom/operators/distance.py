"""Edit and alignment distances as Column expressions, and kernels over them.

A distance is an object whose ``pair(a, b)`` gives a Column.  Hamming and Levenshtein are built-in
operators; the alignments are NumPy rows in a Pandas UDF (``fold`` gives the same as nested SQL folds,
for short strings).  ``cdist`` and ``pdist`` make a row for each pair, which is their
result; the smaller side is broadcast, in blocks of a checked size.  Distances with a ``measure`` compare a sequence
with a block of others at a time (:mod:`batched`), in ``cdist``, ``pdist`` and ``nearest``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .batched import Measure, Nearest

BROADCAST_BYTES = 16 << 20
#: Scores of the NUC4.4 matrix between the four bases.
NUC44 = {"match": 5, "mismatch": -4}


class BaseDistance:
    """Subclass and define ``pair``; ``is_distance`` says whether smaller is closer."""

    is_distance = True

    def pair(self, a: Column, b: Column) -> Column:
        raise NotImplementedError

    def measure(self) -> Measure | None:
        """The same over blocks of sequences, where there is one."""
        return None

    def __call__(self, a: str, b: str, spark) -> float:
        row = spark.createDataFrame([(a, b)], "a string, b string").select(self.pair(F.col("a"), F.col("b")).alias("d")).first()
        return row[0]

    def cdist(self, X: DataFrame, Y: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """(a_id, b_id, d) for each pair of a row of X and a row of Y, or of X; with the columns ``keep`` of Y."""
        left = X.select(F.col("seq_id").alias("a_id"), F.col("seq").alias("a"))
        right = (X if Y is None else Y).select(F.col("seq_id").alias("b_id"), F.col("seq").alias("b"), *keep)
        if self.measure() is not None:
            return _measured(left, right, self.measure()).select("a_id", "b_id", "d", *keep)
        return _product(left, right).select("a_id", "b_id", self.pair(F.col("a"), F.col("b")).alias("d"), *keep)

    def pdist(self, X: DataFrame) -> DataFrame:
        """(a_id, b_id, d) for each pair with a_id < b_id."""
        left = X.select(F.col("seq_id").alias("a_id"), F.col("seq").alias("a"))
        right = X.select(F.col("seq_id").alias("b_id"), F.col("seq").alias("b"))
        if self.measure() is not None:
            return _measured(left, right, self.measure()).where("a_id < b_id").select("a_id", "b_id", "d")
        return _product(left, right, F.col("a_id") < F.col("b_id")).select("a_id", "b_id", self.pair(F.col("a"), F.col("b")).alias("d"))

    def nearest(self, queries: DataFrame, refs: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame | None:
        """(q_id, r_id, d), with the columns ``keep`` of the references: the k nearest are among these rows, a few times k
        for each task.  None where there is no measure, larger is closer, or the ids are not whole numbers.  Null sequences are left out."""
        if self.measure() is None or not self.is_distance or not all(isinstance(df.schema["seq_id"].dataType, IntegralType) for df in (queries, refs)):
            return None
        left = queries.where(F.col("seq").isNotNull()).select(F.col("seq_id").alias("q_id"), F.col("seq").alias("a"))
        right = refs.where(F.col("seq").isNotNull()).select(F.col("seq_id").alias("r_id"), F.col("seq").alias("b"), *keep)
        return _union([_nearest(part, right, self.measure(), k, keep) for part in _parts(left, _size(left, "a"))])


def _size(df: DataFrame, name: str) -> int:
    return int(df.agg(F.sum(F.length(name) + 16)).first()[0] or 0)


def _parts(df: DataFrame, size: int) -> list[DataFrame]:
    """``df`` itself, or blocks of it that can be broadcast."""
    if size <= BROADCAST_BYTES:
        return [df]
    blocks = -(-2 * size // BROADCAST_BYTES)  # twice as many, as a hash deals them unevenly
    return [df.where(F.pmod(F.xxhash64(df.columns[0]), F.lit(blocks)) == i) for i in range(blocks)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _kinds(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)


def _sent(df: DataFrame, seq: str):
    """The rows of a side of a checked size, for every task: an Arrow table without the sequences, and the sequences."""
    found = df.toArrow()
    return df.sparkSession.sparkContext.broadcast((found.drop_columns([seq]).combine_chunks(), found[seq].to_pylist()))


def _measured(left: DataFrame, right: DataFrame, measure: Measure) -> DataFrame:
    """All pairs with d; the smaller side, or blocks of it, goes to every task.  d is null where a sequence is."""
    sizes = _size(left, "a"), _size(right, "b")
    small, large, s, t = (left, right, "a", "b") if sizes[0] < sizes[1] else (right, left, "b", "a")

    def product(part: DataFrame) -> DataFrame:
        shared = _sent(part, s)
        names = [c for c in large.columns if c != t]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fixed, seqs = shared.value
            plain = ["" if x is None else x for x in seqs]
            unknown = np.array([x is None for x in seqs], bool)
            for batch in batches:
                texts = batch.column(t).to_pylist()
                lost = np.array([x is None for x in texts], bool)
                for i, j, d in measure.product(plain, ["" if x is None else x for x in texts]):
                    ours, theirs = pa.array(i), pa.array(j)
                    columns = [*(fixed[c].take(theirs).combine_chunks() for c in fixed.column_names), *(batch.column(c).take(ours) for c in names), pa.array(d, mask=lost[i] | unknown[j])]
                    yield pa.RecordBatch.from_arrays(columns, names=[*fixed.column_names, *names, "d"])

        return large.mapInArrow(run, _kinds(part, [c for c in part.columns if c != s]) + _kinds(large, names) + "d double")

    return _union([product(part) for part in _parts(small, min(sizes))])


def _nearest(queries: DataFrame, refs: DataFrame, measure: Measure, k: int, keep: tuple[str, ...]) -> DataFrame:
    shared = _sent(queries, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed, seqs = shared.value
        found = Nearest(measure, seqs, k)
        for batch in batches:
            q, r, d = found.add(batch.column("r_id").to_numpy().astype(np.int64), batch.column("b").to_pylist())
            rows = pa.array(r)
            yield pa.RecordBatch.from_arrays([fixed["q_id"].take(pa.array(q)).combine_chunks(), *(batch.column(c).take(rows) for c in ("r_id", *keep)), pa.array(d, pa.float64())], names=["q_id", "r_id", *keep, "d"])

    return refs.mapInArrow(run, _kinds(queries, ["q_id"]) + _kinds(refs, ["r_id", *keep]) + "d double")


def _product(left: DataFrame, right: DataFrame, on: Column | None = None) -> DataFrame:
    """All pairs, the smaller side broadcast if it is of a checked size; if neither is, one is cut in blocks that are."""
    sizes = _size(left, "a"), _size(right, "b")
    small = 0 if sizes[0] < sizes[1] else 1
    both = [left, right]

    def joined(part: DataFrame) -> DataFrame:
        sides = list(both)
        sides[small] = F.broadcast(part)
        return sides[0].join(sides[1], on) if on is not None else sides[0].crossJoin(sides[1])

    return _union([joined(part) for part in _parts(both[small], sizes[small])])


def differing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda n, x: n + x)


class Hamming(BaseDistance):
    """Places that differ; sequences of unequal length raise."""

    def pair(self, a, b):
        return F.when(F.length(a) != F.length(b), F.raise_error(F.lit("sequences have unequal lengths")).cast("double")).when(F.length(a) == 0, F.lit(0.0)).otherwise(differing(a, b).cast("double"))


class Levenshtein(BaseDistance):
    """Least insertions, deletions and substitutions; with ``bound``, -1 above it."""

    def __init__(self, bound: int | None = None):
        self.bound = bound

    def measure(self):
        return Measure("edit") if self.bound is None else None

    def pair(self, a, b):
        return (F.levenshtein(a, b) if self.bound is None else F.levenshtein(a, b, self.bound)).cast("double")


def _align(a: bytes, b: bytes, table: np.ndarray, gap: float, local: bool) -> float:
    """Score by rows; the run of gaps along a row is a running maximum of the row less its gaps."""
    if not a or not b:
        return 0.0 if local else gap * (len(a) + len(b))
    if len(a) > len(b):
        a, b, table = b, a, table.T
    y = np.frombuffer(b, np.uint8)
    slope = gap * np.arange(len(y) + 1)
    row = np.zeros(len(y) + 1) if local else slope.copy()
    best = 0.0
    for i, c in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = 0.0 if local else gap * i
        new[1:] = np.maximum(row[:-1] + table[c][y], row[1:] + gap)
        if local:
            np.maximum(new, 0.0, out=new)
        new = np.maximum.accumulate(new - slope) + slope
        if local:
            np.maximum(new, 0.0, out=new)
            best = max(best, float(new.max()))
        row = new
    return best if local else float(row[-1])


def read_matrix(lines: Iterable[str]) -> tuple[str, np.ndarray]:
    """(letters, scores) of a matrix in the common text form: comments, a line of letters, a line for each letter."""
    rows = [x.split() for x in lines if x.strip() and not x.startswith("#")]
    letters = "".join(rows[0])
    if any(len(x) != 1 for x in rows[0]) or [r[0] for r in rows[1:]] != rows[0] or any(len(r) != len(letters) + 1 for r in rows[1:]):
        raise ValueError("rows and columns of the matrix differ")
    return letters, np.array([[float(x) for x in r[1:]] for r in rows[1:]])


class Alignment(BaseDistance):
    """substitution_matrix: a name, a 4 x 4 array for A, C, G, T, or (letters, array), as from :func:`read_matrix`."""

    local = False
    is_distance = False

    def __init__(self, match: float = 1, mismatch: float = -1, gap: float = -1, substitution_matrix: str | np.ndarray | tuple[str, np.ndarray] | None = None, as_distance: bool = False):
        if isinstance(substitution_matrix, str):
            if substitution_matrix.upper() not in ("NUC4.4", "NUC.4.4", "NUC44", "DNAFULL"):
                raise ValueError(f"unknown substitution matrix {substitution_matrix!r}")
            match, mismatch = NUC44["match"], NUC44["mismatch"]
        self.match, self.mismatch, self.gap, self.as_distance = match, mismatch, gap, as_distance
        self.is_distance = as_distance
        self.unit = (match, mismatch, gap) == (1, -1, -1) and substitution_matrix is None
        self.table = np.full((256, 256), float(mismatch))
        np.fill_diagonal(self.table, float(match))
        self.top = float(match)
        if isinstance(substitution_matrix, np.ndarray):
            substitution_matrix = ("ACGT", substitution_matrix)
        if isinstance(substitution_matrix, tuple):
            letters, scores = substitution_matrix
            at = np.frombuffer(letters.encode("ascii"), np.uint8)
            self.table[np.ix_(at, at)] = scores
            self.top = float(np.max(scores))

    def measure(self):
        return Measure("local" if self.local else "global", self.as_distance) if self.unit else None

    def pair(self, a, b):
        table, gap, local = self.table, float(self.gap), self.local

        @F.pandas_udf("double")
        def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for x, y in pairs:
                yield pd.Series([_align(s.encode(), t.encode(), table, gap, local) for s, t in zip(x, y, strict=True)], dtype="float64")

        return self._final(score(a, b), a, b)

    def fold(self, a: Column, b: Column) -> Column:
        """The same by nested folds over characters (match and mismatch scores only)."""
        gap, zero = F.lit(float(self.gap)), F.lit(0.0)
        floor = (lambda x: F.greatest(x, zero)) if self.local else (lambda x: x)
        letters = F.when(F.length(b) > 0, F.split(b, "")).otherwise(F.array().cast("array<string>"))
        first = F.transform(F.sequence(F.lit(0), F.length(b)), lambda j: zero if self.local else j * gap)

        def next_row(state: Column, c: Column) -> Column:
            row = state["row"]
            steps = F.zip_with(
                F.zip_with(F.slice(row, F.lit(1), F.size(letters)), letters, lambda up_left, y: up_left + F.when(c == y, F.lit(float(self.match))).otherwise(F.lit(float(self.mismatch)))),
                F.slice(row, F.lit(2), F.size(letters)),
                lambda diagonal, up: floor(F.greatest(diagonal, up + gap)),
            )
            start = F.array(zero if self.local else row[0] + gap)
            new = F.aggregate(steps, start, lambda acc, x: F.concat(acc, F.array(F.greatest(x, F.element_at(acc, -1) + gap))))
            return F.struct(new.alias("row"), F.greatest(state["best"], F.array_max(new)).alias("best"))

        chars = F.when(F.length(a) > 0, F.split(a, "")).otherwise(F.array().cast("array<string>"))
        end = F.aggregate(chars, F.struct(first.alias("row"), zero.alias("best")), next_row)
        return self._final(end["best"] if self.local else F.element_at(end["row"], -1), a, b)

    def _final(self, score: Column, a: Column, b: Column) -> Column:
        return F.greatest(F.length(a), F.length(b)) * F.lit(self.top) - score if self.as_distance else score


class NeedlemanWunsch(Alignment):
    """Global alignment score with a linear gap."""


class SmithWaterman(Alignment):
    """Local alignment score with a linear gap."""

    local = True


class DistanceKernel:
    """A kernel of a distance d: ``pair`` gives the Column, ``kernel_matrix`` the rows (a_id, b_id, k)."""

    def __init__(self, distance: BaseDistance, transform: str = "rbf", *, gamma: float = 1.0, coef0: float = 0.0, degree: float = 3.0, radius: float = 0.0):
        self.distance = distance
        g = gamma
        makers = {
            "linear": lambda d: -d,
            "rbf": lambda d: F.exp(-g * d * d),
            "poly": lambda d: F.pow(coef0 - g * d, F.lit(float(degree))),
            "sigmoid": lambda d: F.tanh(coef0 - g * d),
            "laplacian": lambda d: F.exp(-g * d),
            "exponential": lambda d: F.exp(-g * d),
            "exponential_clipped": lambda d: F.exp(-g * F.greatest(F.lit(0.0), d - radius)),
            "cauchy": lambda d: 1 / (1 + g * d * d),
        }
        if transform not in makers:
            raise ValueError(f"unknown transform {transform!r}")
        self.apply = makers[transform]

    def pair(self, a: Column, b: Column) -> Column:
        return self.apply(self.distance.pair(a, b))

    def kernel_matrix(self, X: DataFrame, Y: DataFrame | None = None) -> DataFrame:
        return self.distance.cdist(X, Y).select("a_id", "b_id", self.apply(F.col("d")).alias("k"))

    def gram(self, queries: DataFrame, refs: DataFrame) -> DataFrame:
        """The kernel protocol of the estimators: (q_id, r_id, k)."""
        return self.kernel_matrix(queries, refs).select(F.col("a_id").alias("q_id"), F.col("b_id").alias("r_id"), "k")


KERNEL_TRANSFORMS = ("linear", "rbf", "poly", "sigmoid", "laplacian", "exponential", "exponential_clipped", "cauchy")
