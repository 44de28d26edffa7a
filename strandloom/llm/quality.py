"""Compression classifier of text quality.

Labelled good and bad texts each train a Zstandard dictionary.  A text is
compressed with either dictionary in pieces of ``PIECE`` bytes, so that what counts is
how well the dictionary foretells it and not how well it foretells itself; the
difference of the two compressed sizes over the text's size is the evidence.  A logistic fit on labelled
rows kept apart from the dictionaries turns it into a calibrated score.

Labels are learned from a bounded sample, ``FIT_ROWS`` rows at most, drawn by a
seeded hash of the id.  Half of them, by another hash, give the dictionaries' pieces, from anywhere in their whole texts:
all pieces, or the ``FIT_PIECES`` of each class with the smallest hashes.  The other half calibrates: their whole texts are
compressed on the executors, and one number a row comes back.

Null and empty texts score the base rate of the training labels.  With one class only in training, or no rows, every text
scores that base rate.  Each row is scored by itself: repeated rows score alike; very long texts are compressed
whole, in pieces.  An empty table gives no rows.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold, labelled_sample
from .scratch import staged

FIT_ROWS = 6000
FIT_PIECES = 8000  # of each class, 16 MB
DICT_BYTES = 16_384
PIECE = 2048
LEVEL = 3
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

class Model:
    """Dictionaries and the logistic fit; small, and sent to executors whole."""

    def __init__(self, dictionaries: list[bytes], weights: np.ndarray, base: float):
        self.dictionaries, self.weights, self.base = dictionaries, weights, base
        self._tools: list | None = None

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "weights": self.weights, "base": self.base, "_tools": None}

    def evidence(self, text: bytes) -> float:
        """How much less the good texts' dictionary leaves than the bad texts', over the size."""
        if self._tools is None:
            made = [zstandard.ZstdCompressionDict(x) for x in self.dictionaries]
            self._tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=x, write_content_size=False) for x in made]
        bad, good = (sum(len(tool.compress(text[at : at + PIECE])) for at in range(0, len(text), PIECE)) for tool in self._tools)
        return 10 * (bad - good) / (len(text) + 32.0)

    def score(self, text: bytes | None) -> float:
        if not self.dictionaries or not text or not text.strip():
            return self.base
        z = float(self.weights[0] + self.weights[1] * self.evidence(text))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Newton's method for logistic regression with a small ridge; the first column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(y))
    penalty[0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(pieces: list[bytes]) -> bytes:
    total = sum(map(len, pieces))
    if len(pieces) < 8 or total < 1024:
        return b"".join(pieces)[:DICT_BYTES]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(512, total // 10)), pieces).as_bytes()
    except zstandard.ZstdError:  # too little variety: raw content serves as a dictionary too
        return b"".join(pieces)[-DICT_BYTES:]


def _pieces(rows: DataFrame, label: int) -> list[bytes]:
    """Pieces of the whole texts of a class, those with the smallest hashes.  rows: (doc_id, text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                pieces = [x for at in range(0, len(raw), PIECE) if len(x := raw[at : at + PIECE]) >= 8]
                ranks = [xxhash.xxh64_intdigest(f"{key}:{i}") >> 1 for i in range(len(pieces))]
                yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array(pieces, pa.binary())], names=["rank", "piece"])

    found = rows.where(F.col("label") == label).select("doc_id", "text").mapInArrow(run, "rank long, piece binary")
    return [bytes(r["piece"]) for r in found.orderBy("rank", "piece").limit(FIT_PIECES).collect()]


def quality_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    rows = labelled_sample(docs, labels, "quality", (FOLDS, HELD_OUT), fit_rows).select("doc_id", F.col("text").cast("binary").alias("text"), "label")
    rows = staged(rows.where(F.trim(F.col("text").cast("string")) != ""), "quality-rows")
    half = F.crc32(F.concat(F.lit("half:"), F.col("doc_id").cast("string"))) % 2
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("label", half.alias("half")).agg(F.count(F.lit(1))).collect()}
    n = [sum(c for (k, _), c in counts.items() if k == label) for label in (0, 1)]
    base = (n[1] + 1) / (sum(n) + 2)
    if min(counts.get((label, part), 0) for label in (0, 1) for part in (0, 1)) < 2:
        return Model([], np.zeros(2), base)
    dictionaries = [_dictionary(_pieces(rows.where(half == 0), label)) for label in (0, 1)]
    if not all(dictionaries):
        return Model([], np.zeros(2), base)
    model = Model(dictionaries, np.zeros(2), base)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([own.evidence(t.as_buffer().to_pybytes()) for t in batch.column(1)], pa.float64())], names=["doc_id", "label", "x"])

    apart = rows.where(half == 1).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "label").mapInArrow(run, "doc_id string, label int, x double").collect()
    apart.sort(key=lambda r: (r["doc_id"], r["x"]))  # the same order in any run
    x = np.array([[1.0, r["x"]] for r in apart])
    model.weights = logistic(x, np.array([float(r["label"]) for r in apart]))
    return model


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tens of KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            values = [own.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64()), pa.array([int(v >= threshold) for v in values], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    body = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return body.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
