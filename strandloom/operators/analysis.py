"""Analyses on top of kernels and scores: scan scores, average linkage, areas under curves, grids of kernels."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .models import KernelSVM


def scan_scores(scan: DataFrame, coefficients: DataFrame, bias: float = 0.0) -> DataFrame:
    """(q_id, window_idx, score) of a sliding scan (q_id, window_idx, r_id, k): sum of k * coef, plus the bias.

    coefficients: (r_id, coef), a row a reference; references without one add nothing.
    """
    sums = scan.join(coefficients, "r_id", "left").groupBy("q_id", "window_idx").agg(F.sum(F.col("k") * F.coalesce("coef", F.lit(0.0))).alias("s"))
    return sums.select("q_id", "window_idx", (F.col("s") + F.lit(float(bias))).alias("score"))


def svm_scan(model: KernelSVM, queries: DataFrame, *, window: int, shift: int = 1) -> DataFrame:
    """``scan_scores`` of a fitted two-class model: its support vectors are the references."""
    if len(model._pairs) != 1:
        raise ValueError("scan scores are for two classes")
    _, _, weights, bias, _ = model._pairs[0]
    coefficients = F.broadcast(queries.sparkSession.createDataFrame([(int(k), c) for k, c in weights.items()], "r_id long, coef double"))  # at most max_rows
    references = model._train.join(coefficients.select(F.col("r_id").alias("seq_id")), "seq_id", "left_semi")
    return scan_scores(model.kernel.set_references(references).sliding_window_query_kernel(queries, window=window, shift=shift), coefficients, bias)


def peaks(scores: DataFrame) -> DataFrame:
    """(q_id, window_idx, score) of each query's best window, the first of equal ones."""
    best = F.max(F.struct("score", (-F.col("window_idx")).alias("back"))).alias("b")
    return scores.groupBy("q_id").agg(best).select("q_id", (-F.col("b.back")).alias("window_idx"), "b.score")


def kernel_distances(kernel: DataFrame) -> DataFrame:
    """(a_id, b_id, d) of a self kernel (q_id, r_id, k): sqrt(2 - 2k), 0 on the diagonal, the mean of both directions."""
    d = F.when(F.col("q_id") == F.col("r_id"), 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("k"))))
    pairs = kernel.select(F.least("q_id", "r_id").alias("a_id"), F.greatest("q_id", "r_id").alias("b_id"), d.alias("d"))
    return pairs.where("a_id < b_id").groupBy("a_id", "b_id").agg(F.avg("d").alias("d"))


def average_linkage(distances: DataFrame, max_rows: int = 2000) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) by average linkage; leaves are numbered by id, the i-th merge is node n + i.

    distances: (a_id, b_id, d) for each pair once.  The tree needs the whole matrix on the driver: ``max_rows`` bounds it.
    """
    ids = [r[0] for r in distances.select(F.explode(F.array("a_id", "b_id")).alias("id")).distinct().orderBy("id").limit(max_rows + 1).collect()]
    if len(ids) > max_rows:
        raise ValueError(f"more than {max_rows} sequences")
    n, at = len(ids), {k: i for i, k in enumerate(ids)}
    table = distances.toPandas()
    d = np.full((n, n), np.inf)
    a, b = table["a_id"].map(at).to_numpy(int), table["b_id"].map(at).to_numpy(int)
    d[a, b] = d[b, a] = table["d"]
    size, node, out = np.ones(n), np.arange(n), []
    for step in range(n - 1):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        height, total = float(d[i, j]), size[i] + size[j]
        out.append((int(min(node[i], node[j])), int(max(node[i], node[j])), height, int(total)))
        mixed = (size[i] * d[i] + size[j] * d[j]) / total
        d[i], d[:, i] = mixed, mixed
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        size[i], node[i] = total, n + step
    return out


def auc(scored: DataFrame, score: str = "decision", label: str = "label") -> DataFrame:
    """(auc) of 0/1 labels: the share of pairs in the right order, ties by half; null if a class is missing.

    Scores are grouped before they are put in order, so the one ordered pass has a row a distinct score.
    """
    groups = scored.groupBy(score).agg(F.sum((F.col(label) == 1).cast("double")).alias("p"), F.sum((F.col(label) == 0).cast("double")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    right = groups.select("p", "n", below.alias("below"))
    return right.agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0.0))).alias("auc"))


def kernel_grid(train: DataFrame, test: DataFrame, kernels: Iterable[tuple[str, object]], C: float = 1.0) -> DataFrame:
    """(kernel, auc) of a support vector classifier with each named kernel; labels are 0 and 1."""
    out = None
    for name, kernel in kernels:
        decisions = KernelSVM(kernel, C=C).fit(train).decision_function(test.select("seq_id", "seq"))
        part = auc(decisions.join(test.select("seq_id", "label"), "seq_id")).select(F.lit(name).alias("kernel"), "auc")
        out = part if out is None else out.unionByName(part)
    return out


def stringency(positives: DataFrame, make_scorer, settings: Iterable, top: int = 5) -> DataFrame:
    """(setting, feature, score): the most enriched features against each setting's background."""
    out = None
    for setting in settings:
        part = make_scorer(setting).fit(positives).top(top).select(F.lit(str(setting)).alias("setting"), "feature", "score")
        out = part if out is None else out.unionByName(part)
    return out
