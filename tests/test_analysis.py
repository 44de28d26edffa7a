import numpy as np
import pytest

from strandloom.operators import analysis
from strandloom.operators.gkm import GKMKernel
from strandloom.operators.models import KernelSVM


def test_linkage_against_brute_force(spark):
    rng = np.random.default_rng(2)
    points = rng.random((12, 2))
    d = np.sqrt(((points[:, None] - points) ** 2).sum(axis=2))
    rows = [(i * 10, j * 10, float(d[i, j])) for i in range(12) for j in range(i + 1, 12)]
    got = analysis.average_linkage(spark.createDataFrame(rows, "a_id long, b_id long, d double"))
    groups, want = {i: [i] for i in range(12)}, []
    for step in range(11):
        height, a, b = min((np.mean([d[i, j] for i in groups[x] for j in groups[y]]), x, y) for x in groups for y in groups if x < y)
        want.append((a, b, height, len(groups[a]) + len(groups[b])))
        groups[12 + step] = groups.pop(a) + groups.pop(b)
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want]
    assert [h for *_, h, _ in got] == pytest.approx([h for *_, h, _ in want])
    with pytest.raises(ValueError):
        analysis.average_linkage(spark.createDataFrame(rows, "a_id long, b_id long, d double"), max_rows=5)


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(3)
    score, label = rng.integers(0, 12, 80).astype(float), rng.integers(0, 2, 80)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label, strict=True)], "decision double, label int")
    pairs = [(a > b) + 0.5 * (a == b) for a in score[label == 1] for b in score[label == 0]]
    assert analysis.auc(df).first()[0] == pytest.approx(np.mean(pairs))
    assert analysis.auc(df.where("label = 1")).first()[0] is None


def test_scan_of_a_model(spark):
    """The motif's windows score best, and each score is the model's decision for that window."""
    motif = "GATTACAGATTACA"
    train = [(i, ("ACGT" * i)[:6] + (motif if i % 2 else "CCTTCCGGTTCCGG") + "ACGTTGCA"[: i % 5], i % 2) for i in range(16)]
    model = KernelSVM(GKMKernel(6, 4, 2), C=5.0).fit(spark.createDataFrame(train, "seq_id long, seq string, label int"))
    long = "CCTTCCGGTTCCGGTTAACCGG" + motif + "TTCCGGAACCTTGGCC"
    scores = analysis.svm_scan(model, spark.createDataFrame([(1, long)], "seq_id long, seq string"), window=14, shift=2)
    got = {r.window_idx: r.score for r in scores.collect()}
    pieces = spark.createDataFrame([(i, long[2 * i : 2 * i + 14]) for i in got], "seq_id long, seq string")
    want = {r.seq_id: r.decision for r in model.decision_function(pieces).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in got)
    assert analysis.peaks(scores).first().window_idx == 11
    grid = analysis.kernel_grid(spark.createDataFrame(train[:10], "seq_id long, seq string, label int"), spark.createDataFrame(train[10:], "seq_id long, seq string, label int"), [("plain", GKMKernel(6, 4, 2)), ("rbf", GKMKernel(6, 4, 2, transform="rbf"))])
    assert {r.kernel: r.auc for r in grid.collect()} == {"plain": 1.0, "rbf": 1.0}
