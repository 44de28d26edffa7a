import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators.distance import DistanceKernel, Hamming, KERNEL_TRANSFORMS, Levenshtein, NeedlemanWunsch, SmithWaterman, read_matrix


def pair(spark, d, a, b):
    return d(a, b, spark)


def dynamic(a, b, match, mismatch, gap, local):
    rows = [[0 if local else gap * j for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        rows.append([0 if local else gap * i])
        for j, y in enumerate(b, 1):
            s = max(rows[i - 1][j - 1] + (match if x == y else mismatch), rows[i - 1][j] + gap, rows[i][j - 1] + gap)
            rows[i].append(max(0, s) if local else s)
    return max(map(max, rows)) if local else rows[-1][-1]


def test_known_values(spark):
    nw, sw = NeedlemanWunsch(), SmithWaterman()
    assert [pair(spark, nw, *x) for x in (("ACGT", "ACGT"), ("ACGT", "ACG"), ("AAAA", "TTTT"))] == [4, 2, -4]
    assert [pair(spark, sw, *x) for x in (("ACGT", "ACGT"), ("ACGT", "TTACGTTT"), ("AAAA", "TTTT"))] == [4, 4, 0]
    assert pair(spark, NeedlemanWunsch(gap=-4, substitution_matrix="NUC4.4"), "ACGT", "ACGT") == 20
    assert [pair(spark, NeedlemanWunsch(as_distance=True), "ACGT", x) for x in ("ACGT", "ACG")] == [0, 2]
    assert pair(spark, Hamming(), "ACGT", "ACGA") == 1 and pair(spark, Hamming(), "", "") == 0
    assert pair(spark, Levenshtein(), "", "ACG") == 3 and pair(spark, Levenshtein(bound=1), "AAAA", "TTTT") == -1


def test_alignments_against_dynamic_programming(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 14))) for _ in range(14)]
    df = spark.createDataFrame(list(enumerate(words)), "seq_id long, seq string")
    for make, local in ((NeedlemanWunsch, False), (SmithWaterman, True)):
        d = make(match=2, mismatch=-1, gap=-2)
        rows = d.cdist(df).collect()
        assert len(rows) == 196
        for r in rows:
            assert r.d == dynamic(words[r.a_id], words[r.b_id], 2, -1, -2, local)
        both = df.select(F.col("seq_id").alias("i"), F.col("seq").alias("a")).crossJoin(df.select(F.col("seq_id").alias("j"), F.col("seq").alias("b")))
        for r in both.select("i", "j", d.fold(F.col("a"), F.col("b")).alias("d")).collect():
            assert r.d == dynamic(words[r.i], words[r.j], 2, -1, -2, local)


def test_matrix_argument(spark):
    m = np.full((4, 4), -3.0)
    np.fill_diagonal(m, 2.0)
    assert pair(spark, NeedlemanWunsch(substitution_matrix=m), "ACG", "ACG") == 6
    with pytest.raises(ValueError):
        NeedlemanWunsch(substitution_matrix="BLOSUM62")


def test_pairs(spark):
    df = spark.createDataFrame([(0, "ACGT"), (1, "ACGA"), (2, "TTTT")], "seq_id long, seq string")
    assert {(r.a_id, r.b_id): r.d for r in Hamming().pdist(df).collect()} == {(0, 1): 1, (0, 2): 3, (1, 2): 4}
    with pytest.raises(Exception, match="unequal"):
        Hamming().cdist(df, df.select("seq_id", F.lit("A").alias("seq"))).collect()


def test_kernels(spark):
    df = spark.createDataFrame([(0, "ACGT"), (1, "ACGA")], "seq_id long, seq string")
    value = lambda t, **k: {(r.a_id, r.b_id): r.k for r in DistanceKernel(Hamming(), t, **k).kernel_matrix(df).collect()}[0, 1]
    assert value("rbf") == pytest.approx(math.exp(-1)) and value("cauchy") == 0.5 and value("linear") == -1
    assert value("exponential_clipped", radius=2) == 1
    assert value("poly", coef0=2, degree=2) == 1 and value("sigmoid", coef0=1) == 0
    assert value("laplacian") == value("exponential") == pytest.approx(math.exp(-1))
    assert len(KERNEL_TRANSFORMS) == 8
    with pytest.raises(ValueError):
        DistanceKernel(Hamming(), "x")


def test_broadcast_join_only(spark):
    df = spark.createDataFrame([(0, "ACGT"), (1, "ACGA")], "seq_id long, seq string")
    small = df.limit(2)
    for pairs in (Levenshtein().cdist(df, small), Levenshtein().cdist(small, df)):
        assert "CartesianProduct" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in Levenshtein().cdist(df)._jdf.queryExecution().executedPlan().toString()


def test_product_in_blocks(spark, monkeypatch):
    from strandloom.operators import distance

    df = spark.createDataFrame([(i, "ACGT" * (i % 5) + "TTG" * (i % 3), f"l{i}") for i in range(40)], "seq_id long, seq string, label string")
    want = sorted(map(tuple, Levenshtein().cdist(df.limit(25), df, keep=("label",)).collect())), sorted(map(tuple, Levenshtein().pdist(df).collect()))
    monkeypatch.setattr(distance, "BROADCAST_BYTES", 300)
    pairs = Levenshtein().cdist(df.limit(25), df, keep=("label",))
    assert "CartesianProduct" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert (sorted(map(tuple, pairs.collect())), sorted(map(tuple, Levenshtein().pdist(df).collect()))) == want


def test_matrix_from_text(spark):
    text = ["# made up", "   A  R  N", "A  4 -1 -2", "R -1  5  0", "N -2  0  6"]
    letters, scores = read_matrix(text)
    assert letters == "ARN" and scores[1, 1] == 5
    d = NeedlemanWunsch(gap=-3, substitution_matrix=(letters, scores))
    assert pair(spark, d, "ARN", "ARN") == 15 and pair(spark, d, "ARN", "AN") == 4 - 3 + 6
    with pytest.raises(ValueError):
        read_matrix(text[:-1])
