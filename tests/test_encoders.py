from collections import Counter
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.functions.sequences import reverse_complement
from strandloom.operators.encoders import GappyEncoder, MismatchEncoder, SpectrumEncoder, generate_masks

SEQS = ["ACGTACGT", "AAAATTTT", "GCGCAATTGCGC", "AC", "", "AAAAAAAAAA", "ACGTACGT"]


def counted(spark, encoder, seqs):
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    out = [Counter() for _ in seqs]
    for r in encoder.fit_transform(df).collect():
        out[r.seq_id][r.feature] = r.cnt
        assert encoder.get_feature_names_out()[r.col] == r.feature
    return out


def brute(seq, k):
    return Counter(seq[i : i + k] for i in range(len(seq) - k + 1))


def test_spectrum_is_counting(spark):
    assert counted(spark, SpectrumEncoder(3), SEQS) == [brute(s, 3) for s in SEQS]
    assert SpectrumEncoder(3).n_features_ == 64


def test_canonical(spark):
    got = counted(spark, SpectrumEncoder(4, canonical_rc=True), SEQS)
    for seq, bag in zip(SEQS, got, strict=True):
        want = Counter()
        for k, n in brute(seq, 4).items():
            want[min(k, reverse_complement(k))] += n
        assert bag == want
    assert got[1]["AAAA"] == 2 and got[2]["AATT"] == 1
    assert SpectrumEncoder(4, canonical_rc=True).n_features_ == 136


def test_short_sequences_are_not_validated_long_ones_are(spark):
    assert counted(spark, SpectrumEncoder(4), ["NN", "ACGT"])[0] == Counter()
    with pytest.raises(Exception, match="ACGT"):
        counted(spark, SpectrumEncoder(2), ["ACNT"])
    with pytest.raises(Exception, match="null"):
        counted(spark, SpectrumEncoder(2), [None])


@pytest.mark.parametrize("k,m", [(3, 0), (3, 1), (4, 2)])
def test_mismatch(spark, k, m):
    got = counted(spark, MismatchEncoder(k, m), SEQS)
    for seq, bag in zip(SEQS, got, strict=True):
        want = Counter()
        for x, n in brute(seq, k).items():
            for y in map("".join, product("ACGT", repeat=k)):
                if sum(a != b for a, b in zip(x, y, strict=True)) <= m:
                    want[y] += n
        assert bag == want


def test_mismatch_totals_and_canonical_modes(spark):
    assert sum(counted(spark, MismatchEncoder(4, 1), ["ACGTACGT"])[0].values()) == 65
    assert sum(counted(spark, MismatchEncoder(4, 2), ["ACGTAC"])[0].values()) == 201
    assert counted(spark, MismatchEncoder(4, 0, canonical_rc=True), ["AAAATTTT"])[0]["AAAA"] == 2
    assert counted(spark, MismatchEncoder(4, 0, canonical_rc=True, legacy_drop=True), ["AAAATTTT"])[0]["AAAA"] == 1


def test_masks():
    assert generate_masks(4, 4, 1, 2) == ["*-**", "**-*", "*--*"]
    assert generate_masks(3, 4, 1, 1) == ["*-*", "*-**", "**-*"]
    for bad in ([""], ["-*"], ["*x*"], ["*" * 16], ["*" + "-" * 32 + "*"], []):
        with pytest.raises(ValueError):
            GappyEncoder(bad)


def test_gappy(spark):
    e = GappyEncoder(["*--*", "**"])
    assert e.n_features_ == 32
    got = counted(spark, e, SEQS)
    for seq, bag in zip(SEQS, got, strict=True):
        want = Counter("*--*_" + seq[i] + seq[i + 3] for i in range(len(seq) - 3)) + Counter("**_" + seq[i : i + 2] for i in range(len(seq) - 1))
        assert bag == want
    assert GappyEncoder(L=4, g_min=1, g_max=1).n_features_ == 128
    assert GappyEncoder(["**-*", "*-**"], canonical_rc=True).masks == ["**-*"]


def test_vectors_keep_empty_sequences(spark):
    df = spark.createDataFrame(list(enumerate(SEQS)), "seq_id long, seq string")
    rows = {r.seq_id: r.features for r in SpectrumEncoder(3).vectors(df).collect()}
    assert len(rows) == len(SEQS) and rows[3].numNonzeros() == 0 and rows[0].toArray().sum() == 6


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ACGT", max_size=40), min_size=1, max_size=6))
def test_spectrum_property(spark, seqs):
    assert counted(spark, SpectrumEncoder(2), seqs) == [brute(s, 2) for s in seqs]


@pytest.mark.parametrize("make", [lambda: SpectrumEncoder(0), lambda: SpectrumEncoder(13), lambda: MismatchEncoder(3, 4), lambda: GappyEncoder()])
def test_parameters(make):
    with pytest.raises(ValueError):
        make()


@pytest.mark.parametrize("encoder", [SpectrumEncoder(3), SpectrumEncoder(3, canonical_rc=True), MismatchEncoder(3, 1), GappyEncoder(L=2, g_max=1)])
def test_arrays_and_vectors_are_the_rows(spark, encoder):
    df = spark.createDataFrame([(1, "ACGTACGTTT"), (2, "AC"), (3, ""), (4, "TTTTTT")], "seq_id long, seq string")
    want = {}
    for r in encoder.fit(df).transform(df).collect():
        want.setdefault(r.seq_id, {})[r.col] = r.cnt
    got = {r.seq_id: dict(zip(r.cols, r.cnts, strict=True)) for r in encoder.arrays(df).collect()}
    assert got == {i: want.get(i, {}) for i in (1, 2, 3, 4)}
    assert all(list(r.cols) == sorted(r.cols) for r in encoder.arrays(df).collect())
    assert "Exchange" not in encoder.vectors(df)._jdf.queryExecution().executedPlan().toString()
    assert {r.seq_id: dict(zip(r.features.indices.tolist(), r.features.values.astype(int).tolist(), strict=True)) for r in encoder.vectors(df).collect()} == got
