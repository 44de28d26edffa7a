import math

import pytest

from strandloom.functions.sequences import reverse_complement
from strandloom.functions.weights import mismatch_weights
from strandloom.operators.gkm import GKMKernel, WGKMKernel, WindowedGKMKernel, WindowedWGKMKernel

SIX = "ACGTACGTACGTACGTACGT TTTTAAAAGGGGCCCCAAAA ACGTTGCATGCATGCATGCA CCCCGGGGTTTTAAAACCCC ATATGCGCATATGCGCATAT GAATTCGAATTCGAATTCGA".split()
FOUR = "ACGTACGTACGTACGTACGTAC TTTTAAAAGGGGCCCCAAAATT ACGTTGCATGCATGCATGCATG CCCCGGGGTTTTAAAACCCCAG".split()
#: Golden similarities (L, k, d): {(i, j): value}; all other pairs are 0.
GOLDEN = {
    (6, 4, 1): {(3, 1): 0.2720756},
    (6, 4, 2): {(2, 0): 0.005990317, (3, 1): 0.2967457, (3, 2): 0.002457542, (4, 0): 0.01610381, (4, 1): 0.01214547, (4, 2): 0.07010734, (5, 0): 0.008594701, (5, 1): 0.01620527, (5, 2): 0.02109275, (5, 3): 0.01410399, (5, 4): 0.04733534},
    (8, 4, 1): {(3, 1): 0.1563858},
    (8, 4, 2): {(3, 1): 0.1731574, (5, 4): 0.03347857},
    (8, 4, 3): {(3, 1): 0.1871526, (4, 1): 0.00872988, (5, 2): 0.006542037, (5, 4): 0.06695713},
    (8, 6, 1): {(3, 1): 0.1324068},
    (8, 6, 2): {(3, 1): 0.137755, (5, 4): 0.005579761},
    (10, 4, 1): {},
    (10, 4, 2): {(3, 1): 0.0335578},
    (10, 4, 3): {(3, 1): 0.04578685},
    (10, 6, 1): {},
    (10, 6, 2): {(3, 1): 0.01626904},
    (10, 6, 3): {(3, 1): 0.01985754},
}


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")


def values(df, *by):
    return {tuple(r[c] for c in ("q_id", "r_id", *by)): r.k for r in df.collect()}


@pytest.mark.parametrize("params", list(GOLDEN))
def test_golden(spark, params):
    got = values(GKMKernel(*params, use_rc=True).set_references(frame(spark, SIX)).kernel())
    for i in range(6):
        for j in range(6):
            want = 1.0 if i == j else GOLDEN[params].get((max(i, j), min(i, j)), 0.0)
            assert got[i, j] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("strategy", ["neighbours", "blocks"])
def test_strategies_agree(spark, strategy):
    refs = frame(spark, SIX)
    want = values(GKMKernel(6, 4, 2, use_rc=True, strategy="broadcast").set_references(refs).kernel())
    got = values(GKMKernel(6, 4, 2, use_rc=True, strategy=strategy).set_references(refs).kernel())
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_weights():
    assert mismatch_weights(8, 5, 3)[:2] == [56.0, 21.0]
    assert mismatch_weights(10, 6, 3, "truncated") == pytest.approx([1.6959830601e-01, 5.5734808207e-02, 1.4950497891e-02, 2.7788987209e-03], rel=1e-9)
    assert mismatch_weights(10, 6, 3, "estimated_full") == pytest.approx([2.2412490845e-01, 5.8399200439e-02, 6.4888000488e-03, -2.1629333496e-03], rel=1e-9)
    assert mismatch_weights(6, 4, 2, "truncated") == pytest.approx([3.9319580793e-01, 1.1171936989e-01, 1.9553303719e-02], rel=1e-9)


def brute(a, b, L, w, d, rc, pa=lambda i: 1.0, pb=lambda i: 1.0):
    total = 0.0
    strands = [(b[j : j + L], pb(j)) for j in range(len(b) - L + 1)]
    if rc:
        strands += [(reverse_complement(x), p) for x, p in strands]
    for i in range(len(a) - L + 1):
        x = a[i : i + L]
        for y, p in strands:
            h = sum(s != t for s, t in zip(x, y, strict=True))
            if h <= d:
                total += w[h] * pa(i) * p
    return total


def test_position_weights_against_brute_force(spark):
    L, k, d = 5, 3, 2
    w = mismatch_weights(L, k, d)
    got = values(WGKMKernel(L, k, d, use_rc=True, weight_kernel="gaussian", weight_sigma=6).set_references(frame(spark, FOUR)).kernel(offsets=[-3, 2]), "center_idx")
    for n, off in enumerate((-3, 2)):
        p = lambda i, off=off: math.exp(-((i + 2 - 10.5 - off) ** 2) / 72)
        raw = {(i, j): brute(FOUR[i], FOUR[j], L, w, d, True, p, p) for i in range(4) for j in range(4)}
        for i in range(4):
            for j in range(4):
                assert got[i, j, n] == pytest.approx(raw[i, j] / math.sqrt(raw[i, i] * raw[j, j]), abs=1e-9)


def test_windows_against_brute_force(spark):
    L, k, d = 5, 3, 1
    w = mismatch_weights(L, k, d)
    got = values(WindowedGKMKernel(L, k, d, window=12, shift=6, padding=3).set_references(frame(spark, FOUR)).kernel(), "window_idx")
    spans = [(0, 9), (3, 15), (9, 21)]
    for n, (a, z) in enumerate(spans):
        parts = [s[a:z] for s in FOUR]
        raw = {(i, j): brute(parts[i], parts[j], L, w, d, False) for i in range(4) for j in range(4)}
        for i in range(4):
            for j in range(4):
                assert got[i, j, n] == pytest.approx(raw[i, j] / math.sqrt(raw[i, i] * raw[j, j]), abs=1e-9)


def test_scan_and_windowed_weights(spark):
    refs = frame(spark, FOUR)
    scan = values(GKMKernel(5, 3, 1).set_references(refs).sliding_window_query_kernel(refs, window=22, shift=1), "window_idx")
    whole = values(GKMKernel(5, 3, 1).set_references(refs).kernel())
    assert {k[:2]: v for k, v in scan.items()} == pytest.approx(whole)
    for legacy in (False, True):
        got = values(WindowedWGKMKernel(5, 3, 1, window=12, shift=5, weight_kernel="cauchy", weight_sigma=4, legacy_center=legacy).set_references(refs).kernel(), "window_idx")
        assert all(got[i, i, n] == pytest.approx(1) for i in range(4) for n in range(3))
        assert all(got[i, j, n] == pytest.approx(got[j, i, n]) for i in range(4) for j in range(4) for n in range(3))


def test_errors(spark):
    for bad in (dict(L=1), dict(L=13), dict(k=11), dict(d=5), dict(kernel_type="x"), dict(transform="x")):
        with pytest.raises(ValueError):
            GKMKernel(**bad)
    with pytest.raises(RuntimeError):
        GKMKernel().kernel()
    with pytest.raises(ValueError):
        GKMKernel().set_references(frame(spark, []).limit(0))
    with pytest.raises(ValueError):
        GKMKernel().set_references(frame(spark, ["ACGT"]))
    with pytest.raises(ValueError):
        WGKMKernel(weight_peak=0)
    with pytest.raises(ValueError):
        WindowedGKMKernel(window=5, shift=1)
    with pytest.raises(ValueError):
        WGKMKernel(4, 3, 1).set_references(frame(spark, ["ACGTACGT", "ACGTA"])).kernel()
    with pytest.raises(NotImplementedError):
        WGKMKernel().sliding_window_query_kernel()
    with pytest.raises(NotImplementedError):
        WindowedWGKMKernel(5, 3, 1, window=12, shift=5).kernel(X_query=frame(spark, FOUR))
    with pytest.raises(Exception, match="shorter"):
        GKMKernel(6, 4, 1).set_references(frame(spark, SIX)).kernel(X_query=frame(spark, ["ACG"])).collect()


def test_lower_case_is_accepted(spark):
    assert values(GKMKernel(6, 4, 1).set_references(frame(spark, [s.lower() for s in SIX])).kernel()) == values(GKMKernel(6, 4, 1).set_references(frame(spark, SIX)).kernel())


@pytest.mark.parametrize("entries", [900, 20_000])
def test_blocks_of_references_agree(spark, monkeypatch, entries):
    """References in blocks, by dense tables through transforms or sparse ones, give what one table gives."""
    from strandloom.operators import gkm

    refs = frame(spark, SIX + [reverse_complement(s) for s in SIX])
    for use_rc in (False, True):
        want = values(GKMKernel(4, 2, 2, use_rc=use_rc).set_references(refs).kernel())
        monkeypatch.setattr(gkm, "BLOCK_ENTRIES", entries)
        monkeypatch.setattr(gkm, "RESULT_ROWS", 30)
        kernel = GKMKernel(4, 2, 2, use_rc=use_rc, strategy="broadcast").set_references(refs)
        got = values(kernel.kernel())
        monkeypatch.undo()
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_weighted_cross(spark):
    """Queries that are the references give the self kernel; a slice of offsets is a centre each."""
    refs, weighted = frame(spark, FOUR), WGKMKernel(6, 4, 1, weight_kernel="gaussian", weight_sigma=6, use_rc=True)
    own = values(weighted.set_references(refs).kernel())
    cross = values(weighted.kernel(X_query=refs))
    assert own.keys() == cross.keys() and all(cross[k] == pytest.approx(own[k]) for k in own)
    many = values(weighted.kernel(offsets=slice(2, 9, 3)), "center_idx")
    assert {c for _, _, c in many} == {0, 1, 2}
