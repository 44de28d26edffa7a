import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequences as sq


def test_scalar_codes():
    assert sq.kmer_to_code("ACGT") == 0b00011011
    assert sq.code_to_kmer(27, 4) == "ACGT"
    assert sq.reverse_complement("AACG") == "CGTT"
    assert sq.reverse_complement(b"ARN") == b"NYT"
    assert sq.canonical_code(sq.kmer_to_code("TTTT"), 4) == 0
    assert list(sq.iterate_kmers("ACGT", 3)) == ["ACG", "CGT"]
    assert list(sq.iterate_kmers("AC", 3)) == []
    assert sq.kmer_is_canonical(b"ACGT") and not sq.kmer_is_canonical("TTT")


@pytest.mark.parametrize("bad", [lambda: sq.kmer_to_code("ACN"), lambda: sq.code_to_kmer(0, 0), lambda: sq.reverse_complement("acgt")])
def test_scalar_errors(bad):
    with pytest.raises(ValueError):
        bad()


def test_columns_agree_with_scalars(spark):
    kmers = ["ACGTAC", "TTTTTT", "GATTAC", "CCCGGG"]
    df = spark.createDataFrame([(k,) for k in kmers], "k string")
    code = sq.col_code(F.col("k"))
    rows = df.select("k", code.alias("c"), sq.col_packed_rc(code, 6).alias("r"), sq.col_canonical_code(code, 6).alias("m"), sq.col_kmer(code, 6).alias("b"), sq.col_is_canonical(F.col("k")).alias("i")).collect()
    for r in rows:
        c = sq.kmer_to_code(r.k)
        assert (r.c, r.r, r.m, r.b, r.i) == (c, sq.packed_rc(c, 6), sq.canonical_code(c, 6), r.k, sq.kmer_is_canonical(r.k))


def test_kmers_and_windows(spark):
    df = spark.createDataFrame([("ACGTA",), ("AC",), ("",)], "s string")
    assert [r[0] for r in df.select(sq.col_kmers(F.col("s"), 3)).collect()] == [["ACG", "CGT", "GTA"], [], []]
    cases = [(22, 12, 4, 0, 0, 3), (22, 12, 4, 0, 2, 4), (22, 12, 6, 0, 0, 2), (22, 12, 6, 3, 3, 3), (22, 12, 6, -2, -2, 2), (40, 10, 5, 0, 0, 7), (44, 20, 10, 0, 0, 3), (5, 10, 5, 0, 0, 0)]
    for n, w, s, left, right, expected in cases:
        spans = spark.range(1).select(sq.window_starts(F.lit(n), w, s, left, right)).first()[0]
        assert len(spans) == expected
        assert all(0 <= x["first"] <= x["stop"] <= n for x in spans)


@pytest.mark.parametrize("bad", ["ACGN", "acgt", None])
def test_checked_raises(spark, bad):
    with pytest.raises(Exception, match="sequence"):
        spark.createDataFrame([(bad,)], "s string").select(sq.checked(F.col("s"))).collect()
