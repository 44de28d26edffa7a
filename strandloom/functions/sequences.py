"""Functions on nucleotide strings: Column expressions, and their scalar twins for driver code.

Strict functions take upper-case A, C, G, T; a k-mer's code has two bits a base, the first
base highest.  A null sequence or a letter outside the alphabet raises at run time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ACGT"
IUPAC_ALPHABET = "ACGTRYSWKMBDHVN"
#: The complement of each letter of IUPAC_ALPHABET.
IUPAC_COMPLEMENT = "TGCAYRSWMKVHDBN"
_COMPLEMENT = str.maketrans(IUPAC_ALPHABET, IUPAC_COMPLEMENT)
#: Bases as the digits of a base-four numeral, and back.
_TO_DIGITS, _TO_BASES = str.maketrans(ALPHABET, "0123"), str.maketrans("0123", ALPHABET)


# --- scalar: a k-mer is a base-four numeral ----------------------------------


def _letters(s: str | bytes, alphabet: str) -> str:
    text = str(s, "ascii") if isinstance(s, bytes) else s
    if bad := sorted(set(text).difference(alphabet)):
        raise ValueError(f"letters outside {alphabet}: {bad}")
    return text


def _numeral(code: int, k: int) -> str:
    """The last k base-four digits of a code."""
    return np.base_repr(code % 4**k, 4).zfill(k)


def kmer_to_code(kmer: str | bytes) -> int:
    return int(_letters(kmer, ALPHABET).translate(_TO_DIGITS) or "0", 4)


def code_to_kmer(code: int, k: int) -> str:
    if k < 1:
        raise ValueError("k must be 1 or more")
    return _numeral(code, k).translate(_TO_BASES)


def packed_rc(code: int, k: int) -> int:
    """The digits' complements to 3, which is a subtraction from the largest numeral, read backwards."""
    return int(_numeral(4**k - 1 - code % 4**k, k)[::-1], 4) if k else 0


def canonical_code(code: int, k: int) -> int:
    return min(code, packed_rc(code, k))


def reverse_complement(seq: str | bytes) -> str | bytes:
    turned = _letters(seq, IUPAC_ALPHABET)[::-1].translate(_COMPLEMENT)
    return turned.encode() if isinstance(seq, bytes) else turned


def iterate_kmers(seq: str | bytes, k: int) -> Iterator[str]:
    """Windows of k letters, as k shifted readings of the sequence side by side."""
    text = str(seq, "ascii") if isinstance(seq, bytes) else seq
    return map("".join, zip(*(itertools.islice(text, i, None) for i in range(k)), strict=False))


def kmer_is_canonical(kmer: str | bytes) -> bool:
    return min(kmer, reverse_complement(kmer)) == kmer


# --- columns ----------------------------------------------------------------


def checked(seq: Column, alphabet: str = ALPHABET) -> Column:
    """``seq`` itself; raises on null and on letters outside the alphabet.  Binary columns are decoded."""
    text = seq.cast("string")
    return (
        F.when(text.isNull(), F.raise_error(F.lit("a sequence is null")).cast("string"))
        .when(text.rlike(f"^[{alphabet}]*$"), text)
        .otherwise(F.raise_error(F.concat(F.lit(f"a sequence has letters outside {alphabet}: "), F.substring(text, 1, 40))).cast("string"))
    )


def dna_letters(text: Column) -> Column:
    """The letters a, c, g, t of a text, in upper case: a sequence from any text."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^acgt]", ""))


def col_code(kmer: Column) -> Column:
    return F.conv(F.translate(kmer, ALPHABET, "0123"), 4, 10).cast("long")


def col_kmer(code: Column, k: int) -> Column:
    if k < 1:
        raise ValueError("k must be 1 or more")
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", ALPHABET)


def col_reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, IUPAC_ALPHABET, IUPAC_COMPLEMENT))


def col_packed_rc(code: Column, k: int) -> Column:
    """Each base complemented and the order of bases turned round, on the packed code."""
    terms = [F.shiftleft(F.lit(3) - F.shiftright(code, 2 * i).bitwiseAND(F.lit(3)), 2 * (k - 1 - i)) for i in range(k)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out.cast("long")


def col_canonical_code(code: Column, k: int) -> Column:
    return F.least(code, col_packed_rc(code, k))


def col_is_canonical(kmer: Column) -> Column:
    return kmer <= col_reverse_complement(kmer)


def col_kmers(seq: Column, k: int) -> Column:
    """All windows of k letters, in order; one pass over the string."""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def mismatches(a: Column, b: Column) -> Column:
    """Different bases of two packed codes."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def window_starts(length: Column, window: int, shift: int, pad_left: int = 0, pad_right: int = 0) -> Column:
    """(idx, first, stop) of sliding windows over a padded length, clipped to it; empty if none fits."""
    n = F.floor((length + (pad_left + pad_right - window)) / shift).cast("int")
    idx = F.when(length + (pad_left + pad_right) >= window, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        idx,
        lambda i: F.struct(
            i.alias("idx"),
            F.greatest(F.lit(0), i * shift - pad_left).cast("int").alias("first"),
            F.least(length, i * shift - pad_left + window).cast("int").alias("stop"),
        ),
    )
