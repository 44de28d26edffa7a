"""Mismatch weights and positional weights of the gapped k-mer kernels."""

from __future__ import annotations

from collections.abc import Callable
from math import comb, prod

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMES = ("full", "truncated", "estimated_full")
POSITIONAL = ("triangular", "epanechnikov", "gaussian", "laplacian", "cauchy")
TRANSFORMS = (None, "linear", "rbf", "poly", "sigmoid", "exponential", "exponential_clipped")
_BASES = 4


def _filter_values(L: int, k: int) -> list[float]:
    """f[m] of the estimated count filter, for m mismatches.

    With S(i) the number of L-mers within i changes, the coefficient of i shared changes is
    S(k - i) times the product of (k - j - L) / (k - j) for j < i, over C(L, k) * 4**L.
    """
    within = [sum(comb(L, j) * (_BASES - 1) ** j for j in range(i + 1)) for i in range(k + 1)]
    shared = [within[k - i] * prod((k - j - L) / (k - j) for j in range(i)) / (comb(L, k) * _BASES**L) for i in range(k + 1)]
    return [sum(shared[i] * comb(L - m, k - i) * comb(m, i) for i in range(min(m, k) + 1)) for m in range(L + 1)]


def mismatch_weights(L: int, k: int, d: int, scheme: str = "full") -> list[float]:
    """Weights of 0 to d mismatches."""
    if scheme not in SCHEMES:
        raise ValueError(f"unknown weight scheme {scheme!r}")
    if scheme == "full":
        return [float(comb(L - m, k)) for m in range(d + 1)]
    f = _filter_values(L, k)
    if scheme == "truncated":
        first = next((m for m, x in enumerate(f) if x < 1e-50), len(f))
        f = [x if m < first else 0.0 for m, x in enumerate(f)]
    out = []
    for h in range(d + 1):
        same, total = L - h, 0.0
        # t changes at the agreeing places; m1 - t and m2 - t at the others, r of them to a third letter.
        for t in range(same + 1):
            for a in range(h + 1):
                for r in range(a + 1):
                    b = h + r - a
                    if b < 0 or t + b > L:
                        continue
                    ways = comb(same, t) * comb(h, a) * comb(a, r) * (_BASES - 1) ** t * (_BASES - 2) ** r
                    total += ways * f[t + a] * f[t + b]
        out.append(total)
    return out


def positional_weight(kind: str, distance: Column, gamma: float = 1.0, sigma: float = 50.0) -> Column:
    """Weight of a place at a distance from the centre."""
    d = F.abs(distance)
    makers: dict[str, Callable[[], Column]] = {
        "triangular": lambda: F.greatest(F.lit(0.0), 1 - d / sigma),
        "epanechnikov": lambda: F.greatest(F.lit(0.0), 1 - d * d / (sigma * sigma)),
        "gaussian": lambda: F.exp(-(d * d) / (2 * sigma * sigma)),
        "laplacian": lambda: F.exp(-gamma * d),
        "cauchy": lambda: 1 / (1 + d * d / (sigma * sigma)),
    }
    if kind not in makers:
        raise ValueError(f"unknown positional kernel {kind!r}")
    return makers[kind]()


def transformed(value: Column, kind: str | None, gamma: float = 1.0, coef0: float = 0.0, degree: float = 3.0, radius: float = 0.0) -> Column:
    """The post-transform of a kernel value."""
    makers: dict[str | None, Callable[[], Column]] = {
        None: lambda: value,
        "linear": lambda: value,
        "rbf": lambda: F.exp(gamma * (value - 1)),
        "poly": lambda: F.pow(gamma * value + coef0, F.lit(float(degree))),
        "sigmoid": lambda: F.tanh(gamma * value + coef0),
        "exponential": lambda: F.exp(-gamma * ((1 - value) - radius)),
        "exponential_clipped": lambda: F.exp(-gamma * F.greatest(F.lit(0.0), (1 - value) - radius)),
    }
    if kind not in makers:
        raise ValueError(f"unknown transform {kind!r}")
    return makers[kind]()
