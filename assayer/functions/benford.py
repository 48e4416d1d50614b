"""Generalised Benford law, first digits and divergences as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..constants import EPS, RENYI_ALPHA, TSALLIS_Q


def benford_share(digit: Column, base) -> Column:
    """Expected share of a first digit in a base (number or column)."""
    b = F.lit(float(base)) if isinstance(base, int) else base.cast("double")
    if isinstance(base, int) and base < 3:
        raise ValueError("the base must be at least 3")
    return F.log(F.lit(1.0) + F.lit(1.0) / digit) / F.log(b)


def first_digit(value: Column, base: Column) -> Column:
    """First significant digit in a base; NULL for zero."""
    v, b = F.abs(value.cast("double")), base.cast("double")
    d = F.floor(v / F.pow(b, F.floor(F.log(v) / F.log(b))))
    return F.when(v != 0, F.greatest(F.lit(1), F.least(base.cast("bigint") - 1, d)).cast("int"))


# A divergence between observed p and expected q is a sum of per-digit terms and
# a closing formula. ``term`` works on columns, ``number`` on plain numbers.

def _js(p: Column, q: Column) -> Column:
    m = F.lit(0.5) * (p + q)
    return F.lit(0.5) * (p * F.log2(p / m) + q * F.log2(q / m))


def _js_number(p: float, q: float) -> float:
    m = 0.5 * (p + q)
    return 0.5 * (p * math.log2(p / m) + q * math.log2(q / m))


class Divergence:
    """A named divergence that can be summed over the digits that occur."""

    def __init__(self, term, number, close):
        self.term, self.number, self.close = term, number, close

    def unseen(self, base: int) -> float:
        """Total of the terms of all digits as if none had occurred."""
        return sum(self.number(EPS, max(EPS, math.log(1 + 1 / d) / math.log(base)))
                   for d in range(1, base))


def _power(order: float, name: str):
    if order <= 0 or abs(order - 1.0) < 1e-9:
        raise ValueError(f"{name} order must be positive and not 1")
    return (lambda p, q: F.pow(p, F.lit(order)) * F.pow(q, F.lit(1.0 - order)),
            lambda p, q: p ** order * q ** (1.0 - order))


def jensen_shannon() -> Divergence:
    return Divergence(_js, _js_number, lambda total: total)


def renyi(alpha: float = RENYI_ALPHA) -> Divergence:
    term, number = _power(alpha, "Renyi")
    return Divergence(term, number,
                      lambda t: F.log(F.greatest(t, F.lit(EPS))) / F.lit(alpha - 1.0))


def tsallis(q_order: float = TSALLIS_Q) -> Divergence:
    term, number = _power(q_order, "Tsallis")
    return Divergence(term, number, lambda t: (t - F.lit(1.0)) / F.lit(q_order - 1.0))


# Registry: add a divergence here to make it available to the feature jobs.
REGISTRY = {"jensen_shannon": jensen_shannon(), "renyi": renyi(), "tsallis": tsallis()}


def clipped(share: Column) -> Column:
    return F.greatest(share, F.lit(EPS))
