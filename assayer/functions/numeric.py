"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``; NULL when the denominator is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def nan_to_null(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def blank_to_null(text: Column) -> Column:
    """CSV cell to DOUBLE; blank, ``nan`` and infinite cells stay missing."""
    value = F.nullif(F.trim(text), F.lit("")).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


# Rational approximation of erfc with fractional error below 1.2e-7
# (Numerical Recipes), highest power first.
_ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807,
         -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def two_sided_p(z: Column) -> Column:
    """Two-sided normal tail probability ``2 * (1 - Phi(|z|))``."""
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    poly = F.lit(_ERFC[0])
    for c in _ERFC[1:]:
        poly = poly * t + F.lit(c)
    return t * F.exp(-x * x + poly)
