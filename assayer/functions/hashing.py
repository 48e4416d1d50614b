"""Seeded draws from md5, portable across engines and stable across retries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

TWO32 = 4294967296.0


def seeded_md5(seed, *parts) -> Column:
    """md5 of ``seed|part|part`` as 32 hex characters."""
    pieces = [F.lit(str(seed))] + [F.col(p).cast("string") if isinstance(p, str)
                                   else p.cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *pieces))


def hex_number(md5_hex: Column, start: int = 1, digits: int = 8) -> Column:
    """A run of hex digits as BIGINT."""
    return F.conv(F.substring(md5_hex, start, digits), 16, 10).cast("bigint")


def uniform(md5_hex: Column, start: int = 1) -> Column:
    """Uniform draw in (0, 1) from eight hex digits."""
    return (hex_number(md5_hex, start) + F.lit(0.5)) / F.lit(TWO32)


def gaussian(md5_hex: Column) -> Column:
    """Standard normal draw by the Box-Muller transform of two uniforms."""
    u1, u2 = uniform(md5_hex, 1), uniform(md5_hex, 9)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def all_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags)
