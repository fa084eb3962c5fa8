"""Column functions: rounding to narrower floats, vector arithmetic, clamping, portable random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fp16(x: Column) -> Column:
    """The double nearest to x among IEEE half-precision values, ties to even; infinite from 65520 on. No -0."""
    size = F.abs(x)
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.when(size > 0, size))), F.lit(-14)) - 10)
    return (
        F.when(F.isnan(x) | (size == 0), F.abs(x))
        .when(size >= 65520, F.when(x > 0, float("inf")).otherwise(float("-inf")))
        .otherwise(F.rint(x / step) * step + 0.0)
    )


def fp32(x: Column) -> Column:
    """The double nearest to x among single-precision values."""
    return x.cast("float").cast("double")


CASTS = {"f64": lambda x: x.cast("double"), "f32": fp32, "f16": fp16}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def in_range(x: Column, low: float, high: float) -> Column:
    return x.between(low, high)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rounded(x: Column, digits: int = 4) -> Column:
    """Rounded, and 0 rather than -0."""
    return F.round(x, digits) + 0.0


def hashed(i: Column, seed: int) -> Column:
    """A portable pseudo-random number in 0..2**31-1 for a number: two steps of a linear congruence, in 64-bit integers."""
    x = (i % 2147483648 * 1103515245 + 12345 + seed * 7919) % 2147483648
    return ((x + F.floor(x / 65536)).cast("long") % 2147483648 * 1103515245 + 12345) % 2147483648


def uniform(i: Column, low: float, high: float, seed: int) -> Column:
    """Uniform doubles in [low, high) by ``hashed``."""
    return F.lit(low) + F.lit(high - low) * (hashed(i, seed).cast("double") / 2147483648.0)
