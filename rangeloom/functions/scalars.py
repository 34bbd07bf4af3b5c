"""Scalar helpers as column expressions on longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_pow2(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)


def floor_log2(x: Column) -> Column:
    """The highest set bit's place; null for values under 1."""
    return F.when(x >= 1, F.length(F.bin(x)) - 1).cast("int")


def next_pow2(x: Column) -> Column:
    """The smallest power of two that isn't smaller; 0 stays 0."""
    return F.when(x <= 0, F.lit(0)).when(x == 1, F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (floor_log2(x - 1) + 1).cast("int"))).cast("long")


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def median9(values: list[Column]) -> Column:
    """The median of three medians of three."""
    return median3(*(median3(*values[i : i + 3]) for i in (0, 3, 6)))


def coprime(n: int) -> int:
    """The largest number below n without a common divisor; 1 for n under 3."""
    import math

    return next((k for k in range(n - 1, 1, -1) if math.gcd(k, n) == 1), 1)


def xorshift(state: Column) -> Column:
    """The next state of a 64-bit xorshift generator (shifts 13, 7, 17)."""
    x = state.bitwiseXOR(F.shiftleft(state, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def stringify(*parts) -> Column:
    """The parts as one string."""
    return F.concat(*((p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts))
