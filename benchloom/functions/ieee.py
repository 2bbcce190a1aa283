"""Floating-point operations on columns as IEEE 754 has them; a null input gives null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def any_nan(*columns: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.isnan(c) for c in columns])


def is_finite(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(~F.isnan(c) & (F.abs(c) < INF))


def divide(a: Column, b: Column) -> Column:
    """True division; x/0 is infinite by the sign of x, 0/0 is not a number (the sign of a zero divisor is ignored)."""
    by_zero = F.when(F.isnan(a) | (a == 0), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def compare(op: str, a: Column, b: Column) -> Column:
    """Comparison; with not-a-number on a side only ``!=`` holds."""
    plain = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(any_nan(a, b), F.lit(op == "!=")).otherwise(plain)


def log(x: Column, base10: bool = False) -> Column:
    own = F.log10(F.when(x > 0, x)) if base10 else F.log(F.when(x > 0, x))
    return F.when(x.isNull(), F.lit(None).cast("double")).when(F.isnan(x) | (x < 0), NAN).when(x == 0, -INF).otherwise(own)


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def extreme(columns: list[Column], largest: bool) -> Column:
    """Element-wise minimum or maximum; null wins, then not-a-number."""
    none = reduce(lambda x, y: x | y, [c.isNull() for c in columns])
    best = (F.greatest if largest else F.least)(*columns) if len(columns) > 1 else columns[0]
    return F.when(none, F.lit(None).cast("double")).when(any_nan(*columns), NAN).otherwise(best)


def truth(c: Column) -> Column:
    """Non-zero is true, not-a-number too; null stays null."""
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(F.isnan(c) | (c != 0))


def holds(c: Column) -> Column:
    """Whether a row passes a filter: non-zero and a number, never null."""
    return F.coalesce((c != 0) & ~F.isnan(c), F.lit(False))


def round_even(c: Column, digits: int = 0) -> Column:
    """Half to even; infinite and not-a-number pass."""
    finite = F.when(is_finite(c), c)
    return F.when(c.isNull() | ~is_finite(c), c).otherwise(F.bround(finite, digits))
