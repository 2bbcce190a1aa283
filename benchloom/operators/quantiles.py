"""Exact order statistics of groups of any size: a sketch brackets the ranks, one counting pass decides.

Spark's approximate percentiles are within a known share of ranks. The values between them, some ten-thousandths of a group,
are counted by value, all smaller ones as one; a running sum over these counts finds the value at the rank. Both passes combine
before they shuffle, so no task holds or sorts a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's error is 1/ACCURACY of a group's rows at most.
ACCURACY = 10_000


def nearest(q: float) -> Callable[[Column], Column]:
    """The rank nearest to the share ``q`` of n values, halves up."""
    return lambda n: F.floor((n - 1) * q + 0.5)


def lower_half(n: Column) -> Column:
    return F.floor((n - 1) / 2)


def upper_half(n: Column) -> Column:
    return F.floor(n / 2)


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """keys, n and by name the value at a rank (from 0) of each group's sorted values, nulls left out.

    ``ranks``: a share and the rank near that share, as a function of n.
    """
    values = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    # The sketch's own error, one rank beside the share (groups of fewer than ACCURACY rows are counted whole), and one to spare.
    margin = 3.0 / ACCURACY
    shares = sorted({min(1.0, max(0.0, q + e)) for q, _ in ranks.values() for e in (-margin, margin)})
    n = values.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("__v", shares, ACCURACY).alias("__e"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    near = {q: F.col("__e")[i] for i, q in enumerate(shares)}
    small = F.col("n") <= ACCURACY
    low = {q: F.when(small, F.col("__min")).otherwise(near[max(0.0, q - margin)]) for q, _ in ranks.values()}
    high = {q: F.when(small, F.col("__max")).otherwise(near[min(1.0, q + margin)]) for q, _ in ranks.values()}
    inside = F.lit(False)
    for q in low:
        inside = inside | F.col("__v").between(low[q], high[q])
    top = F.greatest(*high.values()) if len(high) > 1 else next(iter(high.values()))
    # Values between two brackets count, with those below the first, at the bracket they precede.
    next_edge = F.array_min(F.array(*[F.when(e > F.col("__v"), e) for e in low.values()]))
    met = values.join(n, keys).filter(F.col("__v") <= top)
    counts = met.select(*keys, "n", F.when(inside, F.col("__v")).otherwise(next_edge).alias("__at"), (~inside).alias("__below")).groupBy(*keys, "n", "__at", "__below").agg(F.count("*").alias("__c"))
    so_far = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__at", F.desc("__below")))
    placed = counts.withColumn("__to", so_far).filter(~F.col("__below"))
    found = {name: F.max(F.when((F.col("__to") > rank(F.col("n"))) & (F.col("__to") - F.col("__c") <= rank(F.col("n"))), F.col("__at"))).alias(name) for name, (_, rank) in ranks.items()}
    return placed.groupBy(*keys, "n").agg(*found.values())


def medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and the median of each group."""
    both = at_ranks(df, keys, value, {"__low": (0.5, lower_half), "__high": (0.5, upper_half)})
    return both.select(*keys, ((F.col("__low") + F.col("__high")) / 2).alias(name))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and by name the percentile at a share (0 to 1) of each group, linear between the two nearest ranks."""
    at = lambda q: lambda n: (n - 1) * q
    below = {f"__b{i}": (q, lambda n, q=q: F.floor(at(q)(n))) for i, q in enumerate(shares.values())}
    above = {f"__a{i}": (q, lambda n, q=q: F.ceil(at(q)(n))) for i, q in enumerate(shares.values())}
    found = at_ranks(df, keys, value, below | above)

    def between(i: int, q: float) -> Column:
        low, high, part = F.col(f"__b{i}").cast("double"), F.col(f"__a{i}").cast("double"), at(q)(F.col("n")) - F.floor(at(q)(F.col("n")))
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part)

    return found.select(*keys, *[between(i, q).alias(name) for i, (name, q) in enumerate(shares.items())])
