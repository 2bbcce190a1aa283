"""Median and MAD of centred time windows: one sorted window that takes a row and gives one back.

Rows of a group are dealt to blocks of time, each with the rows within half a window of it; a block is read in order by one
task. The sorted window is an array into which a bisection inserts and from which one removes; the median is at its middle,
and the median deviation is found by bisection over how many of the smallest deviations lie below the median.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from math import isfinite

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from benchloom.operators.grouped import add_by_group

#: A block is so many half windows wide; a row lies in two blocks at most.
BLOCK = 8


def deviation(a: list[float], mid: float, rank: int) -> float:
    """The ``rank``-th (from 0) smallest distance from ``mid`` in the sorted list ``a``."""
    cut = bisect_left(a, mid)
    # i of the rank + 1 smallest lie below the cut, going down from it; the others go up from it.
    low, high = max(0, rank + 1 - (len(a) - cut)), min(cut, rank + 1)
    while low < high:
        i = (low + high) // 2
        up = cut + rank - i
        if up < len(a) and mid - a[cut - i - 1] < a[up] - mid:
            low = i + 1
        else:
            high = i
    below = mid - a[cut - low] if low else 0.0
    up = cut + rank - low
    return max(below, a[up] - mid if up >= cut else 0.0)


def scan(t: np.ndarray, v: np.ndarray, half: int) -> list[list[float] | None]:
    """For each row [median, MAD] of the values within ``half`` of its time; None without values. Rows are in order of time."""
    out: list[list[float] | None] = []
    window: list[float] = []
    first = last = 0
    times, values = t.tolist(), v.tolist()
    plain = all(x is None or x != x or isfinite(x) for x in values)
    for now in times:
        while last < len(times) and times[last] <= now + half:
            if (x := values[last]) is not None and x == x:
                insort(window, x)
            last += 1
        while times[first] < now - half:
            if (x := values[first]) is not None and x == x:
                del window[bisect_left(window, x)]
            first += 1
        n = len(window)
        if not n:
            out.append(None)
            continue
        mid = (window[(n - 1) // 2] + window[n // 2]) / 2
        if plain:
            out.append([mid, (deviation(window, mid, (n - 1) // 2) + deviation(window, mid, n // 2)) / 2])
        else:  # distances from infinite values have no order of their own
            with np.errstate(invalid="ignore"):
                d = np.sort(np.abs(np.array(window) - mid))
            out.append([mid, float((d[(n - 1) // 2] + d[n // 2]) / 2)])
    return out


def with_median_mad(df: DataFrame, keys: list[str], time: str, value: str, half_us: int) -> DataFrame:
    """Adds ``med`` and ``mad`` of the window that is closed at both ends; a group's windows hold its rows alone. NaN counts as no value."""
    width = BLOCK * half_us
    own = F.floor(F.col(time) / width)
    near = F.array_distinct(F.array(own, F.floor((F.col(time) - half_us) / width), F.floor((F.col(time) + half_us) / width)))
    dealt = df.withColumn("__own", own).withColumn("__block", F.explode(near)).withColumn("__v", F.col(value).cast("double"))
    scanned = add_by_group(dealt, [*keys, "__block"], [time], [time, "__v"], lambda rows: scan(rows[time], rows["__v"], half_us), "__w", ArrayType(DoubleType()))
    return scanned.filter(F.col("__own") == F.col("__block")).withColumn("med", F.col("__w")[0]).withColumn("mad", F.col("__w")[1]).drop("__own", "__block", "__v", "__w")
