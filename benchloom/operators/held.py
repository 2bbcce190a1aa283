"""A rule with memory over long groups: what is held moves only with a value that differs enough from it.

What a chunk of a group makes of the value held before it is a function with few pieces: with the first value that differs enough
the chunk's further course no longer depends on what came in, and only a value beyond all before it in the chunk can be that first
one. So each chunk is summed up on its own (those values, and what is held at the chunk's end after each of them), a pass over
the summaries of a group says what every chunk begins with, and all chunks are then scanned at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from benchloom.operators.grouped import add_by_group, map_groups

#: Rows of a chunk, if times are spread evenly.
CHUNK_ROWS = 1 << 17
# Values this close to the least or largest before them are kept as well: differences are rounded.
MARGIN = 1e-12


def moves(v: float, held: float | None, tolerance: float) -> bool:
    """Whether a value takes the place of the one held: it is a number, and the first or far enough from it."""
    return v == v and (held is None or abs(v - held) > tolerance * max(abs(v), abs(held)))


def _scan(values: list[float], start: int, held: float | None, tolerance: float, known: dict[int, float] | None = None) -> tuple[list[int], float | None]:
    """The places that move from ``start`` on, and what is held at the end; a place in ``known`` ends the scan with its end."""
    at = []
    for i in range(start, len(values)):
        v = values[i]
        if moves(v, held, tolerance):
            if known and i in known:
                return at, known[i]
            held = v
            at.append(i)
    return at, held


def summary(values: list[float], tolerance: float) -> tuple[list[float], list[float]]:
    """Values that can be the first to move, in order, and what is held at the end after each of them."""
    first, low, high = [], 0.0, 0.0
    for i, v in enumerate(values):
        if v != v:
            continue
        if not first:
            first, low, high = [i], v, v
        elif tolerance >= 1:
            first.append(i)
        elif v not in (low, high) and (v > high - MARGIN * abs(high) or v < low + MARGIN * abs(low)):
            first.append(i)
            low, high = min(low, v), max(high, v)
        if first and tolerance < 0.25 and high - low > 4 * tolerance * max(abs(low), abs(high)):
            break  # nothing is near enough to both
    known: dict[int, float] = {}
    for i in reversed(first):
        if i not in known:
            at, end = _scan(values, i + 1, values[i], tolerance, known)
            known |= dict.fromkeys([i, *at], end)
    return [values[i] for i in first], [known[i] for i in first]


def carry(held: float | None, firsts: list[float], ends: list[float], tolerance: float) -> float | None:
    """What is held after a chunk."""
    return next((e for v, e in zip(firsts, ends) if moves(v, held, tolerance)), held)


def changed(df: DataFrame, by: list[str], time: str, column: str, tolerance: float = 1e-5, chunk_rows: int | None = None) -> DataFrame:
    """Adds ``changed``: against the last accepted value, which moves only with a change; the first value counts as one.

    Rows without a number change nothing. Groups of more than ``chunk_rows`` rows are cut by time into chunks, each in a task of
    its own; rows of one time are ordered by value.
    """
    size = chunk_rows or CHUNK_ROWS
    same = lambda a, b, names: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names], F.lit(True))
    t = F.col(time).cast("double")
    extent = df.groupBy(*by).agg(F.count("*").alias("__n"), F.min(t).alias("__lo"), F.max(t).alias("__hi"))
    part = F.coalesce(F.least(F.floor((t - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * F.ceil(F.col("__n") / size)), F.ceil(F.col("__n") / size) - 1), F.lit(-1))
    part = F.when((F.col("__n") > size) & (F.col("__hi") > F.col("__lo")), part).otherwise(0)
    cut = df.alias("a").join(extent.alias("b"), same("a", "b", by)).select("a.*", "__n", part.cast("long").alias("__chunk"), F.col(f"a.{column}").cast("double").alias("__v"))
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{keys}{', ' if by else ''}__chunk long, "

    def summed(rows: dict) -> dict[str, list]:
        firsts, ends = summary(rows["__v"].tolist(), tolerance)
        return {"__firsts": [firsts], "__ends": [ends]}

    def carried(rows: dict) -> dict[str, list]:
        held, out = None, []
        for firsts, ends in zip(rows["__firsts"], rows["__ends"], strict=True):
            out.append(held)
            held = carry(held, list(firsts), list(ends), tolerance)
        return {"__chunk": rows["__chunk"].tolist(), "__held": out}

    long = cut.filter(F.col("__n") > size).select(*by, "__chunk", F.col(time).alias("__t"), "__v")
    sums = map_groups(long, [*by, "__chunk"], ["__t", "__v"], summed, schema + "__firsts array<double>, __ends array<double>")
    begins = map_groups(sums, by, ["__chunk"], carried, schema + "__held double")

    def scan(rows: dict) -> list[bool]:
        values, held = rows["__v"].tolist(), rows["__held"][0]
        moved = set(_scan(values, 0, None if held is None or held != held else float(held), tolerance)[0])
        return [i in moved for i in range(len(values))]

    met = cut.alias("a").join(begins.alias("b"), same("a", "b", [*by, "__chunk"]), "left").select("a.*", "b.__held")
    return add_by_group(met, [*by, "__chunk"], [time, "__v"], ["__v", "__held"], scan, "changed", BooleanType()).drop("__n", "__chunk", "__v", "__held")
