"""Best-fit packing: a configuration linear program over the length histogram decides, ranks within lengths place rows.

Three passes: tokenize and cut (written once, without texts), count lengths (at most ``capacity`` rows reach the driver),
give each piece its rank among those of its length and with it a place. Ranks are those within a partition plus the sum
over partitions before, so no length, however frequent, meets in one task. The program's size depends on the capacity alone.

Defined results: a null or empty text is its end token alone; every row of the input gives pieces, repeated rows too; an
empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benchloom.llm import tokens
from benchloom.llm.common import materialize

PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all but the first have full length."""
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def tokenize_pieces(df: DataFrame, tokenizer: str, capacity: int, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows: id, piece, start, length, CRC of the ids, part and rank among the part's pieces of that length; ``ids`` if asked."""
    schema = f"`{doc_id}` {df.schema[doc_id].dataType.simpleString()}, {PIECE}, part int, local_rank bigint" + (", ids array<int>" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seen = tokens.load(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

        def rows() -> pa.RecordBatch:
            cols = [doc_ids.take(pa.array(of, pa.int32())), pa.array(no, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array([part] * len(of), pa.int32()), pa.array(rank)]
            names = [doc_id, "piece", "start", "length", "ids_crc32", "part", "local_rank"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.frombuffer(b"".join(held), "<i4"))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            doc_ids, of, no, start, length, crc, rank, held, size = batch.column(0), [], [], [], [], [], [], [], 0
            for i, value in enumerate(batch.column(1)):
                ids = tok.encode(value.as_py() or "") + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * s : 4 * (s + n)]
                    of.append(i), no.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(own)), rank.append(int(seen[n]))
                    seen[n] += 1
                    if with_ids:
                        held.append(own)
                        size += len(own)
                if size > 8 << 20:
                    yield rows()
                    of, no, start, length, crc, rank, held, size = [], [], [], [], [], [], [], 0
            yield rows()

    return df.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def _knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[w]: the largest value of lengths that sum to at most ``w``; last[w]: a length of such a choice, 0: none."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(value > 0)
    worth = value[lengths]
    for w in range(1, capacity + 1):
        n = np.searchsorted(lengths, w, "right")
        if n:
            c = worth[:n] + best[w - lengths[:n]]
            k = int(c.argmax())
            if c[k] > best[w - 1] + 1e-12:
                best[w], last[w] = c[k], lengths[k]
                continue
        best[w] = best[w - 1]
    return best, last


def _choice(last: np.ndarray, w: int) -> list[int]:
    out = []
    while w > 0:
        if last[w]:
            out.append(int(last[w]))
            w -= int(last[w])
        else:
            w -= 1
    return out


def _prices(covered: np.ndarray, need: np.ndarray, eta: float) -> np.ndarray:
    """Multiplicative weights: a length's price falls exponentially with the share of it that is covered."""
    have = need > 0
    share = np.divide(covered, need, out=np.zeros(len(need)), where=have)
    return np.where(have, np.arange(len(need)) / (len(need) - 1) * np.exp(-eta * (share - (share[have].mean() if have.any() else 0.0))), 0.0)


def relaxed(counts: np.ndarray, capacity: int, turns: int = 60, eta: float = 0.5, levels: int = 2, near: float = 0.995) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """The configuration program without whole numbers: how often each configuration is used, and what it covers of each length.

    Each turn prices lengths by what is covered of them. A knapsack over lengths that are not yet covered up to the level gives
    the best configuration and, for each first length, its best one, taken if nearly as good; the level rises when little is
    left below it, and what is nearly as good gets wider when few configurations can be had.
    """
    need = counts.astype(float)
    covered, x = np.zeros(capacity + 1), {}
    level, width = 1, near
    for _ in range(turns):
        allowed = need * (level / levels)
        price = np.where(covered < allowed * (1 - 1e-9), _prices(covered, need, eta), 0.0)
        if not price.any():
            break
        best, last = _knapsack(price, capacity)
        tried = taken = 0
        for first in np.flatnonzero(price)[::-1]:
            if price[first] + best[capacity - first] >= width * best[capacity]:
                c = tuple(sorted([int(first), *_choice(last, capacity - int(first))], reverse=True))
                kinds, times = np.unique(c, return_counts=True)
                step = float(((allowed[kinds] - covered[kinds]) / times).min())
                tried += 1
                if step > 1e-12:
                    x[c] = x.get(c, 0.0) + step
                    covered[kinds] += step * times
                    taken += 1
        if taken * 8 <= tried or taken < 3:
            width -= 0.01
        if level < levels and (covered.sum() > 0.9 * allowed.sum() or width < 0.8):
            level, width = level + 1, near
        elif width < 0.8:
            break
    return x, covered


def program(counts: np.ndarray, capacity: int, eta: float = 0.5, near: float = 0.97, refresh: int = 16) -> tuple[dict[tuple[int, ...], int], np.ndarray]:
    """Configurations in whole numbers, and the counts of the pieces that none of them holds.

    The relaxed program is rounded down. What that leaves is rounded up in configurations of its prices: from the longest length
    left, the next one is that of largest price and knapsack value behind it among those still there, and half of the times
    that fit are taken at once. The knapsack is solved again whenever ``refresh`` lengths have run out. Lengths whose
    best configuration falls behind ``near`` of the knapsack's are left.
    """
    rest = counts.astype(np.int64).copy()
    plan: dict[tuple[int, ...], int] = {}
    if rest[capacity]:
        plan[(capacity,)] = int(rest[capacity])
        rest[capacity] = 0
    need = rest.astype(float)
    x, covered = relaxed(rest, capacity, eta=eta) if rest.any() else ({}, need)
    for c, v in x.items():
        kinds, times = np.unique(c, return_counts=True)
        if m := min(int(v + 1e-9), int((rest[kinds] // times).min())):
            plan[c] = m
            rest[kinds] -= m * times
    prices, aside, gone = _prices(covered, need, eta), np.zeros(capacity + 1, bool), refresh
    while (firsts := np.flatnonzero((rest > 0) & ~aside)).size:
        if gone >= refresh:
            price = np.where(rest > 0, prices, 0.0)
            best, _ = _knapsack(price, capacity)
            gone = 0
        there = np.flatnonzero(rest)
        used, room, worth = {int(firsts[-1]): 1}, capacity - int(firsts[-1]), price[firsts[-1]]
        while n := int(np.searchsorted(there, room, "right")):
            value = price[there[:n]] + best[room - there[:n]]
            for size, times in used.items():
                if times >= rest[size] and size <= room:
                    value[np.searchsorted(there, size)] = -1.0
            size = int(there[value.argmax()])
            if value.max() <= 0:
                break
            used[size], room, worth = used.get(size, 0) + 1, room - size, worth + price[size]
        if worth < near * best[capacity]:
            aside[firsts[-1]] = True
            continue
        m = max(1, min(int(rest[size]) // times for size, times in used.items()) // 2)
        c = tuple(sorted((size for size, times in used.items() for _ in range(times)), reverse=True))
        plan[c] = plan.get(c, 0) + m
        for size, times in used.items():
            rest[size] -= m * times
            gone += not rest[size]
    return plan, rest


def solve(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (lengths, descending) with how often each is used, which hold exactly ``counts[length]`` pieces.

    The program places most pieces, at every size of the input; those left go by best fit. Where best fit alone takes fewer
    sequences, its plan is taken: both work on counts.
    """
    plan, rest = program(counts, capacity)
    for c, m in _best_fit(rest, capacity):
        plan[c] = plan.get(c, 0) + m
    alone = _best_fit(counts, capacity)
    if sum(m for _, m in alone) < sum(plan.values()):
        plan = {}
        for c, m in alone:
            plan[c] = plan.get(c, 0) + m
    return sorted(plan.items(), key=lambda t: t[0], reverse=True)


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by falling length, on counts: equal bins are handled together."""
    free: dict[int, dict[tuple[int, ...], int]] = {}
    for size in np.flatnonzero(counts)[::-1]:
        size, n = int(size), int(counts[size])
        for room in sorted(r for r in free if r >= size):
            for c in list(free[room]):
                while n and free[room].get(c):
                    each = min(room // size, n)
                    bins = min(free[room][c], max(1, n // each))
                    free[room][c] -= bins
                    new = c + (size,) * each
                    free.setdefault(room - each * size, {})[new] = free.get(room - each * size, {}).get(new, 0) + bins
                    n -= bins * each
                if not free[room].get(c):
                    free[room].pop(c, None)
            if not n:
                break
        each = capacity // size
        for k, bins in ((each, n // each), (n % each, 1)):
            if k and bins:
                c = (size,) * k
                free.setdefault(capacity - k * size, {})[c] = free.get(capacity - k * size, {}).get(c, 0) + bins
    return [(c, m) for by in free.values() for c, m in by.items() if m]


@dataclass
class Places:
    """For each length: from which rank on a configuration holds its pieces, how many of them a sequence has, where."""

    first: dict[int, np.ndarray]
    each: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]


def places(plan: list[tuple[tuple[int, ...], int]]) -> Places:
    rank: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for c, m in plan:
        at = 0
        for size in dict.fromkeys(c):
            n = c.count(size)
            out.setdefault(size, []).append((rank.get(size, 0), n, sequence, at))
            rank[size] = rank.get(size, 0) + n * m
            at += n * size
        sequence += m
    columns = {k: np.array(v, np.int64).T for k, v in out.items()}
    return Places(*({k: v[i] for k, v in columns.items()} for i in range(4)))


def pack(df: DataFrame, tokenizer: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows with their sequence and offset there, gapless from 0; ``ids`` too if asked."""
    pieces = materialize(tokenize_pieces(df, tokenizer, capacity, doc_id, text, end_id, with_ids), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[r.length] = r.n
    where = df.sparkSession.sparkContext.broadcast(places(solve(counts, capacity)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(by_part.select("part", "length", before.alias("before")), ["part", "length"]).select(*[c for c in pieces.columns if c not in ("part", "local_rank")], (F.col("before") + F.col("local_rank")).alias("rank"))
    kept = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = where.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, bounds) if len(order) else []:
                size = int(length[rows[0]])
                k = np.searchsorted(p.first[size], rank[rows], "right") - 1
                inside, each = rank[rows] - p.first[size][k], p.each[size][k]
                sequence[rows] = p.sequence[size][k] + inside // each
                offset[rows] = p.offset[size][k] + inside % each * size
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)
