"""Suffix sorting by induction over bucket queues that move to disk and carry common prefixes.

The priority queue of an induced sort holds suffixes by first byte and by the rank of what follows. Suffixes are induced in
the order of those ranks, so each byte's bucket is a first-in first-out queue: it is kept as a list of arrays, and beyond
``memory`` entries arrays are written to a scratch file and read once, in order. With each suffix goes what it shares with the
one before it in its queue, which follows from what the suffixes share that induced both. Left-to-right and right-to-left passes
sort the suffixes from their LMS suffixes, whose own shared prefixes are found by comparing neighbours; LMS suffixes are sorted the same way from their substrings, whose names form a
shorter text that is sorted by recursion (by doubling ranks, once it has more names than bytes have values).
"""

from __future__ import annotations

import tempfile

import numpy as np


#: Suffixes that one array operation handles.
STEP = 1 << 14


class Queues:
    """First-in first-out queues of suffixes, one for each byte value, with the prefix each shares with the one before it."""

    def __init__(self, n: int, memory: int) -> None:
        self.parts: list[list] = [[] for _ in range(n)]
        self.held, self.memory, self.file = 0, memory, None

    def put(self, key: int, values: np.ndarray, shared: np.ndarray | None) -> None:
        if not len(values):
            return
        if self.held + len(values) > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            at = self.file.tell()
            self.file.write(values.astype(np.int64).tobytes())
            if shared is not None:
                self.file.write(shared.astype(np.int64).tobytes())
            self.parts[key].append((at, len(values), shared is not None))
        else:
            self.parts[key].append([values, shared])
            self.held += len(values)

    def spread(self, keys: np.ndarray, values: np.ndarray, shared: np.ndarray | None) -> None:
        """Puts each value in the queue of its key; keys are in order, values in that of their queue."""
        bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else [0]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            self.put(int(keys[a]), values[a:b], None if shared is None else shared[a:b])

    def take(self, key: int):
        """The suffixes of a queue in order, in arrays of about STEP; those put meanwhile too."""
        parts = self.parts[key]
        while parts:
            got, size = [], 0
            while parts and size < STEP:
                part = parts.pop(0)
                if isinstance(part, tuple):
                    at, n, both = part
                    self.file.seek(at)
                    data = np.frombuffer(self.file.read(8 * n * (1 + both)), np.int64)
                    part = [data[:n], data[n:] if both else None]
                else:
                    self.held -= len(part[0])
                got.append(part)
                size += len(part[0])
            if len(got) == 1:
                yield got[0]
            else:
                yield np.concatenate([g[0] for g in got]), None if got[0][1] is None else np.concatenate([g[1] for g in got])


class Carried:
    """What suffixes share with the one before them in their queue, from what those share that induce them.

    Two suffixes with one first byte share one byte more than the suffixes behind that byte, and these share the least
    of what neighbours between them share. Minima over a step's suffixes come from a table of powers of two.
    """

    def __init__(self, n: int, limit: int) -> None:
        self.limit = limit
        self.low = np.full(n, limit, np.int64)
        self.seen = np.zeros(n, bool)

    def step(self, shared: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """For suffixes induced by those at places ``at`` into ``keys`` (in order of key, then place), given what all of the step share."""
        table = [shared]
        while 2 << (len(table) - 1) <= len(shared):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        start = np.zeros(len(at), np.int64)
        start[1:] = at[:-1] + 1
        start[first] = 0
        level = np.log2(at - start + 1).astype(np.int64)
        out = np.empty(len(at), np.int64)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(table[k][start[own]], table[k][at[own] - (1 << k) + 1])
        heads = np.flatnonzero(first)
        out[heads] = np.minimum(out[heads], self.low[keys[heads]])
        out = np.minimum(out + 1, self.limit)
        out[heads[~self.seen[keys[heads]]]] = 0
        self.low = np.minimum(self.low, shared.min())
        if len(keys):
            ends = np.append(heads[1:], len(keys)) - 1
            behind = np.append(np.minimum.accumulate(shared[::-1])[::-1], self.limit)
            self.low[keys[ends]] = behind[at[ends] + 1]
            self.seen[keys[ends]] = True
        return out


def _types(t: np.ndarray) -> np.ndarray:
    """For each place whether its suffix is smaller than the next one (type S); the last, a sentinel, is."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = step[np.minimum(at, n - 2)] > 0
    return out


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, top: int, memory: int, shared: np.ndarray | None = None, limit: int = 0, text: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """All suffixes, in the order that sorted ``lms`` suffixes (or substrings) imply.

    With ``shared``, the bytes that each LMS suffix shares with the one before it (at most ``limit``), also what each suffix
    shares with the one before it, carried along. Only where a bucket's types meet are two suffixes compared.
    """

    def on(queues: Queues, carried: Carried | None, own: np.ndarray, own_shared: np.ndarray | None, of: bool) -> None:
        """Induces the suffixes before ``own`` that are of the type ``of``."""
        for low in range(0, len(own), STEP):
            part = own[low : low + STEP]
            before = part - 1
            at = np.flatnonzero((before >= 0) & (small[before] == of))
            keys = t[before[at]].astype(np.int64)
            order = np.argsort(keys, kind="stable")
            at, keys = at[order], keys[order]
            queues.spread(keys, before[at], carried.step(own_shared[low : low + STEP], at, keys) if carried else None)

    def meeting(a: int, b: int) -> int:
        return int(common_prefixes(text, np.array([a, b]), limit)[0])

    queues, carried = Queues(top + 1, memory), Carried(top + 1, limit) if shared is not None else None
    cuts = np.searchsorted(t[lms], np.arange(1, top + 1))
    seeds, seeds_shared = np.split(lms, cuts), np.split(shared, cuts) if shared is not None else [None] * (top + 1)
    larger: list[list] = [[] for _ in range(top + 1)]
    for c in range(top + 1):
        for own, own_shared in queues.take(c):
            larger[c].append((own, own_shared))
            on(queues, carried, own, own_shared, False)
        if len(seeds[c]):
            own_shared = seeds_shared[c]
            if carried:
                own_shared = own_shared.copy()
                own_shared[0] = meeting(larger[c][-1][0][-1], seeds[c][0]) if larger[c] else 0
            on(queues, carried, seeds[c], own_shared, False)
    queues, carried = Queues(top + 1, memory), Carried(top + 1, limit) if shared is not None else None
    out: list[np.ndarray] = []
    out_shared: list[np.ndarray] = []
    for c in range(top, -1, -1):
        # Type S suffixes of a bucket stand behind its type L ones; they arrive from the largest down.
        last = -1
        for own, own_shared in queues.take(c):
            out.append(own)
            out_shared.append(own_shared)
            last = int(own[-1])
            on(queues, carried, own, own_shared, True)
        behind = None  # what the suffix after this one shares with it
        for own, own_shared in reversed(larger[c]):
            down = None
            if carried:
                down = np.empty(len(own), np.int64)
                down[0] = behind if behind is not None else meeting(own[-1], last) if last >= 0 else 0
                down[1:] = own_shared[:0:-1]
                behind = int(own_shared[0])
            out.append(own[::-1])
            out_shared.append(down)
            on(queues, carried, own[::-1], down, True)
        if c == 0:
            out.append(np.array([len(t) - 1]))
            out_shared.append(np.zeros(1, np.int64))
    return np.concatenate(out)[::-1], np.concatenate(out_shared)[1:][::-1] if carried else None


def _double(names: np.ndarray) -> np.ndarray:
    """The suffix array of names by doubling ranks."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.full(n, 0, np.int64)
        second[:-k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank[order] = fresh
        k *= 2
        if fresh[-1] == n - 1 or k >= n:
            return order


def suffix_array(text: np.ndarray, memory: int = 1 << 26, limit: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes of ``text`` (bytes) in their order, a shorter one before those that begin with it; and the bytes that each
    but the first shares with the one before it, at most ``limit`` (with a limit of 0 all zeros)."""
    n = len(text)
    if n < 2:
        return np.arange(n), np.zeros(0, np.int64)
    t = np.zeros(n + 1, np.uint16)
    t[:-1] = text
    t[:-1] += 1
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    by_byte = lms[np.argsort(t[lms], kind="stable")]
    # The order of LMS substrings, then their names: equal substrings are neighbours and get one name.
    order, _ = _induce(t, small, by_byte, 256, memory)
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    sorted_lms = order[is_lms[order]]
    end = np.append(lms[1:], n)
    length = np.zeros(n + 1, np.int64)
    length[lms] = end - lms + 1
    a, b = sorted_lms[:-1], sorted_lms[1:]
    differ = length[a] != length[b]
    same = np.flatnonzero(~differ)
    step = 0
    while len(same):
        go = step < length[a[same]]
        same = same[go]
        if not len(same):
            break
        other = (t[a[same] + step] != t[b[same] + step]) | (small[a[same] + step] != small[b[same] + step])
        differ[same[other]] = True
        same = same[~other]
        step += 1
    name = np.zeros(n + 1, np.int64)
    name[sorted_lms] = np.concatenate([[0], np.cumsum(differ)])
    names = name[lms]
    sorted_lms = lms[_double(names)] if len(lms) > 1 and names.max() + 1 < len(names) else sorted_lms
    shared = np.concatenate([[0], common_prefixes(text, sorted_lms, limit)]) if limit else None
    order, shared = _induce(t, small, sorted_lms, 256, memory, shared, limit, text)
    return order[1:], shared[1:] if limit else np.zeros(n - 1, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each suffix of ``order`` but the first, the bytes it shares with the one before it, at most ``limit``."""
    if len(order) < 2:
        return np.zeros(0, np.int64)
    n = len(text)
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), np.int64)
    room = np.minimum(n - np.maximum(a, b), limit)
    at = np.arange(len(a))
    wide = np.zeros(n + 16, np.uint8)
    wide[:n] = text
    words = np.lib.stride_tricks.sliding_window_view(wide, 8)
    while len(at):
        x = np.ascontiguousarray(words[a[at] + out[at]]).view(np.uint64).ravel() ^ np.ascontiguousarray(words[b[at] + out[at]]).view(np.uint64).ravel()
        low = x & (~x + np.uint64(1))
        equal = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        out[at] = np.minimum(out[at] + equal, room[at])
        at = at[(equal == 8) & (out[at] < room[at])]
    return out
