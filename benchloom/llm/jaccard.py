"""N-gram Jaccard join: an exact metric-space join of shingle sets, for groups of linked documents.

Jaccard distance is a metric. Pivots of the first level are single shingles: {s} is at distance 1 - 1/|x| from each set x that
has s, at 1 from all others, so a set lies in the Voronoi regions of its own shingles. A global order (rare shingles first,
then by hash) ranks these; a set stays only in the regions of its first |x| - ceil(t|x|) + 1 shingles, as linked sets
share one of those (they can't miss more). That is the boundary window of this level, and it loses no link.

Within a region, sets are compared by signatures, their shingle counts in hash buckets: the L1 distance of signatures is
a metric below the sets' symmetric difference (more buckets for long sets), hence a pair beyond the bound on that isn't linked. Large regions are cut by
distance to pivots among their signatures, each window replicating its boundary (triangle inequality), recursively. What
is left are edges of possible links, at most one per set and region; their components (blocks) hold all links. Only
documents of blocks are read again, each block's sets are joined exactly: against a pivot first, whose linked sets count as
one, then pairs of different groups inside the window of their distances to the pivot. Blocks too large for a task meet
their pivot in many tasks, and what is linked to it and out of reach of the rest is done there.

Regions of more than ``REGION`` sets meet a pivot of the region in many tasks first, in the same way.

Equal sets are one class from the start, so copies, however many, cost a row each. Shingles are known by 64-bit hashes, sets
by 64 bits over theirs, or by a second number where two sets share the first. Defined results: null or empty texts have no shingles and are linked with nothing; documents of fewer words than
``k`` have their whole sequence as one shingle; a null id takes part but is never a component's id (unless all are null);
repeated rows are linked; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.llm.common import free_names, materialize, mix, shingle_hashes, text_chunks, word_hashes
from benchloom.llm.graph import components

#: Counts in a signature, by size. Noise of unrelated sets' distance grows with the root of size times counts, what a link
#: may differ by with the size: n shingles at a bound c = (1-t)/(1+t) need about NOISE * n * c² counts.
BUCKETS = (32, 128, 512)
NOISE = 12.5
#: A shingle is common from this share of all shingle occurrences on; at most twice its inverse are.
COMMON = 2.0**-18
#: Bytes of sets in a block that one task joins; larger ones meet their pivot in many tasks first.
BLOCK = 48 << 20
#: Rows of text hashes that may be sent to all tasks.
BROADCAST = 2_000_000
#: Ratio of the largest to the smallest size of a band.
BAND = 1.25
#: Sets of a region that one task compares; those of larger ones meet a pivot of the region in many tasks first.
REGION = 20_000
#: Parts in which a large region or block meets its pivot.
SALTS = 64
#: Set apart second hashes of sets.
SECOND = 0x5851F42D4C957F2D
_FILTER = 20


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    words, _, _, before = word_hashes(data, offsets)
    h, row, _ = shingle_hashes(words, before, k)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        s = np.sort(h[a:b])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if b > a else s)
    return out


def _hash(s: np.ndarray, seed: int) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s + np.uint64(seed)).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0]) if len(s) else 0


def _class(s: np.ndarray, shared: frozenset = frozenset()) -> int:
    """One number for a set, over all its shingles; 0: empty. ``shared``: numbers of several sets, which go by a second one."""
    first = _hash(s, 0)
    return _hash(s, SECOND) if first in shared else first


def _profiles(docs: DataFrame, k: int, shared: frozenset = frozenset()) -> DataFrame:
    """Rows of documents (kind 0: doc_id, n, cls, second hash) and of shingles common in part of a task (kind 1: n, cls the shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        names = ["kind", "doc_id", "n", "cls", "text_hash", "second"]

        def common(ids: pa.Array) -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(3.0, size * COMMON)
            values, n = values[often], n[often].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int32)), pa.nulls(len(n), ids.type), pa.array(n), pa.array(values.view(np.int64)), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], names)

        ids = None
        for batch in batches:
            for rows, data, offsets in text_chunks(batch, "text"):
                sets, ids = _sets(data, offsets, k), rows.column(0)
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), ids, pa.array(n), pa.array([_class(s, shared) for s in sets], pa.int64()), rows.column(2), pa.array([_hash(s, SECOND) for s in sets], pa.int64())], names)
                held += sets
                size += int(n.sum())
                if size > 6_000_000:
                    yield common(ids)
                    held, size = [], 0
        if size:
            yield common(ids)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"kind int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, cls bigint, text_hash bigint, second bigint")


def _regions(docs: DataFrame, k: int, num: int, den: int, common: np.ndarray, shared: frozenset = frozenset()) -> DataFrame:
    """One row per class: cls, n, text_hash (of one of its texts), prefix (its regions), signature."""
    table = np.zeros(1 << _FILTER, bool)
    table[(common & np.uint64((1 << _FILTER) - 1)).astype(np.int64)] = True
    sent = docs.sparkSession.sparkContext.broadcast((common, table))
    limits = size_limits(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, table = sent.value
        seen: set[int] = set()
        for batch in batches:
            for rows, data, offsets in text_chunks(batch, "text"):
                hashes = rows.column(1).to_numpy()
                out: list[list] = [[], [], [], [], []]
                for i, s in enumerate(_sets(data, offsets, k)):
                    n = len(s)
                    cls = _class(s, shared)
                    if not n or cls in seen:
                        continue
                    seen.add(cls)
                    p = n - -(-num * n // den) + 1
                    often = table[(s & np.uint64((1 << _FILTER) - 1)).astype(np.int64)]
                    if often.any():
                        often[often] = np.isin(s[often], common, assume_unique=True)
                        s_ranked = np.concatenate([s[~often], s[often]])
                    else:
                        s_ranked = s
                    buckets = BUCKETS[int(np.searchsorted(limits, n))]
                    signature = np.minimum(np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8)
                    for column, value in zip(out, (cls, n, hashes[i], s_ranked[:p].view(np.int64), signature.tobytes()), strict=True):
                        column.append(value)
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.binary())], ["cls", "n", "text_hash", "prefix", "signature"])

    found = docs.select("text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "cls bigint, n bigint, text_hash bigint, prefix array<bigint>, signature binary")
    return found.dropDuplicates(["cls"])


class _Union:
    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        labels = np.unique(np.append(self.label[others], self.label[i]))
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]


def _near(n: np.ndarray, signature: np.ndarray, at: np.ndarray, union: _Union, num: int, den: int, depth: int = 0) -> None:
    """Joins in ``union`` all pairs of ``at`` whose sizes and signatures allow a link."""
    if len(at) > 1500 and depth < 6:
        pivot = signature[at[int(len(at) * (0.37 + 0.09 * depth)) % len(at)]].astype(np.int64)
        d = np.abs(signature[at].astype(np.int64) - pivot).sum(1)
        reach = int(2 * n[at].max() * (den - num) // (den + num)) + 1  # the largest symmetric difference of a link here
        width = max(3 * reach, 1)
        if d.max() - d.min() > width:
            for low in range(int(d.min()), int(d.max()) + 1, width):
                inside = at[(d >= low) & (d < low + width + reach)]
                if len(inside) > 1:
                    _near(n, signature, inside, union, num, den, depth + 1 if len(inside) < len(at) else 9)
            return
    order = at[np.argsort(n[at], kind="stable")]
    sizes = n[order]
    ends = np.searchsorted(sizes, sizes * den // num, "right")
    sig = signature[order].astype(np.int16)
    for i in range(len(order) - 1):
        j = np.arange(i + 1, ends[i])
        j = j[union.label[order[j]] != union.label[order[i]]]
        if len(j):
            apart = np.abs(sig[j] - sig[i]).sum(1, dtype=np.int64)
            j = j[(den + num) * apart <= (den - num) * (sizes[j] + sizes[i])]
            if len(j):
                union.join(order[i], order[j])


def size_limits(num: int, den: int) -> np.ndarray:
    """Up to which size sets have each of BUCKETS but the last."""
    return np.array([b / (NOISE * ((den - num) / (den + num)) ** 2) for b in BUCKETS[:-1]])


def _near_any(n: np.ndarray, signatures: list[bytes], union: _Union, num: int, den: int) -> None:
    """_near among sets with equally long signatures, and with those longer ones whose sizes allow a link, folded."""
    limits = size_limits(num, den)
    tier = np.searchsorted(limits, n)
    for k, width in enumerate(BUCKETS):
        own = tier == k
        if not own.any():
            continue
        if k < len(limits):
            own = own | ((tier > k) & (n * num <= limits[k] * den))
        at = np.flatnonzero(own)
        if len(at) < 2:
            continue
        table = np.zeros((len(n), width), np.uint8)
        for i in at:
            x = np.frombuffer(signatures[i], np.uint8)
            table[i] = x if len(x) == width else np.minimum(x.reshape(-1, width).sum(0, dtype=np.int64), 255)
        _near(n, table, at, union, num, den)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with equal ``key`` of batches sorted by it; small groups come together in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.searchsorted(keys != keys[-1], False)) if keys[0] != keys[-1] else 0
        cut = len(keys) - int(np.argmax((keys != keys[-1])[::-1])) if keys[0] != keys[-1] else 0
        if cut:
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _bounds(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _possible(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): edges whose components contain every pair of the regions' sets that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for table in _groups(batches, "s"):
            keys, cls, n = (table.column(c).to_numpy() for c in ("s", "cls", "n"))
            signatures = table.column("signature").to_pylist()
            bounds = _bounds(keys)
            a, b = [], []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                same = hash(cls[low:high].tobytes())
                if high - low < 2 or same in done:
                    continue
                done.add(same)
                union = _Union(high - low)
                _near_any(n[low:high], signatures[low:high], union, num, den)
                moved = np.flatnonzero(union.label != np.arange(high - low))
                a.append(cls[low:high][moved])
                b.append(cls[low:high][union.label[moved]])
            if len(done) > 1_000_000:
                done.clear()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return rows.repartition(F.col("s")).sortWithinPartitions("s", "cls").mapInArrow(run, "a bigint, b bigint").distinct()


def _region_pivots(rows: DataFrame, big: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Regions of ``big`` (s, pivot: one of its classes): edges to the pivot, and the rows still to be compared.

    Distances are those of signatures folded to the shortest, a metric. A set that may be linked with the pivot stays
    only if a set that may not is within its reach (triangle inequality).
    """
    few = big.count() < 10_000
    small = lambda df: F.broadcast(df) if few else df
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    pivots = rows.join(small(big), "s").filter("cls = pivot").select("s", "pivot", F.col("n").alias("pivot_n"), F.col("signature").alias("pivot_signature"), salt.alias("salt"))
    own = rows.join(small(big.select("s")), "s", "left_semi").withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    limits, names = size_limits(num, den), ["s", "cls", "n", "signature", "pivot", "d", "hit"]

    def folded(signature: bytes, width: int) -> np.ndarray:
        return np.minimum(np.frombuffer(signature, np.uint8).reshape(-1, width).sum(0, dtype=np.int64), 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, hit = [], []
            for n, x, m, y in zip(*[batch.column(c).to_pylist() for c in ("n", "signature", "pivot_n", "pivot_signature")], strict=True):
                width = BUCKETS[int(np.searchsorted(limits, min(n, m)))]
                apart = int(np.abs(folded(x, width) - folded(y, width)).sum())
                d.append(int(np.abs(folded(x, BUCKETS[0]) - folded(y, BUCKETS[0])).sum()))
                hit.append(num * n <= den * m and num * m <= den * n and (den + num) * apart <= (den - num) * (n + m))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:5]], pa.array(d, pa.int64()), pa.array(hit, pa.bool_())], names)

    met = materialize(own.join(pivots, ["s", "salt"]).mapInArrow(run, "s bigint, cls bigint, n bigint, signature binary, pivot bigint, d bigint, hit boolean"), "regions")
    edges = met.filter("hit and cls != pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b"))
    left = met.filter("not hit").groupBy("s").agg(F.min("d").alias("nearest"))
    reach = F.col("n") * ((den - num) / num) + 1  # of a link to a set of at most n * den / num
    rest = met.join(small(left), "s").filter(~F.col("hit") | (F.col("d") + reach >= F.col("nearest"))).select("s", "cls", "n", "signature", "hit")
    return edges, rest


def _possible_all(rows: DataFrame, num: int, den: int) -> DataFrame:
    """_possible of rows (s, cls, n, signature, sets), where ``sets`` counts a region's rows; large regions meet pivots first."""
    small = rows.filter(F.col("sets") <= REGION).select("s", "cls", "n", "signature")
    large = rows.filter(F.col("sets") > REGION).select("s", "cls", "n", "signature", F.lit(False).alias("hit"))
    size = large.count()
    edges = []
    while size:
        large = materialize(large, "large")
        # A pivot is a set that no pivot of the region met; a region without one is done with.
        big = large.groupBy("s").agg(F.count("*").alias("sets"), F.min(F.when(~F.col("hit"), F.col("cls"))).alias("pivot")).filter("pivot is not null")
        big = materialize(big, "big")
        small = small.unionByName(large.join(big.filter(F.col("sets") <= REGION), "s", "left_semi").drop("hit"))
        found, large = _region_pivots(large.drop("hit"), big.filter(F.col("sets") > REGION).select("s", "pivot"), num, den)
        edges.append(found)
        before, size = size, large.count()
        if size > 0.95 * before:
            # Pivots no longer part what is left: it goes to tasks by region, as small ones do.
            small = small.unionByName(large.drop("hit"))
            break
    out = _possible(small, num, den)
    for e in edges:
        out = out.unionByName(e)
    return out


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = _shared(x, y)
    return den * both >= num * (len(x) + len(y) - both)


def join_sets(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """A label for each set, equal for sets connected by links.

    Pivots: the first set of those left; its linked sets form a group with it, the rest keep their distance to it. Then the
    regions are cut again, by the block's own rare shingles: sets of different groups are compared only where one of
    their first shingles (by frequency in the block) is the same and their distances to every pivot allow a link.
    """
    n = len(sets)
    union = _Union(n)
    sizes = np.array([len(s) for s in sets])
    distances: list[np.ndarray] = []
    left = np.arange(n)
    reach = (den - num) / den + 1e-9
    while len(left) and len(distances) < 8:
        pivot = sets[left[0]]
        shared = np.array([_shared(s, pivot) for s in sets])
        distances.append(1 - shared / (sizes + len(pivot) - shared))
        hit = np.flatnonzero(den * shared >= num * (sizes + len(pivot) - shared))
        union.join(int(left[0]), hit)
        left = left[1:][~np.isin(left[1:], hit)]
    if not len(left):
        return union.label
    d = np.array(distances)
    counts = np.minimum([np.bincount((x & np.uint64(127)).astype(np.int64), minlength=128) for x in sets], 255).astype(np.int16)
    owner = np.repeat(np.arange(n), sizes)
    _, which, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((which, often[which], owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = order[place < np.repeat(sizes - -(-num * sizes // den) + 1, sizes)]
    which, owner = which[order], owner[order]
    order = np.argsort(which, kind="stable")
    which, owner = which[order], owner[order]
    bounds = _bounds(which)
    several = np.flatnonzero(np.diff(bounds) > 1)
    tried: set[int] = set()
    for g in several[np.argsort(np.diff(bounds)[several], kind="stable")]:
        members = owner[bounds[g] : bounds[g + 1]]
        if (union.label[members] == union.label[members[0]]).all():
            continue
        for at in range(len(members) - 1):
            i, j = int(members[at]), members[at + 1 :]
            j = j[union.label[j] != union.label[i]]
            j = j[(num * sizes[j] <= den * sizes[i]) & (num * sizes[i] <= den * sizes[j])]
            j = j[(np.abs(d[:, j] - d[:, i : i + 1]) <= reach).all(0)]
            j = j[(den + num) * np.abs(counts[j] - counts[i]).sum(1, dtype=np.int64) <= (den - num) * (sizes[j] + sizes[i])]
            for k in j.tolist():
                pair = min(i, k) * n + max(i, k)
                if pair not in tried and union.label[i] != union.label[k]:
                    tried.add(pair)
                    if _linked(sets[i], sets[k], num, den):
                        union.join(i, np.array([k]))
    return union.label


def _exact(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that connect what is linked in each block of (block, cls, shingles).

    A block is cut into bands of sizes; a set that may be linked with smaller ones of the band below is in both.
    """
    size = F.octet_length("shingles") / 8
    band = lambda x: F.floor(F.log(x) / F.lit(math.log(BAND)) + 1e-9)
    bands = F.sequence(band(F.greatest(size * (num / den) - 1, F.lit(1.0))), band(size))
    rows = rows.withColumn("band", F.explode(bands)).withColumn("part", F.xxhash64("block", "band"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "part"):
            keys, cls = table.column("part").to_numpy(), table.column("cls").to_numpy()
            shingles = table.column("shingles")
            bounds = _bounds(keys)
            a, b = [], []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in shingles.slice(low, high - low)]
                label = join_sets(sets, num, den)
                moved = np.flatnonzero(label != np.arange(high - low))
                a.append(cls[low:high][moved])
                b.append(cls[low:high][label[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return rows.select("part", "cls", "shingles").repartition(F.col("part")).sortWithinPartitions("part", "cls").mapInArrow(run, "a bigint, b bigint")


def _meet_pivots(rows: DataFrame, big: DataFrame, num: int, den: int, salts: int = SALTS) -> tuple[DataFrame, DataFrame]:
    """Blocks of ``big`` (block, pivot: its smallest class): links with the pivot, and the rows still to be joined.

    The pivot's set goes to ``salts`` parts of its block. Rows linked to it and farther than a link from every unlinked row
    of the block (triangle inequality) are done; the rest, with the pivot, stay.
    """
    pivots = big.join(rows.select(F.col("cls").alias("pivot"), F.col("shingles").alias("pivot_set")), "pivot").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = rows.join(F.broadcast(big.select("block")) if big.count() < 10_000 else big.select("block"), "block", "left_semi").withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(salts)).cast("int"))
    paired = own.join(pivots, ["block", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, hit = [], []
            for x, y in zip(batch.column("shingles"), batch.column("pivot_set"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = _shared(x, y)
                d.append(1 - both / (len(x) + len(y) - both))
                hit.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("block", "cls", "shingles", "pivot")], pa.array(d, pa.float64()), pa.array(hit, pa.bool_())], ["block", "cls", "shingles", "pivot", "d", "hit"])

    met = materialize(paired.mapInArrow(run, "block bigint, cls bigint, shingles binary, pivot bigint, d double, hit boolean"), "pivots")
    links = met.filter("hit and cls != pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b"))
    nearest = met.filter("not hit").groupBy("block").agg(F.min("d").alias("d_rest"), F.min("cls").alias("next"))
    reach = (den - num) / den + 1e-9
    # The next pivot is an unlinked class: blocks are named by it, so that a later round cuts by another one.
    rest = met.join(nearest, "block").filter((~F.col("hit")) | (F.col("d") >= F.col("d_rest") - reach)).select(F.col("next").alias("block"), "cls", "shingles")
    return links, rest


def link_groups(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n and root of every row: rows with shingles are connected by links just if their roots are equal."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    shared: frozenset = frozenset()
    while True:
        profiles = materialize(_profiles(docs, k, shared), "profiles")
        own = profiles.filter("kind = 0").select("doc_id", "n", "cls", "text_hash", "second")
        # Different sets with one number: a handful among ten billion.
        twice = own.groupBy("cls").agg(F.min("second").alias("low"), F.max("second").alias("high")).filter("low != high").select("cls").collect()
        if not twice or shared:
            break
        shared = frozenset(r.cls for r in twice)
    own = own.drop("second")
    total = own.agg(F.sum("n")).first()[0] or 0
    common = profiles.filter("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(4.0, total * COMMON / 2)).select("cls").toArrow()  # at most 2/COMMON
    regions = materialize(_regions(docs, k, num, den, np.sort(common.column("cls").to_numpy().view(np.uint64)), shared), "regions")
    spread = regions.select("cls", F.explode("prefix").alias("s"))
    sizes = spread.groupBy("s").agg(F.count("*").alias("sets")).filter("sets > 1")
    several = spread.join(sizes, "s").select("s", "cls", "sets")
    edges = materialize(_possible_all(several.join(regions.select("cls", "n", "signature"), "cls"), num, den), "possible")
    blocks = components(edges).select(F.col("node").alias("cls"), F.col("root").alias("block"))
    wanted = materialize(regions.select("cls", "text_hash").join(blocks, "cls"), "wanted")
    links = []
    if size := wanted.count():
        hashes = wanted.select("text_hash")
        again = docs.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(hashes) if size <= BROADCAST else hashes, "text_hash", "left_semi").select("text")
        sets = materialize(_sets_of(again, k, shared).dropDuplicates(["cls"]).join(wanted.select("cls", "block"), "cls").select("block", "cls", "shingles"), "sets")
        before = None
        while True:
            big = materialize(sets.groupBy("block").agg(F.min("cls").alias("pivot"), F.sum(F.octet_length("shingles")).alias("n")).filter(F.col("n") > BLOCK).select("block", "n", F.when(F.col("block") == F.col("pivot"), F.col("pivot")).otherwise(F.col("block")).alias("pivot")), "big")
            left = big.agg(F.sum("n")).first()[0]
            if not left or before and left > 0.95 * before:
                break  # no large block, or pivots no longer part them
            before = left
            big = big.select("block", "pivot")
            small = sets.join(big.select("block"), "block", "left_anti")
            found, rest = _meet_pivots(sets, big, num, den)
            links.append(found)
            sets = materialize(small.unionByName(rest), "sets")
        links.append(_exact(sets, num, den))
    if not links:
        return own.select("doc_id", "text_hash", "n", F.col("cls").alias("root"))
    joined = links[0]
    for more in links[1:]:
        joined = joined.unionByName(more)
    roots = components(materialize(joined.distinct(), "links"))
    return own.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("doc_id", "text_hash", "n", F.coalesce("root", "cls").alias("root"))


def link_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id reachable by links, Jaccard of at least num/den."""
    rows = link_groups(docs, k, num, den, doc_id, text)
    smallest = materialize(rows.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    return rows.join(smallest, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group, that of its smallest doc_id (nulls last), then text hash; rows without words stay."""
    rows = materialize(link_groups(docs, k, num, den, doc_id, text).filter("n > 0"), "groups")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    keepers = materialize(rows.groupBy("root").agg(F.min(own).alias("best"), F.count("*").alias("rows")).filter("rows > 1"), "keepers")
    known = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    pairs = rows.join(keepers, "root").withColumn("stays", known)
    marks = materialize(pairs.groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count("*").alias("times")).filter("not stays or times > 1"), "marks")
    counts = marks.agg(F.count("*").alias("n"), F.sum(F.col("stays").cast("int")).alias("twice")).first()
    mark_id, mark_hash, stays, own_hash = free_names(docs.columns, "mark_id", "mark_hash", "stays", "text_hash")
    sides = marks.select(F.col("doc_id").alias(mark_id), F.col("text_hash").alias(mark_hash), F.col("stays").alias(stays))
    sides = F.broadcast(sides) if counts.n <= BROADCAST else sides
    hashed = docs.withColumn(own_hash, F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    met = F.col(f"`{doc_id}`").eqNullSafe(F.col(mark_id)) & (F.col(own_hash) == F.col(mark_hash))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = hashed.join(sides, met, "left_anti").select(*columns)
    if counts.twice:
        # Repeated rows of one id and text, of which one stays.
        again = hashed.join(sides.filter(stays), met, "left_semi").dropDuplicates([doc_id, own_hash]).select(*columns)
        out = out.unionByName(again)
    return out


def _sets_of(texts: DataFrame, k: int, shared: frozenset = frozenset()) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in text_chunks(batch, "text"):
                cls, sets = [], []
                for s in _sets(data, offsets, k):
                    c = _class(s, shared)
                    if len(s) and c not in seen:
                        seen.add(c)
                        cls.append(c)
                        sets.append(s.tobytes())
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], ["cls", "shingles"])

    return texts.mapInArrow(run, "cls bigint, shingles binary")
