"""Embedding whitening: principal components by block subspace iteration, without a covariance matrix.

Entries become whole numbers, ``x = floor(1024 c) + 100000``, so that sums and distances from the mean are exact. Each pass
of Spark multiplies the covariance V of the centred rows with one block of directions Q: a task adds ``Xᵀ(XQ)`` of its rows in
double precision, and the partial products are summed by row of the product. The driver holds nothing of the data but such
products (dimension x block). There the block is made orthonormal against what is known (QR), the best ``block`` directions
within all of it follow by Rayleigh-Ritz, and their residuals ``V u - e u`` are the next block. Products of earlier passes
stay in the Rayleigh-Ritz basis up to ``basis`` directions, then it restarts from its best ones: near-equal eigenvalues, which
plain subspace iteration takes thousands of passes to part, cost as many passes as blocks fit into the dimension. It ends
when a pass over the found components themselves shows residuals below ``tolerance`` of the largest eigenvalue for all.

Defined results: vectors that are null or hold null or non-finite entries take no part, nor do empty ones and entries that no
long can hold; where lengths differ, those of the most frequent length (the longer at a tie) take part. Repeated rows and
rows without id count each. Fewer than ``k`` components come back where the vectors span fewer directions (none where all are
equal). Other columns stay, whatever their names. Without usable vectors the result is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchloom.llm.common import bound_batches, free_names, materialize

SCALE, SHIFT = 1024.0, 100_000
#: Cells of a batch that one step works on.
CELLS = 1 << 20
#: Entries beyond this leave the range of longs.
_LARGEST = float(2**62) / SCALE


@dataclass
class Whitening:
    """The fitted map: rows, sums by dimension, eigenvalues (falling) and unit components (columns), share of the variance of each."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector takes part, vectors as doubles."""
    v = F.col(f"`{vector}`").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < _LARGEST))
    rows = vectors.filter(v.isNotNull() & (F.size(v) > 0) & whole)
    sizes = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size(v) == (sizes.d if sizes else 0))


def _whole(batch: pa.RecordBatch, vector: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of a batch and their entries as whole numbers."""
    if not batch.num_rows:
        return
    step = max(1, CELLS // max(1, len(batch.column(vector)[0])))
    for at in range(0, batch.num_rows, step):
        piece = batch.slice(at, step)
        cells = piece.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield piece, np.floor(cells * SCALE).astype(np.int64).reshape(piece.num_rows, -1) + SHIFT


def _scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n x - S``, exact: longs where they hold it, else Python's integers."""
    top = int(np.abs(x).max(initial=0))
    if top * n + max((abs(int(s)) for s in sums), default=0) < 2**62:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _summed(df: DataFrame, vector: str, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what ``part`` makes of a piece: a matrix of ``width`` columns, whose rows are summed apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _whole(batch, vector):
                total = part(x) if total is None else total + part(x)
        if total is not None:
            flat = pa.array(total.ravel())
            yield pa.record_batch({"i": pa.array(np.arange(len(total), dtype=np.int64)), "p": pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * width), flat)})

    parts = df.select(F.col(f"`{vector}`").cast("array<double>").alias(vector)).mapInArrow(run, "i long, p array<double>")
    rows = parts.groupBy("i").agg(*[F.sum(F.col("p")[j]).alias(f"p{j}") for j in range(width)]).collect()
    return np.array([r[1:] for r in sorted(rows)], np.float64).reshape(-1, width)


def _sums(df: DataFrame, vector: str) -> tuple[int, list[int]]:
    """Rows and exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for piece, x in _whole(batch, vector):
                n += piece.num_rows
                small = int(np.abs(x).max(initial=0)) * len(x) < 2**62
                s = x.sum(axis=0) if small else x.astype(object).sum(axis=0)
                total = s.astype(object) if total is None else total + s
        if total is not None:
            # Two limbs, so that sums of limbs stay within decimals whatever the entries.
            yield pa.record_batch({"i": pa.array(range(len(total)), pa.int64()), "n": pa.array([n] * len(total), pa.int64()), "high": pa.array([int(s) >> 40 for s in total], pa.int64()), "low": pa.array([int(s) & (2**40 - 1) for s in total], pa.int64())})

    parts = df.select(F.col(f"`{vector}`").cast("array<double>").alias(vector)).mapInArrow(run, "i long, n long, high long, low long")
    wide = {c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")}
    rows = sorted(parts.groupBy("i").agg(F.sum("n").alias("n"), *wide.values()).collect())
    return (rows[0].n, [(int(r.high) << 40) + int(r.low) for r in rows]) if rows else (0, [])


def _orthonormal(new: np.ndarray, known: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to ``known``; directions lost to rounding are left out."""
    for _ in range(3):
        new = new - known @ (known.T @ new)
        norms = np.linalg.norm(new, axis=0)
        new = new[:, norms > 0] / norms[norms > 0]
    if not new.shape[1]:
        return new
    q, s, _ = np.linalg.svd(new, full_matrices=False)
    q = q[:, s > 1e-10 * max(1.0, s[0])]
    q = q - known @ (known.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def fit(vectors: DataFrame, vector: str = "embedding", k: int = 8, block: int = 16, basis: int = 256, tolerance: float = 1e-12, max_passes: int = 500, seed: int = 1) -> Whitening:
    """The first ``k`` components of ``vectors`` (rows that ``usable`` keeps, read once a pass; store them first)."""
    n, sums = _sums(vectors, vector)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    exact = np.array(sums, object)
    d = len(sums)
    k, block = min(k, d), min(max(block, k), d)
    basis = min(d, max(basis, 4 * block))

    def centred(x: np.ndarray) -> np.ndarray:
        return _scaled(x, n, exact).astype(np.float64) / n

    trace = float(_summed(vectors, vector, 1, lambda x: np.array([[float((centred(x) ** 2).sum())]]))[0, 0]) / n
    if trace == 0:
        return Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0.0, 0)

    def times(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ q)

        return _summed(vectors, vector, q.shape[1], part) / n

    known, product = np.zeros((d, 0)), np.zeros((d, 0))
    new = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, block)))[0]
    passes = 0
    while True:
        if passes >= max_passes:
            raise RuntimeError(f"residuals of {k} components are not below {tolerance} after {passes} passes")
        known, product = np.hstack([known, new]), np.hstack([product, times(new)])
        passes += 1
        small = known.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        best = known @ turn[:, :block]
        residual = product @ turn[:, :block] - best * values[:block]
        wrong = np.linalg.norm(residual, axis=0) / max(values[0], trace / d)
        new = _orthonormal(residual[:, wrong > tolerance / 100], known) if known.shape[1] < d else np.zeros((d, 0))
        if wrong[:k].max() > tolerance and new.shape[1]:
            if known.shape[1] + new.shape[1] > basis:
                keep = turn[:, : max(2 * block, basis // 2)]
                known, product = known @ keep, product @ keep
            continue
        # The components themselves go through one more pass, so that rounding gathered in the basis does not count.
        u = np.linalg.qr(best[:, :k])[0]
        again = times(u)
        passes += 1
        inner = u.T @ again
        e, turn = np.linalg.eigh((inner + inner.T) / 2)
        e, turn = e[::-1], turn[:, ::-1]
        u, again = u @ turn, again @ turn
        if np.linalg.norm(again - u * e, axis=0).max() <= 100 * tolerance * max(e[0], trace / d) or not new.shape[1]:
            break
    rank = int((e > 1e-10 * max(e[0], trace / d)).sum())
    u, e = u[:, :rank], e[:rank]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(rank)])
    model = Whitening(n, sums, e, u, e / trace, 0.0, passes)
    model.identity_error = _identity_error(vectors, vector, model) if rank else 0.0
    return model


def _identity_error(vectors: DataFrame, vector: str, model: Whitening) -> float:
    """The largest entry of the covariance of the whitened rows minus the identity."""
    r, n = len(model.values), model.n
    exact, turn = np.array(model.sums, object), model.components / np.sqrt(model.values)

    def part(x: np.ndarray) -> np.ndarray:
        w = _scaled(x, n, exact).astype(np.float64) / n @ turn
        return np.vstack([w.T @ w, w.sum(axis=0)])

    total = _summed(vectors, vector, r, part) / n
    return float(np.abs(total[:r] - np.outer(total[r], total[r]) - np.eye(r)).max())


def transform(vectors: DataFrame, model: Whitening, vector: str = "embedding", out: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """``vectors`` with the whitened coordinates (array) and the exact sum of ``(n x - S)^2`` (decimal)."""
    spark = vectors.sparkSession
    bound_batches(spark)
    out, deviation, key = free_names(vectors.columns, out, deviation, "numbers")
    schema = T.StructType([*vectors.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType())), T.StructField(deviation, T.StringType())])
    n, exact = model.n, np.array(model.sums, object)
    turn = model.components / np.sqrt(model.values)
    names = [*vectors.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, x in _whole(batch, key):
                z = _scaled(x, n, exact)
                small = z.dtype != object and float(np.abs(z).max(initial=0)) ** 2 * z.shape[1] < 2**62
                squares = (z * z).sum(axis=1) if small else (z.astype(object) ** 2).sum(axis=1)
                w = z.astype(np.float64) / n @ turn
                white = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in range(len(names))], white, pa.array([str(s) for s in squares.tolist()], pa.string())], [*names, out, deviation])

    rows = vectors.withColumn(key, F.col(f"`{vector}`").cast("array<double>")).mapInArrow(run, schema)
    return rows.withColumn(deviation, F.col(f"`{deviation}`").cast("decimal(38,0)"))


def whiten(vectors: DataFrame, vector: str = "embedding", k: int = 8) -> tuple[DataFrame, Whitening]:
    """The usable rows with their whitened coordinates, and the map."""
    rows = materialize(usable(vectors, vector), "vectors")
    model = fit(rows, vector, k)
    return transform(rows, model, vector), model


def components(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8) -> DataFrame:
    """One row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows, model = whiten(vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("embedding")), "embedding", k)
    shares = F.array(*[F.lit(float(s)) for s in model.explained]).cast("array<double>")
    parts = rows.select("vec_id", F.col("deviation").cast("bigint").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return parts.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
