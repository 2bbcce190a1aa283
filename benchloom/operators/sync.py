"""Clock offsets by correlation of two signals on one grid, with checks of how far the result can be trusted."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.operators.grouped import map_groups

#: Limits of the checks: weak and failed correlation, margin of a second peak, overlap.
WARN_R, FAIL_R, AMBIGUOUS, MIN_OVERLAP = 0.7, 0.3, 0.05, 0.5

#: Grid points of a block.
BLOCK = 1 << 16
SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def products(a: np.ndarray, b: np.ndarray, max_lag: int, mean_a: float = 0.0, mean_b: float = 0.0) -> np.ndarray:
    """Count and sums of x, y, xx, yy, xy (rows) of all pairs ``a[i], b[i + max_lag + lag]`` for each lag (columns), by FFT.

    ``b`` is longer than ``a`` by ``max_lag`` on either side; values are centred by the means; missing ones (nan) take no part.
    """
    n = 1 << int(np.ceil(np.log2(max(len(b), 2))))
    ma, mb = np.isfinite(a).astype(float), np.isfinite(b).astype(float)
    x, y = np.where(ma > 0, a - mean_a, 0.0), np.where(mb > 0, b - mean_b, 0.0)
    left = {k: np.conj(np.fft.rfft(v, n)) for k, v in (("1", ma), ("x", x), ("xx", x * x))}
    right = {k: np.fft.rfft(v, n) for k, v in (("1", mb), ("y", y), ("yy", y * y))}
    pairs = (("1", "1"), ("x", "1"), ("1", "y"), ("xx", "1"), ("1", "yy"), ("x", "y"))
    out = np.stack([np.fft.irfft(left[p] * right[q], n)[: 2 * max_lag + 1] for p, q in pairs])
    out[0] = np.round(out[0])
    return out


def pearson(sums: np.ndarray, square: float) -> np.ndarray:
    """Pearson's r by lag from ``products``; nan with fewer than three pairs or none but equal values (against ``square``)."""
    count, sx, sy, sxx, syy, sxy = sums
    safe = np.maximum(count, 1)
    vx, vy = sxx - sx**2 / safe, syy - sy**2 / safe
    floor = 1e-9 * max(square, 1e-300)
    ok = (count >= 3) & (vx > floor) & (vy > floor)
    return np.where(ok, (sxy - sx * sy / safe) / np.sqrt(np.where(ok, vx * vy, 1.0)), np.nan)


def correlation_curve(a: np.ndarray, b: np.ndarray, max_lag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lags, Pearson's r and overlap of ``b`` shifted against ``a``, two arrays on one grid; missing values (nan) take no part."""
    means = [float(np.nanmean(v)) if np.isfinite(v).any() else 0.0 for v in (a, b)]
    beyond = np.full(max_lag, np.nan)
    around = np.concatenate([beyond, b, np.full(max(len(a) - len(b), 0), np.nan), beyond])
    sums = products(a, around, max_lag, *means)
    square = max(float(np.nansum((v - m) ** 2)) for v, m in zip((a, b), means))
    return np.arange(-max_lag, max_lag + 1), pearson(sums, square), sums[0]


def best_lag(a: np.ndarray, b: np.ndarray, max_lag: int) -> dict[str, object]:
    """judged_lag of two arrays on one grid."""
    lags, r, count = correlation_curve(a, b, max_lag)
    return judged_lag(lags, r, count, min(np.isfinite(a).sum(), np.isfinite(b).sum()))


def judged_lag(lags: np.ndarray, r: np.ndarray, count: np.ndarray, short: int) -> dict[str, object]:
    """lag (with a parabola's fraction), r, overlap (share of the shorter signal) and checks."""
    short = max(short, 1)
    usable = np.where(count >= MIN_OVERLAP * short, r, np.nan)
    if not np.isfinite(usable).any():
        return {"lag": np.nan, "r": np.nan, "overlap": 0.0, "checks": ["fail: no lag with enough overlap"]}
    k = int(np.nanargmax(usable))
    lag, checks = float(lags[k]), []
    if 0 < k < len(r) - 1 and np.isfinite(r[k - 1 : k + 2]).all():
        bend = r[k - 1] - 2 * r[k] + r[k + 1]
        lag += float(0.5 * (r[k - 1] - r[k + 1]) / bend) if bend < 0 else 0.0
    else:
        checks.append("warn: at the edge of the range")
    if r[k] < FAIL_R:
        checks.append("fail: no correlation")
    elif r[k] < WARN_R:
        checks.append("warn: weak correlation")
    peaks = [i for i in range(1, len(r) - 1) if np.isfinite(usable[i - 1 : i + 2]).all() and usable[i] >= usable[i - 1] and usable[i] > usable[i + 1] and abs(i - k) > 1]
    if peaks and max(usable[i] for i in peaks) > r[k] - AMBIGUOUS:
        checks.append("warn: another lag is as good")
    return {"lag": lag, "r": float(r[k]), "overlap": float(count[k] / short), "checks": checks}


def cross_correlate(a: DataFrame, b: DataFrame, by: list[str], k: str, value: str, max_lag: int, block: int | None = None) -> DataFrame:
    """by, lag, r, overlap, checks: one row per group of two signals on a grid with index ``k`` (missing points allowed).

    The first signal is cut into blocks of the grid; each block meets the second signal's points up to ``max_lag`` beyond it and
    leaves sums by lag, which are added up over blocks: a task holds one block, and a group's curve has 2 max_lag + 1 lags. Groups
    that are in one signal only have no row; points without a number take no part; of points with one index one counts.
    """
    size = max(block or BLOCK, 2 * max_lag, 1)
    kinds = ", ".join(f"`{c}` {a.schema[c].dataType.simpleString()}" for c in by)
    # Columns of their own names: both sides may come from one table.
    left, right = (df.select(*by, F.col(k).cast("long").alias("at"), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v) and abs(v) < double('inf')") for df in (a, b))
    totals = lambda df, n: df.groupBy(*by).agg(F.count("v").alias(f"n_{n}"), F.avg("v").alias(f"mean_{n}"), (F.var_pop("v") * F.count("v")).alias(f"square_{n}"))
    both = totals(left, "a").join(totals(right, "b"), by)
    means = both.select(*by, "mean_a", "mean_b")
    of = F.floor(F.col("at") / size)
    near = F.explode(F.sequence(F.floor((F.col("at") - max_lag) / size), F.floor((F.col("at") + max_lag) / size)))
    left = left.join(means, by).select(*by, of.alias("__block"), F.lit(0).alias("__side"), "at", "v", "mean_a", "mean_b")
    sides = left.unionByName(right.select(*by, near.alias("__block"), F.lit(1).alias("__side"), "at", "v"), allowMissingColumns=True)

    def summed(rows: dict) -> dict:
        own = rows["__side"] == 0
        if not own.any() or own.all():
            return {c: [] for c in ("at", *SUMS)}
        # Only the span that the block's points cover: short groups need no transform of a whole block.
        start, end = int(rows["at"][own].min()), int(rows["at"][own].max())
        x, y = np.full(end - start + 1, np.nan), np.full(end - start + 1 + 2 * max_lag, np.nan)
        x[rows["at"][own] - start] = rows["v"][own]
        other = ~own & (rows["at"] >= start - max_lag) & (rows["at"] <= end + max_lag)
        y[rows["at"][other] - start + max_lag] = rows["v"][other]
        sums = products(x, y, max_lag, rows["mean_a"][own][0], rows["mean_b"][own][0])
        return {"at": range(-max_lag, max_lag + 1), **dict(zip(SUMS, sums, strict=True))}

    parts = map_groups(sides, [*by, "__block"], ["__side", "at", "v"], summed, kinds + ", __block long, at long, " + ", ".join(f"{c} double" for c in SUMS))
    curve = parts.groupBy(*by, "at").agg(*[F.sum(c).alias(c) for c in SUMS])
    curves = both.select(*by, F.least("n_a", "n_b").alias("short"), F.greatest("square_a", "square_b").alias("square")).join(curve, by, "left")

    def judged(rows: dict) -> dict:
        there = np.isfinite(rows["at"].astype(float))
        lags, sums = (rows["at"][there].astype(int), np.stack([rows[c][there] for c in SUMS])) if there.any() else (np.zeros(1, int), np.zeros((len(SUMS), 1)))
        best = judged_lag(lags, pearson(sums, float(rows["square"][0])), sums[0], int(rows["short"][0]))
        return {c: [v] for c, v in best.items()}

    return map_groups(curves, by, ["at"], judged, kinds + ", lag double, r double, overlap double, checks array<string>")
