"""Window statistics: one row per step and channel.

Location, slope, integral, two-point and autocorrelation parts are grouped aggregates over one join of samples with their
windows by source and time bucket; steps are few, so they are broadcast after their number is checked. Robust parts that no
aggregate expresses run per step in NumPy over the rows inside its window, many steps in one batch.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benchloom.operators.grouped import map_groups

#: Steps that may be sent to every task.
BROADCAST_STEPS = 100_000


def _bucketed(windows: DataFrame, low: str, high: str) -> tuple[DataFrame, float]:
    """Windows with each time bucket they touch, ``__b``, and the buckets' width: the windows' mean length, so at most three each on average.

    They are marked for a broadcast up to ``BROADCAST_STEPS`` of them.
    """
    sizes = windows.agg(F.count("*").alias("n"), F.avg(F.col(high) - F.col(low)).alias("length")).first()
    width = max(float(sizes.length or 0), 1e-3)
    spread = windows.filter(F.col(high) >= F.col(low)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return F.broadcast(spread) if sizes.n <= BROADCAST_STEPS else spread, width


def in_windows(samples: DataFrame, windows: DataFrame, by: list[str], time: str, low: str, high: str) -> DataFrame:
    """Samples with each window of their ``by`` that contains them, both ends closed: only samples and windows of one bucket meet."""
    inside = (F.col(time) >= F.col(low)) & (F.col(time) <= F.col(high))
    spread, width = _bucketed(windows, low, high)
    return samples.withColumn("__b", F.floor(F.col(time) / width)).join(spread, [*by, "__b"]).filter(inside).drop("__b")


def counts(rows: DataFrame, step: list[str], y: str, low: str, high: str, excluded: str | None = None) -> DataFrame:
    """n (usable), n_excluded (finite, but left out), n_missing (rows without a value), window_s; windows without rows are not among ``rows``."""
    finite = F.col(y).isNotNull() & ~F.isnan(y)
    out = F.col(excluded) if excluded else F.lit(False)
    return rows.groupBy(*step).agg(F.count_if(finite & ~out).alias("n"), F.count_if(finite & out).alias("n_excluded"), F.count_if(~finite).alias("n_missing"), F.first(F.col(high) - F.col(low)).alias("window_s"))


def location(rows: DataFrame, step: list[str], y: str) -> DataFrame:
    """n, mean, median, sd, sem, min, max, q05, q95 of finite values."""
    good = rows.filter(F.col(y).isNotNull() & ~F.isnan(y))
    n, sd = F.count(y), F.stddev_samp(y)
    return good.groupBy(*step).agg(n.alias("n"), F.avg(y).alias("mean"), F.median(y).alias("median"), sd.alias("sd"), (sd / F.sqrt(n)).alias("sem"), F.min(y).alias("min"), F.max(y).alias("max"), F.percentile(y, 0.05).alias("q05"), F.percentile(y, 0.95).alias("q95"))


def slope(rows: DataFrame, step: list[str], x: str, y: str, low: str) -> DataFrame:
    """slope, slope_se, intercept (at the window's start), r2, residual_sd; null with fewer than two times."""
    good = rows.filter(F.col(y).isNotNull() & ~F.isnan(y)).withColumn("__x", F.col(x) - F.col(low))
    s = good.groupBy(*step).agg(F.count(y).alias("n"), F.regr_sxx(y, "__x").alias("sxx"), F.regr_syy(y, "__x").alias("syy"), F.regr_sxy(y, "__x").alias("sxy"), F.avg("__x").alias("mx"), F.avg(y).alias("my"))
    m = F.when(F.col("sxx") > 0, F.col("sxy") / F.when(F.col("sxx") > 0, F.col("sxx")))
    sse = F.greatest(F.col("syy") - m * F.col("sxy"), F.lit(0.0))
    rsd = F.when(F.col("n") > 2, F.sqrt(sse / F.when(F.col("n") > 2, F.col("n") - 2)))
    return s.select(*step, m.alias("slope"), (rsd / F.sqrt(F.when(F.col("sxx") > 0, F.col("sxx")))).alias("slope_se"), (F.col("my") - m * F.col("mx")).alias("intercept"), F.when((F.col("syy") > 0) & m.isNotNull(), m * F.col("sxy") / F.when(F.col("syy") > 0, F.col("syy"))).alias("r2"), F.when(m.isNotNull(), rsd).alias("residual_sd"))


def integral(samples: DataFrame, windows: DataFrame, by: list[str], step: list[str], time: str, y: str, low: str, high: str, order: str, gap: str | None = None) -> DataFrame:
    """integral, covered_s, coverage, integral_gap_s of every window: trapezoids of links between neighbouring rows, cut at its edges.

    A link counts where both ends have values, time grows, and (``gap``) its second row begins no new segment.
    """
    w = Window.partitionBy(*by).orderBy(order)
    links = samples.select(*by, F.col(time).alias("t0"), F.col(y).alias("y0"), F.lead(time).over(w).alias("t1"), F.lead(y).over(w).alias("y1"), (F.lead(gap).over(w) if gap else F.lit(False)).alias("cut"))
    links = links.filter("t1 > t0 and y0 is not null and y1 is not null and not cut")
    windows = windows.select(*by, *[s for s in step if s not in by], low, high)
    spread, width = _bucketed(windows, low, high)
    first, last = F.floor(F.col("t0") / width), F.floor(F.col("t1") / width)
    met = links.withColumn("__b", F.explode(F.sequence(first, last))).join(spread, [*by, "__b"]).filter((F.col("t1") > F.col(low)) & (F.col("t0") < F.col(high)))
    # A link and a window that share several buckets count in the first of them.
    met = met.filter(F.col("__b") == F.greatest(first, F.floor(F.col(low) / width)))
    a, b = F.greatest("t0", low), F.least("t1", high)
    at = lambda t: F.col("y0") + (F.col("y1") - F.col("y0")) * (t - F.col("t0")) / (F.col("t1") - F.col("t0"))
    sums = met.groupBy(*step).agg(F.sum((at(a) + at(b)) / 2 * (b - a)).alias("integral"), F.sum(b - a).alias("covered_s"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    length = F.col(high) - F.col(low)
    return windows.join(sums, step, "left").select(*step, zero("integral").alias("integral"), zero("covered_s").alias("covered_s"), (zero("covered_s") / length).alias("coverage"), (length - zero("covered_s")).alias("integral_gap_s"))


def two_point(rows: DataFrame, step: list[str], x: str, y: str, low: str, high: str, order: str, half_width: float = 0.0, reading_u: float = 0.0, clock_u: float = 0.0) -> DataFrame:
    """two_point (change per second between the window's ends), two_point_u, two_point_dt, two_point_offset_s.

    An end's value is the nearest usable one, or the median of those within ``half_width`` of the end, at their mean time. The
    uncertainty has that of both values (of a median: 1.2533 s/√n, with ``reading_u``) and twice the clock's.
    """
    good = rows.filter(F.col(y).isNotNull() & ~F.isnan(y))

    def end(at: str) -> list:
        apart = F.abs(F.col(x) - F.col(at))
        if half_width <= 0:
            return [F.min_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(reading_u).alias("u"), F.col(at).alias("at")), F.struct(apart, order))]
        near = lambda c: F.when(apart <= half_width, F.col(c))
        n = F.count(near(y))
        return [F.when(n > 0, F.struct(F.avg(near(x)).alias("x"), F.median(near(y)).alias("y"), F.hypot(F.coalesce(1.2533 * F.stddev_samp(near(y)) / F.sqrt(n), F.lit(0.0)), F.lit(reading_u)).alias("u"), F.first(at).alias("at")))]

    c = F.col
    ends = good.groupBy(*step).agg(end(low)[0].alias("a"), end(high)[0].alias("b")).withColumn("dt", c("b.x") - c("a.x")).withColumn("dy", c("b.y") - c("a.y"))
    dt = F.when(c("dt") > 0, c("dt"))
    u = F.sqrt((c("a.u") ** 2 + c("b.u") ** 2) / dt**2 + (c("dy") / dt**2) ** 2 * (2 * clock_u**2))
    offset = F.greatest(F.abs(c("a.x") - c("a.at")), F.abs(c("b.x") - c("b.at")))
    return ends.select(*step, (c("dy") / dt).alias("two_point"), u.alias("two_point_u"), dt.alias("two_point_dt"), F.when(dt.isNotNull(), offset).alias("two_point_offset_s"))


def autocorrelation(rows: DataFrame, step: list[str], y: str, order: str) -> DataFrame:
    """rho1 of neighbouring values, n_eff = n(1-rho)/(1+rho) (from 1 to n), sem_eff = sd/sqrt(n_eff)."""
    good = rows.filter(F.col(y).isNotNull() & ~F.isnan(y))
    centred = good.withColumn("__c", F.col(y) - F.avg(y).over(Window.partitionBy(*step)))
    centred = centred.withColumn("__p", F.lag("__c").over(Window.partitionBy(*step).orderBy(order)))
    s = centred.groupBy(*step).agg(F.count(y).alias("n"), F.sum(F.col("__c") * F.col("__p")).alias("cp"), F.sum(F.col("__c") ** 2).alias("cc"), F.stddev_samp(y).alias("sd"))
    rho = F.when((F.col("n") > 2) & (F.col("cc") > 0), F.col("cp") / F.when(F.col("cc") > 0, F.col("cc")))
    s = s.withColumn("rho1", rho)
    n_eff = F.when(F.col("rho1") > 0, F.greatest(F.col("n") * (1 - F.col("rho1")) / (1 + F.col("rho1")), F.lit(1.0))).otherwise(F.col("n").cast("double"))
    return s.withColumn("n_eff", n_eff).select(*step, "rho1", "n_eff", (F.col("sd") / F.sqrt("n_eff")).alias("sem_eff"))


def durbin_watson(rows: DataFrame, step: list[str], x: str, y: str, low: str, order: str, floor: float = 1e-12) -> DataFrame:
    """Durbin-Watson of the residuals of the straight line; null where their squares sum up to ``floor`` at most."""
    good = rows.filter(F.col(y).isNotNull() & ~F.isnan(y)).withColumn("__x", F.col(x) - F.col(low))
    line = good.groupBy(*step).agg(F.regr_slope(y, "__x").alias("__m"), F.regr_intercept(y, "__x").alias("__b"), F.count(y).alias("__n"))
    r = good.join(line, step).filter("__n > 2").withColumn("__r", F.col(y) - F.col("__m") * F.col("__x") - F.col("__b"))
    r = r.withColumn("__d", F.col("__r") - F.lag("__r").over(Window.partitionBy(*step).orderBy(order)))
    s = r.groupBy(*step).agg(F.sum(F.col("__d") ** 2).alias("a"), F.sum(F.col("__r") ** 2).alias("b"))
    return s.select(*step, F.when(F.col("b") > floor, F.col("a") / F.when(F.col("b") > floor, F.col("b"))).alias("durbin_watson"))


def hac_slope_se(x: np.ndarray, y: np.ndarray) -> float:
    """Newey-West standard error of the slope: Bartlett weights, floor(4 (n/100)^(2/9)) lags, factor n/(n-2)."""
    n = len(x)
    if n < 3 or np.ptp(x) == 0:
        return float("nan")
    c = x - x.mean()
    m = (c * y).sum() / (c * c).sum()
    g = c * (y - y.mean() - m * c)
    total = (g * g).sum()
    lags = int(4 * (n / 100) ** (2 / 9))
    for k in range(1, min(lags, n - 1) + 1):
        total += 2 * (1 - k / (lags + 1)) * (g[k:] * g[:-k]).sum()
    return float(np.sqrt(max(total, 0) * n / (n - 2)) / (c * c).sum())


def lag1(d: np.ndarray) -> float:
    """Autocorrelation of neighbouring deviations; nan below three of them or without spread."""
    return float(d[1:] @ d[:-1] / (d @ d)) if len(d) > 2 and (d * d).sum() > 0 else float("nan")


def widening(rho: float) -> float:
    """By how much correlation of neighbours widens a variance: (1+ρ)/(1-ρ), 1 where ρ is not positive."""
    return (1 + rho) / (1 - rho) if 0 < rho < 1 else 1.0


def _ties(v: np.ndarray) -> float:
    times = np.unique(v, return_counts=True)[1].astype(float)
    return float((times * (times - 1) * (2 * times + 5)).sum())


def theil_sen(x: np.ndarray, y: np.ndarray, confidence: float = 0.95, all_pairs: int = 1000, sample: int = 499_500, seed: int = 0) -> tuple[float, float, float, float]:
    """Median slope of pairs, its intercept, and an interval by ranks; beyond ``all_pairs`` points a seeded sample of pairs.

    The interval is Kendall's: the variance of its sum with ties of both sides, widened for correlated residuals, gives ranks
    among all pairs of different times, which are scaled to the sample's.
    """
    n = len(x)
    if n < 3 or np.ptp(x) == 0:
        return (float("nan"),) * 4
    i, j = np.triu_indices(n, 1) if n <= all_pairs else np.random.default_rng(seed).integers(0, n, (2, sample))
    apart = x[j] != x[i]
    s = np.sort((y[j] - y[i])[apart] / (x[j] - x[i])[apart])
    m = float(np.median(s))
    own = np.unique(x, return_counts=True)[1]
    pairs = n * (n - 1) // 2 - int((own * (own - 1) // 2).sum())
    left = y - m * x
    variance = (n * (n - 1) * (2 * n + 5) - _ties(x) - _ties(y)) / 18 * widening(lag1(left - np.median(left)))
    half = NormalDist().inv_cdf((1 + confidence) / 2) * np.sqrt(max(variance, 0.0))
    ranks = [max(round((pairs - half) / 2) - 1, 0), min(round((pairs + half) / 2), pairs - 1)]
    if len(s) != pairs:
        ranks = [round(r / max(pairs - 1, 1) * (len(s) - 1)) for r in ranks]
    return m, float(np.median(left)), float(s[ranks[0]]), float(s[ranks[1]])


def _half(v: np.ndarray) -> tuple[float, float]:
    """Mean of one half of a window, and the square of its standard error with correlated neighbours."""
    d = v - v.mean()
    n_eff = max(len(v) / widening(lag1(d)), 1.0) if np.ptp(v) else float(len(v))
    return float(v.mean()), float((d @ d) / (len(v) - 1) / n_eff) if np.ptp(v) else 0.0


def steady(diff: float, u: float, confidence: float = 0.95) -> bool:
    """Whether a difference is not significant, at half the error of the two tests together."""
    return abs(diff) <= NormalDist().inv_cdf(1 - (1 - confidence) / 4) * u if u else diff == 0


ROBUST = ("slope_se_hac", "slope_se_ar1", "slope_se_eff", "durbin_watson", "slope_theil_sen", "intercept_theil_sen", "ts_ci_low", "ts_ci_high", "halves_diff", "halves_u")


def robust(rows: DataFrame, step: list[str], x: str, y: str, low: str, high: str) -> DataFrame:
    """ROBUST and ``stationary`` per step: standard errors of the slope that allow for correlated neighbours (Newey-West, AR(1), the
    larger of both), Theil and Sen's slope with its interval, the difference of the window's halves and its error; null where too few points allow none.

    Stationary: neither the slope (by the larger error) nor the halves' difference is significant.
    """
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in step)

    def one(g: dict) -> dict:
        good = np.isfinite(g[y].astype(float))
        out: dict[str, float | bool | None] = dict.fromkeys((*ROBUST, "stationary"))
        if not good.any():
            return {n: [] for n in out}
        t, v = g[x][good].astype(float) - g[low][0], g[y][good].astype(float)
        verdicts = []
        if len(t) > 2 and np.ptp(t):
            c = t - t.mean()
            m = (c @ v) / (c @ c)
            e = v - v.mean() - m * c
            se, rho = np.sqrt((e @ e) / (len(t) - 2) / (c @ c)), lag1(e)
            out["slope_se_hac"] = hac_slope_se(t, v)
            out["slope_se_ar1"] = None if rho >= 1 else se * widening(rho) ** 0.5
            out["slope_se_eff"] = max(z for z in (out["slope_se_hac"], out["slope_se_ar1"]) if z is not None)
            out["durbin_watson"] = float((np.diff(e) ** 2).sum() / (e @ e)) if (e @ e) > 0 else None
            verdicts.append(steady(m, out["slope_se_eff"]))
        out |= dict(zip(("slope_theil_sen", "intercept_theil_sen", "ts_ci_low", "ts_ci_high"), theil_sen(t, v), strict=True))
        first = t < (g[high][0] - g[low][0]) / 2
        if first.sum() > 2 and (~first).sum() > 2:
            (a, ua), (b, ub) = _half(v[first]), _half(v[~first])
            out["halves_diff"], out["halves_u"] = b - a, (ua + ub) ** 0.5
            verdicts.append(steady(b - a, out["halves_u"]))
        out["stationary"] = bool(all(verdicts)) if verdicts else None
        return {n: [None if z is None or z != z else z] for n, z in out.items()}

    used = rows.select(*dict.fromkeys([*step, x, y, low, high]))
    return map_groups(used, step, [x], one, kinds + "".join(f", {n} double" for n in ROBUST) + ", stationary boolean")
