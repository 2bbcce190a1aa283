"""Analyses across steps: crossings of a level, straight lines with errors in both axes, covariances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crossing(df: DataFrame, by: list[str], x: str, y: Column, level: float, name: str = "x_cross") -> DataFrame:
    """Per group the first x, in x order, at which y passes ``level`` (linear between points); null where it does not."""
    good = df.withColumn("__y", y.cast("double")).filter(F.col(x).isNotNull() & F.col("__y").isNotNull() & ~F.isnan("__y"))
    w = Window.partitionBy(*by).orderBy(x, "__y")
    good = good.withColumn("__x1", F.lead(x).over(w)).withColumn("__y1", F.lead("__y").over(w))
    hit = ((F.col("__y") - level) * (F.col("__y1") - level) <= 0) & (F.col("__y") != F.col("__y1"))
    at = F.col(x) + (level - F.col("__y")) * (F.col("__x1") - F.col(x)) / F.when(F.col("__y1") != F.col("__y"), F.col("__y1") - F.col("__y"))
    return good.groupBy(*by).agg(F.min_by(F.when(hit, at), F.when(hit, F.struct(x, "__y"))).alias(name), F.count("*").alias("n"))


def crossing_range(df: DataFrame, by: list[str], x: str, y: str, u: str, level: float) -> DataFrame:
    """n, x_cross, and where y - u and y + u cross, the smaller first."""
    mid = crossing(df, by, x, F.col(y), level)
    low, high = (crossing(df, by, x, F.col(y) + sign * F.col(u), level, name).drop("n") for sign, name in ((-1, "__a"), (1, "__b")))
    out = mid.join(low, by, "left").join(high, by, "left")
    return out.select(*by, "n", "x_cross", F.least("__a", "__b").alias("x_low"), F.greatest("__a", "__b").alias("x_high"))


def crossing_text(df: DataFrame, by: list[str], x: str, y: str, level: float, unit: str = "") -> DataFrame:
    """by, text: the crossing in whole numbers (half to even), or on which side of the curve it lies (``> 350``), – for none."""
    good = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(y))
    ends = good.groupBy(*by).agg(F.min_by(y, F.struct(x, y)).alias("a"), F.max_by(y, F.struct(x, y)).alias("b"), F.min(y).alias("low"), F.max(y).alias("high"), F.min(x).alias("first"), F.max(x).alias("last"))
    c = F.col
    before = F.when(c("b") >= c("a"), ~(c("high") < level) & (c("low") >= level)).otherwise(~(c("low") > level) & (c("high") <= level))
    whole = lambda v: F.concat(F.format_string("%.0f", F.bround(v)), F.lit(f" {unit}" if unit else ""))
    met = df.select(*by).distinct().join(crossing(df, by, x, F.col(y), level).drop("n"), by, "left").join(ends, by, "left")
    text = F.when(c("x_cross").isNotNull(), whole(c("x_cross"))).when(c("first").isNull(), "–").when(before, F.concat(F.lit("< "), whole(c("first")))).otherwise(F.concat(F.lit("> "), whole(c("last"))))
    return met.select(*by, text.alias("text"))


def derived_quantities(fit: DataFrame, by: list[str], formulas: dict[str, str], constants: dict[str, float] | None = None) -> DataFrame:
    """by, and for each formula over m, b, constants and formulas before it its value and u, from a line's u_m, u_b and cov_mb.

    Slope and intercept of a line depend on each other: without ``cov_mb`` (see fit_line's ``with_cov``) they are taken as independent.
    """
    from benchloom.functions import formula
    from benchloom.operators import evaluate

    c, given = F.col, {n: F.lit(float(v)) for n, v in (constants or {}).items()}
    env = {"m": c("m"), "b": c("b"), **given}
    inputs = {n: evaluate.Input(v, c(f"u_{n}") if n in ("m", "b") else None) for n, v in env.items()}
    cov = c("cov_mb") if "cov_mb" in fit.columns else F.lit(0.0)
    known: dict[str, evaluate.Budget] = {}
    out = []
    for name, text in formulas.items():
        budget = known[name] = evaluate.differentiate(text, known, inputs)
        by_m, by_b = (formula.to_column(budget.gradients[n], env) if n in budget.gradients else F.lit(0.0) for n in ("m", "b"))
        square = (by_m * c("u_m")) ** 2 + (by_b * c("u_b")) ** 2 + 2 * by_m * by_b * cov
        out += [formula.to_column(budget.node, env).alias(name), F.sqrt(F.greatest(square, F.lit(0.0))).alias(f"u_{name}")]
    return fit.select(*by, *out)


def fit_line(df: DataFrame, by: list[str], x: str, y: str, u_x: str, u_y: str, iterations: int = 5, with_cov: bool = False) -> DataFrame:
    """n, m, u_m, b, u_b, chi2_red, birge (and cov_mb): effective variance u_y² + (m u_x)², each round five weighted sums.

    Uncertainties of m and b are widened by the Birge factor where it exceeds 1. Groups with fewer than three points or
    one x have no line.
    """
    good = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.col(u_y) > 0)).select(*by, F.col(x).alias("x"), F.col(y).alias("y"), F.col(u_x).alias("ux"), F.col(u_y).alias("uy"))
    line = good.groupBy(*by).agg(F.regr_slope("y", "x").alias("m"))
    for i in range(iterations):
        weighed = good.join(line.select(*by, "m"), by).withColumn("w", 1 / (F.col("uy") ** 2 + (F.coalesce("m", F.lit(0.0)) * F.col("ux")) ** 2))
        w, wx, wy, wxx, wxy, wyy = (F.sum(c) for c in (F.col("w"), F.col("w") * F.col("x"), F.col("w") * F.col("y"), F.col("w") * F.col("x") ** 2, F.col("w") * F.col("x") * F.col("y"), F.col("w") * F.col("y") ** 2))
        s = weighed.groupBy(*by).agg(F.count("*").alias("n"), w.alias("w"), wx.alias("wx"), wy.alias("wy"), wxx.alias("wxx"), wxy.alias("wxy"), wyy.alias("wyy"))
        det = F.col("w") * F.col("wxx") - F.col("wx") ** 2
        det = F.when(det > 1e-12 * F.col("w") * F.col("wxx"), det)
        m = (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / det
        b = (F.col("wxx") * F.col("wy") - F.col("wx") * F.col("wxy")) / det
        line = s.withColumn("m", m).withColumn("b", b).withColumn("u_m", F.sqrt(F.col("w") / det)).withColumn("u_b", F.sqrt(F.col("wxx") / det)).withColumn("cov_mb", -F.col("wx") / det)
    c = F.col
    chi2 = c("wyy") + c("m") ** 2 * c("wxx") + c("b") ** 2 * c("w") - 2 * c("m") * c("wxy") - 2 * c("b") * c("wy") + 2 * c("m") * c("b") * c("wx")
    line = line.filter("n > 2").withColumn("chi2_red", F.greatest(chi2, F.lit(0.0)) / (c("n") - 2)).withColumn("birge", F.greatest(F.sqrt("chi2_red"), F.lit(1.0)))
    return line.select(*by, "n", "m", (c("u_m") * c("birge")).alias("u_m"), "b", (c("u_b") * c("birge")).alias("u_b"), "chi2_red", "birge", *([(c("cov_mb") * c("birge") ** 2).alias("cov_mb")] if with_cov else []))


def covariance(df: DataFrame, key: str, gradients: dict[str, str], random: dict[str, str], systematic: dict[str, str], scope: list[str]) -> DataFrame:
    """key, scope, own, c_<input>: the covariance of a table's rows as a diagonal and factors, a row for each of them.

    Of two rows of one scope it is the sum of the products of their c_<input> (systematic contributions), plus ``own`` (random
    ones) where both are the same row; rows of different scopes share nothing. ``random`` and ``systematic`` map inputs to
    columns of uncertainties, ``gradients`` to columns of derivatives. No pairs are made.
    """
    c = {n: F.col(gradients[n]) * F.col(u) for n, u in {**random, **systematic}.items()}
    own = sum((c[n] ** 2 for n in random), F.lit(0.0))
    return df.select(F.col(key), *scope, own.alias("own"), *[c[n].alias(f"c_{n}") for n in systematic])


def crossing_systematic(df: DataFrame, by: list[str], x: str, y: str, u: str, u_syst: str, level: float) -> DataFrame:
    """crossing_range by the whole uncertainty, and x_low_syst, x_high_syst by its systematic part alone."""
    both = crossing_range(df, by, x, y, u, level)
    part = crossing_range(df, by, x, y, u_syst, level).select(*by, F.col("x_low").alias("x_low_syst"), F.col("x_high").alias("x_high_syst"))
    return both.join(part, by, "left")


def monte_carlo_line(df: DataFrame, by: list[str], key: str, x: str, y: str, u_x: str, u_y: str, draws: int = 200, seed: int = 42) -> DataFrame:
    """m_mean, m_sd, b_mean, b_sd of lines through points that vary by their uncertainties, weighted as the line through all (one round).

    Draws are functions of seed, draw and key. Points are dealt evenly first, as tasks of their file are few for so much work;
    each task sums its points' products by draw before these are shuffled.
    """
    good = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.col(u_y) > 0)).select(*by, F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(u_x).alias("ux"), F.col(u_y).alias("uy"))
    slope = good.groupBy(*by).agg(F.regr_slope("y", "x").alias("m"))
    good = good.join(slope, by).withColumn("w", 1 / (F.col("uy") ** 2 + (F.coalesce("m", F.lit(0.0)) * F.col("ux")) ** 2))
    good = good.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "k")
    drawn = good.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    drawn = drawn.withColumn("xs", F.col("x") + F.col("ux") * normal_draw(F.concat(F.lit("x"), F.col("k").cast("string")), F.col("d"), seed)).withColumn("ys", F.col("y") + F.col("uy") * normal_draw(F.concat(F.lit("y"), F.col("k").cast("string")), F.col("d"), seed))
    c = F.col
    s = drawn.groupBy(*by, "d").agg(F.sum("w").alias("w"), F.sum(c("w") * c("xs")).alias("wx"), F.sum(c("w") * c("ys")).alias("wy"), F.sum(c("w") * c("xs") ** 2).alias("wxx"), F.sum(c("w") * c("xs") * c("ys")).alias("wxy"))
    det = c("w") * c("wxx") - c("wx") ** 2
    s = s.withColumn("det", F.when(det > 0, det)).withColumn("m", (c("w") * c("wxy") - c("wx") * c("wy")) / c("det")).withColumn("b", (c("wxx") * c("wy") - c("wx") * c("wxy")) / c("det"))
    return s.groupBy(*by).agg(F.avg("m").alias("m_mean"), F.stddev_samp("m").alias("m_sd"), F.avg("b").alias("b_mean"), F.stddev_samp("b").alias("b_sd"))


def fit_line_gls(df: DataFrame, by: list[str], x: str, y: str, own_x: str, own_y: str, factors_x: list[str], factors_y: list[str], iterations: int = 5, with_cov: bool = False) -> DataFrame:
    """n, m, u_m, b, u_b, chi2_red, birge (and cov_mb): a straight line by group with the full covariance of cov_y + m² cov_x.

    Covariances are diagonals and factors (see covariance): their inverse needs the sums of products of a group's columns
    alone (Woodbury), one aggregate a round; small matrices are solved where those sums meet. Groups with fewer than three points
    or one x have no line. ``own_x`` and ``own_y`` are variances.
    """
    columns = ["one", "x", "y", *[f"fx{i}" for i in range(len(factors_x))], *[f"fy{i}" for i in range(len(factors_y))]]
    good = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(*by, F.lit(1.0).alias("one"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(own_x).alias("vx"), F.col(own_y).alias("vy"), *[F.col(c).alias(f"fx{i}") for i, c in enumerate(factors_x)], *[F.col(c).alias(f"fy{i}") for i, c in enumerate(factors_y)])
    line = good.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("m"), F.regr_sxx("y", "x").alias("sxx")).filter("n > 2 and sxx > 0").select(*by, "n", "m")
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def solved(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                g = np.zeros((len(columns), len(columns)))
                for (i, j), v in zip(pairs, r[len(by) + 2 :], strict=True):
                    g[i, j] = g[j, i] = v
                n, m = r[len(by)], r[len(by) + 1]
                f = np.arange(3, len(columns))
                scale = np.array([m] * len(factors_x) + [1.0] * len(factors_y))
                # W = D - D F (1 + F' D F)^-1 F' D, between the columns one, x, y.
                left = g[:3, f] * scale
                w = g[:3, :3] - left @ np.linalg.pinv(np.eye(len(f)) + g[np.ix_(f, f)] * np.outer(scale, scale)) @ left.T if len(f) else g[:3, :3]
                a = w[np.ix_([1, 0], [1, 0])]
                cov = np.linalg.pinv(a)
                mb = cov @ w[[1, 0], 2]
                chi2 = max(w[2, 2] - 2 * mb @ w[[1, 0], 2] + mb @ a @ mb, 0.0) / max(n - 2, 1)
                birge = max(1.0, chi2**0.5)
                rows.append((*r[: len(by)], n, mb[0], max(cov[0, 0], 0) ** 0.5 * birge, mb[1], max(cov[1, 1], 0) ** 0.5 * birge, chi2, birge, cov[0, 1] * birge**2))
            yield pd.DataFrame(rows, columns=[*by, "n", "m", "u_m", "b", "u_b", "chi2_red", "birge", "cov_mb"])

    for _ in range(iterations):
        met = good.join(line.select(*by, "n", "m"), by).withColumn("d", 1 / (F.col("vy") + F.col("m") ** 2 * F.col("vx")))
        sums = met.groupBy(*by, "n", "m").agg(*[F.sum(F.col("d") * F.col(columns[i]) * F.col(columns[j])).alias(f"s{i}_{j}") for i, j in pairs])
        line = sums.mapInPandas(solved, kinds + ", n long, m double, u_m double, b double, u_b double, chi2_red double, birge double, cov_mb double")
    return line if with_cov or not iterations else line.drop("cov_mb")


def fit_gls(x: np.ndarray, y: np.ndarray, cov_x: np.ndarray, cov_y: np.ndarray, iterations: int = 5) -> dict[str, float]:
    """A straight line with full covariances: weights are the pseudo-inverse of cov_y + m² cov_x."""
    design = np.column_stack([x, np.ones_like(x)])
    m = np.polyfit(x, y, 1)[0]
    for _ in range(iterations):
        w = np.linalg.pinv(cov_y + m * m * cov_x)
        cov = np.linalg.pinv(design.T @ w @ design)
        m, b = cov @ design.T @ w @ y
    r = y - m * x - b
    chi2 = float(r @ w @ r) / max(len(x) - 2, 1)
    birge = max(1.0, chi2**0.5)
    return {"m": float(m), "b": float(b), "u_m": float(cov[0, 0] ** 0.5 * birge), "u_b": float(cov[1, 1] ** 0.5 * birge), "chi2_red": chi2, "birge": birge}


#: No draw is larger: its uniform number is 1/4294967297 at least, of which sqrt(-2 ln u) is 6.6604.
REACH = 6.7


def normal_draw(key: Column, draw: Column, seed: int = 42) -> Column:
    """A standard normal number that a row's key and the number of a draw determine (Box-Muller of a digest)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), key.cast("string")))
    uniform = lambda at: (F.conv(F.substring(h, at, 8), 16, 10).cast("double") + 1) / 4294967297.0
    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * F.pi() * uniform(9))


def monte_carlo_crossing(df: DataFrame, by: list[str], key: str, x: str, y: str, u: str, level: float, draws: int = 2000, seed: int = 42) -> DataFrame:
    """share, mean, sd of the first crossing in x order (then by ``key``, unique in a group) when every y varies by its u; null without one.

    Draws are functions of seed, draw and key, so neighbours are joined once and each makes the draws of both ends: only
    crossings are shuffled, whatever the number of draws. Links that no draw brings to the level make none.
    """
    good = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(y)).select(*by, F.col(key).alias("k0"), F.col(x).cast("double").alias("x0"), F.col(y).alias("y0"), F.coalesce(u, F.lit(0.0)).alias("u0"))
    w = Window.partitionBy(*by).orderBy("x0", "k0")
    links = good.select("*", *[F.lead(f"{c}0").over(w).alias(f"{c}1") for c in "kxyu"]).filter("x1 is not null")
    beyond = [F.col(f"y{i}") + sign * REACH * F.abs(F.col(f"u{i}")) for sign in (-1, 1) for i in (0, 1)]
    links = links.filter(~((beyond[0] > level) & (beyond[1] > level)) & ~((beyond[2] < level) & (beyond[3] < level)))

    def crossed(d: Column) -> Column:
        a, b = (F.col(f"y{i}") + F.col(f"u{i}") * normal_draw(F.col(f"k{i}"), d, seed) for i in (0, 1))
        at = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda z: F.when(((z["a"] - level) * (z["b"] - level) <= 0) & (z["a"] != z["b"]), F.struct(d.alias("draw"), (F.col("x0") + (level - z["a"]) * (F.col("x1") - F.col("x0")) / (z["b"] - z["a"])).alias("at"))))
        return F.get(at, F.lit(0))

    hits = links.select(*by, "x0", "k0", F.explode(F.array_compact(F.transform(F.sequence(F.lit(1), F.lit(draws)), crossed))).alias("h"))
    first = hits.groupBy(*by, "h.draw").agg(F.min_by("h.at", F.struct("x0", "k0")).alias("at"))
    found = first.groupBy(*by).agg((F.count("at") / draws).alias("share"), F.avg("at").alias("mean"), F.stddev_samp("at").alias("sd"))
    return df.select(*by).distinct().join(found, by, "left").select(*by, F.coalesce("share", F.lit(0.0)).alias("share"), "mean", "sd")
