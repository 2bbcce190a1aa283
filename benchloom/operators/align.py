"""Putting recordings on one time: clocks, as-of lookups, coverage, grids, correlation, level of detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchloom.functions import formula, ieee
from benchloom.operators.recording import SO_FAR, Recording


def piecewise(df: DataFrame, time_us: str, default: str, pieces: list[tuple[float, float, str]]) -> Column:
    """A formula that others replace in half-open spans of seconds."""
    out = None
    for start, end, text in pieces:
        hit = (F.col(time_us) >= int(start * 1e6)) & (F.col(time_us) < int(end * 1e6))
        value = formula.compile_formula(text, df)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    base = formula.compile_formula(default, df)
    return base if out is None else out.otherwise(base)


def clock(seconds: Column, offset: float = 0.0, drift_ppm: float = 0.0, reference: Column | float = 0.0) -> Column:
    """Master seconds: an offset, and a drift counted from a reference."""
    return seconds + offset + (seconds - reference) * (drift_ppm / 1e6)


def clock_anchors(seconds: Column, anchors: list[tuple[float, float]]) -> Column:
    """Master seconds by pairs (own, master): one is an offset, several are joined by lines that go on beyond the ends."""
    pairs = sorted(anchors)
    if len(pairs) == 1:
        return seconds + (pairs[0][1] - pairs[0][0])
    out = None
    for (a, b), (c, e) in zip(pairs[:-1], pairs[1:], strict=True):
        line = b + (seconds - a) * ((e - b) / (c - a))
        last = (c, e) == pairs[-1]
        out = line if out is None and last else F.when(seconds < c, line) if out is None else out.otherwise(line) if last else out.when(seconds < c, line)
    return out


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], tie: str | None = None) -> DataFrame:
    """``left`` with the values of the last row of ``right`` at or before its time: one sort of both, no pairs."""
    rows = right.select(*by, F.col(time), F.lit(0).alias("__side"), F.struct(F.col(time).alias("__at"), *values).alias("__r"), *([F.col(tie).alias("__tie")] if tie else [F.lit(0).alias("__tie")]))
    both = left.withColumn("__side", F.lit(1)).withColumn("__tie", F.lit(None)).unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(time, "__side", "__tie").rowsBetween(*SO_FAR)
    found = both.withColumn("__f", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1")
    return found.select(*left.columns, F.col("__f.__at").alias("matched_time"), *[F.col(f"__f.{v}").alias(v) for v in values])


def broadcast_steps(samples: DataFrame, steps: DataFrame, by: list[str], time: str, start: str, end: str, values: list[str]) -> DataFrame:
    """Samples with the values of the step they lie in (both ends inside), null outside."""
    found = as_of(samples, steps.withColumn(time, F.col(start)), by, time, [end, *values])
    inside = F.col(time) <= F.col(end)
    return found.select(*samples.columns, *[F.when(inside, F.col(v)).alias(v) for v in values])


def minimal_trace(steps: DataFrame, by: list[str], start: str, end: str, value: str) -> DataFrame:
    """time, value: each step's ends, and a null after its end where the next one does not follow at once."""
    after = F.lead(start).over(Window.partitionBy(*by).orderBy(start))
    open_ = after.isNull() | (after > F.col(end))
    points = F.array(F.struct(F.col(start).alias("time"), F.col(value).alias("value"), F.lit(0).alias("part")), F.struct(F.col(end).alias("time"), F.col(value).alias("value"), F.lit(1).alias("part")), F.when(F.col("__open"), F.struct(F.col(end).alias("time"), F.lit(None).cast("double").alias("value"), F.lit(2).alias("part"))))
    return steps.withColumn("__open", open_).select(*by, F.explode(F.array_compact(points)).alias("p")).select(*by, "p.*")


def coverage(rec: Recording, channel: str, factor: float = 5.0) -> DataFrame:
    """Segments of a channel: rows with values whose steps stay under ``factor`` × their median step; by source."""
    valued = rec.df.filter(F.col(channel).isNotNull())
    w = rec.in_source()
    df = valued.withColumn("__dt", F.col(rec.time) - F.lag(rec.time).over(w))
    df = df.withColumn("__m", F.median("__dt").over(Window.partitionBy(*rec.source)))
    df = df.withColumn("segment", F.sum(F.coalesce(F.col("__dt") > factor * F.col("__m"), F.lit(False)).cast("long")).over(w.rowsBetween(*SO_FAR)))
    return df.groupBy(*rec.source, "segment").agg(F.min(rec.time).alias("start_us"), F.max(rec.time).alias("end_us"), F.count("*").alias("n"))


def coverage_gaps(segments: DataFrame, source: list[str]) -> DataFrame:
    """start, end of what lies between segments."""
    after = F.lead("start_us").over(Window.partitionBy(*source).orderBy("segment"))
    return segments.withColumn("gap_end_us", after).filter("gap_end_us is not null").select(*source, F.col("end_us").alias("gap_start_us"), "gap_end_us")


def resample(rec: Recording, channel: str, step_us: int, max_gap_us: int) -> DataFrame:
    """source, grid_us, value: linear on a grid of multiples of ``step_us``; null across steps longer than ``max_gap_us``.

    Every link between neighbouring values makes the grid points that it covers; nothing is joined.
    """
    w = rec.in_source()
    df = rec.df.filter(F.col(channel).isNotNull()).select(*rec.source, rec.row, F.col(rec.time).alias("t0"), F.col(channel).alias("y0"))
    df = df.withColumn("t1", F.lead("t0").over(w)).withColumn("y1", F.lead("y0").over(w)).filter("t1 > t0")
    first, last = F.ceil(F.col("t0") / step_us), F.ceil(F.col("t1") / step_us) - 1
    grid = df.filter(last >= first).withColumn("g", F.explode(F.sequence(first, last))).withColumn("grid_us", F.col("g") * step_us)
    value = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("grid_us") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return grid.select(*rec.source, "grid_us", F.when(F.col("t1") - F.col("t0") <= max_gap_us, value).alias("value"))


def lag_correlation(a: DataFrame, b: DataFrame, by: list[str], k: str, value: str, lags: list[int], min_overlap: int = 3) -> DataFrame:
    """lag, r, overlap by ``by``: Pearson's r of values on a grid with index ``k`` against shifted ones; rows × lags, no pairs."""
    shifted = b.select(*by, F.col(k).alias("kb"), F.col(value).alias("vb")).withColumn("lag", F.explode(F.array(*[F.lit(x) for x in lags]))).withColumn(k, F.col("kb") - F.col("lag"))
    # Made grid points do not show in a plan's estimate of size, which is that of the samples: without the hint they would be broadcast.
    both = a.select(*by, k, F.col(value).alias("va")).join(shifted.hint("merge"), [*by, k]).filter("va is not null and vb is not null")
    # corr fails for constants: sums of centred products instead, null where a side is constant.
    n, sx, sy, sxx, syy, sxy = (F.count("*"), F.sum("va"), F.sum("vb"), F.sum(F.col("va") ** 2), F.sum(F.col("vb") ** 2), F.sum(F.col("va") * F.col("vb")))
    out = both.groupBy(*by, "lag").agg(n.alias("overlap"), sx.alias("sx"), sy.alias("sy"), sxx.alias("sxx"), syy.alias("syy"), sxy.alias("sxy"))
    c = F.col
    vx, vy = c("sxx") - c("sx") ** 2 / c("overlap"), c("syy") - c("sy") ** 2 / c("overlap")
    r = F.when((vx > 1e-9) & (vy > 1e-9), (c("sxy") - c("sx") * c("sy") / c("overlap")) / F.sqrt(F.when((vx > 1e-9) & (vy > 1e-9), vx * vy)))
    return out.filter(c("overlap") >= min_overlap).select(*by, "lag", "overlap", r.alias("r"))


def median_offset(pairs: DataFrame, by: list[str], own: str, master: str, resolution_s: float = 1.0) -> DataFrame:
    """offset (median difference), mad, u (the larger of mad and half a resolution), n."""
    d = pairs.withColumn("__d", F.col(master) - F.col(own))
    d = d.withColumn("__m", F.median("__d").over(Window.partitionBy(*by)))
    out = d.groupBy(*by).agg(F.first("__m").alias("offset"), F.median(F.abs(F.col("__d") - F.col("__m"))).alias("mad"), F.count("__d").alias("n"))
    return out.withColumn("u", F.greatest("mad", F.lit(resolution_s / 2)))


def min_max_columns(rec: Recording, channel: str, start_us: int, width_us: int) -> DataFrame:
    """Level of detail: smallest and largest value of each column of ``width_us``, and whether it has a break."""
    broken = F.col(channel).isNull() | ~ieee.is_finite(F.col(channel).cast("double"))
    finite = F.when(~broken, F.col(channel))
    df = rec.df.filter(F.col(rec.time) >= start_us).withColumn("pixel", F.floor((F.col(rec.time) - start_us) / width_us))
    return df.groupBy(*rec.source, "pixel").agg(F.min(finite).alias("low"), F.max(finite).alias("high"), F.max(broken).alias("has_break"))


def clipped(rec: Recording, start_us: int, end_us: int) -> DataFrame:
    """The rows of a span and one on either side, so that lines go on to the edges of a plot."""
    low = F.max(F.when(F.col(rec.time) < start_us, F.col(rec.row)))
    high = F.min(F.when(F.col(rec.time) > end_us, F.col(rec.row)))
    near = rec.df.groupBy(*rec.source).agg(low.alias("__low"), high.alias("__high"))
    inside = F.col(rec.time).between(start_us, end_us) | (F.col(rec.row) == F.col("__low")) | (F.col(rec.row) == F.col("__high"))
    return rec.df.join(near, list(rec.source)).filter(inside).drop("__low", "__high")


def value_at(rec: Recording, at: DataFrame, channel: str, time: str = "at_us") -> DataFrame:
    """The last value of a channel at or before each asked time."""
    right = rec.df.filter(F.col(channel).isNotNull()).select(*rec.source, F.col(rec.time).alias(time), channel, rec.row)
    return as_of(at, right, list(rec.source), time, [channel], rec.row)


def moving_mean(rec: Recording, channel: str, width: int) -> Column:
    """Sum over ``width`` rows centred on a row, divided by ``width`` also where the ends have fewer."""
    before = width // 2
    return F.sum(channel).over(rec.in_source().rowsBetween(-before, width - 1 - before)) / width


def step_expanded(df: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """Sample and hold: each value also at the time of the next one."""
    w = Window.partitionBy(*by).orderBy(time)
    points = F.array_compact(F.array(F.struct(F.col(time).alias("x"), F.col(value).alias("y"), F.lit(0).alias("part")), F.when(F.col("__next").isNotNull(), F.struct(F.col("__next").alias("x"), F.col(value).alias("y"), F.lit(1).alias("part")))))
    return df.withColumn("__next", F.lead(time).over(w)).select(*by, F.explode(points).alias("p")).select(*by, "p.*")
