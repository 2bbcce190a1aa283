"""Flags put together, rows picked and ordered, ranges and groups of channels: small parts of many views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchloom.functions import formula, ieee, times
from benchloom.operators import quantiles
from benchloom.operators.recording import Recording

#: Padding of the range of a channel that is constantly zero.
CONSTANT_PAD = 1.0


def assemble_flags(parts: list[DataFrame]) -> DataFrame:
    """Flags of a parent, of own channels and others as one table, each event once."""
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def ordered_flags(flags: DataFrame, source: list[str]) -> DataFrame:
    """Events by source and row; those of a whole row (without channel) come first."""
    return flags.orderBy(*source, "row", F.asc_nulls_first("channel"), "flag")


def flag_mask(rec: Recording, flags: DataFrame, names: list[str], channel: str, out: str = "flagged") -> DataFrame:
    """Adds ``out``: whether a row has one of the flags ``names`` on a channel or as a whole."""
    hit = flags.filter(F.col("flag").isin(names) & (F.col("channel").isNull() | (F.col("channel") == channel)))
    hit = hit.select(*rec.source, F.col("row").alias(rec.row)).distinct().withColumn(out, F.lit(True))
    return rec.df.join(hit, [*rec.source, rec.row], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def rows_in(df: DataFrame, rows: DataFrame, key: list[str], absent: bool = False) -> DataFrame:
    """The rows whose key is among others (or is not)."""
    return df.join(rows.select(*key), key, "left_anti" if absent else "left_semi")


def trim_footer(df: DataFrame, audit: DataFrame, source: list[str], row: str, channels: list[str]) -> DataFrame:
    """Without the rows at a source's end that have no value; a row with an audit entry is none of them."""
    noted = audit.select(*source, row).distinct().withColumn("__noted", F.lit(True))
    df = df.join(noted, [*source, row], "left")
    full = F.col("__noted").isNotNull() | reduce(lambda a, b: a | b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in channels])
    last = df.groupBy(*source).agg(F.max(F.when(full, F.col(row))).alias("__last"))
    return df.join(last, source).filter(F.col(row) <= F.col("__last")).drop("__last", "__noted")


def first_rows(df: DataFrame, by: list[str], row: str, n: int, skip: int = 0) -> DataFrame:
    """Rows ``skip`` to ``skip + n`` of each group in its order."""
    w = Window.partitionBy(*by).orderBy(row)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n").between(skip + 1, skip + n)).drop("__n")


def last_rows(df: DataFrame, by: list[str], row: str, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(row))
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def largest(df: DataFrame, by: list[str], value: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows of largest value of each group (then smallest key), with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(value), key)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def robust_range(df: DataFrame, by: list[str], value: str, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """low, high: percentiles of finite values; a constant channel gets a band of 5 % (1 about zero)."""
    finite = df.filter(F.col(value).isNotNull() & ieee.is_finite(F.col(value).cast("double")))
    p = quantiles.percentiles(finite, by, value, {"low": low / 100, "high": high / 100})
    pad = F.when(F.col("high") <= F.col("low"), F.when(F.col("low") == 0, CONSTANT_PAD).otherwise(F.abs("low") * 0.05)).otherwise(0.0)
    return p.withColumn("__p", pad).select(*by, (F.col("low") - F.col("__p")).alias("low"), (F.when(F.col("high") <= F.col("low"), F.col("low")).otherwise(F.col("high")) + F.col("__p")).alias("high"))


def constant_within(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """column, constant: whether a column has one value at most in every group."""
    each = df.groupBy(*group).agg(*[F.count_distinct(c).alias(c) for c in columns])
    one = each.agg(*[(F.coalesce(F.max(c), F.lit(0)) <= 1).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "constant")


def joined_texts(df: DataFrame, by: list[str], text: str, out: str) -> DataFrame:
    """The distinct texts of a group in order, with commas."""
    return df.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_set(text)), ", ").alias(out))


def connected(rec: Recording, channel: str) -> DataFrame:
    """Adds ``connects``: whether a line goes on to the next row, which takes finite values on both sides and no gap between."""
    value = F.col(channel).cast("double")
    ok = value.isNotNull() & ieee.is_finite(value)
    after = F.lead(ok).over(rec.in_source())
    gap = F.lead("is_gap").over(rec.in_source()) if "is_gap" in rec.df.columns else F.lit(False)
    return rec.df.withColumn("connects", F.coalesce(ok & after & ~gap, F.lit(False)))


def to_long(df: DataFrame, ids: list[str], channels: list[str]) -> DataFrame:
    """ids, channel, value: time, metadata and parameters as ids, channels as rows."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in channels]).unpivot(ids, channels, "channel", "value")


def column_order(names: list[str]) -> list[str]:
    """By number if all names are numbers, else by text."""
    try:
        return sorted(names, key=float)
    except ValueError:
        return sorted(names)


def track_groups(channels: list[tuple[str, str, str]], by: str) -> dict[str, list[str]]:
    """Tracks of a plot: channels (name, unit, source) by ``channel``, ``unit`` or ``source``, in order of appearance."""
    at = {"channel": 0, "unit": 1, "source": 2}[by]
    out: dict[str, list[str]] = {}
    for c in channels:
        out.setdefault(c[at], []).append(c[0])
    return out


def with_absolute_time(df: DataFrame, seconds: str, origin_us: Column, zone: str = "UTC", out: str = "time_abs") -> DataFrame:
    """Adds the wall-clock time of seconds since an origin right after their column."""
    absolute = times.master_wall((origin_us + F.round(F.col(seconds) * 1e6)) / 1e6, zone).alias(out)
    return df.select(*[x for c in df.columns for x in ([F.col(c), absolute] if c == seconds else [F.col(c)])])


def secondary_axis(df: DataFrame, x: str, text: str, out: str = "x2") -> DataFrame:
    """Adds a second scale of an axis, a formula over ``x``."""
    node = formula.parse(text, {"x"})
    return df.withColumn(out, formula.to_column(node, {"x": F.col(x)}))


def parameter_audit(df: DataFrame, runs: list[str], detect: list[str], forced: list[str], min_samples: int = 2) -> tuple[DataFrame, DataFrame]:
    """column, parameter of the columns to be judged (one value in every run, and enough of them in one); and the forced ones that vary."""
    each = df.groupBy(*runs).agg(*[F.count_distinct(c).alias(f"d_{c}") for c in [*detect, *forced]], *[F.count(c).alias(f"n_{c}") for c in [*detect, *forced]])
    one = each.agg(*[F.struct(F.max(f"d_{c}").alias("d"), F.max(f"n_{c}").alias("n")).alias(c) for c in [*detect, *forced]])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["d"].alias("d"), F.col(c)["n"].alias("n")) for c in [*detect, *forced]])).alias("r")).select("r.*")
    found = rows.filter(F.col("column").isin(detect)).select("column", ((F.col("d") <= 1) & (F.col("n") >= min_samples)).alias("parameter"))
    bad = rows.filter(F.col("column").isin(forced) & (F.col("d") > 1)).select("column", F.lit("non_constant_parameter").alias("reason"))
    return found, bad


def gap_at(segments: DataFrame, source: list[str], at: DataFrame, time: str) -> DataFrame:
    """Adds ``covered``: whether a segment (start_us, end_us) of the source holds a time. One sort, no pairs."""
    from benchloom.operators.align import as_of

    right = segments.select(*source, F.col("start_us").alias(time), "end_us")
    found = as_of(at, right, source, time, ["end_us"])
    return found.select(*at.columns, F.coalesce(F.col(time) <= F.col("end_us"), F.lit(False)).alias("covered"))


def covered_seconds(segments: DataFrame, source: list[str]) -> DataFrame:
    return segments.groupBy(*source).agg((F.sum(F.col("end_us") - F.col("start_us")) / 1e6).alias("covered_s"))


def span(rec: Recording, master: Column) -> DataFrame:
    """start, end of a source on master time."""
    return rec.df.groupBy(*rec.source).agg(F.min(master).alias("start"), F.max(master).alias("end"))
