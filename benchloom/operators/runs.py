"""Summaries of runs and of channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benchloom.operators.recording import Recording


def run_summary(rec: Recording, parameters: list[str] | None = None, aborted_fraction: float = 0.1) -> DataFrame:
    """One row per run: counts, times in seconds, median step, first value of each parameter, whether it was cut short."""
    dt = (F.col(rec.time) - F.lag(rec.time).over(rec.in_run())) / 1e6
    firsts = [F.min_by(p, F.when(F.col(p).isNotNull(), F.col(rec.row))).alias(p) for p in parameters or []]
    runs = rec.df.withColumn("__dt", dt).groupBy(*rec.keys).agg(
        F.count("*").alias("n_samples"), (F.min(rec.time) / 1e6).alias("t_start"), (F.max(rec.time) / 1e6).alias("t_end"), ((F.max(rec.time) - F.min(rec.time)) / 1e6).alias("duration_s"), F.median("__dt").alias("median_dt_s"), *firsts)
    # One row: the median run length, from counts per run only.
    typical = runs.agg(F.median("n_samples").alias("__typical"))
    return runs.join(F.broadcast(typical)).withColumn("aborted", F.col("n_samples") < aborted_fraction * F.col("__typical")).drop("__typical")


def availability(rec: Recording) -> DataFrame:
    """Share of rows with a value, by run and channel."""
    wide = rec.df.groupBy(*rec.keys).agg(*[(F.count(c) / F.count("*")).alias(c) for c in rec.channels])
    return wide.unpivot(list(rec.keys), list(rec.channels), "channel", "fill_ratio")


def fill_ratio(df: DataFrame) -> DataFrame:
    """Share of non-null values of each column of a table."""
    one = df.agg(*[(F.count(F.col(f"`{c}`")) / F.count("*")).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "fill_ratio")


def run_time(rec: Recording) -> DataFrame:
    """Adds ``run_time_s``: seconds since the run's first time."""
    return rec.df.withColumn("run_time_s", (F.col(rec.time) - F.min(rec.time).over(Window.partitionBy(*rec.keys))) / 1e6)


def select_run(rec: Recording, **key: object) -> Recording:
    """The rows of one run (null-safe); a run that is not there raises."""
    df = rec.df
    for name, value in key.items():
        df = df.filter(F.col(name).eqNullSafe(F.lit(value)))
    if df.isEmpty():
        raise KeyError(f"no run {key}")
    return rec.with_df(df)


def constant_parameters(rec: Recording, columns: list[str], min_samples: int = 2) -> DataFrame:
    """For each column whether every run of at least ``min_samples`` values has one distinct value of it (exact)."""
    per_run = rec.df.groupBy(*rec.keys).agg(*[F.count_distinct(c).alias(f"d_{c}") for c in columns], *[F.count(c).alias(f"n_{c}") for c in columns])
    one = per_run.agg(*[F.coalesce(F.min((F.col(f"d_{c}") <= 1) | (F.col(f"n_{c}") < min_samples)), F.lit(True)).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "constant")
