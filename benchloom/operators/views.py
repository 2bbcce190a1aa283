"""The tables behind views: tables, matrices, aligned curves, timelines, and text templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchloom.functions import formula, ieee


def table(df: DataFrame, columns: list[str], where: str | None = None, sort: list[tuple[str, bool]] = ()) -> DataFrame:
    """Filter by a formula, sort by (column, ascending), select."""
    if where:
        df = df.filter(ieee.holds(formula.compile_formula(where, df)))
    if sort:
        df = df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in sort])
    return df.select(*columns)


def xy(df: DataFrame, x: str, y: str, u_y: str | None = None, colour: str | None = None, facet: str | None = None, where: str | None = None) -> DataFrame:
    """x, y, u_y by formulas, finite pairs only, with grouping keys."""
    if where:
        df = df.filter(ieee.holds(formula.compile_formula(where, df)))
    parts = {"x": formula.compile_formula(x, df), "y": formula.compile_formula(y, df)}
    if u_y:
        parts["u_y"] = formula.compile_formula(u_y, df)
    keys = [F.col(c).alias(name) for name, c in (("colour", colour), ("facet", facet)) if c]
    return df.select(*[c.alias(n) for n, c in parts.items()], *keys).filter(ieee.is_finite(F.col("x")) & ieee.is_finite(F.col("y")))


def matrix(df: DataFrame, rows: str, columns: str, value: str, status: Column) -> DataFrame:
    """Per cell: mean and number of the values whose status holds, else the range of all, marked."""
    ok = F.avg(F.when(status, F.col(value)))
    return df.groupBy(rows, columns).agg(ok.alias("mean"), F.count(F.when(status, F.col(value))).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).withColumn("marked", F.col("n") == 0)


def aligned(samples: DataFrame, origin: DataFrame, by: list[str], time: str, start: str) -> DataFrame:
    """Samples with minutes since their sequence's first start."""
    first = origin.groupBy(*by).agg(F.min(start).alias("__t0"))
    return samples.join(first, by).withColumn("minutes", (F.col(time) - F.col("__t0")) / 60).drop("__t0")


def best_source(counts: DataFrame, step: list[str], source: str, n: str) -> DataFrame:
    """Per step the source with most samples (then by name)."""
    w = Window.partitionBy(*step).orderBy(F.desc(n), source)
    return counts.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def timeline(steps: DataFrame, start: str, end: str, low: float, high: float) -> DataFrame:
    """Steps on a page, cut to it."""
    return steps.filter((F.col(end) > low) & (F.col(start) < high)).withColumn("from", F.greatest(F.col(start), F.lit(low))).withColumn("to", F.least(F.col(end), F.lit(high)))


_REDUCE = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "n": F.count}


def fill_template(df: DataFrame, template: str, by: list[str]) -> DataFrame:
    """by, text: ``{formula|reduction:format}`` replaced by values; ``{{`` and ``}}`` are braces; digits as in ``.2f``."""
    parts, aggregates = [], []
    for piece in re.split(r"(\{\{|\}\}|\{[^{}]*\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif piece.startswith("{"):
            m = re.fullmatch(r"\{(.*?)(?:\|(\w+))?(?::\.(\d+)f)?\}", piece)
            name = f"__v{len(aggregates)}"
            if dict(df.dtypes).get(m[1].strip()) == "string":
                # Texts of a group are joined, each once.
                aggregates.append(F.array_join(F.sort_array(F.collect_set(m[1].strip())), ", ").alias(name))
                parts.append(F.when(F.col(name) == "", "–").otherwise(F.col(name)))
                continue
            values = formula.compile_formula(m[1], df)
            finite = F.when(ieee.is_finite(values), values)
            aggregates.append(_REDUCE[m[2] or "mean"](finite).cast("double").alias(name))
            digits = int(m[3]) if m[3] else 6
            parts.append(F.coalesce(F.format_string(f"%.{digits}f", ieee.round_even(F.col(name), digits)), F.lit("–")))
        elif piece:
            parts.append(F.lit(piece))
    return df.groupBy(*by).agg(*aggregates).select(*by, F.concat(*parts).alias("text"))


def report_tiles(tables: dict[str, DataFrame], tiles: list[tuple[str, str, str, str | None]]) -> DataFrame:
    """place, label, text of each tile (label, table, template, filter formula); a table that is not there raises with the tile's label."""
    out = None
    for place, (label, name, template, where) in enumerate(tiles):
        if name not in tables:
            raise ValueError(f"tile {label!r}: no table {name!r}; there are {', '.join(sorted(tables))}")
        df = tables[name]
        try:
            df = df.filter(ieee.holds(formula.compile_formula(where, df))) if where else df
            one = fill_template(df, template, [])
        except formula.FormulaError as e:
            raise ValueError(f"tile {label!r}: {e}") from None
        one = one.select(F.lit(place).alias("place"), F.lit(label).alias("label"), "text")
        out = one if out is None else out.unionByName(one)
    return out


def bars(df: DataFrame, quantity: str, key: list[str], where: str | None = None, labels: dict[str, str] | None = None) -> DataFrame:
    """key, u, part, share of a budget's bars: the whole uncertainty of a quantity, and the part of its square by input (with labels)."""
    if where:
        df = df.filter(ieee.holds(formula.compile_formula(where, df)))
    prefix = f"b_{quantity}__"
    parts = [c for c in df.columns if c.startswith(prefix)]
    total = sum((F.col(c) ** 2 for c in parts), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit((labels or {}).get(c[len(prefix) :], c[len(prefix) :])).alias("part"), F.when(F.col("__t") > 0, F.col(c) ** 2 / F.when(F.col("__t") > 0, F.col("__t"))).alias("share")) for c in parts])
    return df.withColumn("__t", total).select(*key, F.col(f"u_{quantity}").alias("u"), F.explode(rows).alias("p")).select(*key, "u", "p.*")
