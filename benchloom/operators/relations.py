"""Relations between the steps of a table, applied one after the other; each may use what those before it added."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.functions import formula, ieee
from benchloom.operators import held, steps

_FUNCTIONS = {**formula.FUNCTIONS, "changed": 1}


@dataclass(frozen=True)
class Nearest:
    """The value of the nearest reference steps (``where``) before and after, with equal ``match`` columns."""

    name: str
    value: str
    where: str
    match: tuple[str, ...] = ()
    linear: bool = False
    u_min: float = 0.3
    u_one: float = 1.0
    fallback: str | None = None


@dataclass(frozen=True)
class Cumulative:
    """A running sum of a formula, from anew after pauses of ``gap_s`` and where ``reset`` holds."""

    name: str
    expr: str
    gap_s: float | None = 300.0
    reset: str | None = None


@dataclass(frozen=True)
class Bin:
    name: str
    expr: str
    width: float


@dataclass(frozen=True)
class Layout:
    """Names of a step table's columns: what orders it inside ``by``."""

    by: tuple[str, ...]
    row: str
    start: str
    end: str
    extra: dict = field(default_factory=dict)


def _formula(df: DataFrame, text: str, at: Layout) -> tuple[DataFrame, Column]:
    """The table with a column for each ``changed(column)`` of a formula, and the formula over it."""
    known = set(df.columns)
    node = formula.parse(text, known, _FUNCTIONS)

    def walk(n):
        nonlocal df
        if not isinstance(n, formula.Op):
            return n
        if n.name != "changed":
            return formula.Op(n.name, tuple(walk(a) for a in n.args))
        if not isinstance(n.args[0], formula.Var):
            raise formula.FormulaError(text, 0, "changed takes the name of a column")
        name, column = f"__changed_{n.args[0].name}", n.args[0].name
        if name not in df.columns:
            df = held.changed(df, list(at.by), at.start, column).withColumnRenamed("changed", name)
        return formula.Var(name)

    node = walk(node)
    texts = {f.name for f in df.schema if f.dataType.typeName() == "string"}
    return df, formula.to_column(node, {c: F.col(f"`{c}`") for c in df.columns}, texts)


def apply(df: DataFrame, relations: list[Nearest | Cumulative | Bin], at: Layout) -> DataFrame:
    """The step table with the columns of all relations, in order.

    Nearest adds name, u_name, name_kind, name_before, name_after (``fallback``, a formula, where there is no reference, kind
    fallback); Cumulative adds name and name_run; Bin adds name.
    """
    for r in relations:
        own = df.columns
        if isinstance(r, Bin):
            df, value = _formula(df, r.expr, at)
            df = df.withColumn(r.name, steps.bin_value(value, r.width)).select(*own, r.name)
        elif isinstance(r, Cumulative):
            df, value = _formula(df, r.expr, at)
            df = df.withColumn("__value", value)
            reset = None
            if r.reset:
                df, test = _formula(df, r.reset, at)
                df = df.withColumn("__reset", ieee.holds(test))
                reset = F.col("__reset")
            df = steps.cumulative(df, list(at.by), at.start, at.end, F.col("__value"), r.gap_s, reset)
            df = df.withColumnRenamed("total", r.name).withColumnRenamed("run_no", f"{r.name}_run").select(*own, r.name, f"{r.name}_run")
        else:
            df, value = _formula(df, r.value, at)
            df, test = _formula(df.withColumn("__value", value), r.where, at)
            df = df.withColumn("__ref", ieee.holds(test))
            df = steps.nearest_reference(df, list(r.match), at.row, at.start, at.end, "__value", F.col("__ref"), r.u_min, r.u_one, r.linear)
            ref, u, kind = F.col("ref"), F.col("u_ref"), F.col("ref_kind")
            if r.fallback:
                df, other = _formula(df, r.fallback, at)
                none = F.col("ref_kind") == "none"
                ref, u, kind = F.when(none, other).otherwise(ref), F.when(none, F.lit(0.0)).otherwise(u), F.when(none, "fallback").otherwise(kind)
            df = df.select(*own, ref.alias(r.name), u.alias(f"u_{r.name}"), kind.alias(f"{r.name}_kind"), F.col("ref_before").alias(f"{r.name}_before"), F.col("ref_after").alias(f"{r.name}_after"))
    return df
