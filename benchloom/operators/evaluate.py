"""Evaluation of step tables: measures, calculations with uncertainty budgets, criteria, ratings, scenarios."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.functions import formula, ieee
from benchloom.functions.formula import Node, Num


@dataclass(frozen=True)
class Input:
    """A quantity with uncertainty: value, standard uncertainty, kind (random or systematic) and the group it shares."""

    value: Column
    u: Column | None
    kind: str = "random"
    group: str | None = None


@dataclass(frozen=True)
class Own:
    """A calculation's own uncertainty, a formula whose value counts; it is shared like that of an input of this kind and group."""

    formula: str
    kind: str = "random"
    group: str | None = None


def merged_inputs(*parts: Mapping[str, tuple[float, float, str, str | None]]) -> dict[str, Input]:
    """Constants (value, u, kind, group) of several places as inputs; one name with different ones raises, u of 0 is no uncertainty."""
    out: dict[str, tuple] = {}
    for part in parts:
        for name, given in part.items():
            full = (*given, *(0.0, "systematic", None)[len(given) - 1 :])
            if out.setdefault(name, full) != full:
                raise ValueError(f"input {name!r} is given as {out[name]} and as {full}")
    return {n: Input(F.lit(float(v)), F.lit(float(u)) if u > 0 else None, kind, group) for n, (v, u, kind, group) in out.items()}


@dataclass
class Budget:
    """A calculated quantity: its formula over inputs, and for each input the derivative by it."""

    node: Node
    gradients: dict[str, Node] = field(default_factory=dict)


def differentiate(text: str, known: Mapping[str, Budget], inputs: Mapping[str, Input]) -> Budget:
    """A formula over inputs and earlier quantities as one over inputs, with its gradients."""
    node = formula.parse(text, set(known) | set(inputs))
    full = formula.substitute(node, {name: b.node for name, b in known.items()})
    gradients = {}
    for name in formula.names(full):
        if name in inputs and inputs[name].u is not None and (g := formula.derivative(full, name)) != Num(0.0):
            gradients[name] = g
    return Budget(full, gradients)


def contributions(budget: Budget, inputs: Mapping[str, Input], env: Mapping[str, Column]) -> dict[str, Column]:
    """gradient × u of each input; exactly 0 where the gradient is 0, even if u is not a number."""
    out = {}
    for name, node in sorted(budget.gradients.items()):
        g = formula.to_column(node, env)
        out[name] = F.when(g == 0, 0.0).otherwise(g * inputs[name].u)
    return out


def _root(parts: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, parts)) if parts else F.lit(0.0)


def calculate(df: DataFrame, calculations: Mapping[str, str], inputs: Mapping[str, Input], own: Mapping[str, Own] | None = None) -> DataFrame:
    """Adds for each calculation: name, u_name, u_name_random, u_name_systematic and b_name__input (contributions).

    First-order propagation: random parts add in squares; systematic ones add up inside a group, in squares between.
    Derivatives are taken of the formulas, so all of it is a few projections. A calculation's ``own`` uncertainty is one more
    input (b_name__own_name), which later calculations inherit; a negative one raises when it is computed.
    """
    columns = df.columns
    own = own or {}
    inputs = {**inputs, **{f"own_{n}": Input(F.lit(0.0), F.lit(0.0), o.kind, o.group) for n, o in own.items()}}
    uncertain = {n: i for n, i in inputs.items() if i.u is not None}
    df = df.select("*", *[i.value.cast("double").alias(f"__x_{n}") for n, i in inputs.items()], *[i.u.cast("double").alias(f"__u_{n}") for n, i in uncertain.items()])
    env = {n: F.col(f"__x_{n}") for n in inputs}
    held = {n: Input(env[n], F.col(f"__u_{n}") if n in uncertain else None, i.kind, i.group) for n, i in inputs.items()}
    known: dict[str, Budget] = {}
    values: list[Column] = []
    results: list[Column] = []
    for name, text in calculations.items():
        budget = differentiate(text, known, inputs)
        if name in own:
            u = formula.to_column(formula.substitute(formula.parse(own[name].formula, set(known) | set(inputs)), {n: b.node for n, b in known.items()}), env)
            u = F.when(u < 0, F.raise_error(F.lit(f"calculation {name!r}: its own uncertainty {own[name].formula!r} is negative")).cast("double")).otherwise(u)
            held[f"own_{name}"] = Input(env[f"own_{name}"], u, own[name].kind, own[name].group)
            budget = Budget(formula.Op("+", (budget.node, formula.Var(f"own_{name}"))), {**budget.gradients, f"own_{name}": Num(1.0)})
        parts = contributions(budget, held, env)
        values += [formula.to_column(budget.node, env).alias(name), *[c.alias(f"b_{name}__{n}") for n, c in parts.items()]]
        column = {n: F.col(f"b_{name}__{n}") for n in parts}
        random = [c * c for n, c in column.items() if inputs[n].kind == "random"]
        groups: dict[str, list[Column]] = {}
        for n, c in column.items():
            if inputs[n].kind != "random":
                groups.setdefault(inputs[n].group or f"\0{n}", []).append(c)
        shared = [reduce(lambda a, b: a + b, g) for g in groups.values()]
        u_random, u_systematic = _root(random), _root([s * s for s in shared])
        results += [F.col(name), F.sqrt(u_random**2 + u_systematic**2).alias(f"u_{name}"), u_random.alias(f"u_{name}_random"), u_systematic.alias(f"u_{name}_systematic"), *column.values()]
        known[name] = budget
    # Values and contributions are columns before their squares are summed, so that no formula is written out twice.
    return df.select(*columns, *values).select(*columns, *results)


def criteria(df: DataFrame, tests: Mapping[str, str]) -> DataFrame:
    """Boolean columns, each usable by later ones; not-a-number fails."""
    for name, text in tests.items():
        df = df.withColumn(name, ieee.holds(formula.compile_formula(text, df)))
    return df


def rate(df: DataFrame, rules: list[tuple[str, str, list[str]]], texts: Mapping[str, str]) -> DataFrame:
    """Adds rating (the first rule (name, all|any|none, criteria) that holds; one without criteria always does) and reason."""
    out = None
    for name, how, names in rules:
        if not names:
            hit = F.lit(True)
        else:
            join = (lambda a, b: a & b) if how == "all" else (lambda a, b: a | b)
            hit = reduce(join, [F.col(n) for n in names])
            hit = ~hit if how == "none" else hit
        out = F.when(hit, name) if out is None else out.when(hit, name)
    violated = F.array_join(F.array_compact(F.array(*[F.when(~F.col(n), text) for n, text in texts.items()])), "; ")
    return df.withColumn("rating", out).withColumn("reason", violated)


def first_source(long: DataFrame, step: list[str], source: str, value: str, order: list[str], min_n: str | None = None, least: int = 1) -> DataFrame:
    """Per step the value of the first listed source that has one (from ``least`` points of ``min_n`` on)."""
    rank = reduce(lambda acc, x: acc.when(F.col(source) == x[1], x[0]), list(enumerate(order))[1:], F.when(F.col(source) == order[0], 0))
    ok = rank.isNotNull() & F.col(value).isNotNull() & ((F.col(min_n) >= least) if min_n else F.lit(True))
    return long.filter(ok).groupBy(*step).agg(F.min_by(value, rank).alias(value), F.min_by(source, rank).alias("source"))


def scenarios(df: DataFrame, calculations: Mapping[str, str], inputs: Mapping[str, Input], variants: Mapping[str, Mapping[str, float]], key: list[str]) -> DataFrame:
    """key, scenario and each calculation, for every variant of constants (replaced values)."""
    parts = []
    for name, overrides in variants.items():
        own = {k: Input(F.lit(float(overrides[k])), i.u, i.kind, i.group) if k in overrides else i for k, i in inputs.items()}
        parts.append(calculate(df, calculations, own).select(*key, F.lit(name).alias("scenario"), *calculations))
    return reduce(lambda a, b: a.unionByName(b), parts)


def shares(df: DataFrame, name: str) -> DataFrame:
    """input, share: each contribution's part of the sum of squares, by row."""
    parts = [c for c in df.columns if c.startswith(f"b_{name}__")]
    total = reduce(lambda a, b: a + b, [F.col(c) ** 2 for c in parts])
    keep = [c for c in df.columns if not c.startswith("b_")]
    rows = F.array(*[F.struct(F.lit(c.split("__", 1)[1]).alias("input"), F.when(total > 0, F.col(c) ** 2 / F.when(total > 0, total)).alias("share")) for c in parts])
    return df.select(*keep, F.explode(rows).alias("p")).select(*keep, "p.*")


def measure_u(stat: str, sem_eff: Column, slope_se_eff: Column, two_point_u: Column, integral_u: Column, reading_u: float = 0.0) -> Column:
    """The standard uncertainty of a measure: what does not average out is added to a mean, counts have none, others are unknown."""
    none = F.lit(None).cast("double")
    return {"mean": F.sqrt(sem_eff**2 + reading_u**2), "slope": slope_se_eff, "two_point": two_point_u, "integral": integral_u, "covered_s": F.lit(0.0), "n": F.lit(0.0)}.get(stat, none)


def unknown_names(calculations: Mapping[str, str], tests: Mapping[str, str], classes: Mapping[str, str], names: set[str]) -> list[str]:
    """Problems of an evaluation as a whole: formulas that name what is not there (yet), names that are taken twice."""
    out, known = [], set(names)
    for what, formulas in (("calculation", calculations), ("criterion", tests)):
        for name, text in formulas.items():
            try:
                formula.parse(text, known)
            except formula.FormulaError as e:
                out.append(f"{what} {name}: {str(e).splitlines()[0]}")
            if name in known:
                out.append(f"{what} {name}: the name is taken")
            known.add(name)
    for name, text in classes.items():
        try:
            formula.parse(text, known)
        except formula.FormulaError as e:
            out.append(f"class {name}: {str(e).splitlines()[0]}")
    return out
