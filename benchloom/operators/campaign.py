"""A campaign: sources with their clocks, a step table and an evaluation, as one JSON document and a session over it."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.functions import formula, ieee
from benchloom.operators import align, analyses, assembly, byhand, evaluate, reshape, stationary, stats, steps
from benchloom.operators.evaluate import Input
from benchloom.operators.recording import Recording


@dataclass
class Source:
    """A recording in a store: a Parquet path (``${NAME}`` is taken from the environment), its columns, its clock."""

    path: str
    time: str
    channels: list[str]
    source: list[str]
    row: str
    offset_s: float = 0.0
    drift_ppm: float = 0.0
    anchors: list[list[float]] = field(default_factory=list)
    derived: dict[str, str] = field(default_factory=dict)
    clock_u_s: float | None = None


@dataclass
class Measure:
    """A statistic of a channel in a step's window: of the first of ``sources`` (all that have it) with enough points and coverage.

    Points with one of ``exclude_flags`` are left out; ``reading_u`` is the uncertainty of one reading.
    """

    channel: str
    stat: str = "mean"
    skip_start: float = 0.0
    skip_end: float = 0.0
    sources: list[str] = field(default_factory=list)
    exclude_flags: list[str] = field(default_factory=list)
    min_n: int = 1
    min_coverage: float = 0.0
    reading_u: float = 0.0
    half_width_s: float = 0.0


@dataclass
class Display:
    """How a channel is shown: another name, a line style, a colour, and its range (auto, fixed or robust)."""

    alias: str = ""
    style: str | None = None
    color: str | None = None
    scale: str = "auto"
    low: float | None = None
    high: float | None = None

    def problems(self) -> list[str]:
        out = []
        if self.color is not None and not re.fullmatch("#[0-9a-fA-F]{6}", self.color):
            out.append(f"{self.color!r} is no colour")
        if self.scale not in ("auto", "fixed", "robust"):
            out.append(f"{self.scale!r} is no scale")
        if self.scale == "fixed" and (self.low is None or self.high is None or self.low >= self.high):
            out.append("a fixed range needs low < high")
        return out

    def limits(self, df: DataFrame, channel: str) -> tuple[float, float] | None:
        """The range to show; None lets the plot fit what is visible. A robust one is between percentiles (1 and 99)."""
        if self.scale == "fixed":
            return self.low, self.high
        if self.scale == "auto":
            return None
        r = assembly.robust_range(df.withColumn("__all", F.lit(0)), ["__all"], channel, self.low if self.low is not None else 1.0, self.high if self.high is not None else 99.0).first()
        return (r.low, r.high) if r else None


@dataclass
class Campaign:
    sources: dict[str, Source] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=dict)
    constants: dict[str, list] = field(default_factory=dict)
    calculations: dict[str, str] = field(default_factory=dict)
    criteria: dict[str, str] = field(default_factory=dict)
    classes: dict[str, str] = field(default_factory=dict)
    zone: str = "Europe/Zurich"
    #: Own uncertainties of calculations: formula, kind, group.
    own: dict[str, list] = field(default_factory=dict)
    #: Analyses of results by name: kind (crossing, line, aggregate) and its arguments.
    analyses: dict[str, dict] = field(default_factory=dict)
    #: Steps and windows set by hand.
    manual_steps: list[dict] = field(default_factory=list)
    overrides: list[dict] = field(default_factory=list)
    display: dict[str, Display] = field(default_factory=dict)
    #: The step table as it was when the campaign was saved.
    snapshot: list[dict] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "Campaign":
        """Unknown keys raise; what is read and written again stays the same."""
        d = json.loads(text)
        if unknown := set(d) - set(Campaign.__dataclass_fields__):
            raise KeyError(f"unknown keys: {', '.join(sorted(unknown))}")
        d["sources"] = {k: Source(**v) for k, v in d.get("sources", {}).items()}
        d["measures"] = {k: Measure(**v) for k, v in d.get("measures", {}).items()}
        d["display"] = {k: Display(**v) for k, v in d.get("display", {}).items()}
        return Campaign(**d)

    def relative_to(self, folder: str) -> "Campaign":
        """A copy whose source paths are relative to a folder, as far as they lie below it."""
        inside = lambda p: p[len(folder.rstrip("/")) + 1 :] if p.startswith(folder.rstrip("/") + "/") else p
        return replace(self, sources={k: replace(v, path=inside(v.path)) for k, v in self.sources.items()})

    def below(self, folder: str) -> "Campaign":
        """A copy whose relative source paths lie below a folder."""
        full = lambda p: p if p.startswith(("/", "$")) or "://" in p else f"{folder.rstrip('/')}/{p}"
        return replace(self, sources={k: replace(v, path=full(v.path)) for k, v in self.sources.items()})

    def with_recipe(self, recipe: dict) -> tuple["Campaign", list[str]]:
        """A copy with the evaluation of a recipe (which has no sources), and what of it the sources here lack."""
        parts = ("measures", "constants", "calculations", "criteria", "classes", "own", "analyses")
        if unknown := set(recipe) - set(parts):
            raise KeyError(f"unknown keys: {', '.join(sorted(unknown))}")
        given = {k: recipe.get(k, {}) for k in parts}
        given["measures"] = {k: v if isinstance(v, Measure) else Measure(**v) for k, v in given["measures"].items()}
        out = replace(self, **given)
        channels = {c for s in self.sources.values() for c in [*s.channels, *s.derived]}
        return out, [f"measure {n}: no source has {m.channel}" for n, m in out.measures.items() if m.channel not in channels]


def calibrated(source: Source, name: str, channel: str, factor: float, sensitivity: float, zero: float) -> Source:
    """A copy of a source with one more channel, a channel's calibration line."""
    return replace(source, derived={**source.derived, name: stationary.calibration_formula(channel, factor, sensitivity, zero)})


def expand_path(path: str) -> str:
    """``${NAME}`` from the environment; an unset name raises."""
    if missing := [n for n in re.findall(r"\$\{(\w+)\}", path) if n not in os.environ]:
        raise KeyError(f"not set: {', '.join(missing)}")
    return re.sub(r"\$\{(\w+)\}", lambda m: os.environ[m[1]], path)


class Session:
    """Lazy tables of a campaign; nothing is computed until a result is asked for. ``flags`` are the quality events of sources."""

    def __init__(self, spark: SparkSession, campaign: Campaign, flags: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.campaign, self.flags = spark, campaign, flags or {}
        #: What could not be used, but does not stand in the way of the rest.
        self.problems: list[str] = []
        problems = [f"measure {n}: no channel {m.channel}" for n, m in campaign.measures.items() if not self.sources_of(m)]
        names = [*campaign.measures, *campaign.constants, *campaign.calculations, *campaign.criteria]
        problems += [f"name {n} is used twice" for n in sorted({n for n in names if names.count(n) > 1})]
        problems += [f"display of {n}: {p}" for n, d in campaign.display.items() for p in d.problems()]
        problems += [f"own uncertainty of {n}, which is no calculation" for n in campaign.own if n not in campaign.calculations]
        if problems:
            raise ValueError("; ".join(problems))

    def sources_of(self, m: Measure) -> list[str]:
        """The sources of a measure in order of preference."""
        having = [k for k, s in self.campaign.sources.items() if m.channel in [*s.channels, *s.derived]]
        return [k for k in m.sources if k in having] if m.sources else having[:1]

    def recording(self, name: str) -> Recording:
        """A source on master time (``master_s``), with its calculated channels; one that cannot be calculated is null and a problem."""
        s = self.campaign.sources[name]
        df = self.spark.read.parquet(expand_path(s.path))
        for channel, text in s.derived.items():
            try:
                df = df.withColumn(channel, formula.compile_formula(text, df))
            except formula.FormulaError as e:
                self.problems.append(f"{name}/{channel}: {str(e).splitlines()[0]}")
                df = df.withColumn(channel, F.lit(None).cast("double"))
        own = F.col(s.time) / 1e6
        master = align.clock_anchors(own, [tuple(a) for a in s.anchors]) if s.anchors else align.clock(own, s.offset_s, s.drift_ppm)
        df = df.withColumn("master_s", master)
        return Recording(df, tuple(s.source), tuple(s.source), s.row, s.time, (*s.channels, *s.derived))

    def coverage(self, name: str, channel: str) -> DataFrame:
        return align.coverage(self.recording(name), channel)

    def span(self, name: str) -> DataFrame:
        """start, end of a source on master time."""
        return assembly.span(self.recording(name), F.col("master_s"))

    def all_steps(self, tables: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
        """The steps of several tables (status, reason as derived) and those set by hand in order of their starts; and the rows that are none."""
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
        good = both.filter("status = 'step'") if "status" in both.columns else both
        if self.campaign.manual_steps:
            hand = self.spark.createDataFrame([(str(m["step_id"]), m.get("label"), float(m["start"]), float(m["end"])) for m in self.campaign.manual_steps], "step_id string, label string, start double, `end` double")
            good = byhand.with_manual(good.withColumn("step_id", F.col("step_id").cast("string")), hand)
        return good.orderBy("start"), both.filter("status <> 'step'") if "status" in both.columns else both.limit(0)

    def changes(self, table: DataFrame) -> DataFrame:
        """key, change of the step table against the snapshot that the campaign was saved with."""
        content = [c for c in ("label", "start", "end") if c in table.columns]
        schema = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in ("step_id", *content))
        old = self.spark.createDataFrame([tuple(r.get(c) for c in ("step_id", *content)) for r in self.campaign.snapshot], schema)
        return steps.compare_snapshots(old, table.select("step_id", *content), "step_id", content)

    def measure_rows(self, source: str, measures: dict[str, Measure], table: DataFrame, by: list[str]) -> DataFrame:
        """step_id, measure, source, n, coverage, value, u, level, checks of measures on one source, all in one pass over its samples.

        Each measure has its window of a step and the values it takes (a channel less what its flags exclude); samples give their
        values once for each kind that is taken, windows meet their kind's, and every statistic is one grouping by step and measure.
        """
        s, rec = self.campaign.sources[source], self.recording(source)
        flags = self.flags.get(source)
        kind_of = {name: (m.channel, tuple(sorted(m.exclude_flags)) if flags is not None else ()) for name, m in measures.items()}
        kinds = list(dict.fromkeys(kind_of.values()))
        df, key, place = rec.df, ["step_id", "measure"], [*by, "__of"]
        if any(names for _, names in kinds):
            hit = lambda channel, names: F.max(F.col("flag").isin(*names) & (F.col("channel").isNull() | (F.col("channel") == channel)))
            marked = flags.groupBy(*rec.source, F.col("row").alias(rec.row)).agg(*[hit(*kind).alias(f"__f{i}") for i, kind in enumerate(kinds) if kind[1]])
            df = df.join(marked, [*rec.source, rec.row], "left")
        out = {i: F.coalesce(f"__f{i}", F.lit(False)) if names else F.lit(False) for i, (_, names) in enumerate(kinds)}
        taken = F.inline(F.array(*[F.struct(F.lit(i).alias("__of"), F.col(channel).cast("double").alias("__y"), out[i].alias("__out")) for i, (channel, _) in enumerate(kinds)]))
        samples = df.select(*by, F.col(rec.row).alias("__row"), F.col("master_s").alias("__t"), taken)

        def window(name: str, m: Measure) -> Column:
            low, high = steps.window_rule(F.col("start"), F.col("end"), m.skip_start, m.skip_end)
            return F.struct(F.lit(name).alias("measure"), F.lit(kinds.index(kind_of[name])).alias("__of"), low.alias("__lo"), high.alias("__hi"))

        windows = table.select(*by, "step_id", F.inline(F.array(*[window(*x) for x in measures.items()]))).filter("__lo is not null")
        rows = stats.in_windows(samples, windows, place, "__t", "__lo", "__hi")
        used = rows.filter(~F.col("__out"))
        found = [
            stats.counts(rows, key, "__y", "__lo", "__hi", "__out"),
            stats.integral(samples.withColumn("__y", F.when(~F.col("__out"), F.col("__y"))), windows, place, key, "__t", "__y", "__lo", "__hi", "__row"),
            stats.location(used, key, "__y").drop("n"),
            stats.autocorrelation(used, key, "__y", "__row").select(*key, "n_eff", "sem_eff"),
        ]
        having = lambda stat: [n for n, m in measures.items() if m.stat == stat]
        if names := having("slope"):
            some = used.filter(F.col("measure").isin(names))
            robust = stats.robust(some, key, "__t", "__y", "__lo", "__hi").select(*key, "slope_se_eff", "slope_theil_sen", "ts_ci_low", "ts_ci_high", "halves_diff", "halves_u")
            found += [stats.slope(some, key, "__t", "__y", "__lo").select(*key, "slope"), robust]
        if names := having("two_point"):
            alike: dict[tuple[float, float], list[str]] = {}
            for n in names:
                alike.setdefault((measures[n].half_width_s, measures[n].reading_u), []).append(n)
            ends = [stats.two_point(used.filter(F.col("measure").isin(of)), key, "__t", "__y", "__lo", "__hi", "__row", *how, s.clock_u_s or 0.0) for how, of in alike.items()]
            found.append(reduce(DataFrame.unionByName, ends).select(*key, "two_point", "two_point_u"))
        df = reduce(lambda a, b: a.join(b, key, "left"), found, windows.select(*key))
        col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        n, coverage = zero("n"), F.coalesce("coverage", F.lit(0.0))

        def each(f: Callable[[Measure], Column]) -> Column:
            return F.coalesce(*[F.when(F.col("measure") == name, f(m)) for name, m in measures.items()])

        df = df.withColumn("__value", each(lambda m: (n if m.stat == "n" else F.col(m.stat)).cast("double")))
        df = df.withColumn("__u", each(lambda m: evaluate.measure_u(m.stat, F.col("sem_eff"), col("slope_se_eff"), col("two_point_u"), F.col("sem_eff") * F.col("covered_s"), m.reading_u)))
        trend = stationary.Trend(*[col(c) for c in ("slope", "slope_se_eff", "slope_theil_sen", "ts_ci_low", "ts_ci_high", "halves_diff", "halves_u", "window_s")])
        df = df.withColumn("__c", stationary.checks(n, coverage, zero("n_excluded"), zero("n_missing"), F.col("sd"), n_eff=F.col("n_eff"), trend=trend))
        return df.select(*key, F.lit(source).alias("source"), n.alias("n"), coverage.alias("coverage"), F.col("__value").alias("value"), F.when(F.col("__value").isNotNull(), F.col("__u")).alias("u"), stationary.level(F.col("__c")).alias("level"), F.transform("__c", lambda x: x["text"]).alias("checks"))

    def window_table(self, table: DataFrame, by: list[str]) -> DataFrame:
        """measure_rows of every measure over its window of every step (step_id, start, end), of its first source that is good enough."""
        measures = self.campaign.measures
        sources = {name: self.sources_of(m) for name, m in measures.items()}
        among = lambda f: F.coalesce(*[F.when(F.col("measure") == name, f(name)) for name in measures])
        parts = []
        for source in dict.fromkeys(x for names in sources.values() for x in names):
            of = {name: m for name, m in measures.items() if source in sources[name]}
            place = among(lambda name: F.lit(sources[name].index(source) if source in sources[name] else len(sources[name])))
            parts.append(self.measure_rows(source, of, table, by).withColumn("__place", place))
        good = F.col("value").isNotNull() & (F.col("n") >= among(lambda name: F.lit(measures[name].min_n))) & (F.col("coverage") >= among(lambda name: F.lit(measures[name].min_coverage)))
        out = reduce(DataFrame.unionByName, parts).withColumn("__ok", good)
        best = F.min_by(F.struct("source", "n", "coverage", "value", "u", "level", "checks"), F.struct(~F.col("__ok"), "__place"))
        single = F.col("measure").isin([name for name, names in sources.items() if len(names) < 2])
        return out.groupBy("step_id", "measure").agg(best.alias("b"), F.max("__ok").alias("__any")).select("step_id", "measure", "b.source", "b.n", "b.coverage", *[F.when(F.col("__any") | single, F.col(f"b.{c}")).alias(c) for c in ("value", "u")], "b.level", "b.checks")

    def window_stats(self, table: DataFrame, by: list[str], step_id, source: str, channel: str) -> DataFrame:
        """stat, value, u of one step's window on one channel."""
        named = {stat: Measure(channel, stat) for stat in ("n", "mean", "median", "sd", "min", "max", "slope", "two_point", "integral", "covered_s")}
        return self.measure_rows(source, named, table.filter(F.col("step_id") == F.lit(step_id)), by).select(F.col("measure").alias("stat"), "value", "u")

    def results(self, table: DataFrame, by: list[str]) -> DataFrame:
        """The step table with measures (name, u_name, checks_name, source_name), classes with a note, calculations with budgets, and criteria.

        Formulas that name what is not there raise, all of them at once.
        """
        c = self.campaign
        if wrong := evaluate.unknown_names(c.calculations, c.criteria, c.classes, {*table.columns, *c.measures, *c.constants}):
            raise ValueError("; ".join(wrong))
        parts = ("value", "u", "checks", "source")
        wide = self.window_table(table, by).groupBy("step_id").pivot("measure", list(c.measures)).agg(*[F.first(p).alias(p) for p in parts])
        named = {"value": "{}", "u": "u_{}", "checks": "checks_{}", "source": "source_{}"}
        wide = wide.select("step_id", *[F.col(f"{m}_{p}").alias(named[p].format(m)) for m in c.measures for p in parts])
        df = table.join(wide, "step_id", "left")
        if c.classes:
            df = steps.classify(df, c.classes)
        inputs = {m: Input(F.col(m), F.coalesce(F.col(f"u_{m}"), F.lit(0.0))) for m in c.measures}
        inputs |= evaluate.merged_inputs({k: tuple(v) for k, v in c.constants.items()})
        df = evaluate.calculate(df, c.calculations, inputs, {n: evaluate.Own(*o) for n, o in c.own.items()})
        return evaluate.criteria(df, c.criteria)

    def analysis(self, name: str, results: DataFrame) -> DataFrame:
        """An analysis of the results by its kind and the arguments of its function (KINDS), of the rows for which ``where`` holds.

        ``columns_of`` names formulas that are computed first; ``derived`` of a line names formulas over its m and b and the campaign's
        constants, which come with their u beside the line's columns.
        """
        spec = dict(self.campaign.analyses[name])
        kind, where, computed, derived = (spec.pop(k, None) for k in ("kind", "where", "columns_of", "derived"))
        if kind not in KINDS:
            raise ValueError(f"analysis {name}: no kind {kind!r}; there are {', '.join(KINDS)}")
        if derived and kind not in LINES:
            raise ValueError(f"analysis {name}: {kind} has no derived quantities; {', '.join(LINES)} have")
        df = results.filter(ieee.holds(formula.compile_formula(where, results))) if where else results
        for column, text in (computed or {}).items():
            df = df.withColumn(column, formula.compile_formula(text, df))
        if not derived:
            return KINDS[kind](df, **spec)
        line = KINDS[kind](df, **spec, with_cov=True)
        found = analyses.derived_quantities(line, spec["by"], derived, {k: v[0] for k, v in self.campaign.constants.items()})
        return line.drop("cov_mb").join(found, spec["by"])


#: Analyses of a campaign by kind; lines can have derived quantities.
LINES = {"line": analyses.fit_line, "line_gls": analyses.fit_line_gls}
KINDS = {
    **LINES, "crossing": analyses.crossing_range, "crossing_systematic": analyses.crossing_systematic, "crossing_text": analyses.crossing_text,
    "monte_carlo_crossing": analyses.monte_carlo_crossing, "monte_carlo_line": analyses.monte_carlo_line, "aggregate": reshape.aggregate,
}
