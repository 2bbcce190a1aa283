"""What columns of a loaded table are: runs, parameters, units, the parts of a long table, settings of quality detectors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.operators import assembly, quality
from benchloom.operators.recording import Recording

# Fixed words that tell what a column is.
RUN_WORDS = ("run", "cycle", "experiment", "versuch", "lauf", "zyklus")
VARIABLE_WORDS = ("variable", "channel", "kanal", "roi", "parameter", "sensor")
VALUE_WORDS = ("value", "wert", "parsed")
UNIT_WORDS = ("unit", "einheit")
CALCULATED_WORDS = ("calculated", "berechnet")
TRUTH = ("1", "true", "yes", "ja", "wahr")


def tokens(name: str) -> set[str]:
    """The words of a column's name, between underscores, spaces, points and changes of case."""
    return {w.lower() for w in re.findall(r"[A-Z]?[a-zäöüß]+|[A-ZÄÖÜ]+(?![a-zäöüß])|[0-9]+", name)}


def run_columns(kinds: dict[str, str], given: list[str] | None = None, names: dict[str, str] | None = None) -> list[str]:
    """The given columns (raw names count), else identifiers and texts with a word for runs; a given one that is not there raises."""
    if given is not None:
        found = [(names or {}).get(c, c) for c in given]
        if missing := [c for c in found if c not in kinds]:
            raise KeyError(f"no run column {', '.join(missing)}; there are {', '.join(kinds)}")
        return found
    return [c for c, k in kinds.items() if k in ("identifier", "categorical") and tokens(c) & set(RUN_WORDS)]


def units(numeric: list[str], headers: dict[str, str], attributes: dict[str, dict[str, str]], given: dict[str, str], names: dict[str, str] | None = None) -> dict[str, str]:
    """Units by column: given ones first, then attributes of channels, then headers; a given one of no numeric column raises."""
    out = {c: u for c, u in headers.items() if c in numeric}
    for c, own in attributes.items():
        unit = next((str(v).strip() for k, v in own.items() if tokens(k) & set(UNIT_WORDS) and str(v or "").strip()), None)
        if c in numeric and unit:
            out[c] = unit
    for name, unit in given.items():
        c = (names or {}).get(name, name)
        if c not in numeric:
            raise KeyError(f"unit of {name!r}, which is no numeric column; there are {', '.join(numeric)}")
        out[c] = unit.strip()
    return {c: out[c] for c in numeric if c in out}


@dataclass(frozen=True)
class LongRoles:
    variable: str
    value: str
    attributes: tuple[str, ...] = ()
    metadata: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()


def long_roles(df: DataFrame, kinds: dict[str, str], time: str, variable: str | None = None, value: str | None = None, force: bool = False) -> LongRoles | None:
    """The parts of a long table, or None if it is wide: its times are all different or it has one variable.

    Of the other columns those with one value at each time are metadata of the row, those with one for each variable are
    attributes of the channel; what varies with both is dropped.
    """
    only = lambda found: found[0] if len(found) == 1 else None
    variable = variable or only([c for c, k in kinds.items() if k == "categorical" and tokens(c) & set(VARIABLE_WORDS)])
    value = value or only([c for c, k in kinds.items() if k == "numeric" and tokens(c) & set(VALUE_WORDS)])
    if not variable or not value:
        if force:
            raise ValueError("a long table needs its variable and value columns named")
        return None
    if not force:
        r = df.agg(F.count_distinct(variable).alias("v"), F.count_distinct(time).alias("t"), F.count("*").alias("n")).first()
        if r.v < 2 or r.t == r.n:
            return None
    rest = [c for c in df.columns if c not in (time, variable, value, "row_index")]
    constant = lambda by, columns: {r.column for r in assembly.constant_within(df, [by], columns).filter("constant").collect()} if columns else set()
    meta = constant(time, rest)
    own = constant(variable, [c for c in rest if c not in meta])
    return LongRoles(variable, value, tuple(c for c in rest if c in own), tuple(c for c in rest if c in meta), tuple(c for c in rest if c not in meta and c not in own))


@dataclass(frozen=True)
class QualitySettings:
    """What detectors run with; None is found from the data."""

    detect: bool = True
    jump_factor: float = 10.0
    jump_thresholds: dict[str, float] | None = None
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    calculated: tuple[str, ...] | None = None
    spike_window_s: float | None = None
    spike_channels: tuple[str, ...] | None = None
    spike_min_scale: dict[str, float] = field(default_factory=dict)


def resolve_quality(settings: QualitySettings, rec: Recording, attributes: dict[str, dict[str, str]] | None = None, names: dict[str, str] | None = None) -> QualitySettings:
    """The settings with loaded names and every value that is not given taken from the data (largest over sources)."""
    if not settings.detect:
        return settings

    def known(name: str, what: str) -> str:
        c = (names or {}).get(name, name)
        if c not in rec.channels:
            raise KeyError(f"{what} of {name!r}, which is no channel; there are {', '.join(rec.channels)}")
        return c

    one = lambda df, c: df.agg(F.max(c)).first()[0]
    jumps = {known(n, "jump threshold"): v for n, v in (settings.jump_thresholds or {}).items()}
    jumps = {c: jumps[c] if c in jumps else one(quality.jump_threshold(rec, c, settings.jump_factor), "threshold") for c in rec.channels}
    marked = [c for c, own in (attributes or {}).items() if any(tokens(k) & set(CALCULATED_WORDS) and str(v).strip().lower() in TRUTH for k, v in own.items())]
    calculated = tuple(known(n, "calculated channel") for n in settings.calculated) if settings.calculated is not None else tuple(c for c in rec.channels if c in marked)
    spikes = tuple(known(n, "spike channel") for n in settings.spike_channels) if settings.spike_channels is not None else tuple(rec.channels)
    scale = {known(n, "smallest scale"): v for n, v in settings.spike_min_scale.items()}
    scale = {c: scale[c] if c in scale else one(quality.resolution(rec, c), "resolution") for c in spikes}
    window = settings.spike_window_s if settings.spike_window_s is not None else one(quality.spike_window(rec), "window_s")
    return replace(settings, jump_thresholds=jumps, ranges={known(n, "range"): r for n, r in settings.ranges.items()}, calculated=calculated, spike_channels=spikes, spike_min_scale=scale, spike_window_s=window)
