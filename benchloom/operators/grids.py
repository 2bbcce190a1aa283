"""Steps from a sheet: header rows are found by text, rows become steps or get a reason why not."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from benchloom.operators.reshape import clean_name


def header_key(text: str, unit: bool = True) -> str:
    """Case and spaces do not count; without ``unit`` a bracketed or comma-separated unit does not either."""
    s = text if unit else re.sub(r"\s*(?:[\[(][^\])]*[\])]|,\s*\S+)\s*$", "", text)
    return re.sub(r"\s+", "", s).lower().rstrip(":")


def suggest_header(name: str, headers: list[str]) -> str | None:
    """The header that is most like a name."""
    keys = {header_key(h): h for h in headers if h.strip()}
    near = difflib.get_close_matches(header_key(name), list(keys), 1)
    return keys[near[0]] if near else None


def match_header(name: str, headers: list[str]) -> int | None:
    """The column of a header: by its text, without units, by its clean name, by that without units; several equally good ones raise."""
    readings = (header_key, lambda h: header_key(h, False), clean_name, lambda h: clean_name(re.sub(r"\s*[\[(][^\])]*[\])]\s*$", "", h)))
    for read in readings:
        wanted = read(name)
        hits = [i for i, h in enumerate(headers) if h.strip() and wanted and read(h) == wanted]
        if len(hits) > 1:
            raise LookupError(f"{name!r} fits several headers: {', '.join(headers[i] for i in hits)}")
        if hits:
            return hits[0]
    return None


def find_header_row(grid: list[list[str]], names: list[str], rows: int = 200) -> int:
    """The first row that has all names; else an error with the closest header of the best row."""
    best, missing = -1, names
    for i, row in enumerate(grid[:rows]):
        absent = [n for n in names if match_header(n, row) is None]
        if not absent:
            return i
        if len(absent) < len(missing):
            best, missing = i, absent
    near = difflib.get_close_matches(missing[0], [c for r in grid[:rows] for c in r if c.strip()], 1)
    raise LookupError(f"no row has {', '.join(missing)}" + (f" (row {best + 1} has the others)" if best >= 0 else "") + (f"; did you mean {near[0]!r}?" if near else ""))


@dataclass
class Mapping:
    """Columns of a step table: start and end (seconds of the day or numbers), label, parameters with defaults."""

    start: str
    end: str | None = None
    label: str | None = None
    params: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    skip_rows: tuple[int, ...] = ()
    fixed_s: float | None = None


def _seconds(text: str) -> float | None:
    s = text.strip().replace(",", ".")
    if m := re.fullmatch(r"(\d{1,2}):([0-5]\d)(?::([0-5]\d(?:\.\d+)?))?", s):
        return int(m[1]) * 3600 + int(m[2]) * 60 + float(m[3] or 0)
    try:
        return float(s)
    except ValueError:
        return None


#: Columns of derived steps.
STEPS = "row int, status string, reason string, step_id string, label string, start double, `end` double, params map<string,string>, cells map<string,string>"


def derive_steps(spark: SparkSession, grid: list[list[str]], mapping: Mapping) -> DataFrame:
    """The steps of one sheet that the driver holds (``step_rows``); for many books see ``sources.journals``."""
    return spark.createDataFrame(step_rows(grid, mapping), STEPS)


def step_rows(grid: list[list[str]], mapping: Mapping) -> list[tuple]:
    """row, status, reason, step_id, label, start, end, params, cells of every row below the header.

    A clock time below the start before it is on the next day; an end before its start too. Ends: the column, the next start,
    the fixed length. Labels are filled down, parameters have their defaults where a cell is empty. ``cells`` has all of a row.
    """
    wanted = [n for n in (mapping.start, mapping.end, mapping.label, *mapping.params.values()) if n]
    head = find_header_row(grid, wanted)
    at = {n: match_header(n, grid[head]) for n in wanted}
    cell = lambda row, n: row[at[n]].strip() if n and at[n] < len(row) else ""
    rows: list[dict] = []
    before, day, label = None, 0.0, None
    for i, row in enumerate(grid[head + 1 :], head + 2):
        text = cell(row, mapping.start)
        start = _seconds(text)
        label = cell(row, mapping.label) or label
        reason = "skipped by hand" if i in mapping.skip_rows else "empty row" if not any(c.strip() for c in row) else "no start" if not text else f"start {text!r} is no time" if start is None else None
        end = None
        if reason is None:
            clock = ":" in text
            if clock and before is not None and start + day < before:
                day += 86400.0
            start = before = start + day * clock
            if mapping.end and (e := _seconds(cell(row, mapping.end))) is not None:
                end = e + day * (":" in cell(row, mapping.end))
                end += 86400.0 * (end < start and clock)
        params = {k: cell(row, n) or mapping.defaults.get(k, "") for k, n in mapping.params.items()}
        cells = {h.strip(): row[j].strip() for j, h in enumerate(grid[head]) if h.strip() and j < len(row) and row[j].strip()}
        rows.append({"cells": cells, "row": i, "reason": reason, "label": label, "start": start if reason is None else None, "end": end, "params": params})
    good = [r for r in rows if r["reason"] is None]
    for here, after in zip(good, [*good[1:], None], strict=True):
        if here["end"] is None:
            here["end"] = after["start"] if after else here["start"] + mapping.fixed_s if mapping.fixed_s is not None else None
        if here["end"] is None:
            here["reason"] = "no end"
        elif here["end"] <= here["start"]:
            here["reason"] = "end is not after start"
    return [(r["row"], "step" if r["reason"] is None else "excluded", r["reason"], f"row{r['row']}" if r["reason"] is None else None, r["label"], r["start"], r["end"], r["params"], r["cells"]) for r in rows]
