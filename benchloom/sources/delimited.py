"""Delimited files as recordings: sniffed once, read as text by Spark, typed with an audit of every cell that is no value."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from benchloom.functions import times, typing
from benchloom.operators.reshape import clean_name, unique_names
from benchloom.sources import quoted
from benchloom.sources.lines import numbered_lines
from benchloom.sources.sniff import Sniffed, sniff

# Fixed words that name a time column.
TIME_NAMES = ("time", "time_seconds", "zeit", "timestamp", "datetime", "date")


@dataclass
class Dataset:
    """Typed columns, the audit, kinds and units by column, and what was decided (enough to load again the same way)."""

    df: DataFrame
    audit: DataFrame
    kinds: dict[str, str]
    units: dict[str, str]
    time: str
    spec: dict = field(default_factory=dict)
    #: The loaded name of each header; the time column is time_seconds.
    names: dict[str, str] = field(default_factory=dict)


def read_raw(spark: SparkSession, path: str, sniffed: Sniffed) -> DataFrame:
    """All cells as text, with ``row_index`` (the line, from 0, on which a record begins); comments, the header and the footer left out."""
    names = sniffed.names
    quotes = quoted.has_quotes(spark, path, sniffed.encoding)
    lines = quoted.records(spark, path, sniffed.encoding, sniffed.delimiter) if quotes else numbered_lines(spark, path, sniffed.encoding)
    body = lines.filter((F.col("row_index") > sniffed.header_row) & (F.trim("value") != "") & ~F.col("value").startswith("#"))
    if len(names) > 1:
        # The footer, as footer_of has it but over the whole file: all after the last line with a value beside the first.
        d = re.escape(sniffed.delimiter)
        data = F.col("value").rlike(rf"^[^{d}]*{d}[\s{d}]*[^\s{d}]") & ~F.col("value").rlike(r"^(?:#|//|\*)")
        body = body.filter(F.col("row_index") <= F.lit(body.filter(data).agg(F.max("row_index")).first()[0]).cast("bigint"))
    cells = F.from_csv("value", _ddl(names), {"sep": sniffed.delimiter, "mode": "PERMISSIVE", "escape": '"', "maxCharsPerColumn": "-1"})
    return body.select("row_index", cells.alias("c")).select("row_index", "c.*")


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n}` string" for n in names)


def split_unit(header: str, pattern: str = r"^(?P<name>.*?)\s*[\[(](?P<unit>[^\])]*)[\])]\s*$") -> tuple[str, str | None]:
    """Name and unit of a header such as ``Temp [°C]``; a number in brackets is part of the name."""
    m = re.match(pattern, header)
    return (m["name"], m["unit"]) if m and m["name"] and not m["unit"].strip().isdigit() else (header, None)


def load(spark: SparkSession, path: str, time_column: str | None = None, kinds: dict[str, str] | None = None, run_columns: tuple[str, ...] = (), ratio: float = 0.5, spec: dict | None = None) -> Dataset:
    """A file as a dataset. With the ``spec`` of an earlier load all decisions are taken from it."""
    spec = spec or {}
    s = Sniffed(**spec["sniffed"]) if "sniffed" in spec else sniff(spark, path)
    out = as_dataset(read_raw(spark, path, s), s.names, s.decimal, time_column, kinds, run_columns, ratio, spec)
    out.spec["sniffed"] = s.__dict__
    return out


def as_dataset(raw: DataFrame, headers: list[str], decimal: str = ".", time_column: str | None = None, kinds: dict[str, str] | None = None, run_columns: tuple[str, ...] = (), ratio: float = 0.5, spec: dict | None = None) -> Dataset:
    """Cells of text under ``headers``, after ``row_index``, as a dataset."""
    spec = spec or {}
    names = unique_names([clean_name(split_unit(n)[0], i) for i, n in enumerate(headers)])
    units = {new: u for new, n in zip(names, headers, strict=True) if (u := split_unit(n)[1])}
    raw = raw.toDF("row_index", *names)
    wanted = spec.get("time") or time_column
    time = next((n for n, r in zip(names, headers, strict=True) if wanted in (n, r)), None) if wanted else next((n for n in names if n in TIME_NAMES), names[0])
    if time is None:
        raise KeyError(f"no column {wanted!r}; there are {', '.join(names)}")
    found = spec.get("kinds")
    if not found:
        # One pass over the cells decides the kinds of all columns.
        found = {r.column: r.kind for r in typing.column_kinds(raw, [n for n in names if n != time], ratio=ratio, decimal=decimal).collect()}
        found |= {n: k for raw_name, k in (kinds or {}).items() for n, r in zip(names, headers, strict=True) if raw_name in (n, r)}
        found |= {n: "identifier" for n in run_columns if found.get(n) == "numeric"}
    cells = {n: typing.number_cell(F.col(n), decimal) if k == "numeric" else typing.integer_cell(F.col(n)) for n, k in found.items() if k in ("numeric", "identifier")}
    texts = [F.when(~typing.is_sentinel(F.col(n)), F.trim(n)).alias(n) for n, k in found.items() if k == "categorical"]
    format_ = spec.get("time_format") or time_format(raw, time)
    kept = raw.select("row_index", F.col(time).alias("__raw_time"), *[c["value"].alias(n) for n, c in cells.items()], *texts)
    df = with_seconds(kept, "__raw_time", format_, decimal)
    bad_time = df.filter(F.col("time_seconds").isNull() & (F.trim("__raw_time") != "")).select("row_index", F.lit(time).alias("column"), F.col("__raw_time").alias("raw_value"), F.lit("invalid_timestamp").alias("reason"))
    audit = typing.audit(raw, "row_index", cells).unionByName(bad_time) if cells else bad_time
    return Dataset(df.drop("__raw_time"), audit, {time: "time"} | found, units, "time_seconds", {"time": time, "kinds": found, "time_format": format_}, {r: "time_seconds" if n == time else n for n, r in zip(names, headers, strict=True)})


def time_format(raw: DataFrame, time: str) -> str:
    """clock, datetime or number: the first that at least half of 50 cells are."""
    part = raw.select(F.col(time).alias("t")).filter(F.trim("t") != "").limit(50)
    r = part.agg(F.count("*").alias("n"), F.count(times.clock_seconds(F.col("t"))).alias("clock"), F.count(times.parse_datetime(F.col("t"))).alias("datetime")).first()
    return next((k for k in ("clock", "datetime") if r.n and r[k] * 2 >= r.n), "number")


def with_seconds(df: DataFrame, time: str, format_: str, decimal: str) -> DataFrame:
    """Adds time_seconds: numbers as they are, clock times that count on over midnight, date-times as epoch seconds."""
    if format_ == "datetime":
        return df.withColumn("time_seconds", F.unix_micros(times.parse_datetime(F.col(time))) / 1e6)
    if format_ == "number":
        return df.withColumn("time_seconds", typing.parse_number(F.col(time), decimal))
    # A file is one sequence; its clock times are ordered in one task, a file of this kind being a day's log.
    df = df.withColumn("__file", F.lit(0)).withColumn("__own", times.clock_seconds(F.col(time)))
    own, days, w = times.unrolled(F.col("__own"), ["__file"], "row_index")
    df = df.withColumn("__days", days)
    return df.withColumn("time_seconds", own + 86400.0 * F.sum("__days").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__file", "__own", "__days")
