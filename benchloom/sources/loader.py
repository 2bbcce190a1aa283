"""Any file as a dataset: its profile is found, its reader called, what was done is kept; several files become one table."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date, datetime, timedelta, timezone
from pathlib import PurePath
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.functions import times
from benchloom.operators import reshape
from benchloom.sources import delimited, files, sniff, sqlite, tables
from benchloom.sources.profiles import Profile, detect
from benchloom.sources.shipped import SHIPPED


@dataclass
class Loaded:
    """A dataset, its profile, and meta: source, sha256, reader, settings, side sheets, and how its origin was found."""

    data: delimited.Dataset | None
    profile: Profile | None
    meta: dict = field(default_factory=dict)
    origin_us: int | None = None


def with_choices(profile: Profile | None, reader: str, sheet: str | None = None, table: str | None = None, clock_date: date | None = None) -> Profile:
    """A copy of a profile (or a new one for the reader) with a sheet, a table, or the date of clock times; the given one stays."""
    out = profile or Profile("manual", reader)
    options = dict(out.options)
    if sheet is not None:
        options["sheet"] = sheet
    if table is not None:
        options["table"] = table
        options.pop("query", None)
    if clock_date is not None:
        options["clock_date"] = clock_date.isoformat()
        options.pop("origin", None)
    return replace(out, options=options)


def needs_clock_date(loaded: Loaded) -> bool:
    """Whether the times are times of day that nothing places on a day."""
    return loaded.origin_us is None and loaded.data is not None and loaded.data.spec["time_format"] == "clock"


def _text_rows(df: DataFrame, headers: list[str]) -> DataFrame:
    return df.select("row_index", *[F.col(f"`{c}`").cast("string").alias(c) for c in headers])


def load_any(spark: SparkSession, path: str, profile: Profile | None = None, profiles: tuple[Profile, ...] = SHIPPED, spec: dict | None = None) -> Loaded:
    """The file at ``path`` by its profile (the given one, else the first that fits); sqlite, excel, xml or delimited by its bytes."""
    head, _ = sniff.head_bytes(spark, path, 1 << 20)
    name = PurePath(path).name
    reader = files.reader_for(head, name)
    if profile is None:
        text = None
        if reader == "sqlite":
            text = " ".join(files.table_names(spark, path))
        elif reader == "excel" and head[:2] == b"PK":
            content = files.fetch(spark, path)
            text = " ".join([*files.sheet_names(content), *(c for s in files.sheet_names(content) for row in files.read_grid(content, s)[:50] for c in row)])
        profile = detect(profiles, name, head, text)
    options = profile.options if profile else {}
    out = Loaded(None, profile, {"source": name, "sha256": files.digest(spark, path), "reader": reader, "profile": profile.name if profile else None})
    common = {"time_column": options.get("time_column"), "kinds": options.get("kinds"), "run_columns": tuple(options.get("run_columns", ()))}
    if reader == "xml":
        out.meta["settings"] = files.read_xml_meta(spark, path, options.get("blocks", []))
        return out
    if reader == "delimited":
        out.data = delimited.load(spark, path, spec=spec, **common)
    else:
        if reader == "sqlite":
            df = sqlite.read(spark, path, options.get("table"), options.get("query"), numbered="row_index")
            for column in options.get("json_columns", []):
                df = tables.split_json(df, column)
        else:
            df = files.read_excel(spark, path, options.get("sheet"), options.get("header_row"), numbered="row_index")
            content = files.fetch(spark, path)
            out.meta["sheets"] = {s: files.key_values(files.read_grid(content, s)) for s in options.get("meta_sheets", []) if s in files.sheet_names(content)}
        headers = [c for c in df.columns if c != "row_index"]
        out.data = delimited.as_dataset(_text_rows(df, headers), headers, spec=spec, **common)
    out.origin_us = _origin(spark, path, out, options)
    return out


def _origin(spark: SparkSession, path: str, loaded: Loaded, options: dict) -> int | None:
    """Where a recording of clock times or numbers begins: by a date, an origin, or the time its file was saved less its duration."""
    d, zone = loaded.data, options.get("zone")
    form = d.spec["time_format"]
    ends = None
    if options.get("clock_date") or options.get("origin") or options.get("origin_rule") == "file_mtime_end" and form != "datetime":
        ends = d.df.agg(F.min_by("time_seconds", "row_index").alias("first"), F.max("time_seconds").alias("last"), F.min("time_seconds").alias("low")).first()
    if options.get("clock_date"):
        return times.origin_us(form, zone, ends["first"], clock_date=date.fromisoformat(options["clock_date"]))
    if options.get("origin"):
        return times.origin_us(form, zone, origin=datetime.fromisoformat(options["origin"]))
    if options.get("origin_rule") == "file_mtime_end" and form != "datetime" and ends["last"] is not None:
        saved = spark.read.format("binaryFile").load(path).agg(F.unix_micros(F.max("modificationTime")).alias("us")).first().us
        loaded.meta["origin_rule"] = {"rule": "file_mtime_end", "file_saved": (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=saved)).astimezone(ZoneInfo(zone or "UTC")).isoformat(), "note": "the file is taken to be saved right after its last sample"}
        return saved - round((ends["last"] - ends["first"]) * 1e6)
    return None


def default_key(time: str, variable: str | None = None) -> list[str]:
    """Rows of overlapping files are one by time, and in long tables by variable."""
    return [time, variable] if variable else [time]


def placed(loaded: Loaded) -> DataFrame:
    """A loaded table on absolute time: where a file's clock or counter begins at an origin, its seconds count from there.

    Clock times keep their distance from the first of them; date-times are absolute as they are.
    """
    df = loaded.data.df
    if loaded.origin_us is None or loaded.data.spec["time_format"] == "datetime":
        return df
    first = df.agg(F.min_by("time_seconds", "row_index").alias("t")).first().t if loaded.data.spec["time_format"] == "clock" else 0.0
    return df.withColumn("time_seconds", F.col("time_seconds") - F.lit(first or 0.0) + F.lit(loaded.origin_us / 1e6))


def load_many(spark: SparkSession, paths: list[str], key: list[str] | None = None, profile: Profile | None = None, profiles: tuple[Profile, ...] = SHIPPED, **choices) -> tuple[DataFrame, DataFrame, list[str]]:
    """All files as one table in the order given: of rows with equal keys those of the last file stay; a file that was given before
    (by its bytes) is skipped. Each file is read by its profile (``profile`` for all, ``choices`` as with_choices has them)
    and put on absolute time by its origin. Returns the table (with source_no), the conflicts, and the paths that were skipped."""
    seen: set[str] = set()
    parts, skipped, time, variable = [], [], None, None
    for path in paths:
        digest = files.digest(spark, path)
        if digest in seen:
            skipped.append(path)
            continue
        seen.add(digest)
        given = with_choices(profile, "delimited", **choices) if choices else profile
        loaded = load_any(spark, path, given, profiles)
        if loaded.data is None:
            raise ValueError(f"{path}: settings are no table")
        time = time or loaded.data.time
        variable = variable or (loaded.profile.options.get("variable") if loaded.profile else None)
        parts.append(placed(loaded).drop("row_index"))
    if not parts:
        raise ValueError("no files were given")
    key = key or default_key(time, variable if variable in parts[0].columns else None)
    columns = [c for c in parts[0].columns if c not in key]
    return reshape.newest_wins(parts, key), reshape.merge_conflicts(parts, key, columns), skipped
