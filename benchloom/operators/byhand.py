"""What is set by hand beside rules: steps, windows of steps, and how they find their step again; named windows, looked-up parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchloom.functions import times, typing
from benchloom.operators import steps
from benchloom.operators.grids import Mapping


def with_manual(table: DataFrame, manual: DataFrame) -> DataFrame:
    """Derived steps and those set by hand (step_id, label, start, end), with ``manual``; all in order of their starts."""
    own = table.withColumn("manual", F.lit(False))
    return own.unionByName(manual.withColumn("manual", F.lit(True)), allowMissingColumns=True).orderBy("start", "step_id")


def with_overrides(windows: DataFrame, overrides: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Windows (step_id, label, window, low, high) with those set by hand in their place, and what no longer fits.

    Overrides: step_id, window, label, low, high. A problem has step_id, window and problem: no step of this id, no window
    of this name, or another label than the override was made for (which still holds).
    """
    o = overrides.select("step_id", "window", F.col("label").alias("__label"), F.least("low", "high").alias("__low"), F.greatest("low", "high").alias("__high"))
    met = windows.join(o, ["step_id", "window"], "left")
    by_hand = F.col("__low").isNotNull()
    out = met.withColumn("low", F.when(by_hand, F.col("__low")).otherwise(F.col("low"))).withColumn("high", F.when(by_hand, F.col("__high")).otherwise(F.col("high"))).withColumn("by_hand", by_hand)
    labels = windows.select("step_id", F.col("label").alias("__now")).distinct()
    found = o.join(labels.withColumn("__there", F.lit(True)), "step_id", "left")
    what = F.when(F.col("__there").isNull(), "no such step").when(~F.col("window").isin(names), "no such window").when((F.col("__label") != "") & (F.col("__label") != F.col("__now")), F.concat(F.lit("set on step "), F.col("__label"), F.lit(", which is now "), F.col("__now")))
    problems = found.withColumn("problem", what).filter("problem is not null").select("step_id", "window", "problem")
    return out.drop("__label", "__low", "__high"), problems


def relinked(overrides: DataFrame, table: DataFrame, tolerance_s: float = 1.0) -> DataFrame:
    """Overrides (step_id, window, label, step_start, …) with the id of the one step that now has their label and start.

    Those whose own step still fits, that fit several steps or none, or whose new place is taken, keep their id. Starts
    meet in buckets of the tolerance, so nothing is paired beyond neighbours.
    """
    now = table.select(F.col("step_id").alias("__id"), F.col("label").alias("__label"), F.col("start").alias("__start"))
    near = now.withColumn("__b", F.explode(F.array(*[F.floor(F.col("__start") / tolerance_s) + k for k in (-1, 0, 1)])))
    asked = overrides.withColumn("__b", F.floor(F.col("step_start") / tolerance_s))
    hit = (F.col("label") == F.col("__label")) & (F.abs(F.col("step_start") - F.col("__start")) <= tolerance_s)
    met = asked.join(near.withColumnRenamed("__b", "__c"), (F.col("__b") == F.col("__c")) & hit, "left")
    met = met.groupBy(*overrides.columns).agg(F.count("__id").alias("__n"), F.max("__id").alias("__new"), F.max(F.coalesce(F.col("__id") == F.col("step_id"), F.lit(False))).alias("__fits"))
    moved = (F.col("__n") == 1) & ~F.col("__fits")
    met = met.withColumn("__to", F.when(moved, F.col("__new")).otherwise(F.col("step_id")))
    taken = F.count("*").over(Window.partitionBy("__to", "window")) > 1
    return met.withColumn("__taken", taken).withColumn("step_id", F.when(F.col("__taken"), F.col("step_id")).otherwise(F.col("__to"))).select(*overrides.columns)


def named_windows(table: DataFrame, by: list[str], windows: dict[str, dict]) -> DataFrame:
    """step_id, window, low, high of every named window: a rule's skip_start, skip_end, keep, at_end; ``class`` limits it to a class,
    ``until`` (a class) ends it where the next step of that class starts, at most ``cap`` seconds after its own start."""
    parts = []
    for name, rule in windows.items():
        df, end = table, F.col("end")
        if until := rule.get("until"):
            cap = F.col("start") + float(rule["cap"]) if rule.get("cap") else None
            w = Window.partitionBy(*by).orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
            df = df.withColumn("__next", F.last(F.when(F.col("class") == until, F.col("start")), ignorenulls=True).over(w))
            end = F.coalesce(F.least("__next", cap) if cap is not None else F.col("__next"), F.col("end"))
        if rule.get("class"):
            df = df.filter(F.col("class") == rule["class"])
        low, high = steps.window_rule(F.col("start"), end, rule.get("skip_start", 0.0), rule.get("skip_end", 0.0), rule.get("keep"), rule.get("at_end", True))
        parts.append(df.select("step_id", F.lit(name).alias("window"), low.alias("low"), high.alias("high")).filter("low is not null"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def typed_parameters(table: DataFrame, params: list[str], cells: str = "params", decimal: str = ".") -> DataFrame:
    """The cells of a map as columns: numbers where all filled ones are, else texts; the map stays."""
    value = {p: F.col(cells)[p] for p in params}
    filled = {p: (v.isNotNull() & (F.trim(v) != "")) for p, v in value.items()}
    one = table.agg(*[(F.count_if(filled[p]) == F.count_if(filled[p] & typing.parse_number(value[p], decimal).isNotNull())).alias(p) for p in params]).first()
    return table.select("*", *[(typing.parse_number(value[p], decimal) if one[p] else F.when(filled[p], value[p])).alias(p) for p in params])


def looked_up(table: DataFrame, rows: DataFrame, by: list[str], tolerance_s: float, values: list[str]) -> DataFrame:
    """Steps with values of the nearest row (row_id, time) of another table, each row taken once; null without one in reach."""
    claims = steps.claim_rows(table.select(*by, "step_id", "start"), rows.select(*by, "row_id", "time"), by, tolerance_s).select("step_id", "row_id")
    found = claims.join(rows.select("row_id", *values), "row_id")
    return table.join(found, "step_id", "left")


def steps_from_table(df: DataFrame, by: list[str], row: str, start: str, end: str | None, day: Column, label: str | None = None) -> DataFrame:
    """A table of cells as steps: row, step_id, label (filled down), start, end (seconds), status, reason.

    Cells are clock times on ``day``, serial numbers or date-times; an end before its start is on the next day. Steps of one
    start follow each other in the order of their rows.
    """
    at = lambda c: F.unix_micros(times.cell_datetime(F.col(c), day)) / 1e6
    out = df.withColumn("__s", at(start)).withColumn("__e", at(end) if end else F.lit(None).cast("double"))
    out = out.withColumn("__e", F.when(F.col("__e") < F.col("__s"), F.col("__e") + 86400.0).otherwise(F.col("__e")))
    out = steps.end_rule(out.filter("__s is not null"), by, "__s", "__e", row=row)
    name = steps.fill_down("__label", by, row) if label else F.lit(None).cast("string")
    text = df.withColumn("__label", F.when(F.trim(F.col(label)) != "", F.trim(F.col(label)))) if label else df
    named = text.select(*by, F.col(row).alias("__row"), F.col(row), *([F.col("__label")] if label else []), F.col(start)).withColumn("label", name)
    met = named.join(out.select(*by, F.col(row).alias("__row"), "__s", "step_end"), [*by, "__row"], "left")
    reason = F.when(F.coalesce(F.trim(F.col(start)), F.lit("")) == "", "no start").when(F.col("__s").isNull(), "start is no time").when(F.col("step_end").isNull(), "no end")
    return met.select(*by, F.col("__row").alias(row), "label", F.col("__s").alias("start"), F.col("step_end").alias("end"), F.when(reason.isNull(), "step").otherwise("excluded").alias("status"), reason.alias("reason"))


def column_shapes(df: DataFrame, time: str | None) -> DataFrame:
    """column, rows, filled, clocks (cells that read as times), kinds (distinct values): what guessing goes by, in one pass."""
    rows = df.filter(F.col(time).isNotNull()) if time else df
    columns = [c for c in df.columns if c != time]
    text = {c: F.trim(F.col(c).cast("string")) for c in columns}
    clock = {c: times.clock_seconds(F.when(t.rlike("^[0-9]{1,2}:[0-5][0-9]$"), F.concat(t, F.lit(":00"))).otherwise(t)).isNotNull() | times.parse_datetime(t).isNotNull() for c, t in text.items()}
    one = rows.agg(*[F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(text[c] != "").alias("filled"), F.count_if(clock[c]).alias("clocks"), F.count_distinct(F.when(text[c] != "", text[c])).alias("kinds")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("s")).select("s.*")


def guessed_mapping(df: DataFrame, time: str | None, texts: list[str], channels: list[str]) -> Mapping:
    """Roles of a step table's columns by the shape of their cells, never by their names.

    The first text column of times, filled in at least 80 % of the rows, is the end; the leftmost other text column filled in less
    than half of them, else the leftmost, is the label; up to three numeric columns with few values are set points.
    """
    shape = {r.column: r for r in column_shapes(df, time).collect()}  # one row per column
    text = [c for c in texts if c != time and shape[c].filled]
    ends = [c for c in text if shape[c].clocks == shape[c].filled >= 0.8 * shape[c].rows]
    labels = [c for c in text if not shape[c].clocks]
    sparse = [c for c in labels if shape[c].filled < 0.5 * shape[c].rows]
    params = [c for c in channels if 1 < shape[c].kinds <= max(3, shape[c].rows // 3)][:3]
    return Mapping(start=time or "", end=ends[0] if ends else None, label=(sparse or labels or [None])[0], params={c: c for c in params})
