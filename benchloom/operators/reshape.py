"""Names, wide and long forms, merging of overlapping tables, footers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Letters replaced in names, and words of exports that go.
LETTERS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "Ä": "ae", "Ö": "oe", "Ü": "ue"}
EXPORT_WORDS = ("letzte", "last", "wert", "value", "aktuell")
_TOKEN = re.compile(r"[(\[{](?P<inner>[^)\]}]*)[)\]}]|(?P<word>\w+)")


def clean_name(name: str, index: int = 0) -> str:
    """Snake case, from a name's words: units in brackets are none, numbers in brackets are, words of exports go, umlauts become letters.

    What is empty then is called ``time`` in the first place, else by its place.
    """
    words = []
    for m in _TOKEN.finditer(name):
        text = m["word"] if m["word"] is not None else m["inner"].strip() if m["inner"].strip().isdecimal() else ""
        if text and text.lower() not in EXPORT_WORDS:
            words += re.findall("[a-z0-9]+", "".join(LETTERS.get(c, c) for c in text).lower())
    return "_".join(words) or ("time" if index == 0 else f"col_{index}")


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get _1, _2, …"""
    out, taken = [], set()
    for n in names:
        new, i = n, 0
        while new in taken:
            i += 1
            new = f"{n}_{i}"
        taken.add(new)
        out.append(new)
    return out


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names([clean_name(c, i) for i, c in enumerate(df.columns)]))


def clean_value(c: Column) -> Column:
    """clean_name for a column of names: its words are taken out, judged and joined."""
    tokens = F.regexp_extract_all(c, F.lit(r"[(\[{][^)\]}]*[)\]}]|[\p{L}\p{N}_]+"), F.lit(0))
    inner = lambda t: F.trim(F.substring(t, F.lit(2), F.length(t) - 2))
    word = F.transform(tokens, lambda t: F.when(~t.rlike(r"^[(\[{]"), t).when(inner(t).rlike("^[0-9]+$"), inner(t)).otherwise(""))
    s = F.array_join(F.filter(word, lambda w: (w != "") & ~F.lower(w).isin(*EXPORT_WORDS)), "_")
    for letter, by in LETTERS.items():
        s = F.replace(s, F.lit(letter), F.lit(by))
    return F.array_join(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), F.lit(0)), "_")


def unpivot(df: DataFrame, ids: list[str], values: list[str] | None = None, variable: str = "variable", value: str = "value") -> DataFrame:
    """Long form; without ``values`` all columns that are no ids, as far as they are numbers."""
    values = values or [f.name for f in df.schema if f.name not in ids and f.dataType.typeName() in ("double", "float", "integer", "long", "decimal")]
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(ids, values, variable, value)


def pivot_first(df: DataFrame, index: list[str], variable: str, value: str, names: list[str], row: str) -> DataFrame:
    """Wide form: the value of the smallest ``row`` per index and variable; rows without a variable go."""
    return df.filter(F.col(variable).isNotNull()).groupBy(*index).pivot(variable, names).agg(F.min_by(value, row))


def long_duplicates(df: DataFrame, index: list[str], variable: str, row: str) -> DataFrame:
    """Rows that repeat an index and variable, but the first."""
    w = Window.partitionBy(*index, variable).orderBy(row)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n > 1").drop("__n")


def channel_attributes(df: DataFrame, variable: str, attribute: str, row: str) -> DataFrame:
    """The first value of an attribute of each variable, and whether it has several."""
    return df.groupBy(variable).agg(F.min_by(attribute, F.when(F.col(attribute).isNotNull(), F.col(row))).alias(attribute), (F.count_distinct(attribute) > 1).alias("ambiguous"))


def drop_footer(df: DataFrame, source: list[str], row: str, channels: list[str], everywhere: bool = False) -> DataFrame:
    """Without the rows at a source's end (or all) whose channels are all null, not a number or blank."""
    empty = reduce(lambda a, b: a & b, [F.col(c).isNull() | (F.trim(F.col(c).cast("string")).isin("", "NaN")) for c in channels])
    if everywhere:
        return df.filter(~empty)
    last = F.max(F.when(~empty, F.col(row))).over(Window.partitionBy(*source))
    return df.withColumn("__last", last).filter(F.col(row) <= F.col("__last")).drop("__last")


def newest_wins(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """All rows of tables in order, columns by name, with ``source_no``; of rows with equal keys those of the last table stay.

    Rows of one table with equal keys all stay, and so do rows with a null in the key.
    """
    both = _numbered(parts)
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    newest = F.max("source_no").over(Window.partitionBy(*key))
    return both.withColumn("__new", newest).filter(no_key | (F.col("source_no") == F.col("__new"))).drop("__new")


def _numbered(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("source_no", F.lit(i)) for i, p in enumerate(parts)])


def merge_conflicts(parts: list[DataFrame], key: list[str], columns: list[str]) -> DataFrame:
    """key, column, old, new, source_no: values of replaced rows that the newest row has not; a value that was null is none."""
    both = _numbered(parts)
    w = Window.partitionBy(*key)
    both = both.withColumn("__new", F.max("source_no").over(w)).filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]))
    winner = both.filter(F.col("source_no") == F.col("__new")).groupBy(*key).agg(*[F.first(c).alias(f"__{c}") for c in columns])
    loser = both.filter(F.col("source_no") < F.col("__new"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("old"), F.col(f"__{c}").cast("string").alias("new")) for c in columns])
    rows = loser.join(winner, key).select(*key, "source_no", F.explode(pairs).alias("p")).select(*key, "p.*", "source_no")
    return rows.filter(F.col("old").isNotNull() & ~F.col("old").eqNullSafe(F.col("new")))


def merge_sources(parts: list[DataFrame], key: list[str], columns: list[str]) -> DataFrame:
    """By table: rows read, kept, replaced, and conflicting values."""
    read = _numbered(parts).groupBy("source_no").agg(F.count("*").alias("n_rows"))
    kept = newest_wins(parts, key).groupBy("source_no").agg(F.count("*").alias("n_kept"))
    bad = merge_conflicts(parts, key, columns).groupBy("source_no").agg(F.count("*").alias("n_conflicts"))
    out = read.join(kept, "source_no", "left").join(bad, "source_no", "left").na.fill(0)
    return out.select("source_no", "n_rows", "n_kept", (F.col("n_rows") - F.col("n_kept")).alias("n_replaced"), "n_conflicts")


AGGREGATES = {"mean": F.avg, "median": F.median, "n": F.count, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_samp}


def aggregate(df: DataFrame, rows: str, value: str, how: str, columns: str | None = None, names: list | None = None, where: Column | None = None) -> DataFrame:
    """One aggregate by ``rows``, or by rows and ``columns`` (wide, ``names`` in order)."""
    df = df.filter(where) if where is not None else df
    finite = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    f = AGGREGATES[how](finite)
    grouped = df.groupBy(rows)
    return grouped.pivot(columns, names).agg(f) if columns else grouped.agg(f.alias(f"{value}_{how}"))


def missing_ranges(df: DataFrame, key: str, chunk: int = 1 << 20) -> DataFrame:
    """first, last: ranges of integers between the smallest and largest key that are absent (gaps and islands).

    Keys are ordered inside chunks of values; a chunk's edges meet the next chunk's through one row per chunk.
    """
    keys = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k")).distinct().withColumn("c", F.floor(F.col("k") / chunk))
    inside = keys.withColumn("next", F.lead("k").over(Window.partitionBy("c").orderBy("k"))).filter("next > k + 1").select("k", "next")
    edges = keys.groupBy("c").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    between = edges.withColumn("next", F.lead("low").over(Window.orderBy("c"))).filter("next > high + 1").select(F.col("high").alias("k"), "next")
    return inside.unionByName(between).select((F.col("k") + 1).alias("first"), (F.col("next") - 1).alias("last"))
