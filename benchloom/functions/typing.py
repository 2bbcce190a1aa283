"""Text cells to typed values, with a reason for every cell that is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for a missing value.
SENTINELS = ("", "NA", "N/A", "null", "NULL", "NaN", "None", "-999", "ERR", "#N/A", "#VALUE!", "nan", "NAN", "error", "ERROR", "undef", "UNDEF", "overflow", "OVERFLOW", "#DIV/0!", "#REF!", "#NAME?", "#NUM!", "#NULL!")
_PLAIN = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_WORDS = r"(?i)^[+-]?(?:inf|infinity|nan)$"


def parse_number(c: Column, decimal: str = ".") -> Column:
    """A double, or null: plain numbers, and with a decimal comma thousands points; nothing that merely begins with digits."""
    s = F.trim(c)
    if decimal == ",":
        grouped = s.rlike(r"^[+-]?[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?$")
        s = F.when(grouped, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit(".")))
    else:
        grouped = s.rlike(r"^[+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?$")
        s = F.when(grouped, F.replace(s, F.lit(","), F.lit(""))).otherwise(s)
    return F.when(s.rlike(_PLAIN) | s.rlike(_WORDS), s.try_cast("double"))


def is_sentinel(c: Column) -> Column:
    """Whether a cell is one of the words, as it stands or in capitals."""
    return F.trim(c).isin(*SENTINELS) | F.upper(F.trim(c)).isin(*SENTINELS)


def number_cell(c: Column, decimal: str = ".") -> Column:
    """struct(value, reason): the reason is null, sentinel_value or non_convertible_float."""
    value = parse_number(c, decimal)
    reason = F.when(c.isNull() | (F.trim(c) == ""), F.lit(None)).when(is_sentinel(c), F.lit("sentinel_value")).when(value.isNull(), F.lit("non_convertible_float"))
    return F.struct(F.when(~is_sentinel(c), value).alias("value"), reason.alias("reason"))


def integer_cell(c: Column) -> Column:
    """struct(value, reason): whole numbers, also written as 12.0."""
    s = F.trim(c)
    value = F.when(s.rlike(r"^[+-]?[0-9]{1,18}(?:\.0*)?$"), F.regexp_replace(s, r"\.0*$", "").try_cast("long"))
    reason = F.when(c.isNull() | (s == ""), F.lit(None)).when(is_sentinel(c), F.lit("sentinel_value")).when(value.isNull(), F.lit("non_convertible_int"))
    return F.struct(F.when(~is_sentinel(c), value).alias("value"), reason.alias("reason"))


def audit(df: DataFrame, row: str, cells: dict[str, Column]) -> DataFrame:
    """row, column, raw_value, reason: one row for each cell with a reason; ``cells`` maps columns to cell structs."""
    parts = F.array(*[F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").cast("string").alias("raw_value"), cell["reason"].alias("reason")) for name, cell in cells.items()])
    return df.select(row, F.explode(parts).alias("a")).select(row, "a.*").filter("reason is not null")


def column_kinds(df: DataFrame, columns: list[str], id_tokens: tuple[str, ...] = ("id", "key", "run", "number"), ratio: float = 0.5, decimal: str = ".") -> DataFrame:
    """column, filled, numeric, whole, kind: all from one pass over the table."""
    sums = []
    for c in columns:
        col = F.col(f"`{c}`").cast("string")
        real = col.isNotNull() & ~is_sentinel(col)
        sums.append(F.struct(F.lit(c).alias("column"), F.count_if(real).alias("filled"), F.count_if(real & parse_number(col, decimal).isNotNull()).alias("numeric"), F.count_if(real & col.rlike(r"^\s*[+-]?[0-9]+\s*$")).alias("whole")).alias(c))
    one = df.agg(*[s for s in sums])
    rows = one.select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("s")).select("s.*")
    is_id = F.arrays_overlap(F.split(F.regexp_replace(F.lower("column"), "[^a-z0-9]+", "_"), "_"), F.array(*[F.lit(t) for t in id_tokens]))
    kind = F.when(F.col("filled") == 0, "numeric").when(is_id & (F.col("whole") == F.col("filled")), "identifier").when(F.col("numeric") >= ratio * F.col("filled"), "numeric").otherwise("categorical")
    return rows.withColumn("kind", kind)
