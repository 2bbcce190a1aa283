"""Columns of JSON text and other structured cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_keys(df: DataFrame, column: str) -> list[str]:
    """The keys of a column of JSON objects, sorted: names of columns, so a small list."""
    keys = df.select(F.explode(F.map_keys(F.from_json(F.col(column), "map<string,string>"))).alias("k")).distinct()
    return sorted(r.k for r in keys.collect())


def split_json(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """One text column per key, the JSON column stays; a key whose name is taken becomes ``<column>_<key>``."""
    keys = json_keys(df, column) if keys is None else keys
    parsed = F.from_json(F.col(column), "map<string,string>")
    return df.select("*", *[parsed.getItem(k).alias(f"{column}_{k}" if k in df.columns else k) for k in keys])


def invalid_json(df: DataFrame, column: str) -> DataFrame:
    """How many cells hold text that is no JSON object."""
    bad = F.col(column).isNotNull() & F.from_json(F.col(column), "map<string,string>").isNull()
    return df.agg(F.count_if(bad).alias("invalid"))
