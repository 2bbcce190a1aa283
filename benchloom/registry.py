"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.rounding import DIGITS, DOUBLES, rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "quality_summary"


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its DuckDB twin. Doubles are rounded alike in both, -0 becomes 0."""
    doubles = {c: int(n or DIGITS) for c, _, n in (x.partition(":") for x in DOUBLES.get(name, "").split())}

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: rounded(F.col(f"`{c}`"), n) + F.lit(0.0) for c, n in doubles.items()}) if sql and doubles else df

        QUERIES[name] = run
        if sql:
            replaced = ", ".join(f'round(CAST("{c}" AS DOUBLE), {n}) + 0.0 AS "{c}"' for c, n in doubles.items())
            ORACLE_SQL[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if doubles else sql
        return f

    return add


def load() -> None:
    """Import every module that registers queries."""
    from importlib import import_module
    from pkgutil import iter_modules

    from benchloom import plans

    for m in iter_modules(plans.__path__):
        import_module(f"benchloom.plans.{m.name}")
