"""Windows over sources of any length: chunk and carry.

A source is cut into chunks of its order; Spark's windows run within chunks, a small summary of each chunk (its count, last
row, last value) goes through a window over the summaries of a source, and what that carries is joined back. So a single
source with all rows runs in as many tasks as it has chunks. The chunk of a row is a function of the row alone, so that
nothing has to be written or sampled to place it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a chunk where order is a row number.
CHUNK_ROWS = 1 << 17
BEFORE = (Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class Chunks:
    """Groups (``keys``) in the order of ``order``, cut by ``chunk``: an expression that never falls along that order."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunk: Column

    @property
    def local(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "__chunk").orderBy(*self.order)

    def _carried(self, df: DataFrame, summary: dict[str, Column], over: dict[str, Column]) -> DataFrame:
        """``df`` (with ``__chunk``) and what the chunks before a row's chunk leave: ``summary`` by chunk, ``over`` their window."""
        chunks = df.groupBy(*self.keys, "__chunk").agg(*[c.alias(n) for n, c in summary.items()])
        w = Window.partitionBy(*self.keys).orderBy("__chunk").rowsBetween(*BEFORE)
        carried = chunks.select(*[F.col(k).alias(f"__{k}") for k in self.keys], F.col("__chunk").alias("__of"), *[c.over(w).alias(n) for n, c in over.items()])
        on = F.col("__chunk") == F.col("__of")
        for k in self.keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return df.join(carried, on, "left").drop("__of", *[f"__{k}" for k in self.keys])

    def with_lag(self, df: DataFrame, columns: dict[str, str | Column], ignore_nulls: bool = False) -> DataFrame:
        """Adds, by name, the value of a column in the row before (``ignore_nulls``: the last value before that is not null)."""
        inner = {f"__v{i}": c if isinstance(c, Column) else F.col(c) for i, c in enumerate(columns.values())}
        df = df.withColumn("__chunk", self.chunk).withColumns(inner)
        at = F.struct(*self.order)
        last = {f"__c{i}": F.max_by(F.struct(v), F.when(F.col(v).isNotNull(), at) if ignore_nulls else at) for i, v in enumerate(inner)}
        df = self._carried(df, last, {f"__c{i}": F.last(f"__c{i}", ignorenulls=True) for i in range(len(inner))})
        for i, (name, v) in enumerate(zip(columns, inner)):
            if ignore_nulls:
                value = F.coalesce(F.last(v, ignorenulls=True).over(self.local.rowsBetween(*BEFORE)), F.col(f"__c{i}")[v])
            else:
                value = F.when(F.row_number().over(self.local) == 1, F.col(f"__c{i}")[v]).otherwise(F.lag(v).over(self.local))
            df = df.withColumn(name, value)
        return df.drop("__chunk", *inner, *last)

    def with_running_sum(self, df: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
        """Adds, by name, the sum of a column over the rows up to and with each row."""
        inner = {f"__v{i}": c if isinstance(c, Column) else F.col(c) for i, c in enumerate(columns.values())}
        df = df.withColumn("__chunk", self.chunk).withColumns(inner)
        df = self._carried(df, {f"__c{i}": F.sum(v) for i, v in enumerate(inner)}, {f"__c{i}": F.sum(f"__c{i}") for i in range(len(inner))})
        so_far = self.local.rowsBetween(Window.unboundedPreceding, 0)
        zero = lambda c: F.coalesce(c, F.lit(0))
        for i, (name, v) in enumerate(zip(columns, inner)):
            df = df.withColumn(name, zero(F.sum(v).over(so_far)) + zero(F.col(f"__c{i}")))
        return df.drop("__chunk", *inner, *[f"__c{i}" for i in range(len(inner))])


def by_row(keys: tuple[str, ...], row: str, size: int | None = None) -> Chunks:
    """Groups in the order of a row number."""
    return Chunks(tuple(keys), (row,), F.floor(F.col(row) / (size or CHUNK_ROWS)))


def by_time(keys: tuple[str, ...], time: str, *ties: str, width: int = 3600 * 10**6) -> Chunks:
    """Groups in the order of a time in microseconds, cut every ``width``."""
    return Chunks(tuple(keys), (time, *ties), F.floor(F.col(time) / width))


def numbered(df: DataFrame, chunks: Chunks, name: str) -> DataFrame:
    """Adds the number, from 0, of each row in its group."""
    return chunks.with_running_sum(df, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)
