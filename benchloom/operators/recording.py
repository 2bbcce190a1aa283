"""What a recording is: a table with an order inside sources, runs inside sources, a time and channels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Recording:
    """Names of the parts of a table. Rows are ordered by ``row`` inside ``source``; ``time`` counts microseconds.

    Every window is partitioned by source, at least, so that no operator gathers a table in one task.
    """

    df: DataFrame
    source: tuple[str, ...]
    run: tuple[str, ...]
    row: str
    time: str
    channels: tuple[str, ...]

    def with_df(self, df: DataFrame) -> "Recording":
        return Recording(df, self.source, self.run, self.row, self.time, self.channels)

    def narrow(self, *channels: str) -> "Recording":
        """With these channels alone: what is kept or read by Python carries no column that no one reads."""
        df = self.df.select(*dict.fromkeys([*self.source, *self.run, self.row, self.time, *channels]))
        return Recording(df, self.source, self.run, self.row, self.time, channels)

    @property
    def keys(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.source, *self.run)))

    def in_source(self) -> WindowSpec:
        return Window.partitionBy(*self.source).orderBy(self.row)

    def in_run(self, *more: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *more).orderBy(self.row)


BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, 0)


def quantile_nearest(c: Column, q: float) -> Column:
    """The element of nearest rank, halves up, of an aggregate's non-null values."""
    values = F.sort_array(F.collect_list(c))
    return F.get(values, F.floor((F.size(values) - 1) * q + 0.5).cast("int"))
