"""Level of detail, kept: columns of a channel at widths that grow by a factor, written once, from which a view reads its own level.

A column holds the smallest and largest finite value in it and what joins columns: the first and last row and segment. All of
that adds up, so that a level is made from the one below, which is ``fan_out`` times as large; the raw rows are read once. The
grid is fixed in time and does not move with a view. A column knows its neighbours, so that a view with the column on either
side of it, to which lines go on at its edges, is one filter that Parquet prunes by.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.functions import ieee
from benchloom.operators.chunks import Chunks
from benchloom.operators.recording import Recording

#: Columns of a chunk where neighbours are looked for.
CHUNK_COLUMNS = 1 << 15
NONE_BEFORE, NONE_AFTER = -(1 << 63), (1 << 63) - 1
_ADDS_UP = {"low": F.min, "high": F.max, "n": F.sum, "first_us": F.min, "first_row": F.min, "last_row": F.max, "first_segment": F.min, "last_segment": F.max}


@dataclass(frozen=True)
class Pyramid:
    """A written pyramid: its folder, the source's columns, the origin of the grid and the width of each level."""

    spark: SparkSession
    path: str
    source: tuple[str, ...]
    origin_us: int
    widths_us: tuple[int, ...]

    def level_for(self, start_us: int, end_us: int, columns: int) -> int | None:
        """The coarsest level with at least so many columns in a span; None where the finest has fewer, and rows are to be shown."""
        fit = [k for k, w in enumerate(self.widths_us) if w * max(columns, 1) <= end_us - start_us]
        return max(fit, default=None)

    def view(self, level: int, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
        """source, pixel, at_us, low, high, n, joined of a level: whole, or the columns that meet a span and one on either side.

        ``at_us`` is the time of a column's first sample; ``joined`` whether its last sample and the next column's first are
        neighbouring rows of one segment, and the next column is shown too. A span without samples gives its neighbours.
        """
        df = self.spark.read.parquet(f"{self.path}/columns").filter(F.col("level") == level)
        width = self.widths_us[level]
        joined = F.col("joined")
        if start_us is not None:
            df = df.filter(F.col("after") >= (start_us - self.origin_us) // width)
        if end_us is not None:
            last = (end_us - self.origin_us) // width
            df = df.filter(F.col("before") <= last)
            joined = joined & (F.col("pixel") <= last)
        return df.select(*self.source, "pixel", F.col("first_us").alias("at_us"), "low", "high", "n", joined.alias("joined"))


def _base(rec: Recording, channel: str, origin_us: int, width_us: int, segment: Column) -> DataFrame:
    """The finest columns, of finite values alone; partial sums come before the shuffle, so a hot source is no hot task."""
    value = F.col(channel).cast("double")
    rows = rec.df.filter(ieee.is_finite(value) & F.col(rec.time).isNotNull()).select(
        *rec.source, F.floor((F.col(rec.time) - origin_us) / width_us).alias("pixel"), value.alias("low"), value.alias("high"), F.lit(1).cast("long").alias("n"),
        F.col(rec.time).alias("first_us"), F.col(rec.row).alias("first_row"), F.col(rec.row).alias("last_row"), segment.cast("long").alias("first_segment"), segment.cast("long").alias("last_segment"),
    )
    return rows.groupBy(*rec.source, "pixel").agg(*[f(c).alias(c) for c, f in _ADDS_UP.items()])


def _with_neighbours(cells: DataFrame, source: Sequence[str]) -> DataFrame:
    """Adds ``before`` and ``after`` (the columns next to a column) and ``joined``; a source's columns are many chunks."""
    keys = (*source, "level")
    ahead = Chunks(keys, ("pixel",), F.floor(F.col("pixel") / CHUNK_COLUMNS))
    back = Chunks(keys, ("__back",), F.floor(F.col("__back") / CHUNK_COLUMNS))
    df = ahead.with_lag(cells, {"before": "pixel"}).withColumn("__back", -F.col("pixel"))
    df = back.with_lag(df, {"after": "pixel", "__row": "first_row", "__segment": "first_segment"})
    joined = F.coalesce((F.col("__row") == F.col("last_row") + 1) & F.col("__segment").eqNullSafe(F.col("last_segment")), F.lit(False))
    df = df.withColumns({"joined": joined, "before": F.coalesce("before", F.lit(NONE_BEFORE)), "after": F.coalesce("after", F.lit(NONE_AFTER))})
    return df.drop("__back", "__row", "__segment", "first_row", "last_row", "first_segment", "last_segment")


def build(rec: Recording, channel: str, path: str, origin_us: int, width_us: int, fan_out: int = 4, segment: str | None = None, coarsest: int = 256) -> Pyramid:
    """Writes the pyramid of a channel into ``path`` (a folder that executors share) and gives it.

    Rows are numbered one by one in their source, in order of time. ``segment`` never falls along a source; lines break where it
    changes, and where rows without a finite value lie between. Levels are added until no source has over ``coarsest`` columns'
    length. A table without finite values has one empty level. Each level is written before the next one is made of it.
    """
    if width_us < 1 or fan_out < 2:
        raise ValueError(f"width {width_us} and fan-out {fan_out}: at least 1 and 2 are needed")
    spark = rec.df.sparkSession
    cells = _base(rec, channel, origin_us, width_us, F.col(segment) if segment else F.lit(0))
    widths = [width_us]
    while True:
        place = f"{path}/parts/level={len(widths) - 1}"
        cells.write.mode("overwrite").parquet(place)
        cells = spark.read.parquet(place)
        reach = cells.groupBy(*rec.source).agg((F.max("pixel") - F.min("pixel")).alias("d")).agg(F.max("d")).first()[0]
        if reach is None or reach < coarsest:
            break
        up = cells.withColumn("pixel", F.floor(F.col("pixel") / fan_out))
        cells = up.groupBy(*rec.source, "pixel").agg(*[f(c).alias(c) for c, f in _ADDS_UP.items()])
        widths.append(widths[-1] * fan_out)
    schema = spark.read.parquet(f"{path}/parts/level=0").schema.add("level", "integer")
    parts = spark.read.schema(schema).parquet(f"{path}/parts")
    near = _with_neighbours(parts, rec.source)
    # Unique keys: ranges are even whatever the sizes of sources are, and files hold few pixels of few sources.
    order = ["level", *rec.source, "pixel"]
    near.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("level").parquet(f"{path}/columns")
    if reach is None:
        # No column: the folder still has a table.
        near.limit(0).withColumn("level", F.col("level").cast("int")).write.mode("overwrite").parquet(f"{path}/columns")
    about = [(k, w, int(origin_us), list(rec.source)) for k, w in enumerate(widths)]
    spark.createDataFrame(about, "level int, width_us long, origin_us long, source array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/levels")
    return Pyramid(spark, path, tuple(rec.source), int(origin_us), tuple(widths))


def open_pyramid(spark: SparkSession, path: str) -> Pyramid:
    """A pyramid that was written before."""
    levels = spark.read.parquet(f"{path}/levels").orderBy("level").collect()
    return Pyramid(spark, path, tuple(levels[0].source), levels[0].origin_us, tuple(x.width_us for x in levels))
