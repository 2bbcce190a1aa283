"""Lines of a file, or of a folder's files in the order of their names as one text, numbered in all splits at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """value, row_index: the lines, counted from 0; a first pass counts those of each split, one row a split.

    Spark deals splits by size, and a task may hold several of them, each a range of the task's rows; they are put in the order of
    file names and of places within a file. A task's lines of one split follow one another.
    """
    lines = spark.read.option("encoding", encoding).text(path).select("value", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i"), F.input_file_name().alias("__file"), F.input_file_block_start().alias("__at"))
    counts = lines.groupBy("__p", "__file", "__at").agg(F.count("*").alias("__n"), F.min("__i").alias("__low"))
    name = F.url_decode(F.replace(F.element_at(F.split("__file", "/"), -1), F.lit("+"), F.lit("%2B")))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(name, "__file", "__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("__p").alias("__q"), "__low", (F.col("__low") + F.col("__n")).alias("__high"), (before - F.col("__low")).alias("__shift"))
    own = (F.col("__p") == F.col("__q")) & (F.col("__i") >= F.col("__low")) & (F.col("__i") < F.col("__high"))
    return lines.select("value", "__p", "__i").join(F.broadcast(starts), own).select("value", (F.col("__i") + F.col("__shift")).alias("row_index"))
