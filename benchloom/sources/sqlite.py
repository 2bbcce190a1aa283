"""SQLite files as partitioned tables: the file goes to every node, each task reads a range of row ids.

Spark hands the file out from any store it reads. A first pass counts rows and the kinds of values by range, so that types and
row numbers hold for the whole table; the second reads rows in batches. Queries that are no plain table are read by one task,
row after row. The driver sees names of tables and columns and the ends of row ids, never rows.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from benchloom.operators.reshape import unique_names

#: Row ids of a task's range; rows of a batch.
SPLIT_ROWS, BATCH_ROWS = 250_000, 10_000
_ROW = {LongType: (pa.int64(), int), DoubleType: (pa.float64(), float), StringType: (pa.string(), lambda v: v.hex() if isinstance(v, bytes) else str(v))}


def ship(spark: SparkSession, path: str) -> str:
    """The name under which all nodes have the file."""
    spark.sparkContext.addFile(path)
    return path.rstrip("/").rsplit("/", 1)[-1]


def connect(name: str) -> sqlite3.Connection:
    """The node's copy, opened read-only."""
    return sqlite3.connect(f"file:{SparkFiles.get(name)}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(con: sqlite3.Connection) -> list[str]:
    """Tables and views by name."""
    return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') ORDER BY name")]


def _ranges(con: sqlite3.Connection, table: str | None, split_rows: int) -> list[tuple[int | None, int | None]]:
    """Ranges of row ids of about ``split_rows``; one without ends for what has no row ids."""
    try:
        low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone() if table else (None, None)
    except sqlite3.OperationalError:
        low = None
    if not isinstance(low, int):
        return [(None, None)]
    cuts = [*range(low, high + 1, max(split_rows, -(-(high - low + 1) // 100_000))), high + 1]
    return list(zip(cuts, cuts[1:]))


def read(spark: SparkSession, path: str, table: str | None = None, sql: str | None = None, where: str | None = None, numbered: str | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """A table or a query; errors of a query surface, an unknown table names the others.

    ``where``: a condition that SQLite applies; ``numbered``: a first column with the number of each row from 0, by row id.
    Integers are longs, numbers of both kinds doubles, all other columns text (bytes as hexadecimal digits).
    """
    name = ship(spark, path)
    con = connect(name)
    try:
        if sql is None:
            known = tables(con)
            table = table or (known[0] if len(known) == 1 else None)
            if table not in known:
                raise KeyError(f"no table {table!r}; there are {', '.join(known)}")
        source = _quoted(table) if sql is None else f"({sql})"
        columns = [c[0] for c in con.execute(sql or f"SELECT * FROM {source} LIMIT 0").description]
        ranges = _ranges(con, table if sql is None else None, split_rows)
    finally:
        con.close()
    names = unique_names(columns)
    bounds = lambda low: " AND ".join([*([f"({where})"] if where else []), *([] if low is None else ["rowid >= ? AND rowid < ?"])])

    def rows_of(con: sqlite3.Connection, low: int | None, high: int | None) -> sqlite3.Cursor:
        condition = bounds(low)
        plain = sql if sql is not None and not condition else f"SELECT * FROM {source}" + (f" WHERE {condition}" if condition else "") + (" ORDER BY rowid" if low is not None else "")
        return con.execute(plain, () if low is None else (low, high))

    parts = spark.createDataFrame([(i, low, high) for i, (low, high) in enumerate(ranges)], "part int, low long, high long").repartition(len(ranges), "part")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                con, n, kinds = connect(name), 0, [set() for _ in names]
                for row in rows_of(con, r["low"], r["high"]):
                    n += 1
                    for k, v in zip(kinds, row):
                        if v is not None:
                            k.add(type(v).__name__)
                con.close()
                yield pa.record_batch({"part": pa.array([r["part"]], pa.int32()), "n": pa.array([n], pa.int64()), "kinds": pa.array([[",".join(sorted(k)) for k in kinds]], pa.list_(pa.string()))})

    found = sorted(parts.mapInArrow(seen, "part int, n long, kinds array<string>").collect())  # a row a range
    kinds = [set().union(*(set(filter(None, r.kinds[i].split(","))) for r in found)) for i in range(len(names))]
    types = [LongType() if k == {"int"} else DoubleType() if k and k <= {"int", "float"} else StringType() for k in kinds]
    before, start = {}, 0
    for r in found:
        before[r.part], start = start, start + r.n
    first = [StructField(numbered, LongType())] if numbered else []
    schema = StructType([*first, *[StructField(n, t) for n, t in zip(names, types)]])

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                con, at = connect(name), before[r["part"]]
                cursor = rows_of(con, r["low"], r["high"])
                while rows := cursor.fetchmany(BATCH_ROWS):
                    arrays = [pa.array(range(at, at + len(rows)), pa.int64())] if numbered else []
                    for values, t in zip(zip(*rows), types):
                        kind, cast = _ROW[type(t)]
                        arrays.append(pa.array([None if v is None else cast(v) for v in values], kind))
                    yield pa.RecordBatch.from_arrays(arrays, schema.names)
                    at += len(rows)
                con.close()

    return parts.mapInArrow(out, schema)
