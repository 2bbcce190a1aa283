"""Groups read in order: one sorted pass over partitions, many small groups in one batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType


def map_groups(df: DataFrame, keys: list[str], order: list[str], f: Callable[[dict[str, np.ndarray]], dict[str, list]], schema: StructType | str) -> DataFrame:
    """``f`` of the rows of each group, as arrays by column in ``order``; the keys of a group precede what it returns.

    A group's rows are together in one task, groups of a partition follow each other: what a task holds is one group and
    one batch. Nulls of numbers come as NaN.
    """

    kinds = {f.name: to_arrow_type(f.dataType) for f in (StructType.fromDDL(schema) if isinstance(schema, str) else schema)}

    def applied(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch, of, out = _by_group(held, keys, f)
        own = batch.take(pa.array(np.array(of, np.int64)))
        return pa.RecordBatch.from_arrays([*[own.column(k) for k in keys], *[pa.array(out.get(c, []), t) for c, t in kinds.items() if c not in keys]], [*keys, *[c for c in kinds if c not in keys]])

    return _together(df, keys).sortWithinPartitions(*keys, *order).mapInArrow(lambda batches: _runs(batches, keys, applied), schema)


def add_by_group(df: DataFrame, keys: list[str], order: list[str], used: list[str], f: Callable[[dict[str, np.ndarray]], list], out: str, kind: DataType) -> DataFrame:
    """``df`` with ``out``: the values that ``f`` gives for the rows of each group, read in ``order``; ``f`` gets the columns ``used``."""
    arrow = to_arrow_type(kind)

    def applied(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch, _, values = _by_group(held, keys, lambda rows: {out: f(rows)}, used)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values[out], arrow)], [*batch.schema.names, out])

    schema = StructType([*df.schema.fields, StructField(out, kind)])
    return _together(df, keys).sortWithinPartitions(*keys, *order).mapInArrow(lambda batches: _runs(batches, keys, applied), schema)


def _together(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys) if keys else df.coalesce(1)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], applied: Callable[[list[pa.RecordBatch]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``applied`` to runs of whole groups, as soon as a group's last row has come."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = _starts(batch, keys)
        if held and not _same(held[-1], batch, keys):
            yield applied(held)
            held = []
        if fresh[-1]:
            held.append(batch.slice(0, fresh[-1]))
            yield applied(held)
            held = []
        held.append(batch.slice(fresh[-1]))
    if held:
        yield applied(held)


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Places at which a group begins."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in keys:
        codes = batch.column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return all(a.column(k)[-1].as_py() == b.column(k)[0].as_py() for k in keys)


def _by_group(held: list[pa.RecordBatch], keys: list[str], f, used: list[str] | None = None) -> tuple[pa.RecordBatch, list[int], dict[str, list]]:
    """The rows as one batch, the first row of the group of each value, and the values by name."""
    batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    arrays = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (used or batch.schema.names) if c not in keys}
    starts = _starts(batch, keys)
    of, out = [], {}
    for low, high in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        found = f({c: v[low:high] for c, v in arrays.items()})
        for c, values in found.items():
            out.setdefault(c, []).extend(values)
        of += [low] * len(next(iter(found.values()), []))
    return batch, of, out
