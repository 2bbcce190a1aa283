"""What the operators share: the shared folder, Arrow batches cut by bytes, vectorised words and shingles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step handles; its working memory is about 40 times that.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch sent to a Python worker, unless the session's own bound is lower.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of Arrow batches: by default 64 MB, which buffers of the JVM hold several times."""
    bound = spark.conf.get(_BATCH_CONF, "64m")
    size = int(bound.rstrip("bkmg")) << {"k": 10, "m": 20, "g": 30}.get(bound.rstrip("b")[-1:], 0)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def free_names(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores as keep it apart from ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def free_prefix(columns: list[str]) -> str:
    """Underscores that no name of ``columns`` begins with."""
    return "_" * (2 + max((len(c) - len(c.lstrip("_")) for c in columns), default=0))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir. In local mode one is set here where none is; on a cluster that raises."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names the folder that executors share; it is not set")
        path = tempfile.mkdtemp(prefix="benchloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder."""
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def remove_written(spark: SparkSession) -> int:
    """Deletes what this process wrote to the shared folder so far and returns how many folders; results that read them must be stored first."""
    hadoop, n = spark._jvm.org.apache.hadoop.fs, 0
    while _written:
        at = hadoop.Path(_written.pop())
        n += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
    return n


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there and each later use reads files."""
    spark = df.sparkSession
    bound_batches(spark)
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``limit`` bytes of text (one row at least): rows, bytes, row offsets. Nulls are empty."""
    at = batch.schema.get_field_index(column)
    texts = batch.column(at).cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(CHUNK_BYTES + 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        p, q = np.full(n, _STEP, np.uint64), np.full(n, inverse, np.uint64)
        p[:1] = q[:1] = 1
        return np.multiply.accumulate(p), np.multiply.accumulate(q)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64; a worker keeps those for a chunk, longer texts make their own."""
    if n > CHUNK_BYTES + 1:
        return _powers(n)
    p, q = _kept_powers()
    return p[:n], q[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of rows of bytes, A-Z lower-cased: 64-bit hash, start, end, and words before each row.

    ``gaps`` has for each byte whether it separates words.
    """
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64)
    solid = ~gaps[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins[inner] |= solid[inner]
    ends[inner - 1] |= solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        p, q = _power_table(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
        h = mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64) * _ODD)
    return h, start, end, np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, before: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of each row, the row and first word of each.

    A row with fewer words gives its whole sequence as one shingle if ``short``, else none; without words it gives none.
    """
    counts = np.diff(before)
    rows = len(counts)
    with np.errstate(over="ignore"):
        full = np.maximum(counts - k + 1, 0)
        row = np.repeat(np.arange(rows), full)
        first = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full) + np.repeat(before[:-1], full)
        h = np.zeros(len(row), np.uint64)
        for i in range(k):
            h = mix(h + words[first + i] * _ODD + np.uint64(i + 1))
        if short and (few := np.flatnonzero((counts > 0) & (counts < k))).size:
            more = np.zeros(len(few), np.uint64)
            for i in range(k - 1):
                here = counts[few] > i
                more[here] = mix(more[here] + words[before[few[here]] + i] * _ODD + np.uint64(i + 1))
            row, first, h = np.concatenate([row, few]), np.concatenate([first, before[few]]), np.concatenate([h, mix(more + counts[few].astype(np.uint64))])
            order = np.argsort(row, kind="stable")
            row, first, h = row[order], first[order], h[order]
    return h, row, first


def distinct_by_row(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, sorted by both."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]
