"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by size (powers of two of their shingle count). Every item gets a bottom sketch, its ``r``
smallest shingle hashes, with ``r`` fixed by the partition so that a text holding the share ``threshold`` of any item of
that size holds at least one sketch hash: it can miss at most n - ceil(threshold·n) shingles, and r is one more. The search
therefore loses nothing. Documents stream through one vectorised pass each against the sketches, which are sent in blocks
of bounded size; what a probe finds is counted exactly on the shingles themselves. Documents are not shuffled or cut.

Shingles: five words, split at ASCII white space, A-Z lower-cased; a text of fewer words is one shingle, so such an item is
found in documents that equal it. Defined results: items without words are found nowhere, documents without words (null,
empty) hold nothing; repeated rows and items are each reported; other columns stay (a column named like the result is
replaced); without items, or documents, all lists (or the table) are empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from benchloom.llm.common import bound_batches, free_names, shingle_hashes, text_chunks, word_hashes

#: Shingles of items in one block, which bounds what is sent to the executors at once (about 100 bytes each).
BLOCK = 400_000
#: Blocks that one pass over the texts looks up.
TOGETHER = 4
_BITS = 20


def shingle_texts(text: bytes, k: int) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, min(len(words), 1)))}


@dataclass
class Index:
    """Items of one block: ids, shingle hashes and texts, and the sketches as a sorted table of (hash, item)."""

    ids: list
    hashes: list[np.ndarray]
    texts: list[bytes]
    sketch: np.ndarray
    item: np.ndarray
    filter: np.ndarray


def sketch_size(n: int, threshold: float) -> int:
    """Sketch length in the partition of ``n``: enough for its largest size."""
    top = 2 ** n.bit_length() - 1
    return min(n, top - math.ceil(round(threshold * top, 9)) + 1)


def build(rows: list[tuple], k: int, threshold: float) -> Index:
    """The index over (id, text) rows; items are handled in the order of size partitions."""
    ids, hashes, texts = [], [], []
    for item_id, text in sorted(rows, key=lambda r: len((r[1] or "").split()).bit_length()):
        data = (text or "").encode()
        words, _, _, before = word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        h = np.unique(shingle_hashes(words, before, k)[0])
        if len(h):
            ids.append(item_id), hashes.append(h), texts.append(data)
    sketches = [h[: sketch_size(len(h), threshold)] for h in hashes]
    sketch = np.concatenate(sketches) if sketches else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(sketches)), [len(s) for s in sketches])
    order = np.argsort(sketch, kind="stable")
    table = np.zeros(1 << _BITS, bool)
    table[(sketch & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    return Index(ids, hashes, texts, sketch[order], item[order], table)


def probe(index: Index, h: np.ndarray, row: np.ndarray) -> set[tuple[int, int]]:
    """(row, item) pairs in which the row has a hash of the item's sketch."""
    near = np.flatnonzero(index.filter[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
    h, row = h[near], row[near]
    low, high = np.searchsorted(index.sketch, h, "left"), np.searchsorted(index.sketch, h, "right")
    hit = np.flatnonzero(high > low)
    return {(int(row[i]), int(j)) for i in hit for j in index.item[low[i] : high[i]]}


def with_matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.8, out: str = "benchmark_matches", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (their columns ``keep``, by default all) with ``out``: the items of which a document holds at least the share ``threshold``.

    Each match has item_id, shared (its shingles that the document has), item_shingles and containment, in the items' order.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = items.schema[item_id].dataType
    match = ArrayType(StructType([StructField("item_id", kind), StructField("shared", LongType()), StructField("item_shingles", LongType()), StructField("containment", DoubleType())]), False)
    kept = [c for c in (docs.columns if keep is None else keep) if c != out]
    items = items.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{item_text}`").alias("t"))
    total = items.agg(F.sum(F.size(F.split(F.coalesce("t", F.lit("")), r"[\x20\x09-\x0D]+")))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK))
    result = docs
    columns: list[str] = []
    for first in range(0, blocks, TOGETHER):
        (name,) = free_names([*docs.columns, *columns], f"{out}_{first}")
        sent = []
        for b in range(first, min(blocks, first + TOGETHER)):
            rows = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == b).collect()]  # bounded by BLOCK
            sent.append(spark.sparkContext.broadcast(build(rows, k, threshold)))
        last = first + TOGETHER >= blocks
        fields = [docs.schema[c] for c in (kept if last or text in kept else [*kept, text])] + [StructField(c, match) for c in (*columns, name)]
        result = result.mapInArrow(_matcher(sent, text, k, threshold, [f.name for f in fields[:-1]], name, to_arrow_type(match)), StructType(fields))
        columns.append(name)
    return result.select(*[F.col(f"`{c}`") for c in kept], F.array_sort(F.concat(*[F.col(f"`{c}`") for c in columns])).alias(out))


def _matcher(sent: list, text: str, k: int, threshold: float, passed: list[str], name: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_chunks(batch, text):
                words, _, _, before = word_hashes(data, offsets)
                h, row, _ = shingle_hashes(words, before, k)
                bounds = np.searchsorted(row, np.arange(len(offsets)))
                found: list[list[dict]] = [[] for _ in range(rows.num_rows)]
                for index in (b.value for b in sent):
                    for i, j in sorted(probe(index, h, row)):
                        n = len(index.hashes[j])
                        need = round(threshold * n, 9)
                        if np.isin(index.hashes[j], h[bounds[i] : bounds[i + 1]]).sum() >= need:
                            shared = len(shingle_texts(index.texts[j], k) & shingle_texts(data[offsets[i] : offsets[i + 1]].tobytes(), k))
                            if shared >= need:
                                found[i].append({"item_id": index.ids[j], "shared": shared, "item_shingles": n, "containment": shared / n})
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in passed], pa.array(found, kind)], [*passed, name])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no item, with their columns."""
    (out,) = free_names(docs.columns, "benchmark_matches")
    return with_matches(docs, items, out=out, **options).filter(F.size(out) == 0).drop(out)
