"""Language-model scores of whole texts: a byte model (prediction by partial matching) and a smoothed word model.

Counting: every task counts all its training bytes' contexts and words, partial counts are summed by a shuffle that grows
with the corpus. All nodes of the trie stay. Contexts of three bytes and more are dealt to buckets by their last three
bytes, so that a bucket has all nodes that an escape from one of its contexts can meet, orders 0 to 2 (at most 2^24 nodes,
whatever the corpus) are sent to all. Each bucket finds the probability of every gram (a context of ``order`` bytes and the byte after it) that
occurs in any text. Grams with at least ``share`` of all bytes, and words with at least ``word_share`` of all words, are
sent to all scoring tasks; the others are looked up exactly, grams by their bucket, words by a join, so that both shares
change the work but no score. Words are known by 64-bit hashes of their bytes, A-Z lower-cased (equal hashes of different
words: about V²/2^65 pairs).

A text ends after each of its bytes, and before the first, with one probability, that of the training texts' ends among their
bytes and ends (by Laplace's rule): scores of all texts are the logarithms of probabilities that sum to 1.

Defined results: a null or empty text has its end token alone and the score of its end; a null id counts as the text
''; repeated rows count as often as they appear and each get their score; without training rows the byte model is uniform
over 256 bytes and all words are unknown; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.llm import ppm
from benchloom.llm.common import materialize, text_chunks, word_hashes

WORD = 100
#: Grams of held-out texts while counting.
ASKED = -1
#: Orders up to this one are sent to all tasks.
LOW = 2
#: Trie nodes and bytes of training text for each bucket of grams.
BUCKET_NODES, BUCKET_BYTES = 600_000, 16 << 20
#: Buckets at least: a row has a partial sum from each bucket of its rare grams, as with a large corpus.
LEAST_BUCKETS = 24
#: Distinct keys a counting task holds before it hands partial counts on.
HELD = 2_000_000


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 7."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7) == 2


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def count(docs: DataFrame, order: int, text: str = "text") -> DataFrame:
    """(kind, key, n): counts of words (WORD), and of the contexts of each order with their byte (0 to ``order``).

    Rows with ``held_out`` count as 0 and give their contexts of the full order alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {order: [], WORD: [], ASKED: []}

        def out() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    keys, n = _merged(parts)
                    parts.clear()
                    for k in range(order, -1, -1) if kind == order else [kind]:
                        if kind == order:
                            keys, n = _merged([(keys & ppm.mask(k + 1), n)])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), order if k == ASKED else k, np.int32)), pa.array(keys), pa.array(n * (k != ASKED))], ["kind", "key", "n"])

        def learned(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            for _, data, offsets in text_chunks(batch.filter(pc.invert(batch.column(1))), text):
                yield order, ppm.grams(data, offsets, order)
                yield WORD, word_hashes(data, offsets)[0].view(np.int64)
            for _, data, offsets in text_chunks(batch.filter(batch.column(1)), text):
                yield ASKED, ppm.grams(data, offsets, order)

        size = 0
        for batch in batches:
            for kind, values in learned(batch):
                if len(values):
                    c = pa.array(values).value_counts()
                    held[kind].append((c.field(0).to_numpy(), c.field(1).to_numpy()))
                    size += len(c)
                if size > HELD:
                    for k, parts in held.items():
                        held[k] = [_merged(parts)] if parts else []
                    size = sum(len(p[0]) for parts in held.values() for p in parts)
                    if size > HELD // 2:
                        yield from out()
                        size = 0
        yield from out()

    return docs.select(F.col(f"`{text}`").alias(text), "held_out").mapInArrow(run, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def bucket(key, buckets: int):
    """The bucket of a context with its byte by the context's last three bytes, for arrays."""
    return ((((key >> 8) & 0xFFFFFF) * 2654435761 & 0xFFFFFFFF) >> 8) % buckets


def _bucket_column(key: Column, buckets: int) -> Column:
    context = F.shiftright(key, 8).bitwiseAND(F.lit(0xFFFFFF))
    return (F.shiftright((context * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF)), 8) % buckets).cast("int")


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def gram_logs(counts: DataFrame, order: int, n_bytes: int, buckets: int, share: float) -> DataFrame:
    """For each bucket its grams and their log probabilities, packed; and as arrays those of at least ``share`` of all bytes."""
    low = counts.filter((F.col("kind") <= LOW) & (F.col("n") > 0)).toArrow()
    kinds, keys, ns = (low.column(c).to_numpy() for c in ("kind", "key", "n"))
    sent = counts.sparkSession.sparkContext.broadcast([_table(kinds, keys, ns, k) for k in range(min(LOW, order) + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in (b.column(0), b.column(1), b.column(2))] for b in batches]
        if not parts:
            return
        kinds, keys, ns = (np.concatenate([p[i] for p in parts]) for i in range(3))
        learned = ns > 0
        model = ppm.Model.build([*sent.value, *[_table(kinds[learned], keys[learned], ns[learned], k) for k in range(LOW + 1, order + 1)]])
        grams, n = _table(kinds, keys, ns, order)
        logs = model.log_probability(grams)
        hot = (n > 0) & (n >= share * n_bytes)
        at = bucket(grams, buckets)
        for b in np.unique(at):
            own = np.flatnonzero(at == b)
            warm = own[hot[own]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([len(own)]), pa.array([_packed(grams[own])]), pa.array([_packed(logs[own])]), pa.array([grams[warm].tolist()], pa.list_(pa.int64())), pa.array([logs[warm].tolist()], pa.list_(pa.float64()))],
                ["bucket", "n_keys", "keys", "logs", "hot", "hot_logs"],
            )

    rows = counts.filter(((F.col("kind") > LOW) & (F.col("kind") < WORD)) | (F.col("kind") == order)).select("kind", "key", "n", _bucket_column(F.col("key"), buckets).alias("bucket"))
    return rows.repartitionById(buckets, "bucket").mapInArrow(run, "bucket int, n_keys bigint, keys binary, logs binary, hot array<bigint>, hot_logs array<double>")


def _table(kinds: np.ndarray, keys: np.ndarray, ns: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.flatnonzero(kinds == kind)
    own = own[np.argsort(keys[own])]
    return keys[own], ns[own]


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, part): sums of log probabilities of the grams asked for; each bucket's table comes before what asks it."""
    keys, logs = np.zeros(0, np.int64), np.zeros(0)
    for batch in batches:
        for r in batch.to_pylist():
            if r["n_keys"] is not None:
                keys, logs = _unpacked(r["keys"], r["n_keys"], np.int64), _unpacked(r["logs"], r["n_keys"], np.float64)
                continue
            rows, times = _unpacked(r["own"], r["n_own"], np.int64), _unpacked(r["times"], r["n_own"], np.int32)
            found = logs[np.searchsorted(keys, _unpacked(r["keys"], int(times.sum()), np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.add.reduceat(found, np.cumsum(times) - times))], ["row", "part"])


def _known(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, order: int, grams: np.ndarray, gram_log: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple]]:
    """log10 of the grams sent to all, summed by row, and the others by bucket: packed grams, their rows and how many of each."""
    if not len(data):
        return np.zeros(len(offsets) - 1), []
    coded = pa.array(ppm.grams(data, offsets, order)).dictionary_encode()
    words, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    at = np.minimum(np.searchsorted(grams, words), max(len(grams) - 1, 0))
    known = grams[at] == words if len(grams) else np.zeros(len(words), bool)
    logs = np.where(known, gram_log[at], 0.0) if len(grams) else np.zeros(len(words))
    total = np.concatenate([[0.0], np.cumsum(logs[codes])])
    rare = np.flatnonzero(~known[codes])
    own = bucket(words, buckets).astype(np.int32)[codes[rare]]
    by_bucket = np.argsort(own, kind="stable")
    rare, own = rare[by_bucket], own[by_bucket]
    row = np.searchsorted(offsets, rare, "right") - 1
    asked = []
    bounds = np.searchsorted(own, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)):
        part = slice(bounds[b], bounds[b + 1])
        some, times = np.unique(row[part], return_counts=True)
        asked.append((int(b), _packed(words[codes[rare[part]]]), len(some), _packed(rows[some]), _packed(times.astype(np.int32))))
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.log(10), asked


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = 5, share: float = 2.0**-21, word_share: float = 2.0**-20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every row."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    docs = docs.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("row", F.monotonically_increasing_id())
    counts = materialize(count(docs, order), "counts")
    sums = {r.kind: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()}
    n_docs = docs.filter(~F.col("held_out")).count()
    n_bytes = sums[0].n if 0 in sums else 0
    n_words, n_distinct = (sums[WORD].n, sums[WORD].distinct) if WORD in sums else (0, 0)
    total, vocabulary = n_words + n_docs, n_distinct + (n_docs > 0)
    ends = (n_docs + 1) / (n_bytes + n_docs + 2)
    log_end, log_on = float(np.log10(ends)), float(np.log10(1 - ends))
    # At most 1/share grams and 1/word_share words.
    buckets = int(max(LEAST_BUCKETS, -(-sum(r.distinct for k, r in sums.items() if LOW < k < WORD) // BUCKET_NODES), -(-n_bytes // BUCKET_BYTES)))
    logs, grams, gram_log = None, np.zeros(0, np.int64), np.zeros(0)
    if n_bytes:
        logs = materialize(gram_logs(counts, order, n_bytes, buckets, share), "logs")
        hot = logs.select(F.explode(F.arrays_zip("hot", "hot_logs")).alias("h")).select("h.hot", "h.hot_logs").toArrow()
        grams, gram_log = hot.column(0).to_numpy(), hot.column(1).to_numpy()
        by_key = np.argsort(grams)
        grams, gram_log = grams[by_key], gram_log[by_key]
    kept = counts.filter((F.col("kind") == WORD) & (F.col("n") >= word_share * n_words)).toArrow()
    word_keys, word_n = _table(*(kept.column(c).to_numpy() for c in ("kind", "key", "n")), WORD)
    denominator = float(total + vocabulary + 1)
    sent = docs.sparkSession.sparkContext.broadcast((grams, gram_log, word_keys, np.log10((word_n + 1) / denominator)))
    end_log = float(np.log10((n_docs + 1) / denominator))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, gram_log, word_keys, word_logs = sent.value
        for batch in batches:
            for rows, data, offsets in text_chunks(batch, "text"):
                words, _, _, before = word_hashes(data, offsets)
                words = words.view(np.int64)
                at = np.minimum(np.searchsorted(word_keys, words), max(len(word_keys) - 1, 0))
                known = word_keys[at] == words if len(word_keys) else np.zeros(len(words), bool)
                logs = np.where(known, word_logs[at], 0.0) if len(word_keys) else np.zeros(len(words))
                sums = np.array([logs[a:b].sum() for a, b in zip(before[:-1], before[1:], strict=True)]) + end_log
                n_known = np.diff(np.concatenate([[0], np.cumsum(known)])[before]) + (n_docs > 0)
                rare = np.flatnonzero(~known)
                rare_at = np.searchsorted(rare, before)
                own, asked = _known(data, offsets, rows.column(3).to_numpy(), order, grams, gram_log, buckets) if n_bytes else (-np.diff(offsets) * np.log10(256), [])
                own = own + np.diff(offsets) * log_on + log_end
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), rows.column(3), pa.array(np.diff(before) + 1), pa.array(n_known.astype(np.int64)), pa.array(sums), pa.array(own), pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), pa.array(words[rare])), *(pa.nulls(len(rows), t) for t in asked_types)],
                    names,
                )
                if asked:
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(asked), t) for t in [rows.column(0).type, *own_types]), *(pa.array([a[i] for a in asked], t) for i, t in enumerate(asked_types))], names)

    own_types = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
    asked_types = [pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    names = ["doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "score", "rare", "bucket", "keys", "n_own", "own", "times"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, row bigint, n_tokens bigint, n_known bigint, base_score double, score double, rare array<bigint>, bucket int, keys binary, n_own bigint, own binary, times binary"
    both = materialize(docs.mapInArrow(run, schema), "scored")
    scored = both.filter("bucket is null").select(names[:8])
    if n_bytes:
        # Rare grams, exactly: each bucket's table before the packed grams that ask it.
        asks = both.filter("bucket is not null").select("bucket", F.lit(None).cast("bigint").alias("n_keys"), "keys", F.lit(None).cast("binary").alias("logs"), "n_own", "own", "times")
        tables = logs.select("bucket", "n_keys", "keys", "logs", *(F.lit(None).cast(t).alias(c) for c, t in (("n_own", "bigint"), ("own", "binary"), ("times", "binary"))))
        parts = tables.unionByName(asks).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", F.col("n_keys").isNull()).mapInArrow(_looked_up, "row bigint, part double")
        scored = scored.join(parts.groupBy("row").agg(F.sum("part").alias("part")), "row", "left").withColumn("score", F.col("score") + F.coalesce(F.col("part"), F.lit(0.0)) / float(np.log(10))).drop("part")
    # Rare words, exactly: how often each row has them, joined with their counts. Their share bounds how hot one can be in training.
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    words = counts.filter((F.col("kind") == WORD) & (F.col("n") < word_share * n_words)).select("key", "n")
    c = F.coalesce(F.col("n"), F.lit(0))
    tail = rare.join(words, "key", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10((c + 1) / F.lit(denominator))).alias("tail"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more")).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), (F.col("base_score") + zero("tail")).alias("base_score"), "score")
