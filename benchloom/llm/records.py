"""Token ids as length-delimited binary records: a Spark data source ``token_records`` over framed files with offset indexes.

A folder holds shards (``.tfrecord``: framed Examples), beside each an index (``.idx``: for each record its offset and the
ids before it in the shard, two unsigned 64-bit numbers little-endian, and one such pair for the end) and ``manifest.json``
with the shards in order. Tasks write shards under names of their own; the manifest, written last, names those of the tasks
that counted, so repeated, lost or speculative attempts never show, and what they left is removed. Reading plans ranges of
records from the manifest, so a large shard is read by many tasks, and checks every length and checksum. ``shuffled`` reads
single records by the index in an order drawn from a seed.

Texts are cut where the tokenizer's own rules make the pieces independent of each other; each distinct piece is then encoded
once by the tokenizers library and its ids are gathered by arrays.

Defined results: a null text is an empty one: the end id alone. Records are in ascending order of doc_id, nulls first, and of
a digest of the text at equal ids; repeated rows are records of their own. Other columns are ignored. An empty table is a
folder without shards. Texts of any length are one record.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from benchloom.llm import framing
from benchloom.llm.common import bound_batches
from benchloom.llm.tokens import byte_of_char

FORMAT = "token_records"
#: Bytes of a shard after which a task begins the next one, and of records that a task reads or a batch holds.
SHARD_BYTES, SPLIT_BYTES, STEP_BYTES = 256 << 20, 32 << 20, 2 << 20
#: Distinct pieces that a worker remembers, their greatest length, and bytes of text encoded in one step.
KEPT_PIECES, PIECE_BYTES, TEXT_BYTES = 400_000, 64, 1 << 20
_MANIFEST = "manifest.json"


#: The pattern of pre-tokens whose pieces ``_BREAKS`` gives.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _classes() -> np.ndarray:
    """Classes of bytes: white space 0, letters 1, digits 2, other ASCII 3, apostrophe 4, beyond ASCII 5."""
    out = np.full(256, 3, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[[*range(65, 91), *range(97, 123)]] = 1
    out[48:58] = 2
    out[39] = 4
    out[128:] = 5
    return out


def _breaks() -> np.ndarray:
    """Whether pre-tokens on both sides of two neighbouring classes never depend on each other.

    White space is in no pre-token. ASCII letters and digits end before other ASCII characters and begin after them, but for
    what an apostrophe begins. What lies beyond ASCII may be a letter or a mark, so nothing is cut there.
    """
    cut = np.zeros((8, 8), bool)
    cut[0, 1:6] = cut[1:6, 0] = True
    cut[1, [2, 3, 4]] = cut[2, [1, 2, 3, 4]] = cut[3, [1, 2]] = True
    return cut.ravel()


_CLASS, _BREAKS = _classes(), _breaks()
#: Small letters that normalization leaves as they are, and the characters that stand for bytes in byte-level vocabularies.
_SMALL, _SHOWN = re.compile("[a-zß-öø-ÿ]+"), {b: c for c, b in byte_of_char().items()}
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) < 91)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers, and how many lie before each list."""
    before = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]).astype(np.int64)
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(before[-1])), before


class Encoder:
    """Ids of a tokenizer file, by pieces of text where its rules allow it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pieces, self.added = cuts_apply(spec), [t["content"] for t in spec.get("added_tokens", [])]
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.begins, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many lie before each text."""
        return _flat([e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)])

    def _add(self, words: list[str], ids: np.ndarray, before: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.begins = np.concatenate([self.begins, self.begins[-1] + before[1:]])
        self.ids = np.concatenate([self.ids, ids])

    def _places(self, words: list[str]) -> np.ndarray:
        """Where the ids of distinct ``words`` are kept; encodes those that are new."""
        if len(self.place) > KEPT_PIECES:
            self._clear()
        new = [w for w in words if w not in self.place]
        # Small letters are one pre-token as they are: the library's model alone gives their ids, at half the cost.
        plain = [w for w in new if _SMALL.fullmatch(w)]
        if plain:
            tokenize = self.whole.model.tokenize
            self._add(plain, *_flat([[t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_SHOWN))] for w in plain]))
        if rest := [w for w in new if w not in self.place]:
            self._add(rest, *self._encoded(rest))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, and how many lie before each (with the total as last)."""
        special = np.zeros(len(texts), bool)
        for content in self.added:
            special |= pc.match_substring(texts, content, ignore_case=True).to_numpy(zero_copy_only=False)
        if not self.pieces or special.all():
            return self._encoded(texts.to_pylist())
        if not special.any():
            return self._by_pieces(texts)
        # Texts with added tokens in them go to the library whole.
        parts = [self._encoded(texts.filter(pa.array(special)).to_pylist()), self._by_pieces(texts.filter(pa.array(~special)))]
        sizes = np.zeros(len(texts), np.int64)
        sizes[special], sizes[~special] = (np.diff(before) for _, before in parts)
        owner = np.repeat(special, sizes)
        out = np.zeros(len(owner), np.uint32)
        out[owner], out[~owner] = (ids for ids, _ in parts)
        return out, np.concatenate([[0], np.cumsum(sizes)])

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kind = _CLASS[data]
        cut = np.concatenate([[True], _BREAKS[kind[:-1] * np.uint8(8) + kind[1:]]])
        cut[offsets[offsets < len(data)]] = True
        # Capitals are lowered where no mark can follow, which the tokenizer would join to the capital.
        plain = _CAPITAL[data]
        plain[:-1] &= kind[1:] != 5
        data = data + plain.view(np.uint8) * np.uint8(32)
        # White space is left out, so that pieces lie end to end.
        solid = kind != 0
        starts = np.flatnonzero(cut & solid)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        dense = data[solid]
        ends = np.append((np.cumsum(solid, dtype=np.int64) - 1)[starts], len(dense))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(dense)]).dictionary_encode()
        lengths = pc.binary_length(words.dictionary).to_numpy()
        names = words.dictionary.cast(pa.large_string()).to_numpy(zero_copy_only=False)
        short = np.flatnonzero(lengths <= PIECE_BYTES)
        places = np.zeros(len(names), np.int64)
        places[short] = self._places(names[short].tolist())
        begins, ids = self.begins, self.ids
        long_ = np.flatnonzero(lengths > PIECE_BYTES)
        if len(long_):  # met once as a rule: encoded for this step alone
            more, before = self._encoded(names[long_].tolist())
            places[long_] = len(begins) - 1 + np.arange(len(long_))
            begins, ids = np.concatenate([begins, begins[-1] + before[1:]]), np.concatenate([ids, more])
        at = places[words.indices.to_numpy()]
        first = begins[at]
        size = begins[at + 1] - first
        after = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(after[-1]) + np.repeat(first - after[:-1], size)
        return ids[take], after[np.searchsorted(starts, offsets)]


def cuts_apply(spec: dict) -> bool:
    """Whether a tokenizer file encodes a text as its pieces by ``_BREAKS``, one after the other.

    So it does if normalization composes marks, makes white space one and lowers, in this order, if pre-tokens are the matches
    of ``_PATTERN``, and if nothing is added at a text's ends. Added tokens are looked for apart.
    """
    several = lambda x, key: (x or {}).get(key) or ([x] if x else [])
    space = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    first, *rest = several(spec.get("pre_tokenizer"), "pretokenizers") or [{}]
    split = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
    bytes_only = all(p["type"] == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex") for p in rest)
    return several(spec.get("normalizer"), "normalizers") == [{"type": "NFC"}, space, {"type": "Lowercase"}] and first == split and bytes_only and not spec.get("truncation")


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The tokenizer at ``path``, loaded once in each worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_ids(docs: DataFrame, tokenizer: str, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit numbers, ``end`` the last) in ascending order of doc_id over all partitions."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # Ties are cut by text and place, so that a third of all rows under one id are many partitions.
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            bytes_before = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("text")).to_numpy())])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(bytes_before, bytes_before[at] + TEXT_BYTES, "right")) - 1)
                ids, before = encoder.encode(batch.column("text").slice(at, to - at))
                n = to - at
                out = np.full(len(ids) + n, end, "<u4")
                out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(before))] = ids
                offsets = pa.array((before + np.arange(n + 1)) * 4, pa.int32())
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(at, n), "ids": pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(out)])})
                at = to

    return rows.mapInArrow(run, "doc_id long, ids binary")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _read(store: fs.FileSystem, path: str, start: int = 0, size: int | None = None) -> bytes:
    with store.open_input_file(path) as f:
        f.seek(start)
        return f.read() if size is None else f.read(size)


def _manifest(path: str) -> dict:
    store, root = _store(path)
    return json.loads(_read(store, f"{root}/{_MANIFEST}"))


class Written(WriterCommitMessage):
    """The shards of one task: file, records, ids, bytes."""

    def __init__(self, task: int, shards: list[tuple[str, int, int, int]]) -> None:
        self.task, self.shards = task, shards


class Shard:
    """A shard being written, with its index."""

    def __init__(self, store: fs.FileSystem, root: str, name: str) -> None:
        self.name, self.records, self.ids, self.bytes = name, 0, 0, 0
        self.data, self.index = store.open_output_stream(f"{root}/{name}.tfrecord"), store.open_output_stream(f"{root}/{name}.idx")

    def add(self, messages: list[bytes], sizes: np.ndarray) -> None:
        framed, begins = framing.frame(messages)
        self.data.write(pa.py_buffer(framed))
        before = self.ids + np.cumsum(sizes) - sizes
        self.index.write(np.stack([self.bytes + begins[:-1], before], 1).astype("<u8").tobytes())
        self.records, self.ids, self.bytes = self.records + len(messages), self.ids + int(sizes.sum()), self.bytes + len(framed)

    def close(self) -> tuple[str, int, int, int]:
        self.index.write(np.array([self.bytes, self.ids], "<u8").tobytes())
        self.data.close()
        self.index.close()
        return self.name, self.records, self.ids, self.bytes


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.shard_bytes = int(options.get("shardbytes", SHARD_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        shards, shard = [], None
        for batch in iterator:
            ids_of, at = batch.column("ids"), 0
            lengths = np.concatenate([[0], np.cumsum(pc.binary_length(ids_of).to_numpy(zero_copy_only=False))]).astype(np.int64)
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(lengths, lengths[at] + min(STEP_BYTES, self.shard_bytes), "right")) - 1)
                ids = np.frombuffer(b"".join(x.as_py() for x in ids_of.slice(at, to - at)), "<u4")
                sizes = np.diff(lengths[at : to + 1]) // 4
                packed, cuts = framing.varints(ids, np.concatenate([[0], np.cumsum(sizes)]))
                doc_ids = batch.column("doc_id").slice(at, to - at).to_pylist()
                shard = shard or Shard(store, root, f"part-{task:06d}-{len(shards):04d}-{attempt}")
                shard.add([framing.example(i, packed[a:b].tobytes()) for i, a, b in zip(doc_ids, cuts[:-1], cuts[1:])], sizes)
                at = to
                if shard.bytes >= self.shard_bytes:
                    shards.append(shard.close())
                    shard = None
        if shard:
            shards.append(shard.close())
        return Written(task, shards)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        start, shards = 0, []
        for m in sorted((m for m in messages if m), key=lambda m: m.task):
            for name, records, ids, size in m.shards:
                shards.append({"name": name, "records": records, "ids": ids, "bytes": size, "start": start})
                start += ids
        if not self.overwrite and store.get_file_info(f"{root}/{_MANIFEST}").type != fs.FileType.NotFound:
            raise FileExistsError(self.path)
        draft = f"{root}/{_MANIFEST}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps({"shards": shards}).encode())
        store.move(draft, f"{root}/{_MANIFEST}")
        kept = {s["name"] for s in shards}
        for info in store.get_file_info(fs.FileSelector(root)):
            if (m := re.fullmatch(r"(part-\d{6,}-\d{4,}-[0-9a-f]{32})\.(tfrecord|idx)", info.base_name)) and m[1] not in kept:
                store.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            for name, *_ in m.shards if m else ():
                for end in ("tfrecord", "idx"):
                    store.delete_file(f"{root}/{name}.{end}")


class Range(InputPartition):
    """Records ``[first, last)`` of a shard; ``start``: ids of all shards before."""

    def __init__(self, name: str, start: int, first: int, last: int) -> None:
        super().__init__(name)
        self.name, self.start, self.first, self.last = name, start, first, last


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.index_only = options.get("part", "records") == "index"

    def partitions(self) -> list[InputPartition]:
        out = []
        for s in _manifest(self.path)["shards"]:
            pieces = max(1, min(s["records"], -(-s["bytes"] // self.split)))
            cuts = [s["records"] * i // pieces for i in range(pieces + 1)]
            out += [Range(s["name"], s["start"], a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part is None or part.value is None:
            return
        store, root = _store(self.path)
        index = np.frombuffer(_read(store, f"{root}/{part.name}.idx", part.first * 16, (part.last - part.first + 1) * 16), "<u8").reshape(-1, 2).astype(np.int64)
        if len(index) != part.last - part.first + 1:
            raise framing.Damaged(f"{part.name}: the index is too short")
        offsets, before = index[:, 0], index[:, 1]
        if self.index_only:
            n = len(index) - 1
            yield pa.record_batch({"shard": pa.array([part.name] * n, pa.string()), "offset": pa.array(offsets[:-1]), "bytes": pa.array(np.diff(offsets)), "start": pa.array(part.start + before[:-1]), "n_tokens": pa.array(np.diff(before))})
            return
        with store.open_input_file(f"{root}/{part.name}.tfrecord") as f:
            f.seek(int(offsets[0]))
            at = 0
            while at < len(offsets) - 1:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, "right")) - 1)
                data = np.frombuffer(f.read(int(offsets[to] - offsets[at])), np.uint8)
                yield _decoded(data, offsets[at : to + 1] - offsets[at], part.start + before[at : to + 1])
                at = to


def _decoded(data: np.ndarray, begins: np.ndarray, before: np.ndarray) -> pa.RecordBatch:
    """doc_id, start, n_tokens, ids of framed records; ``before``: ids before each, and after the last."""
    lists = [framing.int_lists(m) for m in framing.unframe(data, begins)]
    ids = framing.numbers(np.frombuffer(b"".join(x["input_ids"] for x in lists), np.uint8)).astype("<u4")
    sizes = np.diff(before)
    if len(ids) != sizes.sum() or any(np.count_nonzero(np.frombuffer(x["input_ids"], np.uint8) < 128) != n for x, n in zip(lists, sizes)):
        raise framing.Damaged("the index does not count a record's ids")
    offsets = pa.array((before - before[0]) * 4, pa.int32())
    column = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, offsets.buffers()[1], pa.py_buffer(ids)])
    return pa.record_batch({"doc_id": pa.array([framing.signed(x["doc_id"]) for x in lists], pa.int64()), "start": pa.array(before[:-1]), "n_tokens": pa.array(sizes), "ids": column})


RECORDS, INDEX = "doc_id long, start long, n_tokens long, ids binary", "shard string, offset long, bytes long, start long, n_tokens long"


class TokenRecords(DataSource):
    """``spark.read.format("token_records").load(folder)`` and ``df.write.format("token_records").save(folder)``.

    Written columns: doc_id, ids (little-endian unsigned 32-bit numbers). Options: shardBytes, splitBytes, part ("index": the
    offset indexes instead of the records).
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return INDEX if self.options.get("part") == "index" else RECORDS

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in dict(self.options).items()})

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer({k.lower(): v for k, v in dict(self.options).items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(TokenRecords)


def write(ids: DataFrame, path: str, **options) -> str:
    """``ids`` (doc_id, ids; partitions in order, rows in order) as records in the new folder ``path``."""
    register(ids.sparkSession)
    ids.write.format(FORMAT).options(**options).mode("append").save(path)
    return path


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids of all records of a folder."""
    register(spark)
    return spark.read.format(FORMAT).options(**options).load(path)


def shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """All records in an order drawn from ``seed``: each is read alone at its offset."""
    index = read(spark, path, part="index").withColumn("key", F.xxhash64(F.lit(seed), "shard", "offset"))
    drawn = index.repartitionByRange("key", "shard", "offset").sortWithinPartitions("key", "shard", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        for batch in batches:
            rows, at = batch.to_pydict(), 0
            while at < batch.num_rows:
                to, size = at, 0
                while to < batch.num_rows and (to == at or size + rows["bytes"][to] <= STEP_BYTES):
                    size, to = size + rows["bytes"][to], to + 1
                got: dict[int, bytes] = {}
                by_shard: dict[str, list[int]] = {}
                for i in range(at, to):
                    by_shard.setdefault(rows["shard"][i], []).append(i)
                for shard, wanted in by_shard.items():  # each file is opened once a step and read forwards
                    with store.open_input_file(f"{root}/{shard}.tfrecord") as f:
                        for i in sorted(wanted, key=lambda i: rows["offset"][i]):
                            f.seek(rows["offset"][i])
                            got[i] = f.read(rows["bytes"][i])
                data = np.frombuffer(b"".join(got[i] for i in range(at, to)), np.uint8)
                begins = np.concatenate([[0], np.cumsum(rows["bytes"][at:to])]).astype(np.int64)
                out = _decoded(data, begins, np.concatenate([[0], np.cumsum(rows["n_tokens"][at:to])]).astype(np.int64))
                yield out.set_column(1, "start", batch.column("start").slice(at, to - at))
                at = to

    return drawn.select("shard", "offset", "bytes", "start", "n_tokens").mapInArrow(run, RECORDS)
