import os
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from benchloom.llm import framing, queries, records

WORDS = public_tokenizers.path("word_bpe_49k.json")
D = "/root/testdata/sf0.01"


def crc_by_bits(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def brute(rows):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(WORDS), 0, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out[i] = (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    return sorted(out.values())


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def ids_of(spark, rows):
    return records.token_ids(frame(spark, rows), WORDS, 2)


def test_checksums():
    assert crc_by_bits(b"123456789") == 0xE3069283
    r = np.random.default_rng(1)
    runs = [b"", b"1", b"123456789", *[r.integers(0, 256, n, np.uint8).tobytes() for n in (63, 64, 65, 128, 1000, 4097)]]
    ends = np.cumsum([len(x) for x in runs])
    assert framing.crc32c(np.frombuffer(b"".join(runs), np.uint8), ends - [len(x) for x in runs], ends).tolist() == [crc_by_bits(x) for x in runs]
    assert framing.masked(np.array([0xE3069283], np.uint32))[0] == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) % 2**32


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.lists(st.integers(0, 2**32 - 1), max_size=70)), max_size=6))
def test_messages_and_frames(rows):
    ends = np.concatenate([[0], np.cumsum([len(ids) for _, ids in rows])]).astype(np.int64)
    packed, cuts = framing.varints(np.array([x for _, ids in rows for x in ids], np.uint32), ends)
    messages = [framing.example(i, packed[a:b].tobytes()) for (i, _), a, b in zip(rows, cuts, cuts[1:])]
    data, begins = framing.frame(messages)
    at = 0
    for m in messages:  # by the format's definition
        head = struct.pack("<Q", len(m))
        mask = lambda c: ((c >> 15 | c << 17) + 0xA282EAD8) % 2**32
        whole = head + struct.pack("<I", mask(crc_by_bits(head))) + m + struct.pack("<I", mask(crc_by_bits(m)))
        assert data[at : at + len(whole)].tobytes() == whole
        at += len(whole)
    back = [framing.int_lists(m) for m in framing.unframe(data, begins)]
    assert [(framing.signed(x["doc_id"]), framing.numbers(np.frombuffer(x["input_ids"], np.uint8)).tolist()) for x in back] == [(i, ids) for i, ids in rows]


def test_damage_is_found():
    data, begins = framing.frame([b"abc" * 50, b"", b"x"])
    for at in (0, 9, 20, 165):
        bad = data.copy()
        bad[at] ^= 4
        with pytest.raises(framing.Damaged):
            framing.unframe(bad, begins)


TEXTS = ["", None, "It's  DON'T we'll x y　z", "á e ́x Å ΣΣ Σ", "<|endoftext|>tail <|startoftext|> x<|endoftext|>", "12 345,6!? ''s 'S", "\x0b\x0c\x1c\x1d \x85t​u﻿ \x00nul", "İstanbul ǅ ﬁ \U0001f600\U0001f468‍\U0001f469", "z" * 5000, "w" * 63 + " " + "w" * 65, ("long text " * 9 + "\n") * 4000]


def test_pieces_are_the_library_whole(spark, tmp_path):
    rows = list(enumerate(TEXTS)) + [(-5, "neg"), (2**40, "far")]
    out = records.read(spark, records.write(ids_of(spark, rows), f"{tmp_path}/r", shardBytes=2000), splitBytes=500)
    got = sorted(tuple(r) for r in out.select("doc_id", "start", "n_tokens", F.crc32("ids")).collect())
    assert got == brute(rows)
    assert len([x for x in os.listdir(f"{tmp_path}/r") if x.endswith(".idx")]) > 2


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_any_text(text):
    import pyarrow as pa

    e = records.encoder_of(WORDS)
    assert e.pieces and e.encode(pa.array([text, "", text]))[0].tolist() == e.whole.encode(text, add_special_tokens=False).ids * 2


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op12_records(spark, D).collect()) == brute(rows)


def test_ties_nulls_and_other_columns(spark, tmp_path):
    rows = [(None, "n", "x"), (7, "b", "x"), (7, "b", "x"), (7, "a c", "x"), (1, "q", "y")]
    df = frame(spark, rows, "doc_id long, text string, ids string")
    got = records.read(spark, records.write(records.token_ids(df, WORDS, 2), f"{tmp_path}/r")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 7, 7, 7] and [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    empty = records.read(spark, records.write(ids_of(spark, [(1, "a")]).limit(0), f"{tmp_path}/e"))
    assert empty.count() == 0 and records.shuffled(spark, f"{tmp_path}/e", 1).count() == 0


def test_shuffled_reads(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(300)]
    path = records.write(ids_of(spark, rows), f"{tmp_path}/r", shardBytes=1500)
    straight = {r.doc_id: tuple(r) for r in records.read(spark, path).collect()}
    one, again, other = ([tuple(r) for r in records.shuffled(spark, path, seed).collect()] for seed in (1, 1, 2))
    assert one == again and one != other and sorted(one) == sorted(straight.values()) and [r[0] for r in one] != sorted(r[0] for r in one)


def test_lost_attempts_do_not_show(spark, tmp_path):
    path = f"{tmp_path}/r"
    os.makedirs(path)
    for end in ("tfrecord", "idx"):  # what a lost executor left
        open(f"{path}/part-000000-0000-{'0' * 32}.{end}", "wb").write(b"half")
    open(f"{path}/notes.txt", "w").write("stays")
    records.write(ids_of(spark, [(1, "a b")]), path)
    assert records.read(spark, path).count() == 1 and sorted(os.listdir(path))[-1].startswith("part-") and not any("0" * 32 in x for x in os.listdir(path)) and "notes.txt" in os.listdir(path)
    with pytest.raises(Exception):
        records.write(ids_of(spark, [(1, "a b")]), path)
    shard = next(x for x in os.listdir(path) if x.endswith(".tfrecord"))
    data = bytearray(open(f"{path}/{shard}", "rb").read())
    data[-6] ^= 1
    open(f"{path}/{shard}", "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        records.read(spark, path).collect()


def test_other_tokenizers_are_taken_whole():
    assert not records.Encoder(public_tokenizers.path("byte_bpe_50k.json")).pieces
