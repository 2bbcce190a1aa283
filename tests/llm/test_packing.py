import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from benchloom.llm import packing, queries, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a  b", "word " * 5000, "é ü 　x", "<|endoftext|> in text", "it's\n\n don't \t x ", "same text", "same text", "x" * 9000]


@pytest.mark.parametrize("text", [t or "" for t in TEXTS])
def test_ids_are_those_of_the_file(text):
    tok = tokens.load(PATH)
    assert np.frombuffer(tok.encode(text), "<u4").tolist() == tok.exact.encode(text, add_special_tokens=False).ids


def check(rows, expected, capacity):
    """Pieces as brute force cuts them, every sequence gapless from 0 and within the capacity."""
    got = sorted((r.doc_id is None, r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == sorted(expected)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def brute(rows, capacity):
    tok, out = tokens.load(PATH).exact, []
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity
        starts = ([0] if first else []) + list(range(first, len(ids), capacity))
        for k, s in enumerate(starts):
            own = ids[s : first if s == 0 and first else s + capacity]
            out.append((doc_id is None, doc_id, k, s, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return out


def test_edge_cases(spark):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    check(packing.pack(df, PATH, 64).collect(), brute(rows, 64), 64)
    assert packing.pack(df.filter(F.lit(False)), PATH).count() == 0


def test_query_over_a_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op3_packing(spark, d).collect()
    n = check(got, brute(rows, 2048), 2048)
    assert n <= -(-sum(r.length for r in got) // 2048) + 2


def test_ids_are_returned_with_their_places(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    rows = sorted(packing.pack(df, PATH, 4, with_ids=True).collect(), key=lambda r: r.start)
    ids = [i for r in rows for i in r.ids]
    assert ids == tokens.load(PATH).exact.encode("a b c d e f").ids + [0]


@pytest.mark.parametrize("seed", range(4))
def test_programs_pack_all_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(4, 1, 4000).astype(int), 1, 256)
    counts = np.bincount(lengths, minlength=257)
    plan = packing.solve(counts, 256)
    used = np.zeros(257, int)
    for c, m in plan:
        assert sum(c) <= 256
        for x in c:
            used[x] += m
    assert (used == counts).all()
    best_fit = sum(m for _, m in packing._best_fit(counts, 256))
    assert sum(m for _, m in plan) <= best_fit + 1


def bins(plan):
    return sum(m for _, m in plan)


def test_the_program_beats_best_fit_where_that_goes_wrong():
    counts = np.zeros(2049, np.int64)
    counts[[1044, 552, 532, 472]] = 6000, 6000, 6000, 12000
    plan = packing.solve(counts, 2048)
    assert bins(plan) == 9000 == -(-int(counts @ np.arange(2049)) // 2048) and bins(packing._best_fit(counts, 2048)) == 11000
    held = np.zeros(2049, np.int64)
    for c, m in plan:
        np.add.at(held, list(c), m)
        assert sum(c) <= 2048
    assert (held == counts).all()


@pytest.mark.parametrize("n, share", [(300, 0.1), (100_000, 0.7)])
def test_the_program_places_pieces_at_every_size(n, share):
    sizes = np.minimum(np.exp(np.random.default_rng(2).normal(5.5, 1.1, n)).astype(int) + 1, 2048)
    counts = np.bincount(sizes, minlength=2049).astype(np.int64)
    plan, rest = packing.program(counts, 2048)
    held = rest.copy()
    for c, m in plan.items():
        np.add.at(held, list(c), m)
    assert (held == counts).all() and rest.sum() <= (1 - share) * n
    assert bins(packing.solve(counts, 2048)) <= 1.002 * bins(packing._best_fit(counts, 2048)) + 1


@pytest.mark.parametrize("seed", range(6))
def test_never_more_sequences_than_best_fit(seed):
    r = np.random.default_rng(seed)
    n = (200, 1000, 20_000)[seed % 3]
    sizes = np.clip(r.lognormal(5.5, 1.2, n).astype(int), 1, 2048) if seed < 3 else r.choice([1044, 552, 532, 472], n)
    counts = np.bincount(sizes, minlength=2049)
    plan = packing.solve(counts, 2048)
    held = np.zeros(2049, np.int64)
    for c, m in plan:
        assert sum(c) <= 2048
        np.add.at(held, list(c), m)
    assert (held == counts).all() and sum(m for _, m in plan) <= sum(m for _, m in packing._best_fit(counts, 2048))
