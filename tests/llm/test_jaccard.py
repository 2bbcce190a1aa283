import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchloom.llm import graph, jaccard, queries


def brute(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1)))})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and label[i] != label[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(50)]
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 and texts:
            w = list(rng.choice(texts))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                if w:
                    at = rng.randrange(len(w))
                    w[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 20, 60, 150, 300]))]
            if kind > 0.8:
                w += passage
        texts.append(w)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return rows + [(1000, None), (1001, ""), (1002, " \t"), (1003, "A b"), (1004, "a B"), (5, rows[5][1]), (None, rows[6][1]), (None, "only null")]


@pytest.mark.parametrize(("seed", "k", "num", "den"), [(1, 3, 90, 100), (2, 5, 80, 100), (3, 1, 50, 100)])
def test_matches_brute_force(spark, seed, k, num, den):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    got = sorted((tuple(r) for r in jaccard.link_components(df, k, num, den).collect()), key=str)
    assert got == brute(rows, k, num, den)


@pytest.mark.parametrize("noise", [50, 1000])
def test_long_sets(spark, monkeypatch, noise):
    monkeypatch.setattr(jaccard, "NOISE", noise)
    rows = corpus(11)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in jaccard.link_components(df, 3, 80, 100).collect()), key=str) == brute(rows, 3, 80, 100)


def test_large_blocks_and_regions(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4000)
    monkeypatch.setattr(jaccard, "BROADCAST", 0)
    rng = random.Random(5)
    base = ["w%d" % i for i in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            w[rng.randrange(120)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in jaccard.link_components(df).collect()), key=str)
    assert got == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("region", [2, 5, 30])
def test_large_regions_meet_pivots(spark, monkeypatch, region):
    monkeypatch.setattr(jaccard, "REGION", region)
    monkeypatch.setattr(jaccard, "SALTS", 3)
    rows = corpus(13)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in jaccard.link_components(df, 3, 80, 100).collect()), key=str) == brute(rows, 3, 80, 100)


def test_sets_with_one_number_are_told_apart():
    a, b = np.array([1, 2, 3], np.uint64), np.array([4, 5], np.uint64)
    shared = frozenset([jaccard._class(a)])
    assert jaccard._class(a, shared) == jaccard._hash(a, jaccard.SECOND) != jaccard._class(a) and jaccard._class(b, shared) == jaccard._class(b)


def test_signature_windows_lose_nothing():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 30, (40, 32))
    signature = np.minimum(np.repeat(base, 60, 0) + rng.integers(0, 2, (2400, 32)), 255).astype(np.uint8)
    n = signature.sum(1).astype(np.int64)
    union, plain = jaccard._Union(2400), jaccard._Union(2400)
    jaccard._near(n, signature, np.arange(2400), union, 90, 100)
    jaccard._near(n, signature, np.arange(2400), plain, 90, 100, depth=9)
    first = lambda u: [int(np.flatnonzero(u.label == x)[0]) for x in u.label]
    assert first(union) == first(plain)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (200, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in graph.components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.link_components(df).count() == 0
    assert jaccard.link_components(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).filter(F.col("doc_id") != F.col("component_id")).count() == 0


def test_query_over_a_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op7_jaccard(spark, d).collect()), key=str) == brute(rows, 3, 90, 100)
