import numpy as np
import pytest
from pyspark.sql import functions as F

from benchloom.llm import ann, hnsw, queries

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, ask):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(np.float64)
    out = []
    for q in sorted(good):
        if q % ask == 0:
            found = sorted((-float(good[c] @ good[q]), c) for c in good if c != q and len(good[c]) == len(good[q]))[:k]
            out += [(q, r + 1, c, pytest.approx(-s, abs=1e-12)) for r, (s, c) in enumerate(found)]
    return out


def run(spark, rows, k=5, ask=4, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % ask == 0, k, **options).collect())


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)]
    rows += [(200, None), (204, [0.0] * 4), (208, [float("nan"), 1.0, 1.0, 1.0]), (212, [float("inf")] * 4), (216, [None, 1.0, 1.0, 1.0]), (220, []), (None, [1.0] * 4), (224, [1.0, 2.0]), (228, [3.0, 1.0]), (3, rows[3][1])]
    rows += [(300 + i, [2.0, 2.0, 1.0, 1.0]) for i in range(40)]
    assert run(spark, rows) == brute(rows, 5, 4)


def test_fewer_candidates_and_empty_tables(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [0.5, 0.0])]
    assert run(spark, rows) == brute(rows, 5, 4)
    assert run(spark, rows[:1]) == [] and run(spark, []) == []


def test_recall_of_graphs_on_lengths_that_differ(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(4000, 24)) * rng.uniform(0.5, 2, (4000, 1))).astype(np.float32)
    x[1000:1400] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = run(spark, rows, 10, 100, min_shards=3)
    want = brute(rows, 10, 100)
    assert len(got) == len(want)
    assert len({r[:1] + r[2:3] for r in got} & {r[:1] + r[2:3] for r in want}) >= 0.95 * len(want)


def test_graphs_of_few_hundred_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 16)).astype(np.float32))]
    for shards in (1, 2):
        got, want = run(spark, rows, 10, 10, min_shards=shards), brute(rows, 10, 10)
        assert len(got) == len(want) and len({r[:1] + r[2:3] for r in got} & {r[:1] + r[2:3] for r in want}) >= 0.95 * len(want)


def test_long_vectors_get_more_shards(spark, monkeypatch):
    seen = []
    index = ann._index
    monkeypatch.setattr(ann, "_index", lambda points, shards, m: seen.append(shards) or index(points, shards, m))
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(5).normal(size=(200, 100)).astype(np.float32))]
    assert len(run(spark, rows, 5, 20, shard_bytes=30_000)) == 50 and seen == [10]


def test_several_vectors_under_one_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [5.0, 0.0]), (2, [0.0, 1.0]), (0, [0.0, 2.0])]
    assert [(q, c, s) for q, _, c, s in run(spark, rows)] == [(0, 1, 5.0), (0, 2, 2.0)]


def test_query_recall(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op6_ann(spark, d).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = brute(rows, 20, 20)
    assert len(got) == len(want)
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found & {(w[0], w[2]) for w in want}) >= 0.95 * len(want)


def test_every_node_is_reached():
    x = np.random.default_rng(3).normal(size=(700, 8))
    graph, row = hnsw.build(x)
    assert sorted(row) == list(range(700))
    ids = hnsw.search(graph, x[row], 1, 60)
    assert (ids[:, 0] >= 0).all()
