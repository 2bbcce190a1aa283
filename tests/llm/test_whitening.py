import math

import numpy as np
import pytest

from benchloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n string, whitened double"


def brute(rows, k=8):
    """All of it by the covariance matrix, sums in Python's integers."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    z = [[n * r[j] - s[j] for j in range(d)] for r in x]
    c = np.array(z, dtype=np.float64) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [i for i, _ in kept], [sum(a * a for a in r) for r in z], c @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


def check(out, rows, k=8):
    ids, deviation, white, share = brute(rows, k)
    got = {(r.vec_id, r.component): r for r in out.collect()}
    assert len(got) == len(ids) * white.shape[1]
    for j in range(white.shape[1]):
        ours = np.array([got[i, j + 1].whitened for i in ids])
        sign = np.sign(ours @ white[:, j])
        assert np.abs(ours * sign - white[:, j]).max() < 1e-8
        assert abs(got[ids[0], j + 1].explained / share[j] - 1) < 1e-9
    assert all(got[i, 1].deviation == s and got[i, 1].n == len(ids) and got[i, 1].identity_error < 1e-9 for i, s in zip(ids, deviation))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("d", [2, 20, 70])
def test_against_the_covariance_matrix(spark, d):
    r = np.random.default_rng(d)
    v = r.standard_normal((300, d)) * np.linspace(1, 2, d)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    rows += [(1000, rows[0][1]), (1001, None), (1002, [None] * d), (1003, [float("nan")] * d), (1004, [float("inf")] * d), (1005, []), (1006, [0.0] * d), (1007, [1e30] * d), (1008, [1.0])]
    check(whitening.components(frame(spark, rows)), [x for x in rows if x[0] not in (1007, 1008)])


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(queries.op13_whitening(spark, d), rows)


def test_restarts_of_a_small_basis_find_the_same(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(r.standard_normal((400, 48)) * np.linspace(1, 3, 48))]
    df = whitening.usable(frame(spark, rows)).cache()
    few, all_ = whitening.fit(df, k=3, block=4, basis=16), whitening.fit(df, k=3, block=48)
    assert few.passes > 3 and all_.passes == 2
    assert np.abs(few.components - all_.components).max() < 1e-8 and np.allclose(few.values, all_.values, rtol=1e-12)
    with pytest.raises(RuntimeError):
        whitening.fit(df, k=3, block=4, basis=16, max_passes=2)


def test_fewer_directions_and_large_entries(spark):
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(40)]
    out = whitening.components(frame(spark, line)).collect()
    assert {r.component for r in out} == {1} and abs(out[0].explained - 1) < 1e-12
    assert whitening.components(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.components(frame(spark, [(1, None)])).count() == 0
    # Sums and squares beyond longs: exact as decimals, and coordinates stay right.
    wide = [(i, [float((-1) ** i * 2.0**40 * (1 + i % 3)), float(i)]) for i in range(10)]
    rows, model = whitening.whiten(frame(spark, wide))
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in wide]
    s = [sum(r[j] for r in x) for j in range(2)]
    want = {i: sum((10 * x[i][j] - s[j]) ** 2 for j in range(2)) for i in range(10)}
    assert model.sums == s and {r.vec_id: int(r.deviation) for r in rows.collect()} == want
    assert rows.columns == ["vec_id", "embedding", "n", "whitened", "whitened_", "deviation"]
