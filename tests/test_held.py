import random

import pytest
from pyspark.sql import functions as F

from benchloom.operators import held

NAN = float("nan")


def plain(values, tolerance, last=None):
    out = []
    for v in values:
        out.append(v is not None and held.moves(v, last, tolerance))
        last = v if out[-1] else last
    return out, last


def series(r, kind, n):
    if kind == "walk":
        v, out = r.choice([1.0, -1.0, 0.0, 100.0]), []
        for _ in range(n):
            v += r.gauss(0, 0.02)
            out.append(v)
        return out
    if kind == "ramp":
        return [1 + 1e-3 * i for i in range(n)]
    if kind == "falling":
        return [-1 - 1e-3 * i for i in range(n)]
    if kind == "ulps":
        return [1 + r.randint(-3, 3) * 1.1e-16 + r.randint(0, 1) * 0.1 for _ in range(n)]
    return [r.choice([NAN, 0.0, 1.0, 1.05, 1.1, -1.0, -1.05, 5.0]) for _ in range(n)]


@pytest.mark.parametrize("kind", ["walk", "ramp", "falling", "ulps", "mixed"])
@pytest.mark.parametrize("tolerance", [0.0, 1e-5, 0.01, 0.1, 0.3, 1.0, 1.5])
def test_summaries_stand_for_chunks(kind, tolerance):
    r = random.Random(f"{kind}{tolerance}")
    for _ in range(40):
        values = series(r, kind, r.randint(0, 60))
        firsts, ends = held.summary(values, tolerance)
        for last in (None, 0.0, 1.0, -1.0, 1.1, 0.9, *(v * (1 + s * tolerance) for v in values[:5] if v == v for s in (-1, 0, 1, -1.0000001, 0.9999999))):
            assert held.carry(last, firsts, ends, tolerance) == plain(values, tolerance, last)[1]


def test_summaries_are_short():
    r = random.Random(3)
    assert max(len(held.summary(series(r, "walk", 20_000), 0.01)[0]) for _ in range(5)) < 400  # of 20,000
    assert len(held.summary([7.0] * 1000, 1e-5)[0]) == 1


def test_one_long_group_in_many_tasks(spark):
    r = random.Random(5)
    walk, flat = series(r, "walk", 3000), [None if i % 7 == 0 else 5.0 for i in range(900)]
    rows = [("a", i, v) for i, v in enumerate(walk)] + [(None, i * i, v) for i, v in enumerate(flat)] + [("c", 1, 2.0), ("d", None, 3.0)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, t long, v double").repartition(5)
    out = held.changed(df, ["g"], "t", "v", 0.05, chunk_rows=100)
    assert out.columns == ["g", "t", "v", "changed"]
    got = {(x.g, x.t): x.changed for x in out.collect()}
    for g, values, at in (("a", walk, lambda i: i), (None, flat, lambda i: i * i), ("c", [2.0], lambda i: 1), ("d", [3.0], lambda i: None)):
        assert [got[g, at(i)] for i in range(len(values))] == plain(values, 0.05)[0]
    wide = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = held.changed(df.filter("g = 'a'"), ["g"], "t", "v", 0.05, chunk_rows=100).groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) == 4 and max(p["count"] for p in parts) < 2000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", wide)
    assert held.changed(df.limit(0), ["g"], "t", "v").count() == 0
    assert held.changed(df.filter("g = 'a'").drop("g"), [], "t", "v", 0.05, chunk_rows=100).filter("changed").count() == sum(plain(walk, 0.05)[0])
