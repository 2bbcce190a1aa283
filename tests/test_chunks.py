"""Windows by chunks, exact quantiles and sliding medians against plain ones; one source fills many tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from benchloom.operators import chunks, quality, quantiles, sliding
from benchloom.operators.recording import Recording


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    t, out = 0, []
    for i in range(3000):
        t += r.choice([1, 1, 1, 2, 60]) * 10**6
        out.append(("hot" if i % 3 else None, i, t, r.choice([None, 1.0, 1.5, r.gauss(5, 2)]), r.choice(["a", "b"])))
    return spark.createDataFrame(out, "s string, row long, us long, x double, run string").cache()


def test_lags_and_sums(rows):
    w = Window.partitionBy("s").orderBy("row")
    c = chunks.by_row(("s",), "row", 97)
    got = c.with_lag(rows, {"a": "x", "b": F.col("us")})
    got = c.with_lag(got, {"c": "x"}, ignore_nulls=True)
    got = chunks.numbered(c.with_running_sum(got, {"d": F.col("x").isNull().cast("long")}), c, "e")
    want = rows.select("*", F.lag("x").over(w).alias("a"), F.lag("us").over(w).alias("b"), F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("c"),
                       F.sum(F.col("x").isNull().cast("long")).over(w).alias("d"), (F.row_number().over(w) - 1).cast("long").alias("e"))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_one_source_is_many_tasks(spark, rows):
    """No window or sort sees more than a chunk: with many partitions, the largest holds a small share of the rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        one = rows.withColumn("s", F.lit("one"))
        got = chunks.by_row(("s",), "row", 97).with_lag(one, {"a": "x"}).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("count"), F.sum("a"))
        assert max(r["count"] for r in got.collect()) < 700
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles(spark, monkeypatch, accuracy):
    """With a sketch of 20 the brackets lie far from the ranks, with ties on both sides."""
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    r = np.random.default_rng(4)
    data = {"n": r.standard_normal(5000), "ties": r.integers(0, 4, 3001).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 4.0]), "log": 10.0 ** r.integers(-200, 200, 999), "same": np.full(500, 2.0)}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("none", None)], "k string, x double")
    got = {x.k: x for x in quantiles.at_ranks(df, ["k"], "x", {"p99": (0.99, quantiles.nearest(0.99)), "p10": (0.1, quantiles.nearest(0.1)), "low": (0.5, quantiles.lower_half)}).collect()}
    assert set(got) == set(data)
    for k, v in data.items():
        v, n = np.sort(v), len(v)
        assert (got[k].n, got[k].p99, got[k].p10, got[k].low) == (n, v[int((n - 1) * 0.99 + 0.5)], v[int((n - 1) * 0.1 + 0.5)], v[(n - 1) // 2]), k
    assert {x.k: x.m for x in quantiles.medians(df, ["k"], "x", "m").collect()} == {k: float(np.median(v)) for k, v in data.items()}


def test_sliding_medians():
    r = random.Random(9)
    for _ in range(60):
        t = np.cumsum([r.choice([0, 1, 1, 3, 40]) for _ in range(r.randrange(1, 80))])
        v = np.array([r.choice([np.nan, 1.0, 2.0, 2.0, r.gauss(0, 9), r.choice([1.0, float("inf")])]) for _ in t])
        for i, got in enumerate(sliding.scan(t, v, 5)):
            w = v[(t >= t[i] - 5) & (t <= t[i] + 5) & ~np.isnan(v)]
            if not len(w):
                assert got is None
            elif np.isfinite(w).all():
                assert got == [np.median(w), np.median(np.abs(w - np.median(w)))]


def test_sliding_blocks_join_without_seams(rows):
    got = sliding.with_median_mad(rows, ["s"], "us", "x", 7 * 10**6).select("row", "med", "mad").collect()
    assert len(got) == rows.count()
    all_ = rows.filter("s is null").orderBy("us").collect()
    t, v = np.array([x.us for x in all_]), np.array([np.nan if x.x is None else x.x for x in all_])
    want = dict(zip((x.row for x in all_), sliding.scan(t, v, 7 * 10**6)))
    assert {x.row: None if x.med is None else [x.med, x.mad] for x in got if x.row in want} == want


def test_detectors_in_small_chunks(spark, rows, monkeypatch):
    """Segments, stuck blocks and thresholds are the same whatever the chunks."""
    rec = Recording(rows.withColumn("s", F.coalesce("s", F.lit("cold"))), ("s",), ("s", "run"), "row", "us", ("x",))

    def all_of():
        seg = quality.with_segments(rec)
        parts = [seg.select("s", "row", "is_gap", "segment"), quality.stuck_flags(seg, rec, "x", 2, 2), quality.jump_threshold(rec, "x"), quality.missing_flags(rec, "x"), quality.jump_candidates(seg, rec, "x", 2.0).select("row", "level", "ordinal", "jumps")]
        return [sorted(map(tuple, p.collect()), key=repr) for p in parts]

    whole = all_of()
    monkeypatch.setattr(chunks, "CHUNK_ROWS", 50)
    assert all_of() == whole and all(map(len, whole))


@pytest.mark.parametrize("n", [1, 2, 3, 49, 50, 51, 64, 101])
def test_ranks_of_small_groups(spark, n):
    df = spark.createDataFrame([("k", float(i)) for i in range(n)], "k string, x double")
    r = quantiles.at_ranks(df, ["k"], "x", {"p99": (0.99, quantiles.nearest(0.99)), "high": (0.5, quantiles.upper_half)}).first()
    assert (r.p99, r.high) == (float(int((n - 1) * 0.99 + 0.5)), float(n // 2))


def test_claims_of_one_group_in_parts(spark):
    """Greedy over the whole group in one loop, against parts that nothing reaches across."""
    from benchloom.operators import steps

    r = random.Random(8)
    starts = sorted((r.choice([0, 500, 5000]) + 10_000 * r.randrange(30) + r.randrange(300), i) for i in range(200))
    times = sorted((10_000 * r.randrange(30) + r.randrange(900), i) for i in range(260))
    taken, want = set(), set()
    for start, step in starts:
        near = [(abs(t - start), k) for k, (t, _) in enumerate(times) if abs(t - start) <= 240 and k not in taken]
        if near:
            taken.add(min(near)[1])
            want.add((step, times[min(near)[1]][1]))
    a = spark.createDataFrame([("g", i, float(t)) for t, i in starts], "g string, step_id long, start double")
    b = spark.createDataFrame([("g", i, float(t)) for t, i in times], "g string, row_id long, time double")
    got = steps.claim_rows(a, b, ["g"])
    assert {(x.step_id, x.row_id) for x in got.collect()} == want and got.columns == ["g", "step_id", "row_id"]
