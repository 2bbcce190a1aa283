"""Operators without an SQL twin against plain loops, and edge cases of formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchloom import registry
from benchloom.functions import formula, ieee
from benchloom.operators import analyses, held, quality, reshape, stats, steps
from benchloom.operators.recording import Recording
from benchloom.plans.steps import inside
from benchloom.streaming import live

registry.load()
D = "/root/testdata/sf0.001"


def record(spark, values, step=1.0):
    rows = [("a", i, int(i * step * 1e6), None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "s string, row long, us long, v double")
    return Recording(df, ("s",), ("s",), "row", "us", ("v",))


def test_jump_and_dropout(spark):
    rec = record(spark, [1, 1, 9, 9, 1, 1, 20, 20, 20, None, 1])
    seg = quality.with_segments(rec)
    flags = {(r.row, r.flag) for r in quality.jump_flags(seg, rec, "v", 3, 2.5).collect()}
    assert flags == {(2, "dropout"), (3, "dropout"), (6, "jump"), (10, "jump")}
    flags = {(r.row, r.flag) for r in quality.jump_flags(seg, rec, "v", 3, 60).collect()}
    assert flags == {(2, "dropout"), (3, "dropout"), (6, "dropout"), (7, "dropout"), (8, "dropout")}


def test_one_slow_sample_is_one_gap(spark):
    rec = record(spark, range(10))
    late = rec.with_df(rec.df.withColumn("us", F.col("us") + F.when(F.col("row") >= 6, 20_000_000).otherwise(0)))
    assert [r.row for r in quality.gap_flags(quality.with_segments(late), late).collect()] == [6]


@pytest.mark.parametrize(("seconds", "n"), [(30, 0), (10, 20)])
def test_stuck_lasts_long_enough(spark, seconds, n):
    rec = record(spark, [*range(5), *[7] * 20, *range(5)])
    assert quality.stuck_flags(quality.with_segments(rec), rec, "v", seconds).count() == n


def test_changed_moves_only_when_accepted(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.05, 1.1, 1.2, None, 1.25])], "g string, t long, v double")
    got = [r.changed for r in held.changed(df, ["g"], "t", "v", 0.1).orderBy("t").collect()]
    assert got == [True, False, False, True, False, False]


@pytest.mark.parametrize(("linear", "value"), [(False, 20.0), (True, 8.0)])
def test_references_on_both_sides(spark, linear, value):
    df = spark.createDataFrame([("a", 0, 0.0, 10.0, 0.0, True), ("a", 1, 12.0, 16.0, 5.0, False), ("a", 2, 30.0, 40.0, 40.0, True)], "m string, row long, s double, e double, v double, is_ref boolean")
    rows = {r.row: r for r in steps.nearest_reference(df, ["m"], "row", "s", "e", "v", F.col("is_ref"), linear=linear).collect()}
    assert rows[1].ref_kind == "both" and (rows[1].ref_before, rows[1].ref_after) == (0, 2)
    assert rows[1].ref == pytest.approx(value) and rows[1].u_ref == pytest.approx(40 / (2 * 3**0.5)) and rows[0].ref_kind == "one"


@pytest.mark.parametrize(("raw", "clean"), [("Kanal (1) [°C]", "kanal_1"), ("Letzte Wert Druck", "druck"), ("Größe", "groesse"), ("", "time"), ("{x}", "time"), ("\ufeffA-b", "a_b")])
def test_clean_names(raw, clean):
    assert reshape.clean_name(raw) == clean


def test_claims_are_greedy_and_unique(spark):
    s = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, 50.0)], "g string, step_id long, start double")
    r = spark.createDataFrame([("a", 10, 0.9), ("a", 11, 3.0), ("a", 12, 100.0)], "g string, row_id long, time double")
    got = {(x.step_id, x.row_id) for x in steps.claim_rows(s, r, ["g"], 5).collect()}
    assert got == {(1, 10), (2, 11)}


def test_robust_statistics(spark):
    rows = inside(spark, D)
    got = {r.step_id: r for r in stats.robust(rows, ["step_id"], "t", "value", "s0", "s1").collect()}
    by = {}
    for r in rows.collect():
        by.setdefault(r.step_id, []).append((r.t - r.s0, r.value))
    assert set(got) == set(by)
    for key, points in by.items():
        points.sort()
        s = [(b[1] - a[1]) / (b[0] - a[0]) for i, a in enumerate(points) for b in points[i + 1 :] if a[0] != b[0]]
        if len(points) > 2 and s:
            assert got[key].slope_theil_sen == pytest.approx(float(np.median(s)))


def test_newey_west_by_loop():
    rng = np.random.default_rng(1)
    x, y = np.arange(80.0), rng.normal(size=80).cumsum()
    n, c = 80, np.arange(80.0) - 39.5
    m = (c * y).sum() / (c * c).sum()
    g = [c[i] * (y[i] - y.mean() - m * c[i]) for i in range(n)]
    lags = int(4 * (n / 100) ** (2 / 9))
    total = sum(v * v for v in g) + 2 * sum((1 - k / (lags + 1)) * sum(g[i] * g[i - k] for i in range(k, n)) for k in range(1, lags + 1))
    assert stats.hac_slope_se(x, y) == pytest.approx(math.sqrt(total * n / (n - 2)) / (c * c).sum())


def test_straight_line_with_errors_in_both_axes(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 10, 30)
    rows = [("a", float(a), float(2 * a + 1 + e), 0.1, 0.3) for a, e in zip(x, rng.normal(0, 0.3, 30))]
    r = analyses.fit_line(spark.createDataFrame(rows, "g string, x double, y double, ux double, uy double"), ["g"], "x", "y", "ux", "uy").first()
    xs, ys = np.array([p[1] for p in rows]), np.array([p[2] for p in rows])
    m = np.polyfit(xs, ys, 1)[0]
    for _ in range(5):
        w = 1 / (0.3**2 + (m * 0.1) ** 2) * np.ones(30)
        det = w.sum() * (w * xs * xs).sum() - (w * xs).sum() ** 2
        m, b = (w.sum() * (w * xs * ys).sum() - (w * xs).sum() * (w * ys).sum()) / det, ((w * xs * xs).sum() * (w * ys).sum() - (w * xs).sum() * (w * xs * ys).sum()) / det
    assert (r.m, r.b) == (pytest.approx(m), pytest.approx(b))
    gls = analyses.fit_gls(xs, ys, np.eye(30) * 0.01, np.eye(30) * 0.09)
    assert gls["m"] == pytest.approx(r.m) and gls["chi2_red"] == pytest.approx(r.chi2_red)


def test_monte_carlo_agrees_with_the_crossing(spark):
    df = spark.createDataFrame([("a", i, float(i), i * 10.0, 1.0) for i in range(20)], "g string, k long, x double, y double, u double")
    r = analyses.monte_carlo_crossing(df, ["g"], "k", "x", "y", "u", 95).first()
    assert r["mean"] == pytest.approx(9.5, abs=0.02) and 0.05 < r["sd"] < 0.15


CASES = [
    ("1 / 0", math.inf), ("-1 / 0", -math.inf), ("0 / 0", math.nan), ("nan == nan", 0), ("nan != nan", 1), ("nan < 1", 0), ("log(0)", -math.inf), ("log(-1)", math.nan), ("sqrt(-1)", math.nan), ("min(1, nan)", math.nan),
    ("1 < 2 < 3", 1), ("1 < 2 > 3", 0), ("not 0", 1), ("2 if nan else 3", 2), ("round(2.5)", 2), ("round(125, -1)", 120), ("a + b", None), ("isfinite(inf)", 0), ("2 − 3 × 4", -10), ("-2 ** 2", -4), ("b == 'x'", 0), ("t == 'x'", 1), ("t != 'y'", 1), ("max(a, 5, 2)", 5),
]


@pytest.mark.parametrize(("text", "value"), CASES)
def test_formula_values(spark, text, value):
    df = spark.createDataFrame([(1.0, None, "x")], "a double, b double, t string")
    got = df.select(formula.compile_formula(text, df).alias("v")).first().v
    assert got is value if value is None else got == pytest.approx(value, nan_ok=True)


@pytest.mark.parametrize("text", ["", "1 +", "a b", "a // b", "a[0]", "lambda: 1", "f(1)", "log(1, 2)", "__import__('os')", "a.b.c()", "'x'", "'x' + 1", "'a' < 'b'", "round(a, a)", "x := 1", "a if b", "[1]", "max()", "unknown + 1", "min(*a)", "log(a=1)"])
def test_formulas_that_are_none(text):
    with pytest.raises(formula.FormulaError):
        formula.parse(text, {"a", "b"})
    with pytest.raises(formula.FormulaError, match="did you mean 'temperature'"):
        formula.parse("temprature * 2", {"temperature"})


@pytest.mark.parametrize("text", ["a * b / (a + 1)", "a ** b", "log(a) * exp(b)", "log10(a) + sqrt(a * b)", "abs(a - 5) * b", "a if a > b else b * b", "max(a, b * 2) + min(a, 3)", "round(a) * a", "-a + 3 * b"])
def test_derivatives_match_differences(spark, text):
    df = spark.createDataFrame([(2.3, 1.7)], "a double, b double")
    node = formula.parse(text)
    value = lambda n, **at: df.select(formula.to_column(n, {k: F.lit(v) for k, v in at.items()}).alias("v")).first().v
    for name in ("a", "b"):
        at = {"a": 2.3, "b": 1.7}
        up, down = {**at, name: at[name] + 1e-6}, {**at, name: at[name] - 1e-6}
        assert value(formula.derivative(node, name), **at) == pytest.approx((value(node, **up) - value(node, **down)) / 2e-6, rel=1e-5, abs=1e-6)


def test_filters_take_numbers_other_than_zero(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (math.nan,), (None,)], "x double")
    assert df.filter(ieee.holds(F.col("x"))).count() == 1


def test_streams_give_what_batches_give(spark, tmp_path):
    events = spark.read.parquet(f"{D}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    seen = []
    live.run_available(live.min_max(stream, ["event_type"], "ts", "value", "1 day"), lambda df, i: seen.extend(df.collect()), str(tmp_path / "c"), "complete")
    want = events.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"))
    assert {(r.event_type, r.start, r.low, r.high, r.n) for r in seen} == {(r.event_type, r.w.start, r.low, r.high, r.n) for r in want.collect()}
