"""Small parts that no query names: formulas over arrays, selected runs, names of tables, checks of windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchloom.functions import formula
from benchloom.operators import reshape, runs, stationary, stats
from benchloom.operators.recording import Recording

FORMULAS = ["a * b + 2", "a / (b - 1)", "a ** b", "log(a) + sqrt(b)", "a if a > b else -b", "a < b <= 3", "not a or b", "min(a, b, 2) + max(a, 1)", "round(a * 2.5)", "isfinite(a / b)", "t == 'x'", "abs(-a) + exp(b / 10)", "a and b"]


@pytest.mark.parametrize("text", FORMULAS)
def test_arrays_and_columns_agree(spark, text):
    rows = [(0.0, 1.0, "x"), (2.0, 3.0, "y"), (-1.5, 0.5, "x"), (float("nan"), 2.0, "z"), (4.0, 0.0, "x")]
    df = spark.createDataFrame(rows, "a double, b double, t string")
    ours = [r.v for r in df.select(formula.compile_formula(text, df).alias("v")).collect()]
    env = {"a": np.array([r[0] for r in rows]), "b": np.array([r[1] for r in rows]), "t": np.array([r[2] for r in rows], object)}
    theirs = np.broadcast_to(formula.evaluate(formula.parse(text, set(env)), env), len(rows))
    assert np.allclose(np.array(ours, float), theirs.astype(float), equal_nan=True)


def test_uncertainty_of_a_number():
    value, u = formula.evaluate_with_uncertainty("a * b + c", {"a": (2.0, 0.1), "b": (3.0, 0.2), "c": (1.0, 0.0)})
    assert value == 7.0 and u == pytest.approx(((3 * 0.1) ** 2 + (2 * 0.2) ** 2) ** 0.5)


def test_selected_runs(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), (None, 1, 2)], "run string, us long, row long")
    rec = Recording(df, ("run",), ("run",), "row", "us", ())
    assert [r.row for r in runs.select_run(rec, run="a").df.orderBy("row").collect()] == [0, 1] and runs.select_run(rec, run=None).df.count() == 1
    with pytest.raises(KeyError, match="no run"):
        runs.select_run(rec, run="b")


def test_names_of_a_table(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Zeit [s]` int, `Zeit (min)` int, `last Wert` int")
    assert reshape.clean_names(df).columns == ["zeit", "zeit_1", "col_2"]
    assert reshape.clean_name("last_value") == "last_value" and reshape.clean_name("Kanal (12) Größe") == "kanal_12_groesse"


def test_checks_and_counts_of_windows(spark):
    rows = [(1, float(i), 5.0, 0.0, 10.0, False) for i in range(6)] + [(2, 1.0, None, 0.0, 10.0, False), (2, 2.0, 3.0, 0.0, 10.0, True)]
    df = spark.createDataFrame(rows, "k long, x double, y double, lo double, hi double, out boolean")
    c = {r.k: r for r in stats.counts(df, ["k"], "y", "lo", "hi", "out").collect()}
    assert (c[1].n, c[1].n_excluded, c[1].n_missing, c[1].window_s) == (6, 0, 0, 10.0) and (c[2].n, c[2].n_excluded, c[2].n_missing) == (0, 1, 1)
    found = df.limit(1).select(stationary.checks(F.lit(6), F.lit(0.5), F.lit(0), F.lit(0), F.lit(0.0)).alias("c")).withColumn("level", stationary.level(F.col("c"))).first()
    assert [x.text for x in found.c] == ["coverage 50% below 80%", "constant values in the window (quantized or frozen?)"] and found.level == "warn"
    why = df.limit(1).select(stationary.assumptions([], 0.5, 0.1, F.lit(False)).alias("a")).first().a
    assert why[0] == "left out: rows flagged nothing" and "off by 0.5 s" in why[3] and len(why) == 4
    area = stats.integral(df.filter("k = 1").withColumn("g", F.lit("a")), spark.createDataFrame([("a", 1, 0.5, 3.5), ("a", 2, 100.0, 110.0)], "g string, w long, lo2 double, hi2 double"), ["g"], ["w"], "x", "y", "lo2", "hi2", "x")
    got = {r.w: r for r in area.collect()}
    assert got[1].integral == pytest.approx(15.0) and got[1].coverage == pytest.approx(1.0) and (got[2].integral, got[2].integral_gap_s) == (0.0, 10.0)
