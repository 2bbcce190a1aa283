"""Queries on steadiness and on a whole campaign."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchloom.operators import stationary, stats
from benchloom.operators.campaign import Campaign, Measure, Session, Source
from benchloom.plans.files import _place
from benchloom.plans.recordings import events
from benchloom.plans.steps import _GRID, _H, INSIDE, ROBUST_PARTS, ROBUST_SQL, STEPS, inside, step_table
from benchloom.registry import query

_Z95 = 1.6448536269514722


@query("window_stationary", f"SELECT step_id, halves_diff, stationary FROM ({ROBUST_SQL})")
def window_stationary(spark, d):
    return stats.robust(inside(spark, d), ["step_id"], "t", "value", "s0", "s1").select("step_id", "halves_diff", "stationary")


@query("window_equivalence", f"SELECT step_id, slope - {_Z95} * se > -2e-4 AND slope + {_Z95} * se < 2e-4 AS equivalent FROM (SELECT step_id, slope_se_eff_e6 / 1e6 AS se, m AS slope FROM ({ROBUST_SQL}) JOIN (SELECT step_id, regr_slope(value, t - s0) AS m FROM {INSIDE} GROUP BY 1) USING (step_id))")
def window_equivalence(spark, d):
    rows = inside(spark, d)
    line = stats.slope(rows, ["step_id"], "t", "value", "s0").select("step_id", "slope")
    both = stats.robust(rows, ["step_id"], "t", "value", "s0", "s1").select("step_id", "slope_se_eff").join(line, "step_id")
    return both.select("step_id", stationary.equivalent(F.col("slope"), F.col("slope_se_eff"), 2e-4).alias("equivalent"))


_CHECKED = f"(SELECT step_id, count(*) FILTER (WHERE value <= 100) AS n, count(*) FILTER (WHERE value > 100) AS x, any_value(s1 - s0) AS window_s, stddev_samp(value) FILTER (WHERE value <= 100) AS sd FROM {INSIDE} GROUP BY 1)"


@query("window_counts", f"SELECT step_id, n, x AS n_excluded, CAST(0 AS BIGINT) AS n_missing, window_s FROM {_CHECKED}")
def window_counts(spark, d):
    rows = inside(spark, d).withColumn("out", F.col("value") > 100)
    return stats.counts(rows, ["step_id"], "value", "s0", "s1", "out")


@query("window_checks", f"SELECT step_id, list_filter([CASE WHEN n = 0 THEN 'no data in the window' END, CASE WHEN n BETWEEN 1 AND 4 THEN 'only ' || n || ' points (min 5)' END, CASE WHEN x > 0 THEN x || ' points excluded by flags' END, CASE WHEN n > 0 AND sd = 0 THEN 'constant values in the window (quantized or frozen?)' END], lambda c: c IS NOT NULL) AS checks, CASE WHEN n < 5 THEN 'fail' WHEN x > 0 OR n > 0 AND sd = 0 THEN 'warn' ELSE 'ok' END AS level, CASE WHEN n > 2 THEN 6 ELSE 5 END AS n_assumptions FROM {_CHECKED}")
def window_checks(spark, d):
    rows = inside(spark, d).withColumn("out", F.col("value") > 100)
    sd = rows.filter("not out").groupBy("step_id").agg(F.stddev_samp("value").alias("sd"))
    table = stats.counts(rows, ["step_id"], "value", "s0", "s1", "out").join(sd, "step_id", "left")
    table = table.withColumn("c", stationary.checks(F.col("n"), F.lit(1.0), F.col("n_excluded"), F.col("n_missing"), F.col("sd")))
    why = stationary.assumptions(["spike"], None, 0.0, F.col("n") > 2)
    return table.select("step_id", F.transform("c", lambda x: x["text"]).alias("checks"), stationary.level(F.col("c")).alias("level"), F.size(why).alias("n_assumptions"))


_Z = stationary.z(0.9875)


@query("window_findings", f"""{ROBUST_PARTS} SELECT step_id, coalesce(abs(m) > {_Z!r} * eff, false) AS drift, coalesce(CASE WHEN u > 0 THEN abs(diff) > {_Z!r} * u ELSE diff <> 0 END, false) AS halves, coalesce(abs(m - ts) > (hi - lo) / {stationary.z(0.975)!r}, false) AS outliers,
  CASE WHEN eff IS NULL OR m IS NULL THEN 'untested' WHEN m - {_Z95} * eff > -2e-4 AND m + {_Z95} * eff < 2e-4 THEN 'steady' ELSE 'not steady' END AS practical FROM o""")
def window_findings(spark, d):
    """What the course of each window gives to look at; texts are told apart by how they begin."""
    rows, key = inside(spark, d), ["step_id"]
    known = stats.robust(rows, key, "t", "value", "s0", "s1").join(stats.slope(rows, key, "t", "value", "s0"), "step_id").join(stats.counts(rows, key, "value", "s0", "s1"), "step_id")
    trend = stationary.Trend(*[F.col(c) for c in ("slope", "slope_se_eff", "slope_theil_sen", "ts_ci_low", "ts_ci_high", "halves_diff", "halves_u", "window_s")])
    none = F.lit(0)
    df = known.withColumn("c", stationary.checks(F.col("n"), F.lit(1.0), none, none, F.lit(None).cast("double"), trend=trend, delta=2e-4))
    begins = lambda text: F.exists("c", lambda x: x["text"].startswith(text))
    practical = F.when(begins("practical steadiness"), "untested").when(begins("not steady"), "not steady").otherwise("steady")
    return df.select("step_id", begins("drift: slope").alias("drift"), begins("drift: the second").alias("halves"), begins("straight line").alias("outliers"), practical.alias("practical"))


def _session(spark, d, measures: dict[str, Measure]) -> Session:
    """A campaign whose one source is the recording of events."""
    path = _place(spark, "recording.parquet")
    events(spark, d).select("user_id", "row", "us", "value").write.parquet(path)
    return Session(spark, Campaign({"rec": Source(path, "us", ["value"], ["user_id"], "row", derived={"double": "2 * value"})}, measures))


def _step_rows(spark, d):
    return step_table(spark, d).select("user_id", "step_id", F.col("s0").alias("start"), F.col("s1").alias("end"))


_LATE = f"(SELECT w.step_id, s.value FROM (SELECT * FROM {STEPS} WHERE s1 > s0 + 3600) w LEFT JOIN (SELECT user_id, epoch_us(ts) / 1e6 AS t, value FROM events) s ON s.user_id = w.user_id AND s.t >= w.s0 + 3600 AND s.t <= w.s1)"


@query("window_measures", f"""SELECT step_id, 'level' AS measure, count(*) AS n, avg(value) AS value FROM {INSIDE} GROUP BY 1 UNION ALL SELECT step_id, 'points', count(*), count(*) FROM {INSIDE} GROUP BY 1 UNION ALL SELECT step_id, 'top', count(*), max(2 * value) FROM {INSIDE} GROUP BY 1
  UNION ALL SELECT step_id, 'late', count(value), median(value) FROM {_LATE} GROUP BY 1""")
def window_measures(spark, d):
    """Four measures of every step, two of them of a calculated channel or a shorter window, in one pass over the source."""
    s = _session(spark, d, {"level": Measure("value"), "points": Measure("value", "n"), "top": Measure("double", "max"), "late": Measure("value", "median", skip_start=3600.0)})
    return s.window_table(_step_rows(spark, d), ["user_id"]).select("step_id", "measure", "n", "value")


@query("step_statistics", f"WITH one AS (SELECT * FROM {INSIDE} WHERE step_id = (SELECT min(step_id) FROM {STEPS})) SELECT 'n' AS stat, CAST(count(*) AS DOUBLE) AS value FROM one UNION ALL SELECT 'mean', avg(value) FROM one UNION ALL SELECT 'sd', stddev_samp(value) FROM one UNION ALL SELECT 'max', max(value) FROM one UNION ALL SELECT 'slope', regr_slope(value, t - s0) FROM one")
def step_statistics(spark, d):
    """All statistics of the first step's window; some of them have a twin."""
    table = _step_rows(spark, d)
    first = table.agg(F.min("step_id")).first()[0]
    return _session(spark, d, {}).window_stats(table, ["user_id"], first, "rec", "value").filter("stat in ('n', 'mean', 'sd', 'max', 'slope')").select("stat", "value")


_LAGS = f"""(SELECT user_id, l, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(x) * count(*) > 1e-6 AND var_pop(y) * count(*) > 1e-6 THEN corr(x, y) END AS r FROM
  (SELECT a.user_id, a.value AS x, b.value AS y, b.k - a.k AS l FROM g a JOIN (SELECT user_id, k + 3 AS k, value FROM g) b ON a.user_id = b.user_id AND b.k - a.k BETWEEN -24 AND 24) GROUP BY 1, 2)"""


@query("cross_correlation", f"""WITH g AS MATERIALIZED (SELECT user_id, grid_us // {_H} AS k, value FROM {_GRID} WHERE value IS NOT NULL), c AS MATERIALIZED {_LAGS}, s AS (SELECT user_id, count(*) AS short FROM g GROUP BY 1),
b AS (SELECT user_id, any_value(short) AS short, arg_max(l, r) AS k, max(r) AS r, arg_max(n, r) AS n FROM c JOIN s USING (user_id) WHERE n >= 0.5 * short AND r IS NOT NULL GROUP BY 1)
SELECT b.user_id, b.k + CASE WHEN x.r - 2 * b.r + y.r < 0 THEN 0.5 * (x.r - y.r) / (x.r - 2 * b.r + y.r) ELSE 0 END AS lag, b.r, b.n / short AS overlap FROM b LEFT JOIN c x ON x.user_id = b.user_id AND x.l = b.k - 1 LEFT JOIN c y ON y.user_id = b.user_id AND y.l = b.k + 1""")
def cross_correlation(spark, d):
    """Clock offset of each user's signal against itself, three grid steps late; the tests hold curves against NumPy, and checks."""
    from benchloom.operators import align, sync
    from benchloom.plans.recordings import recording

    g = align.resample(recording(spark, d), "value", _H, 48 * _H).filter("value is not null").select("user_id", F.floor(F.col("grid_us") / _H).alias("k"), "value")
    return sync.cross_correlate(g, g.withColumn("k", F.col("k") + 3), ["user_id"], "k", "value", 24).select("user_id", "lag", "r", "overlap")
