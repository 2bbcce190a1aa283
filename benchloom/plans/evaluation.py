"""Queries over step tables: calculations, criteria, analyses and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchloom.operators import analyses, evaluate, stats, views
from benchloom.operators.evaluate import Input
from benchloom.plans.recordings import events
from benchloom.plans.steps import INSIDE, SAMPLES, STEPS, inside, samples, step_table
from benchloom.registry import query
from benchloom.rounding import rounded

CALCULATIONS = {"rate": "amount / hours * k", "share": "rate / (rate + zero)", "bounded": "min(rate, 100) if hours > 1 else rate"}


def _inputs():
    hours = (F.col("s1") - F.col("s0")) / 3600
    return {
        "amount": Input(F.col("amount"), F.lit(0.5)), "hours": Input(hours, F.lit(0.01), "systematic", "clock"),
        "k": Input(F.lit(1.2), F.lit(0.05), "systematic", "scale"), "zero": Input(F.lit(10.0), F.lit(0.2), "systematic", "scale"),
    }


_BASE = f"(SELECT step_id, amount, (s1 - s0) / 3600 AS h, s0, s1, user_id FROM {STEPS})"
_RATE = f"(SELECT *, amount / h * 1.2 AS rate, 1.2 / h * 0.5 AS ra, -amount * 1.2 / (h * h) * 0.01 AS rh, amount / h * 0.05 AS rk FROM {_BASE})"


@query("uncertainty_budget", f"""SELECT step_id, rate, sqrt(ra * ra + rh * rh + rk * rk) AS u_rate, abs(ra) AS u_rate_random, sqrt(rh * rh + rk * rk) AS u_rate_systematic, share, g * 0.05 * (amount / h) + g2 * 0.2 AS scale_part,
  sqrt(pow(g * ra, 2) + pow(g * rh, 2) + pow(g * rk + g2 * 0.2, 2)) AS u_share FROM (SELECT *, rate / (rate + 10) AS share, 10 / pow(rate + 10, 2) AS g, -rate / pow(rate + 10, 2) AS g2 FROM {_RATE})""")
def uncertainty_budget(spark, d):
    out = evaluate.calculate(step_table(spark, d), CALCULATIONS, _inputs())
    return out.select("step_id", "rate", "u_rate", "u_rate_random", "u_rate_systematic", "share", "u_share", (F.col("b_share__k") + F.col("b_share__zero")).alias("scale_part"))


@query("budget_shares", f"SELECT step_id, unnest(['amount', 'hours', 'k']) AS input, unnest([ra * ra, rh * rh, rk * rk]) / (ra * ra + rh * rh + rk * rk) AS share FROM {_RATE} WHERE amount > 0")
def budget_shares(spark, d):
    out = evaluate.calculate(step_table(spark, d).filter("amount > 0"), {"rate": CALCULATIONS["rate"]}, _inputs())
    return evaluate.shares(out, "rate").select("step_id", "input", "share")


@query("criteria_rating", f"""SELECT step_id, big, quick, fine, CASE WHEN big AND quick THEN 'good' WHEN big OR quick THEN 'fair' WHEN NOT (big OR quick) THEN 'poor' END AS rating, array_to_string(list_filter([CASE WHEN NOT big THEN 'too little' END, CASE WHEN NOT quick THEN 'too slow' END], lambda x: x IS NOT NULL), '; ') AS reason
FROM (SELECT step_id, amount > 40 AS big, h < 60 AS quick, amount > 40 AND h < 60 AS fine FROM {_BASE})""")
def criteria_rating(spark, d):
    s = step_table(spark, d).withColumn("h", (F.col("s1") - F.col("s0")) / 3600)
    s = evaluate.criteria(s, {"big": "amount > 40", "quick": "h < 60", "fine": "big and quick"})
    out = evaluate.rate(s, [("good", "all", ["big", "quick"]), ("fair", "any", ["big", "quick"]), ("poor", "none", ["big", "quick"])], {"big": "too little", "quick": "too slow"})
    return out.select("step_id", "big", "quick", "fine", "rating", "reason")


@query("scenario_compare", f"SELECT step_id, 'base' AS scenario, rate FROM {_RATE} UNION ALL SELECT step_id, 'double', rate * 2 FROM {_RATE}")
def scenario_compare(spark, d):
    return evaluate.scenarios(step_table(spark, d), {"rate": CALCULATIONS["rate"]}, _inputs(), {"base": {}, "double": {"k": 2.4}}, ["step_id"])


@query("measure_priority", f"""WITH c AS (SELECT i.step_id, s.event_type AS source, avg(s.value) AS mean, count(*) AS n FROM {INSIDE} i JOIN {SAMPLES} s ON i.user_id = s.user_id AND i.row = s.row GROUP BY 1, 2)
SELECT step_id, arg_min(mean, p) AS mean, arg_min(source, p) AS source FROM (SELECT *, CASE source WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 END AS p FROM c) WHERE p IS NOT NULL AND n >= 2 GROUP BY 1""")
def measure_priority(spark, d):
    rows = stats.in_windows(samples(spark, d).select("user_id", "t", "value", "event_type"), step_table(spark, d).select("user_id", "step_id", "s0", "s1"), ["user_id"], "t", "s0", "s1")
    by = rows.groupBy("step_id", F.col("event_type").alias("source")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return evaluate.first_source(by, ["step_id"], "source", "mean", ["view", "click", "error"], "n", 2)


@query("best_source", f"SELECT step_id, source, n FROM (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY n DESC, source) AS r FROM (SELECT i.step_id, s.event_type AS source, count(*) AS n FROM {INSIDE} i JOIN {SAMPLES} s ON i.user_id = s.user_id AND i.row = s.row GROUP BY 1, 2)) WHERE r = 1")
def best_source(spark, d):
    rows = stats.in_windows(samples(spark, d).select("user_id", "t", "event_type"), step_table(spark, d).select("user_id", "step_id", "s0", "s1"), ["user_id"], "t", "s0", "s1")
    return views.best_source(rows.groupBy("step_id", F.col("event_type").alias("source")).agg(F.count("*").alias("n")), ["step_id"], "source", "n")


@query("step_results", f"""SELECT s.step_id, s1 - s0 AS duration_s, l.mean, l.n, l.mean / amount AS ratio FROM {STEPS} s LEFT JOIN (SELECT step_id, avg(value) AS mean, count(value) AS n FROM {INSIDE} GROUP BY 1) l USING (step_id) WHERE amount > 1""")
def step_results(spark, d):
    s = step_table(spark, d).filter("amount > 1")
    loc = stats.location(inside(spark, d), ["step_id"], "value").select("step_id", "mean", "n")
    return s.join(loc, "step_id", "left").select("step_id", (F.col("s1") - F.col("s0")).alias("duration_s"), "mean", "n", (F.col("mean") / F.col("amount")).alias("ratio"))


_CURVE = f"(SELECT user_id, us / 1e6 AS x, sum(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS y, 0.1 * value AS u FROM (SELECT *, epoch_us(ts) AS us FROM events))"


def _curve(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, d).select("user_id", (F.col("us") / 1e6).alias("x"), F.sum("value").over(w).alias("y"), (0.1 * F.col("value")).alias("u"))


def _cross_sql(y: str) -> str:
    return f"(SELECT user_id, count(*) AS n, arg_min(x + (500 - y) * (x1 - x) / (y1 - y), x) FILTER (WHERE (y - 500) * (y1 - 500) <= 0 AND y <> y1) AS c FROM (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM (SELECT user_id, x, {y} AS y FROM {_CURVE}) WINDOW w AS (PARTITION BY user_id ORDER BY x, y)) GROUP BY 1)"


@query("level_crossing", f"SELECT m.user_id, m.n, round(m.c, 4) AS x_cross, round(least(a.c, b.c), 4) AS x_low, round(greatest(a.c, b.c), 4) AS x_high FROM {_cross_sql('y')} m JOIN {_cross_sql('y - u')} a USING (user_id) JOIN {_cross_sql('y + u')} b USING (user_id)")
def level_crossing(spark, d):
    out = analyses.crossing_range(_curve(spark, d), ["user_id"], "x", "y", "u", 500)
    return out.select("user_id", "n", *[rounded(c, 4).alias(c) for c in ("x_cross", "x_low", "x_high")])


def _fit_sql(rounds: int) -> str:
    """Effective-variance rounds, each a query over the one before it."""
    line = "SELECT l_suppkey AS k, regr_slope(l_extendedprice, l_quantity) AS m FROM lineitem GROUP BY 1"
    for _ in range(rounds):
        line = f"""SELECT *, (w * wxy - wx * wy) / (w * wxx - wx * wx) AS m, (wxx * wy - wx * wxy) / (w * wxx - wx * wx) AS b FROM (SELECT k, count(*) AS n, sum(p) AS w, sum(p * x) AS wx, sum(p * y) AS wy, sum(p * x * x) AS wxx, sum(p * x * y) AS wxy, sum(p * y * y) AS wyy FROM
          (SELECT k, l_quantity AS x, l_extendedprice AS y, 1 / (pow(0.02 * l_extendedprice, 2) + pow(coalesce(m, 0) * 0.5, 2)) AS p FROM lineitem JOIN ({line}) ON k = l_suppkey) GROUP BY 1)"""
    return f"""SELECT l_suppkey, n, m, b, sqrt(w / det) * birge AS u_m, sqrt(wxx / det) * birge AS u_b, chi2_red, birge FROM (SELECT *, greatest(sqrt(chi2_red), 1) AS birge FROM
      (SELECT k AS l_suppkey, n, m, b, w, wxx, w * wxx - wx * wx AS det, greatest(wyy + m * m * wxx + b * b * w - 2 * m * wxy - 2 * b * wy + 2 * m * b * wx, 0) / (n - 2) AS chi2_red FROM ({line}) WHERE n > 2))"""


@query("line_fit", _fit_sql(5))
def line_fit(spark, d):
    df = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_quantity", "l_extendedprice", F.lit(0.5).alias("u_x"), (0.02 * F.col("l_extendedprice")).alias("u_y"))
    return analyses.fit_line(df, ["l_suppkey"], "l_quantity", "l_extendedprice", "u_x", "u_y")


def _gls_sql(rounds: int) -> str:
    """The same with one shared factor f = 0.01 y: products of columns less what the factor takes (Sherman-Morrison)."""
    line = "SELECT l_suppkey AS k, regr_slope(l_extendedprice / 1000, l_quantity) AS m FROM lineitem GROUP BY 1"
    for _ in range(rounds):
        line = f"""SELECT *, (w * wxy - wx * wy) / (w * wxx - wx * wx) AS m, (wxx * wy - wx * wxy) / (w * wxx - wx * wx) AS b FROM (SELECT k, n, w - fw * fw / s AS w, wx - fw * fx / s AS wx, wy - fw * fy / s AS wy, wxx - fx * fx / s AS wxx, wxy - fx * fy / s AS wxy, wyy - fy * fy / s AS wyy FROM
          (SELECT k, count(*) AS n, sum(p) AS w, sum(p * x) AS wx, sum(p * y) AS wy, sum(p * x * x) AS wxx, sum(p * x * y) AS wxy, sum(p * y * y) AS wyy, sum(p * f) AS fw, sum(p * f * x) AS fx, sum(p * f * y) AS fy, 1 + sum(p * f * f) AS s FROM
            (SELECT k, l_quantity AS x, l_extendedprice / 1000 AS y, 0.01 * l_extendedprice / 1000 AS f, 1 / (pow(0.02 * l_extendedprice / 1000, 2) + m * m * 0.25) AS p FROM lineitem JOIN ({line}) ON k = l_suppkey) GROUP BY 1))"""
    return f"SELECT k AS l_suppkey, n, m, b, greatest(wyy + m * m * wxx + b * b * w - 2 * m * wxy - 2 * b * wy + 2 * m * b * wx, 0) / (n - 2) AS chi2_red FROM ({line}) WHERE n > 2"


@query("line_fit_gls", _gls_sql(3))
def line_fit_gls(spark, d):
    y = F.col("l_extendedprice") / 1000
    df = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_quantity", y.alias("y"), F.lit(0.25).alias("vx"), ((0.02 * y) ** 2).alias("vy"), (0.01 * y).alias("scale"))
    return analyses.fit_line_gls(df, ["l_suppkey"], "l_quantity", "y", "vx", "vy", [], ["scale"], 3).select("l_suppkey", "n", "m", "b", "chi2_red")


@query("line_fit_weighted", """SELECT l_suppkey, n, (w * wxy - wx * wy) / (w * wxx - wx * wx) AS m, (wxx * wy - wx * wxy) / (w * wxx - wx * wx) AS b FROM (SELECT l_suppkey, count(*) AS n, sum(p) AS w, sum(p * x) AS wx, sum(p * y) AS wy, sum(p * x * x) AS wxx, sum(p * x * y) AS wxy FROM
  (SELECT l_suppkey, l_quantity AS x, l_extendedprice / 1000 AS y, 1 / pow(0.02 * l_extendedprice / 1000, 2) AS p FROM lineitem) GROUP BY 1)""")
def line_fit_weighted(spark, d):
    df = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"), F.lit(0.0).alias("u_x"), (0.02 * F.col("l_extendedprice") / 1000).alias("u_y"))
    return analyses.fit_line(df, ["l_suppkey"], "l_quantity", "y", "u_x", "u_y", 1).select("l_suppkey", "n", "m", "b")


@query("row_covariance", f"SELECT step_id, user_id, pow(0.5 / h, 2) AS own, -amount / (h * h) * 0.01 AS c_hours FROM {_BASE}")
def row_covariance(spark, d):
    h = (F.col("s1") - F.col("s0")) / 3600
    s = step_table(spark, d).select("step_id", "user_id", (1 / h).alias("g"), (-F.col("amount") / (h * h)).alias("f"), F.lit(0.5).alias("ua"), F.lit(0.01).alias("uh"))
    return analyses.covariance(s, "step_id", {"amount": "g", "hours": "f"}, {"amount": "ua"}, {"hours": "uh"}, ["user_id"])


@query("matrix_cells", "SELECT l_returnflag, l_linestatus, avg(l_quantity) FILTER (WHERE l_discount > 0.05) AS mean, count(l_quantity) FILTER (WHERE l_discount > 0.05) AS n, min(l_quantity) AS low, max(l_quantity) AS high, count(l_quantity) FILTER (WHERE l_discount > 0.05) = 0 AS marked FROM lineitem GROUP BY 1, 2")
def matrix_cells(spark, d):
    return views.matrix(spark.read.parquet(f"{d}/lineitem.parquet"), "l_returnflag", "l_linestatus", "l_quantity", F.col("l_discount") > 0.05)


@query("aligned_curve", f"SELECT s.event_id, (t - t0) / 60 AS minutes FROM {SAMPLES} s JOIN (SELECT user_id, min(s0) AS t0 FROM {STEPS} GROUP BY 1) o USING (user_id)")
def aligned_curve(spark, d):
    return views.aligned(samples(spark, d), step_table(spark, d), ["user_id"], "t", "s0").select("event_id", "minutes")


@query("timeline_page", f"SELECT step_id, greatest(s0, 1704500000) AS \"from\", least(s1, 1704700000) AS \"to\" FROM {STEPS} WHERE s1 > 1704500000 AND s0 < 1704700000")
def timeline_page(spark, d):
    return views.timeline(step_table(spark, d), "s0", "s1", 1704500000.0, 1704700000.0).select("step_id", "from", "to")


@query("xy_view", "SELECT l_orderkey * 10 + l_linenumber AS x, l_quantity / l_discount AS y, l_returnflag AS colour FROM lineitem WHERE l_discount > 0 AND l_tax > 0.02")
def xy_view(spark, d):
    return views.xy(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey * 10 + l_linenumber", "l_quantity / l_discount", colour="l_returnflag", where="l_tax > 0.02")


@query("table_view", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice / 2 > 100000")
def table_view(spark, d):
    return views.table(spark.read.parquet(f"{d}/orders.parquet"), ["o_orderkey", "o_totalprice"], "o_totalprice / 2 > 100000", [("o_totalprice", False)])


@query("template_tiles", "SELECT l_returnflag, '{' || count(l_quantity) || '.0} items, largest ' || CAST(CAST(max(l_quantity * 2) AS BIGINT) AS VARCHAR) || '.00' AS text FROM lineitem GROUP BY 1")
def template_tiles(spark, d):
    return views.fill_template(spark.read.parquet(f"{d}/lineitem.parquet"), "{{{l_quantity|n:.1f}}} items, largest {l_quantity * 2|max:.2f}", ["l_returnflag"])


_DRAW = "CAST('0x' || substr(md5(s || '|' || d || '|' || event_id), {}, 8) AS BIGINT) + 1"
_NOISE = f"(sqrt(-2 * ln(({_DRAW.format(1)}) / 4294967297.0)) * cos(2 * pi() * ({_DRAW.format(9)}) / 4294967297.0))"


@query("monte_carlo_crossing", f"""WITH c AS (SELECT user_id, event_id, us / 1e6 AS x, sum(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS y, 0.1 * value AS u FROM (SELECT *, epoch_us(ts) AS us FROM events)),
z AS (SELECT user_id, event_id, d, x, y + u * {_NOISE} AS y FROM (SELECT c.*, '42' AS s, unnest(generate_series(1, 40)) AS d FROM c)),
p AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM z WINDOW w AS (PARTITION BY user_id, d ORDER BY x, event_id)),
f AS (SELECT user_id, d, arg_min(x + (500 - y) * (x1 - x) / (y1 - y), (x, event_id)) AS x FROM p WHERE (y - 500) * (y1 - 500) <= 0 AND y <> y1 GROUP BY 1, 2)
SELECT user_id, count(f.x) / 40 AS share, round(avg(f.x), 2) AS mean, round(stddev_samp(f.x), 2) AS sd FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN f USING (user_id) GROUP BY 1""")
def monte_carlo_crossing(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    curve = events(spark, d).select("user_id", "event_id", (F.col("us") / 1e6).alias("x"), F.sum("value").over(w).alias("y"), (0.1 * F.col("value")).alias("u"))
    out = analyses.monte_carlo_crossing(curve, ["user_id"], "event_id", "x", "y", "u", 500, 40)
    return out.select("user_id", "share", rounded("mean", 2).alias("mean"), rounded("sd", 2).alias("sd"))
