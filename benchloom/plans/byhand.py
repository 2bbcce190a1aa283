"""Queries over relations, steps and windows set by hand, own uncertainties, and the texts of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchloom.operators import align, analyses, byhand, evaluate, relations, stats, steps, views
from benchloom.plans.evaluation import _RATE, _curve, _inputs, _CURVE, _cross_sql, CALCULATIONS
from benchloom.plans.recordings import REC, events, recording
from benchloom.plans.steps import _AUTO, _CLAIMED, INSIDE, STEPS, inside, samples, step_table
from benchloom.registry import query
from benchloom.rounding import rounded

_REL = f"""(SELECT *, CASE WHEN b IS NOT NULL AND f IS NOT NULL THEN (b + f) / 2 ELSE coalesce(b, f) END AS ref FROM (SELECT a.*, arg_max(b.amount, (b.s1, -b.row)) FILTER (WHERE b.s1 <= a.s0) AS b, arg_min(b.amount, (b.s0, b.row)) FILTER (WHERE b.s0 >= a.s1) AS f
  FROM {STEPS} a LEFT JOIN {STEPS} b ON a.user_id = b.user_id AND b.amount > 60 AND a.step_id <> b.step_id GROUP BY ALL))"""


@query("relations_in_order", f"""SELECT step_id, coalesce(ref, 50) AS ref, CASE WHEN b IS NOT NULL AND f IS NOT NULL THEN 'both' WHEN ref IS NOT NULL THEN 'one' ELSE 'fallback' END AS ref_kind, round_even(amount / coalesce(ref, 50) / 0.25, 0) * 0.25 AS step_bin,
  round(sum(amount - coalesce(ref, 50)) OVER (PARTITION BY user_id, run ORDER BY s0 ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS total, run AS total_run FROM
  (SELECT *, CAST(sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY s0 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (SELECT *, lag(half) OVER (PARTITION BY user_id ORDER BY s0) IS DISTINCT FROM half AS fresh FROM (SELECT *, amount > 50 AS half FROM {_REL})))""")
def relations_in_order(spark, d):
    s = step_table(spark, d).withColumn("row_id", F.col("user_id") * 1_000_000 + F.col("row")).withColumn("half", (F.col("amount") > 50).cast("double"))
    todo = [
        relations.Nearest("ref", "amount", "amount > 60", ("user_id",), fallback="50"), relations.Bin("step_bin", "amount / ref", 0.25), relations.Cumulative("total", "amount - ref", None, "changed(half)"),
    ]
    out = relations.apply(s, todo, relations.Layout(("user_id",), "row_id", "s0", "s1"))
    return out.select("step_id", "ref", "ref_kind", "step_bin", (rounded("total", 6) + F.lit(0.0)).alias("total"), "total_run")


@query("own_uncertainty", f"SELECT step_id, rate, sqrt(ra * ra + rh * rh + rk * rk + pow(0.02 * rate, 2)) AS u_rate, abs(0.02 * rate) AS part, 2 * sqrt(ra * ra + rh * rh + rk * rk + pow(0.02 * rate, 2)) AS u_twice FROM {_RATE} WHERE amount > 0")
def own_uncertainty(spark, d):
    out = evaluate.calculate(step_table(spark, d).filter("amount > 0"), {"rate": CALCULATIONS["rate"], "twice": "2 * rate"}, _inputs(), {"rate": evaluate.Own("0.02 * rate0 if rate0 > 0 else 0".replace("rate0", "(amount / hours * k)"))})
    return out.select("step_id", "rate", "u_rate", F.abs("b_rate__own_rate").alias("part"), "u_twice")


@query("fixed_constants", "SELECT o_orderkey, o_totalprice * 3 + 2 AS y, sqrt(pow(o_totalprice * 0.1, 2) + 1) AS u_y FROM orders")
def fixed_constants(spark, d):
    """A constant without uncertainty is no input of a budget."""
    given = evaluate.merged_inputs({"k": (3.0, 0.1, "systematic", None), "c": (2.0, 0.0)}, {"k": (3.0, 0.1, "systematic", None)})
    o = spark.read.parquet(f"{d}/orders.parquet")
    out = evaluate.calculate(o, {"y": "p * k + c"}, {"p": evaluate.Input(F.col("o_totalprice"), F.lit(1.0) / 3), **given})
    assert "b_y__c" not in out.columns
    return out.select("o_orderkey", "y", "u_y")


_WINDOWS = f"(SELECT user_id, step_id, amount, s0, s1, CASE WHEN amount > 60 THEN 'large' ELSE 'small' END AS label FROM {STEPS})"


def _labelled(spark, d):
    return step_table(spark, d).withColumn("label", F.when(F.col("amount") > 60, "large").otherwise("small"))


@query("named_windows", f"""SELECT step_id, 'whole' AS "window", s0 AS low, s1 AS high FROM {_WINDOWS} UNION ALL SELECT step_id, 'late', greatest(s0 + 60, s1 - 3600), s1 FROM {_WINDOWS} WHERE label = 'large' AND s1 > s0 + 60
  UNION ALL SELECT step_id, 'until', s0, e FROM (SELECT *, coalesce(least(min(CASE WHEN label = 'large' THEN s0 END) OVER (PARTITION BY user_id ORDER BY s0 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), s0 + 400000), s1) AS e FROM {_WINDOWS})""")
def named_windows(spark, d):
    t = _labelled(spark, d).select("user_id", "step_id", F.col("s0").alias("start"), F.col("s1").alias("end"), F.col("label").alias("class"))
    rules = {"whole": {}, "late": {"class": "large", "skip_start": 60.0, "keep": 3600.0}, "until": {"until": "large", "cap": 400000.0}}
    return byhand.named_windows(t, ["user_id"], rules)


_SET = f"(SELECT step_id + CASE WHEN step_id % 20 = 0 THEN 10000000 ELSE 0 END AS step_id, CASE WHEN step_id % 20 = 5 THEN 'other' ELSE 'main' END AS win, CASE WHEN step_id % 20 = 10 THEN 'moved' ELSE label END AS label, s1 AS low, s0 AS high FROM {_WINDOWS} WHERE step_id % 5 = 0)"


def _set_by_hand(spark, d):
    k = F.col("step_id")
    return _labelled(spark, d).filter(k % 5 == 0).select((k + F.when(k % 20 == 0, 10_000_000).otherwise(0)).alias("step_id"), F.when(k % 20 == 5, "other").otherwise("main").alias("window"), F.when(k % 20 == 10, "moved").otherwise(F.col("label")).alias("label"), F.col("s1").alias("low"), F.col("s0").alias("high"))


def _main_windows(spark, d):
    return _labelled(spark, d).select("step_id", "label", F.lit("main").alias("window"), (F.col("s0") + 10).alias("low"), F.col("s1").alias("high"))


@query("window_overrides", f"SELECT w.step_id, CASE WHEN o.step_id IS NULL THEN s0 + 10 ELSE s0 END AS low, s1 AS high, o.step_id IS NOT NULL AS by_hand FROM {_WINDOWS} w LEFT JOIN {_SET} o ON w.step_id = o.step_id AND o.win = 'main'")
def window_overrides(spark, d):
    return byhand.with_overrides(_main_windows(spark, d), _set_by_hand(spark, d), ["main"])[0].select("step_id", "low", "high", "by_hand")


@query("stale_overrides", f"""SELECT o.step_id, o.win AS "window", CASE WHEN w.step_id IS NULL THEN 'no such step' WHEN o.win <> 'main' THEN 'no such window' ELSE 'set on step moved, which is now ' || w.label END AS problem FROM {_SET} o LEFT JOIN {_WINDOWS} w USING (step_id) WHERE w.step_id IS NULL OR o.win <> 'main' OR o.label <> w.label""")
def stale_overrides(spark, d):
    return byhand.with_overrides(_main_windows(spark, d), _set_by_hand(spark, d), ["main"])[1]


@query("relinked_windows", f"""SELECT CASE WHEN step_id % 3 = 0 AND n = 1 THEN step_id ELSE CASE WHEN step_id % 3 = 0 THEN step_id + 10000000 ELSE step_id END END AS step_id, s0 + 0.25 AS step_start FROM
  (SELECT a.*, (SELECT count(*) FROM {_WINDOWS} b WHERE b.label = a.label AND abs(b.s0 - (a.s0 + 0.25)) <= 1) AS n FROM {_WINDOWS} a WHERE step_id % 2 = 0)""")
def relinked_windows(spark, d):
    """Every third override has an id that no step has any more."""
    t = _labelled(spark, d).select("step_id", "label", F.col("s0").alias("start"))
    k = F.col("step_id")
    o = t.filter(k % 2 == 0).select((k + F.when(k % 3 == 0, 10_000_000).otherwise(0)).alias("step_id"), F.lit("main").alias("window"), "label", (F.col("start") + 0.25).alias("step_start"))
    return byhand.relinked(o, t).select("step_id", "step_start")


@query("manual_steps", f"SELECT step_id, s0 AS start, s1 AS \"end\", false AS manual FROM {STEPS} UNION ALL SELECT -user_id, 1704500000.0, 1704600000.0, true FROM (SELECT DISTINCT user_id FROM events)")
def manual_steps(spark, d):
    t = step_table(spark, d).select("step_id", F.col("s0").alias("start"), F.col("s1").alias("end"))
    hand = spark.read.parquet(f"{d}/events.parquet").select((-F.col("user_id")).cast("bigint").alias("step_id")).distinct().select("step_id", F.lit(1704500000.0).alias("start"), F.lit(1704600000.0).alias("end"))
    return byhand.with_manual(t, hand)


@query("typed_parameters", "SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS state FROM orders")
def typed_parameters(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    cells = F.create_map(F.lit("price"), F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(20,2)").cast("string")), F.lit("state"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus")).otherwise(""))
    return byhand.typed_parameters(o.select("o_orderkey", cells.alias("params")), ["price", "state"]).select("o_orderkey", "price", "state")


@query("looked_up", f"SELECT s.step_id, v.value AS found FROM {STEPS} s LEFT JOIN ({_CLAIMED}) c USING (step_id) LEFT JOIN events v ON v.event_id = c.row_id")
def looked_up(spark, d):
    s = step_table(spark, d).select("user_id", "step_id", F.col("s0").alias("start"))
    r = samples(spark, d).filter("event_type = 'view'").select("user_id", F.col("event_id").alias("row_id"), F.col("t").alias("time"), F.col("value").alias("found"))
    return byhand.looked_up(s, r, ["user_id"], 50000.0, ["found"]).select("step_id", "found")


@query("steps_of_a_table", """SELECT o_orderkey, "start", "end", CASE WHEN reason IS NULL THEN 'step' ELSE 'excluded' END AS status, reason, last_value(CASE WHEN o_orderkey % 6 = 0 THEN 'block ' || o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS label FROM
  (SELECT *, CASE WHEN k = 0 THEN 'no start' WHEN k = 1 THEN 'start is no time' WHEN e IS NULL THEN 'no end' END AS reason, CASE WHEN k > 1 THEN s END AS "start", e AS "end" FROM
    (SELECT *, CASE WHEN k > 1 THEN CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN s % 86400 > 3600 THEN s - s % 86400 + 3600 + 86400 WHEN s % 86400 < 3600 THEN s - s % 86400 + 3600 END END END AS own,
       CASE WHEN k > 1 THEN coalesce(CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN s % 86400 > 3600 THEN s - s % 86400 + 90000 WHEN s % 86400 < 3600 THEN s - s % 86400 + 3600 END END, lead(CASE WHEN k > 1 THEN s END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY CASE WHEN k > 1 THEN 0 ELSE 1 END, s)) END AS e FROM
      (SELECT o_orderkey, o_custkey, o_orderkey % 7 AS k, 1714953600.0 + (o_orderkey * 37) % 86400 AS s FROM orders)))""")
def steps_of_a_table(spark, d):
    k = F.col("o_orderkey")
    sec = (k * 37) % 86400
    clock = F.format_string("%d:%02d:%02d", (sec / 3600).cast("int"), ((sec % 3600) / 60).cast("int"), sec % 60)
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", F.when(k % 7 == 0, " ").when(k % 7 == 1, "soon").otherwise(clock).alias("from"), F.when(k % 4 == 0, "01:00").alias("to"), F.when(k % 6 == 0, F.concat(F.lit("block "), k.cast("string"))).alias("name"))
    out = byhand.steps_from_table(o, ["o_custkey"], "o_orderkey", "from", "to", F.lit("2024-05-06").cast("date"), "name")
    return out.select("o_orderkey", "start", "end", "status", "reason", "label")


@query("column_shapes", f"SELECT 'event_type' AS \"column\", count(*) AS rows, count(*) AS filled, 0 AS clocks, count(DISTINCT event_type) AS kinds FROM events UNION ALL SELECT 'clock', count(*), count(*) FILTER (WHERE event_id % 3 > 0), count(*) FILTER (WHERE event_id % 3 > 0), count(DISTINCT CASE WHEN event_id % 3 > 0 THEN event_id % 24 END) FROM events")
def column_shapes(spark, d):
    k = F.col("event_id")
    e = spark.read.parquet(f"{d}/events.parquet").select("ts", "event_type", F.when(k % 3 > 0, F.format_string("%d:30", k % 24)).alias("clock"))
    return byhand.column_shapes(e, "ts")


@query("crossing_text", f"SELECT m.user_id, CASE WHEN m.c IS NOT NULL THEN CAST(CAST(round_even(m.c, 0) AS BIGINT) AS VARCHAR) || ' s' ELSE CASE WHEN y1 >= y0 THEN CASE WHEN hi < 500 THEN '> ' || CAST(CAST(round_even(x1, 0) AS BIGINT) AS VARCHAR) WHEN lo >= 500 THEN '< ' || CAST(CAST(round_even(x0, 0) AS BIGINT) AS VARCHAR) ELSE '> ' || CAST(CAST(round_even(x1, 0) AS BIGINT) AS VARCHAR) END || ' s' END END AS text FROM {_cross_sql('y')} m JOIN (SELECT user_id, arg_min(y, x) AS y0, arg_max(y, x) AS y1, min(y) AS lo, max(y) AS hi, min(x) AS x0, max(x) AS x1 FROM {_CURVE} GROUP BY 1) e USING (user_id)")
def crossing_text(spark, d):
    return analyses.crossing_text(_curve(spark, d), ["user_id"], "x", "y", 500, "s")


@query("crossing_systematic", f"SELECT m.user_id, round(m.c, 4) AS x_cross, round(least(a.c, b.c), 4) AS x_low_syst, round(greatest(a.c, b.c), 4) AS x_high_syst FROM {_cross_sql('y')} m JOIN {_cross_sql('y - u / 4')} a USING (user_id) JOIN {_cross_sql('y + u / 4')} b USING (user_id)")
def crossing_systematic(spark, d):
    curve = _curve(spark, d).withColumn("us", F.col("u") / 4)
    out = analyses.crossing_systematic(curve, ["user_id"], "x", "y", "u", "us", 500)
    return out.select("user_id", *[rounded(c, 4).alias(c) for c in ("x_cross", "x_low_syst", "x_high_syst")])


_FIT1 = """(SELECT *, sqrt(w / det) * birge AS u_m, sqrt(wxx / det) * birge AS u_b FROM (SELECT *, greatest(sqrt(greatest(wyy + m * m * wxx + b * b * w - 2 * m * wxy - 2 * b * wy + 2 * m * b * wx, 0) / (n - 2)), 1) AS birge FROM (SELECT *, w * wxx - wx * wx AS det, (w * wxy - wx * wy) / (w * wxx - wx * wx) AS m, (wxx * wy - wx * wxy) / (w * wxx - wx * wx) AS b FROM
  (SELECT l_suppkey, count(*) AS n, sum(p) AS w, sum(p * x) AS wx, sum(p * y) AS wy, sum(p * x * x) AS wxx, sum(p * x * y) AS wxy, sum(p * y * y) AS wyy FROM (SELECT l_suppkey, l_quantity AS x, l_extendedprice / 1000 AS y, 1 / pow(0.02 * l_extendedprice / 1000, 2) AS p FROM lineitem) GROUP BY 1)) WHERE n > 2))"""


@query("derived_quantities", f"SELECT l_suppkey, -m * 8.314 AS ea, 8.314 * u_m AS u_ea, exp(b / 10) AS k0, exp(b / 10) / 10 * u_b AS u_k0 FROM {_FIT1}")
def derived_quantities(spark, d):
    df = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"), F.lit(0.0).alias("u_x"), (0.02 * F.col("l_extendedprice") / 1000).alias("u_y"))
    fit = analyses.fit_line(df, ["l_suppkey"], "l_quantity", "y", "u_x", "u_y", 1)
    return analyses.derived_quantities(fit, ["l_suppkey"], {"ea": "-m * r", "k0": "exp(b / 10)"}, {"r": 8.314})


_BOTH = f"(SELECT l_suppkey, m, b, u_m, u_b, -wx / det * birge * birge AS c FROM {_FIT1})"


@query("derived_correlated", f"""SELECT l_suppkey, 20 * m + b AS at_20, sqrt(400 * u_m * u_m + u_b * u_b + 40 * c) AS u_at_20, -b / m AS zero, sqrt(pow(b / m / m * u_m, 2) + pow(u_b / m, 2) - 2 * b / pow(m, 3) * c) AS u_zero,
  (20 * m + b) / m AS ratio, sqrt(pow(b / m / m * u_m, 2) + pow(u_b / m, 2) - 2 * b / pow(m, 3) * c) AS u_ratio FROM {_BOTH}""")
def derived_correlated(spark, d):
    """Quantities of slope and intercept with their covariance; one rests on another."""
    df = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"), F.lit(0.0).alias("u_x"), (0.02 * F.col("l_extendedprice") / 1000).alias("u_y"))
    fit = analyses.fit_line(df, ["l_suppkey"], "l_quantity", "y", "u_x", "u_y", 1, with_cov=True)
    return analyses.derived_quantities(fit, ["l_suppkey"], {"at_20": "20 * m + b", "zero": "-b / m", "ratio": "at_20 / m"})


def _draw(kind: str) -> str:
    at = "CAST('0x' || substr(md5('42|' || d || '|{k}' || key), {a}, 8) AS BIGINT) + 1"
    return f"(sqrt(-2 * ln(({at.format(k=kind, a=1)}) / 4294967297.0)) * cos(2 * pi() * ({at.format(k=kind, a=9)}) / 4294967297.0))"


@query("monte_carlo_line", f"""SELECT l_suppkey, avg(m) AS m_mean, stddev_samp(m) AS m_sd, avg(b) AS b_mean, stddev_samp(b) AS b_sd FROM (SELECT l_suppkey, d, (w * wxy - wx * wy) / (w * wxx - wx * wx) AS m, (wxx * wy - wx * wxy) / (w * wxx - wx * wx) AS b FROM
  (SELECT l_suppkey, d, sum(p) AS w, sum(p * x) AS wx, sum(p * y) AS wy, sum(p * x * x) AS wxx, sum(p * x * y) AS wxy FROM (SELECT l_suppkey, d, p, x + 0.5 * {_draw('x')} AS x, y + u * {_draw('y')} AS y FROM
    (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS key, l_quantity AS x, l_extendedprice / 1000 AS y, 0.02 * l_extendedprice / 1000 AS u, 1 / (pow(0.02 * l_extendedprice / 1000, 2) + pow(0.5 * m, 2)) AS p, unnest(generate_series(1, 20)) AS d FROM lineitem JOIN (SELECT l_suppkey AS k, regr_slope(l_extendedprice / 1000, l_quantity) AS m FROM lineitem GROUP BY 1) ON k = l_suppkey)) GROUP BY 1, 2)) GROUP BY 1""")
def monte_carlo_line(spark, d):
    y = F.col("l_extendedprice") / 1000
    df = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_quantity", y.alias("y"), F.lit(0.5).alias("u_x"), (0.02 * y).alias("u_y"))
    return analyses.monte_carlo_line(df, ["l_suppkey"], "key", "l_quantity", "y", "u_x", "u_y", 20)


@query("budget_bars", f"SELECT step_id, sqrt(ra * ra + rh * rh + rk * rk) AS u, unnest(['amount', 'clock time', 'k']) AS part, unnest([ra * ra, rh * rh, rk * rk]) / (ra * ra + rh * rh + rk * rk) AS share FROM {_RATE} WHERE amount > 20")
def budget_bars(spark, d):
    out = evaluate.calculate(step_table(spark, d), {"rate": CALCULATIONS["rate"]}, _inputs())
    return views.bars(out, "rate", ["step_id"], "amount > 20", {"hours": "clock time"})


@query("report_tiles", "SELECT 0 AS place, 'Largest' AS label, CAST(CAST(max(l_quantity) AS BIGINT) AS VARCHAR) || '.0 of ' || string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS text FROM lineitem UNION ALL SELECT 1, 'Late', CAST(count(*) AS VARCHAR) || '.0' FROM orders WHERE o_totalprice > 1000")
def report_tiles(spark, d):
    tables = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("lineitem", "orders")}
    return views.report_tiles(tables, [("Largest", "lineitem", "{l_quantity|max:.1f} of {l_returnflag}", None), ("Late", "orders", "{o_totalprice|n:.1f}", "o_totalprice > 1000")])


@query("clipped_span", f"SELECT event_id FROM (SELECT *, max(CASE WHEN us < 1704500000000000 THEN row END) OVER (PARTITION BY user_id) AS a, min(CASE WHEN us > 1704600000000000 THEN row END) OVER (PARTITION BY user_id) AS b FROM {REC}) WHERE us BETWEEN 1704500000000000 AND 1704600000000000 OR row = a OR row = b")
def clipped_span(spark, d):
    return align.clipped(recording(spark, d), 1704500000000000, 1704600000000000).select("event_id")


@query("measure_uncertainty", f"SELECT step_id, sqrt(sem_eff * sem_eff + 0.25) AS u_mean FROM ({_AUTO})")
def measure_uncertainty(spark, d):
    out = stats.autocorrelation(inside(spark, d), ["step_id"], "value", "row")
    none = F.lit(None).cast("double")
    return out.select("step_id", evaluate.measure_u("mean", F.col("sem_eff"), none, none, none, 0.5).alias("u_mean"))
