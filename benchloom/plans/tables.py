"""Queries over plain tables: reshaping, merging, typing, times, JSON, formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchloom.functions import formula, times, typing
from benchloom.operators import reshape
from benchloom.plans.recordings import REC, events
from benchloom.registry import query


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("unpivot_long", " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{c}' AS variable, {c} AS value FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def unpivot_long(spark, d):
    return reshape.unpivot(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("pivot_wide_first", f"SELECT user_id, {', '.join(f'''arg_min(value, row) FILTER (WHERE event_type = '{t}') AS \"{t}\"''' for t in _TYPES)} FROM {REC} WHERE event_type IS NOT NULL GROUP BY 1")
def pivot_wide_first(spark, d):
    return reshape.pivot_first(events(spark, d), ["user_id"], "event_type", "value", _TYPES, "row")


@query("long_duplicates", f"SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY row) AS n FROM {REC}) WHERE n > 1")
def long_duplicates(spark, d):
    return reshape.long_duplicates(events(spark, d), ["user_id"], "event_type", "row").select("event_id")


@query("channel_attributes", "SELECT l_returnflag, arg_min(l_linestatus, l_orderkey * 10 + l_linenumber) AS l_linestatus, count(DISTINCT l_linestatus) > 1 AS ambiguous FROM lineitem GROUP BY 1")
def channel_attributes(spark, d):
    return reshape.channel_attributes(_t(spark, d, "lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "l_returnflag", "l_linestatus", "row")


@query("clean_values", "SELECT p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS brand FROM part")
def clean_values(spark, d):
    return _t(spark, d, "part").select("p_partkey", reshape.clean_value(F.concat("p_brand", F.lit(" [kg]"))).alias("brand"))


@query("drop_footer", f"SELECT event_id FROM (SELECT *, max(CASE WHEN event_type <> 'view' THEN row END) OVER (PARTITION BY user_id) AS last FROM {REC}) WHERE row <= last")
def drop_footer(spark, d):
    e = events(spark, d).withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    return reshape.drop_footer(e, ["user_id"], "row", ["v"]).select("event_id")


for _how, _sql in {"mean": "avg", "median": "median", "n": "count", "min": "min", "max": "max", "sum": "sum", "std": "stddev_samp"}.items():

    @query(f"aggregate_{_how}", f"SELECT l_returnflag, {_sql}(l_quantity) AS l_quantity_{_how} FROM lineitem WHERE l_discount > 0.02 GROUP BY 1")
    def _aggregate(spark, d, how=_how):
        return reshape.aggregate(_t(spark, d, "lineitem"), "l_returnflag", "l_quantity", how, where=F.col("l_discount") > 0.02)


@query("pivot_matrix", "SELECT l_returnflag, avg(l_quantity) FILTER (WHERE l_linestatus = 'F') AS \"F\", avg(l_quantity) FILTER (WHERE l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def pivot_matrix(spark, d):
    return reshape.aggregate(_t(spark, d, "lineitem"), "l_returnflag", "l_quantity", "mean", "l_linestatus", ["F", "O"])


_OLD = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0"
_NEW = "SELECT CASE WHEN o_orderkey % 97 <> 0 THEN o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderkey % 2 AS extra FROM orders WHERE o_orderkey % 2 = 0"
_BOTH = f"(SELECT *, NULL::BIGINT AS extra, 0 AS source_no FROM ({_OLD}) UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, NULL AS o_orderpriority, extra, 1 AS source_no FROM ({_NEW}))"
_MERGED = f"(SELECT * EXCLUDE (newest) FROM (SELECT *, max(source_no) OVER (PARTITION BY o_orderkey) AS newest FROM {_BOTH}) WHERE o_orderkey IS NULL OR source_no = newest)"
_CONFLICT = f"""(SELECT a.o_orderkey, 'o_orderstatus' AS "column", a.o_orderstatus AS old, b.o_orderstatus AS new, 0 AS source_no FROM ({_OLD}) a JOIN ({_NEW}) b USING (o_orderkey) WHERE a.o_orderstatus IS NOT NULL AND a.o_orderstatus IS DISTINCT FROM b.o_orderstatus)"""


def _parts(spark, d):
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey")
    old = o.filter(k % 3 != 0).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    status = F.when(k % 5 == 0, "X").when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_orderstatus"))
    new = o.filter(k % 2 == 0).select(F.when(k % 97 != 0, k).alias("o_orderkey"), status.alias("o_orderstatus"), "o_totalprice", (k % 2).alias("extra"))
    return [old, new]


@query("merge_newest", f"SELECT * FROM {_MERGED}")
def merge_newest(spark, d):
    return reshape.newest_wins(_parts(spark, d), ["o_orderkey"])


@query("merge_conflicts", f"SELECT * FROM {_CONFLICT}")
def merge_conflicts(spark, d):
    return reshape.merge_conflicts(_parts(spark, d), ["o_orderkey"], ["o_orderstatus"])


@query("merge_sources", f"SELECT r.source_no, n_rows, n_kept, n_rows - n_kept AS n_replaced, coalesce(n_conflicts, 0) AS n_conflicts FROM (SELECT source_no, count(*) AS n_rows FROM {_BOTH} GROUP BY 1) r JOIN (SELECT source_no, count(*) AS n_kept FROM {_MERGED} GROUP BY 1) k USING (source_no) LEFT JOIN (SELECT source_no, count(*) AS n_conflicts FROM {_CONFLICT} GROUP BY 1) c USING (source_no)")
def merge_sources(spark, d):
    return reshape.merge_sources(_parts(spark, d), ["o_orderkey"], ["o_orderstatus"])


@query("missing_id_ranges", "SELECT k + 1 AS first, n - 1 AS last FROM (SELECT o_orderkey AS k, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 7 > 1) WHERE n > k + 1")
def missing_id_ranges(spark, d):
    return reshape.missing_ranges(_t(spark, d, "orders").filter("o_orderkey % 7 > 1"), "o_orderkey", 1000)


_CELL = "CASE o_orderkey % 9 WHEN 0 THEN '-999' WHEN 1 THEN ' n/a' WHEN 2 THEN '12f' WHEN 3 THEN '1.234,50' WHEN 4 THEN '1,234.5' WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN ' 7.50 ' ELSE CAST(o_orderkey AS VARCHAR) END"
_RAW = f"(SELECT o_orderkey, {_CELL} AS raw FROM orders)"


def _raw(spark, d):
    k = F.col("o_orderkey")
    c = F.when(k % 9 == 0, "-999").when(k % 9 == 1, " n/a").when(k % 9 == 2, "12f").when(k % 9 == 3, "1.234,50").when(k % 9 == 4, "1,234.5").when(k % 9 == 5, "").when(k % 9 == 6, F.lit(None)).when(k % 9 == 7, " 7.50 ").otherwise(k.cast("string"))
    return _t(spark, d, "orders").select("o_orderkey", c.alias("raw"))


@query("typed_numbers", f"SELECT o_orderkey, CASE WHEN o_orderkey % 9 IN (0, 1, 2, 3, 5, 6) THEN NULL ELSE CAST(replace(trim(raw), ',', '') AS DOUBLE) END AS value FROM {_RAW}")
def typed_numbers(spark, d):
    return _raw(spark, d).select("o_orderkey", typing.number_cell(F.col("raw"))["value"].alias("value"))


@query("typed_numbers_comma", f"SELECT o_orderkey, CASE o_orderkey % 9 WHEN 3 THEN 1234.5 WHEN 7 THEN 7.5 WHEN 8 THEN o_orderkey END::DOUBLE AS value FROM {_RAW}")
def typed_numbers_comma(spark, d):
    return _raw(spark, d).select("o_orderkey", typing.number_cell(F.col("raw"), ",")["value"].alias("value"))


@query("audit_log", f"SELECT o_orderkey, 'raw' AS \"column\", raw AS raw_value, CASE WHEN o_orderkey % 9 IN (0, 1) THEN 'sentinel_value' ELSE 'non_convertible_float' END AS reason FROM {_RAW} WHERE o_orderkey % 9 IN (0, 1, 2, 3)")
def audit_log(spark, d):
    return typing.audit(_raw(spark, d), "o_orderkey", {"raw": typing.number_cell(F.col("raw"))})


@query("typed_integers", f"SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 8 THEN o_orderkey END AS value, CASE WHEN o_orderkey % 9 IN (0, 1) THEN 'sentinel_value' WHEN o_orderkey % 9 IN (2, 3, 4, 7) THEN 'non_convertible_int' END AS reason FROM {_RAW}")
def typed_integers(spark, d):
    return _raw(spark, d).select("o_orderkey", typing.integer_cell(F.col("raw")).alias("c")).select("o_orderkey", "c.*")


@query("column_kinds", "SELECT c AS \"column\", n AS filled, x AS numeric, w AS whole, k AS kind FROM (SELECT 'o_order_key' AS c, count(*) AS n, count(*) AS x, count(*) AS w, 'identifier' AS k FROM orders UNION ALL SELECT 'o_totalprice', count(*), count(*), count(*) FILTER (WHERE CAST(o_totalprice AS VARCHAR) NOT LIKE '%.%'), 'numeric' FROM orders UNION ALL SELECT 'o_orderpriority', count(*), 0, 0, 'categorical' FROM orders)")
def column_kinds(spark, d):
    o = _t(spark, d, "orders").select((F.col("o_orderkey") + 20000).cast("string").alias("o_order_key"), F.col("o_totalprice").cast("string").alias("o_totalprice"), "o_orderpriority")
    return typing.column_kinds(o, o.columns)


@query("parse_times", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN epoch_us(o_orderdate) END AS us FROM orders")
def parse_times(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    text = F.when(k % 4 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 4 == 1, F.date_format(t, "dd.MM.yyyy HH:mm:ss")).when(k % 4 == 2, F.date_format(t, "yyyy/MM/dd HH:mm:ss.S")).otherwise("gestern")
    return _t(spark, d, "orders").select("o_orderkey", F.unix_micros(times.parse_datetime(text)).alias("us"))


@query("clock_seconds", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 24) * 3600.0 + (o_orderkey % 60) * 60 + 7.25 END AS seconds FROM orders")
def clock_seconds(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, "25h").otherwise(F.format_string("%d:%02d:07,25", k % 24, k % 60))
    return _t(spark, d, "orders").select("o_orderkey", times.clock_seconds(text).alias("seconds"))


@query("midnight_rollover", f"SELECT event_id, s + 86400.0 * sum(CASE WHEN s < b - 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY row ROWS UNBOUNDED PRECEDING) AS seconds FROM (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY row) AS b FROM (SELECT *, (us / 1e6) % 86400 AS s FROM {REC}))")
def midnight_rollover(spark, d):
    e = events(spark, d).withColumn("s", (F.col("us") / 1e6) % 86400)
    seconds, days, w = times.unrolled(F.col("s"), ["user_id"], "row")
    e = e.withColumn("days", days)
    return e.select("event_id", (seconds + 86400 * F.sum("days").over(w.rowsBetween(-(2**63), 0))).alias("seconds"))


_WALL = "(SELECT o_orderkey, o_orderkey % 2 AS autumn, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2024-03-31 00:00:00' ELSE TIMESTAMP '2024-10-27 00:00:00' END AS day, (o_orderkey * 61) % 86400 AS s FROM orders)"


@query("local_to_utc", f"""SELECT o_orderkey, CASE WHEN autumn = 0 AND s >= 7200 AND s < 10800 THEN NULL ELSE day + to_seconds(s - CASE WHEN autumn = 0 AND s < 7200 OR autumn = 1 AND s >= 10800 THEN 3600 ELSE 7200 END) END AS utc,
CASE WHEN s >= 7200 AND s < 10800 THEN CASE WHEN autumn = 0 THEN 'nonexistent_local_time' ELSE 'ambiguous_local_time' END END AS reason FROM {_WALL}""")
def local_to_utc(spark, d):
    """Every time of the days on which the clocks of a zone go forth and back."""
    k = F.col("o_orderkey")
    day = F.when(k % 2 == 0, "2024-03-31 00:00:00").otherwise("2024-10-27 00:00:00").cast("timestamp_ntz")
    wall = day + F.make_dt_interval(secs=((k * 61) % 86400).cast("decimal(18,6)"))
    return _t(spark, d, "orders").select("o_orderkey", times.local_to_utc(wall, "Europe/Zurich").alias("r")).select("o_orderkey", "r.*")


@query("json_columns", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def json_columns(spark, d):
    from benchloom.sources.tables import split_json

    return split_json(_t(spark, d, "events").select("event_id", "props"), "props", ["k"]).select("event_id", "k")


@query("invalid_json", "SELECT count(*) FILTER (WHERE event_id % 9 = 0) AS invalid FROM events")
def invalid_json(spark, d):
    from benchloom.sources import tables

    e = _t(spark, d, "events").select(F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("x"), "props")).otherwise(F.col("props")).alias("props"))
    return tables.invalid_json(e, "props")


_FORMULAS = {
    "ratio": ("l_extendedprice / (l_discount * l_tax)", "CASE WHEN l_discount * l_tax = 0 THEN CASE WHEN l_extendedprice = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END ELSE l_extendedprice / (l_discount * l_tax) END"),
    "logs": ("log(l_discount) + log10(l_quantity)", "CASE WHEN l_discount = 0 THEN '-inf'::DOUBLE ELSE ln(l_discount) + log10(l_quantity) END"),
    "pick": ("l_quantity if 0.02 < l_discount <= 0.06 and not l_tax == 0 else -l_tax", "CASE WHEN l_discount > 0.02 AND l_discount <= 0.06 AND l_tax <> 0 THEN l_quantity ELSE -l_tax END"),
    "bounds": ("max(min(l_quantity, 30), 5) * sqrt(abs(l_tax - 0.04)) ** 2", "greatest(least(l_quantity, 30), 5) * pow(sqrt(abs(l_tax - 0.04)), 2)"),
    "text": ("where(l_returnflag == 'A' or l_linestatus != 'O', 1, 0) + isfinite(l_tax / l_tax)", "CASE WHEN l_returnflag = 'A' OR l_linestatus <> 'O' THEN 1.0 ELSE 0.0 END + CASE WHEN l_tax = 0 THEN 0 ELSE 1 END"),
    "even": ("round(l_quantity / 2) + round(l_extendedprice, -2)", "round_even(l_quantity / 2, 0) + round_even(l_extendedprice, -2)"),
}


@query("formula_values", f"SELECT l_orderkey, l_linenumber, {', '.join(f'{sql} AS {name}' for name, (_, sql) in _FORMULAS.items())} FROM lineitem")
def formula_values(spark, d):
    df = _t(spark, d, "lineitem")
    return df.select("l_orderkey", "l_linenumber", *[formula.compile_formula(text, df).alias(name) for name, (text, _) in _FORMULAS.items()])


@query("formula_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_discount <> 0")
def formula_filter(spark, d):
    from benchloom.functions import ieee

    df = _t(spark, d, "lineitem")
    return df.filter(ieee.holds(formula.compile_formula("(l_quantity > 10) * l_discount", df))).select("l_orderkey", "l_linenumber")


@query("formula_piecewise", f"SELECT event_id, CASE WHEN us >= 1704500000000000 AND us < 1704600000000000 THEN value * 2 WHEN us >= 1704600000000000 AND us < 1704700000000000 THEN value + 100 ELSE value END AS value FROM {REC}")
def formula_piecewise(spark, d):
    from benchloom.operators.align import piecewise

    e = events(spark, d)
    return e.select("event_id", piecewise(e, "us", "value", [(1704500000, 1704600000, "value * 2"), (1704600000, 1704700000, "value + 100")]).alias("value"))


@query("formula_gradient", "SELECT l_orderkey, l_linenumber, l_quantity * (1 - l_discount) / (1 + l_tax) AS y, (1 - l_discount) / (1 + l_tax) AS by_quantity, -l_quantity * (1 - l_discount) / pow(1 + l_tax, 2) AS by_tax, exp(l_tax) * ln(l_quantity) AS by_tax_of_log FROM lineitem")
def formula_gradient(spark, d):
    df = _t(spark, d, "lineitem")
    y = formula.parse("l_quantity * (1 - l_discount) / (1 + l_tax)")
    z = formula.parse("log(l_quantity) * exp(l_tax)")
    env = {c: F.col(c) for c in df.columns}
    column = lambda node: formula.to_column(node, env)
    return df.select("l_orderkey", "l_linenumber", column(y).alias("y"), column(formula.derivative(y, "l_quantity")).alias("by_quantity"), column(formula.derivative(y, "l_tax")).alias("by_tax"), column(formula.derivative(z, "l_tax")).alias("by_tax_of_log"))
