"""Queries over flags, row picks, ranges, and times of mixed kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchloom.functions import times
from benchloom.operators import align, assembly, quality
from benchloom.operators.chunks import CHUNK_ROWS, Chunks, numbered
from benchloom.plans.recordings import ALL_FLAGS, FLAGS, REC, _all_flags, _flags, events, recording
from benchloom.plans.steps import _COVER
from benchloom.registry import query


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("assembled_flags", f"SELECT DISTINCT * FROM (SELECT * FROM ({FLAGS['gap']}) UNION ALL SELECT * FROM ({FLAGS['range']}) UNION ALL SELECT * FROM ({FLAGS['range']}))")
def assembled_flags(spark, d):
    f = _flags(recording(spark, d))
    return assembly.assemble_flags([f["gap"], f["range"], f["range"]])


@query("ordered_flags", f"SELECT *, row_number() OVER (ORDER BY user_id, row, channel NULLS FIRST, flag) AS place FROM ({ALL_FLAGS})")
def ordered_flags(spark, d):
    """Events in order, with the place of each (a number over the whole order)."""
    flags = _all_flags(recording(spark, d)).persist()
    counts = flags.groupBy("user_id").agg(F.count("*").alias("n"))
    # The place is that among a user's events plus the events of users before; both by chunks.
    before = Chunks((), ("user_id",), F.floor(F.col("user_id") / 1000)).with_running_sum(counts, {"so_far": "n"}).select("user_id", (F.col("so_far") - F.col("n") + 1).alias("first"))
    own = numbered(flags, Chunks(("user_id",), ("row", "channel", "flag"), F.floor(F.col("row") / CHUNK_ROWS)), "own")
    return assembly.ordered_flags(own.join(before, "user_id"), ["user_id"]).select("user_id", "row", "channel", "flag", (F.col("own") + F.col("first")).alias("place"))


@query("flag_mask", f"SELECT event_id, EXISTS (SELECT 1 FROM ({ALL_FLAGS}) f WHERE f.user_id = r.user_id AND f.row = r.row AND flag IN ('gap', 'out_of_range') AND (channel IS NULL OR channel = 'value')) AS flagged FROM {REC} r")
def flag_mask(spark, d):
    rec = recording(spark, d)
    # The mask takes gaps and ranges alone: segments are kept without channels.
    flags = quality.gap_flags(quality.with_segments(rec.narrow()), rec).unionByName(quality.range_flags(rec, "value", 5, 120))
    return assembly.flag_mask(rec, flags, ["gap", "out_of_range"], "value").select("event_id", "flagged")


@query("rows_in", f"SELECT event_id FROM {REC} r WHERE (user_id, row) IN (SELECT (user_id, row) FROM ({FLAGS['range']}))")
def rows_in(spark, d):
    rec = recording(spark, d)
    return assembly.rows_in(rec.df, _flags(rec)["range"], ["user_id", "row"]).select("event_id")


_FOOT = f"(SELECT event_id, user_id, row, CASE WHEN row < n - 3 THEN value END AS v, row = n - 2 AS noted FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM {REC}))"


@query("footer_with_audit", f"SELECT event_id FROM (SELECT *, max(CASE WHEN v IS NOT NULL OR noted THEN row END) OVER (PARTITION BY user_id) AS last FROM {_FOOT}) WHERE row <= last")
def footer_with_audit(spark, d):
    from pyspark.sql import Window

    e = events(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    e = e.withColumn("v", F.when(F.col("row") < F.col("n") - 3, F.col("value")))
    return assembly.trim_footer(e, e.filter("row = n - 2"), ["user_id"], "row", ["v"]).select("event_id")


@query("head_rows", f"SELECT event_id FROM {REC} WHERE row BETWEEN 2 AND 6")
def head_rows(spark, d):
    return assembly.first_rows(events(spark, d), ["user_id"], "row", 5, 2).select("event_id")


@query("tail_rows", f"SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row DESC) AS k FROM {REC}) WHERE k <= 4")
def tail_rows(spark, d):
    return assembly.last_rows(events(spark, d), ["user_id"], "row", 4).select("event_id")


@query("top_values", f"SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM {REC}) WHERE rank <= 3")
def top_values(spark, d):
    return assembly.largest(events(spark, d), ["user_id"], "value", "event_id", 3).select("user_id", "event_id", "rank")


@query("common_keys", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def common_keys(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return o.filter("o_orderstatus = 'O'").select("k").intersect(o.filter("o_orderstatus = 'F'").select("k"))


@query("other_keys", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def other_keys(spark, d):
    parts = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag", "l_quantity")
    return parts.filter("l_returnflag = 'A'").select("k").subtract(parts.filter("l_quantity > 40").select("k"))


@query("robust_range", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.02) AS low, quantile_cont(l_extendedprice, 0.97) AS high FROM lineitem GROUP BY 1")
def robust_range(spark, d):
    return assembly.robust_range(_t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 2, 97)


@query("constant_range", "SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN -1.0 ELSE 95.0 END AS low, CASE l_returnflag WHEN 'A' THEN 1.0 ELSE 105.0 END AS high FROM (SELECT DISTINCT l_returnflag FROM lineitem)")
def constant_range(spark, d):
    return assembly.robust_range(_t(spark, d, "lineitem").withColumn("v", F.when(F.col("l_returnflag") == "A", 0.0).otherwise(100.0)), ["l_returnflag"], "v")


@query("constant_within", f"SELECT 'event_type' AS \"column\", max(a) <= 1 AS constant FROM (SELECT count(DISTINCT event_type) AS a FROM {REC} GROUP BY user_id) UNION ALL SELECT 'day', max(a) <= 1 FROM (SELECT count(DISTINCT user_id % 7) AS a FROM {REC} GROUP BY user_id)")
def constant_within(spark, d):
    return assembly.constant_within(events(spark, d).withColumn("day", F.col("user_id") % 7), ["user_id"], ["event_type", "day"])


@query("joined_texts", "SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS types FROM events GROUP BY 1")
def joined_texts(spark, d):
    return assembly.joined_texts(_t(spark, d, "events"), ["user_id"], "event_type", "types")


@query("connect_mask", f"SELECT event_id, coalesce(sparse IS NOT NULL AND lead(sparse) OVER (PARTITION BY user_id ORDER BY row) IS NOT NULL, false) AS connects FROM {REC}")
def connect_mask(spark, d):
    return assembly.connected(recording(spark, d), "sparse").select("event_id", "connects")


@query("long_channels", f"SELECT event_id, event_type, unnest(['value', 'coarse']) AS channel, unnest([value, coarse]) AS value FROM {REC}")
def long_channels(spark, d):
    return assembly.to_long(recording(spark, d).df, ["event_id", "event_type"], ["value", "coarse"])


@query("absolute_time", f"SELECT event_id, us / 1e6 - 1704067200 AS s, make_timestamp(us) + INTERVAL 1 HOUR AS time_abs FROM {REC}")
def absolute_time(spark, d):
    e = events(spark, d).select("event_id", (F.col("us") / 1e6 - 1704067200).alias("s"))
    return assembly.with_absolute_time(e, "s", F.lit(1704067200000000), "Europe/Zurich")


@query("secondary_axis", "SELECT l_orderkey, l_linenumber, l_quantity * 1.8 + 32 AS x2 FROM lineitem")
def secondary_axis(spark, d):
    return assembly.secondary_axis(_t(spark, d, "lineitem"), "l_quantity", "x * 1.8 + 32").select("l_orderkey", "l_linenumber", "x2")


@query("parameter_roles", f"SELECT c AS \"column\", k <= 1 AND n >= 2 AS parameter FROM (SELECT 'half' AS c, max(a) AS k, max(b) AS n FROM (SELECT count(DISTINCT user_id % 2) AS a, count(*) AS b FROM {REC} GROUP BY user_id) UNION ALL SELECT 'value', max(a), max(b) FROM (SELECT count(DISTINCT value) AS a, count(value) AS b FROM {REC} GROUP BY user_id))")
def parameter_roles(spark, d):
    e = events(spark, d).withColumn("half", F.col("user_id") % 2)
    return assembly.parameter_audit(e, ["user_id"], ["half", "value"], [])[0]


@query("parameter_audit", "SELECT 'value' AS \"column\", 'non_constant_parameter' AS reason")
def parameter_audit(spark, d):
    e = events(spark, d).withColumn("half", F.col("user_id") % 2)
    return assembly.parameter_audit(e, ["user_id"], [], ["half", "value"])[1]


@query("gap_at", f"SELECT event_id, EXISTS (SELECT 1 FROM {_COVER} c WHERE c.user_id = r.user_id AND us + 1800000000 BETWEEN start_us AND end_us) AS covered FROM {REC} r")
def gap_at(spark, d):
    rec = recording(spark, d)
    at = rec.df.select("user_id", "event_id", (F.col("us") + 1800000000).alias("at_us"))
    return assembly.gap_at(align.coverage(rec, "sparse"), ["user_id"], at, "at_us").select("event_id", "covered")


@query("covered_seconds", f"SELECT user_id, sum(end_us - start_us) / 1e6 AS covered_s FROM {_COVER} GROUP BY 1")
def covered_seconds(spark, d):
    return assembly.covered_seconds(align.coverage(recording(spark, d), "sparse"), ["user_id"])


@query("source_span", f"SELECT user_id, min(us) / 1e6 + 12.5 AS start, max(us) / 1e6 + 12.5 AS \"end\" FROM {REC} GROUP BY 1")
def source_span(spark, d):
    return assembly.span(recording(spark, d), align.clock(F.col("us") / 1e6, 12.5))


_DATED = "(SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 10 = 9 THEN 'never' WHEN o_orderkey % 10 = 8 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN o_orderkey % 10 = 7 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE '+02:00' END END AS text FROM orders)"


@query("mixed_timezone", f"SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 7 THEN epoch_us(o_orderdate) - CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 7200000000 END END AS us, CASE o_orderkey % 10 WHEN 9 THEN 'invalid_timestamp' WHEN 8 THEN 'mixed_timezone' END AS reason FROM {_DATED}")
def mixed_timezone(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    text = F.when(k % 10 == 9, "never").when(k % 10 == 8, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(k % 10 == 7, "").otherwise(F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 2 == 0, "Z").otherwise("+02:00")))
    return times.date_times(_t(spark, d, "orders").select("o_orderkey", text.alias("text")), "text", [], "Europe/Zurich").select("o_orderkey", "us", "reason")


@query("naive_times", f"SELECT event_id, us - 3600000000 AS us FROM {REC}")
def naive_times(spark, d):
    e = events(spark, d).select("event_id", "user_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("text"))
    return times.date_times(e, "text", ["user_id"], "Europe/Zurich").select("event_id", "us")


@query("dates_in_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def dates_in_text(spark, d):
    k, t = F.col("o_orderkey") % 5, F.col("o_orderdate").cast("timestamp")
    text = F.when(k == 0, F.concat(F.lit("run_12_"), F.date_format(t, "yyyy-MM-dd"), F.lit("_b.csv"))).when(k == 1, F.concat(F.lit("Blatt "), F.date_format(t, "d.M.yyyy"))).when(k == 2, F.concat(F.lit("2024-13-40 "), F.date_format(t, "dd_MM_yyyy"))).when(k == 3, "99.99.2024").otherwise(F.lit(None))
    return _t(spark, d, "orders").select("o_orderkey", times.date_in_text(text).alias("day"))


@query("sheet_times", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN TIMESTAMP '2024-05-06 07:08:00' WHEN 1 THEN TIMESTAMP '2024-05-06 07:08:09.5' WHEN 2 THEN TIMESTAMP '2024-03-01 12:00:00' WHEN 3 THEN TIMESTAMP '2024-05-06 06:00:00' END AS at FROM orders")
def sheet_times(spark, d):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "7:08").when(k == 1, "07:08:09,5").when(k == 2, "45352.5").when(k == 3, "0.25").otherwise("later")
    return _t(spark, d, "orders").select("o_orderkey", times.cell_datetime(text, F.lit("2024-05-06").cast("date")).cast("timestamp_ntz").alias("at"))


@query("master_wall", f"SELECT event_id, make_timestamp(us) + INTERVAL 1 HOUR AS wall FROM {REC}")
def master_wall(spark, d):
    return events(spark, d).select("event_id", times.master_wall(F.col("us") / 1e6, "Europe/Zurich").alias("wall"))


@query("clock_origin", f"SELECT event_id, 1717624800000000 + CAST(round((s - f) * 1e6) AS BIGINT) + 29289000000 AS us FROM (SELECT *, first_value(s) OVER (PARTITION BY user_id ORDER BY row) AS f FROM (SELECT event_id, user_id, row, us / 1e6 AS s FROM {REC}))")
def clock_origin(spark, d):
    from datetime import date

    start = times.origin_us("clock", "Europe/Zurich", 8 * 3600 + 8 * 60 + 9.0, clock_date=date(2024, 6, 6))
    e = events(spark, d).withColumn("s", F.col("us") / 1e6)
    from pyspark.sql import Window

    rel = F.col("s") - F.first("s").over(Window.partitionBy("user_id").orderBy("row"))
    return e.select("event_id", (F.lit(start) + F.round(rel * 1e6).cast("long")).alias("us"))
