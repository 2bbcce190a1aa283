"""Queries over recordings: ``events`` by user, in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from benchloom.operators import quality, runs
from benchloom.operators.recording import Recording
from benchloom.registry import query
from benchloom.rounding import rounded


def events(spark: SparkSession, d: str) -> DataFrame:
    """``events`` with microseconds and a row number in each user's order."""
    e = spark.read.parquet(f"{d}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.row_number().over(w) - 1).cast("long").alias("row"), "ts")


def recording(spark: SparkSession, d: str) -> Recording:
    e = events(spark, d)
    e = e.withColumn("coarse", F.round(F.col("value") / 40).cast("long") * 40.0).withColumn("sparse", F.when(F.col("event_type") != "view", F.col("value")))
    return Recording(e, ("user_id",), ("user_id",), "row", "us", ("value", "coarse", "sparse"))


REC = """(SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row,
  CAST(round(value / 40) AS BIGINT) * 40.0 AS coarse, CASE WHEN event_type <> 'view' THEN value END AS sparse FROM events)"""
SEG = f"""(SELECT *, sum(CAST(is_gap AS BIGINT)) OVER (PARTITION BY user_id ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM
  (SELECT *, coalesce(med > 0 AND dt > 5 * med, false) AS is_gap FROM
    (SELECT *, median(dt) OVER (PARTITION BY user_id) AS med FROM
      (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY row) AS dt FROM {REC}))))"""


@query("gap_segments", f"SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM {SEG} GROUP BY 1, 2")
def gap_segments(spark, d):
    return quality.with_segments(recording(spark, d)).groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("run_summary", f"""WITH r AS (SELECT user_id, count(*) AS n_samples, min(us) / 1e6 AS t_start, max(us) / 1e6 AS t_end, (max(us) - min(us)) / 1e6 AS duration_s, median(dt / 1e6) AS median_dt_s, arg_min(event_type, row) AS event_type
  FROM (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY row) AS dt FROM {REC}) GROUP BY 1)
SELECT *, n_samples < 0.1 * (SELECT median(n_samples) FROM r) AS aborted FROM r""")
def run_summary(spark, d):
    return runs.run_summary(recording(spark, d), ["event_type"])


@query("channel_availability", " UNION ALL ".join(f"SELECT user_id, '{c}' AS channel, count({c}) / count(*) AS fill_ratio FROM {REC} GROUP BY 1" for c in ("value", "coarse", "sparse")))
def channel_availability(spark, d):
    return runs.availability(recording(spark, d))


@query("fill_ratio", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) / count(*) AS fill_ratio FROM {REC}" for c in ("user_id", "value", "sparse")))
def fill_ratio(spark, d):
    return runs.fill_ratio(recording(spark, d).df.select("user_id", "value", "sparse"))


@query("run_time", f"SELECT event_id, (us - min(us) OVER (PARTITION BY user_id)) / 1e6 AS run_time_s FROM {REC}")
def run_time(spark, d):
    return runs.run_time(recording(spark, d)).select("event_id", "run_time_s")


@query("constant_parameters", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", bool_and(d <= 1 OR n < 2) AS constant FROM (SELECT count(DISTINCT {c}) AS d, count({c}) AS n FROM {REC} GROUP BY user_id)" for c in ("user_id", "event_type")))
def constant_parameters(spark, d):
    return runs.constant_parameters(recording(spark, d), ["user_id", "event_type"])


FLAGS = {
    "gap": f"SELECT user_id, row, CAST(NULL AS VARCHAR) AS channel, 'gap' AS flag FROM {SEG} WHERE is_gap",
    "missing": f"SELECT user_id, row, 'sparse' AS channel, 'missing' AS flag FROM (SELECT *, count(sparse) OVER (PARTITION BY user_id) AS k FROM {REC}) WHERE k > 0 AND sparse IS NULL",
    "stuck": f"""SELECT user_id, row, 'coarse' AS channel, 'stuck' AS flag FROM (SELECT *, count(*) OVER b AS n, (max(us) OVER b - min(us) OVER b) / 1e6 AS s FROM
      (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY row ROWS UNBOUNDED PRECEDING) AS block FROM
        (SELECT *, coalesce(coarse IS DISTINCT FROM lag(coarse) OVER (PARTITION BY user_id ORDER BY row), true) OR is_gap AS fresh FROM {SEG})) WINDOW b AS (PARTITION BY user_id, block)) WHERE n >= 3 AND s >= 30""",
    "range": f"SELECT user_id, row, 'value' AS channel, 'out_of_range' AS flag FROM {REC} WHERE value < 5 OR value > 120",
}
ALL_FLAGS = " UNION ALL ".join(FLAGS.values())


def _flags(rec: Recording) -> dict[str, DataFrame]:
    seg = quality.with_segments(rec.narrow(*rec.channels))
    return {
        "gap": quality.gap_flags(seg, rec), "missing": quality.missing_flags(rec, "sparse"), "stuck": quality.stuck_flags(seg, rec, "coarse"), "range": quality.range_flags(rec, "value", 5, 120),
    }


def _all_flags(rec: Recording) -> DataFrame:
    a, b, c, e = _flags(rec).values()
    return a.unionByName(b).unionByName(c).unionByName(e)


for _name in FLAGS:

    @query(f"{_name}_flags", FLAGS[_name])
    def _one(spark, d, name=_name):
        return _flags(recording(spark, d))[name]


@query("quality_summary", f"SELECT channel, flag, count(*) AS n FROM ({ALL_FLAGS}) GROUP BY 1, 2")
def quality_summary(spark, d):
    return quality.flag_summary(_all_flags(recording(spark, d)))


@query("flag_columns", f"""WITH f AS ({ALL_FLAGS}), t AS (SELECT user_id, row, coalesce(channel, 'row') AS c, string_agg(DISTINCT flag, ',' ORDER BY flag) AS x FROM f GROUP BY 1, 2, 3)
SELECT event_id, max(CASE WHEN c = 'value' THEN x END) AS value_flags, max(CASE WHEN c = 'coarse' THEN x END) AS coarse_flags, max(CASE WHEN c = 'sparse' THEN x END) AS sparse_flags, max(CASE WHEN c = 'row' THEN x END) AS row_flags
FROM {REC} r LEFT JOIN t USING (user_id, row) GROUP BY 1""")
def flag_columns(spark, d):
    rec = recording(spark, d)
    return quality.with_flag_columns(rec, _all_flags(rec)).select("event_id", "value_flags", "coarse_flags", "sparse_flags", "row_flags")


_HALF = 12 * 3600 * 10**6
def _median_sql(x: str) -> str:
    return f"list_aggregate({x}, 'median')"


HAMPEL = f"""(SELECT *, {_median_sql('list_transform(w, lambda x: abs(x - mid))')} AS mad FROM (SELECT *, {_median_sql('w')} AS mid FROM
  (SELECT *, list(value) OVER (PARTITION BY user_id, segment ORDER BY us RANGE BETWEEN {_HALF} PRECEDING AND {_HALF} FOLLOWING) AS w FROM {SEG})))"""


@query("hampel_spikes", f"SELECT user_id, row, 'value' AS channel, 'spike' AS flag FROM {HAMPEL} WHERE mad > 0 AND abs(value - mid) > 3.0::DOUBLE * (1.4826::DOUBLE * mad)")
def hampel_spikes(spark, d):
    rec = recording(spark, d).narrow("value")
    return quality.spike_flags(quality.with_segments(rec), rec, "value", _HALF)


@query("spike_notes", f"SELECT 'value' AS channel, 'spike_mad_zero' AS note, count(*) AS n FROM {HAMPEL} WHERE mad = 0 AND value <> mid HAVING count(*) > 0")
def spike_notes(spark, d):
    rec = recording(spark, d).narrow("value")
    return quality.spike_notes(quality.with_segments(rec), rec, "value", _HALF)


@query("jump_threshold", f"""SELECT user_id, 10 * step AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM
  (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY row)) AS step FROM {REC} WHERE value IS NOT NULL) WHERE step > 0) WHERE place = floor((n - 1) * 0.99 + 0.5) + 1""")
def jump_threshold(spark, d):
    return quality.jump_threshold(recording(spark, d), "value")


@query("resolution", f"""SELECT user_id, round(min(step), 9) AS resolution FROM (SELECT user_id, v - lag(v) OVER (PARTITION BY user_id ORDER BY v) AS step FROM (SELECT DISTINCT user_id, value AS v FROM {REC} WHERE isfinite(value))) WHERE step > 0 GROUP BY 1""")
def resolution(spark, d):
    return quality.resolution(recording(spark, d), "value").withColumn("resolution", rounded("resolution", 9))


@query("spike_window", f"SELECT user_id, median(dt) * 21 / 1e6 AS window_s FROM (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY row) AS dt FROM {REC}) WHERE dt > 0 GROUP BY 1")
def spike_window(spark, d):
    return quality.spike_window(recording(spark, d))


@query("jump_candidates", f"""SELECT user_id, row, level FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, segment ORDER BY row) AS level FROM {SEG} WHERE value IS NOT NULL) WHERE abs(value - level) > 30""")
def jump_candidates(spark, d):
    rec = recording(spark, d).narrow("value")
    return quality.jump_candidates(quality.with_segments(rec), rec, "value", 30).filter("jumps").select("user_id", "row", "level")


_SPANS = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT *, lag(value) OVER w AS level, row_number() OVER w AS ordinal FROM {SEG} WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id, segment ORDER BY row)),
c AS MATERIALIZED (SELECT * FROM v WHERE abs(value - level) > 30),
b AS (SELECT a.user_id, a.segment, a.ordinal, min(k.ordinal) AS back FROM c a LEFT JOIN c k ON a.user_id = k.user_id AND a.segment = k.segment AND k.ordinal > a.ordinal AND k.us - a.us <= {4 * 86400 * 10**6} AND abs(k.value - a.level) <= 30 GROUP BY 1, 2, 3),
n AS MATERIALIZED (SELECT b.user_id, b.segment, b.ordinal, any_value(b.back) AS back, min(k.ordinal) AS next FROM b LEFT JOIN c k ON b.user_id = k.user_id AND b.segment = k.segment AND k.ordinal > coalesce(b.back, b.ordinal) GROUP BY 1, 2, 3),
r AS (SELECT user_id, segment, min(ordinal) AS ordinal FROM c GROUP BY 1, 2 UNION ALL SELECT n.user_id, n.segment, n.next FROM r JOIN n ON r.user_id = n.user_id AND r.segment = n.segment AND r.ordinal = n.ordinal WHERE n.next IS NOT NULL)
SELECT v.user_id, v.row, 'value' AS channel, CASE WHEN n.back IS NULL THEN 'jump' ELSE 'dropout' END AS flag FROM r JOIN n ON r.user_id = n.user_id AND r.segment = n.segment AND r.ordinal = n.ordinal JOIN v ON v.user_id = r.user_id AND v.segment = r.segment AND v.ordinal BETWEEN r.ordinal AND coalesce(n.back - 1, r.ordinal)"""


@query("jump_dropout", _SPANS)
def jump_dropout(spark, d):
    """A scan in order: what a dropout covers is not judged again."""
    rec = recording(spark, d).narrow("value")
    return quality.jump_flags(quality.with_segments(rec), rec, "value", 30, 4 * 86400)


@query("masked_rows", f"SELECT user_id, row, 'value' AS channel, 'masked' AS flag FROM {REC} WHERE us BETWEEN 1704500000000000 AND 1704600000000000 UNION ALL SELECT user_id, row, NULL, 'masked' FROM {REC} WHERE us BETWEEN 1704580000000000 AND 1704650000000000")
def masked_rows(spark, d):
    return quality.mask_flags(recording(spark, d), [(1704500000, 1704600000, "value"), (1704580000, 1704650000, None)])


@query("inherited_flags", f"WITH f AS ({ALL_FLAGS}) SELECT DISTINCT * FROM (SELECT * FROM f UNION ALL SELECT user_id, row, 'total', flag FROM f WHERE channel IN ('value', 'sparse') AND flag NOT LIKE 'missing%' UNION ALL SELECT user_id, row, 'ratio', flag FROM f WHERE channel IN ('value', 'sparse') AND flag NOT LIKE 'missing%')")
def inherited_flags(spark, d):
    return quality.inherited_flags(_all_flags(recording(spark, d)), {"total": ["value", "sparse"], "ratio": ["total"]})
