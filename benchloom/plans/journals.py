"""Queries on journals in many books, on campaigns put together from them, and on kept levels of detail."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from benchloom.operators import assembly, grids, pyramid, quality
from benchloom.operators.campaign import Campaign, Session, Source
from benchloom.plans.files import _place
from benchloom.plans.recordings import REC, SEG, events, recording
from benchloom.plans.steady import _step_rows
from benchloom.plans.steps import INSIDE, STEPS
from benchloom.registry import query
from benchloom.sources import journals, xls

_BOOK = 400


def _books(spark, d):
    """One journal a _BOOK customers: titles, a header whose wording and place differ by book, a row each; every fourth book lacks it."""

    def book(part: pd.DataFrame) -> pd.DataFrame:
        no = int(part["no"].iloc[0])
        part = part.sort_values("c_custkey")
        head = [["Journal", "Operator:", None, f"team {no}"], *[[]] * (no % 3)]
        start, end = (("Start [s]", "END"), ("start", "End [s]"), ("S t a r t", "end:"))[no % 3]
        names = ["What", start, end, "Nation"] if no % 4 < 3 else ["What", "Begin", "x", "Nation"]
        rows = [[f"block {k}" if k % 5 == 0 else None, "soon" if k % 11 == 0 else None if k % 13 == 0 else float(k), None if k % 7 == 0 else k + (-1.0 if k % 9 == 0 else 0.25), int(m)] for k, m in zip(part["c_custkey"], part["c_nationkey"], strict=True)]
        return pd.DataFrame({"path": [f"{no}.xls"], "content": [xls.write_book({"Data": [*head, names, *rows]})]})

    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey", F.floor(F.col("c_custkey") / _BOOK).alias("no"))
    return c.groupBy("no").applyInPandas(book, "path string, content binary")


_MAPPING = grids.Mapping("Start", "End", "What", {"nation": "Nation"})


@query("sheet_steps", f"""WITH c AS (SELECT *, c_custkey AS k, c_custkey // {_BOOK} AS no FROM customer),
t AS (SELECT *, k % 11 > 0 AND k % 13 > 0 AS timed, last_value(CASE WHEN k % 5 = 0 THEN 'block ' || k END IGNORE NULLS) OVER (PARTITION BY no ORDER BY k ROWS UNBOUNDED PRECEDING) AS label FROM c WHERE no % 4 < 3),
e AS (SELECT *, CASE WHEN timed THEN CAST(k AS DOUBLE) END AS "start", CASE WHEN timed THEN coalesce(CASE WHEN k % 7 > 0 THEN k + CASE WHEN k % 9 = 0 THEN -1.0 ELSE 0.25 END END, min(CASE WHEN timed THEN k END) OVER (PARTITION BY no ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) END AS "end" FROM t)
SELECT no || '.xls' AS path, CASE WHEN timed AND "end" > "start" THEN 'step' ELSE 'excluded' END AS status,
  CASE WHEN k % 11 = 0 THEN 'start ''soon'' is no time' WHEN k % 13 = 0 THEN 'no start' WHEN "end" IS NULL THEN 'no end' WHEN "end" <= "start" THEN 'end is not after start' END AS reason,
  label, "start", CAST("end" AS DOUBLE) AS "end", CAST(c_nationkey AS VARCHAR) AS nation, CASE WHEN k % 11 > 0 AND k % 13 > 0 THEN CAST(k AS VARCHAR) WHEN k % 11 = 0 THEN 'soon' END AS cell FROM e
UNION ALL SELECT DISTINCT no || '.xls', 'problem', 'no row has Start, End', NULL, NULL, NULL, NULL, NULL FROM c WHERE no % 4 = 3""")
def sheet_steps(spark, d):
    """Steps of journals in many books, whose headers are found by text, without units or spaces; a book without them is a problem of its own."""
    out = journals.steps_of_books(_books(spark, d), _MAPPING, "Data")
    start = F.array_compact(F.array(*[F.col("cells")[h] for h in ("Start [s]", "start", "S t a r t")]))
    why = F.when(F.col("status") == "problem", F.regexp_extract("reason", "^(no row has Start, End)", 1)).otherwise(F.col("reason"))
    return out.select("path", "status", why.alias("reason"), "label", "start", "end", F.col("params")["nation"].alias("nation"), F.get(start, F.lit(0)).alias("cell"))


@query("located_cells", f"""WITH b AS (SELECT DISTINCT c_custkey // {_BOOK} AS no FROM customer) SELECT no || '.xls' AS path, 'operator' AS name, 'team ' || no AS value, FALSE AS lacking FROM b UNION ALL SELECT no || '.xls', 'corner', 'Journal', FALSE FROM b
  UNION ALL SELECT no || '.xls', 'second', CASE WHEN no % 4 < 3 AND no % 3 > 0 THEN (SELECT v FROM (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'soon' ELSE CAST(c_custkey AS VARCHAR) END AS v, row_number() OVER (ORDER BY c_custkey) AS r FROM customer WHERE c_custkey // {_BOOK} = b.no AND (c_custkey % 11 = 0 OR c_custkey % 13 > 0)) WHERE r = 2) END, no % 4 = 3 OR no % 3 = 0 FROM b""")
def located_cells(spark, d):
    """Of each book: the cell beside a label, one by its address, and the second value below a header that some books lack."""
    places = {"operator": {"label": "operator"}, "corner": {"cell": "A1"}, "second": {"label": "start", "direction": "below", "n": 2}}
    return journals.located(_books(spark, d), places).select("path", "name", "value", F.col("problem").isNotNull().alias("lacking"))


def _kept(spark, d, name: str, campaign: Campaign) -> Session:
    path = _place(spark, name)
    events(spark, d).write.parquet(path)
    campaign.sources["rec"] = Source(path, "us", ["value"], ["user_id"], "row", offset_s=2.0, derived={"double": "2 * value", "broken": "nope + 1"})
    return Session(spark, campaign)


@query("calculated_channels", f"SELECT event_id, us / 1e6 + 2 AS master_s, 2 * value AS double, CAST(NULL AS DOUBLE) AS broken, 1 AS problems FROM {REC}")
def calculated_channels(spark, d):
    """A source's calculated channels on master time; one that cannot be calculated is null and a problem."""
    s = _kept(spark, d, "channels", Campaign())
    df = s.recording("rec").df
    return df.select("event_id", "master_s", "double", "broken", F.lit(len(s.problems)).alias("problems"))


@query("campaign_steps", f"""SELECT CAST(step_id AS VARCHAR) AS step_id, s0 AS "start", s1 AS "end", 'step' AS status, FALSE AS manual FROM {STEPS} WHERE s1 - s0 <= 86400 UNION ALL SELECT 'h1', 1704100000.0, 1704103600.0, NULL, TRUE
  UNION ALL SELECT CAST(step_id AS VARCHAR), s0, s1, 'excluded', NULL FROM {STEPS} WHERE s1 - s0 > 86400""")
def campaign_steps(spark, d):
    """The steps of two tables and one set by hand, and the rows that are none."""
    t = _step_rows(spark, d).withColumn("status", F.when(F.col("end") - F.col("start") > 86400, "excluded").otherwise("step"))
    hand = Campaign(manual_steps=[{"step_id": "h1", "label": "by hand", "start": 1704100000.0, "end": 1704103600.0}])
    good, bad = Session(spark, hand).all_steps([t.filter("step_id % 2 = 0"), t.filter("step_id % 2 = 1")])
    return good.select("step_id", "start", "end", "status", "manual").unionByName(bad.select(F.col("step_id").cast("string").alias("step_id"), "start", "end", "status"), allowMissingColumns=True)


@query("recipe_results", f"SELECT s.step_id, i.m AS level, i.m * 3 AS scaled, i.m * 3 > 700 AS high FROM {STEPS} s LEFT JOIN (SELECT step_id, avg(value) AS m FROM {INSIDE} GROUP BY 1) i USING (step_id)")
def recipe_results(spark, d):
    """Results by a recipe, an evaluation without sources, over a source's own clock that is set two seconds back."""
    recipe = {"measures": {"level": {"channel": "value"}}, "constants": {"k": [3.0]}, "calculations": {"scaled": "level * k"}, "criteria": {"high": "scaled > 700"}}
    s = _kept(spark, d, "recipe", Campaign())
    s.campaign.sources["rec"].offset_s = 0.0
    done, lacking = s.campaign.with_recipe(recipe)
    if lacking:
        raise ValueError("; ".join(lacking))
    return Session(spark, done).results(_step_rows(spark, d), ["user_id"]).select("step_id", "level", "scaled", "high")


@query("pivot_columns", "WITH n AS (SELECT DISTINCT 'p_size' AS kind, CAST(p_size AS VARCHAR) AS name, CAST(p_size AS DOUBLE) AS num FROM part UNION ALL SELECT DISTINCT 'p_brand', p_brand, NULL FROM part) SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY num, name) - 1 AS place FROM n")
def pivot_columns(spark, d):
    """The order of a pivot's columns: by number where all names are numbers, else by text."""
    p, out = spark.read.parquet(f"{d}/part.parquet"), []
    for c in ("p_size", "p_brand"):
        names = [str(r[0]) for r in p.select(c).distinct().collect()]  # the columns of a table
        out += [(c, n, i) for i, n in enumerate(assembly.column_order(names))]
    return spark.createDataFrame(out, "kind string, name string, place long")


_HOUR, _ORIGIN, _NONE = 3600 * 10**6, 1704067200 * 10**6, 1 << 62


def _columns_sql(view: str, width: int, start: int | None, end: int | None) -> str:
    low = (start - _ORIGIN) // width if start is not None else -_NONE
    high = (end - _ORIGIN) // width if end is not None else _NONE
    return f"""SELECT '{view}' AS view, user_id, pixel, at_us, low, high, n, pixel <= {high} AND coalesce(next_row = last_row + 1 AND next_seg = last_seg, FALSE) AS joined FROM
  (SELECT *, lag(pixel) OVER w AS before, lead(pixel) OVER w AS after, lead(first_row) OVER w AS next_row, lead(first_seg) OVER w AS next_seg FROM
    (SELECT user_id, (us - {_ORIGIN}) // {width} AS pixel, min(us) AS at_us, min(sparse) AS low, max(sparse) AS high, count(*) AS n, min(row) AS first_row, max(row) AS last_row, arg_min(segment, row) AS first_seg, arg_max(segment, row) AS last_seg
     FROM {SEG} WHERE sparse IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY pixel))
  WHERE coalesce(after, {_NONE}) >= {low} AND coalesce(before, {-_NONE}) <= {high}"""


_WEEK = (_ORIGIN + 7 * 24 * _HOUR, _ORIGIN + 14 * 24 * _HOUR)


@query("lod_pyramid", " UNION ALL ".join((_columns_sql("whole", 16 * _HOUR, None, None), _columns_sql("week", 4 * _HOUR, *_WEEK), _columns_sql("day", _HOUR, _WEEK[0], _WEEK[0] + 24 * _HOUR))))
def lod_pyramid(spark, d):
    """Views of a kept level of detail: a month, a week and a day, each from the level that fits its number of columns."""
    rec = recording(spark, d)
    segments = quality.with_segments(rec)
    p = pyramid.build(rec.with_df(segments), "sparse", _place(spark, "pyramid"), _ORIGIN, _HOUR, segment="segment", coarsest=40)
    segments.unpersist()
    views = {"whole": (None, None, 16), "week": (*_WEEK, 4), "day": (_WEEK[0], _WEEK[0] + 24 * _HOUR, 1)}
    parts = []
    for name, (start, end, hours) in views.items():
        level = p.level_for(start or _ORIGIN, end or _ORIGIN + 30 * 24 * _HOUR, {16: 40, 4: 40, 1: 20}[hours])
        parts.append(p.view(level, start, end).select(F.lit(name).alias("view"), "*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
