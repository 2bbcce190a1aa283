"""Findings of round 3: rows on which a query and its SQL differed, and steps that grew too fast."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from benchloom import registry
from benchloom.operators import analyses, byhand, quantiles, sync
from benchloom.operators.grouped import map_groups
from benchloom.plans import files
from benchloom.rounding import rounded
from benchloom.sources import delimited, sniff
from benchloom.sources import files as readers

from .util import TABLES, assert_twin

registry.load()
D = "/root/testdata/sf0.001"


def with_table(tmp_path, name: str, sql: str) -> str:
    """A folder of the smallest tables, with one of them made by SQL from itself."""
    for t in TABLES:
        if t != name:
            os.symlink(f"{D}/{t}.parquet", tmp_path / f"{t}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW old AS FROM '{D}/{name}.parquet'")
    con.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def test_ratios_of_many_digits_are_rounded_alike(spark, tmp_path):
    """Spark's round goes by the decimal text, the twin's by scaling."""
    d = with_table(tmp_path, "lineitem", "SELECT * REPLACE (900 + (hash(l_orderkey * 10 + l_linenumber + i) % 1000000007) / 1000000007.0 * 104000 AS l_extendedprice, l_orderkey + i * 100000 AS l_orderkey) FROM old, range(20) r(i)")
    assert assert_twin(registry.QUERIES["formula_values"](spark, d), registry.ORACLE_SQL["formula_values"], d)


def test_rounded_edges(spark):
    values = [0.5, -0.5, 2.5, 1e308, -1e308, float("inf"), float("nan"), None, 0.49999999999999994]
    got = [r.r for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded("v", 0).alias("r")).collect()]
    assert got[:6] == [1.0, -1.0, 3.0, 1e308, -1e308, float("inf")] and got[6] != got[6] and got[7:] == [None, 0.0]
    assert spark.range(1).select(rounded(F.lit(1e306), 6).alias("r")).first().r == 1e306


def test_windows_that_lie_on_a_line_have_no_row(spark, tmp_path):
    """the twin leaves out residuals whose squares sum up to a millionth; the query left out a millionth of that."""
    at = "SELECT {i} AS event_id, TIMESTAMP '2024-01-01' + INTERVAL ({s}) SECOND AS ts, user_id, '{k}' AS event_type, {v}::DOUBLE AS value, props FROM (FROM old LIMIT 1)"
    rows = [(1, 0, "purchase", 10), (2, 100, "view", 20.0001), (3, 200, "purchase", 30), (4, 300, "view", 50), (5, 400, "purchase", 30)]
    d = with_table(tmp_path, "events", " UNION ALL ".join(at.format(i=i, s=s, k=k, v=v) for i, s, k, v in rows))
    assert assert_twin(registry.QUERIES["window_durbin_watson"](spark, d), registry.ORACLE_SQL["window_durbin_watson"], d) == 1


def test_grids_are_not_broadcast(spark):
    """a plan's estimate knows the samples, not the grid points made of them."""
    plan = registry.QUERIES["lag_correlation"](spark, D)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_steps_of_one_start_follow_their_rows(spark):
    """which of two equal starts came first was open."""
    rows = [("a", k, "08:00:00" if k < 40 else "09:00:00") for k in range(41)]
    df = spark.createDataFrame(rows, "g string, k long, s string").repartition(3).orderBy(F.desc("k"))
    out = byhand.steps_from_table(df, ["g"], "k", "s", None, F.lit("2024-05-06").cast("date"))
    assert [r.k for r in out.filter("`end` > start").collect()] == [39]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["claimed_rows", "looked_up", "cross_correlation"])
def test_groups_go_to_python_in_batches(spark, name):
    """One call for each of millions of small groups took most of the time."""
    plan = plan_of(registry.QUERIES[name](spark, D))
    assert "InPandas" not in plan and "MapInArrow" in plan


def test_short_groups_get_short_transforms(spark, monkeypatch):
    """F8: a block's transform was as long as the longest block may be, however few points it held."""
    sizes = []
    monkeypatch.setattr(sync, "map_groups", lambda df, keys, order, f, schema: sizes.append(f) or map_groups(df, keys, order, f, schema))
    rows = spark.createDataFrame([("a", k, float(k**3 % 101)) for k in range(50)], "g string, k long, v double")
    assert sync.cross_correlate(rows, rows.withColumn("k", F.col("k") + 2), ["g"], "k", "v", 5).first().lag == pytest.approx(2, abs=0.5)
    one = {"__side": np.array([0] * 50 + [1] * 50), "at": np.r_[0:50, 2:52], "v": np.ones(100), "mean_a": np.ones(100), "mean_b": np.ones(100)}
    lengths = []
    monkeypatch.setattr(sync, "products", lambda x, y, *a: lengths.append(len(y)) or np.zeros((6, 11)))
    sizes[0](one)
    assert lengths == [60]


@pytest.mark.parametrize("name", ["hampel_spikes", "spike_notes", "jump_dropout", "flag_mask"])
def test_kept_segments_have_no_column_that_no_one_reads(spark, name):
    """event ids, kinds and other channels were kept, sorted and shuffled along."""
    kept = [r for r in plan_of(registry.QUERIES[name](spark, D)).splitlines() if "InMemoryRelation" in r]
    assert kept and not any(c in r for r in kept for c in ("event_type", "event_id", "coarse", "sparse", "ts#"))


def test_percentiles_of_few_large_groups(spark):
    """F16: counts of all values of a group met in one task."""
    assert "percentile(" not in plan_of(registry.QUERIES["robust_range"](spark, D))
    v = np.random.default_rng(3).normal(size=30_011)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 1.0), ("b", 2.0), ("c", 5.0)], "g string, v double")
    got = {r.g: r for r in quantiles.percentiles(df, ["g"], "v", {"low": 0.02, "mid": 0.5, "high": 0.97}).collect()}
    for g, x in (("a", v), ("b", [1.0, 2.0]), ("c", [5.0])):
        assert [got[g].low, got[g].mid, got[g].high] == pytest.approx(np.quantile(x, [0.02, 0.5, 0.97]), rel=1e-12)


def test_links_that_no_draw_brings_to_the_level_make_none(spark):
    """every link made all draws, also far from the level."""
    rows = [("a", k, float(k), 10.0 * k, 1.0 + k % 3) for k in range(100)]
    df = spark.createDataFrame(rows, "g string, k long, x double, y double, u double")
    args = (["g"], "k", "x", "y", "u", 500.0, 30)
    pruned = analyses.monte_carlo_crossing(df, *args).first()
    near = df.filter("k between 40 and 60")  # ten links of 10 on either side, u is 3 at most
    assert pruned == analyses.monte_carlo_crossing(near, *args).first() and pruned.share == 1.0
    assert f"{analyses.REACH}" in plan_of(analyses.monte_carlo_crossing(df, *args))
    wide = analyses.monte_carlo_crossing(df.withColumn("u", F.lit(-80.0)), *args).first()
    assert wide.share == 1.0 and wide.sd > pruned.sd


def test_no_draw_is_beyond_reach():
    assert analyses.REACH > (2 * np.log(4294967297.0)) ** 0.5


def test_points_are_dealt_before_they_are_drawn(spark):
    """all draws of a file's split were made by one task."""
    plan = plan_of(registry.QUERIES["monte_carlo_line"](spark, D))
    lines = plan.splitlines()
    made, dealt = (next(i for i, r in enumerate(lines) if w in r) for w in ("Generate explode", "RepartitionByExpression"))
    assert made < dealt  # a plan is read from its end


@pytest.fixture
def many_parts(spark):
    """Small tables are written in as many files as there are partitions, and read in splits of 4 kB."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7", "spark.sql.files.maxPartitionBytes": "4k"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["load_delimited", "load_audit", "load_quoted"])
def test_exports_are_written_by_many_tasks(spark, monkeypatch, many_parts, name):
    """one task sorted and wrote the whole file; so did that of load_quoted."""
    made, place = [], files._place
    monkeypatch.setattr(files, "_place", lambda *a: made.append(place(*a)) or made[-1])
    assert assert_twin(registry.QUERIES[name](spark, D), registry.ORACLE_SQL[name], D)
    lines = [r.n for r in spark.read.text(made[0]).groupBy("_metadata.file_name").agg(F.count("*").alias("n")).collect()]
    assert len(lines) == 7 and max(lines) < sum(lines) / 3


def folder(tmp_path, *texts: str) -> str:
    """Files of very different size, as Spark deals splits by it."""
    for i, text in enumerate(texts):
        (tmp_path / f"part +%é {i}.csv").write_text(text)
    return str(tmp_path)


@pytest.mark.parametrize("pack", ["1", "4m"])
def test_files_of_a_folder_are_one_text_in_the_order_of_names(spark, tmp_path, many_parts, pack):
    """lines were numbered in the order of splits, which is that of their size."""
    spark.conf.set("spark.sql.files.openCostInBytes", pack)
    texts = ["# head\n", "time;x\n0;0,5\n", "".join(f"{i};{i},5\n" for i in range(1, 4000)), "", "4000;4000,5", "".join(f"{i};{i},5\n" for i in range(4001, 4400)), "// end\n"]
    data = delimited.load(spark, folder(tmp_path, *texts))
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [tuple(r) for r in data.df.orderBy("row_index").select("row_index", "time_seconds", "x").collect()] == [(i + 2, float(i), i + 0.5) for i in range(4400)]


def test_records_go_on_in_the_next_file(spark, tmp_path, many_parts):
    """splits of quoted files were taken in the order of their size, too."""
    rows = [f"{i};a{i}" for i in range(2000)]
    texts = ["time;s\n" + "\n".join(rows[:3]) + '\n3;"two', "files\n", 'of\n"\n' + "\n".join(rows[4:1500]) + '\n1500;"x\n', 'y"\n', "\n".join(rows[1501:])]
    for pack in ("1", "4m", "1k"):
        spark.conf.set("spark.sql.files.openCostInBytes", pack)
        df = delimited.load(spark, folder(tmp_path, *texts)).df
        got = [(r.time_seconds, r.s) for r in df.orderBy("row_index").collect()]
        spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == [(float(i), {3: "two\nfiles\nof\n", 1500: "x\ny"}.get(i, f"a{i}")) for i in range(2000)]


def test_heads_and_digests_cover_all_files_of_a_folder(spark, tmp_path):
    at = folder(tmp_path, "", "a;b", "1;2\n", "3;4\n")
    assert sniff.head_bytes(spark, at) == (b"a;b\n1;2\n3;4\n", 12) and sniff.head_bytes(spark, at, 5) == (b"a;b\n1", 12)
    before = readers.digest(spark, at)
    (tmp_path / "part +%é 3.csv").write_text("3;5\n")
    assert readers.digest(spark, at) != before
    assert readers.digest(spark, f"{at}/part +%é 2.csv") == readers.sha256(spark, f"{at}/part +%é 2.csv").first().sha256
