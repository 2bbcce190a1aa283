"""What campaigns hold beside their measures: choices of sources, flags, steps by hand, recipes, display, analyses."""

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from benchloom.functions import times
from benchloom.operators import assembly, byhand, evaluate, relations, stats
from benchloom.operators.campaign import Campaign, Display, Measure, Session, Source
from benchloom.operators.grids import match_header, suggest_header
from benchloom.operators.recording import Recording
from benchloom.sources import delimited, files, loader, roles
from benchloom.sources.profiles import Profile
from benchloom.sources.shipped import SHIPPED


def recordings(spark, tmp_path):
    rows = [("d", i, i * 1_000_000, float(i % 7)) for i in range(40)]
    for name, part in (("a", rows), ("b", rows[:14])):
        spark.createDataFrame(part, "dev string, row long, us long, x double").coalesce(1).write.parquet(str(tmp_path / name))
    table = spark.createDataFrame([("d", 1, "one", 0.0, 10.0), ("d", 2, "two", 20.0, 30.0)], "dev string, step_id long, label string, start double, end double")
    source = lambda n, **more: Source(str(tmp_path / n), "us", ["x"], ["dev"], "row", **more)
    return source, table


def test_measures_take_the_first_good_source_without_flagged_points(spark, tmp_path):
    source, table = recordings(spark, tmp_path)
    flags = spark.createDataFrame([("d", 3, "x", "spike")], "dev string, row long, channel string, flag string")
    c = Campaign({"b": source("b"), "a": source("a", clock_u_s=0.5)}, {"m": Measure("x", sources=["b", "a"], min_n=5, exclude_flags=["spike"], reading_u=0.5), "t": Measure("x", "two_point", sources=["a"]), "area": Measure("x", "integral", sources=["a"])})
    rows = {(r.step_id, r.measure): r for r in Session(spark, c, {"b": flags}).window_table(table, ["dev"]).collect()}
    assert (rows[1, "m"].source, rows[1, "m"].n, rows[2, "m"].source, rows[2, "m"].n) == ("b", 10, "a", 11)
    assert rows[1, "m"].checks == ["coverage 80% below 80%"] or "1 points excluded by flags" in rows[1, "m"].checks
    assert rows[1, "m"].u >= 0.5 and rows[2, "t"].u > 0 and rows[2, "area"].value == pytest.approx(sum((i % 7 + (i + 1) % 7) / 2 for i in range(20, 30)))
    one = {r.stat: r.value for r in Session(spark, c).window_stats(table, ["dev"], 2, "a", "x").collect()}
    assert one["n"] == 11 and one["covered_s"] == 10.0 and one["max"] == 6.0


def test_broken_channels_are_reported_and_recipes_applied(spark, tmp_path):
    source, table = recordings(spark, tmp_path)
    c = Campaign({"a": source("a", derived={"bad": "nope + 1", "y": "2 * x"})}, {"m": Measure("y")}, {"k": [2.0, 0.0]}, {"z": "m * k"}, own={"z": ["0.5", "random"]})
    s = Session(spark, c)
    rows = {r.step_id: r for r in s.results(table, ["dev"]).collect()}
    assert rows[1].u_z == pytest.approx((4 * rows[1].u_m ** 2 + 0.25) ** 0.5) and rows[1].source_m == "a" and "nope" in s.problems[0]
    new, lacking = c.with_recipe({"measures": {"q": {"channel": "w"}}, "calculations": {"v": "q * 2"}})
    assert lacking == ["measure q: no source has w"] and list(new.calculations) == ["v"] and c.measures.keys() == {"m"}
    with pytest.raises(KeyError, match="colour"):
        c.with_recipe({"colour": 1})
    c.criteria["ok"] = "zz > 1"
    with pytest.raises(ValueError, match="criterion ok: unknown name 'zz'"):
        Session(spark, c).results(table, ["dev"])


def test_negative_own_uncertainty_raises(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    with pytest.raises(Exception, match="own uncertainty"):
        evaluate.calculate(df, {"y": "a"}, {"a": evaluate.Input(F.col("a"), F.lit(0.1))}, {"y": evaluate.Own("a - 2")}).collect()
    with pytest.raises(ValueError, match="'k' is given as"):
        evaluate.merged_inputs({"k": (1.0, 0.1)}, {"k": (1.0, 0.2)})


def test_documents_keep_everything(spark, tmp_path):
    source, table = recordings(spark, tmp_path)
    c = Campaign({"a": source("a")}, display={"x": Display("X", color="#00ff00", scale="robust")}, manual_steps=[{"step_id": "m1", "label": "by hand", "start": 5.0, "end": 6.0}], snapshot=[{"step_id": 1, "label": "one", "start": 0.0, "end": 10.0}, {"step_id": 9, "label": "two", "start": 20.0, "end": 30.0}])
    assert Campaign.from_json(c.to_json()) == c
    moved = c.relative_to(str(tmp_path))
    assert moved.sources["a"].path == "a" and moved.below(str(tmp_path)) == c
    s = Session(spark, c)
    good, bad = s.all_steps([table.withColumn("status", F.lit("step")), table.withColumn("status", F.lit("excluded"))])
    assert [(r.step_id, r.manual) for r in good.collect()] == [("1", False), ("m1", True), ("2", False)] and bad.count() == 2
    assert {(r.step_id, r.change) for r in s.changes(table).collect()} == {(2, "moved")}
    assert c.display["x"].limits(s.recording("a").df, "x") == (0.0, 6.0) and Display("a", scale="fixed", low=1.0, high=2.0).limits(None, "x") == (1.0, 2.0) and Display().limits(None, "x") is None
    c.display["x"].color = "red"
    with pytest.raises(ValueError, match="no colour"):
        Session(spark, c)
    assert s.span("a").first().end == 39.0


def test_analyses_by_name(spark):
    df = spark.createDataFrame([("a", float(i), 2.0 * i + 1, 0.1) for i in range(6)], "g string, x double, y double, u double")
    c = Campaign(analyses={"c": {"kind": "crossing", "by": ["g"], "x": "x", "y": "y", "u": "u", "level": 6.0}, "l": {"kind": "line", "by": ["g"], "x": "x", "y": "y", "u_x": "u", "u_y": "u", "where": "x > 0"}, "n": {"kind": "none"}})
    s = Session(spark, c)
    assert s.analysis("c", df).first().x_cross == pytest.approx(2.5) and s.analysis("l", df).first().m == pytest.approx(2.0) and s.analysis("l", df).first().n == 5
    with pytest.raises(ValueError, match="no kind 'none'"):
        s.analysis("n", df)


def test_origins_and_zones():
    assert times.origin_us("clock", "Europe/Zurich", 3600.0, clock_date=date(2024, 7, 1)) == 1719788400 * 10**6
    assert times.origin_us("number", None, origin=datetime(1970, 1, 2)) == 86400 * 10**6 and times.origin_us("number", None) is None
    for bad in ({"format_": "number", "zone": None, "clock_date": date(2024, 1, 1)}, {"format_": "datetime", "zone": None, "origin": datetime(2024, 1, 1)}, {"format_": "clock", "zone": None, "origin": datetime(2024, 1, 1), "clock_date": date(2024, 1, 1)}, {"format_": "number", "zone": "Europe/Zurich", "origin": datetime(2024, 3, 31, 2, 30)}):
        with pytest.raises(ValueError):
            times.origin_us(**bad)
    with pytest.raises(ValueError, match="unknown time zone"):
        times.check_zone("Europe/Nowhere")


def test_headers_cells_and_texts():
    heads = ["Zeit", "V_MFC [Nl/min]", "v mfc 2", "Größe (mm)"]
    assert match_header("v_mfc", heads) == 1 and match_header("ZEIT", heads) == 0 and match_header("groesse", heads) == 3 and suggest_header("Zeitt", heads) == "Zeit"
    assert files.parse_a1("$B7") == (6, 1) and files.column_letters(28) == "AB" and files.column_number("AB") == 28
    assert [files.display_text(v) for v in (None, 3.0, 2.5, " a ", date(2024, 5, 6), datetime(2024, 5, 6, 7, 8))] == ["", "3", "2.5", "a", "2024-05-06", "2024-05-06 07:08:00"]
    grid = [["a", "1"], ["a", "2"], ["b", ""]]
    with pytest.raises(LookupError, match="several cells: A1, A2"):
        files.locate(grid, "a")
    assert files.key_values([["k", "", "v"], ["only"], ["n", "1"]]) == {"k": "v", "n": "1"}


def test_roles():
    kinds = {"run_id": "identifier", "Versuch": "categorical", "x": "numeric", "frame": "identifier"}
    assert roles.run_columns(kinds) == ["run_id", "Versuch"] and roles.run_columns(kinds, ["X"], {"X": "x"}) == ["x"]
    with pytest.raises(KeyError, match="no run column y"):
        roles.run_columns(kinds, ["y"])
    assert roles.units(["x", "y"], {"x": "V", "y": "A", "z": "s"}, {"y": {"unit": "mA"}}, {"X": " kV "}, {"X": "x"}) == {"x": "kV", "y": "mA"}
    assert assembly.track_groups([("x", "V", "a"), ("y", "A", "a"), ("z", "V", "b")], "unit") == {"V": ["x", "z"], "A": ["y"]}
    assert assembly.column_order(["10", "9"]) == ["9", "10"] and assembly.column_order(["b", "a1"]) == ["a1", "b"]


def test_choices_and_origins_of_files(spark, tmp_path):
    assert len(SHIPPED) == 8 and all(Profile.from_json(p.to_json()) == p for p in SHIPPED)
    path = tmp_path / "log.csv"
    path.write_text(";Letzte (C)\n08:00:00;20,5\n08:00:10;21,5\n")
    os.utime(path, (1_700_000_000, 1_700_000_000))
    got = loader.load_any(spark, str(path))
    assert got.profile.name == "thermocouple_logger" and got.meta["origin_rule"]["rule"] == "file_mtime_end" and got.origin_us == (1_700_000_000 - 10) * 10**6 and not loader.needs_clock_date(got)
    bare = loader.load_any(spark, str(path), profiles=())
    assert bare.profile is None and loader.needs_clock_date(bare)
    chosen = loader.with_choices(None, "delimited", clock_date=date(2024, 5, 6))
    placed = loader.load_any(spark, str(path), chosen)
    assert placed.origin_us == times.origin_us("clock", None, 8 * 3600.0, clock_date=date(2024, 5, 6)) and chosen.options == {"clock_date": "2024-05-06"}
    assert loader.with_choices(SHIPPED[0], "sqlite", table="t").options.get("query") is None and "query" in SHIPPED[0].options
    assert loader.default_key("t") == ["t"] and loader.default_key("t", "v") == ["t", "v"]


def test_names_exports_and_calibrations(spark, tmp_path):
    from benchloom.operators.campaign import calibrated

    path = tmp_path / "n.csv"
    path.write_text("Zeit;Temp [C]\n1,5;2,5\n2,5;3,5\n")
    data = delimited.load(spark, str(path))
    assert data.names == {"Zeit": "time_seconds", "Temp [C]": "temp"} and files.column_array(data.df, "temp").tolist() == [2.5, 3.5]
    with pytest.raises(MemoryError):
        files.to_arrow(spark.range(10_000), 1000)
    s = calibrated(Source("p", "us", ["x"], ["d"], "row"), "c", "x", 10.0, 4.0, 2.0)
    assert s.derived == {"c": "2.5 * x + -5.0"}


def test_long_files_are_numbered_by_line(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("time,x\n" + "".join(f"{i},{'bad' if i % 1000 == 7 else i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        data = delimited.load(spark, str(path))
        assert {(r.row_index, r.raw_value) for r in data.audit.collect()} == {(i + 1, "bad") for i in range(7, 20_000, 1000)}
        assert data.df.count() == 20_000 and data.df.filter("time_seconds + 1 != row_index").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_guessed_roles(spark):
    rows = [(float(i), f"{8 + i}:30", "block" if i % 4 == 0 else None, "note", float(i % 2), float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "t double, e string, b string, n string, p double, q double")
    m = byhand.guessed_mapping(df, "t", ["e", "b", "n"], ["p", "q"])
    assert (m.start, m.end, m.label, m.params) == ("t", "e", "b", {"p": "p"})


def test_intervals_of_robust_slopes_are_widened():
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.arange(200.0)
    noise = np.zeros(200)
    for i in range(1, 200):
        noise[i] = 0.8 * noise[i - 1] + rng.normal()
    m, b, low, high = stats.theil_sen(x, 0.01 * x + noise)
    independent = stats.theil_sen(x, 0.01 * x + rng.permutation(noise))
    assert low < m < high and high - low > 1.5 * (independent[3] - independent[2])
    big = np.arange(1500.0)
    assert stats.theil_sen(big, 2 * big + rng.normal(size=1500))[0] == pytest.approx(2.0, abs=1e-3)
    assert stats.steady(1.0, 1.0) and not stats.steady(3.0, 1.0) and not stats.steady(1.0, 0.0)


def test_unknown_relations_and_changes(spark):
    df = spark.createDataFrame([("a", i, float(i * 10), float(i * 10 + 5), float(i // 3)) for i in range(9)], "g string, row long, s double, e double, v double")
    at = relations.Layout(("g",), "row", "s", "e")
    out = relations.apply(df, [relations.Cumulative("total", "1", None, "changed(v)")], at)
    assert [r.total for r in out.orderBy("row").collect()] == [1.0, 2.0, 3.0] * 3 and out.columns == [*df.columns, "total", "total_run"]
    with pytest.raises(Exception, match="changed takes"):
        relations.apply(df, [relations.Bin("b", "changed(v + 1)", 1.0)], at)


def test_flags_mask_whole_rows(spark):
    df = spark.createDataFrame([("a", i, i, float(i)) for i in range(4)], "s string, row long, us long, x double")
    rec = Recording(df, ("s",), ("s",), "row", "us", ("x",))
    flags = spark.createDataFrame([("a", 1, None, "gap"), ("a", 2, "x", "spike"), ("a", 3, "y", "spike")], "s string, row long, channel string, flag string")
    got = [r.flagged for r in assembly.flag_mask(rec, flags, ["gap", "spike"], "x").orderBy("row").collect()]
    assert got == [False, True, True, False]


def test_reads_do_not_grow_with_measures(spark, tmp_path):
    source, table = recordings(spark, tmp_path)
    flags = spark.createDataFrame([("d", 3, "x", "spike"), ("d", 4, None, "gap"), ("d", 5, "y", "spike")], "dev string, row long, channel string, flag string")

    def session(**measures):
        return Session(spark, Campaign({"a": source("a", derived={"y": "2 * x"})}, measures), {"a": flags})

    few = session(m=Measure("x")).window_table(table, ["dev"])
    named = {f"{c}{stat}{skip}": Measure(c, stat, skip_start=skip) for c in ("x", "y") for stat in ("mean", "sd", "max", "n") for skip in (0.0, 2.0)}
    many = session(**named, z=Measure("y", exclude_flags=["spike"]), g=Measure("x", exclude_flags=["gap", "spike"])).window_table(table, ["dev"])
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans(few) == scans(many) > 0
    rows = {(r.step_id, r.measure): r for r in many.collect()}
    assert len(rows) == 36 and rows[1, "xmean0.0"].value == few.filter("step_id = 1").first().value
    assert (rows[1, "g"].n, rows[1, "z"].n, rows[1, "xn2.0"].value, rows[2, "ymax2.0"].value) == (9, 10, 9.0, 12.0)
    assert rows[1, "z"].value == pytest.approx((sum(2 * (i % 7) for i in range(11)) - 10) / 10)


def test_findings_of_a_windows_course(spark):
    from benchloom.operators import stationary

    def found(values, delta=None):
        rows = spark.createDataFrame([(1, float(i), float(v), 0.0, float(len(values) - 1)) for i, v in enumerate(values)], "s long, t double, v double, a double, b double")
        df = stats.robust(rows, ["s"], "t", "v", "a", "b").join(stats.slope(rows, ["s"], "t", "v", "a"), "s").join(stats.counts(rows, ["s"], "v", "a", "b"), "s").join(stats.autocorrelation(rows, ["s"], "v", "t"), "s")
        trend = stationary.Trend(*[F.col(c) for c in ("slope", "slope_se_eff", "slope_theil_sen", "ts_ci_low", "ts_ci_high", "halves_diff", "halves_u", "window_s")])
        zero = F.lit(0)
        return [c.text for c in df.select(stationary.checks(F.col("n"), F.lit(1.0), zero, zero, F.lit(2.0), n_eff=F.col("n_eff"), trend=trend, delta=delta).alias("c")).first().c]

    noise = [0.3, -0.2, 0.1, -0.4, 0.2, -0.1, 0.4, -0.3, 0.2, -0.2] * 4
    assert found(noise) == [] and found(noise, 0.5) == []
    drifting = found([x + 0.1 * i for i, x in enumerate(noise)], 0.01)
    assert drifting[0].startswith("40 points count as") and [t.split(" ")[1] for t in drifting[1:3]] == ["slope", "the"] and drifting[-1].startswith("not steady in practice")
    assert any(t.startswith("straight line") for t in found([x + (60 if i in (37, 38, 39) else 0) for i, x in enumerate(noise)]))
    assert found([1.0, 2.0], 0.1) == ["only 2 points (min 5)", "practical steadiness is not tested: no slope with an error"]


def test_analyses_of_every_kind(spark):
    rows = [("g", i, float(i), 2.0 + 3.0 * i + (0.1 if i % 2 else -0.1), 0.1, 0.2) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double, ux double, uy double").withColumns({"vx": F.col("ux") ** 2, "vy": F.col("uy") ** 2, "f": F.lit(0.1)})
    line = {"by": ["g"], "x": "x", "y": "y", "u_x": "ux", "u_y": "uy"}
    gls = {"by": ["g"], "x": "x", "y": "y", "own_x": "vx", "own_y": "vy", "factors_x": []}
    kinds = {
        "a": {"kind": "line", **line, "derived": {"e": "-m * r", "mid": "4.5 * m + b"}}, "b": {"kind": "line_gls", **gls, "factors_y": [], "derived": {"mid": "4.5 * m + b"}}, "c": {"kind": "line_gls", **gls, "factors_y": ["f"], "derived": {"mid": "4.5 * m + b"}},
        "d": {"kind": "monte_carlo_line", **line, "key": "id"}, "e": {"kind": "crossing", "by": ["g"], "x": "x", "y": "y", "u": "uy", "level": 10.0, "where": "x > 1"}, "f": {"kind": "crossing_systematic", "by": ["g"], "x": "x", "y": "y", "u": "uy", "u_syst": "ux", "level": 10.0},
        "g": {"kind": "crossing_text", "by": ["g"], "x": "x", "y": "y2", "level": 20.0, "unit": "K", "columns_of": {"y2": "2 * y"}}, "h": {"kind": "monte_carlo_crossing", "by": ["g"], "key": "id", "x": "x", "y": "y", "u": "uy", "level": 10.0},
        "i": {"kind": "aggregate", "rows": "g", "value": "y", "how": "n"}, "j": {"kind": "none"}, "k": {"kind": "aggregate", "derived": {"q": "m"}},
    }
    s = Session(spark, Campaign({}, {}, {"r": [8.314, 0.0]}, analyses=kinds))
    got = {n: s.analysis(n, df).first() for n in "abcdefgh"}
    a, b, c = got["a"], got["b"], got["c"]
    assert a.e == pytest.approx(-8.314 * a.m) and a.u_e == pytest.approx(8.314 * a.u_m)
    # In the middle of the points a line is known best, far better than its slope and intercept alone would say.
    assert a.u_mid == pytest.approx(0.36 / 8**0.5, rel=0.02) and a.u_mid < 0.5 * ((4.5 * a.u_m) ** 2 + a.u_b**2) ** 0.5
    assert (b.m, b.u_m, b.u_mid) == pytest.approx((a.m, a.u_m, a.u_mid)) and c.u_mid == pytest.approx((b.u_mid**2 + 0.01) ** 0.5)
    assert got["d"].m_mean == pytest.approx(3, abs=0.1) and got["e"].x_low < got["e"].x_cross < got["e"].x_high and got["f"].x_low_syst > got["f"].x_low
    assert got["g"].text == "3 K" and got["h"]["mean"] == pytest.approx(got["e"].x_cross, abs=0.02) and s.analysis("i", df).count() == 1
    with pytest.raises(ValueError, match="no kind 'none'"):
        s.analysis("j", df)
    with pytest.raises(ValueError, match="no derived"):
        s.analysis("k", df)
