import pytest
from pyspark.sql import functions as F

from benchloom.operators.campaign import Campaign, Measure, Session, Source, expand_path
from benchloom.operators.stationary import calibration_formula
from benchloom.sources.profiles import Profile, detect


def campaign(path):
    return Campaign(
        {"a": Source(path, "us", ["x"], ["dev"], "row", offset_s=10.0, derived={"y": "2 * x"})}, {"x_mean": Measure("x"), "y_slope": Measure("y", "slope"), "n": Measure("x", "n")},
        {"k": [3.0, 0.1]}, {"z": "x_mean * k"}, {"ok": "z > 20"}, {"late": "start > 15", "early": "start <= 15"})


def test_documents_are_fix_points(monkeypatch):
    c = campaign("${DATA}/a")
    assert Campaign.from_json(c.to_json()) == c and Campaign.from_json(c.to_json()).to_json() == c.to_json()
    with pytest.raises(KeyError, match="colour"):
        Campaign.from_json('{"colour": 1}')
    monkeypatch.setenv("DATA", "/d")
    assert expand_path("${DATA}/a") == "/d/a"
    with pytest.raises(KeyError, match="NOT_SET"):
        expand_path("${NOT_SET}/a")


def test_results(spark, tmp_path):
    spark.createDataFrame([("d", i, i * 1_000_000, float(i)) for i in range(20)], "dev string, row long, us long, x double").write.parquet(str(tmp_path / "a"))
    s = Session(spark, campaign(str(tmp_path / "a")))
    table = spark.createDataFrame([("d", 1, 10.0, 14.0), ("d", 2, 20.0, 25.0)], "dev string, step_id long, start double, end double")
    rows = {r.step_id: r for r in s.results(table, ["dev"]).collect()}
    assert rows[1].x_mean == pytest.approx(2.0) and rows[2].x_mean == pytest.approx(12.5) and rows[2].y_slope == pytest.approx(2.0)
    assert (rows[1]["class"], rows[2]["class"]) == ("early", "late") and (rows[1].ok, rows[2].ok) == (False, True)
    assert rows[2].z == pytest.approx(37.5) and rows[2].b_z__k == pytest.approx(1.25) and rows[2].n == 6
    assert s.coverage("a", "x").agg(F.count("*")).first()[0] == 1


def test_wrong_campaigns_fail_loudly(spark):
    c = campaign("p")
    c.measures["bad"] = Measure("no")
    c.calculations["k"] = "1"
    with pytest.raises(ValueError, match="no channel no.*used twice"):
        Session(spark, c)


def test_profiles():
    ps = [Profile("any", "delimited", "*.csv"), Profile.from_json('{"name": "dev", "reader": "delimited", "pattern": "*.csv", "hints": ["# device"]}'), Profile("db", "sqlite")]
    assert detect(ps, "x/A.CSV", b"# device 7\n").name == "dev" and detect(ps, "a.csv", b"t,x").name == "any"
    assert detect(ps, "a", b"SQLite format 3\0").name == "db" and detect(ps, "a.xml", b"<?xml") is None


def test_calibration():
    assert eval(calibration_formula("x", 10.0, 4.0, 2.0), {"x": 6.0}) == 10.0
