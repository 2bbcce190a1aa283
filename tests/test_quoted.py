"""Quoted cells with line ends, against the csv module, whatever the splits."""

import csv
import io
import random

import pytest

from benchloom.sources import delimited, quoted


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def text_of(rows, d):
    quote = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in ('\n', '"', d)) else c
    return "".join(d.join(map(quote, r)) + "\n" for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_against_the_csv_module(spark, tmp_path, small_splits, seed):
    r, d = random.Random(seed), ",;\t|"[seed]
    cells = ["", "x", "a b", f"p{d}q", 'say "hi"', "two\nlines", "\n", f'"{d}\n"', "many\n" * r.randrange(1, 400), "#no comment\n# here"]
    rows = [[f"r{i}", r.choices(cells, [30, 30, 20, 5, 5, 3, 1, 1, 1, 1])[0], r.choice(cells[:6])] for i in range(2500)]
    text = text_of(rows, d)
    (tmp_path / "f.csv").write_text(text)
    assert spark.read.text(str(tmp_path / "f.csv")).rdd.getNumPartitions() > 5
    found = {x.row_index: x.value for x in quoted.records(spark, str(tmp_path / "f.csv"), "utf-8", d).collect()}
    want = [next(csv.reader(io.StringIO(found[i], newline=""), delimiter=d)) for i in sorted(found)]
    assert want == [x for x in csv.reader(io.StringIO(text, newline=""), delimiter=d)] == rows
    line = 0
    for i, row in zip(sorted(found), rows):
        assert i == line
        line += 1 + sum(c.count("\n") for c in row)


def test_one_late_quote_in_many_splits(spark, tmp_path, small_splits):
    rows = [f"{i};{i}.5;on" for i in range(6000)]
    rows[5000] = '5000;1.5;"on\noff;\n"'
    (tmp_path / "f.csv").write_text("time;x;s\n" + "\n".join(rows) + "\n;;\n# end\n")
    df = delimited.load(spark, str(tmp_path / "f.csv")).df
    assert df.count() == 6000 and df.filter("time_seconds is null or x is null").count() == 0
    late = df.filter("time_seconds >= 5000").orderBy("row_index").limit(2).collect()
    assert late[0].s == "on\noff;\n" and (late[0].row_index, late[1].row_index) == (5001, 5004)


def test_quotes_that_are_text(spark, tmp_path, small_splits):
    rows = [f'{i};5" pipe;x' for i in range(700)] + ['700;"never closed;x'] + [f"{i};plain;y" for i in range(701, 1500)]
    (tmp_path / "f.csv").write_text("time;name;s\n" + "\n".join(rows) + "\n")
    df = delimited.load(spark, str(tmp_path / "f.csv")).df
    assert df.count() == 1500 and {r.row_index for r in df.select("row_index").collect()} == set(range(1, 1501))
    assert df.filter("time_seconds < 700 and name = '5\" pipe'").count() == 700


def test_maps_of_lines():
    both = quoted.patterns(";")
    maps = {"a;b": (0, 1), 'a;"b': (1, 0), '"a"': (0, 0), '""': (0, 1), 'x"y': (0, 0), 'end";"more': (1, 1), '""";z': (1, 0)}
    for line, ends in maps.items():
        assert quoted.line_map(line, *both, ";") == ends, line
