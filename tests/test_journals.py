"""Journals in many books: what is wrong with one book is that book's own problem."""

from benchloom.operators.grids import Mapping
from benchloom.sources import journals, xls


def _books(spark):
    good = xls.write_book({"Log": [["Who:", "me"], ["Start", "End", "Label"], [1.0, 2.5, "a"], [], [4.0, None, None], [6.0, None, "b"]], "Other": [["x"]]})
    no_end = xls.write_book({"Log": [["start [s]", "label"], [3.0, "z"]]})
    return spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(no_end)), ("c", bytearray(b"no book")), ("d", bytearray(b"")), ("e", bytearray(xls.write_book({"Else": [["q"]]}))), ("f", None)], "path string, content binary")


def test_steps_of_books(spark):
    rows = journals.steps_of_books(_books(spark), Mapping("Start", "End", "Label", fixed_s=10.0), "Log").collect()
    of = {p: [r for r in rows if r.path == p] for p in "abcdef"}
    assert [(r.row, r.status, r.reason, r.label, r.start, r.end) for r in of["a"]] == [
        (3, "step", None, "a", 1.0, 2.5), (4, "excluded", "empty row", "a", None, None), (5, "step", None, "a", 4.0, 6.0), (6, "step", None, "b", 6.0, 16.0),
    ]
    assert of["a"][0].cells == {"Start": "1", "End": "2.5", "Label": "a"} and of["a"][0].params == {}
    for p in "bcdef":
        assert [(r.status, r.start) for r in of[p]] == [("problem", None)] and of[p][0].reason
    assert "End" in of["b"][0].reason and "Log" in of["e"][0].reason


def test_located(spark):
    rows = journals.located(_books(spark), {"who": {"label": "who"}, "third": {"label": "label", "direction": "below", "n": 2}}, "Log").collect()
    found = {(r.path, r.name): (r.value, r.problem) for r in rows}
    assert found["a", "who"] == ("me", None) and found["a", "third"] == ("b", None)
    assert found["b", "who"][0] is None and "no cell" in found["b", "who"][1] and "1 values" in found["b", "third"][1]
    assert all(found[p, "who"][0] is None and found[p, "who"][1] for p in "cdef") and len(rows) == 12


def test_no_books(spark):
    none = _books(spark).limit(0)
    assert journals.steps_of_books(none, Mapping("Start")).count() == 0 and journals.located(none, {"x": {"cell": "A1"}}).count() == 0
