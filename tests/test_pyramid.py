"""Views of a written pyramid against columns of the rows themselves."""

import random

import pytest

from benchloom.operators import pyramid
from benchloom.operators.recording import Recording

W, ORIGIN = 10, 7
NAN, INF = float("nan"), float("inf")


def _rows():
    r = random.Random(11)
    out = []
    for source, n in (("hot", 4000), (None, 300), ("one", 1)):
        t, segment = -50, 0
        for i in range(n):
            step = r.choice([0, 1, 1, 2, 3, 400 if r.random() < 0.02 else 1])
            t, segment = t + step, segment + (step == 400)
            out.append((source, i, t, r.choice([None, NAN, INF]) if r.random() < 0.05 else r.gauss(0, 3), segment))
    return out


def _direct(rows, width, start=None, end=None):
    """Per source: columns of finite samples, joined by neighbouring rows of a segment; those of a span and one on either side."""
    found = []
    for source in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == source and r[3] is not None and abs(r[3]) < INF), key=lambda r: r[1])
        cells = {}
        for _, i, t, y, s in mine:
            cells.setdefault((t - ORIGIN) // width, []).append((i, t, y, s))
        pixels = sorted(cells)
        low = (start - ORIGIN) // width if start is not None else None
        high = (end - ORIGIN) // width if end is not None else None
        shown = [p for k, p in enumerate(pixels) if (low is None or p >= low or k + 1 == len(pixels) or pixels[k + 1] >= low) and (high is None or p <= high or k == 0 or pixels[k - 1] <= high)]
        for p in shown:
            here, after = cells[p], next((q for q in pixels if q > p), None)
            joined = after in shown and after is not None and cells[after][0][0] == here[-1][0] + 1 and cells[after][0][3] == here[-1][3]
            found.append((source, p, here[0][1], min(c[2] for c in here), max(c[2] for c in here), len(here), joined))
    return sorted(found, key=repr)


def _same(df, want):
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want


SCHEMA = "s string, row long, us long, x double, segment long"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = _rows()
    pyramid.CHUNK_COLUMNS, before = 64, pyramid.CHUNK_COLUMNS
    rec = Recording(spark.createDataFrame(rows, SCHEMA).repartition(7), ("s",), ("s",), "row", "us", ("x",))
    p = pyramid.build(rec, "x", str(tmp_path_factory.mktemp("pyramid")), ORIGIN, W, segment="segment", coarsest=20)
    yield rows, p
    pyramid.CHUNK_COLUMNS = before


def test_whole_levels(made):
    rows, p = made
    assert len(p.widths_us) >= 4 and p.widths_us[2] == 160
    for k, width in enumerate(p.widths_us):
        _same(p.view(k), _direct(rows, width))


def test_clips(made):
    rows, p = made
    r = random.Random(5)
    spans = [(-1000, -500), (10**7, 10**7 + 5), (0, 0), *[(a, a + r.choice([0, 30, 500, 20000])) for a in (r.randrange(-100, 30000) for _ in range(6))]]
    for start, end in spans:
        for k in (0, 2):
            _same(p.view(k, start, end), _direct(rows, p.widths_us[k], start, end))
    _same(p.view(1, start_us=500), _direct(rows, 40, 500))
    _same(p.view(1, end_us=500), _direct(rows, 40, None, 500))


def test_a_view_reads_its_level_and_prunes(spark, made):
    _, p = made
    again = pyramid.open_pyramid(spark, p.path)
    assert (again.source, again.origin_us, again.widths_us) == (p.source, p.origin_us, p.widths_us)
    plan = again.view(1, 0, 500)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "GreaterThanOrEqual(after" in plan and "LessThanOrEqual(before" in plan
    assert p.level_for(0, 4000, 100) == 1 and p.level_for(0, 1599, 10) == 1 and p.level_for(0, 1600, 10) == 2
    assert p.level_for(0, 99, 10) is None and p.level_for(0, 10**9, 1) == len(p.widths_us) - 1


def test_without_values(spark, tmp_path):
    none = spark.createDataFrame([("a", 0, 5, None, 0), ("a", 1, 6, NAN, 0)], SCHEMA)
    for i, df in enumerate((none, none.limit(0))):
        p = pyramid.build(Recording(df, ("s",), ("s",), "row", "us", ("x",)), "x", str(tmp_path / str(i)), 0, W)
        assert p.widths_us == (W,) and p.view(0, 0, 100).count() == 0
    with pytest.raises(ValueError, match="fan-out"):
        pyramid.build(Recording(none, ("s",), ("s",), "row", "us", ("x",)), "x", str(tmp_path / "no"), 0, W, fan_out=1)
