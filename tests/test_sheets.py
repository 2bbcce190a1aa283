import numpy as np
import pytest

from benchloom.operators import grids, sync

GRID = [["Protocol"], ["Start [h]", "End", "Sample", "T, K"], ["22:10", "22:40", "A", "300"], ["23:50", "00:20", "", ""], ["", "", "", ""], ["00:30", "", "B", "310"], ["later", "", "C", ""], ["01:00", "00:50:30", "C", "1"], ["02:00", "", "D", "x"]]


def test_steps_of_a_sheet(spark):
    m = grids.Mapping("start", "end", "sample", {"t": "T"}, {"t": "293"}, fixed_s=600)
    rows = grids.derive_steps(spark, GRID, m).orderBy("row").collect()
    got = [(r.row, r.status, r.label, r.start, r["end"], r.params["t"]) for r in rows if r.status == "step"]
    assert got == [(3, "step", "A", 79800.0, 81600.0, "300"), (4, "step", "A", 85800.0, 87600.0, "293"), (6, "step", "B", 88200.0, 90000.0, "310"), (8, "step", "C", 90000.0, 175830.0, "1"), (9, "step", "D", 93600.0, 94200.0, "x")]
    assert {r.row: r.reason for r in rows if r.status != "step"} == {5: "empty row", 7: "start 'later' is no time"}


def test_headers():
    assert grids.match_header("t", ["T [K]", "U"]) == 0 and grids.match_header("x", ["y"]) is None
    with pytest.raises(LookupError, match="several"):
        grids.match_header("t", ["T [K]", "T [C]"])
    with pytest.raises(LookupError, match="did you mean 'Sample'"):
        grids.find_header_row(GRID, ["start", "Smple"])


def test_correlation_finds_a_shift(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300).cumsum()
    a, b = x[20:220].copy(), x[13:213].copy()
    a[50:60] = np.nan
    lags, r, n = sync.correlation_curve(a, b, 30)
    for lag in (-30, -3, 0, 7, 30):
        i = np.arange(max(0, -lag), min(200, 200 - lag))
        ok = np.isfinite(a[i])
        assert r[lag + 30] == pytest.approx(np.corrcoef(a[i][ok], b[i + lag][ok])[0, 1]) and n[lag + 30] == ok.sum()
    frame = lambda v: spark.createDataFrame([("g", i, float(y)) for i, y in enumerate(v) if np.isfinite(y)], "g string, k long, v double")
    row = sync.cross_correlate(frame(a), frame(b), ["g"], "k", "v", 30).first()
    assert row.lag == pytest.approx(7, abs=0.3) and row.r > 0.99 and not [c for c in row.checks if c.startswith("fail")]
    assert "fail: no correlation" in sync.best_lag(rng.normal(size=400), rng.normal(size=400), 5)["checks"]


def test_correlation_in_blocks(spark):
    """Blocks of any size give the curve of the whole, for groups of their own offset, gaps and length."""
    rng = np.random.default_rng(2)
    signals, frames = {}, ([], [])
    for g, n, shift, at in (("p", 900, 5, -300), ("q", 333, -11, 10**9), ("r", 40, 0, 7)):
        x = rng.normal(size=n + 40).cumsum()
        a, b = x[20 : 20 + n].copy(), x[20 - shift : 20 - shift + n].copy()
        a[n // 3 : n // 2], b[::9] = np.nan, np.nan
        signals[g] = sync.best_lag(a, b, 17)
        for rows, v in zip(frames, (a, b)):
            rows += [(g, at + i, float(y)) for i, y in enumerate(v) if np.isfinite(y)]
    frames[0].append(("alone", 1, 1.0))
    for side in frames:
        side += [("apart", i + (10**6 if side is frames[1] else 0), float(i)) for i in range(5)]
    a, b = (spark.createDataFrame(rows, "g string, k long, v double") for rows in frames)
    for block in (34, 100, None):
        got = {r.g: r for r in sync.cross_correlate(a, b, ["g"], "k", "v", 17, block).collect()}
        assert set(got) == {"p", "q", "r", "apart"} and got["apart"].checks == ["fail: no lag with enough overlap"]
        for g, want in signals.items():
            assert (got[g].lag, got[g].r, got[g].overlap) == pytest.approx((want["lag"], want["r"], want["overlap"]), abs=1e-9)
            assert got[g].checks == want["checks"]
