import hashlib
import io
import sqlite3
import zipfile

import pytest

from benchloom.sources import delimited, files, loader, sniff, sqlite
from benchloom.sources.profiles import Profile

CSV = "# device 7\nTime;Temp [°C];Run;State\n0,0;1.234,5;1;on\n1,0;ERR;1;on\n2,0;12f;2;\n3,5;7,25;2;off\n;;;\n"


def write(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def test_sniffing():
    s = sniff.sniff_text(CSV)
    assert (s.delimiter, s.header_row, s.names, s.decimal, s.footer) == (";", 1, ["Time", "Temp [°C]", "Run", "State"], ",", 1)
    assert s.sentinels == ["ERR"]
    assert sniff.clean_headers(["", "a", "a", ""]) == ["time", "a", "a_1", "col_3"]
    assert sniff.decode("é".encode("latin-1")) == ("é", "latin-1") and sniff.decode(b"\xef\xbb\xbfx")[0] == "x"


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_loading_types_and_audits_cells(spark, tmp_path, encoding):
    path = write(tmp_path, "a.csv", CSV.encode(encoding))
    data = delimited.load(spark, path, run_columns=("run",))
    rows = [(r.time_seconds, r.temp, r.run, r.state) for r in data.df.orderBy("row_index").collect()]
    assert rows[:4] == [(0.0, 1234.5, 1, "on"), (1.0, None, 1, "on"), (2.0, None, 2, None), (3.5, 7.25, 2, "off")]
    assert {(r.column, r.raw_value, r.reason) for r in data.audit.collect()} == {("temp", "ERR", "sentinel_value"), ("temp", "12f", "non_convertible_float")}
    assert data.units["temp"] == "°C" and data.kinds["run"] == "identifier"
    again = delimited.load(spark, path, spec=data.spec)
    assert again.spec == data.spec and again.df.collect() == data.df.collect()


def test_clock_times_count_on_over_midnight(spark, tmp_path):
    path = write(tmp_path, "b.csv", "time,x\n23:59:58,1\n23:59:59,2\n00:00:01,3\nnever,4\n")
    data = delimited.load(spark, path)
    assert [r.time_seconds for r in data.df.orderBy("row_index").collect()] == [86398.0, 86399.0, 86401.0, None]
    assert [r.reason for r in data.audit.collect()] == ["invalid_timestamp"]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "c.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (id INTEGER, x REAL, s TEXT, b BLOB)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(1, 1.5, "a", b"\x01"), (2, None, None, None)])
    con.commit()
    con.close()
    assert [tuple(r) for r in sqlite.read(spark, path).collect()] == [(1, 1.5, "a", "01"), (2, None, None, None)]
    assert sqlite.read(spark, path, sql="SELECT sum(id) AS n FROM t").first().n == 3
    with pytest.raises(KeyError, match="t"):
        sqlite.read(spark, path, table="u")
    assert files.reader_for(open(path, "rb").read(16), "c.db") == "sqlite"


def test_xml_keeps_no_secrets(spark, tmp_path):
    path = write(tmp_path, "d.xml", "<a><Cal><zero>1.5</zero><password>x</password><sub><unit>V</unit></sub></Cal><Other><y>2</y></Other></a>")
    assert files.read_xml_meta(spark, path, ["Cal"]) == {"Cal.zero": 1.5, "Cal.sub.unit": "V"}


def xlsx(rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(64 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(64 + j)}{i}"><v>{v}</v></c>' for j, v in enumerate(r, 1) if v is not None) + "</row>" for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Log" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_excel(spark, tmp_path):
    content = xlsx([["Operator:", "Ann"], ["Start", "End", "Label"], [1, 2.5, "a"], [3, None, "b"]])
    path = write(tmp_path, "e.xlsx", content)
    assert [tuple(r) for r in files.read_excel(spark, path).collect()] == [("1", "2.5", "a"), ("3", None, "b")]
    grid = files.read_grid(content)
    assert files.locate(grid, "operator") == "Ann" and files.locate(grid, "Start", "below", 2) == "3"
    with pytest.raises(KeyError, match="Log"):
        files.read_grid(content, "x")


def test_results_and_hashes(spark, tmp_path):
    files.write_result(spark.createDataFrame([(1, "a")], "x int, y string").coalesce(1), str(tmp_path / "out"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "out")).collect()[0].y == "a"
    write(tmp_path, "h.txt", "abc")
    assert files.sha256(spark, str(tmp_path / "h.txt")).first().sha256.startswith("ba7816bf")


@pytest.mark.parametrize("d", [",", ";", "\t", "|"])
def test_footer_is_left_out_of_large_files_too(spark, tmp_path, d):
    rows = [f"{i}{d}{i}.5{d}on" for i in range(100_000)]
    rows[7] = f"7{d}{d}"
    end = ["// end", "* note", "100000 rows", f"100001{d} {d}", "", "# done"]
    path = write(tmp_path, "f.csv", "\n".join([d.join(["time", "x", "s"]), *rows, *end]) + "\n")
    data = delimited.load(spark, path)
    assert data.df.count() == 100_000 and data.audit.count() == 0
    assert data.df.filter("x is null").count() == 1


def test_sqlite_by_ranges(spark, tmp_path):
    path = str(tmp_path / "r.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, x, s TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i * 3 - 500, i if i < 900 else i + 0.5, None if i % 7 else f"s{i}") for i in range(1000)])
    con.execute("CREATE TABLE w (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
    con.execute("INSERT INTO w VALUES ('a', 1)")
    con.execute("CREATE VIEW seen AS SELECT x FROM t WHERE id > 0")
    con.commit()
    con.close()
    df = sqlite.read(spark, path, "t", numbered="row_index", split_rows=100)
    assert df.rdd.getNumPartitions() >= 20 and dict(df.dtypes) == {"row_index": "bigint", "id": "bigint", "x": "double", "s": "string"}
    assert [tuple(r) for r in df.orderBy("row_index").collect()] == [(i, i * 3 - 500, float(i if i < 900 else i + 0.5), None if i % 7 else f"s{i}") for i in range(1000)]
    assert sqlite.read(spark, path, "t", where="x >= 990", split_rows=100).count() == 10
    assert sqlite.read(spark, path, "w").collect()[0].v == 1 and sqlite.read(spark, path, "seen").count() == 833
    with pytest.raises(sqlite3.OperationalError):
        sqlite.read(spark, path, sql="SELECT nothing FROM t")
    with pytest.raises(KeyError, match="seen, t, w"):
        sqlite.read(spark, path)


def test_many_files_by_profile_on_their_origins(spark, tmp_path):
    rows = lambda low, high: "Zeit,Masse\n" + "".join(f"{i},{i * 2}\n" for i in range(low, high))
    a, b = write(tmp_path, "a.csv", rows(0, 5)), write(tmp_path, "b.csv", rows(3, 8))
    own = Profile("own", "delimited", ("*.csv",), ("Masse",), {"time_column": "Zeit", "zone": "UTC", "origin": "2024-01-01T00:00:00"})
    table, conflicts, skipped = loader.load_many(spark, [a, b, a], profiles=(own,))
    base = 1704067200
    assert [(r.time_seconds - base, r.masse, r.source_no) for r in table.orderBy("time_seconds").collect()] == [(float(i), 2.0 * i, 0 if i < 3 else 1) for i in range(8)]
    assert skipped == [a] and conflicts.count() == 0
    clock = write(tmp_path, "c.csv", "Zeit,Masse\n23:59:59,1\n00:00:01,2\n")
    day = Profile("day", "delimited", ("*.csv",), ("Masse",), {"time_column": "Zeit", "zone": "UTC", "clock_date": "2024-01-01"})
    times = [r.time_seconds for r in loader.load_many(spark, [clock], profile=day)[0].orderBy("time_seconds").collect()]
    assert times == [base + 86399.0, base + 86401.0]


def test_digests_of_streams(spark, tmp_path):
    data = bytes(range(256)) * 50_000
    write(tmp_path, "big.bin", data)
    r = files.sha256(spark, str(tmp_path / "big.bin")).first()
    assert (r.sha256, r.length) == (hashlib.sha256(data).hexdigest(), len(data))
    with pytest.raises(FileNotFoundError):
        files.sha256(spark, str(tmp_path / "none"))
