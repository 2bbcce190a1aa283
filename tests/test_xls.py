import random
import struct

import pytest

from benchloom.plans import files as plans
from benchloom.sources import files, xls


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def book(cells: bytes, before: bytes = b"", version: int = 0x0600) -> bytes:
    head = record(xls.BOF, struct.pack("<HHHHII", version, 5, 0, 0, 0, 6)) + before
    at = len(head) + 4 + 8 + 3 + 4
    bound = record(xls.BOUNDSHEET, struct.pack("<IBBBB", at, 0, 0, 3, 0) + b"Tag")
    return xls.compound(head + bound + record(xls.EOF, b"") + record(xls.BOF, struct.pack("<HHHHII", 0x0600, 0x10, 0, 0, 0, 6)) + cells + record(xls.EOF, b""))


@pytest.mark.parametrize("rows", [0, 1, 60, 4000])
def test_round_trip(rows):
    r = random.Random(rows)
    value = lambda: r.choice([1.5, -3, 10**7, "x" * r.randint(1, 40), "ü€😀" * r.randint(1, 30 if rows > 60 else 3000), "", None])
    grid = [[value() for _ in range(5)] for _ in range(rows)]
    content = xls.write_book({"Größe": grid, "B": [["k"]]})
    assert xls.sheet_names(content) == ["Größe", "B"]
    assert {(i, j): v for i, j, v in xls.cells(content)} == {(i, j): v for i, row in enumerate(grid) for j, v in enumerate(row) if v not in ("", None)}
    with pytest.raises(KeyError, match="there are Größe, B"):
        list(xls.cells(content, "C"))


def test_all_kinds_of_cells():
    at = lambda i, j: struct.pack("<HHH", i, j, 0)
    cells = [
        record(xls.RK, at(0, 0) + struct.pack("<I", (7 << 2) | 2)),
        record(xls.RK, at(0, 1) + struct.pack("<I", ((-250 & 0x3FFFFFFF) << 2) | 3)),
        record(xls.MULRK, struct.pack("<HHHIHIH", 1, 2, 0, (5 << 2) | 2, 0, 0x40590000, 3)),
        record(xls.LABEL, at(2, 0) + struct.pack("<HB", 2, 0) + b"ab"),
        record(xls.LABEL, at(2, 1) + struct.pack("<HB", 1, 1) + "€".encode("utf-16-le")),
        record(xls.BOOLERR, at(3, 0) + b"\x01\x00"),
        record(xls.BOOLERR, at(3, 1) + b"\x07\x01"),
        record(xls.FORMULA, at(4, 0) + struct.pack("<dH", 2.25, 0) + bytes(4)),
        record(xls.FORMULA, at(4, 1) + b"\0" * 6 + b"\xff\xff" + bytes(6)),
        record(xls.STRING, struct.pack("<HB", 3, 0) + b"sum"),
        record(xls.FORMULA, at(4, 2) + b"\x01\0\x01\0\0\0\xff\xff" + bytes(6)),
        record(xls.FORMULA, at(4, 3) + b"\x02\0\x2a\0\0\0\xff\xff" + bytes(6)),
        record(xls.FORMULA, at(4, 4) + b"\x03\0\0\0\0\0\xff\xff" + bytes(6)),
    ]
    chart = record(xls.BOF, bytes(16)) + record(xls.NUMBER, at(9, 9) + bytes(8)) + record(xls.EOF, b"")
    grid = files.read_grid(book(b"".join([*cells[:3], chart, *cells[3:]])))
    assert grid == [["7", "-2.5", "", ""], ["", "", "5", "100"], ["ab", "€", "", ""], ["1", "#DIV/0!", "", ""], ["2.25", "sum", "1", "#N/A"]]


def test_what_is_not_read():
    with pytest.raises(ValueError, match="password"):
        list(xls.cells(book(b"", record(xls.FILEPASS, b"\0\0"))))
    with pytest.raises(ValueError, match="older"):
        list(xls.cells(book(b"", version=0x0500)))
    with pytest.raises(ValueError, match="without a book"):
        xls.stream(xls.compound(b"x", "Other"))
    with pytest.raises(ValueError, match="not a compound"):
        xls.stream(b"PK")


def test_as_xlsx(spark, tmp_path):
    """The journal of nations gives the same sheet, header and cells from both kinds of book."""
    modern = files.fetch(spark, plans._workbook(spark, "/root/testdata/sf0.001"))
    grid = files.read_grid(modern)
    old = xls.write_book({"Tag": [[float(c) if c.isdigit() else c for c in r] for r in grid]})
    assert files.read_grid(old, "Tag") == grid and files.sheet_names(old) == files.sheet_names(modern)
    path = files.put_bytes(spark, f"{tmp_path}/journal.xls", old)
    df = files.read_excel(spark, path, numbered="row_index")
    assert df.columns == ["row_index", "Nr", "Name", "Region [id]"]
    assert [tuple(r)[1:] for r in df.orderBy("row_index").collect()] == [tuple(r) for r in grid[3:]]
    assert files.reader_for(old[:8], "journal.xls") == "excel"
    (tmp_path / "empty.xls").write_bytes(b"")
    rows = files.sheet_rows(spark.read.format("binaryFile").load(f"{tmp_path}/*.xls")).collect()
    assert len(rows) == len(grid) and {r.path.rsplit("/", 1)[-1] for r in rows} == {"journal.xls"} and [r.row for r in rows] == list(range(len(grid)))
