"""XML settings and Excel sheets: small files read with the standard library, fetched by Spark from any store."""

from __future__ import annotations

import difflib
import hashlib
import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from benchloom.operators.reshape import unique_names
from benchloom.sources import sqlite, xls

# Words of settings that are never kept.
SECRETS = ("password", "passwd", "secret", "token", "apikey", "api_key", "key")


#: Bytes of a sheet or settings file that the driver may take; larger ones belong in a table.
LIMIT = 1 << 30


def fetch(spark: SparkSession, path: str) -> bytes:
    """A file's bytes through Spark; for settings and sheets of devices, which are small: more than LIMIT raises."""
    size = spark.read.format("binaryFile").load(path).select("length").first()
    if size is not None and size.length > LIMIT:
        raise MemoryError(f"{path}: {size.length} bytes, {LIMIT} can be taken")
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    return bytes(row.content)


def put_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """A small file, written by Spark's file system to any store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def sha256(spark: SparkSession, path: str) -> DataFrame:
    """source, sha256 and length of every file under a path: read as a stream, so that files may have any size.

    A digest depends on all bytes in order, so one file is one stream; several files are one after the other.
    """
    jvm, rows = spark._jvm, []
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(at) or []
    for f in (f for top in found for f in (fs.listStatus(top.getPath()) if top.isDirectory() else [top])):
        if f.isFile() and f.getPath().getName()[:1] not in "._":
            digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
            stream = jvm.java.security.DigestInputStream(fs.open(f.getPath()), digest)
            try:
                stream.transferTo(jvm.java.io.OutputStream.nullOutputStream())
            finally:
                stream.close()
            rows.append((f.getPath().toString(), bytes(digest.digest()).hex(), f.getLen()))
    if not rows:
        raise FileNotFoundError(path)
    return spark.createDataFrame(rows, "source string, sha256 string, length long")


def digest(spark: SparkSession, path: str) -> str:
    """The sha256 of a file; of a folder of several files, that of their digests in the order of names."""
    rows = sorted(sha256(spark, path).collect(), key=lambda r: (r.source.rsplit("/", 1)[-1], r.source))  # a row a file
    return rows[0].sha256 if len(rows) == 1 else hashlib.sha256("\n".join(r.sha256 for r in rows).encode()).hexdigest()


def reader_for(head: bytes, name: str) -> str:
    """sqlite, excel, xml or delimited, by magic bytes, then suffix."""
    if head.startswith(b"SQLite format 3\0"):
        return "sqlite"
    if head.startswith(b"PK\x03\x04") or head.startswith(b"\xd0\xcf\x11\xe0"):
        return "excel"
    if head.lstrip(b"\xef\xbb\xbf \r\n\t").startswith(b"<?xml") or name.lower().endswith(".xml"):
        return "xml"
    return "delimited"


def table_names(spark: SparkSession, path: str) -> list[str]:
    """Tables and views of an SQLite file."""
    con = sqlite.connect(sqlite.ship(spark, path))
    try:
        return sqlite.tables(con)
    finally:
        con.close()


def read_xml_meta(spark: SparkSession, path: str, blocks: list[str]) -> dict[str, object]:
    """Leaf values of the listed blocks as ``block.path``; numbers become numbers, secrets are left out."""
    root = ElementTree.fromstring(fetch(spark, path))
    out: dict[str, object] = {}

    def walk(node: ElementTree.Element, name: str) -> None:
        if len(node):
            for child in node:
                walk(child, f"{name}.{child.tag.rsplit('}', 1)[-1]}")
            return
        text = (node.text or "").strip()
        if text and not any(s in name.lower().replace("-", "_").split(".")[-1] for s in SECRETS):
            out[name] = float(text) if re.fullmatch(r"[+-]?\d+(?:\.\d+)?", text) else text

    for node in root.iter():
        tag = node.tag.rsplit("}", 1)[-1]
        if tag in blocks:
            walk(node, tag)
    return out


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def sheet_names(content: bytes) -> list[str]:
    """The sheets of a book, ``.xlsx`` or ``.xls``, in its order."""
    if content.startswith(xls.MAGIC):
        return xls.sheet_names(content)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS)]


def key_values(grid: list[list[str]], reach: int = 500) -> dict[str, str]:
    """A side sheet's pairs: the first filled cell of a row names the second."""
    out = {}
    for row in grid[:reach]:
        cells = [c.strip() for c in row if c.strip()]
        if len(cells) > 1:
            out.setdefault(cells[0], cells[1])
    return out


def column_letters(n: int) -> str:
    """A for 1, AA for 27."""
    out = ""
    while n > 0:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def parse_a1(cell: str) -> tuple[int, int]:
    """Row and column, from 0, of an address such as B7."""
    m = re.fullmatch(r"\s*\$?([A-Za-z]{1,3})\$?([1-9][0-9]*)\s*", cell)
    if not m:
        raise LookupError(f"{cell!r} is no cell")
    return int(m[2]) - 1, column_number(m[1].upper()) - 1


def display_text(value: object) -> str:
    """A cell's value as it is read: whole numbers without a point, dates and times in ISO form, nothing for none."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return str(int(value)) if value == value and abs(value) < 1e15 and value == int(value) else repr(value)
    return value.isoformat(" ") if hasattr(value, "hour") and hasattr(value, "year") else value.isoformat() if hasattr(value, "isoformat") else str(value).strip()


def read_grid(content: bytes, sheet: str | None = None) -> list[list[str]]:
    """All cells of a sheet (``.xlsx`` or ``.xls``) as text, rows of equal length; an unknown sheet names the others."""
    if content.startswith(xls.MAGIC):
        found: dict[int, dict[int, str]] = {}
        for i, j, v in xls.cells(content, sheet):
            found.setdefault(i, {})[j] = v if isinstance(v, str) else display_text(v)
        return _rectangle(found)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): links[s.get(f"{{{_NS['r']}}}id")] for s in book.find("m:sheets", _NS)}
        sheet = sheet or next(iter(sheets))
        if sheet not in sheets:
            raise KeyError(f"no sheet {sheet!r}; there are {', '.join(sheets)}")
        target = sheets[sheet].lstrip("/")
        root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    rows: dict[int, dict[int, str]] = {}
    for row in root.iter(f"{{{_NS['m']}}}row"):
        at = int(row.get("r") or len(rows) + 1)
        for i, c in enumerate(row):
            m = re.match(r"([A-Z]+)", c.get("r") or "")
            k = column_number(m[1]) if m else i + 1
            v = c.find("m:v", _NS)
            text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else shared[int(v.text)] if c.get("t") == "s" and v is not None else v.text if v is not None else ""
            rows.setdefault(at - 1, {})[k - 1] = text or ""
    return _rectangle(rows)


def _rectangle(rows: dict[int, dict[int, str]]) -> list[list[str]]:
    width = max((k for r in rows.values() for k in r), default=-1) + 1
    return [[rows.get(i, {}).get(k, "") for k in range(width)] for i in range(max(rows, default=-1) + 1)]


def sheet_rows(books: DataFrame, sheet: str | None = None) -> DataFrame:
    """path, row (from 0) and cells of a sheet of each book in ``books`` (path, content: as Spark's ``binaryFile`` gives them).

    Each book is read by the task that holds it, so any number of books is read at once. Cells are texts, null where empty; rows
    without any are kept, as their numbers count. An empty file has no rows.
    """

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                grid = read_grid(content, sheet) if content else []
                for low in range(0, len(grid), 8192):
                    part = grid[low : low + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array(range(low, low + len(part)), pa.int64()), pa.array([[c or None for c in r] for r in part], pa.list_(pa.string()))], ["path", "row", "cells"])

    return books.select("path", "content").mapInArrow(read, "path string, row long, cells array<string>")


def read_excel(spark: SparkSession, path: str, sheet: str | None = None, header_row: int | None = None, numbered: str | None = None) -> DataFrame:
    """A sheet as text columns; without ``header_row`` (from 1) it is the row with most text cells of the first 50. ``numbered``: a first column with the rows' numbers from 0."""
    grid = read_grid(fetch(spark, path), sheet)
    is_text = lambda c: bool(c.strip()) and not re.fullmatch(r"[+-]?\d+(?:[.,]\d+)?(?:[eE][+-]?\d+)?", c.strip())
    at = header_row - 1 if header_row else max(range(min(len(grid), 50)), key=lambda i: (sum(map(is_text, grid[i])), -i), default=0)
    names = unique_names([c.strip() or f"col_{i}" for i, c in enumerate(grid[at])]) if grid else []
    body = [[c if c != "" else None for c in r] for r in grid[at + 1 :] if any(c.strip() for c in r)]
    first = [StructField(numbered, LongType())] if numbered else []
    return spark.createDataFrame([[i, *r] for i, r in enumerate(body)] if numbered else body, StructType([*first, *[StructField(n, StringType()) for n in names]]))


def locate(grid: list[list[str]], label: str | None = None, direction: str = "right", n: int = 1, reach: int = 50, cell: str | None = None) -> str:
    """The n-th cell that is not empty right of or below a label (case and spaces do not count), or that at an address."""
    if cell is not None:
        i, j = parse_a1(cell)
        return grid[i][j] if i < len(grid) and j < len(grid[i]) else ""
    key = lambda c: re.sub(r"\s+", "", c).lower().rstrip(":")
    hits = [(i, j) for i, row in enumerate(grid) for j, c in enumerate(row) if c.strip() and key(c) == key(label or "")]
    if not hits:
        near = difflib.get_close_matches(label or "", [c for row in grid for c in row if c.strip()], 1)
        raise LookupError(f"no cell {label!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
    if len(hits) > 1:
        raise LookupError(f"{label!r} is in several cells: " + ", ".join(f"{column_letters(j + 1)}{i + 1}" for i, j in hits))
    i, j = hits[0]
    cells = grid[i][j + 1 : j + 1 + reach] if direction == "right" else [r[j] for r in grid[i + 1 : i + 1 + reach]]
    found = [c for c in cells if c.strip()]
    if len(found) < n:
        raise LookupError(f"{label!r} has {len(found)} values {direction} of it")
    return found[n - 1]


def write_result(df: DataFrame, path: str) -> None:
    """Results as text with semicolons and a header."""
    df.write.option("sep", ";").option("header", True).csv(path)


def to_arrow(df: DataFrame, limit_bytes: int = 1 << 30):
    """A result as an Arrow table on the driver; one estimated beyond the limit raises, as it belongs in a store."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    rows = df.count() if size > limit_bytes else 0
    if rows * max(len(df.columns), 1) * 16 > limit_bytes:
        raise MemoryError(f"{rows} rows are more than {limit_bytes} bytes; write them to a store")
    return df.toArrow()


def column_array(df: DataFrame, name: str):
    """One column as a NumPy array."""
    return to_arrow(df.select(name)).column(0).to_numpy()


def write_analysis(df: DataFrame, path: str, name: str, texts: dict[str, str] | None = None) -> None:
    """The table of an analysis as text with semicolons: lines of what it rests on (``# key: text``) come before its header.

    Analyses have a row for each group, so one task writes the file.
    """
    head = [f"# analysis: {name}", *(f"# {k}: {v}" for k, v in (texts or {}).items()), ";".join(df.columns)]
    lines = df.select(F.lit(1).alias("part"), F.concat_ws(";", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value"))
    first = df.sparkSession.createDataFrame([(0, "\n".join(head))], "part int, value string")
    first.unionByName(lines).orderBy("part", "value").coalesce(1).select("value").write.text(path)
