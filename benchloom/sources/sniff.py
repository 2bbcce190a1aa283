"""What a delimited file looks like, from its head and tail: encoding, delimiter, header, decimal separator, footer."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from benchloom.functions.typing import SENTINELS
from benchloom.operators.reshape import unique_names

DELIMITERS = (",", ";", "\t", "|")


@dataclass
class Sniffed:
    """``header_row`` counts lines from 0; ``footer`` is the number of lines at the end that hold no data."""

    encoding: str
    delimiter: str
    header_row: int
    names: list[str]
    decimal: str
    footer: int
    sentinels: list[str] = field(default_factory=list)


def decode(data: bytes, cut: bool = False) -> tuple[str, str]:
    """Text and encoding: UTF-8 with or without a mark, else Latin-1; ``cut``: the last character may be there in part."""
    try:
        return data.decode("utf-8-sig"), "utf-8"
    except UnicodeDecodeError as e:
        if cut and e.start >= len(data) - 3 and e.reason == "unexpected end of data":
            return data[: e.start].decode("utf-8-sig"), "utf-8"
        return data.decode("latin-1"), "latin-1"


def delimiter_of(lines: list[str]) -> str:
    """The delimiter whose count per line is most consistent over 100 lines, then that of most columns."""
    rows = [x for x in lines[:100] if x.strip() and not x.startswith("#")]
    best, best_score = ",", float("-inf")
    for d in DELIMITERS:
        counts = [x.count(d) for x in rows]
        if not counts or not max(counts):
            continue
        common, times = Counter(c for c in counts if c).most_common(1)[0]
        mixed = sum(any(o in part for o in DELIMITERS if o != d) for x in rows for part in x.split(d)) / len(rows)
        score = 1000 * times / len(counts) + common - 50 * mixed
        if score > best_score:
            best, best_score = d, score
    return best


def header_row_of(lines: list[str], delimiter: str) -> int:
    """The first of 50 lines that is neither blank nor a comment and has several fields."""
    for i, line in enumerate(lines[:50]):
        if line.strip() and not line.startswith("#") and len(line.split(delimiter)) > 1:
            return i
    return 0


def clean_headers(raw: list[str]) -> list[str]:
    names = [h.strip().strip('"') for h in raw]
    return unique_names([n or ("time" if i == 0 else f"col_{i}") for i, n in enumerate(names)])


def decimal_of(lines: list[str], delimiter: str) -> str:
    """A vote of the cells of 200 lines but for their first column."""
    if delimiter == ",":
        return "."
    comma = point = 0
    for line in lines[:200]:
        for cell in line.split(delimiter)[1:]:
            c = cell.strip().strip('"')
            if c.replace(",", "", 1).lstrip("+-").isdigit() and "," in c:
                comma += 1
            elif c.replace(".", "", 1).lstrip("+-").isdigit() and "." in c:
                point += 1
    return "," if comma > point else "."


def footer_of(lines: list[str], delimiter: str) -> int:
    """Lines at the end that are blank, comments, of one field, or without any value but the first."""
    n = 0
    for line in reversed(lines):
        cells = line.split(delimiter)
        if line.strip() and not line.startswith(("#", "//", "*")) and len(cells) > 1 and any(c.strip() for c in cells[1:]):
            break
        n += 1
    return n


def sniff_text(text: str, encoding: str = "utf-8", delimiter: str | None = None, decimal: str | None = None) -> Sniffed:
    lines = text.splitlines()
    d = delimiter or delimiter_of(lines)
    at = header_row_of(lines, d)
    body = lines[at + 1 :]
    cells = {c.strip().strip('"') for x in body[:200] for c in x.split(d)}
    return Sniffed(encoding, d, at, clean_headers(lines[at].split(d)) if lines else [], decimal or decimal_of(body, d), footer_of(body, d), sorted(c for c in cells if c and (c in SENTINELS or c.upper() in SENTINELS)))


def head_bytes(spark: SparkSession, path: str, n: int = 1 << 20) -> tuple[bytes, int]:
    """The first bytes of a file (of a folder's files in the order of their names, as one) in any store Spark reaches, and its length; nothing else is read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f for f in fs.globStatus(at) or []]
    if not found:
        raise FileNotFoundError(path)
    files = sorted((f for top in found for f in (fs.listStatus(top.getPath()) if top.isDirectory() else [top]) if f.isFile() and f.getPath().getName()[:1] not in "._"), key=lambda f: (f.getPath().getName(), f.getPath().toString()))
    if not files:
        raise FileNotFoundError(path)
    head, length = b"", sum(f.getLen() for f in files)
    for f in files:
        if len(head) >= n:
            break
        if head and not head.endswith(b"\n"):
            head, length = head + b"\n", length + 1  # a file's end ends its last line
        stream = fs.open(f.getPath())
        try:
            head += bytes(stream.readNBytes(n - len(head)))
        finally:
            stream.close()
    return head, length


def sniff(spark: SparkSession, path: str, sample_bytes: int = 1 << 20, **options) -> Sniffed:
    """Sniffs the file at ``path``, in any store; only its first megabyte reaches the driver."""
    head, length = head_bytes(spark, path, sample_bytes)
    text, encoding = decode(head, length > len(head))
    return sniff_text(text.rsplit("\n", 1)[0] if length > len(head) else text, encoding, **options)
