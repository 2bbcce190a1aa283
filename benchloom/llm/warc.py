"""WARC archives: written by the text sink, parsed by Content-Length, assembled to one row per capture.

Each row becomes three records, a request, a response (or a revisit) and a metadata record, joined by WARC-Concurrent-To.
Archives are gzip files in any store Spark can write: the sink's line separator is the blank lines that end a record.
Reading parses each file as a stream; payloads may hold any bytes, also those of record headers.

Defined results: a null payload is empty, a null url has no target, a null page id no page-id field. Of rows with equal
payloads of at least ``min_revisit`` bytes the one with the largest page id is the response (rows that tie with it are
responses too, null ids come last, and rows with null ids only are all responses). Repeated rows give as many captures.
An empty table gives an archive without records, other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, content_type string, header_digest string, payload_bytes bigint, payload_digest string, fields map<string,string>, payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in one file at most; with the size of partitions this bounds what a reading task holds.
RECORDS_PER_FILE = 9000


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null. Line ends within a value are escaped."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _record(kind: Column, record_id: Column, url: Column, concurrent: Column, content_type: str, block: Column, *more: Column) -> Column:
    return F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", record_id), _line("WARC-Date", F.lit("2024-01-01T00:00:00Z")), _line("WARC-Target-URI", url),
        _line("WARC-Concurrent-To", concurrent), *more, F.lit(f"Content-Type: {content_type}\r\n"), _line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )


def write_archives(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 1000) -> str:
    """Write the records of all rows of ``df`` under ``path`` and return it.

    Equal payloads are found by SHA-1: a partial maximum per digest, then a join that AQE splits where a digest is hot.
    """
    rows = df.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    same = rows.filter(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("best"), F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(same, "digest", "left")
    again = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best.page_id"))
    main, ask, about = (_urn(k, F.col("page_id"), F.col("url"), F.col("digest")) for k in ("main", "request", "metadata"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    refers = F.when(again, _urn("main", F.col("best.page_id"), F.col("best.url"), F.col("digest")))
    host = F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/\r\n]*)", 1), F.lit(""))
    target = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/\r\n]*([^#\r\n]*)", 1), F.lit("")), F.lit("/"))
    request = F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    fields = F.concat(_line("page-id", F.col("page_id").cast("string")), F.lit("via: benchloom\r\n"))
    records = F.array(
        _record(F.lit("request"), ask, F.col("url"), main, "application/http; msgtype=request", request),
        _record(F.when(again, "revisit").otherwise("response"), main, F.col("url"), F.lit(None).cast("string"), "application/http; msgtype=response", F.concat(http, F.when(again, "").otherwise(F.col("payload"))),
                _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), _line("WARC-Profile", F.when(again, REVISIT_PROFILE)), _line("WARC-Refers-To", refers)),
        _record(F.lit("metadata"), about, F.col("url"), main, "application/warc-fields", fields),
    )
    out = rows.select(F.explode(records).alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


def _headers(f, what: str) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := f.readline()).rstrip(b"\r\n"):
        if not line.endswith(b"\n"):
            raise ValueError(f"{what}: cut short")
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parse_records(content: bytes) -> Iterator[dict]:
    """The records of one archive, gzip or plain; damaged archives raise."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        h = _headers(f, "WARC header")
        n = int(h["content-length"])
        block = f.read(n)
        if len(block) != n:
            raise ValueError("WARC block: cut short")
        kind, payload, fields = h.get("warc-type"), block, {}
        size, digest = len(block), None
        if kind in ("response", "revisit", "request"):
            inner = io.BytesIO(block)
            fields = {"start-line": inner.readline().decode("utf-8", "replace").rstrip()} | _headers(inner, "HTTP header")
            payload = block[inner.tell() :]
            size = int(fields["content-length"]) if kind == "revisit" else len(payload)
        elif kind == "metadata":
            fields, payload = _headers(io.BytesIO(block + b"\r\n"), "fields"), b""
        said = h.get("warc-payload-digest", "").removeprefix("sha1:").lower() or None
        if kind == "response":
            digest = hashlib.sha1(payload).hexdigest()
            if said and said != digest:
                raise ValueError(f"{h.get('warc-record-id')}: payload digest {digest}, header {said}")
        yield {
            "record_type": kind, "record_id": h.get("warc-record-id"), "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"),
            "content_type": h.get("content-type"), "header_digest": said, "payload_bytes": size, "payload_digest": digest or said, "fields": list(fields.items()), "payload": payload,
        }


_ARROW = pa.schema([(c, pa.string()) for c in ("record_type", "record_id", "concurrent_to", "refers_to", "target_uri", "content_type", "header_digest")] + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; without ``payloads`` the payload is null, its size and digest stay."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for r in parse_records(content.as_py()):
                    if not payloads:
                        r["payload"] = None
                    rows.append(r)
                    held += len(r["payload"] or b"")
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: its response or revisit, with its request and metadata record nested, null where missing.

    Requests and metadata find their response by WARC-Concurrent-To, wherever their archives are. Of several requests (or
    metadata records) of one response one is taken; requests without a response give no row.
    """
    part = lambda kind, *cols: records.filter(F.col("record_type") == kind).dropDuplicates(["concurrent_to"]).select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", *cols).alias(kind))
    main = records.filter(F.col("record_type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), "target_uri", F.struct("record_type", "payload_bytes", "payload_digest", "refers_to", "fields", "payload").alias("response"))
    return main.join(part("request", "fields"), "capture_id", "left").join(part("metadata", "fields"), "capture_id", "left")
