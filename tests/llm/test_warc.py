import pytest
from pyspark.sql import functions as F

from benchloom.llm import queries, warc

from .util import same_rows

LONG = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc é " * 60
ROWS = [(1, "http://a.org/x", LONG), (2, None, LONG), (5, "https://b.org", LONG), (5, "https://b.org", LONG), (None, "http://n.org/a\r\nb", LONG), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "", ""), (None, None, None), (8, "v", LONG + "x"), (9, "v", "y" * 999), (10, "v", "y" * 999)]
SCHEMA = "page_id long, url string, html string"


def run(spark, rows, tmp_path, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    return df, queries.op9_warc(spark, str(tmp_path))


def test_round_trip_gives_every_page(spark, tmp_path):
    df, out = run(spark, ROWS, tmp_path)
    same_rows(out, queries.ORACLE_SQL["op9_warc"], pages=df)


def test_whole_small_table(spark):
    d = "/root/testdata/sf0.001"
    same_rows(queries.op9_warc(spark, d), queries.ORACLE_SQL["op9_warc"], pages=f"{d}/pages.parquet")


def test_payloads_and_nesting_survive(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.org/p?q#f", LONG, "x")], SCHEMA + ", record_type string")
    path = warc.write_archives(df, f"{tmp_path}/w")
    row = warc.assemble(warc.read_archives(spark, path)).collect()[0]
    assert bytes(row.response.payload).decode() == LONG and row.target_uri == "http://a.org/p?q#f"
    assert row.request.fields["start-line"] == "GET /p?q HTTP/1.1" and row.request.fields["host"] == "a.org"
    assert row.metadata.fields["page-id"] == "1"


def test_missing_parts_and_damage(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:1], SCHEMA)
    records = warc.read_archives(spark, warc.write_archives(df, f"{tmp_path}/w"))
    row = warc.assemble(records.filter("record_type != 'request'")).collect()[0]
    assert row.request is None and row.metadata is not None
    assert warc.assemble(records.filter("record_type = 'request'")).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    path = warc.write_archives(df, f"{tmp_path}/w")
    assert warc.assemble(warc.read_archives(spark, path)).filter(F.lit(True)).count() == 0
