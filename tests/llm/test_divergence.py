import random

import pytest

from benchloom.llm import divergence, queries

from .util import same_rows

SQL = queries.ORACLE_SQL["op11_divergence"]
SCHEMA = "lang string, source string, text string"


def rows(n, seed=0):
    r = random.Random(seed)
    words = ["Alpha", "beta", "gamma9delta", "Ärger", "ärger", "x\x00y", "日本語", "don't", "e\x85f", "[\\]^_`{|}~", "10%"] + [f"w{chr(97 + i)}" for i in range(20)]
    langs, sources = ["en", "de", None, ""], ["a", "b", None, "", "é", "z1"]
    return [(r.choice(langs), r.choice(sources), r.choice([None, "", " ".join(r.choices(words, k=r.randrange(40)))]) if r.random() < 0.2 else " ".join(r.choices(words, weights=range(1, len(words) + 1), k=r.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 9, 200, 900])
def test_against_sql(spark, n):
    df = spark.createDataFrame(rows(n, n) + [("one", "s", "rare"), ("two", "s", "rare"), ("two", "t", None)] * bool(n), SCHEMA)
    same_rows(divergence.audit(df), SQL, documents=df)


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    same_rows(queries.op11_divergence(spark, d), SQL, documents=f"{d}/documents.parquet")


def test_sums_in_parts_and_long_texts(spark, monkeypatch):
    """One source with a third of all rows, texts of a megabyte, many batches a task, and tasks that sum after every few rows."""
    monkeypatch.setattr(divergence, "ROWS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    df = spark.createDataFrame(rows(300, 1) + [("en", "hot", f"word{chr(97 + i % 26)} common") for i in range(150)] + [("en", "long", "common wa wb " * 80_000)], SCHEMA).repartition(5)
    try:
        same_rows(divergence.audit(df), SQL, documents=df)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_clashing_columns(spark):
    df = spark.createDataFrame([(*x, "t", 1) for x in rows(200, 2)], SCHEMA + ", term string, count int")
    same_rows(divergence.audit(df), SQL, documents=df)
