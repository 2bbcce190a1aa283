import random

from pyspark.sql import functions as F

from benchloom.llm import decontaminate, queries

from .util import same_rows


def words(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randrange(200)) for _ in range(n)]


def tables(spark, seed=1):
    rng = random.Random(seed)
    items = [(i, " ".join(words(rng, rng.choice([3, 5, 6, 12, 40, 90])))) for i in range(40)] + [(40, None), (41, ""), (42, "Yes No"), (0, "x y z v w u")]
    docs = [(100, None, "s"), (101, "", "s"), (102, "yes\tno", "s"), (103, "say yes no", "s")]
    for i in range(120):
        item = rng.choice(items)[1] or ""
        own = item.split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if own:
                own[rng.randrange(len(own))] = "edit"
        docs.append((i + 1000, " \n".join(words(rng, rng.randrange(400))) + " " + "  ".join(own).upper() + " é é " + " ".join(words(rng, 9)), "s"))
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")


def test_matches_those_of_sql(spark):
    docs, items = tables(spark)
    items = items.filter("text is null or text != 'x y z v w u'")
    found = decontaminate.with_matches(docs, items, keep=["doc_id"]).select("doc_id", F.explode("benchmark_matches").alias("m")).select("doc_id", "m.*")
    assert found.count() > 30
    same_rows(found, queries.ORACLE_SQL["op4_decontaminate"], documents=docs, benchmark=items)


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = tables(spark, 2)
    whole = sorted(map(str, decontaminate.with_matches(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK", 300)
    assert sorted(map(str, decontaminate.with_matches(docs, items).collect())) == whole


def test_clean_documents_stay_with_their_columns(spark):
    docs, items = tables(spark, 3)
    bad = {r.doc_id for r in decontaminate.with_matches(docs, items).collect() if r.benchmark_matches}
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and 102 in bad and 103 not in bad
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad


def test_empty_tables(spark):
    docs, items = tables(spark)
    assert decontaminate.decontaminate(docs, items.filter(F.lit(False))).count() == docs.count()
    assert decontaminate.decontaminate(docs.filter(F.lit(False)), items).count() == 0


def test_query_over_a_whole_table(spark):
    d = "/root/testdata/sf0.001"
    same_rows(queries.op4_decontaminate(spark, d), queries.ORACLE_SQL["op4_decontaminate"], documents=f"{d}/documents.parquet", benchmark=f"{d}/benchmark.parquet")
