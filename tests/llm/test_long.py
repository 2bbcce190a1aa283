"""Texts of megabytes, through every operator on texts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from benchloom.llm import common, decontaminate, html, jaccard, lm, packing, pii, quality

WORDS = ["".join(random.Random(i).choice("abcdefghij") for _ in range(3 + i % 6)) for i in range(3000)]


def long_text(seed, size=2_500_000):
    rng = random.Random(seed)
    out, n = [], 0
    while n < size:
        out.append(rng.choice(WORDS))
        n += len(out[-1]) + 1
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    return {1: long_text(1), 2: "short one here", 3: None, 4: long_text(1)[:200_000] + " a@b.co " + long_text(4, 100_000), 5: ""}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "http://h/p/x", "en") for i, t in texts.items()], "doc_id long, text string, source string, lang string")


def test_language_model(docs, texts):
    got = {r.doc_id: r for r in lm.score(docs, order=3).collect()}
    for i, t in texts.items():
        assert got[i].n_tokens == len((t or "").split()) + 1 and math.isfinite(got[i].score) and got[i].score < 0
    assert got[1].score / len(texts[1]) > -0.9


def test_decontamination(spark, docs, texts):
    words = texts[1].split()
    items = spark.createDataFrame([(7, " ".join(words[300_000:300_040])), (8, "nothing of this kind is in there at all")], "item_id long, text string")
    got = {r.doc_id: [m.item_id for m in r.benchmark_matches] for r in decontaminate.with_matches(docs, items).collect()}
    assert got == {1: [7], 2: [], 3: [], 4: [], 5: []}


def test_main_text(spark, texts):
    body = "".join(f"<p>{texts[1][i : i + 1000]}</p>" for i in range(0, 2_000_000, 1000))
    df = spark.createDataFrame([(1, f"<html><body><nav>Home</nav><article>{body}</article></body></html>")], "page_id long, html string")
    lines = html.main_text(df).first().main_text.split("\n")
    assert len(lines) == 2000 and lines[7] == texts[1][7000:8000].strip()


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert rows.keys() == {1, 2, 3, 4, 5} and all(0 < r.quality_probability < 1 and 0 < r.toxic_probability < 1 for r in rows.values())


def test_personal_data(docs, texts):
    found = pii.find_pii(docs)
    rows = {r.doc_id: r for r in found.withColumn("new", pii.redact(found)).collect()}
    at = texts[4].index("a@b.co")
    assert [(s.kind, s.start, s.end) for s in rows[4].pii_spans] == [("email", at, at + 6)] and rows[4].new == texts[4].replace("a@b.co", "[EMAIL]")
    assert rows[1].new == texts[1] and rows[3].new is None and rows[5].new == ""


def test_ten_thousand_spans(spark):
    text = " ".join(f"user{i}@mail{i % 7}.org word" for i in range(10_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.find_pii(df)
    row = found.withColumn("new", pii.redact(found)).first()
    assert len(row.pii_spans) == 10_000 and row.new == " ".join(["[EMAIL] word"] * 10_000)


def test_links_and_pieces(spark, docs, texts):
    import public_tokenizers

    twice = docs.unionByName(docs.filter("doc_id = 1").withColumn("doc_id", F.lit(9).cast("long")))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(twice).collect()}
    words = texts[1].split()
    assert got[1] == (len({tuple(words[i : i + 3]) for i in range(len(words) - 2)}), 1) and got[9] == (got[1][0], 1) and got[3] == (0, 3)
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).filter("doc_id = 1").orderBy("piece").collect()
    assert [p.start for p in pieces][1:] == [p.start + p.length for p in pieces][:-1] and all(p.length == 2048 for p in pieces[1:])


def test_a_shared_folder_is_set_where_none_is(spark):
    own = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        assert common.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")
    assert common.shared_dir(spark) and (own is None or common.shared_dir(spark) == own.rstrip("/"))


def test_names_apart():
    assert common.free_names(["A", "b_"], "a", "b", "a") == ["a_", "b", "a__"] and common.free_prefix(["__x", "_y"]) == "____"
