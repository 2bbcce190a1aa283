import re

import public_tokenizers

import corpus_pipeline as cp
from benchloom.llm import jaccard, quality

from . import test_decontaminate, test_jaccard, test_packing, test_pii  # noqa: F401

D = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1)))}


def redacted(text):
    spans, out, at = [], [], 0
    for start, _, end, kind in test_pii.brute(text):
        if spans and start < spans[-1][1]:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([start, end, kind])
    for start, end, kind in spans:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    items = {r.item_id: shingles(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()}
    kept = {r.doc_id: r for r in cp.quality_stage(spark, docs, D).collect()}
    accepted = {r.doc_id for r in quality.classify(docs, labels, keep=["doc_id"]).filter("accepted").collect()}
    assert set(kept) == accepted and len(kept) < docs.count()
    current = spark.createDataFrame(list(kept.values()), docs.schema)
    for name, stage in cp.STAGES[1:]:
        before = {r.doc_id: r for r in current.collect()}
        after = stage(spark, current, D)
        if name == "near_duplicates":
            groups = test_jaccard.brute([(r.doc_id, r.text) for r in before.values()], 5, 80, 100)
            want = {d for d, n, c in groups if d == c or n == 0}
            assert {r.doc_id for r in after.collect()} == want and len(want) < len(before)
        elif name == "decontamination":
            bad = {d for d, r in before.items() if any(len(s & shingles(r.text)) >= 0.8 * len(s) for s in items.values() if s)}
            assert {r.doc_id for r in after.collect()} == set(before) - bad and bad
        elif name == "pii":
            rows = after.collect()
            assert {r.doc_id: r.text for r in rows} == {d: redacted(r.text) for d, r in before.items()}
            assert all(r.n_chars == len(r.text) for r in rows) and any(re.search(r"\[EMAIL\]", r.text) for r in rows)
        else:
            rows = after.collect()
            test_packing.check(rows, test_packing.brute([(r.doc_id, r.text) for r in before.values()], cp.CAPACITY), cp.CAPACITY)
            break
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        current = spark.createDataFrame(after.collect(), docs.schema)
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_one_row_of_each_group_stays(spark):
    rows = test_jaccard.corpus(7, 60)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, root string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in jaccard.deduplicate(df).collect()), key=str)
    groups = {}
    for doc_id, n, c in test_jaccard.brute(rows, 5, 80, 100):
        if n:
            groups.setdefault(c, []).append(doc_id)
    empty = [r for r in rows if not (r[1] or "").split()]
    assert len(got) == len(groups) + len(empty)
    assert sorted((d for d, t in got if (t or "").split()), key=str) == sorted(groups, key=str)


def test_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", None, None, None)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, D)
        assert docs.count() == len(table)
