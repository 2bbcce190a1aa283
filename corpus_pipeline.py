"""A corpus pipeline of five stages; each works on what its predecessor kept.

Quality: rejected documents (junk or toxic) go. Near duplicates: one document of each group stays (five-word shingles,
Jaccard of at least 0.8). Decontamination: documents that hold a benchmark item go (containment of at least 0.8). Personal
data: spans are replaced by their kind in brackets, n_chars follows. Packing: the rest in sequences of 2048 tokens.

Defined results: a null or empty text is an empty one: quality judges its shape, it has no duplicates, benchmark items or
spans, stays null, and is packed as its end token alone. Texts of any length are processed whole. Rows repeated with id and
text stay once, if they have words. Other columns stay up to the last stage, whatever their names; without documents the
result is empty, without labels nothing is rejected, without benchmark items nothing is contaminated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.llm import decontaminate, jaccard, packing, pii, quality
from benchloom.llm.common import free_names, materialize

CAPACITY = 2048


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).filter("accepted").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicate(docs, k=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans, clean = free_names(docs.columns, "spans", "clean")
    found = pii.find_pii(docs, out=spans).withColumn(clean, pii.redact(docs, spans=spans))
    new = {"text": F.col(clean)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size(spans) > 0, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Tokens and learned weights have no SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage keeps is written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
