"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.llm import ann, decontaminate, divergence, html, jaccard, lm, packing, pii, quality, records, substrings, warc, whitening
from benchloom.llm.common import materialize, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@_query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "pii_spans"))


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records, read back and assembled to captures."""
    path = warc.write_archives(_table(spark, sf_dir, "pages", "page_id", "url", "html"), new_path(spark, "warc"))
    captures = warc.assemble(materialize(warc.read_archives(spark, path, payloads=False), "records"))
    page = F.col("metadata.fields").getItem("page-id").cast("long")
    rows = captures.select("capture_id", page.alias("page_id"), "response.*")
    # The responses that revisits refer to, by record id.
    named = rows.filter("record_type = 'response'").groupBy("capture_id").agg(F.max("page_id").alias("refers_to_page"))
    # A response, which refers to nothing, keeps its own id as key, so that nulls do not meet in one task.
    rows = rows.withColumn("key", F.coalesce("refers_to", "capture_id"))
    met = rows.join(named.withColumnRenamed("capture_id", "key"), "key", "left").withColumn("refers_to_page", F.when(F.col("refers_to").isNotNull(), F.col("refers_to_page")))
    return met.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


ORACLE_SQL["op9_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS best FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest
"""


@_query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


@_query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of which a document holds at least 0.8 of the five-word shingles."""
    docs, items = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.with_matches(docs, items, keep=["doc_id"])
    return found.select("doc_id", F.explode("benchmark_matches").alias("m")).select("doc_id", "m.*")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def _shingles_sql(table: str, key: str, k: int) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i : i + {k - 1}], ' ') AS s FROM (SELECT {key}, {_WORDS} AS w FROM {table}) x, unnest(generate_series(1, greatest(len(w) - {k - 1}, least(len(w), 1)))) t(i)"


ORACLE_SQL["op4_decontaminate"] = f"""
WITH d AS ({_shingles_sql("documents", "doc_id", 5)}), b AS ({_shingles_sql("benchmark", "item_id", 5)}),
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY 1)
SELECT doc_id, n.item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles, count(*) / any_value(item_shingles) AS containment
FROM b JOIN d USING (s) JOIN n USING (item_id) GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * any_value(item_shingles)
"""


@_query
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-model and word-model scores of all documents, learned from six sevenths of them."""
    return lm.score(_table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps, with their probabilities; rejected documents are absent."""
    docs, labels = _table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return quality.classify(docs, labels, keep=["doc_id", "source"]).filter("accepted").drop("accepted")


@_query
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    rows = html.main_text(_table(spark, sf_dir, "pages", "page_id", "url", "html"), keep=["page_id", "url"])
    return rows.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


@_query
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of three-word shingles of at least 0.9."""
    return jaccard.link_components(_table(spark, sf_dir, "documents", "doc_id", "text"), k=3, num=90, den=100)


@_query
def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth embedding by inner product."""
    return ann.nearest(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)


@_query
def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 200-byte strings that appear elsewhere."""
    return substrings.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"), 200)


@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding in its whitened first eight components."""
    return whitening.components(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@_query
def op12_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as framed records and read back."""
    import public_tokenizers

    ids = records.token_ids(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    rows = records.read(spark, records.write(ids, new_path(spark, "records")))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the vocabularies of all sources of a language, and each source's telling terms."""
    return divergence.audit(_table(spark, sf_dir, "documents", "lang", "source", "text"))


_SHARE = "1 + (1000000000::HUGEINT * ({c} + 2)) // ({n} + 2 * {v})"
_APART = "(({p} - {q}) * ({p} - {q})) // ({p} + {q})"
ORACLE_SQL["op11_divergence"] = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
full_ AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
n AS (SELECT *, sum(c) OVER (PARTITION BY lang, source) AS n, count(*) OVER (PARTITION BY lang, source) AS v, sum(c) OVER (PARTITION BY lang, term) AS lc, sum(c) OVER (PARTITION BY lang) AS ln FROM full_),
p AS (SELECT lang, source, term, c, {_SHARE.format(c="c", n="n", v="v")} AS p, {_SHARE.format(c="lc", n="ln", v="v")} AS q FROM n),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum({_APART.format(p="a.p", q="b.p")}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ({_APART.format(p="p", q="q")})::BIGINT AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
