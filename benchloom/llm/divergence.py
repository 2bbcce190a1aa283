"""How the vocabularies of sources differ: triangular discrimination between all sources of a language, and telling terms.

Terms are counted where they are read: DuckDB cuts texts and counts terms by language and source, batch by batch, and a task
sends one row per language and term with the counts of its sources. These rows are hashed by language and term to shards, in
which DuckDB sums counts and drops rare terms. Spark sums the totals of each source and hands every term, with the counts of
its sources, to a second DuckDB step; it adds up, over the terms of a shard, for each pair of sources that share terms what
these add to the pair, how many terms a source has at each count, and its best terms. Spark merges these sums and ranks.

A term that a source lacks has one share there, whatever the term. So only sources that share a term meet (within the term's
own row), and the rest of a pair's sum follows from the numbers of terms at each count: V·f(0,0), the terms of either source
against the other's share of absent terms, and a correction for shared ones. Nothing is spread over absent terms, and all
arithmetic is on whole numbers.

Defined results: null text, language and source are ''. Every row of documents counts, repeated ones too; other columns are
ignored. A source without kept terms is compared by its shares of absent terms; a language without kept terms has pairs of
value 0 and no terms. A language with one source has no pairs. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benchloom.llm.common import bound_batches, materialize

#: Documents of its language that must hold a term, ranks of terms, and what a share of 1 counts.
MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Rows that a task gathers in DuckDB before it sums them.
ROWS = 1_500_000
#: Terms: ASCII letters and all characters beyond ASCII.
TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _database():
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    _done(con, "SET preserve_insertion_order = false")
    return con


def _done(con, sql: str) -> list[tuple]:
    return con.execute(sql).fetchall()


def _take(con, sql: str, **tables: pa.Table) -> pa.Table:
    for name, t in tables.items():
        con.register(name, t)
    out = con.execute(sql).to_arrow_table()
    for name in tables:
        con.unregister(name)
    return out


def _batches(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from table.cast(schema).to_batches(max_chunksize=50_000)


_PARTIAL = pa.schema([("lang", pa.string()), ("term", pa.string()), ("items", pa.list_(pa.struct([("source", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])))])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to counts by language and term, with the sources of each."""
    con, rows = _database(), 0
    _done(con, "CREATE TABLE seen (lang VARCHAR, term VARCHAR, source VARCHAR, c BIGINT, d BIGINT)")
    sent = "SELECT lang, term, list(struct_pack(source := source, \"count\" := c, docs := d)) AS items FROM (SELECT lang, term, source, sum(c)::BIGINT AS c, sum(d)::BIGINT AS d FROM seen GROUP BY ALL) GROUP BY ALL"
    words = f"SELECT n, lang, source, unnest(regexp_extract_all({_LOWER.format('text')}, '{TERM}')) AS term FROM (SELECT row_number() OVER () AS n, * FROM part)"
    for batch in batches:
        _take(con, f"INSERT INTO seen SELECT lang, term, source, sum(c)::BIGINT, count(*) FROM (SELECT n, lang, source, term, count(*) AS c FROM ({words}) GROUP BY ALL) GROUP BY ALL", part=pa.Table.from_batches([batch]))
        rows = _done(con, "SELECT count(*) FROM seen")[0][0]
        if rows > ROWS:
            yield from _batches(_take(con, sent), _PARTIAL)
            _done(con, "DELETE FROM seen")
    if rows:
        yield from _batches(_take(con, sent), _PARTIAL)


_KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("count", pa.int64()), ("first", pa.int64())])


def _merge(min_docs: int):
    """A shard's sums by language, term and source; terms of fewer than ``min_docs`` documents go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, since = _database(), 0
        _done(con, "CREATE TABLE seen (lang VARCHAR, term VARCHAR, source VARCHAR, c BIGINT, d BIGINT)")
        for batch in batches:
            _take(con, 'INSERT INTO seen SELECT lang, term, i.source, i."count", i.docs FROM (SELECT lang, term, unnest(items) AS i FROM part)', part=pa.Table.from_batches([batch]))
            since += batch.num_rows
            if since > ROWS:  # what repeats is summed before more comes
                _done(con, "CREATE OR REPLACE TABLE seen AS SELECT lang, term, source, sum(c)::BIGINT AS c, sum(d)::BIGINT AS d FROM seen GROUP BY ALL")
                since = 0
        sums = f"""
        WITH s AS (SELECT lang, term, source, sum(c)::BIGINT AS c, sum(d)::BIGINT AS d FROM seen GROUP BY ALL),
        k AS (SELECT lang, term, min(source) AS least FROM s GROUP BY ALL HAVING sum(d) >= {min_docs})
        SELECT lang, term, source, c AS "count", (source = least)::BIGINT AS "first" FROM s JOIN k USING (lang, term)"""
        yield from _batches(_take(con, sums), _KEPT)

    return run


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, source, count of all kept terms, and ``first``: 1 in one row of each term, else 0."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    # As many shards as the input has splits, so that a shard does not grow with it.
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    parts = rows.mapInArrow(_count, "lang string, term string, items array<struct<source: string, count: long, docs: long>>")
    return parts.repartition(shards, "lang", "term").mapInArrow(_merge(min_docs), "lang string, term string, source string, count long, first long")


def _share(count: str, n: str, v: str) -> str:
    return f"(1 + ({UNIT}::HUGEINT * ({count} + 2)) // ({n} + 2 * {v}))::BIGINT"


def _apart(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) // (({p}) + ({q})))"


_PARTS = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("count", pa.int64()), ("value", pa.int64())])


def _compare(top: int):
    """Terms with the counts of their sources to partial sums: pairs' corrections, numbers of terms by count, best terms."""
    both = f"{_apart('a.p', 'b.p')} - {_apart('a.p', 'b.p0')} - {_apart('a.p0', 'b.p')} + {_apart('a.p0', 'b.p0')}"
    shares = f"""CREATE OR REPLACE TABLE shares AS SELECT t, lang, term, i.source AS source, i."count" AS c, {_share('i."count"', "i.n", "v")} AS p, {_share("0", "i.n", "v")} AS p0, {_share("all_count", "all_n", "v")} AS q
    FROM (SELECT row_number() OVER () AS t, lang, term, v, all_n, list_sum(list_transform(items, lambda x: x."count"))::BIGINT AS all_count, unnest(items) AS i FROM part)"""
    sums = f"""
    SELECT 'pair' AS part, a.lang, a.source, b.source AS item, NULL::BIGINT AS "count", sum({both})::BIGINT AS value FROM shares a JOIN shares b ON a.t = b.t AND a.source < b.source GROUP BY ALL
    UNION ALL SELECT 'count', lang, source, NULL, c, count(*) FROM shares GROUP BY ALL
    UNION ALL SELECT 'term', lang, source, term, NULL, {_apart("p", "q")} FROM shares WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {_apart("p", "q")} DESC, term) <= {top}"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _database()
        for batch in batches:
            if batch.num_rows:
                _take(con, shares, part=pa.Table.from_batches([batch]))
                yield from _batches(_take(con, sums), _PARTS)

    return run


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: the distance to every other source of the language, and the source's telling terms."""
    counts = materialize(term_counts(docs, lang, source, text, min_docs), "terms")
    group = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]
    by_source = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    by_lang = counts.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("count").alias("all_n"))
    totals = docs.select(*group).distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["n", "v", "all_n"])
    totals = materialize(totals, "totals")
    met = counts.join(totals, ["lang", "source"]).groupBy("lang", "term").agg(F.first("v").alias("v"), F.first("all_n").alias("all_n"), F.collect_list(F.struct("source", "count", "n")).alias("items"))
    parts = materialize(met.mapInArrow(_compare(top), "part string, lang string, source string, item string, count long, value long"), "parts")

    def apart(p: str, q: str):
        return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")

    shares = totals.withColumn("p0", F.when(F.col("v") > 0, F.expr(f"CAST(1 + CAST({UNIT}L * 2 AS BIGINT) DIV (n + 2 * v) AS BIGINT)")))
    other = shares.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    # Terms of a source against the other's share of absent terms, less what absent terms of both would give.
    number = parts.filter("part = 'count'").groupBy("lang", "source", "count").agg(F.sum("value").alias("terms"))
    number = number.join(shares, ["lang", "source"]).withColumn("p", F.expr(f"CAST(1 + (CAST({UNIT} AS DECIMAL(38,0)) * (count + 2)) DIV (n + 2 * v) AS BIGINT)"))
    one_sided = number.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (apart("p", "q0") - apart("p0", "q0"))).alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    shared = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    absent = shares.join(other, "lang").filter("source <> item").select("lang", "source", "item", F.coalesce(F.col("v") * apart("p0", "q0"), F.lit(0)).alias("value"))
    pairs = absent.unionByName(one_sided).unionByName(turned(one_sided)).unionByName(shared).unionByName(turned(shared)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = ranked(parts.filter("part = 'term'").select("lang", "source", "item", "value"), "term").filter(F.col("rank") <= top)
    return ranked(pairs, "pair").unionByName(terms)
