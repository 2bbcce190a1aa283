"""Approximate nearest neighbours: a navigable small-world graph per shard, shard results merged, scores exact.

Equal vectors are indexed once, with the smallest ``k + 1`` of their ids (more can never be among a query's ``k`` nearest), so
a group of copies neither breaks a graph nor fills a task. Vectors are dealt to shards by hash; a shard has at most about
``shard_rows`` vectors and ``shard_bytes`` of them, whatever their length. Its graph is built in one task and written as flat neighbour arrays. Queries are cut into blocks by
hash; each pair of shard and block is searched by a task of its own. Found vectors are scored in double precision on the
original vectors. Rows per query and shard are bounded, and ranks are partial before they are shuffled.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with null
ids; vectors of different lengths are not compared; repeated rows of one id count once; other columns are ignored; a query
with fewer candidates returns them all: a graph has no fewer neighbours than these. Different vectors under one id are asked
and found each, and the id counts with the best of them.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchloom.llm import hnsw
from benchloom.llm.common import materialize

QUERY_BLOCK = 5_000


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _pack(*arrays: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, *arrays)
    return buffer.getvalue()


def _unpack(data: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return [z[f"arr_{i}"] for i in range(len(z.files))]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", ef: int = 200, m: int = 16, shard_rows: int = 50_000, min_shards: int = 6, shard_bytes: int = 64 << 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of every row for which ``is_query``, by inner product."""
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), is_query.alias("asks")).filter(F.col("vec_id").isNotNull()).filter(usable(F.col("v")))
    rows = rows.withColumn("key", F.xxhash64("v")).withColumn("dim", F.size("v"))
    ids = rows.select("key", "vec_id").distinct()
    order = Window.partitionBy("key").orderBy("vec_id")
    ids = materialize(ids.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1).select("key", "vec_id"), "ids")
    asks = materialize(rows.filter("asks").select("key", "vec_id").distinct(), "asks")
    points = materialize(rows.select("key", "dim", "v").dropDuplicates(["key"]), "points")
    size = points.agg(F.count("*").alias("n"), F.sum("dim").alias("cells")).first()
    # A cell takes eight bytes as it is and four in the graph, a node some neighbours.
    shards = max(min_shards, math.ceil(size.n / shard_rows), math.ceil((12 * (size.cells or 0) + 16 * m * size.n) / shard_bytes))
    found = materialize(_search(_index(points, shards, m), points.join(asks.select("key").distinct(), "key", "left_semi"), shards, k + 1, ef), "found")
    # Of each distinct query the k + 1 best ids, its own possibly among them.
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    merged = found.join(ids, "key").select("query", "vec_id", "score").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place")
    answers = asks.select(F.col("key").alias("query"), F.col("vec_id").alias("query_id")).join(merged, "query").filter("query_id != vec_id")
    answers = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _index(points: DataFrame, shards: int, m: int) -> DataFrame:
    """dim, shard, index: keys, vectors, the rows of nodes and the neighbour arrays."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        keys, v = table.column("key").to_numpy(), _matrix(table.column("v"))
        order = np.argsort(keys)  # the same graph whatever order rows arrive in
        keys, v = keys[order], v[order]
        graph, row = hnsw.build(v, m)
        parts = [keys, v, row, graph.vectors, *graph.layers]
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "index": pa.array([_pack(*parts)], pa.large_binary()).cast(pa.binary())})

    dealt = points.withColumn("shard", F.pmod(F.hash("key"), F.lit(shards)).cast("int"))
    return materialize(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, index binary"), "graphs")


def _search(index: DataFrame, queries: DataFrame, shards: int, k: int, ef: int) -> DataFrame:
    """query, key, score: for each query and shard at least the ``k`` best found, with all that tie with the last."""
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.hash("key", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(graphs: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if graphs.num_rows and asked.num_rows:
            keys, v, row, nodes, *layers = _unpack(graphs.column("index")[0].as_py())
            graph = hnsw.Graph(nodes, layers)
            q_keys, q = asked.column("key").to_numpy(), _matrix(asked.column("v"))
            for at in range(0, len(q), hnsw.BATCH):
                part = q[at : at + hnsw.BATCH]
                ids = hnsw.search(graph, part, ef, ef)
                for i in range(len(part)):
                    own = row[ids[i][ids[i] >= 0]]
                    scores = v[own] @ part[i]
                    if len(scores) > k:
                        keep = scores >= np.partition(scores, -k)[-k]
                        own, scores = own[keep], scores[keep]
                    out[0].append(np.full(len(own), q_keys[at + i]))
                    out[1].append(keys[own])
                    out[2].append(scores)
        flat = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query": pa.array(flat[0].astype(np.int64)), "key": pa.array(flat[1].astype(np.int64)), "score": pa.array(flat[2].astype(np.float64))})

    by = ["dim", "shard", "block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "query bigint, key bigint, score double")
