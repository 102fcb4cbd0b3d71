"""Exact top-k search by tiled matrix products.

Queries are dealt into blocks and vectors into shards; each tile (block, shard) is one matrix
product of bounded size with a selection of its k best per query. The lists of a query are
merged in a tree: first in groups of shards, then the groups. Every vector meets every query,
which is what an exact search by inner product asks for; a tile holds QUERY_BLOCK queries and
about SHARD_ROWS vectors, so memory does not grow with the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinloom.llm.common import partitions, stored

QUERY_BLOCK = 4096
SHARD_ROWS = 16384
LEAST_SHARD = 512
CANDIDATES_AT_ONCE = 2048  # vectors of a shard that are multiplied at once
LARGEST = (1 << 63) - 1

_TILE = "query_id long, vec_id long, score long"
_TILE_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integer_vectors(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """Rows (vec_id, values): floor(factor * x) of each component as double.

    Vectors that are null, or hold null or non-finite components, are left out, and so are
    rows with a null vec_id.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(v * F.lit(float(factor))).cast("double")).alias("values"),
    )


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products; exact, and saturated at the 64-bit range."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(vectors)), dtype=np.int64)
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if bound < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    exact = np.array([[int(v) for v in q] for q in queries], dtype=object) @ np.array(
        [[int(v) for v in x] for x in vectors], dtype=object
    ).T
    return np.clip(exact, -LARGEST - 1, LARGEST).astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the places of its k best candidates, ties to the smaller id."""
    for q in range(len(own)):
        row = scores[q]
        allowed = np.flatnonzero(ids != own[q])
        if len(allowed) > k:
            values = row[allowed]
            least = np.partition(values, len(values) - k)[len(values) - k]
            allowed = allowed[values >= least]
        order = np.lexsort((ids[allowed], -row[allowed].astype(object) if row.min() == -LARGEST - 1 else -row[allowed]))
        yield q, allowed[order[:k]]


def _tile(k: int):
    def run(left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(batches):
            ids, values = [], []
            for b in batches:
                ids += b.column("vec_id").to_pylist()
                values += b.column("values").to_pylist()
            return np.array(ids, dtype=np.int64), values

        q_ids, q_values = read(left)
        v_ids, v_values = read(right)
        sizes = {len(v) for v in q_values} & {len(v) for v in v_values}
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        for size in sizes:  # vectors of another length do not meet
            mine = [i for i, v in enumerate(q_values) if len(v) == size]
            theirs = [i for i, v in enumerate(v_values) if len(v) == size]
            queries = np.array([q_values[i] for i in mine], dtype=np.float64).reshape(len(mine), size)
            own = q_ids[mine]
            held_s = np.empty((len(mine), 0), dtype=np.int64)
            held_i = np.empty((len(mine), 0), dtype=np.int64)
            for at in range(0, len(theirs), CANDIDATES_AT_ONCE):
                some = theirs[at : at + CANDIDATES_AT_ONCE]
                vectors = np.array([v_values[i] for i in some], dtype=np.float64).reshape(len(some), size)
                scores, ids = _products(queries, vectors), v_ids[some]
                new_s = np.full((len(mine), k), -LARGEST - 1, dtype=np.int64)
                new_i = np.full((len(mine), k), LARGEST, dtype=np.int64)
                for q, best in best_of(scores, ids, own, k):
                    new_s[q, : len(best)], new_i[q, : len(best)] = scores[q, best], ids[best]
                held_s, held_i = np.hstack([held_s, new_s]), np.hstack([held_i, new_i])
                order = np.lexsort((held_i, ~held_s), axis=1)[:, :k]
                held_s, held_i = np.take_along_axis(held_s, order, 1), np.take_along_axis(held_i, order, 1)
            q, c = np.nonzero(held_i != LARGEST)
            out["query_id"].append(own[q])
            out["vec_id"].append(held_i[q, c])
            out["score"].append(held_s[q, c])
        if out["query_id"]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[c])) for c in _TILE_SCHEMA.names], schema=_TILE_SCHEMA)

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """The k vectors of largest inner product for each query, another row's only.

    Both frames have vec_id and values (see ``integer_vectors``). Returns query_id, rank
    (from 1), vec_id, score; ties go to the smaller vec_id. A query with fewer candidates
    gets all of them; vectors of another length are none. Rows that repeat a vec_id count as
    one candidate with their best score, and a repeated query is answered once, with the best
    score of its rows. Scores beyond 64 bits are held at the limit. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    vectors, queries = stored(vectors), stored(queries)
    n_vectors, n_queries = vectors.count(), queries.count()
    shards = max(1, math.ceil(n_vectors / SHARD_ROWS), min(partitions(spark), n_vectors // LEAST_SHARD))
    blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = queries.withColumn("block", spread(blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = vectors.withColumn("shard", spread(shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    lists = (
        left.groupBy("block", "shard")
        .cogroup(right.groupBy("block", "shard"))
        .applyInArrow(_cogrouped(k), _TILE)
    )
    order = [F.desc("score"), F.asc("vec_id")]
    group = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, math.isqrt(shards))))
    for keys in (["query_id", "group"], ["query_id"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        once = lists.withColumn("group", group).groupBy("query_id", "group", "vec_id").agg(F.max("score").alias("score"))
        lists = once.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return lists


def _cogrouped(k: int):
    run = _tile(k)

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = list(run(left.to_batches(), right.to_batches()))
        return pa.Table.from_batches(parts, schema=_TILE_SCHEMA)

    return whole


def op3_topk_tiles(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


OP3_SQL = """
WITH v AS (
  SELECT vec_id::BIGINT AS vec_id,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
