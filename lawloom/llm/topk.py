"""Exact top-k search by columnar branch and bound.

Queries come in bounded blocks that are broadcast; each task walks its rows in tiles. A tile is laid out by
dimension (vertically), and inner products grow block of dimensions by block. What a pair can still gain is
bounded by the masses that query and row have left (Cauchy-Schwarz); pairs that can't reach their query's k-th best
score so far go, and once few are left the rest is compacted to a list of pairs. The first bound of a block comes from
its queries, which are scored against one another. Each task returns at most k rows a query, and a
window ranks them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path
from .vectors import NO_ID, TILE, best, dimensions, exact_type, id_column, ids, matrix, query_blocks, tiles

FOUND = "number long, query_id long, vec_id long, score long"


def rest_masses(x: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """For each cut of the dimensions, the norm of what each row has behind it."""
    return [np.sqrt((x[:, c:].astype(np.float64) ** 2).sum(axis=1)) for c in cuts]


def reaching_pairs(q: np.ndarray, x: np.ndarray, least: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, inner product) of all pairs whose product is at least ``least`` of the query."""
    kind = exact_type(q, x)
    columns = np.ascontiguousarray(x.T.astype(kind))
    q, rest_q, rest_x = q.astype(kind), rest_masses(q, cuts), rest_masses(x, cuts)
    sums, pairs, begin = np.zeros((len(q), x.shape[0]), kind), None, 0
    for end, left_q, left_x in zip(cuts, rest_q, rest_x):
        if pairs is None:
            sums += q[:, begin:end] @ columns[begin:end]
            # A look at all pairs costs as much as some dimensions: worth it once the masses left are under the bounds.
            if end == cuts[-1] or np.median(left_q) * np.median(left_x) <= np.median(least):
                alive = sums + np.outer(left_q, left_x) * (1 + 1e-12) + 0.5 >= least[:, None]
                if end == cuts[-1] or alive.mean() <= 0.125:
                    pairs = np.nonzero(alive)
                    sums = sums[pairs]
        else:
            i, j = pairs
            sums = sums + (q[i, begin:end] * columns[begin:end, j].T).sum(axis=1)
            alive = sums + left_q[i] * left_x[j] * (1 + 1e-12) + 0.5 >= least[i]
            pairs, sums = (i[alive], j[alive]), sums[alive]
        begin = end
    return *pairs, sums.astype(np.int64)


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, *, block: int = 8192, step: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the k rows of highest integer inner product, ties to the smaller id.

    Both tables come from ``whole_vectors``. A row is no candidate of a query with its id, so of rows that share an
    id none finds another; beyond that, repeated ids are queries and candidates each for itself, and the lists of such queries
    carry the same query_id. A null id is no query's own and comes last among ties. Vectors shorter than the longest
    count as filled with zeros, an empty one scores 0 with all. Fewer than k candidates: all. No rows or queries: no result.
    """
    spark, dims = rows.sparkSession, dimensions(rows.select("v").unionAll(queries.select("v")))
    cuts = sorted({*range(step, dims, step), dims})
    path, ranked = new_path(spark, "found"), Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    spark.createDataFrame([], "query_id long, rank int, vec_id long, score long").write.parquet(path)
    for found in query_blocks(queries, block):
        q, own, number = matrix(found["v"], dims), ids(found["id"]), found["number"].to_numpy()
        # Dimensions with much mass come first, so that little is left early.
        order = np.argsort(-(q.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        shared = spark.sparkContext.broadcast((q[:, order].astype(np.int32), own, number, order))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, own, number, order = shared.value
            q = q.astype(np.int64)
            least = np.full(len(q), -np.inf)
            seeds = slice(0, min(len(q), 1024))
            top = [np.empty(0, np.int64)] * 3
            parts = range(0, len(q), 512)
            for p in parts:
                s = (q[p : p + 512].astype(exact_type(q, q)) @ q[seeds].T.astype(exact_type(q, q))).astype(np.float64)
                s[own[p : p + 512, None] == own[None, seeds]] = -np.inf
                if s.shape[1] >= k:
                    least[p : p + 512] = np.partition(s, -k, axis=1)[:, -k]
            for tile in tiles(batches, TILE):
                x, known = matrix(tile["v"], dims)[:, order], ids(tile["id"].combine_chunks())
                for p in parts:
                    i, j, score = reaching_pairs(q[p : p + 512], x, least[p : p + 512], cuts)
                    i = i + p
                    other = (own[i] != known[j]) | (known[j] == NO_ID)
                    top = [np.concatenate(c) for c in zip(top, (i[other], score[other], known[j][other]))]
                top = best(*top, k)
                full = np.flatnonzero(np.bincount(top[0], minlength=len(q)) >= k)
                ends = np.searchsorted(top[0], full, "right") - 1
                least[full] = np.maximum(least[full], top[1][ends])
            yield pa.RecordBatch.from_arrays([pa.array(number[top[0]]), id_column(own[top[0]]), id_column(top[2]), pa.array(top[1])], ["number", "query_id", "vec_id", "score"])

        hits = rows.select("id", "v").mapInArrow(search, FOUND).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        hits.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)
