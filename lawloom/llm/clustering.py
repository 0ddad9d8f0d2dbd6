"""Centroid clustering with annulus search, in whole numbers.

By the triangle inequality a vector's nearest centroid differs from it in norm by no more than the vector's distance to any
centroid. So centroids are sorted by norm, each vector gets an upper bound from the centroid it belonged to first, the
centroids in the annulus (norm of the vector minus and plus the bound) are found by binary search, and only these
are compared exactly, those on its edge included. Centroids are broadcast (k times the dimensions); a round reads the vectors,
and returns from each task one sum per cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .vectors import exact_type, matrix, tiles, whole_vectors


def annulus_nearest(x: np.ndarray, centroids: np.ndarray, guess: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row of x (ties to the smaller number) and the squared distance, both exact.

    ``guess`` is a centroid whose distance bounds that of the nearest; without it, it is the one nearest in norm.
    """
    kind = exact_type(np.concatenate([x, centroids]), 4 * np.concatenate([x, centroids]))
    x, c = x.astype(kind), centroids.astype(kind)
    xx, cc = (x * x).sum(axis=1), (c * c).sum(axis=1)
    norms, order = np.sqrt(cc.astype(np.float64)), np.argsort(cc, kind="stable")
    norms, nx = norms[order], np.sqrt(xx.astype(np.float64))
    if guess is None:
        after = np.clip(np.searchsorted(norms, nx), 1, max(1, len(c) - 1))
        before_is_nearer = np.abs(nx - norms[after - 1]) <= np.abs(norms[np.minimum(after, len(c) - 1)] - nx)
        guess = order[np.where(before_is_nearer, after - 1, np.minimum(after, len(c) - 1))]
    nearest, least = guess.astype(np.int64), xx - 2 * (x * c[guess]).sum(axis=1) + cc[guess]
    # A little is added, as roots are rounded: no centroid on the edge is lost.
    bound = np.sqrt(least.astype(np.float64)) * (1 + 1e-9) + 1e-6 * (1 + nx)
    begin, end = np.searchsorted(norms, nx - bound, "left"), np.searchsorted(norms, nx + bound, "right")
    for place, number in enumerate(order):
        rows = np.flatnonzero((begin <= place) & (place < end) & (guess != number))
        distance = xx[rows] - 2 * (x[rows] @ c[number]) + cc[number]
        better = (distance < least[rows]) | ((distance == least[rows]) & (number < nearest[rows]))
        nearest[rows[better]], least[rows[better]] = number, distance[better]
    return nearest, least.astype(np.int64)


def _assigner(shared, dims: int, guessed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles(batches):
            cluster, distance = annulus_nearest(matrix(tile["v"], dims), shared.value, tile["cluster"].to_numpy() if guessed else None)
            kept = [tile["id"], tile["v"]] if not guessed else [tile["id"]]
            yield from pa.table([*kept, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", *(["v"] if not guessed else []), "cluster", "distance"]).to_batches()

    return assign


def _summer(shared, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(shared.value), dims), np.int64), np.zeros(len(shared.value), np.int64)
        for tile in tiles(batches):
            x = matrix(tile["v"], dims)
            cluster, _ = annulus_nearest(x, shared.value, tile["cluster"].to_numpy())
            for number in np.unique(cluster):
                sums[number] += x[cluster == number].sum(axis=0)
            counts += np.bincount(cluster, minlength=len(counts))
        used = np.flatnonzero(counts)
        if len(used):
            c = np.repeat(used, dims)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.tile(np.arange(dims), len(used))), pa.array(sums[used].ravel()), pa.array(counts[c])], ["cluster", "dim", "sum", "n"])

    return add_up


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, *, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 1024, seed: str = "3:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector with ``dims`` components, none null or non-finite.

    Components become floor(scale * x). Centroids start as the k vectors with the smallest sha256 of seed and id, so a tie is one between rows that
    share an id: the vector smaller in its components goes first, and a null id (hashed as "null") is like any other. Each round assigns every vector to its nearest centroid
    (squared distance, ties to the smaller number) and moves each centroid to the floor of the mean of its vectors; one without vectors stays. Equal
    centroids are possible: the smaller number takes all. Fewer than k vectors: as many centroids as vectors. Rows that share an id are assigned each for
    itself. All other columns are left behind, whatever their names. Tables without such a vector give no rows.
    """
    spark = vectors.sparkSession
    marked = vectors.select(F.col(id_col).alias("vec"), F.col(vec_col).alias("embedding")).where(F.size("embedding") == dims)
    kept = materialise(whole_vectors(marked, "vec", "embedding", scale), "vectors")
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    first = kept.orderBy(digest, "v").limit(k).select("v").toArrow()
    centroids = matrix(first["v"], dims)
    none = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], none)
    share = spark.sparkContext.broadcast
    rows = materialise(kept.mapInArrow(_assigner(share(centroids), dims, False), "id long, v array<int>, cluster int, distance long"), "guessed").select("id", "v", "cluster")
    for _ in range(rounds):
        sums = rows.mapInArrow(_summer(share(centroids), dims), "cluster long, dim long, sum long, n long").groupBy("cluster", "dim").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).toArrow()
        centroids = centroids.copy()
        centroids[sums["cluster"].to_numpy(), sums["dim"].to_numpy()] = sums["sum"].to_numpy() // sums["n"].to_numpy()
    last = materialise(rows.mapInArrow(_assigner(share(centroids), dims, True), "id long, cluster int, distance long"), "assigned")
    inertia = last.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).toArrow().to_pydict()
    total = sum(inertia["cluster_inertia"])
    text = [",".join(map(str, centroids[c].tolist())) for c in inertia["cluster"]]
    named = list(zip(inertia["cluster"], inertia["cluster_inertia"], [total] * len(text), text))
    of_cluster = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, components string").withColumn("centroid_sha256", F.sha2("components", 256)).drop("components")
    return last.withColumnRenamed("id", "vec_id").join(F.broadcast(of_cluster), "cluster").select(*[c.split()[0] for c in none.split(", ")])
