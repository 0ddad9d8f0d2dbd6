"""Hard negatives by distributed radix selection.

A window is a range of scores for one anchor: all of it for the anchor's positives, and a share of a positive's
score for its negatives. To find a window's k best rows without gathering what it holds, tasks count its scores by
their highest digit (from the top of the window); Spark sums the counts and locates the digit in which
the k-th best score lies; the next round counts only that bucket by its next digit. A window
is done once its bucket is one score wide, or holds few more rows than are needed, or the whole window holds too few.
Then only rows at or above that bucket are gathered, from each task at most k a window, and ranked.

Anchors come in bounded blocks that are broadcast, with their windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, new_path
from .vectors import NO_ID, best, dimensions, exact_type, id_column, ids, matrix, query_blocks, tiles, whole_vectors

DIGIT = 8
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Windows:
    """Windows of a block of anchors: rows of the anchor's own label, or of all others, with scores from low to high."""

    same: bool
    k: int
    anchor: np.ndarray  # the place of the anchor in its block
    low: np.ndarray
    high: np.ndarray

    def by_anchor(self, anchors: int) -> np.ndarray:
        """A row for each anchor with the numbers of its windows, filled up with -1."""
        order = np.argsort(self.anchor, kind="stable")
        place = np.arange(len(order)) - np.searchsorted(self.anchor[order], self.anchor[order])
        out = np.full((anchors, int(place.max(initial=-1)) + 1), -1)
        out[self.anchor[order], place] = order
        return out


def _hits(tile: pa.Table, block: tuple, windows: Windows, low: np.ndarray, high: np.ndarray, mine: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, score, id) of the rows of a tile that lie between low and high of a window."""
    a, own, label, dims = block
    x, known, labels = matrix(tile["v"], dims), ids(tile["id"].combine_chunks()), tile["label"].to_numpy()
    used, numbers = mine >= 0, np.iinfo(np.int64)
    least = np.where(used, low[mine], numbers.max).min(axis=1, initial=numbers.max)
    most = np.where(used, high[mine], numbers.min).max(axis=1, initial=numbers.min)
    for one in np.unique(labels):
        rows = np.flatnonzero(labels == one)
        fitting = np.flatnonzero(((label == one) == windows.same) & (least <= most))
        for p in range(0, len(fitting), 512):
            part = fitting[p : p + 512]
            kind = exact_type(a[part], x[rows])
            s = a[part].astype(kind) @ x[rows].T.astype(kind)
            i, j = np.nonzero((s >= least[part, None]) & (s <= most[part, None]))
            score, i, j = s[i, j].astype(np.int64), part[i], rows[j]
            other = (own[i] != known[j]) | (known[j] == NO_ID)
            score, i, j = score[other], i[other], j[other]
            for c in range(mine.shape[1]):
                w = mine[i, c]
                inside = (w >= 0) & (score >= low[w]) & (score <= high[w])
                yield w[inside], score[inside], known[j[inside]]


def _in_lots(hits: Iterator[tuple[np.ndarray, ...]], rows: int = 1 << 20) -> Iterator[list[np.ndarray]]:
    """Hits joined to lots of about ``rows``."""
    held, n = [], 0
    for hit in hits:
        held.append(hit)
        n += len(hit[0])
        if n >= rows:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def _located(rows: DataFrame, shared, windows: Windows, low: np.ndarray, high: np.ndarray, shift: np.ndarray, need: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """For each window with at least ``need`` rows between low and high: the bucket of the need-th best score, the rows in better buckets, its own rows."""
    mine = Windows(windows.same, windows.k, windows.anchor, low, high).by_anchor(len(shared.value[1]))
    mine = np.where((mine >= 0) & (need[mine] > 0), mine, -1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for w, score, _ in _in_lots(hit for tile in tiles(batches) for hit in _hits(tile, shared.value, windows, low, high, mine)):
            new, times = np.unique((w << DIGIT) + ((high[w] - score) >> shift[w]), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, times]), len(keys)).astype(np.int64)
        # Buckets behind the one that holds the need-th row of this task alone can't hold that of all tasks.
        w, before = keys >> DIGIT, np.cumsum(counts) - counts
        before = before - before[np.searchsorted(w, w)] if len(w) else before
        kept = before < need[w]
        yield pa.RecordBatch.from_arrays([pa.array(w[kept]), pa.array(need[w[kept]]), pa.array(keys[kept] & ((1 << DIGIT) - 1)), pa.array(counts[kept])], ["w", "need", "bucket", "n"])

    summed = rows.mapInArrow(count, "w long, need long, bucket long, n long").groupBy("w", "need", "bucket").agg(F.sum("n").alias("n"))
    to_here = summed.withColumn("sum", F.sum("n").over(Window.partitionBy("w").orderBy("bucket")))
    found = to_here.where("sum >= need and sum - n < need").select("w", "bucket", (F.col("sum") - F.col("n")).alias("before"), "n")
    return {r.w: (r.bucket, r.before, r.n) for r in found.collect()}


def select_best(rows: DataFrame, shared, windows: Windows, *, few: int = 4) -> DataFrame:
    """w, rank, id, score: the k best rows of each window, ties to the smaller id (null last); all of them, if fewer.

    ``shared`` is the broadcast block of anchors. What goes through the driver is one located bucket a window.
    """
    low, high, k = windows.low.copy(), windows.high.copy(), windows.k
    need = np.where(low <= high, k, 0)
    floor = windows.low.copy()
    while (need > 0).any():
        wide = np.array([max(0, int(h - s).bit_length() - DIGIT) for s, h in zip(low, high)])
        found = _located(rows, shared, windows, low, high, wide, need)
        for w in np.flatnonzero(need > 0):
            if w not in found:  # fewer rows than needed: all of what this bucket holds
                floor[w], need[w] = low[w], 0
                continue
            bucket, before, n = found[w]
            top = int(high[w]) - (bucket << int(wide[w]))
            low[w], high[w] = max(int(low[w]), top - (1 << int(wide[w])) + 1), top
            need[w] -= before
            if wide[w] == 0 or n <= few * k:
                floor[w], need[w] = low[w], 0
    mine = windows.by_anchor(len(shared.value[1]))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [np.empty(0, np.int64)] * 3
        for lot in _in_lots(hit for tile in tiles(batches) for hit in _hits(tile, shared.value, windows, floor, windows.high, mine)):
            top = best(*(np.concatenate(c) for c in zip(top, lot)), k)
        yield pa.RecordBatch.from_arrays([pa.array(top[0]), id_column(top[2]), pa.array(top[1])], ["w", "id", "score"])

    ranked = Window.partitionBy("w").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.mapInArrow(gather, "w long, id long, score long").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame, anchors: Column, label: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = 2048,
) -> DataFrame:
    """For each row that ``anchors`` marks, its first ``positives`` other rows of the same label; for each of these the first ``negatives``
    rows of another label whose score is low to high percent of the positive's.

    Scores are integer inner products of floor(scale * x); higher scores come first, ties by smaller id, null ids last. Rows with a null label or
    vector, or a null or non-finite component, take no part; an empty vector does and scores 0, as shorter vectors count as
    filled with zeros. "Other" rows are those with another id, so rows that share an id are no positives of each other; they count each for itself
    otherwise, and a pair of ids then comes once for each pair of rows. A positive of negative score has no negatives (the range is empty), one
    of score 0 those of score 0. A null in ``anchors`` marks nothing. Columns of vectors but id, vector and those of the
    expressions are left behind, whatever their names. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = materialise(whole_vectors(vectors, id_col, vec_col, scale, label=label.cast("long"), anchor=F.coalesce(anchors, F.lit(False))).where("label is not null"), "vectors")
    dims, chosen = dimensions(rows), rows.where("anchor").select("id", "label", "v")
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0] or 0.0
    rows = rows.select("id", "label", "v")
    path = new_path(spark, "negatives")
    spark.createDataFrame([], RESULT).write.parquet(path)
    for found in query_blocks(chosen, block):
        a, own = matrix(found["v"], dims), ids(found["id"])
        shared = spark.sparkContext.broadcast((a, own, found["label"].to_numpy(), dims))
        reach = np.ceil(np.sqrt((a.astype(np.float64) ** 2).sum(axis=1) * longest) * (1 + 1e-12)).astype(np.int64) + 1
        found_positives = select_best(rows, shared, Windows(True, positives, np.arange(len(own)), -reach, reach)).orderBy("w", "rank").toArrow()
        anchor, score, positive = found_positives["w"].to_numpy(), found_positives["score"].to_numpy(), ids(found_positives["id"])
        windows = Windows(False, negatives, anchor, -(-low * score // 100), high * score // 100)
        named = pa.table({"w": pa.array(np.arange(len(anchor))), "anchor_id": id_column(own[anchor]), "positive_id": id_column(positive), "positive_score": pa.array(score)})
        if len(anchor):
            # One row a window of this block, of which there are at most block * positives.
            names = F.broadcast(spark.createDataFrame(named))
            picked = select_best(rows, shared, windows).join(names, "w")
            picked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema(RESULT).parquet(path)
