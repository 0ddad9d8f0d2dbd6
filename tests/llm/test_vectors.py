"""Search, hard negatives and clusters of vectors against plain Python, on rows with every awkward case."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawloom.llm import hard_negatives
from lawloom.llm.clustering import annulus_nearest, cluster_vectors
from lawloom.llm.hard_negatives import mine_hard_negatives
from lawloom.llm.topk import reaching_pairs, top_k
from lawloom.llm.vectors import whole_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, number long, w long, id long, v string, cluster string, score double, rank string, bucket int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, 9, "x", "y", 0.5, "z", 1) for r in rows], SCHEMA)


def rows_of(dims=12, n=400, ragged=True):
    """Clusters of vectors, one of them very common; nulls, empty and short vectors, repeated rows and ids."""
    r = random.Random(3)
    middles = [[r.gauss(0, 0.2) for _ in range(dims)] for _ in range(5)]
    out = [(i, [m + r.gauss(0, 0.1) for m in middles[i % 5]], r.choice([i % 5, i % 5, 7])) for i in range(n)]
    out += [(1000 + i, middles[0], i % 3) for i in range(n // 2)]
    out += [(2000, None, 1), (2001, [None] * dims, 1), (2002, [math.nan] * dims, 1), (2003, [math.inf] + [0.0] * (dims - 1), 2), (2050, [-0.0] * dims, None)]
    out += [(50, middles[1], 1), (50, middles[1], 1), (None, middles[2], 2), (None, middles[2], 0), (-50, middles[3], 3), (2100, [0.0] * dims, 4)]
    out += [(2150, middles[0][:5], 0), (2200, [], 0)] if ragged else [(2150, middles[0][:5], 0), (2200, [], 0), (2201, middles[0] + [0.1], 0)]
    return out


def whole(v, scale):
    if v is None or not all(x is not None and math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * float(np.float32(x))) for x in v]


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def ordered(hits):
    """Hits (score, id) best first, a null id last among ties."""
    return sorted(hits, key=lambda h: (-h[0], h[1] is None, h[1] or 0))


def plain_top(rows, k):
    kept = [(i, w) for i, v, _ in rows if (w := whole(v, 256)) is not None]
    out = []
    for q, a in kept:
        if q is not None and q % 50 == 0:
            hits = ordered((product(a, b), i) for i, b in kept if i != q)[:k]
            out += [(q, n, i, s) for n, (s, i) in enumerate(hits, 1)]
    return out


def plain_negatives(rows):
    kept = [(i, w, label) for i, v, label in rows if label is not None and (w := whole(v, 256)) is not None]
    out = []
    for q, a, mine in kept:
        if q is None or q % 50:
            continue
        scored = [(product(a, b), i, label == mine) for i, b, label in kept if i != q]
        for ps, p in ordered((s, i) for s, i, same in scored if same)[:5]:
            hits = ordered((s, i) for s, i, same in scored if not same and 50 * ps <= 100 * s <= 95 * ps)[:3]
            out += [(q, p, n, i, ps, s) for n, (s, i) in enumerate(hits, 1)]
    return out


def plain_clusters(rows, dims, k=8, rounds=10):
    kept = [(i, w) for i, v, _ in rows if v is not None and len(v) == dims and (w := whole(v, 1024)) is not None]
    digest = lambda i: hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest()
    centroids = [w for _, w in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for left in range(rounds, -1, -1):
        at = [min((distance(w, c), n) for n, c in enumerate(centroids)) for _, w in kept]
        if left:
            for n in range(len(centroids)):
                own = [w for (_, w), (_, m) in zip(kept, at) if m == n]
                centroids[n] = [sum(x) // len(own) for x in zip(*own)] if own else centroids[n]
    inertia = {n: sum(d for d, m in at if m == n) for n in range(len(centroids))}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, inertia[n], sum(inertia.values()), name[n]) for (i, _), (d, n) in zip(kept, at)]


def found(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("block,k", [(8192, 5), (4, 3), (8192, 1000)])
def test_top_k(spark, block, k):
    rows = rows_of(n=60 if k > 100 else 400)
    vectors = whole_vectors(table(spark, rows).repartition(5), "vec_id", "embedding", 256)
    hits = top_k(vectors.where("id % 50 = 0"), vectors, k, block=block, step=4)
    assert found(hits, "query_id", "rank", "vec_id", "score") == sorted(plain_top(rows, k), key=str)


def test_top_k_without_rows(spark):
    vectors = whole_vectors(table(spark, rows_of()), "vec_id", "embedding", 256)
    assert top_k(vectors.where("id < -90"), vectors).count() == top_k(vectors.where("false"), vectors.where("false")).count() == 0
    assert top_k(vectors.where("id = 0"), vectors.where("id = 0")).count() == 0


@pytest.mark.parametrize("largest", [300, 2**25])
def test_reaching_pairs_lose_nothing(largest):
    """Bounds by the masses left never drop a pair that reaches the threshold, in doubles and in 64-bit integers."""
    r = np.random.default_rng(1)
    q, x = r.integers(-largest, largest, (20, 40)), r.integers(-largest, largest, (300, 40))
    q[:, 30:] //= 50
    scores = q @ x.T
    for share in (0, 0.5, 0.99):
        least = np.sort(scores, axis=1)[:, int(share * 299)].astype(float)
        i, j, s = reaching_pairs(q, x, least, [5, 10, 20, 30, 35, 40])
        got = {(a, b): c for a, b, c in zip(i, j, s)}
        assert all(got[a, b] == scores[a, b] for a, b in zip(*np.nonzero(scores >= least[:, None])))


def mined(df):
    return found(df, "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("block", [2048, 3])
def test_hard_negatives(spark, block):
    rows = rows_of()
    got = mine_hard_negatives(table(spark, rows).repartition(5), F.col("vec_id") % 50 == 0, F.col("label"), block=block)
    want = plain_negatives(rows)
    assert len(want) > 50 and mined(got) == sorted(want, key=str)


def test_hard_negatives_with_small_digits(spark, monkeypatch):
    """With digits of two bits and no row to spare, windows are refined over many rounds; the result is the same."""
    monkeypatch.setattr(hard_negatives, "DIGIT", 2)
    spare = hard_negatives.select_best
    monkeypatch.setattr(hard_negatives, "select_best", lambda *a: spare(*a, few=0))
    rows = rows_of(n=150)
    assert mined(mine_hard_negatives(table(spark, rows), F.col("vec_id") % 50 == 0, F.col("label"))) == sorted(plain_negatives(rows), key=str)


def test_hard_negatives_without_rows(spark):
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, None, 1), (1, [1.0], None)]):
        assert mine_hard_negatives(table(spark, rows), F.col("vec_id") % 50 == 0, F.col("label")).count() == 0


@pytest.mark.parametrize("k,rounds", [(8, 10), (3, 2), (1, 3), (40, 4)])
def test_clusters(spark, k, rounds):
    rows = rows_of(ragged=False)
    got = cluster_vectors(table(spark, rows).repartition(5), k, rounds, dims=12)
    assert found(got, "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256") == sorted(plain_clusters(rows, 12, k, rounds), key=str)


def test_clusters_of_few_or_no_rows(spark):
    few = [(4, [0.5, 0.25], 0), (9, [0.5, 0.25], 0), (2, [-0.5, 0.25], 0)]
    got = cluster_vectors(table(spark, few), dims=2)
    assert found(got, "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256") == sorted(plain_clusters(few, 2), key=str)
    assert cluster_vectors(table(spark, []), dims=2).count() == cluster_vectors(table(spark, [(1, None, 1)]), dims=2).count() == 0


@pytest.mark.parametrize("largest", [40, 2**24])
def test_annulus_finds_the_nearest(largest):
    """Ties on the edge of the annulus, equal norms and equal centroids, with any first guess."""
    r = np.random.default_rng(2)
    x = np.concatenate([r.integers(-largest, largest, (200, 3)), np.zeros((1, 3), int)])
    c = np.concatenate([r.integers(-largest, largest, (30, 3)), -x[:5], x[:5], x[:5], np.zeros((1, 3), int)])
    distance = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    for guess in (None, np.zeros(len(x), int), r.integers(0, len(c), len(x))):
        nearest, least = annulus_nearest(x, c, guess)
        assert (nearest == distance.argmin(axis=1)).all() and (least == distance.min(axis=1)).all()
