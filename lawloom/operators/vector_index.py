"""A stored vector index: inverted lists over trained centroids, with product-quantised residuals.

    path/lists/list=<n>/   pieces: about 1,024 vectors of a list, as ids, codes, code errors and vectors
    path/model             centroids with their radius, code books, and how many lists to probe; written last

Training sees a bounded sample; every vector is indexed. A search comes in bounded blocks of queries that are
broadcast: lists that no query of a block probes are pruned as partitions, the codes of the others give
candidates, and only these are compared by their vectors. ``search_exact`` goes on from there: a list is passed over only if its radius, and a
vector only if its code's error, proves that it can't be among the best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.operators.retrieve import CANDIDATES, top
from lawloom.session import bounded_batches, shared_path

# Bounds: numbers in the training sample, rows of it, lists, codes of a part (one byte), vectors of a piece, pieces of a file, queries of a block.
TRAIN_NUMBERS, TRAIN_ROWS, LISTS, CODES, PIECE, FILE, BLOCK = 8_000_000, 50_000, 4096, 256, 1024, 16, 2048
HELD = 1 << 19  # hits that a task holds before it keeps the best
SAMPLE = 4096  # vectors kept with the model
# Cosines are rounded to this many decimals before they are compared, as in ``retrieve.vector_top``.
DECIMALS = 12
MODEL = "kind string, a int, b int, v array<double>"
PIECE_NUMBERS = 1 << 32  # more than the places of a piece: query and place in one number
PIECES = "list int, piece int, ids array<ID>, codes binary, errors binary, vectors binary"


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def padded(column: pd.Series, dims: int) -> np.ndarray:
    """Rows of a column of arrays as unit vectors, filled with zeros to dims."""
    out = np.zeros((len(column), dims))
    for n, v in enumerate(column):
        out[n, : len(v)] = v
    return units(out)


def lloyd(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """k centroids of the rows of x by Lloyd's rounds, from rows spread over x; an empty one moves to the row worst served."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        counts = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, d], len(c)) for d in range(x.shape[1])], axis=1)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
        empty = np.flatnonzero(counts == 0)
        c[empty] = x[np.argsort(-((x - c[near]) ** 2).sum(axis=1), kind="stable")[: len(empty)]]
    return c


def best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, *rest: np.ndarray) -> list[np.ndarray]:
    """Of each query the k (the last of ``rest``) highest scores, ties to the smaller id, sorted by query and rank; the rest goes along."""
    *rest, k = rest
    order = np.lexsort((ids.astype(str) if ids.dtype == object else ids, -score, q))
    kept = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < k]
    return [c[kept] for c in (q, score, ids, *rest)]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The place of the nearest row of c for each row of x."""
    own = (c * c).sum(axis=1)
    parts = [(own - 2 * x[n : n + 1024] @ c.T).argmin(axis=1) for n in range(0, len(x), 1024)]
    return np.concatenate(parts) if parts else np.empty(0, int)


def finite(vector: str) -> Column:
    """Whether a vector is not null, free of nulls and non-finite numbers, and not all zeros."""
    length = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce((length > 0) & (length < float("inf")), F.lit(False))


@dataclass(frozen=True)
class Model:
    centroids: np.ndarray  # lists x dims
    books: np.ndarray  # parts x codes x width
    probes: int
    radius: np.ndarray  # of each list: the largest distance of a vector from its centroid
    sample: np.ndarray  # some indexed vectors, from which the scores of a query's best are estimated
    count: int  # vectors in the index

    def encode(self, x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals of unit vectors from the centroids of their lists, and how far each decoded vector is off."""
        rest = (x - self.centroids[of]).reshape(len(x), *self.books.shape[::2])
        codes = np.stack([nearest(rest[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)
        return codes, np.linalg.norm(self.decode(codes, of) - x, axis=1)

    def decode(self, codes: np.ndarray, of: np.ndarray | int) -> np.ndarray:
        return self.books[np.arange(codes.shape[1]), codes].reshape(len(codes), -1) + self.centroids[of]

    def rows(self) -> list[tuple]:
        out = [("list", n, 0, [float(r), *map(float, c)]) for n, (c, r) in enumerate(zip(self.centroids, self.radius))]
        out += [("code", p, n, list(map(float, v))) for p, book in enumerate(self.books) for n, v in enumerate(book)]
        out += [("sample", n, 0, list(map(float, v))) for n, v in enumerate(self.sample)]
        return [*out, ("probes", self.probes, 0, []), ("count", 0, 0, [float(self.count)])]

    @staticmethod
    def of(rows: list) -> Model:
        lists = np.array([r.v for r in sorted((r for r in rows if r.kind == "list"), key=lambda r: r.a)])
        codes = sorted((r for r in rows if r.kind == "code"), key=lambda r: (r.a, r.b))
        parts = len({r.a for r in codes})
        books = np.array([r.v for r in codes]).reshape(parts, len(codes) // parts, -1)
        sample = np.array([r.v for r in rows if r.kind == "sample"])
        probes, count = next(r.a for r in rows if r.kind == "probes"), int(next(r.v[0] for r in rows if r.kind == "count"))
        return Model(lists[:, 1:], books, probes, lists[:, 0], sample, count)

    def bar(self, q: np.ndarray, wanted: int) -> np.ndarray:
        """For each query a score that about twice ``wanted`` vectors reach, going by the sample; minus infinity if the sample is too small to tell."""
        place = math.ceil(2 * wanted * len(self.sample) / self.count) + 4
        if place > len(self.sample) or len(self.sample) == self.count:
            return np.full(len(q), -np.inf)
        return np.concatenate([np.partition(q[n : n + 512] @ self.sample.T, -place, axis=1)[:, -place] for n in range(0, len(q), 512)])


def probes_for(sample: np.ndarray, centroids: np.ndarray, recall: float, near: int, asked: int = 256) -> int:
    """The least number of lists in which ``recall`` of the nearest ``near`` rows of sampled queries lie, found on the sample itself."""
    q = sample[: min(asked, len(sample))]
    scores = q @ sample.T
    np.fill_diagonal(scores, -np.inf)
    k = min(near, len(sample) - 1)
    if k < 1:
        return 1
    found = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)
    needed = np.take_along_axis(place, nearest(sample, centroids)[found], axis=1).ravel()
    return int(np.quantile(needed, recall, method="higher")) + 1


def train(vectors: DataFrame, *, lists: int | None = None, width: int = 4, recall: float = 0.95, near: int = 10, seed: int = 1) -> Model:
    """Centroids by k-means over a sample, code books of the residuals by one task a part, and the lists to probe for ``recall`` on the sample.

    ``vectors`` has v, without null and zero vectors. The sample has about TRAIN_ROWS rows, fewer if TRAIN_NUMBERS numbers are reached.
    """
    n, longest = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        raise ValueError("no vectors to index")
    dims = -(-longest // width) * width
    rows = min(TRAIN_ROWS, max(1, TRAIN_NUMBERS // dims))
    filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("v")))
    norm = F.sqrt(F.aggregate(filled, F.lit(0.0), lambda s, x: s + x * x))
    picked = vectors.sample(min(1.0, rows / n), seed).select(F.transform("v", lambda x: x.cast("double")).alias("v")).select(F.transform(filled, lambda x: x / norm).alias("v"))
    path = shared_path(vectors.sparkSession, "sample")
    picked.write.parquet(path)
    sample = vectors.sparkSession.read.parquet(path)
    k = max(1, min(lists or round(math.sqrt(n)), LISTS, sample.count()))
    if k == 1:
        centroids = np.array([sample.agg(*[F.avg(F.col("v")[d]) for d in range(dims)]).first()])
    else:
        fitted = KMeans(k=k, initMode="random", maxIter=10, seed=seed, featuresCol="f").fit(sample.select(array_to_vector("v").alias("f")))
        centroids = np.array(fitted.clusterCenters())
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def residuals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["v"].tolist())
            rest = (x - shared.value[nearest(x, shared.value)]).reshape(len(x), -1, width)
            for p in range(rest.shape[1]):
                yield pd.DataFrame({"part": p, "v": list(rest[:, p])})

    def books(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        book = lloyd(np.array(group["v"].tolist()), CODES)
        return pd.DataFrame({"part": key[0], "code": range(len(book)), "v": list(book)})

    # A group is a part of the bounded sample.
    trained = sample.mapInPandas(residuals, "part int, v array<double>").groupBy("part").applyInPandas(books, "part int, code int, v array<double>").collect()
    codes = np.array([r.v for r in sorted(trained, key=lambda r: (r.part, r.code))]).reshape(dims // width, -1, width)
    own = np.array(sample.limit(max(1, TRAIN_NUMBERS // 8 // dims)).toPandas()["v"].tolist())
    return Model(centroids, codes, probes_for(own, centroids, recall, near), np.zeros(len(centroids)), own[:SAMPLE], n)


def build(docs: DataFrame, path: str, *, id_col: str = "id", vector_col: str = "content_vector", **how) -> None:
    """Write the index of all rows of docs with an id and a vector that is neither null nor zero; ``how`` goes to ``train``.

    Vectors are dealt to pieces by list and a number within it, so a list that holds a third of all rows is cut like any other into pieces of bounded size.
    """
    spark = docs.sparkSession
    rows = docs.where(finite(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind, of_vector = dict(rows.dtypes)["id"], "f4" if dict(rows.dtypes)["v"] == "array<float>" else "f8"
    model = train(rows, **how)
    dims = model.centroids.shape[1]
    shared = spark.sparkContext.broadcast(model)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = padded(batch["v"], dims)
            own = nearest(x, shared.value.centroids)
            yield batch.assign(list=own.astype(np.int32), far=np.linalg.norm(x - shared.value.centroids[own], axis=1))

    placed_at = shared_path(spark, "placed")
    schema = f"id {kind}, v {dict(rows.dtypes)['v']}, list int, far double"
    rows.mapInPandas(assign, schema).withColumn("n", F.monotonically_increasing_id()).write.parquet(placed_at)
    placed = spark.read.schema(f"{schema}, n long").parquet(placed_at)
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"), F.max("far").alias("far"))
    radius = np.zeros(len(model.centroids))
    for r in sizes.collect():  # one row a list, at most LISTS
        radius[r.list] = r.far * (1 + 1e-9) + 1e-12

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x, raw = padded(group["v"], dims), np.zeros((len(group), dims), of_vector)
        for n, v in enumerate(group["v"]):
            raw[n, : len(v)] = v
        codes, errors = shared.value.encode(x, np.full(len(x), key[0]))
        return pd.DataFrame([(key[0], key[1], group["id"].tolist(), codes.tobytes(), (errors * (1 + 1e-9) + 1e-12).astype("f8").tobytes(), raw.tobytes())], columns=["list", "piece", "ids", "codes", "errors", "vectors"])

    numbered = placed.join(F.broadcast(sizes.select("list", "pieces")), "list").withColumn("piece", F.pmod(F.xxhash64("n"), F.col("pieces")).cast("int"))
    # Pieces of a file share a task; grouping by piece needs no further shuffle.
    filed = numbered.select("list", "piece", F.floor(F.col("piece") / FILE).alias("file"), "id", "v").repartition("list", "file")
    filed.groupBy("list", "piece", "file").applyInPandas(pack, PIECES.replace("ID", kind)).write.partitionBy("list").parquet(f"{path}/lists")
    done = replace(model, radius=radius)
    spark.createDataFrame(done.rows(), MODEL).coalesce(1).write.parquet(f"{path}/model")


class VectorIndex:
    """A stored index, opened: the pieces as a table, the model in hand."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        bounded_batches(spark)  # a piece has 1,024 vectors
        self.spark, self.pieces = spark, spark.read.parquet(f"{path}/lists")
        self.model = Model.of(spark.read.schema(MODEL).parquet(f"{path}/model").collect())
        self.kind = dict(self.pieces.dtypes)["ids"][6:-1]

    def _blocks(self, queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
        """Ids and unit vectors of queries, in blocks of about BLOCK."""
        asked = queries.select("query_id", "vector").where(finite("vector"))
        blocks = -(-asked.count() // BLOCK)
        for b in range(blocks):
            few = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()
            if len(few):
                short = few["vector"].map(lambda v: v[: self.model.centroids.shape[1]])
                size = few["vector"].map(lambda v: max(np.linalg.norm(np.array(v, float)), 1e-300)).to_numpy()
                kept = short.map(lambda v: np.linalg.norm(np.array(v, float))).to_numpy()
                # Dimensions that no indexed vector has count in a query's length only.
                yield few["query_id"].tolist(), padded(short, self.model.centroids.shape[1]) * (kept / size)[:, None]

    def _scored(self, wanted: np.ndarray, q: np.ndarray, k: int, *, by_code: bool, least: np.ndarray) -> DataFrame:
        """q (place in the block), list, piece, place, id, score: of the lists that ``wanted`` (queries x lists) marks, the best k of each query and task, ties to the smaller id.

        Scores are those of the codes, and of interest from ``least`` on; or with ``by_code`` false cosines of the vectors, and ``least`` tells which vectors, by code and error, are worth a look.
        """
        model, shared = self.model, self.spark.sparkContext.broadcast((self.model, wanted, q, least))
        lists = np.flatnonzero(wanted.any(axis=0)).tolist()
        rows = self.pieces if len(lists) == wanted.shape[1] else self.pieces.where(F.col("list").isin(lists))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model, wanted, q, least = shared.value
            dims, bar, held, n_held = q.shape[1], least.copy() if by_code else np.full(len(q), -np.inf), [], 0
            for r in (r for batch in batches for r in batch.itertuples(index=False)):
                ids, n = np.asarray(r.ids), len(r.ids)
                every, decoded = np.flatnonzero(wanted[:, r.list]), model.decode(np.frombuffer(r.codes, np.uint8).reshape(n, -1), r.list).T
                for asked in np.split(every, range(1024, len(every), 1024)):
                    scores = q[asked] @ decoded
                    if not by_code:
                        raw = np.frombuffer(r.vectors, f"f{len(r.vectors) // (n * dims)}").reshape(n, dims)
                        near = scores + np.linalg.norm(q[asked], axis=1, keepdims=True) * np.frombuffer(r.errors, "f8") + 1e-9 >= least[asked, None]
                        used = np.flatnonzero(near.any(axis=0))
                        scores = np.full(scores.shape, -np.inf)
                        scores[:, used] = np.round(q[asked] @ units(raw[used].astype(np.float64)).T, DECIMALS)
                    a, b = np.nonzero((scores >= bar[asked, None]) & (scores > -np.inf))
                    held.append((asked[a].astype(np.int32), scores[a, b], ids[b], np.full(len(a), r.list, np.int32), np.full(len(a), r.piece, np.int32), b.astype(np.int32)))
                    n_held += len(a)
                    if n_held > HELD:
                        held = [best(*map(np.concatenate, zip(*held)), k)]
                        n_held, full = len(held[0][0]), np.flatnonzero(np.bincount(held[0][0], minlength=len(q)) >= k)
                        bar[full] = held[0][1][np.searchsorted(held[0][0], full, "right") - 1]
            if held:
                kept = best(*map(np.concatenate, zip(*held)), k)
                yield pd.DataFrame(dict(zip(("q", "score", "id", "list", "piece", "place"), kept)))[["q", "list", "piece", "place", "id", "score"]]

        columns = ["list", "piece", "ids", "codes", *([] if by_code else ["errors", "vectors"])]
        return rows.select(*columns).mapInPandas(run, f"q int, list int, piece int, place int, id {self.kind}, score double")

    def _rescored(self, hits: DataFrame, q: np.ndarray) -> DataFrame:
        """hits with the cosines of their vectors: places are sent to their pieces, which are read once."""
        shared = self.spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    n, dims = len(r.ids), shared.value.shape[1]
                    raw = np.frombuffer(r.vectors, f"f{len(r.vectors) // (n * dims)}").reshape(n, dims)
                    own = units(raw.astype(np.float64))
                    for part in np.split(np.asarray(r.wanted), range(65536, len(r.wanted), 65536)):
                        at, places = part // PIECE_NUMBERS, part % PIECE_NUMBERS
                        score = np.round((shared.value[at] * own[places]).sum(axis=1), DECIMALS)
                        yield pd.DataFrame({"q": at, "id": np.asarray(r.ids)[places], "score": score})

        # At most the candidates of a block of queries.
        wanted = hits.groupBy("list", "piece").agg(F.collect_list(F.col("q").cast("long") * PIECE_NUMBERS + F.col("place")).alias("wanted"))
        joined = self.pieces.select("list", "piece", "ids", "vectors").join(wanted, ["list", "piece"])
        return joined.mapInPandas(run, f"q int, id {self.kind}, score double")

    def _named(self, hits: DataFrame, names: list, kind: str, k: int) -> DataFrame:
        of = F.broadcast(self.spark.createDataFrame(list(enumerate(names)), f"q int, query_id {kind}"))
        return top(hits.join(of, "q").select("query_id", "id", "score"), k)

    def search(self, queries: DataFrame, k: int = CANDIDATES, *, probes: int | None = None, candidates: int | None = None) -> DataFrame:
        """query_id, id, score (cosine), rank: about the k nearest of each query, ties to the smaller id.

        ``probes`` lists are read for each query (by default as many as ``train`` found necessary), and ``candidates`` (10 k, at least 200) compared by
        their vectors. Queries without a vector, or with one of zeros, find nothing. Vectors shorter than the longest count as filled with zeros.
        """
        return self._each(queries, lambda q, names, kind: self._named(self._near(q, k, probes, candidates), names, kind, k))

    def _near(self, q: np.ndarray, k: int, probes: int | None, candidates: int | None) -> DataFrame:
        to_lists, wide = q @ self.model.centroids.T, min(probes or self.model.probes, len(self.model.centroids))
        wanted = to_lists >= np.partition(to_lists, -wide, axis=1)[:, -wide, None]
        most = candidates or max(200, 10 * k)
        found = self._scored(wanted, q, most, by_code=True, least=self.model.bar(q, most))
        return self._rescored(top(found, most, by="q"), q)

    def search_exact(self, queries: DataFrame, k: int = CANDIDATES, *, probes: int | None = None) -> DataFrame:
        """The same, and exactly: the k-th cosine that ``search`` finds tells which lists and vectors can't hold anything better."""

        def run(q: np.ndarray, names: list, kind: str) -> DataFrame:
            least = np.full(len(q), -np.inf)
            for r in top(self._near(q, k, probes, None), k, by="q").where(F.col("rank") == k).collect():  # one row a query of the block
                least[r.q] = r.score - 1e-9
            length = np.linalg.norm(q, axis=1)[:, None]
            wanted = q @ self.model.centroids.T + length * self.model.radius + 1e-9 >= least[:, None]
            return self._named(self._scored(wanted, q, k, by_code=False, least=least), names, kind, k)

        return self._each(queries, run)

    def _each(self, queries: DataFrame, run) -> DataFrame:
        """The results of all blocks, each written once done: plans and broadcasts don't pile up with the queries."""
        kind = dict(queries.dtypes)["query_id"]
        schema, path = f"query_id {kind}, id {self.kind}, score double, rank int", shared_path(self.spark, "hits")
        self.spark.createDataFrame([], schema).write.parquet(path)
        for names, q in self._blocks(queries):
            run(q, names, kind).write.mode("append").parquet(path)
        return self.spark.read.schema(schema).parquet(path)
