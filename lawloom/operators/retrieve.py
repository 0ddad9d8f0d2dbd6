"""Lexical, vector and hybrid search for tables of queries, with rerank and gate.

Queries are rows (query_id, text, vector), a table that is small beside the documents and is
broadcast after a check of its rows; documents are scanned once for all of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawloom.session import bounded_batches, shared_path

# Documents and queries of one matrix product, hits that a task holds before it keeps the best, and rows it hands on at once.
TILE, HELD, OUT = 512, 1 << 19, 10_000
# Hits of the two branches, vector candidates, the gate's score and least hits, and the fusion's constant.
LOCAL_K, STATE_K, CANDIDATES, GATE, LEAST, FUSE = 5, 4, 50, 1.0, 3, 60
LOCAL_TYPES = ["code", "attachment", "new_law"]
_TERM = r"[a-z0-9]+"


def terms(text: Column) -> Column:
    # A dotted capital I is an i, as in SQL; the JVM makes two characters of it.
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u0130"), F.lit("i"))), F.lit(_TERM), F.lit(0))


def small(queries: DataFrame, most: int = 100_000) -> DataFrame:
    """queries, marked for broadcast if they have at most ``most`` rows; else Spark chooses the join."""
    return F.broadcast(queries) if queries.limit(most + 1).count() <= most else queries


def top(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", key: str = "id") -> DataFrame:
    """The k best rows of each query, ties by key, with ``rank`` from 1."""
    order = Window.partitionBy(by).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, *, k1: float = 1.2, b: float = 0.75, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """query_id, id, score of all documents with a term of the query (Robertson and Zaragoza, 2009).

    Only occurrences of query terms are exploded, so a document costs its matches and not its
    words; document counts of terms are summed map-side. A null text is a document without a length, which the mean leaves out. Scores are rounded to 9 decimals, so that equal
    texts tie whatever the order of their sums.
    """
    q = small(queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")))
    tokens = docs.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("terms"), F.col(text_col).isNull().alias("none"))
    sized = tokens.select("id", "terms", F.size("terms").alias("length"), "none")
    whole = sized.agg(F.count("*").alias("docs"), F.avg(F.when(~F.col("none"), F.col("length"))).alias("mean")).first()
    hits = sized.select("id", "length", F.explode("terms").alias("term")).join(small(q.select("term").distinct()), "term", "left_semi")
    tf = hits.groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(whole["docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(whole["mean"] or 1.0))
    weight = tf.join(df, "term").select("id", "term", (idf * F.col("tf") * (k1 + 1) / norm).alias("w"))
    return weight.join(q, "term").groupBy("query_id", "id").agg(F.round(F.sum("w"), 9).alias("score"))


def _best(q: np.ndarray, score: np.ndarray, at: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Which hits are among the k best of their query, ties to the smaller id (a null one first), sorted by query and rank."""
    place = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()[at]
    order = np.lexsort((place, -score, q))
    return order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < k]


class _Held:
    """Hits that a task holds: little more than the k best of each query, and ``bar``, which a further hit must reach."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.bar, self.most = k, np.full(queries, -np.inf), max(HELD, 2 * k * queries)
        self.q, self.score, self.at, self.ids, self.n, self.new = [], [], [], [], 0, 0

    def add(self, first: int, scores: np.ndarray, met: np.ndarray | None = None) -> None:
        """Of scores, a row for each query from ``first`` on and a column for each document of the next ``ids``, those that are met and reach the bar."""
        least = self.bar[first : first + len(scores)]
        if scores.shape[1] > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        a, b = np.nonzero(scores >= least[:, None] if met is None else met & (scores >= least[:, None]))
        self.q.append((a + first).astype(np.int32))
        self.score.append(scores[a, b])
        self.at.append(b + self.new)
        self.n += len(a)

    def done(self, ids: pa.Array) -> None:
        """The documents with these ids are scored for all queries."""
        self.ids.append(ids)
        self.new += len(ids)
        if self.n > self.most:
            self._keep()

    def _keep(self) -> None:
        names = pa.concat_arrays(self.ids)
        q, score, at = np.concatenate(self.q), np.concatenate(self.score), np.concatenate(self.at)
        kept = _best(q, score, at, names, self.k)
        used, own = np.unique(at[kept], return_inverse=True)
        self.q, self.score, self.at, self.ids, self.n, self.new = [q[kept]], [score[kept]], [own], [names.take(pa.array(used))], len(kept), len(used)
        full = np.flatnonzero(np.bincount(self.q[0], minlength=len(self.bar)) >= self.k)
        self.bar[full] = self.score[0][np.searchsorted(self.q[0], full, "right") - 1]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.q:
            self._keep()
            for n in range(0, self.n, OUT):
                yield pa.RecordBatch.from_arrays([pa.array(self.q[0][n : n + OUT]), self.ids[0].take(pa.array(self.at[0][n : n + OUT])), pa.array(self.score[0][n : n + OUT])], ["q", "id", "score"])


def _counted(docs: DataFrame, asked: list[str]) -> DataFrame:
    """id, length, and of the asked terms that a document (id, text) has their places in ``asked`` and their counts."""
    shared = docs.sparkSession.sparkContext.broadcast({t: n for n, t in enumerate(asked)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, find = shared.value, re.compile(_TERM).findall
        for batch in batches:
            lengths, ends, places, counts = [], [0], [], []
            for text in batch["text"].to_pylist():
                found = find((text or "").replace("\u0130", "i").lower())
                own = sorted((known[t], n) for t, n in Counter(found).items() if t in known)
                lengths.append(None if text is None else len(found))
                places += [t for t, _ in own]
                counts += [n for _, n in own]
                ends.append(len(places))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (places, counts)]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(lengths, pa.int64()), *lists], ["id", "length", "terms", "counts"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, length long, terms array<int>, counts array<int>")


def _lexical(counted: DataFrame, of_term: list[list[int]], idf: np.ndarray, queries: int, mean: float, k: int, k1: float, b: float) -> DataFrame:
    """q, id, score: of each task the k best of every query; ``of_term`` has the queries of each term by their numbers."""
    ends = np.cumsum([0, *map(len, of_term)])
    shared = counted.sparkSession.sparkContext.broadcast((ends, np.array([q for own in of_term for q in own], np.int64), idf))
    tile = max(1, min(TILE, (1 << 20) // queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ends, of, idf), held = shared.value, _Held(queries, k)
        for part in (batch.slice(n, tile) for batch in batches for n in range(0, len(batch), tile)):
            terms, tf = part["terms"].flatten().to_numpy(), part["counts"].flatten().to_numpy()
            doc = np.repeat(np.arange(len(part)), pc.list_value_length(part["terms"]).to_numpy())
            norm = k1 * (1 - b + b * pc.fill_null(part["length"], 0).to_numpy() / mean)
            w = idf[terms] * tf * (k1 + 1) / (tf + norm[doc])
            # A row for each query of a term; they add up in the order of terms, so equal texts score alike.
            times = ends[terms + 1] - ends[terms]
            at = np.arange(times.sum()) + np.repeat(ends[terms] - np.cumsum(times) + times, times)
            total = np.bincount(of[at] * len(part) + np.repeat(doc, times), np.repeat(w, times), queries * len(part)).reshape(queries, len(part))
            held.add(0, np.floor(total * 1e9 + 0.5) / 1e9, total > 0)
            held.done(part["id"])
        yield from held.rows()

    return counted.select("id", "length", "terms", "counts").mapInArrow(run, f"q int, id {dict(counted.dtypes)['id']}, score double")


def bm25_top(docs: DataFrame, queries: DataFrame, k: int = CANDIDATES, *, block: int = 10_000, k1: float = 1.2, b: float = 0.75, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """The k best documents of each query by ``bm25``, ties by id, exactly.

    Queries travel in blocks of about ``block``. Documents are cut into words once for a block, and how often each has the block's terms is written; then each
    is scored for all queries where it lies, and only a task's best of each query are shuffled. Ids that are repeated add up their scores, for which all scored pairs are shuffled.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not own.groupBy("id").count().where("count > 1").isEmpty():
        return top(bm25(docs, queries, k1=k1, b=b, id_col=id_col, text_col=text_col), k)
    asked = queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("terms"))
    kind, blocks, found = dict(asked.dtypes)["query_id"], max(1, -(-asked.count() // block)), None
    for part in range(blocks):
        few = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == part).collect()
        names, of_term = {r.query_id: None for r in few}, {}
        number = {q: n for n, q in enumerate(names)}
        for r in few:
            for t in r.terms:
                of_term.setdefault(t, []).append(number[r.query_id])
        every, path = sorted(of_term), shared_path(spark, "counted")
        _counted(own, every).write.parquet(path)
        counted = spark.read.parquet(path)
        whole = counted.agg(F.count("*").alias("docs"), F.avg("length").alias("mean")).first()
        df = np.zeros(len(every))
        for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each of the block's terms at most
            df[r.term] = r["count"]
        idf = np.log((whole["docs"] - df + 0.5) / (df + 0.5) + 1)
        of_query = spark.createDataFrame(list(enumerate(names)), f"q int, query_id {kind}")
        scored = _lexical(counted, [of_term[t] for t in every], idf, max(1, len(names)), whole["mean"] or 1.0, k, k1, b)
        scored = scored.join(F.broadcast(of_query), "q").select("query_id", "id", "score")
        found = scored if found is None else found.unionByName(scored)
    return top(found, k)


def _nearest(docs: DataFrame, few: list, k: int, dims: int) -> DataFrame:
    """query_id (as its place in few), id, score: of each task the k best of every query.

    Documents and queries are scored TILE by TILE, and a task holds little more than the k best of each query, by which what follows is judged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.array([list(r.vector) for r in few], np.float64).reshape(len(few), dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value / np.maximum(np.linalg.norm(shared.value, axis=1, keepdims=True), 1e-300)
        held = _Held(len(asked), k)
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch["v"]))
            for part in (batch.slice(n, TILE) for n in range(0, len(batch), TILE)):
                own = np.array(part["v"].to_pylist(), np.float64)
                if not (sound := np.isfinite(own).all(axis=1)).all():
                    part, own = part.filter(pa.array(sound)), own[sound]
                own = (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-300)).T
                for first in range(0, len(asked), TILE):
                    held.add(first, np.round(asked[first : first + TILE] @ own, 12))
                held.done(part["id"])
        yield from held.rows()

    return docs.mapInArrow(run, f"q int, id {dict(docs.dtypes)['id']}, score double")


def vector_top(docs: DataFrame, queries: DataFrame, k: int = CANDIDATES, *, block: int = 10_000, id_col: str = "id", vector_col: str = "content_vector") -> DataFrame:
    """The k nearest documents of each query by cosine (to 12 decimals), exactly.

    Queries travel to the scan in blocks of about ``block`` (which bounds the broadcast); documents
    are scored against a block tile by tile, and only a task's best of each
    query are shuffled. A null vector or query, or one with a number that isn't finite, is near to nothing.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    asked = queries.select("query_id", "vector").where(F.col("vector").isNotNull())
    blocks = max(1, -(-asked.count() // block))
    found = None
    for part in range(blocks):
        few = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == part).collect()
        dims = max((len(r.vector) for r in few), default=1)
        names = docs.sparkSession.createDataFrame([(n, r.query_id) for n, r in enumerate(few)], f"q int, query_id {dict(asked.dtypes)['query_id']}")
        scored = _nearest(own, few, k, dims).join(F.broadcast(names), "q").select("query_id", "id", "score")
        found = scored if found is None else found.unionByName(scored)
    return top(found, k)


def fuse(*ranked: DataFrame, constant: int = FUSE) -> DataFrame:
    """query_id, id, score: reciprocal rank fusion of ranked lists (Cormack and others, 2009)."""
    parts = [r.select("query_id", "id", (1 / (constant + F.col("rank"))).alias("part")) for r in ranked]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def hybrid(docs: DataFrame, queries: DataFrame, k: int, *, candidates: int = CANDIDATES, vectors: DataFrame | None = None) -> DataFrame:
    """The k best by both lists fused. ``vectors`` (id, content_vector) may be a table of its own, so that texts needn't be joined to it."""
    lexical = bm25_top(docs, queries, candidates)
    return top(fuse(lexical, vector_top(docs if vectors is None else vectors, queries, candidates)), k)


def rerank(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """hits with a score of 0 to 4: weighted shares of the query's terms found in title, keywords and content.

    A plain local substitute for a hosted reranker, behind the same place in the plan.
    """
    fields = {"title": 1.5, "breadcrumb": 0.5, "content": 2.0}
    joined = docs.select("id", *fields).join(small(hits.select("query_id", "id", "rank")), "id").join(small(queries.select("query_id", "text")), "query_id")
    asked = F.array_distinct(terms(F.col("text")))
    share = lambda c: F.size(F.array_intersect(asked, terms(F.col(c)))) / F.greatest(F.size(asked), F.lit(1))
    score = reduce(lambda a, b: a + b, [share(c) * w for c, w in fields.items()])
    return joined.select("query_id", "id", "rank", score.alias("score"))


def branch(docs: DataFrame, local: bool) -> DataFrame:
    """Documents of the local branch or of the other; a null type belongs to the other."""
    own = F.coalesce(F.col("source_type").isin(LOCAL_TYPES), F.lit(False))
    return docs.where(own if local else ~own)


def gate(hits: DataFrame, *, score: float = GATE, least: int = LEAST) -> DataFrame:
    """Hits with at least ``score`` if there are ``least`` such; else the best ``least`` of all. A null score is 0."""
    scored = hits.withColumn("score", F.coalesce("score", F.lit(0.0)))
    by = Window.partitionBy("query_id")
    strong = F.count_if(F.col("score") >= score).over(by)
    place = F.row_number().over(by.orderBy(F.desc("score"), "branch", "rank"))
    kept = scored.withColumns({"strong": strong, "n": place})
    return kept.where(((F.col("strong") >= least) & (F.col("score") >= score)) | ((F.col("strong") < least) & (F.col("n") <= least))).drop("strong")


def search(docs: DataFrame, queries: DataFrame, *, local_k: int = LOCAL_K, state_k: int = STATE_K, vectors: DataFrame | None = None) -> DataFrame:
    """Both branches of a hybrid search, reranked, merged and gated: query_id, n, id, score, branch.

    ``vectors`` (id, source_type, content_vector) as in ``hybrid``. Hits are written before they are reranked: a few rows
    for each query, to which the documents come without a shuffle of their texts.
    """
    parts, spark = [], docs.sparkSession
    for number, (local, k) in enumerate(((True, local_k), (False, state_k))):
        own, path = branch(docs, local), shared_path(spark, "hits")
        hits = hybrid(own, queries, k, vectors=None if vectors is None else branch(vectors, local)).select("query_id", "id", "rank")
        hits.write.parquet(path)
        parts.append(rerank(spark.read.schema(hits.schema).parquet(path), own, queries).withColumn("branch", F.lit(number)))
    return gate(parts[0].unionByName(parts[1])).select("query_id", "n", "id", "score", "branch")
