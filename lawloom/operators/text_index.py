"""A stored full-text index over weighted fields, searched by block maxima.

    path/postings/bucket=<n>/   a row for each term and range of 4,096 documents: places in the range, impacts, and the largest impact
    path/postings/bucket=-1/    a row for each range: places and ids of its documents
    path/meta                   documents, ranges and weights; written last

Documents are numbered where they are read, and a number's upper bits are its range; so each range is cut into terms and turned into
blocks by one task, and only blocks are shuffled. What a term adds to a document's score but its rarity (its impact) is known when
the index is built, so a block's largest impact bounds what the term can add anywhere in the range. A search first reads
only the heads of the blocks of its terms: their sum bounds the score of all documents of a range. The most promising ranges are scored,
which gives each query a k-th best score, and of the other ranges only those that can still reach it. So a
common term costs its heads in a range that can't matter, not its documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lawloom.operators.retrieve import small, top
from lawloom.session import shared_path

# Documents of a range (two to this power), buckets of terms, documents of a file of a bucket, ranges scored first, queries of a block.
BITS, BUCKETS, SPAN, FIRST, BLOCK = 12, 64, 1_000_000, 4, 2000
ROW = "term string, range long, places array<short>, impacts array<double>, top double, docs int"
# English words that carry no meaning of their own.
STOP = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such",
    "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]


def stem(word: str) -> str:
    """The word without an English plural ending (Harman's s-stemmer, 1991): the first rule that fits holds."""
    if not word.endswith("s"):
        return word
    if word.endswith("ies") and not word.endswith(("eies", "aies")):
        return word[:-3] + "y"
    if word.endswith("es") and not word.endswith(("aes", "ees", "oes")):
        return word[:-1]
    return word if word.endswith(("us", "ss")) else word[:-1]


class Analyzer:
    """Terms of texts: lower-case runs of a-z and 0-9, without stop words, stemmed. A null text has none.

    Letters are lower-cased one by one, so a dotted capital I is an i, where Python and the JVM make two characters of it, which would cut a word.
    """

    def __init__(self) -> None:
        self.known: dict[str, str] = dict.fromkeys(STOP, "")

    def terms(self, text: str | None) -> dict[str, int]:
        """Each term and how often it comes."""
        out, known = {}, self.known
        for word, n in Counter(re.findall("[a-z0-9]+", (text or "").replace("\u0130", "i").lower())).items():
            term = known.get(word)
            if term is None:
                term = known[word] = stem(word)
            if term:
                out[term] = out.get(term, 0) + n
        if len(known) > 1_000_000:
            self.known = dict.fromkeys(STOP, "")
        return out


def words(text: Column) -> Column:
    """The length of a text: its runs of a-z and 0-9, stop words included."""
    return F.regexp_count(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u0130"), F.lit("i"))), F.lit("[a-z0-9]+"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term of the distinct terms of queries (query_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyzer = Analyzer()
        for batch in batches:
            found = [list(analyzer.terms(text)) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["query_id"], pa.array(found, pa.list_(pa.string()))], ["query_id", "terms"])

    of_each = queries.select("query_id", "text").mapInArrow(run, f"query_id {dict(queries.dtypes)['query_id']}, terms array<string>")
    return of_each.select("query_id", F.explode("terms").alias("term"))


class _Range:
    """The documents of one range, as they come: for each term its places and summed weights."""

    def __init__(self, number: int) -> None:
        self.number, self.places, self.ids, self.terms = number, [], [], {}

    def add(self, place: int, key, found: list[dict[str, int]], norms: list[float]) -> None:
        self.places.append(place)
        self.ids.append(key)
        x = {t: n * norms[0] for t, n in found[0].items()}
        for own, norm in zip(found[1:], norms[1:]):
            for t, n in own.items():
                x[t] = x.get(t, 0.0) + n * norm
        for t, value in x.items():
            held = self.terms.get(t)
            if held is None:
                held = self.terms[t] = ([], [])
            held[0].append(place)
            held[1].append(value)

    def blocks(self, k1: float, kind: pa.DataType) -> pa.RecordBatch:
        """A row for each term, and one without a term for the ids."""
        terms = list(self.terms)
        sizes = np.array([len(self.terms[t][0]) for t in terms] + [len(self.ids)], np.int32)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        x = np.fromiter(chain.from_iterable(self.terms[t][1] for t in terms), float, ends[-2])
        impacts = x * (k1 + 1) / (x + k1)
        tops = np.append(np.maximum.reduceat(impacts, ends[:-2]) if terms else np.empty(0), 0.0)
        places = np.fromiter(chain(chain.from_iterable(self.terms[t][0] for t in terms), self.places), np.int16, ends[-1])
        only_ids, no_impacts = np.append(np.zeros(len(terms), np.int32), [0, len(self.ids)]), np.append(ends[:-1], ends[-2])
        columns = [
            pa.array([*terms, None], pa.string()),
            pa.array(np.full(len(sizes), self.number)),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(places)),
            pa.ListArray.from_arrays(pa.array(no_impacts.astype(np.int32)), pa.array(impacts)),
            pa.array(tops),
            pa.array(sizes),
            pa.ListArray.from_arrays(pa.array(only_ids.astype(np.int32)), pa.array(self.ids, kind)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["term", "range", "places", "impacts", "top", "docs", "ids"])


def build(docs: DataFrame, path: str, weights: dict[str, float], *, id_col: str = "id", k1: float = 1.2, b: float = 0.75) -> None:
    """Write the index of docs over the fields named by ``weights`` (text columns).

    A term's frequency in a document is the sum over fields of weight * tf / (1 - b + b * length / mean length), and its impact that
    sum saturated by k1 (BM25F: Zaragoza and others, 2004). Each row is a document, also one with a null id, and one without terms, which no search finds.
    """
    spark, fields, kind, bits = docs.sparkSession, list(weights), dict(docs.dtypes)[id_col], BITS
    sizes = docs.agg(F.count("*").alias("docs"), *[F.avg(words(F.col(f))).alias(f"m{k}") for k, f in enumerate(fields)]).first()
    spans = max(1, -(-sizes["docs"] // SPAN))
    norms = [F.lit(float(weights[f])) / (1 - b + b * words(F.col(f)) / F.lit(sizes[f"m{k}"] or 1.0)) for k, f in enumerate(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyzer, held = Analyzer(), None
        for batch in batches:
            of_id = batch["id"].type
            for n, key, norm, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or held.number != n >> bits:
                    if held is not None:
                        yield held.blocks(k1, of_id)
                    held = _Range(n >> bits)
                held.add(n & ((1 << bits) - 1), key, [analyzer.terms(t) for t in texts], norm)
        if held is not None:
            yield held.blocks(k1, of_id)

    numbered = docs.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("id"), F.array(*norms).alias("norms"), *[F.col(f).alias(f"f{k}") for k, f in enumerate(fields)])
    blocks = numbered.mapInArrow(run, f"{ROW}, ids array<{kind}>")
    bucket = F.when(F.col("term").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int")
    dealt = blocks.withColumn("bucket", bucket).repartition("bucket", F.pmod("range", F.lit(spans)))
    dealt.sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark.createDataFrame([(sizes["docs"], bits, kind, ",".join(f"{f}={w}" for f, w in weights.items()))], "docs long, bits int, kind string, weights string").coalesce(1).write.parquet(f"{path}/meta")


class TextIndex:
    """A stored index, opened."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        meta = spark.read.parquet(f"{path}/meta").first()
        self.spark, self.count, self.bits = spark, meta["docs"], meta["bits"]
        self.postings = spark.read.schema(f"{ROW}, ids array<{meta['kind']}>, bucket int").parquet(f"{path}/postings")
        self.kind = meta["kind"]

    def _asked(self, queries: DataFrame) -> DataFrame:
        """query_id, bucket, term of the distinct terms of each query, and the rarity of the term; terms that no document has are left out."""
        terms = query_terms(queries).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        known = self._of_terms(terms, "docs").groupBy("bucket", "term").agg(F.sum("docs").alias("df"))
        idf = F.log((F.lit(self.count) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        at = shared_path(self.spark, "asked")
        terms.join(known, ["bucket", "term"]).select("query_id", "bucket", "term", idf.alias("idf")).write.parquet(at)
        return self.spark.read.parquet(at)

    def _buckets(self, asked: DataFrame) -> list[int]:
        return [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS

    def _of_terms(self, asked: DataFrame, *columns: str) -> DataFrame:
        """Columns of the blocks of the terms that are asked for; buckets without such a term aren't read."""
        rows = self.postings.where(F.col("bucket").isin(self._buckets(asked))).select("bucket", "term", "range", *columns)
        return rows.join(small(asked.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")

    def _scores(self, asked: DataFrame, ranges: DataFrame, k: int, least: dict | None = None) -> DataFrame:
        """query_id, range, id, score: of each range and query the best k documents with one of its terms.

        Blocks of the terms and ids of the ranges are grouped by range, each once for all queries. A query whose bound in a range stays under its
        ``least`` is passed over there.
        """
        rows = asked.orderBy("query_id", "term").toArrow()  # the terms of a block of queries
        names = rows["query_id"].combine_chunks().unique()
        of_query = {key: [] for key in names.to_pylist()}
        for key, term, idf in zip(*(rows[c].to_pylist() for c in ("query_id", "term", "idf"))):
            of_query[key].append((term, idf))
        shared = self.spark.sparkContext.broadcast((names, of_query, least or {}))
        size = 1 << self.bits

        def scored(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            (names, of_query, least), blocks = shared.value, {}
            places, ids = np.empty(0, int), pa.array([], group["ids"].type.value_type)
            for batch in group.to_batches():
                for term, at, impacts, top_impact, own in zip(batch["term"].to_pylist(), *(batch[c] for c in ("places", "impacts", "top", "ids"))):
                    if term:
                        blocks[term] = at.values.to_numpy(), impacts.values.to_numpy(), top_impact.as_py()
                    else:
                        places, ids = at.values.to_numpy(), own.values
            keys = ids.to_pylist()
            of, docs, scores = [], [], []
            for n, (query, terms) in enumerate(of_query.items()):
                own = [(idf, blocks[t]) for t, idf in terms if t in blocks]
                if not own or sum(idf * b[2] for idf, b in own) + 1e-6 < least.get(query, 0.0):
                    continue
                total, met = np.zeros(size), np.zeros(size, bool)
                for idf, (at, impacts, _) in own:
                    total[at] += idf * impacts
                    met[at] = True
                total = np.floor(total[places] * 1e9 + 0.5) / 1e9  # halves go up, as in SQL
                found = np.flatnonzero(met[places])
                if len(found) > k:
                    found = found[total[found] >= np.partition(total[found], -k)[-k]]
                best = sorted(found.tolist(), key=lambda i: (-total[i], keys[i] is not None, keys[i]))[:k]
                of += [n] * len(best)
                docs += best
                scores += total[best].tolist()
            columns = [names.take(pa.array(of, pa.int32())), pa.repeat(key[0], len(of)), ids.take(pa.array(docs, pa.int32())), pa.array(scores, pa.float64())]
            return pa.Table.from_arrays(columns, ["query_id", "range", "id", "score"])

        # The rows of ids have no term; here they go by an empty one, which no text has.
        keys = asked.select("bucket", "term").unionByName(self.spark.createDataFrame([(-1, "")], "bucket int, term string")).distinct()
        rows = self.postings.where(F.col("bucket").isin([-1, *self._buckets(asked)])).withColumn("term", F.coalesce("term", F.lit("")))
        blocks = rows.join(F.broadcast(keys), ["bucket", "term"], "left_semi").join(ranges.select("range").distinct(), "range", "left_semi")
        # A group by range, not rows dealt and sorted by it: Spark takes the join's shuffle for those, and may read that part by part once the join is a broadcast.
        wanted = blocks.select("range", "term", "places", "impacts", "top", "ids").groupBy("range")
        return wanted.applyInArrow(scored, f"query_id {dict(asked.dtypes)['query_id']}, range long, id {self.kind}, score double")

    def bounds(self, asked: DataFrame) -> DataFrame:
        """query_id, range, bound (no document of the range scores more), and the place of the range among those of its query."""
        heads = self._of_terms(asked, "top").join(small(asked), ["bucket", "term"])
        summed = heads.groupBy("query_id", "range").agg((F.sum(F.col("idf") * F.col("top")) + 1e-6).alias("bound"))
        return summed.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")))

    def search(self, queries: DataFrame, k: int = 10, *, first: int = FIRST) -> DataFrame:
        """query_id, id, score, rank: the k best documents of each query (query_id, text), ties to the smaller id; exact.

        Scores are rounded to 9 decimals, so that equal texts tie; a null id comes first. ``first`` ranges of each query are scored before the others are
        judged by their bounds; it changes the work, not the result. A query without known terms finds nothing.
        """
        kind, path = dict(queries.dtypes)["query_id"], shared_path(self.spark, "found")
        schema = f"query_id {kind}, id {self.kind}, score double, rank int"
        self.spark.createDataFrame([], schema).write.parquet(path)
        blocks = -(-queries.count() // BLOCK)
        for part in range(blocks):
            self._block(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == part), k, first).write.mode("append").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _block(self, queries: DataFrame, k: int, first: int) -> DataFrame:
        """The result for a block of queries, which is small enough for the driver."""
        asked, at, begun_at = self._asked(queries), shared_path(self.spark, "bounds"), shared_path(self.spark, "first")
        self.bounds(asked).write.parquet(at)
        bounds = self.spark.read.parquet(at)
        begun_in = bounds.where(F.col("at") <= first).select("range").distinct()
        self._scores(asked, begun_in, k).write.parquet(begun_at)
        begun = self.spark.read.parquet(begun_at)
        kth = {r.query_id: r.score for r in top(begun, k).where(F.col("rank") == k).collect()}  # one row a query of the block
        bars = self.spark.createDataFrame(list(kth.items()), f"query_id {dict(queries.dtypes)['query_id']}, least double")
        rest = bounds.join(begun_in, "range", "left_anti").join(F.broadcast(bars), "query_id", "left")
        rest = rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        return top(begun.unionByName(self._scores(asked, rest, k, kth)).select("query_id", "id", "score"), k)
