"""The index table: embeddings with a cache, merge, and removal of stale rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.functions.text import vector_hash

# Prefixes of the ids that this index owns.
OWNED = r"^(code|attachment|newlaw|ext)-"


@dataclass(frozen=True)
class HashEmbedder:
    """A local stand-in for an embedding service: signed counts of hashed words, at unit length."""

    model: str = "hash"
    dims: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims), np.float64)
        for k, text in enumerate(texts):
            words = pd.Series((text or "").lower().split(), dtype=object)
            if len(words):
                h = pd.util.hash_array(words.to_numpy(), categorize=False)
                np.add.at(out[k], (h % np.uint64(self.dims)).astype(int), np.where(h >> np.uint64(63), 1.0, -1.0))
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).astype(np.float32).tolist()


def embed_texts(texts: DataFrame, embedder: HashEmbedder, *, batch: int = 16, text_col: str = "content") -> DataFrame:
    """texts with ``v``, the vector of each text, in calls of at most ``batch`` texts."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            rows = series.tolist()
            yield pd.Series([v for at in range(0, len(rows), batch) for v in embedder.embed(rows[at : at + batch])])

    return texts.withColumn("v", run(F.col(text_col)))


def cached_vectors(cache: DataFrame) -> DataFrame:
    """One vector of each hash: the last by the column ``seq``, if there is one."""
    if "seq" not in cache.columns:
        return cache.select("h", "v").dropDuplicates(["h"])
    return cache.groupBy("h").agg(F.max_by("v", "seq").alias("v"))


def to_embed(chunks: DataFrame, cache: DataFrame, embedder: HashEmbedder) -> DataFrame:
    """h and content of the distinct texts that the cache lacks."""
    hashed = chunks.select(vector_hash(embedder.model, embedder.dims, F.col("content")).alias("h"), "content")
    return hashed.dropDuplicates(["h"]).join(cache.select("h"), "h", "left_anti")


def embed_chunks(chunks: DataFrame, cache: DataFrame, embedder: HashEmbedder) -> tuple[DataFrame, DataFrame]:
    """chunks with content_vector, and the new rows (h, v) to append to the cache."""
    new = embed_texts(to_embed(chunks, cache, embedder), embedder).select("h", "v")
    known = cached_vectors(cache).unionByName(new)
    hashed = chunks.withColumn("h", vector_hash(embedder.model, embedder.dims, F.col("content")))
    return hashed.join(known.withColumnRenamed("v", "content_vector"), "h", "left").drop("h"), new


def stale_keys(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ids of owned rows of the index that no chunk has."""
    return index.where(F.col("id").rlike(OWNED)).select("id").join(chunks.select("id"), "id", "left_anti")


def upsert(index: DataFrame, rows: DataFrame) -> DataFrame:
    """index with rows merged by id: fields that rows have are replaced, others stay."""
    both = index.alias("o").join(rows.withColumn("_new", F.lit(True)).alias("n"), "id", "full_outer")
    new = set(rows.columns)
    columns = [F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in new else F.col(f"o.{c}") for c in index.columns if c != "id"]
    return both.select("id", *columns)


def push(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """The index after an upload: merged, then without stale rows (never removed before the merge is whole)."""
    return upsert(index, chunks).join(stale_keys(index, chunks), "id", "left_anti")


def key_page(index: DataFrame, skip: int, size: int = 1000) -> DataFrame:
    """One page of the index's ids in order."""
    return index.select("id").orderBy("id").offset(skip).limit(size)


def facets(index: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, rows of each column, arrays by their items; columns are read in one pass."""
    kinds = dict(index.dtypes)

    def pairs_of(c: str) -> Column:
        items = F.col(c) if kinds[c].startswith("array") else F.array(F.col(c).cast("string"))
        return F.transform(items, lambda v: F.struct(F.lit(c).alias("facet"), v.alias("value")))

    pairs = [pairs_of(c) for c in columns]
    every = index.select(F.explode(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<struct<facet:string,value:string>>")) for p in pairs]))).alias("f"))
    return every.where("f.value is not null").groupBy("f.facet", "f.value").agg(F.count("*").alias("rows"))
