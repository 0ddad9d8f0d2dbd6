"""Readers of raw files, stored chunks and cached vectors; polite fetching inside tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.functions.text import cache_name
from lawloom.operators import markup
from lawloom.schemas import BLOCK, PAGES, chunk_schema


def raw_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content of files, as bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def as_text(raw: DataFrame) -> DataFrame:
    """path and html: UTF-8 with replacement of what is not."""

    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda x: None if x is None else bytes(x).decode("utf-8", "replace"))

    return raw.select("path", decode("content").alias("html"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def word_blocks(raw: DataFrame) -> DataFrame:
    """Blocks of Word files: path, block_ix and the block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": p, "block_ix": k, **b} for p, c in zip(batch["path"], batch["content"], strict=True) for k, b in enumerate(markup.word_file(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "block_ix", "kind", "text", "table_header", "table_rows"])

    return raw.select("path", "content").mapInPandas(run, f"path string, block_ix int, {BLOCK}")


def pdf_pages(raw: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """Pages (doc_id, page, text) of PDF files by a given extractor; other files are an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if not bytes(content).startswith(b"%PDF"):
                    raise ValueError(f"{path} is not a PDF")
                rows += [(path, k, text) for k, text in enumerate(extract(bytes(content)), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text"])

    return raw.select("path", "content").mapInPandas(run, PAGES)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(chunk_schema()).json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Cached vectors: h, v, and seq, by which the last of repeated hashes is known."""
    return spark.read.schema("h string, v array<float>, seq long").json(path)


def retried(call: Callable[[], tuple[int, bytes]], *, tries: int = 5, wait: Callable[[float], None] = time.sleep) -> bytes:
    """The body of the first answer with status 200. Other answers and errors are tried again, each wait twice the last."""
    for attempt in range(tries):
        try:
            status, body = call()
        except OSError:
            wait(2.0 * 2**attempt)
            continue
        if status == 200:
            return body
        if status < 500 and status != 429:
            raise ValueError(f"status {status}")
        wait(5.0 * 2**attempt)
    raise ValueError("giving up")


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, bytes]], *, delay: float = 1.5, hosts: int = 8) -> DataFrame:
    """url, name (of the cached file) and content; urls of one host go to one task, with a pause between them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url in batch["url"]:
                out.append((url, retried(lambda u=url: get(u))))
                time.sleep(delay)
            yield pd.DataFrame(out, columns=["url", "content"])

    by_host = urls.select("url").distinct().repartition(hosts, F.regexp_extract("url", "://([^/?#]*)", 1))
    return by_host.mapInPandas(run, "url string, content binary").withColumn("name", cache_name(F.col("url")))
