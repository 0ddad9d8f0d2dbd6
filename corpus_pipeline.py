"""The corpus pipeline: five operators in a row, each on what the one before kept.

Rows are judged each by its id and text (``with_row``), never by the id alone: a verdict holds for rows
with both equal, so documents without an id are judged like others, and of repeated ids with
different texts only the rejected texts go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.llm.common import documents, materialise
from lawloom.llm.decontaminate import decontaminate
from lawloom.llm.language import identify_language
from lawloom.llm.line_dedup import drop_recurring_lines
from lawloom.llm.ngram_join import ngram_join
from lawloom.llm.packing import pack_documents
from lawloom.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_row(docs: DataFrame) -> DataFrame:
    """docs and the hash of their id and text; nulls are marked, as xxhash64 passes over them."""
    marked = [x for c in ("doc_id", "text") for x in (F.col(c), F.col(c).isNull())]
    return docs.select(*COLUMNS, F.xxhash64(*marked).alias("row"))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs (of ``with_row``) but those with one of rows, which are written first, so that Spark knows whether they are few enough to broadcast."""
    return docs.join(materialise(rows.select("row").distinct(), "rows"), "row", "left_anti").select(COLUMNS)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: ``und`` goes, and what the classifier can't place (score under 0.3)."""
    rows = with_row(docs)
    return without(rows, identify_language(rows, key_col="row").where((F.col("lang_pred") == "und") | (F.col("score") < 0.3)))


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that recur; those of which nothing is left go."""
    clean = drop_recurring_lines(docs)
    left = (F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return clean.where(left).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links connect, any id before none; of rows with equal id and text one."""
    rows = with_row(docs)
    found = ngram_join(rows, id_col="row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    groups = materialise(found.groupBy("row", "component").agg(F.count("*").alias("rows")), "groups")
    linked = groups.join(groups.where("row <> component").select("component").distinct(), "component").select("row", "component")
    named = materialise(rows.select("row", "doc_id").join(linked, "row").distinct(), "linked")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    kept = with_row(without(rows, named.join(first, "component").where("row <> first.row")))
    repeated = materialise(groups.where("rows > 1").select("row"), "repeated")
    if repeated.isEmpty():
        return kept.select(COLUMNS)
    return kept.join(repeated, "row", "left_anti").unionByName(kept.join(repeated, "row", "left_semi").dropDuplicates(["row"])).select(COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    rows = with_row(docs)
    found = decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    return without(rows, found.where("contaminated").select(F.col("doc_id").alias("row")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", by_language),
    ("lines", without_recurring_lines),
    ("near_copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

# Language scores, tokens and packing can't be told in SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
