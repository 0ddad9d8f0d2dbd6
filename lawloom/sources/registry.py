"""The registry of sources: one row for each document to ingest."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.functions.text import paragraphs, stub_text

SCHEMA = (
    "id string, title string, url string, kind string, tier string, citation string, sections array<string>, url_pattern string, "
    "file string, note string, summary string, was string"
)


def read_registry(spark: SparkSession, text: str) -> DataFrame:
    """Rows of a TOML text with [[source]] tables; a registry is small, so it is parsed by the driver."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(s.get(n) for n in names) for s in tomllib.loads(text).get("source", [])], SCHEMA)


def expand(registry: DataFrame) -> DataFrame:
    """Rows to ingest: skipped ones go; one with sections becomes a row for each, with its own id, url and citation."""
    rows = registry.where(F.col("tier") != "skip").withColumn("section", F.explode_outer("sections"))
    own = F.col("section").isNotNull()
    stem = F.regexp_replace("id", "-[^-]*$", "")
    cited = F.concat(F.substring_index("title", " §§", 1), F.lit(" § "), "section")
    return rows.withColumns(
        {
            "id": F.when(own, F.concat(stem, F.lit("-"), F.lower("section"))).otherwise(F.col("id")),
            "url": F.when(own, F.replace("url_pattern", F.lit("{section}"), F.col("section"))).otherwise(F.col("url")),
            "citation": F.when(own, cited).otherwise(F.col("citation")),
            "title": F.when(~own, F.col("title")),
        }
    ).drop("sections", "url_pattern")


def adapter(tier: Column, file: Column, url: Column, kind: Column) -> Column:
    """Which reader a row needs; the order matters, as a statute may be a PDF."""
    path = F.lower(F.coalesce(file, url))
    return (
        F.when(tier == "reference", "stub")
        .when(F.coalesce(file, F.lit("")).endswith(".md"), "markdown")
        .when(path.endswith(".pdf"), "pdf")
        .when(F.lower(url).endswith(".docx"), "docx")
        .when(kind == "statute", "statute")
        .otherwise("web")
    )


def route(rows: DataFrame) -> DataFrame:
    """Registry rows (expanded, with what was fetched in ``text`` or ``data``) with ``title`` and ``blocks``, each from its own reader.

    Rows are split by ``adapter``: a stub is made of its summary, Markdown of its paragraphs, statute and web pages of
    their HTML, Word files of their paragraphs; each parser sees its own rows only. Pages of a PDF are not blocks but pages
    (``pdf_pages``, ``page_chunks``) and give no row here.
    """
    from lawloom.operators import markup

    own = rows.withColumn("adapter", adapter(F.col("tier"), F.col("file"), F.col("url"), F.col("kind")))
    block = "array<struct<kind:string,text:string,table_header:string,table_rows:array<string>>>"
    line = lambda x: F.struct(F.lit("para").alias("kind"), x.alias("text"), F.lit(None).cast("string").alias("table_header"), F.lit(None).cast("array<string>").alias("table_rows"))
    of = lambda name: own.where(F.col("adapter") == name)
    stub = of("stub").withColumn("blocks", F.transform(F.array(stub_text(F.col("summary"), F.col("title"), F.col("url"))), line))
    plain = of("markdown").withColumn("blocks", F.transform(paragraphs(F.col("text"), bullets=True), line))

    def read(name: str, column: str, parser: Callable[[object], tuple[str | None, list[dict]]]) -> DataFrame:
        @F.pandas_udf(f"struct<page_title:string,blocks:{block}>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [(None, []) if x is None else parser(x) for x in batch]
                yield pd.DataFrame({"page_title": [t for t, _ in found], "blocks": [b for _, b in found]})

        return of(name).withColumn("_read", run(F.col(column))).withColumns({"title": F.coalesce("title", "_read.page_title"), "blocks": F.col("_read.blocks")}).drop("_read")

    def law(html: str) -> tuple[str, list[dict]]:
        page = markup.statute(html)
        return page["heading"], page["blocks"]

    parts = [stub, plain, read("web", "text", markup.web_page), read("statute", "text", law), read("docx", "data", lambda data: (None, markup.word_file(data)))]
    return reduce(DataFrame.unionByName, parts)


def require_chunks(docs: DataFrame, chunks: DataFrame) -> None:
    """Every document must have given a chunk."""
    bare = docs.select("doc_id").join(chunks.select("doc_id"), "doc_id", "left_anti").limit(20).collect()
    if bare:
        raise ValueError(f"no text extracted from {[r.doc_id for r in bare]}")
