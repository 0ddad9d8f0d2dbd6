"""Chunk rows, Markdown, document rows and the manifest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.functions.text import citation_of, empty_to_null, file_name, file_stem, front_matter, index_key, page_label, part_label, section_citation, slug, url_quote, zero_padded
from lawloom.functions.tokens import PatternTokenizer
from lawloom.operators.chunking import LIMIT, pack, page_chunks
from lawloom.operators.pages import first_seen, strip_repeated_lines
from lawloom.schemas import CHUNK_FIELDS

# The index's name of each kind of source, and the header of its chunks.
SOURCE_TYPES = {"statute": "state_statute", "rule": "state_rule", "guidance": "state_guidance", "model_code": "model_code_ref"}
HEADERS = {"statute": "Revised Statutes", "rule": "Code of Rules", "guidance": "State guidance", "model_code": "Model code (reference only)"}
LEVELS = {"chapter": 1, "part": 2, "article": 2, "section": 3}


def mapped(key: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def as_chunks(rows: DataFrame) -> DataFrame:
    """All stored fields in order, null (or for arrays empty) where rows lack them; ids must not repeat."""
    out = []
    for name, kind, _ in CHUNK_FIELDS:
        value = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        out.append((F.coalesce(value, F.array().cast(kind)) if kind.startswith("array") else value).alias(name))
    return rows.select(out)


def code_chunks(nodes: DataFrame, *, name: str, base_url: str, through: str | None = None, limit: int = LIMIT, tokenizer: PatternTokenizer | None = None) -> DataFrame:
    """Chunks of section trees (rows of ``chapter_tree`` with chapter columns and division)."""
    tokens = tokenizer or PatternTokenizer()
    of = lambda kind: F.get(F.filter("ancestors", lambda a: a["kind"] == kind), 0)
    path = F.concat(F.transform("ancestors", lambda a: a["heading"]), F.array("heading"))
    chapter = F.coalesce(of("chapter"), F.struct("guid", "kind", "heading", "number"))
    section = F.col("kind") == "section"
    rows = nodes.where(F.size("blocks") > 0).select(
        index_key(F.concat(F.lit("code-"), chapter["number"])).alias("doc_id"), "guid", "kind", "blocks", "division",
        F.when(section, F.col("heading")).otherwise(F.concat("heading", F.lit(" (history and notes)"))).alias("title"),
        section_citation(F.col("kind"), F.col("heading"), F.col("number"), chapter["number"], of("article")["number"]).alias("citation"),
        chapter["number"].alias("chapter_number"), F.regexp_extract(chapter["heading"], r"^Chapter\s+\S+\.(?:\s+(.*))?$", 1).alias("chapter_title"),
        of("part")["heading"].alias("part"), of("article")["heading"].alias("article"),
        F.when(section, F.col("number")).alias("section_number"), F.when(section, F.col("nodes_title") if "nodes_title" in nodes.columns else F.col("title")).alias("section_title"),
        F.array_join(path, " > ").alias("breadcrumb"), empty_to_null(F.array_join("history", " ")).alias("history"), "ordinances",
    )
    packed = pack(rows, limit=limit, tokenizer=tokens)
    content = F.concat(F.lit(f"{name} Code\n"), "breadcrumb", part_label(F.col("chunk_index"), F.col("chunk_count")), F.lit("\n\n"), "body")
    return as_chunks(
        packed.withColumns(
            {
                "id": index_key(F.concat(F.lit("code-"), "guid", F.lit("-"), F.col("chunk_index").cast("string"))), "source_type": F.lit("code"), "node_type": F.col("kind"),
                "content": content, "token_count": tokens.column(content), "url": F.concat(F.lit(f"{base_url}/"), "guid"), "node_guid": F.col("guid"),
                "municipality": F.lit(name), "legislation_through": F.lit(through),
            }
        )
    )


def paged_chunks(pages: DataFrame, docs: DataFrame, *, limit: int = LIMIT, tokenizer: PatternTokenizer | None = None) -> DataFrame:
    """Chunks of paged documents. docs: doc_id, source_type, title, citation, url, header, node_type and any chunk fields."""
    tokens = tokenizer or PatternTokenizer()
    chunks = page_chunks(strip_repeated_lines(pages), limit=limit, tokenizer=tokens).join(docs, "doc_id")
    label = F.concat(F.lit(", "), page_label(F.col("page_start"), F.col("page_end")))
    content = F.concat("header", F.lit("\n"), "title", label, part_label(F.col("chunk_index"), F.col("chunk_count")), F.lit("\n\n"), "body")
    return as_chunks(chunks.withColumns({"id": index_key(F.concat("doc_id", F.lit("-"), F.col("chunk_index").cast("string"))), "content": content, "token_count": tokens.column(content), "breadcrumb": F.col("title")}))


def source_chunks(sources: DataFrame, *, municipality: str, limit: int = LIMIT, tokenizer: PatternTokenizer | None = None) -> DataFrame:
    """Chunks of registry documents with blocks: id, kind, title, url, citation, breadcrumb, blocks, and history if there is."""
    tokens = tokenizer or PatternTokenizer()
    packed = pack(sources, limit=limit, tokenizer=tokens)
    content = F.concat(mapped(F.col("kind"), HEADERS), F.lit("\n"), "breadcrumb", part_label(F.col("chunk_index"), F.col("chunk_count")), F.lit("\n\n"), "body")
    doc_id = index_key(F.concat(F.lit("ext-"), "id"))
    return as_chunks(
        packed.withColumns(
            {
                "doc_id": doc_id, "source_type": mapped(F.col("kind"), SOURCE_TYPES), "node_type": F.col("kind"), "citation": F.coalesce("citation", citation_of(F.col("title"))),
                "content": content, "token_count": tokens.column(content), "municipality": F.lit(municipality),
            }
        ).withColumn("id", index_key(F.concat("doc_id", F.lit("-"), F.col("chunk_index").cast("string"))))
    )


def attachment_docs(attachments: DataFrame, chapters: DataFrame, *, base_url: str) -> DataFrame:
    """Documents of attachments (ix, title, href, chapter_guid), the first of each href, with their chapter; orphans are an error."""
    firsts = first_seen(attachments, "href", "ix")
    joined = firsts.join(chapters.select(F.col("guid").alias("chapter_guid"), "chapter_number", "chapter_title"), "chapter_guid", "left")
    known = F.when(F.col("chapter_number").isNull(), F.raise_error(F.concat(F.lit("no chapter for "), "href"))).otherwise(F.col("chapter_number"))
    return joined.select(
        index_key(F.concat(F.lit("attachment-"), file_stem(F.col("href")))).alias("doc_id"), F.lit("attachment").alias("source_type"), "title",
        F.concat(F.lit(base_url), url_quote(F.col("href"))).alias("url"), file_name(F.col("href")).alias("file"), known.alias("chapter_number"), "chapter_title",
    )


def law_docs(rows: DataFrame) -> DataFrame:
    """Documents of new laws (id, title, subject, adopted, type, href)."""
    title = F.coalesce(empty_to_null(F.col("title")), F.col("id"))
    adopted = F.coalesce(F.try_to_date("adopted", "yyyy-MM-dd"), F.try_to_date("adopted", "M/d/yyyy"), F.try_to_date("adopted", "MM-dd-yyyy"))
    return rows.select(
        index_key(F.concat(F.lit("newlaw-"), "id")).alias("doc_id"), F.lit("new_law").alias("source_type"), title.alias("title"), F.coalesce(empty_to_null(F.col("subject")), title).alias("citation"),
        F.col("href").alias("url"), adopted.cast("timestamp").alias("adopted_date"), F.concat_ws(" ", F.lit("Adopted"), empty_to_null(F.col("adopted")), F.lit("-"), empty_to_null(F.col("subject"))).alias("history"), F.array(title).alias("ordinances"),
    )


def node_markdown(nodes: DataFrame) -> DataFrame:
    """doc_id, path, markdown of each chapter; headings below a part stand one level deeper."""
    under_part = F.exists("ancestors", lambda a: a["kind"] == "part") & F.col("kind").isin("article", "section")
    level = mapped(F.col("kind"), LEVELS) + under_part.cast("int")
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n")
    one = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "heading", F.lit("\n"), F.when(F.size("blocks") > 0, F.concat(F.lit("\n"), text, F.lit("\n"))).otherwise(""))
    first = F.min_by(F.struct("heading", "number", "title"), "node_ix").alias("chapter")
    docs = nodes.groupBy("doc_id").agg(first, F.array_sort(F.collect_list(F.struct("node_ix", one.alias("md")))).alias("parts"))
    meta = front_matter([("title", F.col("chapter.heading"), "string"), ("source_type", F.lit("code_chapter"), "string"), ("chapter_number", F.col("chapter.number"), "string"), ("chapter_title", F.col("chapter.title"), "string")])
    path = F.concat(F.lit("markdown/code/"), slug(zero_padded(F.col("chapter.number"))), F.lit("-"), slug(F.col("chapter.title")), F.lit(".md"))
    return docs.select("doc_id", path.alias("path"), F.concat(meta, F.array_join(F.transform("parts", lambda p: p["md"]), "\n")).alias("markdown"))


def write_markdown(docs: DataFrame, root: str) -> DataFrame:
    """Write one file for each row of (path, markdown) below root, in tasks; gives path and bytes of what was written.

    A file is written as a whole under its own path, so a task that runs twice writes the same. root is
    any path that Arrow's file systems know.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = pafs.FileSystem.from_uri(root if ":" in root else f"file://{root}")
        for batch in batches:
            sizes = []
            for path, text in zip(batch["path"], batch["markdown"], strict=True):
                name, data = f"{base}/{path}", text.encode()
                system.create_dir(name.rpartition("/")[0], recursive=True)
                with system.open_output_stream(name) as file:
                    file.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"path": batch["path"], "bytes": sizes})

    return docs.select("path", "markdown").mapInPandas(run, "path string, bytes long")


def document_markdown(docs: DataFrame) -> DataFrame:
    """doc_id, path, markdown of documents (doc_id, source_type, title, url, text) other than chapters."""
    meta = front_matter([(c, F.col(c), "string") for c in ("title", "source_type", "url")])
    path = F.concat(F.lit("markdown/"), slug(F.col("source_type")), F.lit("/"), "doc_id", F.lit(".md"))
    return docs.select("doc_id", path.alias("path"), F.concat(meta, F.lit("# "), "title", F.lit("\n\n"), "text", F.lit("\n")).alias("markdown"))


def document_rows(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """docs with the number of their chunks and the sum of their tokens."""
    sums = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.sum("token_count").alias("token_count"))
    return docs.join(sums, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("chunk_count", "token_count")})


def token_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, tokens_min, tokens_mean (half to even), tokens_max, tokens_total; null figures if there are none."""
    return chunks.agg(
        F.count("*").alias("chunks"), F.min("token_count").alias("tokens_min"), F.bround(F.avg("token_count")).cast("long").alias("tokens_mean"),
        F.max("token_count").alias("tokens_max"), F.sum("token_count").alias("tokens_total"),
    )


def duplicate_ids(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1")


def manifest(docs: DataFrame, chunks: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """One row of JSON: documents by type, sections, chunk figures, and the completeness check if given."""
    if not duplicate_ids(chunks).isEmpty():
        raise ValueError("chunk ids repeat")
    types = docs.groupBy("source_type").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_type", "count")))).alias("documents"))
    sections = chunks.agg(F.countDistinct(F.when(F.col("node_type") == "section", F.col("node_guid"))).alias("sections"))
    parts = [types, sections, token_stats(chunks), *([checked] if checked is not None else [])]
    row = {k: v for part in parts for k, v in part.first().asDict().items()}  # a single row of figures each
    return docs.sparkSession.createDataFrame([(_json(row),)], "manifest string")


def _json(row: dict) -> str:
    import json

    return json.dumps(row, ensure_ascii=False, default=str)


def write_outputs(docs: DataFrame, chunks: DataFrame, path: str, checked: DataFrame | None = None) -> None:
    """chunks and documents as JSON lines with nulls and sorted columns (and chunks as Parquet), and the manifest."""
    manifest(docs, chunks, checked).write.mode("overwrite").text(f"{path}/manifest")
    chunks.write.mode("overwrite").parquet(f"{path}/chunks.parquet")
    chunks.select(sorted(chunks.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/chunks")
    document_rows(docs, chunks).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/documents")
