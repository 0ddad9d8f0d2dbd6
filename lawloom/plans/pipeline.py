"""Whole runs: documents or pages to chunks, outputs and an index, as a library and a command."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.functions.text import index_key, part_label
from lawloom.functions.tokens import PatternTokenizer
from lawloom.operators.chunking import LIMIT, line_blocks, pack
from lawloom.operators.export import as_chunks, token_stats, write_outputs
from lawloom.operators.index import HashEmbedder, embed_chunks, push, upsert
from lawloom.operators.markup import page_blocks
from lawloom.operators.snapshots import Snapshot, changed_rows, changes, write_snapshot
from lawloom.operators.validate import check, validation_errors
from lawloom.operators.verify import completeness, require_complete
from lawloom.session import shared_path
from lawloom.streaming.refresh import IndexTable


@dataclass(frozen=True)
class Options:
    """name heads every chunk; limit is the tokens of a body; a vocabulary file replaces the default tokens."""

    name: str = "Corpus"
    limit: int = LIMIT
    tokenizer: object = PatternTokenizer()
    verify: bool = True


def session(name: str = "lawloom") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()


def document_chunks(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """Chunks of documents (doc_id, text, source), their lines as blocks."""
    rows = line_blocks(docs.select(F.col("doc_id").cast("string").alias("doc"), "text", "source"), id_col="doc").drop("text")
    return _chunks(rows, F.concat(F.lit("Document "), "doc"), F.col("source"), options)


def web_chunks(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """Chunks of web pages (page_id, url, html)."""
    found = page_blocks(pages)
    block = F.struct("kind", "text", "table_header", "table_rows")
    ordered = F.array_sort(F.collect_list(F.struct("block_ix", block.alias("block"))))
    docs = found.groupBy(F.col("id").alias("doc"), "title").agg(F.transform(ordered, lambda b: b["block"]).alias("blocks"))
    return _chunks(docs, F.col("title"), F.lit("web"), options)


def _chunks(rows: DataFrame, title, kind, options: Options) -> DataFrame:
    packed = pack(rows.select(F.col("doc"), title.alias("title"), kind.alias("kind_of"), "blocks"), limit=options.limit, tokenizer=options.tokenizer)
    content = F.concat(F.lit(f"{options.name}\n"), "title", part_label(F.col("chunk_index"), F.col("chunk_count")), F.lit("\n\n"), "body")
    return as_chunks(
        packed.withColumns(
            {
                "doc_id": index_key(F.concat(F.lit("ext-"), "doc")), "id": index_key(F.concat(F.lit("ext-"), "doc", F.lit("-"), F.col("chunk_index").cast("string"))),
                "source_type": F.col("kind_of"), "node_type": F.lit("document"), "citation": F.col("title"), "breadcrumb": F.col("title"),
                "content": content, "token_count": options.tokenizer.column(content), "municipality": F.lit(options.name),
            }
        )
    )


def run(docs: DataFrame, out: str, options: Options = Options()) -> DataFrame:
    """Chunks, checked and written with their documents and manifest; every document must give a chunk if verify is set."""
    chunks = document_chunks(docs, options)
    check(chunks)
    listed = docs.where(F.length(F.trim("text")) > 0).select(index_key(F.concat(F.lit("ext-"), F.col("doc_id").cast("string"))).alias("doc_id"), F.col("source").alias("source_type"))
    report = completeness(chunks, listed, ["doc_id"])
    if options.verify:
        require_complete(report)
    write_outputs(listed, chunks, out, report)
    return token_stats(chunks)


def push_index(chunks: DataFrame, index: DataFrame, cache: DataFrame, embedder: HashEmbedder | None = None) -> tuple[DataFrame, DataFrame]:
    """The index after a push, and the vectors to append to the cache; chunks with faults stop it before."""
    check(chunks)
    embedded, new = embed_chunks(chunks, cache, embedder or HashEmbedder())
    return push(index, embedded), new


def refresh_index(docs: DataFrame, table: IndexTable, options: Options = Options(), embedder: HashEmbedder | None = None) -> DataFrame:
    """A full refresh: chunks of all documents, checked and complete, merged into the index, and then owned rows that no document gave removed.

    Any fault stops the run before the index is touched. Vectors of known texts are reused; new ones are kept
    beside the index. Returns the index as written.
    """
    chunks = document_chunks(docs, options)
    listed = docs.where(F.length(F.trim("text")) > 0).select(index_key(F.concat(F.lit("ext-"), F.col("doc_id").cast("string"))).alias("doc_id"))
    if options.verify:
        require_complete(completeness(chunks, listed, ["doc_id"]))
    cache, index = IndexTable(table.spark, f"{table.path}-vectors"), table.read()
    known = cache.read_all()
    known = known if known is not None else table.spark.createDataFrame([], "h string, v array<float>")
    own = embedder or HashEmbedder()
    check(chunks)
    embedded, new = embed_chunks(chunks, known, own)
    cache.append(new, cache.next_version())
    table.write(embedded if index is None else push(index, embedded))
    return table.read()


def refresh_changed(docs: DataFrame, table: IndexTable, snapshots: str, options: Options = Options(), embedder: HashEmbedder | None = None, rows_a_part: int = 1 << 20) -> DataFrame:
    """A refresh that chunks only documents whose rows were added or changed since the last one, with the index of ``refresh_index``.

    Documents are kept as numbered snapshots below ``snapshots`` and compared by sums of digests (``changes``). Chunks
    of changed and removed documents leave the index, those of added and changed ones are checked, embedded and merged. A run
    that stops leaves its snapshot unnamed in the list of finished ones, so the next compares with the last finished one again.
    Returns the changes (key, change).
    """
    spark, done = table.spark, IndexTable(table.spark, f"{snapshots.rstrip('/')}/done")
    last, own = done.read(), embedder or HashEmbedder()
    path = shared_path(spark, "refresh", base=snapshots)
    new = write_snapshot(docs.select("doc_id", "text", "source"), path, "doc_id", rows_a_part=rows_a_part)
    changes(None if last is None else Snapshot(spark, last.first().path), new).write.parquet(f"{path}/changes")
    found = spark.read.parquet(f"{path}/changes")
    asked = changed_rows(new, found)
    document_chunks(asked, options).write.parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    key = index_key(F.concat(F.lit("ext-"), F.col("doc_id").cast("string"))).alias("doc_id")
    check(chunks)
    if options.verify:
        require_complete(completeness(chunks, asked.where(F.length(F.trim("text")) > 0).select(key), ["doc_id"]))
    cache, index = IndexTable(spark, f"{table.path}-vectors"), table.read()
    known = cache.read_all()
    known = known if known is not None else spark.createDataFrame([], "h string, v array<float>")
    embedded, vectors = embed_chunks(chunks, known, own)
    cache.append(vectors, cache.next_version())
    if index is None:
        table.write(embedded)
    elif not found.isEmpty():
        before = index.join(found.where("change <> 'added'").select(F.col("key").alias("doc_id")).select(key), "doc_id", "left_semi").select("id")
        gone = before.join(chunks.select("id"), "id", "left_anti")
        table.write(upsert(index, embedded).join(gone, "id", "left_anti"))
    done.write(spark.createDataFrame([(path,)], "path string"))
    return found


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lawloom", description="Chunk a table of documents and write chunks, documents and manifest.")
    parser.add_argument("documents", help="Parquet table with doc_id, text, source")
    parser.add_argument("--out", required=True)
    parser.add_argument("--name", default="Corpus")
    parser.add_argument("--limit", type=int, default=LIMIT)
    parser.add_argument("--no-verify", action="store_true")
    parser.add_argument("--check", action="store_true", help="only check the chunks and print their faults")
    parser.add_argument("--index", help="folder of an index to refresh as well; rows of documents that are gone are removed")
    parser.add_argument("--changed", help="folder of snapshots: with --index, chunk only what changed since the last run with this folder")
    parser.add_argument("--recreate", action="store_true", help="begin the index anew")
    given = parser.parse_args(argv)
    spark = session()
    options = Options(given.name, given.limit, verify=not given.no_verify)
    docs = spark.read.parquet(given.documents)
    if given.check:
        validation_errors(document_chunks(docs, options)).show(50, truncate=False)
        return
    if given.index:
        table = IndexTable(spark, given.index)
        if given.recreate:
            table.clear()
        if given.changed:
            refresh_changed(docs, table, given.changed, options).groupBy("change").count().show()
        else:
            refresh_index(docs, table, options)
    run(docs, given.out, options).show()


if __name__ == "__main__":
    main()
