"""Paged text: running lines, paragraphs, page labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawloom.functions.text import clean_picture_text, is_footer, line_key


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, line (its place in the page), text of pages (doc_id, page, text)."""
    return pages.select("doc_id", "page", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line", "text"))


def repeated_lines(pages: DataFrame, *, share: float = 0.5, longest: int = 60) -> DataFrame:
    """doc_id, line_key, n_pages of lines on more than ``share`` of a document's pages, if it has two or more.

    Lines that start with a pipe belong to tables and aren't counted. A page's keys are made distinct in
    place, so its lines aren't shuffled; counts are summed map-side over (document, line).
    """
    lines = F.filter(F.split("text", "\r\n|\r|\n"), lambda x: ~F.ltrim(x).startswith("|"))
    keys = F.array_distinct(F.filter(F.transform(lines, line_key), lambda k: (k != "") & (F.length(k) < longest)))
    by_line = pages.select("doc_id", F.explode(keys).alias("line_key")).groupBy("doc_id", "line_key").agg(F.count("*").alias("n_pages"))
    sizes = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    often = (F.col("pages") >= 2) & (F.col("n_pages") > F.col("pages") * share)
    return by_line.join(sizes, "doc_id").where(often).select("doc_id", "line_key", "n_pages")


def strip_repeated_lines(pages: DataFrame, **options: float) -> DataFrame:
    """pages without footers and repeated lines (those in tables too), picture marks and runs of empty lines.

    A document's repeated keys are few (each is on more than a share of its pages), so they are gathered
    once, and each page's lines are filtered in place.
    """
    keys = repeated_lines(pages, **options).groupBy("doc_id").agg(F.collect_list("line_key").alias("_often"))
    lines = F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n")
    often = F.coalesce("_often", F.array().cast("array<string>"))
    kept = F.filter(lines, lambda x: ~is_footer(x) & ~F.array_contains(often, line_key(x)))
    text = F.array_join(F.transform(kept, clean_picture_text), "\n")
    tight = F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return pages.select("doc_id", "page", "text").join(keys, "doc_id", "left").select("doc_id", "page", tight.alias("text"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by the order column."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_nth = 1").drop("_nth")
