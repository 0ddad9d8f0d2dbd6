"""Exact deduplication by a heavy-hitter split, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, materialise


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")


def exact_dedup(docs: DataFrame, *, support: float = 0.0005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms have the same SHA-256. The rows
    (id, digest) are written once. A Misra-Gries summary (``freqItems``, at most
    1/support counters) proposes the digests that may hold over ``support`` of all
    rows; their exact counts and smallest ids are then taken with map-side partial
    sums, and those that really reach the bound are the winners: at most 1/support
    rows, which is the proven bound of the broadcast. Rows with a winner's digest
    are resolved map-side and never shuffled. All other digests, each with less than
    ``support`` of the rows, use an ordinary shuffle by digest.

    Cases: null text counts as empty; rows with an equal id share one verdict; a null
    id never wins over another id; of a group with null ids only, every row is kept;
    an empty table gives no rows; columns other than the id and the text are not read.
    """
    digest = materialise(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256")),
        "digests",
    )
    least = support * digest.count()
    proposed = digest.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    stats = (F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = materialise(
        digest.join(F.broadcast(proposed), "text_sha256", "left_semi").groupBy("text_sha256").agg(*stats).where(F.col("group_size") >= least),
        "winners",
    )
    hot = digest.join(F.broadcast(winners), "text_sha256")
    own = Window.partitionBy("text_sha256")
    cold = digest.join(F.broadcast(winners), "text_sha256", "left_anti").withColumns(
        {"keep_id": F.min("doc_id").over(own), "group_size": F.count("*").over(own)}
    )
    return hot.unionByName(cold).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
