"""Completeness: what the navigation lists against what was parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.session import with_checkpoints


def reachable(edges: DataFrame, roots: DataFrame, *, within: int | None = None, max_rounds: int = 1000) -> DataFrame:
    """Nodes that edges (parent, child) lead to from roots (node), each with its root and depth.

    A breadth-first walk by joins: each round's new nodes are those not seen before, so cycles
    end. What a round finds is checkpointed in the session's shared folder, which cuts the plan; all
    found so far is written together every tenth round only. With ``within`` the question is which nodes are at most so
    many links away, and the walk ends there. A walk that isn't at its end after ``max_rounds`` is an error.
    """
    with_checkpoints(edges.sparkSession)
    own = edges.select("parent", "child").distinct().checkpoint()
    front = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct().checkpoint()
    seen = front
    for depth in range(1, max_rounds + 1):
        if within is not None and depth > within:
            return seen
        step = front.join(own, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node"), F.lit(depth).alias("depth")).distinct()
        front = step.join(seen, ["root", "node"], "left_anti").checkpoint()
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        seen = seen if depth % 10 else seen.checkpoint()
    raise ValueError(f"links go deeper than {max_rounds} rounds")


def compare(parsed: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """keys and state of every key of either side once: both, missing (listed only), extra (parsed only)."""
    a, b = (x.select(keys).distinct().withColumn(n, F.lit(True)) for x, n in ((parsed, "_parsed"), (listed, "_listed")))
    state = F.when(F.col("_parsed").isNull(), "missing").when(F.col("_listed").isNull(), "extra").otherwise("both")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))


def completeness(parsed: DataFrame, listed: DataFrame, keys: list[str], *, shown: int = 1000) -> DataFrame:
    """One row: sections_parsed, sections_listed, n_missing, n_extra, and the first ``shown`` missing and extra keys (the last of keys) in order.

    The lists are a report; ``compare`` gives all of them as rows.
    """
    found = compare(parsed, listed, keys)
    counts = found.agg(*[F.count_if(test).alias(name) for name, test in {
        "sections_parsed": F.col("state") != "missing", "sections_listed": F.col("state") != "extra", "n_missing": F.col("state") == "missing", "n_extra": F.col("state") == "extra",
    }.items()])
    first = lambda s: found.where(F.col("state") == s).select(F.col(keys[-1]).alias("k")).orderBy("k").limit(shown).agg(F.array_sort(F.collect_list("k")).alias(s))
    return counts.join(F.broadcast(first("missing"))).join(F.broadcast(first("extra")))


def require_complete(report: DataFrame) -> None:
    row = report.first()
    if row.missing or row.extra:
        raise ValueError(f"incomplete: missing {row.missing[:20]}, extra {row.extra[:20]}")


def matched_pages(toc: DataFrame, chapters: DataFrame) -> DataFrame:
    """Contents rows with the chapter page of the same guid; a page that is missing is an error."""
    joined = toc.join(chapters.select("guid", F.lit(True).alias("_found")), "guid", "left")
    return joined.where(F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no page for "), "guid")).cast("boolean")).otherwise(True)).drop("_found")
