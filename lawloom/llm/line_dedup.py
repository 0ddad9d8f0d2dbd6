"""Line deduplication with a log-template tree of fixed depth."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, free_name, hot_join, materialise, spread_join
from .words import mix

_FIELD = re.compile(rb"[0-9@]")  # a token with a digit or an at sign is a variable field
_FIELD_MARK = b"<*>"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LINE = "row long, doc long, line int, leaf long, hash long"
KIND = "leaf long, hash long, first long, n int, tokens string, branches array<long>"


def tokens_of(lowered: bytes) -> list[bytes]:
    """Tokens between ASCII white space, variable fields as <*>; a line of variable fields only has none."""
    tokens = lowered.split()
    if _FIELD.search(lowered):
        tokens = [_FIELD_MARK if _FIELD.search(t) else t for t in tokens]
        if tokens.count(_FIELD_MARK) == len(tokens):
            return []
    return tokens


def leaf_of(tokens: list[bytes], depth: int) -> int:
    """The tree's leaf: the number of tokens, then the leading ``depth`` tokens."""
    return xxhash.xxh64_intdigest(b" ".join(tokens[:depth]), seed=len(tokens)) - (1 << 63)


def hash_of(tokens: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(tokens)) - (1 << 63)


def spare(n: int, similarity: float) -> int:
    """In so many tokens at most two lines of n tokens differ that agree enough."""
    return n - math.ceil(similarity * n - 1e-9)


def segments_of(n: int, depth: int, similarity: float) -> list[tuple[int, int]]:
    """Bounds of runs of the tokens after the first ``depth``: lines of one leaf that agree enough have an equal run.

    There is one run more than such lines may have differences, so one holds none. With too few
    tokens for that, one empty run holds all lines.
    """
    runs = spare(n, similarity) + 1
    if n - depth < runs:
        return [(n, n)]
    edges = [depth + (n - depth) * k // runs for k in range(runs + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def branches_of(leaf: int, tokens: list[bytes], depth: int, similarity: float) -> list[int]:
    """The leaf's branches on which a line stands: one for each run of its tokens, and one for all tokens but each run."""
    bounds = np.array(segments_of(len(tokens), depth, similarity))
    each = np.fromiter((xxhash.xxh64_intdigest(t, seed=k) for k, t in enumerate(tokens)), np.uint64, len(tokens))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each)))
        runs = sums[bounds[:, 1]] - sums[bounds[:, 0]]
        place = mix(np.arange(1, 2 * len(bounds) + 1, dtype=np.uint64) + np.uint64(leaf + (1 << 63)))
        return mix(np.concatenate((runs, sums[-1] - runs)) ^ place).view(np.int64).tolist()


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """One row a line: the line's leaf and the hash of its tokens, without its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, doc, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for at, line in enumerate(text.translate(_LOWER).split(b"\n") if text else ()):
                    if tokens := tokens_of(line):
                        rows.append((row, doc, at, leaf_of(tokens, depth), hash_of(tokens)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in LINE.split(", ")]
    return docs.mapInArrow(run, LINE)


def _kinds(docs: DataFrame, depth: int, similarity: float) -> DataFrame:
    """Tokens and branches of the kinds of line that are asked for, from documents (text, wanted: hash and first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left = {w["hash"]: w["first"] for w in wanted}
                for line in text.translate(_LOWER).split(b"\n"):
                    tokens = tokens_of(line)
                    first = left.pop(hash_of(tokens), None) if tokens else None
                    if first is not None:
                        leaf = leaf_of(tokens, depth)
                        rows.append((leaf, hash_of(tokens), first, len(tokens), b" ".join(tokens).decode("utf-8", "replace"), branches_of(leaf, tokens, depth, similarity)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64())]
    names = [x.split()[0] for x in KIND.split(", ")]
    return docs.mapInArrow(run, KIND)


def _met(members: DataFrame) -> DataFrame:
    """The rows of members that have an earlier line on their branch, with the branch's first line and number of lines."""
    # One row a task and branch is shuffled, however many lines stand on it.
    leads = members.groupBy("branch").agg(F.min(F.struct("first", "hash")).alias("lead"), F.count("*").alias("lines"))
    leads = leads.where("lines > 1").select("branch", F.col("lead.hash").alias("lead"), F.col("lead.first").alias("lead_first"), "lines")
    return hot_join(members, leads, ["branch"], "hash", "lines").where("lead_first < first")


def _agreeing(pairs: DataFrame, kinds: DataFrame, similarity: float) -> DataFrame:
    """leaf, hash of the lines that agree enough with a ``lead`` of theirs; pairs meet once, token by token."""
    pairs = materialise(pairs.select("leaf", "hash", "lead").distinct(), "pairs")
    one = kinds.select("leaf", "hash", "n", "tokens")
    # Tokens are sent for lines that are asked for only; those of a lead once for each task that its pairs are dealt to.
    leads = pairs.groupBy("leaf", "lead").agg(F.count("*").alias("met"))
    two = leads.join(kinds.select("leaf", F.col("hash").alias("lead"), F.col("tokens").alias("lead_tokens")), ["leaf", "lead"])
    both = hot_join(pairs.join(one, ["leaf", "hash"]), two, ["leaf", "lead"], "hash", "met")
    equal = F.size(F.filter(F.zip_with(F.split("tokens", " "), F.split("lead_tokens", " "), lambda a, b: a == b), lambda same: same))
    return materialise(both.where(equal >= F.ceil(F.col("n") * similarity - 1e-9)).select("leaf", "hash").distinct(), "agreeing")


def _like_earlier(kinds: DataFrame, similarity: float, few: int) -> DataFrame:
    """leaf, hash of all kinds of line that agree enough with one that stands in an earlier document."""
    on = kinds.select("leaf", "hash", "first", F.size("branches").alias("n"), F.posexplode("branches").alias("at", "branch"))
    found = _agreeing(_met(on), kinds, similarity)
    # What is equal but for one run need not be looked at again: lines that agree enough have an equal run.
    runs = on.where("2 * at < n")
    slices = F.ceil(F.col("lines") / few).cast("int").alias("slices")
    seekers = materialise(_met(runs).join(found, ["leaf", "hash"], "left_anti").select("branch", "leaf", "hash", "first", "lines", slices), "seekers")
    sought = seekers.groupBy("branch").agg(F.max("first").alias("until"), F.first("slices").alias("slices"), F.first("lines").alias("lines"))
    earlier = hot_join(runs, sought, ["branch"], "hash", "lines").where("first < until")
    earlier = materialise(earlier.select("branch", F.col("hash").alias("lead"), F.col("first").alias("lead_first"), F.pmod(F.xxhash64("hash"), "slices").cast("int").alias("slice")), "earlier")
    at, step = 0, 1
    while not seekers.isEmpty():
        # Slices of about ``few`` earlier lines of a template, twice as many each time; who has found a line seeks no more.
        asked = seekers.withColumn("slice", F.explode(F.sequence(F.lit(at), F.least(F.lit(at + step), "slices") - 1)))
        pairs = spread_join(asked, earlier.where(F.col("slice").between(at, at + step - 1)), ["branch", "slice"], "hash").where("lead_first < first")
        found = materialise(found.unionByName(_agreeing(pairs, kinds, similarity)).distinct(), "like_earlier")
        at, step = at + step, 2 * step
        seekers = materialise(seekers.where(F.col("slices") > at).join(found, ["leaf", "hash"], "left_anti"), "seekers")
    return found


def recurring_lines(docs: DataFrame, *, depth: int = 3, similarity: float = 0.8, few: int = 64) -> DataFrame:
    """row, dropped (set of line numbers) of the documents (row, doc, text) that lose lines. See ``drop_recurring_lines``."""
    lines = materialise(_lines(docs, depth), "lines")
    kinds = materialise(
        lines.groupBy("leaf", "hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.min("row").alias("row"), F.count("*").alias("lines")), "kinds"
    )
    # Only leaves with several kinds of line, of several documents, can hold one template of two kinds.
    several = kinds.groupBy("leaf").agg(F.count("*").alias("kinds"), F.min("first").alias("low"), F.max("last").alias("high"))
    asked = hot_join(kinds, several.where("kinds > 1 and low <> high").select("leaf", "kinds"), ["leaf"], "hash", "kinds")
    wanted = materialise(asked.groupBy("row").agg(F.collect_list(F.struct("hash", "first")).alias("wanted")), "wanted")
    found = _kinds(docs.join(wanted.hint("shuffle_hash"), "row").select("text", "wanted"), depth, similarity)
    found = materialise(found.dropDuplicates(["leaf", "hash"]), "found")
    like = _like_earlier(found, similarity, few).withColumn("like", F.lit(True))
    kept = kinds.select("leaf", "hash", "first", "last", "lines").join(like, ["leaf", "hash"], "left")
    # A kind of line in one document only, that no earlier one is like, loses nothing.
    kept = kept.where("first <> last or like").select("leaf", "hash", "first", "lines", F.coalesce("like", F.lit(False)).alias("like"))
    dropped = hot_join(lines.select("row", "doc", "line", "leaf", "hash"), kept, ["leaf", "hash"], "row", "lines").where("like or doc <> first")
    return dropped.groupBy("row").agg(F.collect_set("line").alias("dropped"))


def drop_recurring_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """docs with recurring lines taken out of the text, and n_lines, n_dropped.

    A tree of fixed depth sorts lines by token count and ``depth`` leading tokens (fields with a
    digit or an at sign are variable), then by branches, which are templates: each run of the tokens that follow is
    fixed and the rest variable (and the other way round). There are so many runs that two lines which agree in at least
    ``similarity`` of all tokens have one in common. Each line is compared, token by token, with the first line of its
    templates. Lines that it isn't like go on: they are compared with slices of about ``few`` earlier lines of each of their
    templates, twice as many slices each time, until they have found a line that is like them or none is left. So a
    line goes from a document exactly if it, or a line that agrees with it in ``similarity`` of all tokens and has its
    count and leading tokens, stands in an earlier document. A line that no earlier one is like is compared with all
    that share a run of its tokens at its place: the work grows with the square of the number of such lines.

    This is the same at every size, and no step gathers a leaf or a branch: equal lines are one
    row, a branch is reduced map-side to its first line, a task never holds a branch, and joins on
    hot leaves, branches, templates and lines are spread over several tasks (``hot_join``). Lines are read as hashes first; tokens are
    fetched only for leaves in which several kinds of line stand.

    Cases: null and empty texts stay as they are, with 0 lines; blank lines and lines of variable fields
    only always stay; rows with equal ids, and rows with null ids, count as one document, null as
    the smallest; rows with equal id and text get the same verdict; all other columns
    pass through (columns named n_lines or n_dropped are replaced); an empty table gives no rows.
    """
    spark = docs.sparkSession
    batches_of(spark, 500)
    # xxhash64 passes over nulls, so they are marked.
    row = F.xxhash64(*[x for c in (id_col, text_col) for x in (F.col(c), F.col(c).isNull())])
    rows = docs.select(row.alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    key, lost = free_name(docs, "row_key"), free_name(docs, "dropped_lines")
    found = materialise(recurring_lines(rows, **options).select(F.col("row").alias(key), F.col("dropped").alias(lost)), "dropped")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    clean = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda at: F.get(lines, at)), "\n"))
    n_lines = F.when(F.length(text_col) > 0, F.size(lines)).otherwise(0).cast("long")
    joined = docs.select(*columns, row.alias(key)).join(found.hint("shuffle_hash"), key, "left")
    return joined.select(
        *[clean.alias(c) if c == text_col else F.col(c) for c in columns], n_lines.alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_dropped")
    )
