"""Whole-number vectors: from a column of arrays to matrices of a task, and bounded blocks of queries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

# An id that is null comes last among ties. Tasks carry it as this number.
NO_ID = np.iinfo(np.int64).max
TILE = 4096


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int, **more: Column) -> DataFrame:
    """Columns id, v (floor(scale * x) of each component x) and more, for rows whose vector is free of nulls and non-finite numbers.

    A null vector takes no part; an empty one does. All other columns of df are left behind, whatever their names.
    """
    finite = F.forall(vec_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    v = F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))
    return df.where(finite).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), *[c.alias(n) for n, c in more.items()])


def dimensions(vectors: DataFrame) -> int:
    """The length of the longest vector; shorter ones count as filled up with zeros."""
    return vectors.agg(F.max(F.size("v"))).first()[0] or 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The lists of a column as rows of whole numbers, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(-1, dims).astype(np.int64)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def id_column(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NO_ID)


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """A type in which inner products of rows of a and b are exact: doubles, which BLAS multiplies fast, or else 64-bit integers."""
    largest = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if largest >= 2**63:
        raise OverflowError("inner products do not fit in 64 bits")
    return np.float64 if largest < 2**52 else np.int64


def tiles(batches: Iterator[pa.RecordBatch], rows: int = TILE) -> Iterator[pa.Table]:
    """Batches joined and cut into tables of at most ``rows`` rows, so that memory doesn't depend on the size of batches."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            whole = pa.Table.from_batches(held)
            full = n - n % rows
            yield from (whole.slice(k, rows) for k in range(0, full, rows))
            held, n = whole.slice(full).to_batches(), n - full
    if n:
        yield pa.Table.from_batches(held)


def best(group: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int, *more: np.ndarray) -> list[np.ndarray]:
    """Of each group the k highest scores, ties to the smaller ``tie``, in that order; more columns go along."""
    order = np.lexsort((tie, -score, group))
    group = group[order]
    keep = np.arange(len(group)) - np.searchsorted(group, group) < k
    return [group[keep], *(c[order][keep] for c in (score, tie, *more))]


def query_blocks(queries: DataFrame, rows: int) -> Iterator[pa.Table]:
    """The queries in blocks of about ``rows``, each small enough to be broadcast; the number of blocks grows with the queries.

    Rows get a number of their own first (column number), as ids may repeat; its hash deals them out.
    """
    numbered = materialise(queries.withColumn("number", F.monotonically_increasing_id()), "queries")
    blocks = math.ceil(numbered.count() / rows)
    for b in range(blocks):
        found = numbered.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).toArrow()
        if found.num_rows:
            yield found
