"""Validation of chunk rows against the index's fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.schemas import CHUNK_FIELDS

_KINDS = {name: kind for name, kind, _ in CHUNK_FIELDS}
_FILTERABLE = {name for name, _, flags in CHUNK_FIELDS if "F" in flags}


def _type_error(name: str, found: str) -> Column:
    """An error text if the value can't be taken as the field's type, else null."""
    value, kind = F.col(name), _KINDS[name]
    if kind == "string":
        bad = F.lit(found != "string")
    elif kind == "int":
        bad = value.try_cast("int").isNull() if found in ("tinyint", "smallint", "int", "bigint") else F.lit(True)
    elif kind == "timestamp":
        bad = F.try_to_timestamp(value).isNull() if found == "string" else F.lit(not found.startswith("timestamp"))
    else:
        bad = F.exists(value, lambda x: x.isNull()) if found == kind else F.lit(True)
    shown = F.concat(F.coalesce("id", F.lit("None")), F.lit(f": {name} is not {kind}"))
    return F.when(value.isNotNull() & bad, shown)


def validation_errors(chunks: DataFrame, *, key_size: int = 1024, content_bytes: int = 32_766, row_bytes: int = 16 << 20) -> DataFrame:
    """One row (id, error) for each fault: key, repeated key, unknown field, type, long content, large row.

    Rules on one row are columns. Repeats are counted over the ids alone, with partial sums in the
    tasks, so no chunk text is shuffled and many equal (or null) ids cost one row a task. Of n rows with one id, n - 1
    are errors.
    """
    key = F.coalesce("id", F.lit(""))
    errors = [F.when(~(key.rlike(r"^[A-Za-z0-9_\-=]+$") & (F.length(key) <= key_size)), F.concat(F.lit("bad key "), key))]
    for name, found in chunks.dtypes:
        errors.append(_type_error(name, found) if name in _KINDS else F.concat(key, F.lit(f": field {name} not in index")))
    if "content" in _FILTERABLE:
        errors.append(F.when(F.octet_length("content") > content_bytes, F.concat(key, F.lit(": content too long for a filterable field"))))
    errors.append(F.when(F.octet_length(F.to_json(F.struct("*"))) > row_bytes, F.concat(key, F.lit(": document exceeds 16 MB"))))
    own = chunks.select("id", F.explode(F.filter(F.array(*errors), lambda e: e.isNotNull())).alias("error"))
    repeats = chunks.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    again = repeats.select("id", F.explode(F.array_repeat(F.concat(F.lit("duplicate key "), key), (F.col("n") - 1).cast("int"))).alias("error"))
    return own.unionByName(again)


def check(chunks: DataFrame, shown: int = 50) -> None:
    """Raise with the first errors, if there are any."""
    found = [r.error for r in validation_errors(chunks).limit(shown).collect()]
    if found:
        raise ValueError("\n".join(found))
