"""Snapshots of a table with a tree of digests, so that two of them are compared without reading what they share."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

ROWS_A_PART = 1 << 20
_BITS = 8  # a part holds 256 buckets
SUMS = "part int, bucket int, n long, low long, high long"
_HALF = (1 << 32) - 1


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    """Rows by group, and the sums of both halves of their digests: copies count, order doesn't, nothing overflows below 2**31 rows."""
    low, high = F.col("digest").bitwiseAND(_HALF), F.shiftrightunsigned("digest", 32)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(low).alias("low"), F.sum(high).alias("high"))


def _marked(columns: list[str]) -> list:
    """The columns and whether they are null, as xxhash64 passes over nulls."""
    return [x for c in columns for x in (F.col(c), F.col(c).isNull())]


class Snapshot:
    """A stored snapshot (see ``write_snapshot``): ``rows`` with part, bucket and digest, and the ``sums`` of all buckets."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self.sums = spark.read.schema(SUMS).parquet(f"{self.path}/sums")
        head = json.loads(spark.read.text(f"{self.path}/head").first()[0])
        self.depth, self.key = head["depth"], head["key"]
        self.rows = spark.read.schema(StructType.fromJson(head["schema"])).parquet(f"{self.path}/rows")


def write_snapshot(rows: DataFrame, path: str, key: str, *, rows_a_part: int = ROWS_A_PART) -> Snapshot:
    """Write rows below ``path``, dealt to parts (folders) and buckets by the leading bits of their key's hash, with sums of digests by bucket.

    A part has about ``rows_a_part`` rows and 256 buckets. Parts are powers of two, so the buckets of a smaller
    snapshot are whole groups of those of a larger one. A part in which one key stands very often is written by
    as many tasks as it fills. Null keys are one key. The columns part, bucket and digest are replaced. The sums are
    written last: a snapshot without them isn't whole and can't be opened.
    """
    spark, rows = rows.sparkSession, rows.drop("part", "bucket", "digest")
    depth = max(0, -(-rows.count() // rows_a_part) - 1).bit_length()
    place = F.shiftrightunsigned(F.xxhash64(*_marked([key])), 64 - _BITS - depth)
    digests = rows.withColumns({"bucket": place.cast("int"), "digest": F.xxhash64(*_marked(rows.columns))})
    digests = digests.withColumn("part", F.shiftright("bucket", _BITS))
    # One row a part, a millionth of the rows.
    fills = digests.groupBy("part").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / (2 * rows_a_part))).alias("tasks"))
    dealt = digests.join(F.broadcast(fills), "part").repartition("part", F.pmod("digest", "tasks")).drop("tasks")
    dealt.sortWithinPartitions("part", "bucket").write.partitionBy("part").parquet(f"{path}/rows")
    schema = StructType([*rows.schema, StructField("bucket", IntegerType()), StructField("digest", LongType()), StructField("part", IntegerType())])
    head = json.dumps({"depth": depth, "key": key, "schema": schema.jsonValue()})
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/head")
    wrote = spark.read.schema("bucket int, digest long, part int").parquet(f"{path}/rows")
    _sums(wrote, "part", "bucket").write.parquet(f"{path}/sums")
    return Snapshot(spark, path)


def _coarse(df: DataFrame, by: int) -> DataFrame:
    return df.withColumn("bucket", F.shiftright("bucket", by))


def differing_buckets(old: Snapshot, new: Snapshot) -> DataFrame:
    """The buckets (of the smaller snapshot's tree) whose sums differ; only sums are read."""
    depth = min(old.depth, new.depth)

    def at(snapshot: Snapshot) -> DataFrame:
        coarse = _coarse(snapshot.sums, snapshot.depth - depth)
        return coarse.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", "low", "high")])

    both = at(old).alias("o").join(at(new).alias("n"), "bucket", "full_outer")
    same = F.lit(True)
    for c in ("n", "low", "high"):
        same &= F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    return both.where(~same).select("bucket")


def _held(snapshot: Snapshot, differing: DataFrame, depth: int) -> DataFrame:
    """The snapshot's rows in differing buckets. Folders without one aren't read: their numbers, one a million rows, are listed first."""
    by = snapshot.depth - depth
    own = _coarse(snapshot.sums, by).join(differing, "bucket", "left_semi").select("part").distinct()
    rows = snapshot.rows.where(F.col("part").isin([r.part for r in own.collect()]))
    return rows.withColumn("_of", F.shiftright("bucket", by)).join(differing.withColumnRenamed("bucket", "_of"), "_of", "left_semi").drop("_of")


def changes(old: Snapshot | None, new: Snapshot) -> DataFrame:
    """key, change: each key that was ``added``, ``removed``, or whose rows ``changed`` since old (None: all are added).

    The rows of a key are compared as a multiset of their digests, in any order. Buckets with equal sums are not read.
    Snapshots need the same key and columns.
    """
    if old is None:
        return new.rows.select(F.col(new.key).alias("key")).distinct().withColumn("change", F.lit("added"))
    if old.key != new.key or set(old.rows.columns) != set(new.rows.columns):
        # Digests are of all columns, in their order: nothing is known to be equal.
        raise ValueError("snapshots differ in key or columns")
    differing, depth = differing_buckets(old, new), min(old.depth, new.depth)
    two = [_sums(_held(s, differing, depth).withColumn("key", F.col(new.key)), "key") for s in (old, new)]
    o, n = two[0].alias("o"), two[1].alias("n")
    both = o.join(n, F.col("o.key").eqNullSafe(F.col("n.key")), "full_outer")
    same = (F.col("o.n") == F.col("n.n")) & (F.col("o.low") == F.col("n.low")) & (F.col("o.high") == F.col("n.high"))
    change = F.when(F.col("o.n").isNull(), "added").when(F.col("n.n").isNull(), "removed").when(~same, "changed")
    return both.select(F.coalesce("n.key", "o.key").alias("key"), change.alias("change")).where("change is not null")


def changed_rows(new: Snapshot, found: DataFrame) -> DataFrame:
    """The rows of new of all keys that were added or changed (``found`` of ``changes``); folders without one aren't read."""
    keys = found.where("change <> 'removed'").select("key")
    place = F.shiftrightunsigned(F.xxhash64(*_marked(["key"])), 64 - new.depth).cast("int") if new.depth else F.lit(0)
    parts = [r.part for r in keys.select(place.alias("part")).distinct().collect()]
    rows = new.rows.where(F.col("part").isin(parts))
    return rows.join(keys, F.col(new.key).eqNullSafe(F.col("key")), "left_semi").drop("part", "bucket", "digest")
