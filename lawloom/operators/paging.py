"""A table kept in order of a key, so that any page of it is read without sorting or counting what comes before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS_A_PART = 1 << 20


def write_paged(rows: DataFrame, path: str, key: str, *, rows_a_part: int = ROWS_A_PART) -> None:
    """Write rows in order of ``key`` below ``path``: ranges of about ``rows_a_part`` rows, and how many rows stand before each.

    Rows are dealt by range once and sorted in their tasks. Their place among all others is that in their range
    (column ``at``) and the count of the ranges before, a small table of one row a range. Rows of one key are dealt
    by their other columns, so a frequent key fills several ranges; rows that are equal in everything share one.
    Null keys come first; columns named part or at are replaced; an empty table has no range and only empty pages.
    """
    spark, rows = rows.sparkSession, rows.drop("part", "at")
    parts = max(1, -(-rows.count() // rows_a_part))
    dealt = rows.repartitionByRange(parts, F.col(key), F.xxhash64(*rows.columns)).sortWithinPartitions(F.col(key), F.xxhash64(*rows.columns))
    # The lower 33 bits count the rows of a task from 0, in the order in which they are written.
    numbered = dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    numbered.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    counts = spark.read.schema(f"at long, {key} {dict(rows.dtypes)[key]}, part int").parquet(f"{path}/rows").groupBy("part").agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts.withColumn("start", before).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def read_paged(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """All rows of a paged table (``columns`` as a schema) and place, their number from 0 in order of the key."""
    rows = spark.read.schema(f"{columns}, at long, part int").parquet(f"{path}/rows")
    starts = spark.read.schema("part int, start long").parquet(f"{path}/ranges")
    # One row a range: a millionth of the rows, and 16 bytes each.
    return rows.join(F.broadcast(starts), "part").withColumn("place", F.col("start") + F.col("at")).drop("part", "at", "start")


def page(spark: SparkSession, path: str, columns: str, skip: int, size: int) -> DataFrame:
    """Rows ``skip`` to ``skip + size`` (not included) and their place, in order.

    The ranges that hold them are looked up first, at most one for each ``rows_a_part`` rows of the page and one
    more; only their folders are read, and in them only the page's rows leave the scan.
    """
    ranges = spark.read.schema("part int, n long, start long").parquet(f"{path}/ranges")
    held = ranges.where((F.col("start") < skip + size) & (F.col("start") + F.col("n") > skip)).select("part", "start").collect()
    rows = spark.read.schema(f"{columns}, at long, part int").parquet(f"{path}/rows")
    wanted, place = F.lit(False), F.lit(None).cast("long")
    for r in held:
        wanted |= (F.col("part") == r.part) & (F.col("at") >= skip - r.start) & (F.col("at") < skip + size - r.start)
        place = F.when(F.col("part") == r.part, F.col("at") + r.start).otherwise(place)
    found = rows.where(F.col("part").isin([r.part for r in held])).where(wanted)
    return found.withColumn("place", place).drop("part", "at").orderBy("place").limit(size)
