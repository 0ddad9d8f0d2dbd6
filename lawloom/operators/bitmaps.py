"""Bitmaps of the rows that hold a value: filters and facets without reading rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITMAP = "field string, value string, bucket long, bits binary"


def build_bitmaps(rows: DataFrame, fields: list[str], *, place: str = "place") -> DataFrame:
    """field, value, bucket, bits: one bitmap of 32,768 rows for each value and range of places in which it stands.

    ``place`` numbers the rows from 0 without gaps (``paging.read_paged``). Arrays count by their items, other
    fields as strings; null values and null items stand in no bitmap. The field ``*`` has a bitmap of all rows. A
    frequent value is one group for each range of places, so no group holds more than 32,768 rows.
    """
    kinds = dict(rows.dtypes)

    def pairs(name: str) -> Column:
        items = F.array_distinct(F.col(name).cast("array<string>")) if kinds[name].startswith("array") else F.array(F.col(name).cast("string"))
        made = F.transform(items, lambda v: F.struct(F.lit(name).alias("field"), v.alias("value")))
        return F.coalesce(made, F.array().cast("array<struct<field:string,value:string>>"))

    every = F.array(F.struct(F.lit("*").alias("field"), F.lit("").alias("value")))
    number = F.col(place) + 1  # Spark's bitmaps count from 1
    held = rows.select(F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit"), F.explode(F.concat(every, *[pairs(f) for f in fields])).alias("x"))
    held = held.where("x.value is not null")
    return held.groupBy(F.col("x.field").alias("field"), F.col("x.value").alias("value"), "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def hits(bitmaps: DataFrame, filters: dict[str, list[str]]) -> DataFrame:
    """bucket, hit: the rows that hold one of the values of each field. No filter: all rows; a field without values: none."""
    asked = filters or {"*": [""]}
    either = reduce(lambda a, b: a | b, [(F.col("field") == f) & F.col("value").isin(values) for f, values in asked.items()])
    by_field = bitmaps.where(either).groupBy("bucket", "field").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = by_field.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("hit"), F.count("*").alias("fields"))
    return both.where(F.col("fields") == len(asked)).select("bucket", "hit")


def count_hits(bitmaps: DataFrame, filters: dict[str, list[str]]) -> DataFrame:
    """rows: how many rows hold one of the values of each field."""
    return hits(bitmaps, filters).agg(F.coalesce(F.sum(F.bitmap_count("hit")), F.lit(0)).alias("rows"))


def facet_hits(bitmaps: DataFrame, filters: dict[str, list[str]], fields: list[str]) -> DataFrame:
    """facet, value, rows: how many hits hold each value of ``fields``; values that none holds are left out.

    A value's bitmap meets that of the hits by bucket: what is joined is 4 KB for 32,768 rows, however many hits there are.
    """
    of = bitmaps.where(F.col("field").isin(fields)).join(hits(bitmaps, filters), "bucket")
    each = of.select("field", "value", "bucket", F.explode(F.array("bits", "hit")).alias("bits"))
    met = each.groupBy("field", "value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    counts = met.groupBy(F.col("field").alias("facet"), "value").agg(F.sum(F.bitmap_count("bits")).alias("rows"))
    return counts.where("rows > 0")
