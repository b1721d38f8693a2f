"""Frequency sketches and dense ids of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hash(row: Column, item: Column) -> Column:
    """48 bits of an MD5 digest of the row and the item."""
    return F.conv(F.substring(F.md5(F.concat(row.cast("string"), F.lit(":"), item.cast("string"))), 1, 12), 16, 10).cast("long")


def _cells(df: DataFrame, item: Column, depth: int, width: int) -> DataFrame:
    each = df.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(depth - 1).cast("long")))).withColumn("__h", _hash(F.col("row"), item))
    bucket = F.call_function("div", F.col("__h"), F.lit(2).cast("long")) % width
    return each.withColumn("bucket", bucket).withColumn("sign", 1 - 2 * (F.col("__h") % 2)).drop("__h")


def count_sketch(df: DataFrame, item: Column, depth: int, width: int) -> DataFrame:
    """(row, bucket, total): signed counts. Items are counted first, so a frequent one is hashed once a task."""
    counted = df.groupBy(item.alias("__i")).agg(F.count("*").alias("__n")).where("__i IS NOT NULL")
    return _cells(counted, F.col("__i"), depth, width).groupBy("row", "bucket").agg(F.sum(F.col("sign") * F.col("__n")).alias("total"))


def estimates(sketch: DataFrame, items: DataFrame, depth: int, width: int) -> DataFrame:
    """(item, estimate): the median over the rows of an item's signed counter. The sketch has depth * width rows."""
    asked = _cells(items, F.col("item"), depth, width).join(F.broadcast(sketch), ["row", "bucket"], "left")
    return asked.groupBy("item").agg(F.median(F.coalesce("total", F.lit(0)) * F.col("sign")).cast("long").alias("estimate"))


def interned(words: DataFrame, word: str) -> DataFrame:
    """(word, id): dense ids from 0 in the order of the words.

    Words are dealt to ranges by their first bytes; a range's words are ranked alone and follow those of the ranges before.
    """
    lead = F.substring(F.hex(F.col(word).cast("binary")), 1, 4)
    each = words.select(word, lead.alias("__b")).distinct()
    sizes = each.groupBy("__b").agg(F.count("*").alias("__n"))  # 65,536 ranges and their beginnings at most
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("__b").orderBy(word)) - 1
    return each.withColumn("__p", place).join(sizes.withColumn("__s", before), "__b").select(word, (F.col("__p") + F.col("__s")).alias("id"))
