"""Reductions, histograms, segments, gather and scatter, compaction, sorting, order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvexa.functions import u32

from .scan import BLOCK, prefix_scan


def wrapping_sum(value: Column) -> Column:
    """Sum modulo 2**32: halves are summed apart, so a 64-bit sum holds 2**31 rows at least of each half."""
    high, low = F.sum(F.shiftright(value, 16)), F.sum(value.bitwiseAND(F.lit(65535)))
    return u32.wrap(F.shiftleft(u32.wrap(high).bitwiseAND(F.lit(65535)), 16) + low)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, count) of every bin from 0 on; values outside are dropped. The dense side is ``bins`` rows."""
    counts = df.where(F.col(value).between(0, bins - 1)).groupBy(F.col(value).cast("long").alias("bin")).agg(F.count("*").alias("count"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def range_counts(counts: DataFrame, ranges: DataFrame) -> DataFrame:
    """(first, last, total) of half-open ranges of bins: differences of running sums, so no range join."""
    sums = prefix_scan(counts, "bin", "count", inclusive=False, into="below")
    top = counts.agg(F.max("bin").alias("bin"), F.sum("count").alias("below")).select((F.col("bin") + 1).alias("bin"), "below")
    sums = sums.select("bin", "below").unionByName(top)
    ends = ranges.crossJoin(F.broadcast(top.select(F.col("bin").alias("top"))))  # one row
    ends = ends.select("first", "last", F.least("first", "top").alias("a"), F.least(F.greatest("first", "last"), "top").alias("z"))
    out = ends.join(sums.select(F.col("bin").alias("a"), F.col("below").alias("x")), "a").join(sums.select(F.col("bin").alias("z"), F.col("below").alias("y")), "z")
    return out.select("first", "last", (F.col("y") - F.col("x")).alias("total"))


def segment_ids(values: DataFrame, offsets: DataFrame, position: str = "pos") -> DataFrame:
    """values with ``segment``: the last segment that starts at or before the position; offsets(segment, start).

    Starts and values are scanned together by a running maximum, which takes the place of a range join. Empty
    segments share their start with the next one and get no rows.
    """
    marks = offsets.select(F.col("start").alias(position), F.col("segment").alias("__s"))
    both = values.withColumn("__s", F.lit(None).cast("long")).unionByName(marks, allowMissingColumns=True).withColumn("__v", F.col("__s").isNull())
    return prefix_scan(both, position, "__s", kind="max", into="segment").where("__v").drop("__s", "__v")


def gather(source: DataFrame, indices: DataFrame) -> DataFrame:
    """(i, v): source(pos, v) at indices(i, at); indices beyond the source give no row."""
    return indices.join(source.withColumnRenamed("pos", "at"), "at").select("i", "v")


def scatter(source: DataFrame, indices: DataFrame) -> DataFrame:
    """(at, v): source(pos, v) written to indices(pos, at); of several writers the last position stays."""
    return indices.join(source, "pos").groupBy("at").agg(F.max_by("v", "pos").alias("v"))


def stream_compact(df: DataFrame, position: str, flag: Column) -> DataFrame:
    """Rows whose flag is set, with ``at``: their place among them."""
    flagged = df.withColumn("__f", F.when(flag, 1).otherwise(0).cast("long"))
    return prefix_scan(flagged, position, "__f", inclusive=False, into="at").where("__f = 1").drop("__f")


def radix_sort(df: DataFrame, key: str, position: str, bits: int) -> DataFrame:
    """``df`` with ``rank``: the place in a stable sort by the lowest ``bits`` bits of the key.

    Places come from exact counts of (key, block of positions): each cell is ranked alone, so equal keys of half
    the table are still spread over many tasks.
    """
    df = df.withColumn("__k", F.col(key).bitwiseAND(F.lit((1 << bits) - 1))).withColumn("__b", F.call_function("div", F.col(position), F.lit(BLOCK).cast("long")))
    cells = df.groupBy("__k", "__b").agg(F.count("*").alias("__n"))
    # A row a cell: at most 2**bits for each BLOCK positions. Keys are laid out one after the other.
    keys = prefix_scan(cells.groupBy("__k").agg(F.sum("__n").alias("__n")), "__k", "__n", inclusive=False, into="__first").select("__k", "__first")
    own = F.sum("__n").over(Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = cells.withColumn("__own", F.coalesce(own, F.lit(0))).join(keys, "__k").select("__k", "__b", (F.col("__first") + F.col("__own")).alias("__at"))
    place = F.row_number().over(Window.partitionBy("__k", "__b").orderBy(position)) - 1
    return df.withColumn("__p", place).join(starts, ["__k", "__b"]).withColumn("rank", F.col("__at") + F.col("__p")).drop("__k", "__b", "__p", "__at")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows in an order, with ``rank`` from 0: each task keeps k rows."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def kth_smallest(df: DataFrame, value: str, k: int, bins: int = 4096):
    """The k-th smallest value (from 1) of a numeric column, or None: counts of equal ranges are refined until few rows are left."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    lo, hi, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not 1 <= k <= n:
        return None
    while lo < hi and n > BLOCK:
        cell = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
        for r in sorted(rows.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z")).collect(), key=lambda r: r["c"]):
            if k <= r["n"]:
                break
            k -= r["n"]
        rows, lo, hi, n = rows.where((F.col("v") >= r["a"]) & (F.col("v") <= r["z"])), r["a"], r["z"], r["n"]
    return lo if lo == hi else rows.orderBy("v").limit(k).agg(F.max("v")).first()[0]


def run_lengths(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """(key, run, value, length) of equal neighbours in each key's order."""
    w = Window.partitionBy(key).orderBy(*order)
    fresh = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    runs = df.withColumn("__f", fresh).withColumn("run", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.first(value).alias(value), F.count("*").alias("length"))


def softmax(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """``df`` with ``weight``: exp(x - max) over its sum, in each group. Group maxima and sums come from aggregates
    that combine before the shuffle, so a group of any size is no single task."""
    df = df.withColumn("__x", value)
    tops = df.groupBy(*by).agg(F.max("__x").alias("__m"))
    join = (lambda a, b: a.join(b, list(by))) if by else (lambda a, b: a.crossJoin(F.broadcast(b)))  # one row
    df = join(df, tops).withColumn("__e", F.exp(F.col("__x") - F.col("__m")))
    return join(df, df.groupBy(*by).agg(F.sum("__e").alias("__t"))).withColumn("weight", F.col("__e") / F.col("__t")).drop("__x", "__m", "__e", "__t")


def insert_first(rows: DataFrame) -> DataFrame:
    """(key, value) of rows(key, value, order): the first value of each key stays. The order must leave no ties."""
    return rows.groupBy("key").agg(F.min_by("value", "order").alias("value"))


def look_up(held: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(key) with ``value`` and ``found``."""
    return asked.join(held.withColumn("found", F.lit(True)), "key", "left").select("key", "value", F.coalesce("found", F.lit(False)).alias("found"))
