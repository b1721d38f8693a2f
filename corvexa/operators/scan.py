"""Running aggregates over a whole table without a single-task window: blocks, totals of blocks, totals of totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block.
BLOCK = 1 << 16
_KINDS = {"sum": F.sum, "max": F.max, "min": F.min}


def prefix_scan(df: DataFrame, position: str, value: str, inclusive: bool = True, kind: str = "sum", into: str = "scan", block: int = BLOCK, levels: int = 2) -> DataFrame:
    """``df`` with the running sum, maximum or minimum of ``value`` in order of the integer ``position``.

    Rows are dealt to blocks of ``block`` positions; within a block a window runs, and what the blocks before amount
    to is scanned likewise over one row a block. Only the last level, with a row for ``block ** levels`` positions,
    is one task. Rows of one position count together (range frame). Exclusive sums start at 0; other kinds at null.
    """
    f, own = _KINDS[kind], f"__{into}"
    cell = F.call_function("div", F.col(position), F.lit(block).cast("long"))
    upto = Window.unboundedPreceding, (0 if inclusive else -1)
    if levels == 0:
        return _with(df, f(value).over(Window.orderBy(position).rangeBetween(*upto)), None, kind, inclusive, into)
    df = df.withColumn(f"{own}_b", cell)
    within = f(value).over(Window.partitionBy(f"{own}_b").orderBy(position).rangeBetween(*upto))
    totals = df.groupBy(F.col(f"{own}_b").alias(f"{own}_p")).agg(f(value).alias(f"{own}_t"))
    before = prefix_scan(totals, f"{own}_p", f"{own}_t", False, kind, f"{own}_o", block, levels - 1).select(F.col(f"{own}_p").alias(f"{own}_b"), f"{own}_o")
    out = df.withColumn(f"{own}_w", within).join(before, f"{own}_b", "left")
    return _with(out, F.col(f"{own}_w"), F.col(f"{own}_o"), kind, inclusive, into).drop(f"{own}_b", f"{own}_w", f"{own}_o")


def _with(df: DataFrame, within: Column, before: Column | None, kind: str, inclusive: bool, into: str) -> DataFrame:
    if kind == "sum":
        zero = F.lit(0).cast("long")
        total = F.coalesce(within, zero) + (F.coalesce(before, zero) if before is not None else zero)
        return df.withColumn(into, total)
    pick = F.greatest if kind == "max" else F.least
    return df.withColumn(into, pick(within, before) if before is not None else within)
