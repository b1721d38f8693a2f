"""Sparse matrix products over semirings, lineage closure, interval merge, balanced scaling."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvexa.functions import u32
from corvexa.plans.lineage import cut

from .reduce import wrapping_sum


@dataclass(frozen=True)
class Semiring:
    """``times`` of two cells, ``plus`` of many; an absent cell is one that can't change a sum."""

    plus: Callable[[Column], Column]
    times: Callable[[Column, Column], Column]


#: BoolAnd's and MinPlus's absent cell is the largest number, the others' is 0. Max-plus takes the largest sum of paths.
SEMIRINGS = {
    "real": Semiring(wrapping_sum, u32.mul),
    "min_plus": Semiring(F.min, u32.saturating_add),
    "max_plus": Semiring(F.max, u32.saturating_add),
    "max_times": Semiring(F.max, u32.mul),
    "bool_or": Semiring(F.bit_or, lambda a, b: a.bitwiseAND(b)),
    "bool_and": Semiring(F.bit_and, lambda a, b: a.bitwiseOR(b)),
    "gf2": Semiring(F.bit_xor, lambda a, b: a.bitwiseAND(b)),
    "lineage": Semiring(F.bit_or, lambda a, b: F.when((a != 0) & (b != 0), a.bitwiseOR(b)).otherwise(F.lit(0))),
}


def product(a: DataFrame, b: DataFrame, ring: str) -> DataFrame:
    """(i, j, v) of a(i, k, v) times b(k, j, v): one equi-join on k, sums combined before the shuffle.

    Absent cells stand for values that annihilate products; for max_plus and bool_and pass zero cells explicitly.
    """
    r = SEMIRINGS[ring]
    both = a.select("i", "k", F.col("v").alias("x")).join(b.select("k", "j", F.col("v").alias("y")), "k")
    return both.groupBy("i", "j").agg(r.plus(r.times(F.col("x"), F.col("y"))).alias("v"))


def lineage_closure(state: DataFrame, rules: DataFrame, rounds: int | None = None) -> tuple[DataFrame, int]:
    """(i, k, v) cells of a right-linear closure: state joined with rules until nothing changes, and the round of that.

    Cells are lineage masks; only cells that changed are joined again (semi-naive). It is an error if ``rounds``, where
    given, end before that.
    """
    total = cut(state.select("i", "k", "v"))
    delta = total
    for n in count():
        new = product(delta, rules, "lineage").where("v <> 0").withColumnRenamed("j", "k")
        grown = new.join(total.withColumnRenamed("v", "old"), ["i", "k"], "left").where("old IS NULL OR (v | old) <> old")
        delta = cut(grown.select("i", "k", F.col("v").bitwiseOR(F.coalesce("old", F.lit(0).cast("long"))).alias("v")))
        if delta.isEmpty():
            return total, n
        if rounds is not None and n >= rounds:
            raise RuntimeError(f"lineage_closure: cells change after {rounds} rounds")
        total = cut(total.unionByName(delta).groupBy("i", "k").agg(F.bit_or("v").alias("v")))


def product_wide(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, word, v) of lineage masks of many words, a(i, k, word, v) times b(k, j, word, v): a cell's mask is joined by
    or with that of the cell that it meets. Cells without a set bit are absent."""
    a, b = a.where("v <> 0"), b.where("v <> 0")
    left = a.join(b.select("k", "j").distinct(), "k").select("i", "j", "word", "v")
    right = b.join(a.select("i", "k").distinct(), "k").select("i", "j", "word", "v")
    return left.unionByName(right).groupBy("i", "j", "word").agg(F.bit_or("v").alias("v"))


def lineage_closure_wide(state: DataFrame, rules: DataFrame, rounds: int | None = None) -> DataFrame:
    """(i, k, word, v) cells of a right-linear closure with masks of many words, until nothing changes (semi-naive). It is an
    error if ``rounds``, where given, end before that."""
    total = cut(state.select("i", "k", "word", "v"))
    delta = total
    for n in count():
        new = product_wide(delta, rules).withColumnRenamed("j", "k")
        grown = new.join(total.withColumnRenamed("v", "old"), ["i", "k", "word"], "left").where("old IS NULL OR (v | old) <> old")
        changed = cut(grown.select("i", "k", "word", F.col("v").bitwiseOR(F.coalesce("old", F.lit(0).cast("long"))).alias("v")))
        if changed.isEmpty():
            return total
        if rounds is not None and n >= rounds:
            raise RuntimeError(f"lineage_closure_wide: cells change after {rounds} rounds")
        total = cut(total.unionByName(changed).groupBy("i", "k", "word").agg(F.bit_or("v").alias("v")))
        # A changed word travels with the rest of its cell's mask.
        delta = total.join(changed.select("i", "k").distinct(), ["i", "k"], "left_semi")


def merge_intervals(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> tuple[Column, Column]:
    """The hull of two intervals."""
    return F.least(lo_a, lo_b), F.greatest(hi_a, hi_b)


def sinkhorn(m: DataFrame, rounds: int = 5, floor: float = 1e-12) -> DataFrame:
    """(i, j, v): rows and columns scaled in turn to sum to one; two aggregates and two joins a round."""
    for n in range(rounds):
        for side in ("i", "j"):
            sums = m.groupBy(side).agg(F.greatest(F.sum("v"), F.lit(floor)).alias("s"))
            m = m.join(sums, side).select("i", "j", (F.col("v") / F.col("s")).alias("v"))
        m = cut(m)
    return m
