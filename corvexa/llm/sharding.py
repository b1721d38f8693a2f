"""Histogram sort: exact byte counts below candidate boundaries, refined until splitters fit, then one exchange.

The order is (hash of the text, hash of the id, id), so equal texts lie side by side. Splitters are found by radix
refinement: each round counts the exact bytes of 4096 sub-ranges of every range that still holds a splitter, so the
driver sees at most ``(shards - 1) * 4096`` sums however large the input is. A range is done when it holds one text.
A group of equal texts stays whole, and the splitter goes to its nearer end, unless the group is larger than
``tolerance`` of a shard; only such a group is cut, between two of its rows.

Null texts count as empty; null ids have the hash of no text and come first; repeated rows share a key and stay together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, session_of

#: Bits that a round fixes, bits of a hash (the first hexadecimal digits of an MD5 digest).
DIGIT, BITS = 12, 60
#: Bytes of the rows that one task sorts, about, at most and at least.
RUN_BYTES, LEAST_RUN = 64 << 20, 256 << 10


def hashed(text: Column) -> Column:
    """A column that is known to hold no null, so that no filter on it, with the digest written out again, is inferred."""
    return F.coalesce(F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long"), F.lit(0).cast("long"))


def _refine(rows: DataFrame, column: str, by: list[str], state: list[dict], goals: list[int]) -> int:
    """Fix ``column`` of each splitter, digit by digit, to the value at which the bytes below reach its goal.

    ``rows`` has ``by`` (the values fixed before, the same names as in the states), ``column`` and __size. States get
    the value, the bytes ``below`` it and its own bytes and rows; the number of rounds is returned.
    """
    todo, rounds = list(range(len(state))), 0
    for s in state:
        s["low"], s["shift"] = 0, BITS
    while todo:
        shift = state[todo[0]]["shift"] - DIGIT
        keys = sorted({(*[state[s][c] for c in by], state[s]["low"]) for s in todo})
        inside = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(by, k, strict=False)], F.shiftright(column, shift + DIGIT) == k[-1]) for k in keys]) if by or shift + DIGIT < BITS else F.lit(True)
        bins: dict = {}
        counts = rows.where(inside).groupBy(*by, F.shiftright(column, shift).alias("__bin")).agg(F.sum("__size").alias("b"), F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for r in counts.collect():
            bins.setdefault((*[r[c] for c in by], r["__bin"] >> DIGIT), []).append(r)
        for v in bins.values():
            v.sort(key=lambda r: r["__bin"])
        rounds, left = rounds + 1, []
        for s in todo:
            below = state[s]["below"]
            for r in bins[(*[state[s][c] for c in by], state[s]["low"])]:
                if below + r["b"] >= goals[s]:
                    break
                below += r["b"]
            state[s] |= {"below": below, "low": r["__bin"], "shift": shift, "bytes": r["b"], "rows": r["n"]}
            if r["lo"] == r["hi"]:
                state[s][column] = r["lo"]
            else:
                left.append(s)
        todo = left
    return rounds


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float) -> tuple[list[tuple[int, int]], dict]:
    """Splitters (h, j) of ``keys(__h, __j, __size)``: rows at or above (h, j) belong to the next shard or a later one."""
    total = keys.agg(F.sum("__size")).first()[0] or 0
    if not total:
        return [], {"rounds": 0, "total": 0}
    goals = [-(-total * (s + 1) // n_shards) for s in range(n_shards - 1)]
    state = [{"below": 0} for _ in goals]
    rounds = _refine(keys, "__h", [], state, goals)
    limit = int(tolerance * total / n_shards)
    large = [k for k, s in enumerate(state) if s["bytes"] > limit]
    whole = [s for k, s in enumerate(state) if k not in set(large)]
    if large:
        within = [state[k] for k in large]
        texts = sorted({s["__h"] for s in within})
        rounds += _refine(keys.where(F.col("__h").isin(texts)), "__j", ["__h"], within, [goals[k] for k in large])
    at = []
    for s, goal in zip(state, goals, strict=True):
        upper = goal - s["below"] > s["below"] + s["bytes"] - goal  # the nearer end
        s["at"] = s["below"] + s["bytes"] * upper
        at.append((s["__h"], s["__j"] + upper) if "__j" in s else (s["__h"] + upper, 0))
    return at, {"rounds": rounds, "total": total, "below": [s["at"] for s in state], "whole": len(whole)}


def histogram_shards(docs: DataFrame, n_shards: int = 40, tolerance: float = 0.03, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``size``, ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard, in key order).

    Sizes are the text's UTF-8 bytes plus 16. A splitter lies off its goal by half of ``tolerance`` of a shard at
    most, or by half of the row that it meets. Columns of these names are replaced.
    """
    spark = session_of(docs)
    ws = Workspace(spark, "shards")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"size", "shard", "slot", "__h", "__j", "__id", "__size", "__band", "__part", "__hot", "__first", "__rank"}])
    body = F.coalesce(F.col(text), F.lit(""))
    derived = {"__h": hashed(body), "__j": hashed(F.coalesce(F.col(key).cast("string"), F.lit(""))), "__id": F.col(key).cast("long"), "__size": F.octet_length(body).cast("long") + 16}
    keys = ws.save(docs.select(*[c.alias(n) for n, c in derived.items()]), "keys")
    splitters, info = find_splitters(keys, n_shards, tolerance)
    h, j = F.col("__h"), F.col("__j")
    shard = reduce(lambda a, b: a + b, [((h > a) | ((h == a) & (j >= b))).cast("int") for a, b in splitters], F.lit(0))
    # Each shard is sorted in runs, one task each: ranges of h, and ranges of j for a text that fills several runs.
    bands = max(DIGIT, (info["total"] // RUN_BYTES).bit_length())
    fill = max(LEAST_RUN, info["total"] >> bands)
    band = F.shiftright(h, BITS - bands)
    hot = keys.groupBy("__h").agg(F.sum("__size").alias("b")).where(F.col("b") > 4 * fill)
    hot = hot.groupBy(band.alias("__band")).agg(F.array_sort(F.collect_list(F.struct("__h", F.ceil(F.log2(F.col("b") / fill)).cast("int").alias("bits")))).alias("__hot"))
    hot = ws.save(hot, "hot")  # a band is expected to hold the bytes of one run beside its hot texts: a few of them at most
    some = not hot.isEmpty()

    def placed(df: DataFrame) -> DataFrame:
        """``df`` with the run of each row. What lies before, in and after a hot text of its band are runs of their own."""
        df = df.withColumns({"shard": shard.cast("int"), "__band": band})
        if not some:
            return df.withColumn("__part", F.lit(0).cast("long"))
        df = df.join(hot, "__band", "left")
        n = lambda c: F.coalesce(F.size(F.filter("__hot", c)), F.lit(0)).cast("long")
        bits = F.element_at(F.filter("__hot", lambda x: x["__h"] == h), 1)["bits"]
        steps = F.when(F.col("__hot").isNull(), F.lit(0).cast("long")).otherwise(n(lambda x: x["__h"] <= h) + n(lambda x: x["__h"] < h))
        inner = F.when(F.col("__hot").isNotNull() & F.exists("__hot", lambda x: x["__h"] == h), F.call_function("shiftright", j, F.lit(BITS) - bits)).otherwise(F.lit(0).cast("long"))
        return df.withColumn("__part", F.coalesce(F.shiftleft(steps, 40) + inner, F.lit(0).cast("long"))).drop("__hot")

    run = ["shard", "__band", "__part"]
    counts = ws.save(placed(keys).groupBy(*run).agg(F.count("*").alias("__n")), "runs")
    before = Window.partitionBy("shard").orderBy("__band", "__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*run, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    out = placed(docs.withColumns(derived))
    order = Window.partitionBy(*run).orderBy("__h", "__j", "__id", F.crc32(body.cast("binary")), "__size")
    out = out.withColumn("__rank", F.row_number().over(order)).join(starts, run)
    out = out.withColumn("slot", F.col("__first") + F.col("__rank") - 1).withColumnRenamed("__size", "size")
    return out.drop("__h", "__j", "__id", "__band", "__part", "__first", "__rank")
