"""Sets of ids: as rows (a column ``id``) and packed into 32-bit words (``word``, ``bits``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvexa.functions import u32

from .scan import prefix_scan


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").unionByName(b.select("id")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").join(b.select("id"), "id", "left_semi").distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").join(b.select("id"), "id", "left_anti").distinct()


def difference_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symmetric difference: one aggregation over both sides, no join."""
    both = a.select("id", F.lit(1).alias("s")).unionByName(b.select("id", F.lit(2).alias("s")))
    return both.groupBy("id").agg(F.bit_or("s").alias("s")).where("s <> 3").select("id")


def complement(a: DataFrame, universe: DataFrame) -> DataFrame:
    return minus(universe, a)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes of both sets and of their intersection, and the flags that follow from them."""
    both = a.select("id", F.lit(1).alias("s")).unionByName(b.select("id", F.lit(2).alias("s"))).groupBy("id").agg(F.bit_or("s").alias("s"))
    n = lambda c: F.count_if(c)
    one, two = F.col("s") != 2, F.col("s") != 1
    return both.agg(n(one).alias("size_a"), n(two).alias("size_b"), n(F.col("s") == 3).alias("both"), (n(F.col("s") != 3) == 0).alias("equal"), (n(F.col("s") == 1) == 0).alias("subset"), (n(one) > 0).alias("any"))


def pack(ids: DataFrame) -> DataFrame:
    """(word, bits): bit i of the set lies in word i / 32."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % 32).cast("int"))
    return ids.groupBy(F.call_function("div", F.col("id"), F.lit(32).cast("long")).alias("word")).agg(F.bit_or(bit).alias("bits"))


def unpack(words: DataFrame) -> DataFrame:
    each = F.explode(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftright", F.col("bits"), i) % 2 == 1))
    return words.select("word", each.alias("bit")).select((F.col("word") * 32 + F.col("bit")).alias("id"))


def packed(a: DataFrame, b: DataFrame, op) -> DataFrame:
    """Word-wise operation on two packed sets; absent words are zero."""
    x, y = F.coalesce(F.col("x"), F.lit(0).cast("long")), F.coalesce(F.col("y"), F.lit(0).cast("long"))
    return a.withColumnRenamed("bits", "x").join(b.withColumnRenamed("bits", "y"), "word", "full").select("word", op(x, y).alias("bits"))


def test_bit(words: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(id) with ``found``: whether the bit is set; ids beyond the words are not."""
    q = asked.withColumn("word", F.call_function("div", F.col("id"), F.lit(32).cast("long")))
    bit = F.call_function("shiftright", F.coalesce("bits", F.lit(0).cast("long")), (F.col("id") % 32).cast("int")) % 2
    return q.join(words, "word", "left").select("id", (bit == 1).alias("found"))


def change_bit(words: DataFrame, id_: int, on: bool) -> DataFrame:
    """The packed set with one bit set or cleared."""
    w, bit = id_ // 32, 1 << (id_ % 32)
    if not on:
        return words.withColumn("bits", F.when(F.col("word") == w, F.col("bits").bitwiseAND(F.lit(u32.MAX - bit))).otherwise(F.col("bits")))
    one = words.sparkSession.createDataFrame([(w, bit)], "word long, bits long")
    return words.unionByName(one).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def rank_index(words: DataFrame) -> DataFrame:
    """(word, bits, before): set bits in all words before."""
    return prefix_scan(words.withColumn("n", u32.popcount(F.col("bits"))), "word", "n", inclusive=False, into="before").select("word", "bits", "before")


def rank1(index: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(id) with ``rank``: set bits below the id. Ids whose word is empty take the words before."""
    q = asked.select("id", F.call_function("div", F.col("id"), F.lit(32).cast("long")).alias("word"))
    # As-of join by a running maximum over the words: queries and words are scanned together.
    both = index.select("word", F.col("before").alias("a"), (F.col("before") + u32.popcount(F.col("bits"))).alias("z"), F.lit(None).cast("long").alias("id"))
    both = both.unionByName(q.select("word", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("z"), "id"))
    ends = prefix_scan(both, "word", "z", kind="max", into="upto").where("id IS NOT NULL").select("id", "word", "upto")
    low = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % 32).cast("int")) - 1
    inside = F.when(F.col("bits").isNotNull(), F.col("before") + u32.popcount(F.col("bits").bitwiseAND(low)))
    return ends.join(index, "word", "left").select("id", F.coalesce(inside, "upto", F.lit(0)).alias("rank"))


def select1(index: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(k) with ``id``: the k-th set bit (from 0). Each k meets the one word whose rank range holds it."""
    hits = index.select("word", "before", F.explode(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftright", F.col("bits"), i) % 2 == 1)).alias("bit"), "bits")
    below = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")) - 1
    return hits.select((F.col("before") + u32.popcount(F.col("bits").bitwiseAND(below))).alias("k"), (F.col("word") * 32 + F.col("bit")).alias("id")).join(asked, "k", "left_semi")


def stochastic_multiply(a: Column, b: Column) -> Column:
    """Product of two bit-stream probabilities: the share of positions set in both."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def zeros(width: DataFrame) -> DataFrame:
    """(word, bits) of no bits, for every word of width(word)."""
    return width.select("word", F.lit(0).cast("long").alias("bits"))


def copied(source: DataFrame, target: DataFrame) -> DataFrame:
    """(word, bits): the source's bits at the target's words."""
    return target.select("word").join(source, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))


def apply_byte_table(pairs: DataFrame, bytes_: DataFrame) -> DataFrame:
    """(k, bits) of pairs(k, x, y): byte i is v of bytes_(a, b, v) at byte i of x and of y. The table has 65,536 rows."""
    byte = lambda c, i: F.call_function("shiftright", F.col(c), i * 8).bitwiseAND(F.lit(255).cast("long"))
    each = pairs.select("k", "x", "y", F.explode(F.array(*map(F.lit, range(4)))).alias("i"))
    each = each.select("k", "i", byte("x", F.col("i")).alias("a"), byte("y", F.col("i")).alias("b"))
    found = each.join(F.broadcast(bytes_), ["a", "b"])
    return found.groupBy("k").agg(F.bit_or(F.call_function("shiftleft", F.col("v"), F.col("i") * 8)).alias("bits"))


def four_russians(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """(g, bits): the rows (g, row, bits) of a boolean matrix of 32 rows joined by or, where vectors(g, front) have a bit.

    Of each byte of the vector a table of its 256 values holds the rows joined; the vector's bytes then pick one each.
    """
    byte = F.call_function("div", F.col("row"), F.lit(8).cast("long"))
    held = rows.groupBy("g", byte.alias("byte")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("row") % 8).cast("int"), "bits"))).alias("m"))  # 8 rows
    row = lambda r: F.coalesce(F.try_element_at("m", r), F.lit(0).cast("long"))
    value = lambda v: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda s, r: F.when(F.call_function("shiftright", v, r) % 2 == 1, s.bitwiseOR(row(r))).otherwise(s))
    tables = held.select("g", "byte", F.transform(F.sequence(F.lit(0), F.lit(255)), value).alias("t"))
    at = F.call_function("shiftright", F.col("front"), (F.col("byte") * 8).cast("int")).bitwiseAND(F.lit(255).cast("long"))
    return tables.join(vectors, "g").groupBy("g").agg(F.bit_or(F.get("t", at.cast("int"))).alias("bits"))
