"""Set queries: the parts that two suppliers ship, as rows and as packed words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvexa.functions import u32
from corvexa.operators import sets
from corvexa.registry import query, table

_A = "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_suppkey % 10 = 3"
_B = "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_suppkey % 10 = 4"
_U = "SELECT p_partkey AS id FROM part"


def _parts(spark: SparkSession, sf_dir: str, of: int) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").where(F.col("l_suppkey") % 10 == of).select(F.col("l_partkey").alias("id"))


def _both(spark, sf_dir):
    return _parts(spark, sf_dir, 3), _parts(spark, sf_dir, 4)


@query(f"{_A} INTERSECT {_B}")
def set_and(spark, sf_dir):
    return sets.intersect(*_both(spark, sf_dir))


@query(f"{_A} UNION {_B}")
def set_or(spark, sf_dir):
    return sets.union(*_both(spark, sf_dir))


@query(f"{_A} EXCEPT {_B}")
def set_and_not(spark, sf_dir):
    return sets.minus(*_both(spark, sf_dir))


@query(f"(({_A}) EXCEPT ({_B})) UNION (({_B}) EXCEPT ({_A}))")
def set_xor(spark, sf_dir):
    return sets.difference_both(*_both(spark, sf_dir))


@query(f"{_U} EXCEPT {_A}")
def set_not(spark, sf_dir):
    return sets.complement(_parts(spark, sf_dir, 3), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


@query(f"""WITH a AS ({_A}), b AS ({_B}) SELECT (SELECT count(*) FROM a) AS size_a, (SELECT count(*) FROM b) AS size_b, (SELECT count(*) FROM a JOIN b USING (id)) AS both,
 NOT EXISTS (SELECT * FROM a FULL JOIN b USING (id) WHERE a.id IS NULL OR b.id IS NULL) AS equal, NOT EXISTS (SELECT * FROM a ANTI JOIN b USING (id)) AS subset, EXISTS (SELECT * FROM a) AS any""")
def set_compare(spark, sf_dir):
    """Equality, subset, any and population counts of two sets, in one pass."""
    return sets.compare(*_both(spark, sf_dir))


_PACK = "SELECT id // 32 AS word, bit_or(CAST(1 AS BIGINT) << (id % 32)) AS bits FROM ({}) GROUP BY 1"


@query(f"""WITH a AS ({_PACK.format(_A)}), b AS ({_PACK.format(_B)}), w AS (SELECT coalesce(a.word, b.word) AS word, coalesce(a.bits, 0) AS x, coalesce(b.bits, 0) AS y FROM a FULL JOIN b ON a.word = b.word)
SELECT word, x & y AS anded, x | y AS ored, xor(x, y) AS xored, x & (4294967295 - y) AS and_not, 4294967295 - x AS inverted, 4294967295 - (x & y) AS nand, 4294967295 - (x | y) AS nor, CAST(bit_count(x) AS BIGINT) AS count FROM w""")
def bitset_words(spark, sf_dir):
    a, b = (sets.pack(s) for s in _both(spark, sf_dir))
    made = F.struct  # one full join serves all operations
    x, y = F.col("bits.x"), F.col("bits.y")
    return sets.packed(a, b, lambda p, q: made(p.alias("x"), q.alias("y"))).select("word", x.bitwiseAND(y).alias("anded"), x.bitwiseOR(y).alias("ored"), x.bitwiseXOR(y).alias("xored"), x.bitwiseAND(u32.bit_not(y)).alias("and_not"), u32.bit_not(x).alias("inverted"), u32.bit_not(x.bitwiseAND(y)).alias("nand"), u32.bit_not(x.bitwiseOR(y)).alias("nor"), u32.popcount(x).alias("count"))


@query(f"SELECT o_orderkey AS id, o_orderkey IN ({_A}) AS found FROM orders")
def bitset_contains(spark, sf_dir):
    """Bit tests, out-of-range ids included, which are not found."""
    return sets.test_bit(sets.pack(_parts(spark, sf_dir, 3)), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))


@query(f"SELECT id FROM (({_A}) UNION (SELECT CAST(7 AS BIGINT))) WHERE id <> 11")
def bitset_set_clear(spark, sf_dir):
    return sets.unpack(sets.change_bit(sets.change_bit(sets.pack(_parts(spark, sf_dir, 3)), 7, True), 11, False))


@query(f"SELECT p_partkey AS id, (SELECT count(*) FROM ({_A}) s WHERE s.id < p_partkey) AS rank FROM part")
def rank1_query(spark, sf_dir):
    index = sets.rank_index(sets.pack(_parts(spark, sf_dir, 3)))
    return sets.rank1(index, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


@query(f"SELECT k, id FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS k, id FROM ({_A})) WHERE k IN (SELECT p_partkey * 3 FROM part)")
def select1_query(spark, sf_dir):
    index = sets.rank_index(sets.pack(_parts(spark, sf_dir, 3)))
    return sets.select1(index, table(spark, sf_dir, "part").select((F.col("p_partkey") * 3).alias("k")))


@query("""SELECT o_orderkey AS k, list_transform([1, 2, 3, 4], lambda i: (o_orderkey * 2654435761 * i) % 65536 & (o_custkey * 40503 * i) % 65536) AS x FROM orders""".replace("AS x FROM", "::BIGINT[] AS product FROM"), name="stochastic_and_mul")
def stochastic_and_mul(spark, sf_dir):
    streams = lambda c, m: F.transform(F.array(*map(F.lit, (1, 2, 3, 4))), lambda i: c * m * i % 65536)
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("k"), sets.stochastic_multiply(streams(F.col("o_orderkey"), 2654435761), streams(F.col("o_custkey"), 40503)).alias("product"))


@query(f"WITH a AS ({_PACK.format(_A)}), w AS (SELECT DISTINCT p_partkey // 32 AS word FROM part) SELECT word, coalesce(bits, 0) AS copied, CAST(0 AS BIGINT) AS zeroed FROM w LEFT JOIN a USING (word)")
def bitset_copy_zero(spark, sf_dir):
    """A packed set copied to a table with a word for every place, and one of zeros."""
    width = table(spark, sf_dir, "part", "p_partkey").select(F.call_function("div", F.col("p_partkey"), F.lit(32).cast("long")).alias("word")).distinct()
    zero = sets.zeros(width)
    return sets.copied(sets.pack(_parts(spark, sf_dir, 3)), zero).withColumnRenamed("bits", "copied").join(zero.withColumnRenamed("bits", "zeroed"), "word")


@query("SELECT k, CAST(list_sum([(((x >> (8 * i)) & 255) * ((y >> (8 * i)) & 255) + 7) % 256 << (8 * i) FOR i IN range(4)]) AS BIGINT) AS looked FROM (SELECT o_orderkey AS k, (o_orderkey * 2654435761) % 4294967296 AS x, (o_custkey * 40503) % 4294967296 AS y FROM orders)")
def byte_table_apply(spark, sf_dir):
    """Words combined byte by byte through a table of all pairs of bytes."""
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("k"), u32.mul(F.col("o_orderkey"), 2654435761).alias("x"), (F.col("o_custkey") * 40503 % u32.WORD).alias("y"))
    pair = spark.range(1 << 16).select(F.shiftright("id", 8).alias("a"), F.col("id").bitwiseAND(F.lit(255).cast("long")).alias("b"))
    return sets.apply_byte_table(t, pair.select("a", "b", ((F.col("a") * F.col("b") + 7) % 256).alias("v"))).withColumnRenamed("bits", "looked")


_LOCAL = "arcs AS (SELECT DISTINCT p_partkey // 32 AS g, p_partkey % 32 AS src, k * (p_partkey + p_size) % 32 AS dst FROM part, (SELECT unnest([1, 3, 5]) AS k)), front AS (SELECT p_partkey // 32 AS g, p_partkey % 32 AS node FROM part WHERE p_size % 3 = 0)"


@query(f"WITH {_LOCAL} SELECT arcs.g, bit_or(CAST(1 AS BIGINT) << dst) AS bits FROM arcs JOIN front ON front.g = arcs.g AND front.node = arcs.src GROUP BY 1")
def four_russians_matvec(spark, sf_dir):
    """Boolean matrices of 32 by 32 times vectors: a table a byte of the vector, one look-up a byte."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    k, g = F.col("p_partkey"), F.call_function("div", F.col("p_partkey"), F.lit(32).cast("long")).alias("g")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.cast("int"))
    rows = p.select(g, (k % 32).alias("row"), F.explode(F.array(*[m * (k + F.col("p_size")) % 32 for m in (1, 3, 5)])).alias("d")).groupBy("g", "row").agg(F.bit_or(bit(F.col("d"))).alias("bits"))
    front = p.where("p_size % 3 = 0").select(g, (k % 32).alias("n")).groupBy("g").agg(F.bit_or(bit(F.col("n"))).alias("front"))
    return sets.four_russians(rows, front).where("bits <> 0")
