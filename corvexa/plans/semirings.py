"""Semiring products of a supplier-part matrix, provenance closure, interval hulls, Sinkhorn scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvexa.operators import semiring
from corvexa.registry import query, table

_A = "SELECT l_suppkey AS i, l_partkey AS k, CAST(max(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2"
_B = "SELECT p_partkey AS k, p_size AS j, p_partkey % 97 + 1 AS v FROM part"
_PARTS = {
    "real": ("CAST(sum(x * y) % 4294967296 AS BIGINT)", "BIGINT"),
    "min_plus": ("min(least(x + y, 4294967295))", ""),
    "max_plus": ("max(least(x + y, 4294967295))", ""),
    "max_times": ("max((x * y) % 4294967296)", ""),
    "bool_or": ("bit_or(x & y)", ""),
    "bool_and": ("bit_and(x | y)", ""),
    "gf2": ("bit_xor(x & y)", ""),
    "lineage": ("bit_or(CASE WHEN x <> 0 AND y <> 0 THEN x | y ELSE 0 END)", ""),
}


def _matrices(spark, sf_dir):
    l, p = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_quantity"), table(spark, sf_dir, "part", "p_partkey", "p_size")
    a = l.groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("k")).agg(F.max("l_quantity").cast("long").alias("v"))
    b = p.select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("j"), (F.col("p_partkey") % 97 + 1).alias("v"))
    return a, b


for _ring, (_agg, _) in _PARTS.items():

    @query(f"SELECT i, CAST(j AS BIGINT) AS j, CAST({_agg} AS BIGINT) AS v FROM (SELECT a.i, b.j, a.v AS x, b.v AS y FROM ({_A}) a JOIN ({_B}) b USING (k)) GROUP BY i, j", name=f"semiring_{_ring}")
    def _product(spark, sf_dir, ring=_ring):
        return semiring.product(*_matrices(spark, sf_dir), ring)


_STATE = "SELECT n_nationkey % 5 AS i, n_nationkey AS k, CAST(1 AS BIGINT) << (n_nationkey % 5) AS v FROM nation WHERE n_nationkey < 5"
_RULES = "SELECT n_nationkey AS k, (n_nationkey * 3 + 2) % 25 AS j, CAST(1 AS BIGINT) << (8 + n_regionkey) AS v FROM nation UNION SELECT n_nationkey, (n_nationkey + 5) % 25, CAST(1 AS BIGINT) << (16 + n_regionkey) FROM nation WHERE n_nationkey % 2 = 0"


@query(f"""WITH RECURSIVE rules AS ({_RULES}), cells AS (SELECT CAST(i AS BIGINT) AS i, CAST(k AS BIGINT) AS k, v FROM ({_STATE}) UNION
 SELECT c.i, CAST(r.j AS BIGINT), c.v | r.v FROM cells c JOIN rules r ON r.k = c.k) SELECT i, k, bit_or(v) AS v FROM cells GROUP BY i, k""")
def provenance_join(spark, sf_dir):
    """Datalog closure with lineage masks: which facts and rules each derived cell goes back to."""
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    k, bit = F.col("n_nationkey").cast("long"), lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.cast("int"))
    state = n.where("n_nationkey < 5").select((k % 5).alias("i"), k.alias("k"), bit(k % 5).alias("v"))
    one = n.select(k.alias("k"), ((k * 3 + 2) % 25).alias("j"), bit(F.col("n_regionkey") + 8).alias("v"))
    two = n.where("n_nationkey % 2 = 0").select(k.alias("k"), ((k + 5) % 25).alias("j"), bit(F.col("n_regionkey") + 16).alias("v"))
    return semiring.lineage_closure(state, one.unionByName(two).distinct())[0]


_BIT = "(CAST(1 AS HUGEINT) << CAST({} AS INT))"


@query(f"""WITH RECURSIVE rules AS (SELECT n_nationkey AS k, (n_nationkey * 3 + 2) % 25 AS j, {_BIT.format('25 + n_nationkey')} AS v FROM nation UNION SELECT n_nationkey, (n_nationkey + 5) % 25, {_BIT.format('50 + n_nationkey')} FROM nation WHERE n_nationkey % 2 = 0),
cells AS (SELECT CAST(n_nationkey % 5 AS BIGINT) AS i, CAST(n_nationkey AS BIGINT) AS k, {_BIT.format('n_nationkey')} AS v FROM nation WHERE n_nationkey < 5 UNION SELECT c.i, CAST(r.j AS BIGINT), c.v | r.v FROM cells c JOIN rules r ON r.k = c.k),
m AS (SELECT i, k, bit_or(v) AS v FROM cells GROUP BY i, k) SELECT i, k, w AS word, CAST((v >> CAST(40 * w AS INT)) & 1099511627775 AS BIGINT) AS v FROM m, range(2) r(w) WHERE (v >> CAST(40 * w AS INT)) & 1099511627775 <> 0""")
def provenance_wide(spark, sf_dir):
    """Lineage with a bit for every fact and every rule, in words of 40 bits."""
    n = table(spark, sf_dir, "nation", "n_nationkey")
    k = F.col("n_nationkey").cast("long")

    def bits(df, at, *columns):
        at = at.cast("int")
        return df.select(*columns, F.call_function("div", at, F.lit(40)).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at % 40).alias("v"))

    state = bits(n.where("n_nationkey < 5"), k, (k % 5).alias("i"), k.alias("k"))
    rules = bits(n, k + 25, k.alias("k"), ((k * 3 + 2) % 25).alias("j")).unionByName(bits(n.where("n_nationkey % 2 = 0"), k + 50, k.alias("k"), ((k + 5) % 25).alias("j")))
    return semiring.lineage_closure_wide(state, rules.distinct())


@query("SELECT o_orderkey AS k, least(a, b) AS lo, greatest(a + 9, b + 4) AS hi FROM (SELECT o_orderkey, o_orderkey % 100 AS a, o_custkey % 100 AS b FROM orders)")
def interval_merge(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    a, b = F.col("o_orderkey") % 100, F.col("o_custkey") % 100
    lo, hi = semiring.merge_intervals(a, a + 9, b, b + 4)
    return t.select(F.col("o_orderkey").alias("k"), lo.alias("lo"), hi.alias("hi"))


_SINK = ["WITH m0 AS (SELECT l_suppkey % 12 AS i, l_partkey % 9 AS j, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)"]
for _n in range(6):
    _s = "i" if _n % 2 == 0 else "j"
    _SINK.append(f"m{_n + 1} AS (SELECT i, j, v / sum(v) OVER (PARTITION BY {_s}) AS v FROM m{_n})")


@query(", ".join(_SINK) + " SELECT i, j, round(v, 7) AS v FROM m6")
def sinkhorn_iterate(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey")
    m = t.groupBy((F.col("l_suppkey") % 12).alias("i"), (F.col("l_partkey") % 9).alias("j")).agg(F.count("*").cast("double").alias("v"))
    return semiring.sinkhorn(m, rounds=3).select("i", "j", F.round("v", 7).alias("v"))
