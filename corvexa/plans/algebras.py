"""Hash, codec, algebra and topology queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvexa.functions import algebra
from corvexa.functions.arrow import spread, with_columns
from corvexa.operators import circuits, graph, hashing, sketch
from corvexa.plans.graphs import _EVEN, _PAIRS, _TREE, pairs, tree
from corvexa.plans.lineage import cut
from corvexa.plans.numerics import _V, vectors
from corvexa.plans.texts import raw
from corvexa.registry import query, table


@query()
def blake3(spark, sf_dir):
    """BLAKE3 digests of whole texts."""
    return hashing.with_blake3(raw(spark, sf_dir), "raw").select("doc_id", "blake3")


_P = 998244353


@query(f"SELECT o_orderkey AS id, (a + b * w % {_P}) % {_P} AS low, ((a - b * w % {_P}) + {_P}) % {_P} AS high FROM (SELECT o_orderkey, o_orderkey * 7919 % {_P} AS a, o_custkey * 104729 % {_P} AS b, (o_orderkey % 64) * 15311432 % {_P} AS w FROM orders)")
def ntt_butterfly(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    low, high = hashing.butterfly(k * 7919 % _P, c * 104729 % _P, k % 64 * 15311432 % _P, _P)
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(k.alias("id"), low.alias("low"), high.alias("high"))


_EIGHT = f"(SELECT id, h, v[h * 8 + 1:h * 8 + 8] AS v FROM ({_V}), range(8) r(h))"


@query(f"SELECT id, h, round(v[1] * v[5] + v[2] * v[6] + v[3] * v[7] - v[4] * v[8], 6) AS s, round(v[1] * v[6] + v[2] * v[5] - v[3] * v[8] + v[4] * v[7], 6) AS x, round(v[1] * v[7] + v[3] * v[5] + v[2] * v[8] - v[4] * v[6], 6) AS y, round(v[1] * v[8] + v[4] * v[5] + v[2] * v[7] - v[3] * v[6], 6) AS p FROM {_EIGHT}")
def clifford_product(spark, sf_dir):
    """Products of the multivectors in each eight components."""
    t = vectors(spark, sf_dir).select("id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("h"), "v").select("id", F.col("h").cast("long").alias("h"), F.slice("v", F.col("h") * 8 + 1, 8).alias("v"))
    v = [F.get("v", F.lit(k)) for k in range(8)]
    return t.select("id", "h", *[F.round(c, 6).alias(n) for n, c in zip("sxyp", algebra.geometric_product(v[:4], v[4:]), strict=True)])


@query(f"SELECT id, j, round(v[j + 1] - 0.5 * coalesce(v[j], 0) - 0.125 * CASE WHEN j > 1 THEN v[j - 1] ELSE 0 END - 0.0625 * CASE WHEN j > 2 THEN v[j - 2] ELSE 0 END, 6) AS d FROM (SELECT id, [0.0] || v AS w, v, unnest(range(len(v))) AS j FROM ({_V}))")
def fractional_derivative(spark, sf_dir):
    """Half derivatives of whole vectors, from the four newest values."""
    d = vectors(spark, sf_dir).select("id", F.posexplode(algebra.fractional_derivative(F.col("v"), 0.5, 4)).alias("j", "d"))
    return d.select("id", F.col("j").cast("long").alias("j"), F.round("d", 6).alias("d"))


_E = f"{_PAIRS}, {_EVEN}"


@query(f"""WITH RECURSIVE {_E}, t AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(node, label) USING KEY (node) AS (SELECT DISTINCT a, a FROM t UNION
 SELECT t.b, min(w.label) FROM w JOIN t ON t.a = w.node JOIN recurring.w r ON r.node = t.b WHERE w.label < r.label GROUP BY t.b)
SELECT count(DISTINCT label) AS components, (SELECT count(*) FROM e) - count(*) + count(DISTINCT label) AS cycles FROM w""")
def betti_numbers(spark, sf_dir):
    """Components and independent cycles of a graph."""
    e = cut(pairs(spark, sf_dir).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct())
    c = graph.components(e).agg(F.countDistinct("component").alias("components"), F.count("*").alias("n"))
    both = c.crossJoin(F.broadcast(e.agg(F.count("*").alias("m"))))  # one row each
    return both.select("components", (F.col("m") - F.col("n") + F.col("components")).alias("cycles"))


@query(f"WITH {_E}, t AS (SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON y.a = x.b JOIN e z ON z.a = x.a AND z.b = y.b) SELECT node, CAST(sum(m) AS BIGINT) AS message FROM (SELECT unnest([a, b, c]) AS node, a * b % 97 + c AS m FROM t) GROUP BY node")
def triangle_messages(spark, sf_dir):
    """Messages of triangles summed at their corners."""
    t = graph.triangles(pairs(spark, sf_dir))
    m = F.col("a") * F.col("b") % 97 + F.col("c")
    return t.select(F.explode(F.array("a", "b", "c")).alias("node"), m.alias("m")).groupBy("node").agg(F.sum("m").alias("message"))


@query(f"""WITH RECURSIVE t AS ({_TREE}), n AS (SELECT max(node) AS n FROM t), h AS (SELECT node, 0 AS height, CAST(1 AS BIGINT) AS size FROM t WHERE node * 2 > (SELECT n FROM n)), s AS (SELECT node AS top, node FROM t UNION ALL SELECT s.top, t.node FROM s JOIN t ON t.parent = s.node)
SELECT size, count(*) AS copies FROM (SELECT top, count(*) AS size FROM s GROUP BY top) GROUP BY size""")
def structural_hash(spark, sf_dir):
    """Equal subtrees by bottom-up structural hashes: how many copies of each shape (named here by its size) there are."""
    t = tree(spark, sf_dir).withColumn("depth", F.floor(F.log2(F.col("node").cast("double")) + 1e-12).cast("int"))
    shape = lambda c: F.xxhash64(F.array_sort(F.collect_list(c)))
    hashes = graph.fold_levels(t.withColumn("leaf", F.lit(1).cast("long")), "leaf", shape).withColumnRenamed("v", "shape")
    ones = t.withColumn("leaf", F.lit(1).cast("long"))
    sizes = graph.fold_levels(ones, "leaf", lambda c: F.sum(c) + 1).withColumnRenamed("v", "size")
    return hashes.join(sizes, "node").groupBy("shape").agg(F.first("size").alias("size"), F.count("*").alias("copies")).select("size", "copies")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN NULL ELSE md5(text) END AS digest, strlen(text) > 4000 AND doc_id % 10 <> 4 AS shorter FROM documents")
def lz4_blocks(spark, sf_dir):
    """Texts as LZ4 blocks of a library's encoder, with back references, decoded again; broken blocks give null."""
    import pyarrow as pa

    def encoded(vs: list) -> list[list]:
        codec = pa.Codec("lz4_raw")
        return [[None if v is None else bytes(codec.compress(v)) for v in vs]]

    blocks = with_columns(raw(spark, sf_dir), "raw", "block binary", encoded)
    broken = F.unhex(F.lit("1061FFFF10"))  # a reference to before the start
    blocks = blocks.withColumn("block", F.when(F.col("doc_id") % 10 == 4, broken).otherwise(F.col("block")))
    out = hashing.with_lz4(blocks, "block")
    return out.select("doc_id", F.md5("plain").alias("digest"), F.coalesce((F.octet_length("block") < F.octet_length("plain")) & (F.octet_length("plain") > 4000), F.lit(False)).alias("shorter"))


_WIDE, _DEEP = 64, 5


def _hash_sql(row: str, of: str) -> str:
    return f"CAST('0x' || substr(md5({row} || ':' || {of}), 1, 12) AS BIGINT)"


@query(f"SELECT row, {_hash_sql('row', 'l_partkey')} // 2 % {_WIDE} AS bucket, CAST(sum(1 - 2 * ({_hash_sql('row', 'l_partkey')} % 2)) AS BIGINT) AS total FROM lineitem, range({_DEEP}) r(row) GROUP BY 1, 2")
def count_sketch(spark, sf_dir):
    """A Count-Sketch of the parts that are ordered: signed counts in hashed buckets."""
    return sketch.count_sketch(table(spark, sf_dir, "lineitem", "l_partkey"), F.col("l_partkey"), _DEEP, _WIDE)


@query(f"""WITH s AS (SELECT row, {_hash_sql('row', 'l_suppkey')} // 2 % {_WIDE} AS bucket, sum(1 - 2 * ({_hash_sql('row', 'l_suppkey')} % 2)) AS total FROM lineitem, range({_DEEP}) r(row) GROUP BY 1, 2),
q AS (SELECT s_suppkey AS item, row, {_hash_sql('row', 's_suppkey')} AS h FROM supplier, range({_DEEP}) r(row))
SELECT item, CAST(median(coalesce(total, 0) * (1 - 2 * (h % 2))) AS BIGINT) AS estimate FROM q LEFT JOIN s ON s.row = q.row AND s.bucket = q.h // 2 % {_WIDE} GROUP BY item""")
def sketch_estimates(spark, sf_dir):
    """Estimated frequencies: the median of an item's signed counters."""
    made = sketch.count_sketch(table(spark, sf_dir, "lineitem", "l_suppkey"), F.col("l_suppkey"), _DEEP, _WIDE)
    return sketch.estimates(made, table(spark, sf_dir, "supplier", "s_suppkey").withColumnRenamed("s_suppkey", "item"), _DEEP, _WIDE)


@query("SELECT c_nationkey, abs(n - exact) <= 0.1 * exact + 2 AS near, exact FROM (SELECT c_nationkey, count(DISTINCT c_custkey) AS n, count(DISTINCT c_custkey) AS exact FROM customer GROUP BY 1)")
def approximate_distinct(spark, sf_dir):
    """HyperLogLog counts beside exact ones. Equal pairs go first: both counts in one aggregate would hold a sketch a pair."""
    t = table(spark, sf_dir, "customer", "c_nationkey", "c_custkey").distinct().groupBy("c_nationkey").agg(F.approx_count_distinct("c_custkey", 0.02).alias("n"), F.count("c_custkey").alias("exact"))
    return t.select("c_nationkey", (F.abs(F.col("n") - F.col("exact")) <= 0.1 * F.col("exact") + 2).alias("near"), "exact")


_BI = f"{_PAIRS}, b AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs), t0 AS (SELECT p_partkey AS node, CAST(p_size AS DOUBLE) AS v FROM part)"


def _lap(k: int, of: str) -> str:
    return f"l{k} AS (SELECT {of}.node, {of}.v - coalesce(s / n, 0) AS v FROM {of} LEFT JOIN (SELECT b.src AS node, sum(x.v) AS s, count(*) AS n FROM b JOIN {of} x ON x.node = b.dst GROUP BY 1) USING (node))"


@query(f"WITH {_BI}, {_lap(1, 't0')}, t1 AS (SELECT * FROM l1), {_lap(2, 't1')}, t2 AS (SELECT t0.node, 2 * l2.v - t0.v AS v FROM l2 JOIN t0 USING (node)), {_lap(3, 't2')}, t3 AS (SELECT t1.node, 2 * l3.v - t1.v AS v FROM l3 JOIN t1 USING (node)) SELECT node, round(0.5123457 * t0.v - 0.2712347 * t1.v + 0.1312349 * t2.v + 0.0712341 * t3.v, 5) AS v FROM t0 JOIN t1 USING (node) JOIN t2 USING (node) JOIN t3 USING (node)")
def chebyshev_filter(spark, sf_dir):
    """A polynomial filter of a graph signal, by Chebyshev's recurrence over the random-walk Laplacian."""
    v = table(spark, sf_dir, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("v"))
    return graph.chebyshev(v, pairs(spark, sf_dir), [0.5123457, -0.2712347, 0.1312349, 0.0712341]).select("node", F.round("v", 5).alias("v"))


_CNF = "SELECT p_partkey AS k, [[1 + k0 % 4, -(1 + (k0 + 1 + s) % 4)], [-(1 + k0 % 4), 1 + (k0 + 2) % 4, 5], [(s % 4 + 1) * CASE WHEN s % 2 = 0 THEN 1 ELSE -1 END]] AS clauses FROM (SELECT p_partkey, p_partkey % 7 AS k0, p_size % 3 AS s FROM part)"


@query(f"""WITH c AS ({_CNF}), m AS (SELECT k, x, [len(list_filter(cl, lambda l: ((x >> (abs(l) - 1)) & 1 = 1) = (l > 0))) > 0 FOR cl IN clauses] AS held FROM c, range(32) r(x))
SELECT k, count(*) AS models FROM m WHERE NOT list_contains(held, false) GROUP BY k""")
def model_counts(spark, sf_dir):
    """Formulas compiled to deterministic decomposable circuits, whose models are then counted."""
    p = spread(table(spark, sf_dir, "part", "p_partkey", "p_size"), "p_partkey")
    k0, s = F.col("p_partkey") % 7, (F.col("p_size") % 3).cast("long")
    one = F.lit(1).cast("long")
    clauses = F.array(F.array(one + k0 % 4, -(one + (k0 + 1 + s) % 4)), F.array(-(one + k0 % 4), one + (k0 + 2) % 4, F.lit(5).cast("long")), F.array((s % 4 + 1) * F.when(s % 2 == 0, 1).otherwise(-1)))
    return circuits.model_counts(p.select(F.col("p_partkey").alias("k"), clauses.alias("clauses")), "k", "clauses", 5).where("models > 0")


@query(f"""WITH RECURSIVE t AS ({_TREE}), n AS (SELECT max(node) AS n FROM t), u(node, v, c) USING KEY (node) AS (SELECT node, CAST(node % 3 + 1 AS HUGEINT), 2 FROM t, n WHERE node * 2 > n UNION
 SELECT t.parent, CASE WHEN floor(log2(any_value(t.parent)) + 1e-12) % 2 = 0 THEN CAST(sum(u.v) % 1000003 AS HUGEINT) ELSE CAST(list_reduce(list(u.v), lambda a, b: a * b % 1000003, CAST(1 AS HUGEINT)) AS HUGEINT) END, 2
 FROM (SELECT r.node, r.v FROM recurring.u r) u JOIN t ON t.node = u.node JOIN n ON true LEFT JOIN recurring.u d ON d.node = t.parent WHERE t.parent IS NOT NULL AND d.node IS NULL GROUP BY t.parent HAVING count(*) = CASE WHEN any_value(2 * t.parent + 1) <= any_value(n.n) THEN 2 ELSE 1 END)
SELECT node, CAST(v AS BIGINT) AS v FROM u""")
def circuit_values(spark, sf_dir):
    """A circuit of sums and products evaluated level by level from its leaves, modulo 1,000,003."""
    t = tree(spark, sf_dir)
    depth = F.floor(F.log2(F.col("node").cast("double")) + 1e-12).cast("int")
    return circuits.evaluate(t.withColumn("depth", depth).withColumn("leaf", F.col("node") % 3 + 1), "leaf", 1_000_003)


@query("""WITH o AS (SELECT x, y, x <= y AS c FROM range(12) a(x), range(12) b(y)) SELECT x AS c, y AS d, (CASE WHEN 2 * x <= y THEN 1 ELSE 0 END) AS left_homs, (CASE WHEN x <= y // 2 THEN 1 ELSE 0 END) AS right_homs, true AS agree FROM o WHERE x < 6""")
def adjoint_pairs(spark, sf_dir):
    """Doubling and halving on finite orders are adjoint: as many arrows on either side of each pair."""
    order = lambda n: spark.range(n * n).select(F.call_function("div", F.col("id"), F.lit(n).cast("long")).alias("x"), (F.col("id") % n).alias("y")).withColumn("homs", (F.col("x") <= F.col("y")).cast("int"))
    f = spark.range(6).select(F.col("id").alias("c"), (F.col("id") * 2).alias("image"))
    g = spark.range(12).select(F.col("id").alias("d"), F.call_function("div", F.col("id"), F.lit(2).cast("long")).alias("image"))
    return circuits.adjoint_witness(order(6), order(12), f, g)


@query(f"""WITH RECURSIVE {_PAIRS}, spiders AS (SELECT p_partkey AS node, p_size % 2 AS colour, p_size % 8 AS phase FROM part), same AS (SELECT p.src AS a, p.dst AS b FROM pairs p JOIN spiders x ON x.node = p.src JOIN spiders y ON y.node = p.dst WHERE x.colour = y.colour AND p.src <> p.dst),
e AS (SELECT a, b FROM same UNION SELECT b, a FROM same), w(node, label) USING KEY (node) AS (SELECT node, node FROM spiders UNION SELECT e.b, min(w.label) FROM w JOIN e ON e.a = w.node JOIN recurring.w r ON r.node = e.b WHERE w.label < r.label GROUP BY e.b)
SELECT label AS node, any_value(colour) AS colour, CAST(sum(phase) % 8 AS BIGINT) AS phase, count(*) AS fused FROM w JOIN spiders USING (node) GROUP BY label""")
def spider_fusion(spark, sf_dir):
    """Spiders of one colour that are joined become one, with the sum of their phases."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    spiders = p.select(F.col("p_partkey").alias("node"), (F.col("p_size") % 2).alias("colour"), (F.col("p_size") % 8).alias("phase"))
    return circuits.fuse_spiders(spiders, pairs(spark, sf_dir), 8)


@query("SELECT word, dense_rank() OVER (ORDER BY word) - 1 AS id FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> ''")
def interned_words(spark, sf_dir):
    """Words with dense ids in their order: a perfect table of a vocabulary."""
    words = table(spark, sf_dir, "part", "p_name").select(F.explode(F.split("p_name", " ")).alias("word")).where("word <> ''").distinct()
    return sketch.interned(words, "word")


@query("""WITH f AS (SELECT p_partkey * 3 AS at, p_size AS v FROM part WHERE p_size % 2 = 0), d AS (SELECT p_partkey * 2 AS d FROM part)
SELECT d, (SELECT max(v) FROM f WHERE f.at <= d.d) AS "left", (SELECT min(v) FROM f WHERE f.at >= d.d) AS "right" FROM d""")
def kan_extensions(spark, sf_dir):
    """Left and right extensions of values along a map into an order: running extremes, no range join."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    f = p.where("p_size % 2 = 0").select((F.col("p_partkey") * 3).alias("at"), F.col("p_size").alias("v"))
    return circuits.kan_extensions(f, p.select((F.col("p_partkey") * 2).alias("d")))


@query("SELECT x AS c, CAST((x * 7) % 5 + 1 AS BIGINT) AS elements, CAST((x * 7) % 5 + 1 AS BIGINT) AS transformations, true AS agree FROM range(9) r(x)")
def yoneda_counts(spark, sf_dir):
    """Maps from what an object represents to a functor of sets, as many as the functor has elements there."""
    sizes = spark.range(9).select(F.col("id").alias("c"), (F.col("id") * 7 % 5 + 1).alias("n"))
    return circuits.yoneda_counts(sizes)
