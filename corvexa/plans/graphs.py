"""Graph queries over edges derived from the orders: customer -> order (1), order -> part (2), part -> supplier (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvexa.operators import graph
from corvexa.registry import query, table

EDGES = """edges AS (SELECT o_custkey * 4 AS src, o_orderkey * 4 + 1 AS dst, 1 AS kind FROM orders UNION
 SELECT l_orderkey * 4 + 1, l_partkey * 4 + 2, 2 FROM lineitem UNION SELECT l_partkey * 4 + 2, l_suppkey * 4 + 3, 4 FROM lineitem)"""
SEEDS = "seeds AS (SELECT c_custkey * 4 AS node FROM customer WHERE c_nationkey = 3)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey"), table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    e = o.select((F.col("o_custkey") * 4).alias("src"), (F.col("o_orderkey") * 4 + 1).alias("dst"), F.lit(1).alias("kind"))
    e = e.unionByName(l.select((F.col("l_orderkey") * 4 + 1).alias("src"), (F.col("l_partkey") * 4 + 2).alias("dst"), F.lit(2).alias("kind")))
    return e.unionByName(l.select((F.col("l_partkey") * 4 + 2).alias("src"), (F.col("l_suppkey") * 4 + 3).alias("dst"), F.lit(4).alias("kind"))).distinct()


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").where("c_nationkey = 3").select((F.col("c_custkey") * 4).alias("node"))


@query(f"WITH {EDGES}, {SEEDS} SELECT DISTINCT dst AS node FROM edges JOIN seeds ON src = node WHERE kind & 1 <> 0")
def csr_forward_hop(spark, sf_dir):
    return graph.hop(seeds(spark, sf_dir), edges(spark, sf_dir), 1)


@query(f"WITH {EDGES} SELECT DISTINCT src AS node FROM edges WHERE dst IN (SELECT s_suppkey * 4 + 3 FROM supplier WHERE s_nationkey = 7) AND kind & 4 <> 0")
def csr_backward_hop(spark, sf_dir):
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").where("s_nationkey = 7").select((F.col("s_suppkey") * 4 + 3).alias("node"))
    return graph.hop(s, edges(spark, sf_dir), 4, backward=True)


@query(f"WITH {EDGES}, {SEEDS} SELECT DISTINCT dst AS node FROM edges JOIN seeds ON src = node WHERE dst % 3 <> 0")
def csr_hop_excluding(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.hop_excluding(seeds(spark, sf_dir), e, e.where("dst % 3 = 0").select(F.col("dst").alias("node")).distinct())


@query(f"WITH {EDGES}, {SEEDS} SELECT node, bool_or(fresh) AND NOT bool_or(NOT fresh) AS fresh FROM (SELECT node, false AS fresh FROM seeds UNION SELECT dst, true FROM edges JOIN seeds ON src = node) GROUP BY node")
def csr_hop_or_changed(spark, sf_dir):
    """One accumulating hop; ``fresh`` marks what is new."""
    seen = seeds(spark, sf_dir)
    every, new = graph.grow(seen, edges(spark, sf_dir))
    return every.join(new.withColumn("fresh", F.lit(True)), "node", "left").select("node", F.coalesce("fresh", F.lit(False)).alias("fresh"))


@query(f"WITH {EDGES}, {SEEDS} SELECT count(*) AS degree FROM edges JOIN seeds ON src = node")
def frontier_degree_sum(spark, sf_dir):
    return graph.degree_sum(seeds(spark, sf_dir), edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES}, {SEEDS}, walk AS (SELECT node, 0 AS depth FROM seeds UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node)
SELECT node, min(depth) AS depth FROM walk GROUP BY node""")
def reachable_closure(spark, sf_dir):
    return graph.closure(seeds(spark, sf_dir), edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES}, walk AS (SELECT c_nationkey AS query_id, c_custkey * 4 AS node, 0 AS depth FROM customer WHERE c_nationkey < 4 UNION SELECT query_id, dst, depth + 1 FROM walk JOIN edges ON src = node)
SELECT query_id, node, min(depth) AS depth FROM walk GROUP BY query_id, node""")
def bfs_batch(spark, sf_dir):
    """Several searches in one run, kept apart by ``query_id``."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").where("c_nationkey < 4")
    return graph.closure(c.select(F.col("c_nationkey").alias("query_id"), (F.col("c_custkey") * 4).alias("node")), edges(spark, sf_dir), by=("query_id",))


_PAIRS = """pairs AS (SELECT DISTINCT p_partkey AS src, CASE k WHEN 0 THEN (p_partkey * 7 + p_size) % n ELSE (p_partkey + 1 + p_size % 7) % n END AS dst
 FROM part, (SELECT count(*) AS n FROM part), range(2) r(k))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edges of every part, a far one and a near one, to other parts: the nodes grow with the table."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    n, k, size = max(1, p.count()), F.col("p_partkey"), F.col("p_size")
    return p.select(k.alias("src"), F.explode(F.array((k * 7 + size) % n, (k + 1 + size % 7) % n)).alias("dst")).distinct()


_BOTH = "e AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs)"


def walk_sql(name: str, start: str, steps: str) -> str:
    """DuckDB: (node, depth) of all that is reachable, each node once: a keyed recursion."""
    return f"""{name}(node, depth) USING KEY (node) AS ({start} UNION SELECT s.dst, min(w.depth) + 1 FROM {name} w JOIN {steps} s ON s.src = w.node LEFT JOIN recurring.{name} r ON r.node = s.dst WHERE r.node IS NULL GROUP BY s.dst)"""


@query(f"""WITH RECURSIVE {_PAIRS}, {_BOTH}, w(node, component) USING KEY (node) AS (SELECT DISTINCT src, src FROM e UNION
 SELECT e.dst, min(w.component) FROM w JOIN e ON e.src = w.node JOIN recurring.w r ON r.node = e.dst WHERE w.component < r.component GROUP BY e.dst)
SELECT node, component FROM w WHERE node IN (SELECT src FROM e WHERE src <> dst)""")
def connected_components(spark, sf_dir):
    """Alias classes by union: the smallest node id of each component."""
    return graph.components(pairs(spark, sf_dir))


@query(f"""WITH RECURSIVE {_PAIRS}, {walk_sql("f", "SELECT CAST(1 AS BIGINT), 0", "pairs")}, {walk_sql("b", "SELECT CAST(1 AS BIGINT), 0", "(SELECT dst AS src, src AS dst FROM pairs)")}
SELECT node, CAST(1 AS BIGINT) AS component FROM f WHERE node IN (SELECT node FROM b)""")
def scc_of_pivot(spark, sf_dir):
    """The strongly connected component of a pivot: what it reaches and what reaches it."""
    e = pairs(spark, sf_dir)
    one = spark.createDataFrame([(1,)], "node long")
    return graph.same_component(graph.closure(one, e), graph.closure(one, e, backward=True), 1)


_GROUPED = "arcs AS (SELECT DISTINCT g * 40 + src AS src, g * 40 + dst AS dst FROM (SELECT p_partkey // 40 AS g, p_partkey % 40 AS src, (p_partkey % 40 + 1 + p_size % 3) % (5 + p_size % 35) AS dst FROM part))"


@query(f"""WITH RECURSIVE {_GROUPED}, nodes AS (SELECT src AS node FROM arcs UNION SELECT dst FROM arcs), w AS (SELECT node AS a, node AS b FROM nodes UNION SELECT w.a, arcs.dst FROM w JOIN arcs ON arcs.src = w.b)
SELECT x.a AS node, min(x.b) AS component FROM w x JOIN w y ON y.a = x.b AND y.b = x.a GROUP BY x.a""")
def scc_decompose(spark, sf_dir):
    """Strongly connected components of a whole graph of many small knots."""
    k, size = F.col("p_partkey"), F.col("p_size")
    g, place = F.call_function("div", k, F.lit(40).cast("long")), k % 40
    e = table(spark, sf_dir, "part", "p_partkey", "p_size").select((g * 40 + place).alias("src"), (g * 40 + (place + 1 + size % 3) % (5 + size % 35)).alias("dst"))
    return graph.strong_components(e)


@query(f"WITH RECURSIVE {EDGES}, {walk_sql('w', 'SELECT c_custkey * 4, 0 FROM customer WHERE c_nationkey IN (3, 5)', 'edges')} SELECT node FROM w")
def closure_warm_start(spark, sf_dir):
    """A closure taken up again with more seeds: only what the first one lacks is followed."""
    e = edges(spark, sf_dir)
    more = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").where("c_nationkey = 5").select((F.col("c_custkey") * 4).alias("node"))
    return graph.closure(more, e, known=graph.closure(seeds(spark, sf_dir), e)).select("node")


@query(f"WITH {EDGES} SELECT node, max(level) AS level FROM (SELECT src AS node, CASE src % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS level FROM edges UNION ALL SELECT dst, CASE dst % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END FROM edges) GROUP BY node")
def toposort_levels(spark, sf_dir):
    """Waves of a topological order: every node after all its predecessors."""
    return graph.levels(edges(spark, sf_dir))


_TREE = "SELECT c_custkey + 1 AS node, CASE WHEN c_custkey = 0 THEN NULL ELSE (c_custkey + 1) // 2 END AS parent FROM customer"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") + 1
    return table(spark, sf_dir, "customer", "c_custkey").select(k.alias("node"), F.when(k > 1, F.call_function("div", k, F.lit(2).cast("long"))).alias("parent"), k.alias("ord"))


_WALK = f"t AS ({_TREE}), w AS (SELECT node, [node] AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.node, list_append(w.path, t.node) FROM w JOIN t ON t.parent = w.node)"


@query(f"WITH RECURSIVE {_WALK} SELECT node, row_number() OVER (ORDER BY path) - 1 AS place FROM w")
def ast_walk_preorder(spark, sf_dir):
    return graph.tree_order(tree(spark, sf_dir))


@query(f"WITH RECURSIVE {_WALK} SELECT node, row_number() OVER (ORDER BY list_append(path, 9223372036854775807)) - 1 AS place FROM w")
def ast_walk_postorder(spark, sf_dir):
    return graph.tree_order(tree(spark, sf_dir), post=True)


@query(f"WITH RECURSIVE {_WALK} SELECT node, list_reverse(path) AS path FROM w")
def path_reconstruct(spark, sf_dir):
    """The way to the root of every node."""
    t = tree(spark, sf_dir)
    return graph.paths(t, t)


@query(f"""WITH RECURSIVE t AS ({_TREE}), d AS (SELECT node, node AS leaf, parent FROM t WHERE node * 2 > (SELECT max(node) FROM t) UNION ALL SELECT t.node, d.leaf, t.parent FROM d JOIN t ON t.node = d.parent)
SELECT node, CAST(sum(leaf % 10) AS BIGINT) AS v FROM d GROUP BY node""")
def sum_product_levels(spark, sf_dir):
    """Sums of the leaves below each node: a bottom-up wave over the depths (circuits and level waves alike)."""
    t = tree(spark, sf_dir)
    depth = F.floor(F.log2(F.col("node").cast("double")) + 1e-12).cast("int")
    return graph.fold_levels(t.withColumn("depth", depth).withColumn("leaf", F.col("node") % 10), "leaf", F.sum)


_EVEN = "e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM pairs WHERE src <> dst)"


@query(f"WITH {_PAIRS}, {_EVEN} SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON y.a = x.b JOIN e z ON z.a = x.a AND z.b = y.b")
def motif_triangles(spark, sf_dir):
    return graph.triangles(pairs(spark, sf_dir))


@query(f"""WITH {_PAIRS}, v AS (SELECT p_partkey AS node, CAST(p_size AS DOUBLE) AS v FROM part), e AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs),
s AS (SELECT src AS node, sum(v - (SELECT 0)) AS s, count(*) AS n FROM e JOIN v ON node = dst GROUP BY src) SELECT node, round(v + coalesce(0.1 * (s.s - s.n * v), 0), 6) AS v FROM v LEFT JOIN s USING (node)""")
def sheaf_diffusion(spark, sf_dir):
    v = table(spark, sf_dir, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("v"))
    return graph.diffuse(v, pairs(spark, sf_dir), 0.1).select("node", F.round("v", 6).alias("v"))


@query("SELECT i AS pos, CAST(coalesce(max_v, 0) AS BIGINT) AS v FROM range((SELECT max(p_partkey) * 3 + 2 FROM part)) r(i) LEFT JOIN (SELECT (p_partkey * 3 + 1) AS t, arg_max(p_size, p_partkey) AS max_v FROM part GROUP BY 1) ON t = i")
def functor_apply(spark, sf_dir):
    """Values moved along a map of positions: every position up to the last target has its place."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    mapping = p.select(F.col("p_partkey").alias("pos"), (F.col("p_partkey") * 3 + 1).alias("to"))
    last = mapping.agg(F.max("to")).first()[0]
    return graph.remap(p.select(F.col("p_partkey").alias("pos"), F.col("p_size").cast("long").alias("v")), mapping, -1 if last is None else last + 1)


@query("""WITH RECURSIVE f AS (SELECT c_custkey // 32 AS g, c_custkey % 32 AS n FROM customer), s AS (SELECT g, n, 2 * (CASE n % 2 WHEN 1 THEN n + 1 ELSE n - 1 END) + 1 AS c FROM f WHERE n > 0),
arcs AS (SELECT g, (n - 1) // 2 AS src, n AS dst FROM f WHERE n > 0 UNION SELECT s.g, s.n, s.c FROM s JOIN f ON f.g = s.g AND f.n = s.c),
w AS (SELECT DISTINCT g, n AS cut, CAST(0 AS BIGINT) AS node FROM f WHERE n > 0 UNION SELECT w.g, w.cut, a.dst FROM w JOIN arcs a ON a.g = w.g AND a.src = w.node WHERE a.dst <> w.cut),
d AS (SELECT x.g, x.n AS node, y.n AS dom FROM f x JOIN f y ON y.g = x.g AND y.n <> x.n WHERE y.n = 0 OR NOT EXISTS (SELECT 1 FROM w WHERE w.g = x.g AND w.cut = y.n AND w.node = x.n)),
k AS (SELECT g, node, count(*) AS k FROM d GROUP BY g, node)
SELECT d.g, d.node, arg_max(d.dom, coalesce(k.k, 0)) AS idom FROM d LEFT JOIN k ON k.g = d.g AND k.node = d.dom WHERE d.node > 0 GROUP BY d.g, d.node UNION ALL SELECT g, n, n FROM f WHERE n = 0""")
def dominator_tree(spark, sf_dir):
    """Immediate dominators of many flow graphs: in each, a tree and from each node an edge to its sibling's first child."""
    c = F.col("c_custkey")
    f = table(spark, sf_dir, "customer", "c_custkey").select(F.call_function("div", c, F.lit(32).cast("long")).alias("g"), (c % 32).alias("n"))
    n = F.col("n")
    down = f.where("n > 0").select("g", F.call_function("div", n - 1, F.lit(2).cast("long")).alias("src"), n.alias("dst"))
    across = f.where("n > 0").select("g", n.alias("src"), (2 * F.when(n % 2 == 1, n + 1).otherwise(n - 1) + 1).alias("dst")).join(f.select("g", n.alias("dst")), ["g", "dst"], "left_semi")
    return graph.dominators(down.unionByName(across), 0, "g")


@query(f"WITH RECURSIVE {_PAIRS}, {walk_sql('d', 'SELECT CAST(1 AS BIGINT), 0', 'pairs')} SELECT count(*) > 0 AS violation FROM d WHERE node % 97 = 5")
def backdoor_check(spark, sf_dir):
    """Whether a candidate adjustment set holds a descendant of the treatment."""
    e = pairs(spark, sf_dir)
    below = graph.closure(spark.createDataFrame([(1,)], "node long"), e)
    z = e.select(F.col("dst").alias("node")).where("node % 97 = 5").distinct()
    return below.join(z, "node", "left_semi").agg((F.count("*") > 0).alias("violation"))


@query(f"WITH {_PAIRS} SELECT CASE WHEN src % 5 = 1 THEN dst ELSE src END AS src, CASE WHEN src % 5 = 1 THEN src ELSE dst END AS dst FROM pairs WHERE dst % 7 <> 2")
def do_calculus_edges(spark, sf_dir):
    """Edge surgery of do-calculus: incoming edges of the treated go, those of a second set turn round."""
    e = graph.keep(pairs(spark, sf_dir), F.col("dst") % 7 != 2)
    turned = F.col("src") % 5 == 1
    return e.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"))


@query(f"WITH {_PAIRS}, f AS (SELECT unnest([0, 1, 2]) AS fact) SELECT DISTINCT src, a.fact AS from_fact, dst, a.fact AS to_fact FROM pairs, f a WHERE NOT (dst % 4 = 0 AND a.fact = 1) UNION SELECT DISTINCT src, 0, dst, 2 FROM pairs WHERE src % 4 = 1")
def exploded_ifds_edges(spark, sf_dir):
    """Edges of the exploded graph: every fact flows on unless killed; generated facts start from the zero fact."""
    e = pairs(spark, sf_dir)
    facts = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    flow = e.select("src", facts.alias("from_fact"), "dst").withColumn("to_fact", F.col("from_fact")).where("NOT (dst % 4 = 0 AND from_fact = 1)")
    made = e.where("src % 4 = 1").select("src", F.lit(0).alias("from_fact"), "dst", F.lit(2).alias("to_fact"))
    return flow.unionByName(made).distinct()


@query(f"WITH {_PAIRS} SELECT DISTINCT dst AS node, c AS context, CASE WHEN dst % 2 = 0 THEN f ELSE 0 END AS field FROM pairs JOIN (SELECT p_partkey AS node, p_size % 3 AS c, p_size % 2 AS f FROM part WHERE p_size < 10) ON node = src WHERE dst % 3 <> c")
def tensor_flow_hop(spark, sf_dir):
    """One hop keyed by node, context and field; an edge passes or drops contexts and clears fields."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size").where("p_size < 10")
    front = p.select(F.col("p_partkey").alias("src"), (F.col("p_size") % 3).alias("context"), (F.col("p_size") % 2).alias("f"))
    out = pairs(spark, sf_dir).join(front, "src").where("dst % 3 <> context")
    return out.select(F.col("dst").alias("node"), "context", F.when(F.col("dst") % 2 == 0, F.col("f")).otherwise(F.lit(0)).alias("field")).distinct()


@query(f"WITH {_PAIRS} SELECT a.src AS i, b.dst AS j, count(*) AS v FROM pairs a JOIN pairs b ON b.src = a.dst GROUP BY 1, 2")
def monoidal_compose(spark, sf_dir):
    """A relation composed with itself: how many ways of two steps there are."""
    from corvexa.operators.semiring import product

    m = pairs(spark, sf_dir).select(F.col("src").alias("i"), F.col("dst").alias("k"), F.lit(1).cast("long").alias("v"))
    return product(m, m.select(F.col("i").alias("k"), F.col("k").alias("j"), "v"), "real")


@query("""WITH p AS (SELECT p_partkey AS id, CAST(p_partkey * 37 % 1000 AS BIGINT) AS x, CAST(p_partkey * 91 % 1000 AS BIGINT) AS y FROM part)
SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 400""")
def vietoris_rips_edges(spark, sf_dir):
    """Pairs of points at most eps apart: places meet in grid cells of that size and their neighbours, no cross join.

    Only the pairs themselves are many where points lie at one place: places are compared once, their points meet in
    blocks, and all joins are by sorted runs, so nothing is sent to the driver or held whole.
    """
    return graph.near_pairs(table(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 1000).alias("x"), (F.col("p_partkey") * 91 % 1000).alias("y")), 20)


@query("""WITH n AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem)
SELECT DISTINCT b AS node FROM n WHERE a < 10 AND b NOT IN (SELECT a FROM n WHERE a < 10) AND b % 4 <> 1""")
def matroid_exchange_step(spark, sf_dir):
    """One breadth-first layer of an exchange graph: reachable, not visited, and independent."""
    e = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    seen = e.where("src < 10").select(F.col("src").alias("node")).distinct()
    return graph.grow(seen, e)[1].where("node % 4 <> 1")
