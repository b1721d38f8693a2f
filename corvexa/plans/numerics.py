"""Dense numeric queries over embeddings and matrices derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvexa.functions import activations as A
from corvexa.operators import dense
from corvexa.registry import query, table

_V = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


@query(f"""SELECT id, round(list_dot_product(v, v), 5) AS dot, round(sqrt(list_dot_product(v, v)), 6) AS l2, round(v[1] / sqrt(list_dot_product(v, v) / len(v) + 1e-6), 6) AS rms_first, round(v[2] / sqrt(list_dot_product(v, v) + 1e-12), 6) AS l2_second,
 round(exp(v[1] - list_max(v)) / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 7) AS softmax_first, round(list_sum(list_transform(v, lambda x: sqrt(greatest(x, 0) * abs(x)))), 6) AS bhattacharyya FROM ({_V})""")
def vector_norms(spark, sf_dir):
    v = F.col("v")
    r = lambda c, n=6: F.round(c, n)
    return vectors(spark, sf_dir).select("id", r(dense.dot(v, v), 5).alias("dot"), r(dense.l2_norm(v)).alias("l2"), r(F.get(dense.rms_normed(v), F.lit(0))).alias("rms_first"), r(F.get(dense.l2_normed(v), F.lit(1))).alias("l2_second"), r(F.get(dense.softmaxed(v), F.lit(0)), 7).alias("softmax_first"), r(dense.bhattacharyya(v, F.transform(v, F.abs))).alias("bhattacharyya"))


@query(f"""WITH e AS ({_V}), p AS (SELECT q.id AS query, e.id, list_sum(list_transform(list_zip(e.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e JOIN e q ON q.id % 50 = 0 AND q.id <> e.id)
SELECT query, rank, id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM p) WHERE rank <= 5""")
def knn_graph(spark, sf_dir):
    """Edges to the five nearest of every vector whose id is divisible by 50, against all vectors."""
    v = vectors(spark, sf_dir)
    return dense.nearest(v, v.where("id % 50 = 0"), 5).select("query", "rank", "id", F.round("distance", 6).alias("distance"))


_M = "SELECT l_linenumber AS batch, l_suppkey % 8 AS i, l_partkey % 16 AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3"


@query(f"WITH m AS ({_M}) SELECT a.batch, a.i, b.i AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM m a JOIN m b ON a.batch = b.batch AND a.k = b.k GROUP BY 1, 2, 3")
def batch_matmul(spark, sf_dir):
    """Batched product of a matrix with its transpose (Gram matrices and tensor contractions alike)."""
    t = table(spark, sf_dir, "lineitem", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
    a = t.groupBy(F.col("l_linenumber").alias("batch"), (F.col("l_suppkey") % 8).alias("i"), (F.col("l_partkey") % 16).alias("k")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    return dense.matmul(a, a.select("batch", "k", F.col("i").alias("j"), "v"))


_GRID = "SELECT p_partkey // 40 AS y, p_partkey % 40 AS x, CAST(p_size AS DOUBLE) AS v FROM part"


def grid(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select(F.call_function("div", k, F.lit(40).cast("long")).alias("y"), (k % 40).alias("x"), F.col("p_size").cast("double").alias("v"))


_KERNEL = {(dy, dx): float((2 - abs(dy)) * (2 - abs(dx))) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}


@query(f"WITH g AS ({_GRID}) SELECT g.y, g.x, sum(n.v * (2 - abs(n.y - g.y)) * (2 - abs(n.x - g.x))) AS v FROM g JOIN g n ON n.y BETWEEN g.y - 1 AND g.y + 1 AND n.x BETWEEN g.x - 1 AND g.x + 1 GROUP BY 1, 2")
def conv2d_3x3(spark, sf_dir):
    return dense.stencil(grid(spark, sf_dir), _KERNEL)


@query(f"WITH g AS ({_GRID}) SELECT g.y, g.x, d.k, coalesce(n.v, 0) AS v FROM g, (SELECT k, k // 3 - 1 AS dy, k % 3 - 1 AS dx FROM range(9) r(k)) d LEFT JOIN g n ON n.y = g.y + d.dy AND n.x = g.x + d.dx")
def im2col_3x3(spark, sf_dir):
    return dense.patches(grid(spark, sf_dir)).select("y", "x", F.posexplode("patch").alias("k", "v")).select("y", "x", F.col("k").cast("long").alias("k"), "v")


@query("""SELECT id, [w & 15, (w >> 4) & 15, (w >> 28) & 15] AS fields, CASE WHEN (w >> 28) & 15 >= 8 THEN ((w >> 28) & 15) - 16 ELSE (w >> 28) & 15 END AS signed, w AS packed,
 CAST(list_sum(list_transform(range(0, 8), lambda k: CASE WHEN (w >> (4 * k)) & 15 >= 8 THEN ((w >> (4 * k)) & 15) - 16 ELSE (w >> (4 * k)) & 15 END * (k + 1))) AS BIGINT) AS dot, round(((w & 63) * 0.5) + 0.25, 3) AS int6, round((w & 255) * 0.125, 3) AS int8
 FROM (SELECT o_orderkey AS id, (o_orderkey * 2654435761) % 4294967296 AS w FROM orders)""")
def quantised_words(spark, sf_dir):
    """Four-bit fields unpacked, packed again and multiplied; six- and eight-bit values scaled."""
    from corvexa.functions import u32

    t = table(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("id"), u32.mul(F.col("o_orderkey"), 2654435761).alias("w"))
    t = t.withColumn("f", dense.unpack_fields(F.col("w"), 4, 8)).withColumn("s", dense.unpack_fields(F.col("w"), 4, 8, signed=True))
    weighted = F.aggregate(F.transform("s", lambda x, k: x * (k + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    w = F.col("w")
    return t.select("id", F.array(*[F.get("f", F.lit(k)) for k in (0, 1, 7)]).alias("fields"), F.get("s", F.lit(7)).alias("signed"), dense.pack_fields(F.col("f"), 4).alias("packed"), weighted.alias("dot"), F.round(w.bitwiseAND(F.lit(63)) * 0.5 + 0.25, 3).alias("int6"), F.round(w.bitwiseAND(F.lit(255)) * 0.125, 3).alias("int8"))


@query(f"SELECT id, sum(g * g) AS squares, round(least(1, 2 / sqrt(sum(g * g))), 6) AS factor, round(max(g * least(1, 2 / n)), 6) AS largest FROM (SELECT id, unnest(v) AS g, sqrt(list_dot_product(v, v)) AS n FROM ({_V})) GROUP BY id".replace("sum(g * g) AS squares, ", ""))
def dp_clip_per_sample(spark, sf_dir):
    """Per-sample gradient clipping to norm 2."""
    v = F.col("v")
    f = F.least(F.lit(1.0), 2 / dense.l2_norm(v))
    return vectors(spark, sf_dir).select("id", F.round(f, 6).alias("factor"), F.round(F.array_max(dense.scale(v, f)), 6).alias("largest"))


@query("""SELECT o_orderkey AS id, CASE WHEN z & 2147483647 >= 1000000000 THEN z ELSE 0 END AS iht, round(a / (2 * (1 + z % 7)), 6) AS rdp, round(a / greatest(z % 3, 0.001), 6) AS sinkhorn, round(pow(1 + sqrt(z % 10 / 10), 2), 6) AS mp_edge,
 round(a + 0.1 / 6 * (a + 2 * (a + 1) + 2 * (a + 2) + (a + 3)), 6) AS rk4, round(a + 0.05 * (z % 5), 6) AS euler, ((z % 49) - ((z % 49) * (z % 49) - 2) * (z % 11) + 49 * 600) % 49 AS hensel, ((3 * (z % 100) + 5 * (z % 30) + 7) >> 2) AS denoise
 FROM (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS z, CAST(o_custkey % 100 AS DOUBLE) AS a FROM orders)""")
def numeric_steps(spark, sf_dir):
    """Element-wise steps: hard threshold, Renyi accounting, guarded scaling, spectral edge, Runge-Kutta, Euler, Hensel, denoising."""
    from corvexa.functions import u32

    t = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("id"), u32.mul(F.col("o_orderkey"), 2654435761).alias("z"), (F.col("o_custkey") % 100).cast("double").alias("a"))
    z, a, r = F.col("z"), F.col("a"), lambda c: F.round(c, 6)
    x = z % 49
    made = {"iht": A.hard_threshold(z, F.lit(1_000_000_000)), "rdp": r(a / (2 * (1 + z % 7))), "sinkhorn": r(a / F.greatest((z % 3).cast("double"), F.lit(0.001))), "mp_edge": r(F.pow(1 + F.sqrt(z % 10 / 10), F.lit(2.0))), "rk4": r(A.rk4(a, a, a + 1, a + 2, a + 3, 0.1)), "euler": r(a + 0.05 * (z % 5)), "hensel": (x - (x * x - 2) * (z % 11) + 49 * 600) % 49, "denoise": F.shiftright(3 * (z % 100) + 5 * (z % 30) + 7, 2)}
    return t.select("id", *[c.alias(n) for n, c in made.items()])
