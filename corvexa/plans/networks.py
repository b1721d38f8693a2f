"""Network layers over embeddings: activations, gates, rotary embeddings, experts, paging, gradients, optimiser steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvexa.functions import activations as A
from corvexa.functions.arrow import spread
from corvexa.operators import dense, layers, reduce
from corvexa.registry import query, table

from .numerics import _V, vectors

_S = "(1 / (1 + exp(-x)))"


@query(f"""SELECT id, pos, round(greatest(x, 0), 6) AS relu, round(0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x))), 6) AS gelu, round(x * {_S}, 6) AS silu, round(x * {_S} * u, 6) AS swiglu,
 round(pow(greatest(0.5 * x, x), 2), 6) AS leaky, round(tanh(x / 30) * 30, 6) AS softcap, round(u * {_S}, 6) AS gated, round({_S} * u + (1 - {_S}) * x, 6) AS skip, round(x + u, 6) AS residual,
 round(u * CASE WHEN x > 0 THEN 2 * x ELSE 0.5 * x END, 6) AS leaky_grad, round(u * (1 - pow(tanh(x / 30), 2)), 6) AS softcap_grad, round(u * (u - x) * {_S} * (1 - {_S}), 6) AS gate_grad
 FROM (SELECT id, unnest(v) AS x, unnest(list_reverse(v)) AS u, CAST(unnest(range(len(v))) AS BIGINT) AS pos FROM ({_V}))""")
def activations(spark, sf_dir):
    t = vectors(spark, sf_dir).select("id", F.posexplode(F.arrays_zip("v", F.reverse("v").alias("u"))).alias("pos", "e"))
    t = t.select("id", F.col("pos").cast("long").alias("pos"), F.col("e.v").alias("x"), F.col("e.u").alias("u"))
    x, u = F.col("x"), F.col("u")
    made = {"relu": A.relu(x), "gelu": A.gelu(x), "silu": A.silu(x), "swiglu": A.swiglu(x, u), "leaky": A.leaky_relu_sq(x), "softcap": A.softcap(x, 30.0), "gated": A.sigmoid_gate(u, x), "skip": A.skip_gate(u, x, x), "residual": x + u, "leaky_grad": A.leaky_relu_sq_grad(x, u), "softcap_grad": A.softcap_grad(x, u, 30.0), "gate_grad": A.skip_gate_grad(u, x, x, u)[2]}
    return t.select("id", "pos", *[F.round(c, 6).alias(n) for n, c in made.items()])


@query(f"""SELECT id, round(v[1] * cos(id) - v[5] * sin(id), 6) AS first, round(v[5] * cos(id) + v[1] * sin(id), 6) AS fifth, round(v[2] * cos(id * pow(10000, -0.25)) - v[6] * sin(id * pow(10000, -0.25)), 6) AS second, round(v[9], 6) AS ninth, round(v[1], 6) AS back FROM ({_V})""")
def partial_rope(spark, sf_dir):
    """Rotary embedding of the first eight components at position id, and its inverse."""
    t = vectors(spark, sf_dir).withColumn("r", dense.rope(F.col("v"), F.col("id"), 8))
    at = lambda c, k: F.round(F.get(c, F.lit(k)), 6)
    return t.select("id", at("r", 0).alias("first"), at("r", 4).alias("fifth"), at("r", 1).alias("second"), at("r", 8).alias("ninth"), at(dense.rope(F.col("r"), F.col("id"), 8, backward=True), 0).alias("back"))


@query(f"""SELECT page, round(score, 5) AS score, rank FROM (SELECT id // 16 AS page, max(list_dot_product(v, (SELECT v FROM ({_V}) WHERE id = 0))) AS score, row_number() OVER (ORDER BY max(list_dot_product(v, (SELECT v FROM ({_V}) WHERE id = 0))) DESC, id // 16) - 1 AS rank FROM ({_V}) GROUP BY 1) WHERE rank < 7""")
def quest_paging(spark, sf_dir):
    """The pages of keys that score best for a query vector."""
    v = vectors(spark, sf_dir)
    q = v.where("id = 0").select(F.col("v").alias("q"))  # one row
    scored = v.crossJoin(F.broadcast(q)).groupBy(F.call_function("div", F.col("id"), F.lit(16).cast("long")).alias("page")).agg(F.max(dense.dot(F.col("v"), F.col("q"))).alias("score"))
    return reduce.top_k(scored, 7, F.desc("score"), F.asc("page")).select("page", F.round("score", 5).alias("score"), "rank")


@query(f"""WITH e AS ({_V}), s AS (SELECT q.id AS q, k.id, k.v, list_dot_product(q.v, k.v) / 8 AS s FROM e q JOIN e k ON k.id // 32 = q.id // 32 AND k.id <= q.id), w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY q)) AS w FROM s)
SELECT id, j, round(sum(w * x) / any_value(t), 6) AS y FROM (SELECT q AS id, w, sum(w) OVER (PARTITION BY q) AS t, v FROM w), unnest(v) WITH ORDINALITY u(x, n), (SELECT unnest(range(64)) AS j) WHERE j = n - 1 GROUP BY id, j""")
def attention(spark, sf_dir):
    """Causal attention within blocks of 32 tokens: scores, stable weights, weighted values of every component."""
    v = vectors(spark, sf_dir).withColumn("block", F.call_function("div", F.col("id"), F.lit(32).cast("long")))
    pairs = v.select("block", F.col("id").alias("q"), F.col("v").alias("qv")).join(v, "block").where("id <= q")
    s = pairs.select("q", "v", (dense.dot(F.col("qv"), F.col("v")) / 8).alias("s"))
    own = Window.partitionBy("q")
    w = s.withColumn("w", F.exp(F.col("s") - F.max("s").over(own))).withColumn("w", F.col("w") / F.sum("w").over(own))
    each = w.select("q", "w", F.posexplode("v").alias("j", "x"))
    return each.groupBy(F.col("q").alias("id"), F.col("j").cast("long").alias("j")).agg(F.round(F.sum(F.col("w") * F.col("x")), 6).alias("y"))


@query(f"""SELECT vec_id * 4 + h AS token, h AS head, round(list_sum(embedding::DOUBLE[][h * 16 + 1:h * 16 + 16]), 5) AS total FROM embeddings, range(4) r(h)""".replace("embedding::DOUBLE[][h", "CAST(embedding AS DOUBLE[])[h"))
def attention_layouts(spark, sf_dir):
    """Token-major vectors dealt to heads: an index projection."""
    v = vectors(spark, sf_dir).select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("h"), "v")
    return v.select((F.col("id") * 4 + F.col("h")).alias("token"), F.col("h").cast("long").alias("head"), F.round(dense.total(F.slice("v", F.col("h") * 16 + 1, 16)), 5).alias("total"))


@query("SELECT c_custkey AS pos, CASE WHEN c_custkey BETWEEN 100 AND 149 THEN -(c_custkey - 100) ELSE c_custkey * 3 END AS v FROM customer")
def kv_cache_append(spark, sf_dir):
    """A cache with one contiguous range replaced by new tokens."""
    old = table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("pos"), (F.col("c_custkey") * 3).alias("v"))
    new = spark.range(50).select((F.col("id") + 100).alias("pos"), (-F.col("id")).alias("v"))
    return old.join(new.select("pos", F.col("v").alias("n")), "pos", "left").select("pos", F.coalesce("n", "v").alias("v"))


@query(f"SELECT l_orderkey, l_linenumber, round(e.v, 6) AS first, round(e.t, 4) AS total FROM lineitem JOIN (SELECT id, v[1] AS v, list_sum(v) AS t FROM ({_V})) e ON e.id = l_partkey % (SELECT count(*) FROM embeddings)")
def embedding_lookup(spark, sf_dir):
    """Part keys folded by the number of rows of the table that is looked up, so that every row can be met."""
    v = vectors(spark, sf_dir)
    e = v.select("id", F.get("v", F.lit(0)).alias("x"), dense.total(F.col("v")).alias("total"))
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").withColumn("id", F.col("l_partkey") % max(1, v.count()))
    return t.join(e, "id").select("l_orderkey", "l_linenumber", F.round("x", 6).alias("first"), F.round("total", 4).alias("total"))


@query(f"WITH t AS (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS k FROM ({_V})), s AS (SELECT id, 2 * stddev_pop(x) AS c FROM t GROUP BY id) SELECT id, k AS pos, round(least(greatest(x, -c), c), 6) AS clipped, least(greatest(round(x / 0.1), 0), 15) AS rounded FROM t JOIN s USING (id)")
def gptq_round_clip(spark, sf_dir):
    """Values clipped at two deviations of their vector, and rounded to four bits."""
    v = F.col("v")
    # A mean and a deviation a vector: within the inner function, or beside the explode, they would be worked out for each value.
    mean = dense.total(v) / F.size(v)
    dev = F.get(F.transform(F.array(mean), lambda m: F.sqrt(dense.total(F.transform(v, lambda x: (x - m) * (x - m))) / F.size(v))), F.lit(0))
    t = spread(vectors(spark, sf_dir), "id").select("id", "v", (2 * dev).alias("c")).select("id", "c", F.posexplode("v").alias("pos", "x"))
    return t.select("id", F.col("pos").cast("long").alias("pos"), F.round(A.clip(F.col("x"), F.col("c")), 6).alias("clipped"), A.gptq_round(F.col("x"), F.lit(0.1), 15).alias("rounded"))


@query(f"""WITH RECURSIVE t AS (SELECT id // 50 AS g, id % 50 AS n, v[1] AS x, 1 / (1 + exp(-v[2])) AS a FROM ({_V})), r AS (SELECT g, n, a * x AS h FROM t WHERE n = 0 UNION ALL SELECT t.g, t.n, (1 - t.a) * r.h + t.a * t.x FROM r JOIN t ON t.g = r.g AND t.n = r.n + 1)
SELECT g, n, round(h, 6) AS h FROM r""")
def gated_recurrence(spark, sf_dir):
    """A gated recurrence along each sequence: h = (1 - a) h + a x."""
    t = vectors(spark, sf_dir).select(F.call_function("div", F.col("id"), F.lit(50).cast("long")).alias("g"), (F.col("id") % 50).alias("n"), F.get("v", F.lit(0)).alias("x"), A.sigmoid(F.get("v", F.lit(1))).alias("a"))
    t = t.select("g", "n", (1 - F.col("a")).alias("keep"), (F.col("a") * F.col("x")).alias("add"))
    return layers.linear_recurrence(t, "g", "n", "keep", "add").select("g", "n", F.round("h", 6).alias("h"))
