"""Image queries: pixels and planes derived from parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvexa.functions import u32
from corvexa.operators import dense
from corvexa.registry import query, table

from .numerics import _GRID, grid


def channel(p: Column, k: int) -> Column:
    """Channel k (0 the lowest byte) of a packed pixel."""
    return u32.unpack(p, 8, k)


def packed(*channels: Column) -> Column:
    out = F.lit(0).cast("long")
    for k, c in enumerate(channels):
        out = out.bitwiseOR(F.shiftleft(c.cast("long"), 8 * k))
    return out


def alpha_over(fg: Column, bg: Column) -> Column:
    """Porter-Duff over with the top byte as alpha, in rounded integer arithmetic."""
    a = channel(fg, 3)
    mix = lambda k: F.floor((channel(fg, k) * a + channel(bg, k) * (255 - a) + 127) / 255)
    return packed(mix(0), mix(1), mix(2), a + F.floor((channel(bg, 3) * (255 - a) + 127) / 255))


_PX = "SELECT p_partkey AS id, (p_partkey * 2654435761) % 4294967296 AS f, (p_partkey * 40503 * 65537) % 4294967296 AS b FROM part"


def pixels(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part", "p_partkey").select(k.alias("id"), u32.mul(k, 2654435761).alias("f"), (k * 40503 * 65537 % u32.WORD).alias("b"))


@query(f"WITH p AS ({_PX}), c AS (SELECT id, f >> 24 AS a, b >> 24 AS ba, [(f >> (8 * 0)) & 255, (f >> 8) & 255, (f >> 16) & 255] AS x, [b & 255, (b >> 8) & 255, (b >> 16) & 255] AS y FROM p) SELECT id, ((x[1] * a + y[1] * (255 - a) + 127) // 255) | (((x[2] * a + y[2] * (255 - a) + 127) // 255) << 8) | (((x[3] * a + y[3] * (255 - a) + 127) // 255) << 16) | ((a + (ba * (255 - a) + 127) // 255) << 24) AS pixel FROM c")
def alpha_over_pixels(spark, sf_dir):
    return pixels(spark, sf_dir).select("id", alpha_over(F.col("f"), F.col("b")).alias("pixel"))


@query(f"SELECT id, ((f & 255) * 77 + ((f >> 8) & 255) * 150 + ((f >> 16) & 255) * 29) >> 8 AS grey, 4294967295 - f AS inverted, (f & 255) | (((f >> 8) & 254) << 8) AS tinted FROM ({_PX})")
def filter_chain(spark, sf_dir):
    """Grey, inversion and tint stages in one projection."""
    f = F.col("f")
    return pixels(spark, sf_dir).select("id", F.shiftright(channel(f, 0) * 77 + channel(f, 1) * 150 + channel(f, 2) * 29, 8).alias("grey"), u32.bit_not(f).alias("inverted"), packed(channel(f, 0), channel(f, 1).bitwiseAND(F.lit(254))).alias("tinted"))


@query(f"SELECT y // 2 AS y, x // 2 AS x, round(avg(v), 6) AS v FROM ({_GRID}) GROUP BY 1, 2")
def downsample_2x(spark, sf_dir):
    half = lambda c: F.call_function("div", F.col(c), F.lit(2).cast("long")).alias(c)
    return grid(spark, sf_dir).groupBy(half("y"), half("x")).agg(F.round(F.avg("v"), 6).alias("v"))


@query(f"SELECT y * 2 + dy AS y, x * 2 + dx AS x, v FROM ({_GRID}), range(2) a(dy), range(2) b(dx)")
def upsample_2x(spark, sf_dir):
    both = F.explode(F.array(F.lit(0), F.lit(1)))
    return grid(spark, sf_dir).withColumn("dy", both).withColumn("dx", both).select((F.col("y") * 2 + F.col("dy")).alias("y"), (F.col("x") * 2 + F.col("dx")).alias("x"), "v")


@query(f"WITH g AS ({_GRID}), h AS (SELECT y, x, sum(v) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM g) SELECT y, x, round(sum(v) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 25, 6) AS v FROM h")
def box_blur(spark, sf_dir):
    """A separable box blur, zero outside: rows, then columns."""
    rows = dense.stencil(grid(spark, sf_dir), {(0, d): 1.0 for d in range(-2, 3)})
    return dense.stencil(rows, {(d, 0): 1.0 for d in range(-2, 3)}).select("y", "x", F.round(F.col("v") / 25, 6).alias("v"))


@query("SELECT y, x, CAST((255 * x + 0 * (63 - x)) // 63 AS BIGINT) AS level, CASE WHEN x BETWEEN 16 AND 47 AND y BETWEEN 16 AND 47 THEN 255 ELSE greatest(0, 255 - 16 * greatest(greatest(16 - x, x - 47), greatest(16 - y, y - 47))) END AS shadow FROM range(64) a(y), range(64) b(x)")
def gradient_and_shadow(spark, sf_dir):
    """A linear gradient and a box shadow, drawn from index arithmetic alone."""
    g = spark.range(64 * 64).select(F.call_function("div", F.col("id"), F.lit(64).cast("long")).alias("y"), (F.col("id") % 64).alias("x"))
    x, y = F.col("x"), F.col("y")
    away = F.greatest(16 - x, x - 47, 16 - y, y - 47)
    return g.select("y", "x", F.call_function("div", 255 * x, F.lit(63).cast("long")).alias("level"), F.when(away <= 0, F.lit(255).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), 255 - 16 * away)).alias("shadow"))


@query("SELECT (o_orderkey % 4) * 256 + (o_orderkey // 4) % 256 + 1024 * (o_orderkey // 1024) AS place, CAST(o_custkey % 256 AS BIGINT) AS byte FROM orders")
def byte_shuffle(spark, sf_dir):
    """Bytes of four-byte words regrouped by their place in the word, block by block."""
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    k, div = F.col("o_orderkey"), lambda a, n: F.call_function("div", a, F.lit(n).cast("long"))
    return t.select((k % 4 * 256 + div(k, 4) % 256 + 1024 * div(k, 1024)).alias("place"), (F.col("o_custkey") % 256).alias("byte"))


_BLUR = f"h AS (SELECT y, x, sum(v) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM ({_GRID})), blurred AS (SELECT y, x, sum(v) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 25 AS v FROM h)"


@query(f"WITH {_BLUR} SELECT y, x, CASE WHEN x IN (0, 39) OR y = 0 THEN 255 ELSE CAST(floor(least(greatest(v * 0.75 + 255 * 0.25, 0), 255)) AS BIGINT) END AS v FROM blurred")
def glass_stages(spark, sf_dir):
    """A pane of glass: blur, tint with clamping, and a border, one after the other."""
    blurred = dense.stencil(dense.stencil(grid(spark, sf_dir), {(0, d): 1.0 for d in range(-2, 3)}), {(d, 0): 1.0 for d in range(-2, 3)})
    return glass(blurred.select("y", "x", (F.col("v") / 25).alias("v")), 0.25, 255.0, (F.col("x").isin(0, 39)) | (F.col("y") == 0))


def glass(plane, strength: float, tint: float, border: Column):
    """(y, x, v): a plane mixed with a tint and clamped to a byte; 255 on the border."""
    mixed = F.col("v") * (1 - strength) + tint * strength
    level = F.floor(F.least(F.greatest(mixed, F.lit(0.0)), F.lit(255.0)))
    return plane.select("y", "x", F.when(border, F.lit(255).cast("long")).otherwise(level).alias("v"))


_CAND = "c AS (SELECT p_partkey // 40 AS y, p_partkey % 40 AS x FROM part WHERE (p_partkey // 40) % 3 = 0 AND p_size % 3 <> 0), d AS (SELECT y, CASE WHEN (y // 3) % 2 = 0 THEN x ELSE -x END AS s FROM c)"


@query(f"""WITH RECURSIVE {_CAND}, w AS (SELECT y, min(s) AS s FROM d GROUP BY y UNION ALL SELECT n.y, n.s FROM (SELECT w.y, (SELECT min(d.s) FROM d WHERE d.y = w.y AND d.s >= w.s + 3) AS s FROM w) n WHERE n.s IS NOT NULL) SELECT y, abs(s) AS x FROM w""")
def planar_rewrites(spark, sf_dir):
    """Matches of 3 x 3 that can be rewritten in one wave without overlap."""
    k = F.col("p_partkey")
    found = table(spark, sf_dir, "part", "p_partkey", "p_size").where("p_size % 3 <> 0").select(F.call_function("div", k, F.lit(40).cast("long")).alias("y"), (k % 40).alias("x"))
    return planar_schedule(found, 3)


def planar_schedule(candidates, k: int):
    """(y, x) of candidates that are taken: every k-th row is scanned, in turns forth and back, and a match is taken if it
    lies k places at least beyond the one taken before. Rows so far apart don't overlap; one row is one list."""
    row = F.call_function("div", F.col("y"), F.lit(k).cast("long"))
    scan = candidates.where(F.col("y") % k == 0).select("y", F.when(row % 2 == 0, F.col("x")).otherwise(-F.col("x")).alias("s"))
    lists = scan.groupBy("y").agg(F.array_sort(F.collect_set("s")).alias("s"))
    none = F.array().cast("array<bigint>")
    taken = F.aggregate("s", none, lambda out, s: F.when((F.size(out) == 0) | (s - F.try_element_at(out, F.lit(-1)) >= k), F.array_append(out, s)).otherwise(out))
    return lists.where(F.size("s") > 0).select("y", F.explode(taken).alias("s")).select("y", F.abs("s").alias("x"))
