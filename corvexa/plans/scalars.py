"""Scalar expression nodes: unsigned arithmetic, bit operations, float functions, conditions, lane groups, atomics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvexa.functions import u32
from corvexa.functions.arrow import flat_map
from corvexa.operators import extensions
from corvexa.plans.lineage import cut
from corvexa.registry import query, table

_AB = "SELECT l_orderkey AS k, l_linenumber AS n, (l_orderkey * 2654435761) % 4294967296 AS a, (l_partkey * 40503 + l_suppkey) % CASE WHEN l_linenumber = 3 THEN 1 ELSE 4294967296 END AS b FROM lineitem"


def operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    top = F.when(F.col("l_linenumber") == 3, 1).otherwise(F.lit(u32.WORD))
    return t.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), u32.mul(F.col("l_orderkey"), 2654435761).alias("a"), ((F.col("l_partkey") * 40503 + F.col("l_suppkey")) % top).alias("b"))


@query(f"""SELECT k, n, (a + b) % 4294967296 AS add, (a - b + 4294967296) % 4294967296 AS sub, CAST((a::HUGEINT * b) % 4294967296 AS BIGINT) AS mul,
 CAST((a::HUGEINT * b) >> 32 AS BIGINT) AS mul_high, CASE WHEN b = 0 THEN 4294967295 ELSE a // b END AS div, CASE WHEN b = 0 THEN 0 ELSE a % b END AS mod,
 abs(a - b) AS abs_diff, least(a, b) AS min, greatest(a, b) AS max, least(a + b, 4294967295) AS sat_add, greatest(a - b, 0) AS sat_sub,
 CAST(least(a::HUGEINT * b, 4294967295) AS BIGINT) AS sat_mul, (a & b) + (xor(a, b) >> 1) AS avg_floor, least(greatest(a, 1000), b) AS clamp FROM ({_AB})""")
def u32_arithmetic(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    made = {"add": u32.add(a, b), "sub": u32.sub(a, b), "mul": u32.mul(a, b), "mul_high": u32.mul_high(a, b), "div": u32.div(a, b), "mod": u32.mod(a, b), "abs_diff": u32.abs_diff(a, b), "min": F.least(a, b), "max": F.greatest(a, b), "sat_add": u32.saturating_add(a, b), "sat_sub": u32.saturating_sub(a, b), "sat_mul": u32.saturating_mul(a, b), "avg_floor": u32.avg_floor(a, b), "clamp": u32.clamp(a, 1000, b)}
    return operands(spark, sf_dir).select("k", "n", *[c.alias(x) for x, c in made.items()])


@query(f"""SELECT k, n, a & b AS bit_and, a | b AS bit_or, xor(a, b) AS bit_xor, 4294967295 - (a & b) AS bit_nand, 4294967295 - (a | b) AS bit_nor, 4294967295 - a AS bit_not,
 (a << (n & 31)) & 4294967295 AS shl, a >> (n & 31) AS shr, ((a << n) & 4294967295) | (a >> (32 - n)) AS rotl, (a >> n) | ((a << (32 - n)) & 4294967295) AS rotr,
 CAST(bit_count(a) AS BIGINT) AS popcount, CAST(32 - length(ltrim(lpad(bin(b), 32, '0'), '0')) AS BIGINT) AS clz,
 CASE WHEN b = 0 THEN 32 ELSE CAST(length(bin(b)) - length(rtrim(bin(b), '0')) AS BIGINT) END AS ctz,
 CAST(list_sum(list_transform(range(0, 32), lambda i: ((a >> i) & 1) << (31 - i))) AS BIGINT) AS reversed,
 (4294967296 - a) % 4294967296 AS neg, a & 15 AS low4, (a >> 4) & 15 AS high4, a & 255 AS low8, (a >> 8) & 255 AS high8 FROM ({_AB})""")
def u32_bits(spark, sf_dir):
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    made = {"bit_and": a.bitwiseAND(b), "bit_or": a.bitwiseOR(b), "bit_xor": a.bitwiseXOR(b), "bit_nand": u32.bit_not(a.bitwiseAND(b)), "bit_nor": u32.bit_not(a.bitwiseOR(b)), "bit_not": u32.bit_not(a), "shl": u32.shl(a, n), "shr": u32.shr(a, n), "rotl": u32.rotate_left(a, n), "rotr": u32.rotate_right(a, n), "popcount": u32.popcount(a), "clz": u32.clz(b), "ctz": u32.ctz(b), "reversed": u32.reverse_bits(a), "neg": u32.negate(a), "low4": u32.unpack(a, 4, 0), "high4": u32.unpack(a, 4, 1), "low8": u32.unpack(a, 8, 0), "high8": u32.unpack(a, 8, 1)}
    return operands(spark, sf_dir).select("k", "n", *[c.alias(x) for x, c in made.items()])


@query("""SELECT l_orderkey AS k, l_linenumber AS n, round(sin(x), 6) AS sin, round(cos(x), 6) AS cos, round(tan(x / 100), 6) AS tan, round(sqrt(x), 6) AS sqrt, round(exp(-x / 10), 6) AS exp,
 round(ln(x), 6) AS log, round(log2(x), 6) AS log2, round(pow(2, x / 10), 6) AS exp2, round(asin(x / 100), 6) AS asin, round(acos(x / 100), 6) AS acos, round(atan(x), 6) AS atan,
 round(tanh(x / 10), 6) AS tanh, round(sinh(x / 10), 6) AS sinh, round(cosh(x / 10), 6) AS cosh, round(1 / sqrt(x), 6) AS inverse_sqrt, round(1 / x, 6) AS reciprocal,
 CAST(floor(-x / 4) AS BIGINT) AS floor, CAST(ceil(x / 4) AS BIGINT) AS ceil, round(x / 2, 0) AS round, trunc(-x / 4) AS trunc, CAST(sign(x - 25) AS DOUBLE) AS sign, abs(x - 25) AS abs,
 round(x * 1.5 + l_linenumber, 6) AS fma, isnan(x) AS is_nan, isinf(x) AS is_inf, isfinite(x) AS is_finite, x = 25 AS eq, x <> 25 AS ne, x < 25 AS lt, x > 25 AS gt, x <= 25 AS le, x >= 25 AS ge,
 x < 25 AND l_linenumber > 2 AS both, x < 25 OR l_linenumber > 2 AS either, NOT (x < 25) AS negated, CASE WHEN x > 25 THEN x ELSE -x END AS chosen
 FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x FROM lineitem)""")
def float_functions(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    x, n = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    r = lambda c: F.round(c, 6)
    made = {"sin": r(F.sin(x)), "cos": r(F.cos(x)), "tan": r(F.tan(x / 100)), "sqrt": r(F.sqrt(x)), "exp": r(F.exp(-x / 10)), "log": r(F.ln(x)), "log2": r(F.log2(x)), "exp2": r(F.pow(F.lit(2.0), x / 10)), "asin": r(F.asin(x / 100)), "acos": r(F.acos(x / 100)), "atan": r(F.atan(x)), "tanh": r(F.tanh(x / 10)), "sinh": r(F.sinh(x / 10)), "cosh": r(F.cosh(x / 10)), "inverse_sqrt": r(1 / F.sqrt(x)), "reciprocal": r(1 / x), "floor": F.floor(-x / 4), "ceil": F.ceil(x / 4), "round": F.round(x / 2, 0), "trunc": F.signum(-x) * F.floor(F.abs(x / 4)), "sign": F.signum(x - 25), "abs": F.abs(x - 25), "fma": r(x * 1.5 + n), "is_nan": F.isnan(x), "is_inf": F.abs(x) == float("inf"), "is_finite": ~F.isnan(x) & (F.abs(x) < float("inf")), "eq": x == 25, "ne": x != 25, "lt": x < 25, "gt": x > 25, "le": x <= 25, "ge": x >= 25, "both": (x < 25) & (n > 2), "either": (x < 25) | (n > 2), "negated": ~(x < 25), "chosen": F.when(x > 25, x).otherwise(-x)}
    return t.select(F.col("l_orderkey").alias("k"), n.alias("n"), *[c.alias(m) for m, c in made.items()])


#: Lanes of a group.
LANES = 32


@query(f"""SELECT o_orderkey AS i, v, sum(v) OVER g AS added, min(v) OVER g AS least, max(v) OVER g AS most, bit_and(v) OVER g AS anded, bit_or(v) OVER g AS ored, bit_xor(v) OVER g AS xored,
 bit_or(CASE WHEN v % 2 = 0 THEN CAST(1 AS BIGINT) << (o_orderkey % {LANES}) ELSE 0 END) OVER g AS ballot, first_value(v) OVER (PARTITION BY o_orderkey // {LANES} ORDER BY o_orderkey) AS broadcast
 FROM (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS v FROM orders) WINDOW g AS (PARTITION BY o_orderkey // {LANES})""".replace("sum(v) OVER g", "CAST(sum(v) OVER g AS BIGINT)"))
def subgroup_operations(spark, sf_dir):
    """Reductions, ballot and broadcast over groups of LANES neighbours; a group is one window partition."""
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").select(F.col("o_orderkey").alias("i"), F.round("o_totalprice").cast("long").alias("v"))
    group, lane, v = F.call_function("div", F.col("i"), F.lit(LANES).cast("long")), F.col("i") % LANES, F.col("v")
    g = Window.partitionBy(group)
    ballot = F.bit_or(F.when(v % 2 == 0, F.call_function("shiftleft", F.lit(1).cast("long"), lane.cast("int"))).otherwise(F.lit(0).cast("long"))).over(g)
    made = {"added": F.sum(v).over(g), "least": F.min(v).over(g), "most": F.max(v).over(g), "anded": F.bit_and(v).over(g), "ored": F.bit_or(v).over(g), "xored": F.bit_xor(v).over(g), "ballot": ballot, "broadcast": F.first(v).over(g.orderBy("i"))}
    return t.select("i", "v", *[c.alias(m) for m, c in made.items()])


@query(f"""WITH t AS (SELECT o_orderkey AS i, CAST(round(o_totalprice) AS BIGINT) AS v FROM orders)
SELECT a.i, b.v AS shuffled FROM t a JOIN t b ON b.i = (a.i // {LANES}) * {LANES} + xor(a.i % {LANES}, 1)""")
def subgroup_shuffle(spark, sf_dir):
    """Lane exchange within a group: the neighbour with the lowest lane bit flipped. Lanes meet in one aggregate, no self-join."""
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").select(F.col("o_orderkey").alias("i"), F.round("o_totalprice").cast("long").alias("v"))
    pair = t.groupBy(F.call_function("div", F.col("i"), F.lit(2).cast("long")).alias("p")).agg(F.collect_list(F.struct("i", "v")).alias("x"))
    other = lambda e: F.filter("x", lambda o: o["i"] == e["i"].bitwiseXOR(F.lit(1).cast("long")))
    return pair.select(F.explode(F.transform("x", lambda e: F.struct(e["i"].alias("i"), F.get(other(e), F.lit(0))["v"].alias("shuffled")))).alias("e")).where("e.shuffled IS NOT NULL").select("e.i", "e.shuffled")


@query(f"""SELECT o_orderkey // {LANES} AS g, CAST(list_reduce(list(v ORDER BY o_orderkey), lambda a, b: (a * b) % 4294967296, CAST(1 AS HUGEINT)) AS BIGINT) AS product
 FROM (SELECT o_orderkey, CAST(CAST(round(o_totalprice) AS BIGINT) | 1 AS HUGEINT) AS v FROM orders) GROUP BY 1""")
def subgroup_multiply(spark, sf_dir):
    """Wrapping products over groups of LANES neighbours."""
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    g = F.call_function("div", F.col("o_orderkey"), F.lit(LANES).cast("long"))
    v = F.round("o_totalprice").cast("long").bitwiseOR(F.lit(1).cast("long"))
    return t.groupBy(g.alias("g")).agg(F.collect_list(v).alias("x")).select("g", F.aggregate("x", F.lit(1).cast("long"), u32.mul).alias("product"))  # LANES values at most


def fetch_nand(updates: DataFrame, slot: str, order: str, operand: str, start: int = u32.MAX) -> DataFrame:
    """(slot, final) after v = not (v and operand) in ``order``.

    Steps compose: each is v -> (v and m) xor c. Ranges of the order are folded apart, so a hot slot is many tasks, and
    their few results are folded in turn.
    """
    placed = cut(updates.select(slot, F.col(order).alias("o"), F.col(operand).alias("m")).repartitionByRange(slot, "o").withColumn("b", F.spark_partition_id()))
    both = lambda s, u: F.struct(s["m"].bitwiseAND(u["m"]).alias("m"), s["c"].bitwiseAND(u["m"]).bitwiseXOR(u["c"]).alias("c"))
    one = F.struct(F.lit(u32.MAX).cast("long").alias("m"), F.lit(0).cast("long").alias("c"))
    step = F.struct(F.col("o"), F.col("m").cast("long").alias("m"), F.lit(u32.MAX).cast("long").alias("c"))
    parts = placed.groupBy(slot, "b").agg(F.min("o").alias("o"), F.aggregate(F.array_sort(F.collect_list(step)), one, both).alias("f")).select(slot, "o", "f.m", "f.c")
    whole = parts.groupBy(slot).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("o", "m", "c"))), one, both).alias("f"))
    return whole.select(slot, F.lit(start).cast("long").bitwiseAND(F.col("f.m")).bitwiseXOR(F.col("f.c")).alias("final"))


@query("""SELECT user_id AS slot, CAST(list_reduce(list(event_id ORDER BY ts, event_id), lambda v, x: 4294967295 - (v & x), 4294967295) AS BIGINT) AS final FROM events GROUP BY user_id""")
def atomic_fetch_nand(spark, sf_dir):
    t = table(spark, sf_dir, "events", "event_id", "ts", "user_id").select(F.col("user_id").alias("slot"), F.struct("ts", "event_id").alias("o"), F.col("event_id").alias("m"))
    return fetch_nand(t, "slot", "o", "m")


@query(f"SELECT CAST(bit_and(a) AS BIGINT) AS all_and, CAST(bit_or(a) AS BIGINT) AS all_or, CAST(bit_xor(a) AS BIGINT) AS all_xor, min(a) AS all_min, max(a) AS all_max FROM ({_AB})")
def collective_bits(spark, sf_dir):
    """Collective reductions over all lanes of all groups: one row."""
    return operands(spark, sf_dir).agg(F.bit_and("a").alias("all_and"), F.bit_or("a").alias("all_or"), F.bit_xor("a").alias("all_xor"), F.min("a").alias("all_min"), F.max("a").alias("all_max"))


_ODD = "SELECT l_orderkey AS k, l_linenumber AS n, CASE l_orderkey % 6 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE) WHEN 2 THEN CAST('-inf' AS DOUBLE) ELSE l_quantity - 25 END AS x FROM lineitem"


@query(f"SELECT k, n, isnan(x) AS is_nan, isinf(x) AS is_inf, isfinite(x) AS is_finite FROM ({_ODD})")
def float_classes(spark, sf_dir):
    """Classes of numbers that hold NaN and both infinities."""
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    r, x, inf = F.col("l_orderkey") % 6, F.col("x"), float("inf")
    t = t.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.when(r == 0, float("nan")).when(r == 1, inf).when(r == 2, -inf).otherwise(F.col("l_quantity") - 25).alias("x"))
    return t.select("k", "n", F.isnan(x).alias("is_nan"), (~F.isnan(x) & (F.abs(x) == inf)).alias("is_inf"), (~F.isnan(x) & (F.abs(x) < inf)).alias("is_finite"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, CAST(CAST(round(l_extendedprice * 100) AS HUGEINT) * 100000007 + l_partkey AS VARCHAR) AS exact, round(l_quantity * 1.5 + l_linenumber, 6) AS near FROM lineitem")
def fused_multiply_add(spark, sf_dir):
    """a * b + c with one rounding: exact in decimals, and in doubles where they hold the product."""
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey")
    a = F.round(F.col("l_extendedprice") * 100).cast("decimal(18,0)")
    return t.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (a * F.lit(100000007).cast("decimal(10,0)") + F.col("l_partkey").cast("decimal(18,0)")).cast("decimal(38,0)").cast("string").alias("exact"), F.round(u32.fma(F.col("l_quantity"), F.lit(1.5), F.col("l_linenumber")), 6).alias("near"))


@query(f"""SELECT k, n, CASE WHEN a % 2 = 0 THEN a // 2 ELSE (3 * a + 1) % 4294967296 END AS collatz, xor(a, a >> 1) AS gray, (a & b) | ((4294967295 - a) & n) AS mux,
 a % 7 = 3 AND b > 1000 AS flagged FROM ({_AB})""")
def opaque_operations(spark, sf_dir):
    """Operations that a caller has registered by name: unary, binary, ternary, and a rule condition."""
    ops = extensions.Extensions()
    ops.register("collatz", lambda a: F.when(a % 2 == 0, u32.div(a, 2)).otherwise(u32.add(u32.mul(a, 3), 1)))
    ops.register("gray", lambda a: a.bitwiseXOR(F.shiftright(a, 1)))
    ops.register("mux", lambda s, a, b: s.bitwiseAND(a).bitwiseOR(u32.bit_not(s).bitwiseAND(b)))
    ops.register("flagged", lambda a, b: (a % 7 == 3) & (b > 1000))
    a, b, n = F.col("a"), F.col("b"), F.col("n").cast("long")
    return operands(spark, sf_dir).select("k", "n", ops.call("collatz", a).alias("collatz"), ops.call("gray", a).alias("gray"), ops.call("mux", a, b, n).alias("mux"), ops.condition("flagged", a, b).column.alias("flagged"))


@query("""SELECT user_id AS slot, count(*) AS added, bit_or(event_id) AS ored, bit_and(event_id) AS anded, bit_xor(event_id) AS xored, min(event_id) AS least, max(event_id) AS most,
 arg_max(event_type, (ts, event_id)) AS exchanged, epoch_us(max(ts)) AS lru FROM events GROUP BY user_id""")
def atomic_updates(spark, sf_dir):
    """Atomic add, or, and, xor, min, max, exchange (last writer) and LRU stamp of a slot: one aggregate a slot."""
    t = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    e = "event_id"
    return t.groupBy(F.col("user_id").alias("slot")).agg(F.count("*").alias("added"), F.bit_or(e).alias("ored"), F.bit_and(e).alias("anded"), F.bit_xor(e).alias("xored"), F.min(e).alias("least"), F.max(e).alias("most"), F.max_by("event_type", F.struct("ts", "event_id")).alias("exchanged"), F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("lru"))


def exchange_map(steps: list[tuple]) -> list[tuple]:
    """(start, final, swaps) for every value that some step (expected, desired) names: what becomes of a slot that holds it.

    Slots that hold the same value move together from then on, so the steps are followed once for all of them: a forest
    whose nodes are the values at the start, with swaps counted on the way to the root.
    """
    parent: dict = {}
    swaps: dict = {}
    at: dict = {}

    def holder(value):
        if value not in parent:
            parent[value], swaps[value] = None, 0
            at.setdefault(value, value)
        return at.get(value)

    for expected, desired in steps:
        a, b = holder(expected), holder(desired)
        if a is None:
            continue
        swaps[a] += 1
        if expected != desired:
            if b is None:
                at[desired] = a
            else:
                parent[a] = b
                swaps[a] -= swaps[b]
            at[expected] = None
    ends = {root: value for value, root in at.items() if root is not None}
    out = []
    for start in parent:
        node, n = start, swaps[start]
        while parent[node] is not None:
            node = parent[node]
            n += swaps[node]
        out.append((start, ends[node], n))
    return out


def compare_exchange(updates: DataFrame, slot: str, order: str, expected: str, desired: str, start: int = 0) -> DataFrame:
    """(slot, final, swaps) after compare-and-exchange updates in ``order``.

    Updates are dealt to ranges. A slot within one range is followed where it lies; of the few slots that lie in several,
    the ranges are followed apart, each as a map from values to values, so a hot slot is many tasks, and a slot's few maps
    are then applied in turn.
    """
    rows = updates.select(slot, F.col(order).alias("o"), F.col(expected).cast("long").alias("e"), F.col(desired).cast("long").alias("d"))
    placed = cut(rows.repartitionByRange(slot, "o").withColumn("b", F.spark_partition_id()))
    ranges = placed.groupBy(slot).agg(F.min("b").alias("b"), F.max("b").alias("z")).where("b <> z").select(slot)
    ranges = cut(ranges)  # a slot for each border between two ranges, at most
    zero = F.struct(F.lit(start).cast("long").alias("v"), F.lit(0).cast("long").alias("n"))
    put = lambda s, u: F.struct(F.when(s["v"] == u["e"], u["d"]).otherwise(s["v"]).alias("v"), (s["n"] + F.when(s["v"] == u["e"], 1).otherwise(0)).alias("n"))
    alone = placed.join(F.broadcast(ranges), slot, "left_anti").groupBy(slot).agg(F.array_sort(F.collect_list(F.struct("o", "e", "d"))).alias("x")).select(slot, F.aggregate("x", zero, put).alias("s"))
    parts = placed.join(F.broadcast(ranges), slot, "left_semi").groupBy(slot, "b").agg(F.min("o").alias("o"), F.array_sort(F.collect_list(F.struct("o", "e", "d"))).alias("x"))
    parts = parts.select(F.struct(slot, "o").alias("k"), F.transform("x", lambda u: F.struct(u["e"].alias("e"), u["d"].alias("d"))).alias("x"))
    maps = flat_map(parts, "k", "x", "m array<struct<start:bigint,final:bigint,swaps:bigint>>", lambda v: [([dict(zip(("start", "final", "swaps"), r, strict=True)) for r in exchange_map([(u["e"], u["d"]) for u in v])],)])
    whole = maps.groupBy(F.col(f"k.{slot}").alias(slot)).agg(F.array_sort(F.collect_list(F.struct(F.col("k.o").alias("o"), "m"))).alias("x"))
    hit = lambda s, u: F.try_element_at(F.filter(u["m"], lambda r: r["start"] == s["v"]), F.lit(1))
    fold = F.aggregate("x", zero, lambda s, u: F.struct(F.coalesce(hit(s, u)["final"], s["v"]).alias("v"), (s["n"] + F.coalesce(hit(s, u)["swaps"], F.lit(0))).alias("n")))
    return alone.unionByName(whole.select(slot, fold.alias("s"))).select(slot, F.col("s.v").alias("final"), F.col("s.n").alias("swaps"))


@query("""WITH RECURSIVE u AS (SELECT l_orderkey AS slot, l_linenumber AS k, (l_linenumber - 1) % 3 AS e, l_linenumber % 3 AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem),
f AS (SELECT DISTINCT slot, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS v, CAST(0 AS BIGINT) AS n FROM u UNION ALL
 SELECT f.slot, u.r, CASE WHEN f.v = u.e THEN u.d ELSE f.v END, f.n + CASE WHEN f.v = u.e THEN 1 ELSE 0 END FROM f JOIN u ON u.slot = f.slot AND u.r = f.r + 1)
SELECT slot, arg_max(v, r) AS final, arg_max(n, r) AS swaps FROM f GROUP BY slot""")
def atomic_compare_exchange(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    n = F.col("l_linenumber")
    t = t.select(F.col("l_orderkey").alias("slot"), F.struct(n, "l_partkey", "l_suppkey").alias("o"), ((n - 1) % 3).alias("e"), (n % 3).alias("d"))
    return compare_exchange(t, "slot", "o", "e", "d")
