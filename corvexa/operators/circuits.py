"""Boolean and arithmetic circuits, finite orders as categories, and rewriting of spider diagrams."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvexa.functions.arrow import flat_map
from corvexa.plans.lineage import cut

from . import graph
from .scan import prefix_scan

#: Gates of one compiled formula, at most.
MAX_GATES = 1 << 16


def compile_cnf(clauses: list[list[int]]) -> list[tuple]:
    """Gates of a deterministic decomposable circuit, the root last: ('lit', x), ('and', gates), ('or', gates), ('true',), ('false',).

    A formula falls into parts without common variables; a part is split by its most frequent variable. Equal parts are
    compiled once. It is an error if there are more than MAX_GATES.
    """
    gates: list[tuple] = []
    made: dict = {}

    def gate(g: tuple) -> int:
        if g not in made:
            if len(gates) >= MAX_GATES:
                raise RuntimeError("the formula needs too many gates")
            made[g] = len(gates)
            gates.append(g)
        return made[g]

    def given(cs: frozenset, x: int) -> frozenset:
        return frozenset(c - {-x} for c in cs if x not in c)

    def build(cs: frozenset) -> int:
        if frozenset() in cs:
            return gate(("false",))
        if not cs:
            return gate(("true",))
        if cs in made:
            return made[cs]
        parts: list[tuple[set, set]] = []
        for c in cs:
            own, mine = {abs(x) for x in c}, {c}
            rest = []
            for vs, held in parts:
                if vs & own:
                    own, mine = own | vs, mine | held
                else:
                    rest.append((vs, held))
            parts = [*rest, (own, mine)]
        if len(parts) > 1:
            out = gate(("and", tuple(sorted(build(frozenset(p)) for _, p in parts))))
        else:
            count: dict[int, int] = {}
            for c in cs:
                for x in c:
                    count[abs(x)] = count.get(abs(x), 0) + 1
            v = min(count, key=lambda x: (-count[x], x))
            ways = [gate(("and", (gate(("lit", x)), build(given(cs, x))))) for x in (v, -v)]
            out = gate(("or", tuple(ways)))
        made[cs] = out
        return out

    root = build(frozenset(frozenset(c) for c in clauses if not any(-x in c for x in c)))
    if root != len(gates) - 1:
        gates.append(("and", (root,)))
    return gates


def count_models(gates: list[tuple], variables: int) -> int:
    """Models over so many variables: products at and, sums at or, twice as many for each variable that a gate leaves open."""
    scope: list[frozenset] = []
    count: list[int] = []
    for g in gates:
        if g[0] == "lit":
            scope.append(frozenset([abs(g[1])]))
            count.append(1)
        elif g[0] in ("true", "false"):
            scope.append(frozenset())
            count.append(int(g[0] == "true"))
        else:
            whole = frozenset().union(*(scope[k] for k in g[1]))
            n = 1 if g[0] == "and" else 0
            for k in g[1]:
                n = n * count[k] if g[0] == "and" else n + (count[k] << len(whole - scope[k]))
            scope.append(whole)
            count.append(n)
    return count[-1] << (variables - len(scope[-1]))


def model_counts(df: DataFrame, key: str, clauses: str, variables: int) -> DataFrame:
    """(key, models) of formulas, each a list of clauses of signed variables. Of late formulas a worker keeps the counts."""

    def one(v) -> list[tuple]:
        return [(_models(tuple(map(tuple, v)), variables),)] if v is not None else []

    return flat_map(df, key, clauses, "models long", one)


@lru_cache(maxsize=1 << 14)
def _models(clauses: tuple[tuple[int, ...], ...], variables: int) -> int:
    return count_models(compile_cnf(clauses), variables)


def evaluate(tree: DataFrame, value: str, modulus: int) -> DataFrame:
    """(node, v) of tree(node, parent, depth, value of leaves): sums at even depths, products at odd ones, modulo a number
    below 2**31. Levels go up from the deepest; a node's children are folded in one aggregate."""
    deepest = tree.agg(F.max("depth")).first()[0]
    out = below = None
    for d in range(deepest if deepest is not None else -1, -1, -1):
        level = tree.where(F.col("depth") == d).select("node", "parent", F.col(value).cast("long").alias("v"))
        if below is not None:
            grouped = below.groupBy(F.col("parent").alias("node"))
            if d % 2 == 0:
                up = grouped.agg((F.sum("v") % modulus).alias("u"))
            else:
                up = grouped.agg(F.aggregate(F.collect_list("v"), F.lit(1).cast("long"), lambda s, x: s * x % modulus).alias("u"))
            level = level.join(up, "node", "left").select("node", "parent", F.coalesce("u", "v").alias("v"))
        below = cut(level)
        done = below.select("node", "v")
        out = done if out is None else out.unionByName(done)
    return out


def adjoint_witness(source: DataFrame, target: DataFrame, f: DataFrame, g: DataFrame) -> DataFrame:
    """(c, d, left_homs, right_homs, agree) for homs(x, y, homs) of two finite categories and maps f(c, image), g(d, image).

    f is left adjoint to g where there are as many arrows f(c) -> d as c -> g(d), for all c and d.
    """
    left = f.join(target, f["image"] == target["x"]).select("c", F.col("y").alias("d"), F.col("homs").alias("left_homs"))
    right = g.join(source, g["image"] == source["y"]).select(F.col("x").alias("c"), "d", F.col("homs").alias("right_homs"))
    return left.join(right, ["c", "d"]).withColumn("agree", F.col("left_homs") == F.col("right_homs"))


def fuse_spiders(spiders: DataFrame, edges: DataFrame, turns: int) -> DataFrame:
    """(node, colour, phase, fused): joined spiders of one colour as one, named by the smallest, phases added modulo ``turns``."""
    ends = spiders.select("node", "colour")
    same = edges.join(ends.withColumnRenamed("node", "src"), "src").join(ends.select(F.col("node").alias("dst"), F.col("colour").alias("__c")), "dst").where("colour = __c").select("src", "dst")
    parts = graph.components(same)
    named = spiders.join(parts, "node", "left").select(F.coalesce("component", "node").alias("to"), "colour", "phase")
    return named.groupBy(F.col("to").alias("node")).agg(F.first("colour").alias("colour"), (F.sum("phase") % turns).alias("phase"), F.count("*").alias("fused"))


def drop_identities(spiders: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spiders of phase 0 with just two neighbours go, where no other such spider is a neighbour, and their neighbours are joined."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    around = both.where("src <> dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("a"), F.max("dst").alias("b"))
    idle = cut(around.where("n = 2").join(spiders.where("phase = 0").select("node"), "node", "left_semi"))
    ids = idle.select("node")
    lone = idle.join(ids.withColumnRenamed("node", "a"), "a", "left_anti").join(ids.withColumnRenamed("node", "b"), "b", "left_anti")
    lone = cut(lone.select("node", "a", "b"))
    gone = lone.select("node")
    kept = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    return spiders.join(gone, "node", "left_anti"), kept.unionByName(lone.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def kan_extensions(values: DataFrame, asked: DataFrame) -> DataFrame:
    """(d, left, right): of values(at, v), where ``at`` is the image of an object in a total order, the join of those at or
    below d and the meet of those at or above it; null where there are none. Both are running extremes over one scan."""
    both = values.select("at", "v", F.lit(None).cast("long").alias("d")).unionByName(asked.select(F.col("d").alias("at"), F.lit(None).cast(dict(values.dtypes)["v"]).alias("v"), "d"))
    both = prefix_scan(both, "at", "v", kind="max", into="left").withColumn("down", -F.col("at"))
    return prefix_scan(both, "down", "v", kind="min", into="right").where("d IS NOT NULL").select("d", "left", "right")


def yoneda_counts(sizes: DataFrame) -> DataFrame:
    """(c, elements, transformations, agree) for a functor of sets on a discrete category, sizes(c, n): a transformation from
    what c represents picks an element at c and, as nothing else has an arrow from c, nothing more."""
    arrows = sizes.select(F.col("c").alias("from")).join(sizes.select(F.col("c").alias("to"), "n"), F.col("from") == F.col("to"))
    picks = arrows.groupBy(F.col("from").alias("c")).agg(F.round(F.exp(F.sum(F.ln("n")))).cast("long").alias("transformations"))
    return sizes.select("c", F.col("n").alias("elements")).join(picks, "c").withColumn("agree", F.col("elements") == F.col("transformations"))
