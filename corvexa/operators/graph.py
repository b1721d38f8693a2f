"""Graphs as edges(src, dst, kind): hops, closures, components, trees, levels, motifs.

Loops are driver loops over DataFrame steps. Each round joins only the newest rows (semi-naive) and is written to the
shared folder, so plans stay short and a lost executor costs a reread. Joins are plain equi-joins whose skewed keys
the adaptive planner splits.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvexa.plans.lineage import Workspace, cut


def of_kind(edges: DataFrame, mask: int) -> DataFrame:
    return edges.where(F.col("kind").bitwiseAND(F.lit(mask)) != 0)


def hop(frontier: DataFrame, edges: DataFrame, mask: int = -1, backward: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Nodes one edge away from frontier(node[, by...]), along edges whose kind meets the mask."""
    near, far = ("dst", "src") if backward else ("src", "dst")
    within = [c for c in by if c in edges.columns]
    steps = (of_kind(edges, mask) if "kind" in edges.columns else edges).select(*within, F.col(near).alias("node"), F.col(far).alias("__to"))
    return frontier.join(steps, [*within, "node"]).select(*by, F.col("__to").alias("node")).distinct()


def hop_excluding(frontier: DataFrame, edges: DataFrame, excluded: DataFrame, mask: int = -1) -> DataFrame:
    return hop(frontier, edges, mask).join(excluded.select("node"), "node", "left_anti")


def grow(seen: DataFrame, edges: DataFrame, mask: int = -1, backward: bool = False) -> tuple[DataFrame, DataFrame]:
    """One accumulating hop: (all nodes, new nodes)."""
    new = hop(seen, edges, mask, backward).join(seen, "node", "left_anti")
    return seen.select("node").unionByName(new), new


#: Tables of earlier rounds that a closure keeps apart before they become one.
_PARTS = 8


def closure(seeds: DataFrame, edges: DataFrame, mask: int = -1, backward: bool = False, rounds: int | None = None, by: tuple[str, ...] = (), known: DataFrame | None = None) -> DataFrame:
    """seeds(node[, by...]) and all that is reachable, with ``depth``, the least number of hops.

    ``by`` columns keep several queries apart in one run; edges that have them stay within their query. ``known``
    (by..., node, depth) is a closure from before: a warm start from it follows only what is new. The loop ends with
    a round that finds nothing new; it is an error if ``rounds``, where given, end before that.
    """
    keys = [*by, "node"]
    frontier = seeds.select(*keys).distinct()
    if known is not None:
        frontier = frontier.join(known.select(*keys), keys, "left_anti")
    ws = Workspace(seeds.sparkSession, "closure")
    # Every round reads the edges: what they are made of is worked out once.
    edges = ws.save(edges.select(*[c for c in (*by, "src", "dst", "kind") if c in edges.columns]), "edges")
    frontier = ws.save(frontier.withColumn("depth", F.lit(0)))
    parts = [*([] if known is None else [known.select(*keys, "depth")]), frontier]
    for n in count(1):
        if len(parts) > _PARTS:
            old, parts = parts, [ws.save(_union(parts))]
            ws.drop(*[p for p in old if p is not frontier])
        new = hop(frontier, edges, mask, backward, by).join(_union(parts).select(*keys), keys, "left_anti")
        frontier = ws.save(new.withColumn("depth", F.lit(n)))
        if frontier.isEmpty():
            return _union(parts)
        if rounds is not None and n > rounds:
            raise RuntimeError(f"closure: new nodes after {rounds} rounds")
        parts.append(frontier)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def degree_sum(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    return frontier.join(edges.select(F.col("src").alias("node")), "node").agg(F.count("*").alias("degree"))


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component) of every node of an edge between two nodes: the smallest node id that is connected.

    Alternating large-star and small-star rounds, until a round changes nothing: O(log^2 n) of them at most. Each is
    aggregations and equi-joins over the edges, written to the shared folder; minima are combined before the shuffle.
    """
    ws = Workspace(edges.sparkSession, "components")
    e = ws.save(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ws.save(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = ws.save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        ws.drop(e, large)
        e = new
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now


def same_component(forward: DataFrame, backward: DataFrame, pivot: int) -> DataFrame:
    """Nodes that a pivot reaches and that reach it."""
    return forward.select("node").join(backward.select("node"), "node", "left_semi").withColumn("component", F.lit(pivot).cast("long"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of a directed graph: the smallest id of its strongly connected component.

    In turns: nodes without edges in or out are components of their own; of the rest, each takes the largest id that
    reaches it as its colour, and what reaches a colour's root backward within the colour is one component. Every
    turn takes out a component of each colour at least, so the loop ends by itself.
    """
    ws = Workspace(edges.sparkSession, "strong")
    e = ws.save(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    nodes = ws.save(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    found: list[DataFrame] = []
    while True:
        # Trim to nodes that have edges both ways.
        while True:
            ends = e.select(F.col("src").alias("node")).join(e.select(F.col("dst").alias("node")), "node", "left_semi").distinct()
            kept = ws.save(e.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi"), "kept")
            done = kept.count() == e.count()
            ws.drop(e)
            e = kept
            if done:
                break
        if e.isEmpty():
            break
        colour = ws.save(e.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")), "colour")
        fresh = colour
        while not fresh.isEmpty():
            sent = e.join(fresh.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("other"))
            fresh = ws.save(sent.join(colour, "node").where("other > colour").select("node", F.col("other").alias("colour")), "fresh")
            new = ws.save(colour.unionByName(fresh).groupBy("node").agg(F.max("colour").alias("colour")), "colour")
            ws.drop(colour)
            colour = new
        inner = e.join(colour.withColumnRenamed("node", "src"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("__c")), "dst").where("colour = __c").select("colour", "src", "dst")
        inner = ws.save(inner, "inner")
        back = closure(colour.where("node = colour"), inner, backward=True, by=("colour",))
        part = ws.save(back.select("node", "colour"), "part")
        found.append(part)
        gone = part.select("node")
        rest = ws.save(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), "edges")
        ws.drop(e, inner, colour)
        e = rest
    alone = nodes if not found else nodes.join(_union(found).select("node"), "node", "left_anti")
    out = alone.withColumn("component", F.col("node"))
    if not found:
        return out
    whole = _union(found)
    least = whole.groupBy("colour").agg(F.min("node").alias("component"))
    return out.unionByName(whole.join(least, "colour").select("node", "component"))


def levels(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, level) of an acyclic graph: the longest way from a source. Nodes on cycles, or below one, get no row.

    Each round takes the nodes whose predecessors are all done, and subtracts their edges from the open in-degrees of
    what they point to; only open nodes are written again. It is an error if ``rounds``, where given, end before.
    """
    ws = Workspace(edges.sparkSession, "levels")
    e = ws.save(edges.select("src", "dst").distinct(), "edges")
    state = ws.save(e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("d")), "degrees")
    ready = ws.save(e.select(F.col("src").alias("node")).distinct().join(state, "node", "left_anti").withColumn("level", F.lit(0)), "ready")
    done = [ready]
    for n in count(1):
        sent = e.join(ready.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("c"))
        left = state.where("d > 0").join(sent, "node", "left").select("node", (F.col("d") - F.coalesce("c", F.lit(0))).alias("d"))
        left, old = ws.save(left, "degrees"), state
        ws.drop(old)
        state = left
        ready = ws.save(state.where("d = 0").select("node").withColumn("level", F.lit(n)), "ready")
        if ready.isEmpty():
            return _union(done)
        if rounds is not None and n > rounds:
            raise RuntimeError(f"levels: open nodes after {rounds} rounds")
        done.append(ready)


def tree_order(tree: DataFrame, post: bool = False) -> DataFrame:
    """(node, place) of tree(node, parent, ord), whose roots have a null parent, in preorder or postorder from 0.

    Depths go down level by level, sizes come up, places go down again; each level is joins and one window over the
    children of a node. Several roots are walked in the order of ``ord``.
    """
    found = [cut(tree.where("parent IS NULL").select("node", "parent", "ord"))]
    while True:
        new = cut(tree.select("node", "parent", "ord").join(found[-1].select(F.col("node").alias("parent")), "parent", "left_semi"))
        if new.isEmpty():
            break
        found.append(new)
    sized, below = [], None
    for level in reversed(found):
        if below is None:
            here = level.withColumn("size", F.lit(1).cast("long"))
        else:
            sums = below.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("s"))
            here = level.join(sums, "node", "left").select("node", "parent", "ord", (F.coalesce("s", F.lit(0)) + 1).alias("size"))
        below = cut(here)
        sized.append(below)
    placed, out = None, None
    for level in reversed(sized):
        before = F.coalesce(F.sum("size").over(Window.partitionBy("parent").orderBy("ord", "node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        here = level.withColumn("before", before)
        if placed is None:
            here = here.select("node", "size", F.col("before").alias("first"))
        else:
            up = placed.select(F.col("node").alias("parent"), F.col("first").alias("up"))
            here = here.join(up, "parent").select("node", "size", (F.col("up") + F.col("before") + (0 if post else 1)).alias("first"))
        placed = cut(here)
        done = placed.select("node", (F.col("first") + (F.col("size") - 1 if post else F.lit(0))).alias("place"))
        out = done if out is None else out.unionByName(done)
    return out


def fold_levels(tree: DataFrame, value: str, how) -> DataFrame:
    """(node, value) where inner nodes hold ``how`` of their children's values: a bottom-up wave over the depths.

    ``tree``: node, parent, depth and the value of leaves. ``how`` is an aggregate of the children's values.
    """
    deepest = tree.agg(F.max("depth")).first()[0]
    out = below = None
    for d in range(deepest if deepest is not None else -1, -1, -1):
        level = tree.where(F.col("depth") == d).select("node", "parent", F.col(value).alias("v"))
        if below is not None:
            level = level.join(below.groupBy(F.col("parent").alias("node")).agg(how("v").alias("u")), "node", "left").select("node", "parent", F.coalesce("u", "v").alias("v"))
        below = cut(level)
        done = below.select("node", "v")
        out = done if out is None else out.unionByName(done)
    return out


def paths(targets: DataFrame, parents: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, path): parent pointers followed from each target to its root, target first.

    A pointer back into its own path is an error, and so is a path that goes on beyond ``max_depth`` steps, where given.
    """
    now = cut(targets.select("node", F.col("node").alias("end"), F.array("node").alias("path")))
    done: list[DataFrame] = []
    for n in count(1):
        # Sorted runs: parents' files are far smaller than the table that a broadcast would send.
        step = now.join(parents.select(F.col("node").alias("end"), "parent").hint("merge"), "end", "left")
        step = cut(step.select("node", F.col("parent").alias("end"), "path", F.coalesce(F.array_contains("path", F.col("parent")), F.lit(False)).alias("back")))
        if not step.where("back").isEmpty():
            raise RuntimeError("paths: the parent pointers have a cycle")
        done.append(step.where("end IS NULL").select("node", "path"))
        now = step.where("end IS NOT NULL").select("node", "end", F.concat("path", F.array("end")).alias("path"))
        if now.isEmpty():
            return _union(done)
        if max_depth is not None and n > max_depth:
            raise RuntimeError(f"paths: open paths after {max_depth} steps")


#: Points of one place that meet as a block.
_BLOCK = 4096


def near_pairs(points: DataFrame, eps: int) -> DataFrame:
    """(a, b), a < b, of points(id, x, y) in whole numbers that are at most eps apart."""
    cell = lambda c: F.floor(F.col(c) / eps)
    places = points.groupBy("x", "y").agg(F.ceil(F.count("*") / _BLOCK).alias("n")).withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    near = F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long")))
    others = places.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("n").alias("bn"), "cx", "cy").withColumn("dx", near).withColumn("dy", near)
    others = others.select("bx", "by", "bn", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    far = (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by"))
    met = places.join(others.hint("merge"), ["cx", "cy"]).where(far <= eps * eps)
    block = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    met = met.select("x", "y", "bx", "by", "n", block("bn").alias("j")).select("x", "y", block("n").alias("i"), "bx", "by", "j")
    dealt = points.join(places.select("x", "y", "n").hint("merge"), ["x", "y"]).select("id", "x", "y", F.pmod(F.xxhash64("id"), F.col("n")).alias("i"))
    left = met.join(dealt.select(F.col("id").alias("a"), "x", "y", "i").hint("merge"), ["x", "y", "i"]).select("a", "bx", "by", "j")
    right = dealt.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("i").alias("j"))
    return left.join(right.hint("merge"), ["bx", "by", "j"]).where("a < b").select("a", "b")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c, all joined: edges point from the node of smaller degree, so hubs make few pairs."""
    e = cut(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct())
    deg = e.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    e = e.join(deg.select(F.col("n").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("n").alias("b"), F.col("d").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    e = cut(e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")))
    wedge = e.join(e.select("x", F.col("y").alias("z")), "x").where("y < z")
    closed = e.select(F.least("x", "y").alias("y"), F.greatest("x", "y").alias("z"))
    t = F.array_sort(F.array("x", "y", "z"))
    return wedge.join(closed, ["y", "z"], "left_semi").select(t[0].alias("a"), t[1].alias("b"), t[2].alias("c"))


def diffuse(values: DataFrame, edges: DataFrame, rate: float, rounds: int = 1) -> DataFrame:
    """(node, v): v + rate * sum of (neighbour - v) over edges, for some rounds (diagonal Laplacian step)."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    for _ in range(rounds):
        pull = both.join(values.select(F.col("node").alias("dst"), F.col("v").alias("w")), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("s"), F.count("w").alias("n"))
        values = cut(values.join(pull, "node", "left").select("node", (F.col("v") + F.coalesce(F.lit(rate) * (F.col("s") - F.col("n") * F.col("v")), F.lit(0.0))).alias("v")))
    return values


def chebyshev(values: DataFrame, edges: DataFrame, weights: list[float]) -> DataFrame:
    """(node, v): the sum of weights[k] T_k(L) v, where L v is v less the mean of its neighbours and T_k the k-th Chebyshev
    polynomial: T_k = 2 L T_(k-1) - T_(k-2). Each order is one join over the edges, written to the shared folder."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))

    def less_mean(t: DataFrame) -> DataFrame:
        near = both.join(t.select(F.col("node").alias("dst"), F.col("v").alias("w")), "dst").groupBy(F.col("src").alias("node")).agg(F.avg("w").alias("m"))
        return t.join(near, "node", "left").select("node", (F.col("v") - F.coalesce("m", F.lit(0.0))).alias("v"))

    before = now = None
    total = values.select("node", (F.col("v") * weights[0]).alias("sum"))
    for k, w in enumerate(weights[1:], 1):
        if k == 1:
            before, now = values.select("node", "v"), cut(less_mean(values.select("node", "v")))
        else:
            new = less_mean(now).join(before.withColumnRenamed("v", "b"), "node").select("node", (2 * F.col("v") - F.col("b")).alias("v"))
            before, now = now, cut(new)
        total = total.join(now, "node").select("node", (F.col("sum") + w * F.col("v")).alias("sum"))
    return total.withColumnRenamed("sum", "v")


def remap(source: DataFrame, mapping: DataFrame, width: int) -> DataFrame:
    """(pos, v) of ``width`` target positions: v of the source that maps there, 0 where none does."""
    moved = mapping.join(source, "pos").where(F.col("to").between(0, width - 1)).groupBy("to").agg(F.max_by("v", "pos").alias("v"))
    return source.sparkSession.range(width).withColumnRenamed("id", "to").join(moved, "to", "left").select(F.col("to").alias("pos"), F.coalesce("v", F.lit(0).cast("long")).alias("v"))


def dominators(edges: DataFrame, root: int, graph: str | None = None) -> DataFrame:
    """(node, idom) of the nodes that ``root`` reaches. A flow graph is one group, named by the column ``graph``: one
    function of a program, which fits a task; groups run in parallel. Without ``graph`` the edges are one function."""
    import pandas as pd

    keyed = edges if graph else edges.withColumn("__g", F.lit(0))
    by = graph or "__g"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        succ, pred = {}, {}
        for s, d in zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True):
            succ.setdefault(s, []).append(d)
            pred.setdefault(d, []).append(s)
        order, seen, stack = [], {root}, [(root, iter(succ.get(root, ())))]
        while stack:
            n, it = stack[-1]
            for d in it:
                if d not in seen:
                    seen.add(d)
                    stack.append((d, iter(succ.get(d, ()))))
                    break
            else:
                order.append(n)
                stack.pop()
        rank = {n: k for k, n in enumerate(order)}
        idom, changed = {root: root}, True
        while changed:
            changed = False
            for n in reversed(order[:-1]):
                new = None
                for p in pred.get(n, ()):
                    if p not in idom:
                        continue
                    if new is None:
                        new = p
                        continue
                    a, b = new, p
                    while a != b:
                        while rank[a] < rank[b]:
                            a = idom[a]
                        while rank[b] < rank[a]:
                            b = idom[b]
                    new = a
                if new is not None and idom.get(n) != new:
                    idom[n], changed = new, True
        return pd.DataFrame({by: pdf[by].iloc[0], "node": list(idom), "idom": list(idom.values())}).astype({"node": "int64", "idom": "int64"})

    kind = dict(keyed.dtypes)[by]
    out = keyed.select(by, "src", "dst").groupBy(by).applyInPandas(solve, f"`{by}` {kind}, node long, idom long")
    return out if graph else out.drop("__g")


def keep(edges: DataFrame, condition: Column) -> DataFrame:
    return edges.where(condition)
