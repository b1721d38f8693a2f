"""Node predicates and data-flow steps on a property graph: nodes(node, kind, tags), edges(src, dst, kind[, slot]).

Every flow operator is one hop; callers iterate with ``graph.closure`` where they want the fixpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import hop, of_kind

#: Edge kinds, a bit each.
DATAFLOW, ALIAS, CALL_ARG, DOMINANCE, RETURN, BLOCK = 1, 2, 4, 8, 16, 32


def kind_is(nodes: DataFrame, kind: int) -> DataFrame:
    return nodes.where(F.col("kind") == kind).select("node")


#: Kinds of nodes that are literals: numbers, characters, strings.
LITERALS = (3, 4, 5)
#: Tag bits of the region that a node belongs to.
IN_FILE, IN_FUNCTION, IN_PACKAGE = 1, 2, 4


def literals(nodes: DataFrame, kinds: tuple[int, ...] = LITERALS) -> DataFrame:
    return nodes.where(F.col("kind").isin(*kinds)).select("node")


def linked(frontier: DataFrame, edges: DataFrame, mask: int) -> DataFrame:
    """Nodes that an edge of one of the mask's kinds joins to the frontier, whichever way it points."""
    return hop(frontier, edges, mask).unionByName(hop(frontier, edges, mask, backward=True)).distinct()


def calls_to(nodes: DataFrame, callees: DataFrame, edges: DataFrame) -> DataFrame:
    """Call sites: nodes of a call-argument edge to a callee."""
    return hop(callees, edges, CALL_ARG, backward=True).join(nodes.select("node"), "node", "left_semi")


def tagged(nodes: DataFrame, mask: int) -> DataFrame:
    """Nodes whose tags meet a family's mask."""
    return nodes.where(F.col("tags").bitwiseAND(F.lit(mask)) != 0).select("node")


def flows_to(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    return hop(frontier, edges, DATAFLOW)


def flows_to_alias_only(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    return hop(frontier, edges, ALIAS)


def bounded_by_comparison(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    return hop(frontier, edges, DOMINANCE, backward=True)


def dominance_predecessors(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    return hop(frontier, edges, DOMINANCE | BLOCK, backward=True)


def arg_of(frontier: DataFrame, edges: DataFrame, slot: int | None = None) -> DataFrame:
    return hop(frontier, edges if slot is None else edges.where(F.col("slot") == slot), CALL_ARG)


def size_argument_of(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    return hop(frontier, edges, CALL_ARG, backward=True)


def return_value_of(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    return hop(frontier, edges, RETURN)


def held(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes of ``a`` that ``b`` covers: checks, escapes, locks and bounds that dominate a use."""
    return a.join(b, "node", "left_semi")


def lacking(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes of ``a`` that ``b`` doesn't cover: kills, unchecked returns and formats."""
    return a.join(b, "node", "left_anti")


def sanitized_flow(sources: DataFrame, sanitizers: DataFrame, edges: DataFrame) -> DataFrame:
    """One hop from the sources that are no sanitizers; a sanitizer that is reached stays visible."""
    return flows_to(lacking(sources, sanitizers), edges)


def reaches_sink(sources: DataFrame, sinks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (found, hits): whether one hop from the sources meets a sink, and how many sinks."""
    return held(flows_to(sources, edges), sinks).agg((F.count("*") > 0).alias("found"), F.count("*").alias("hits"))


def overflow_risk(arithmetic: DataFrame, reached: DataFrame, guarded: DataFrame) -> DataFrame:
    return lacking(held(arithmetic, reached), guarded)


def aliases(x: DataFrame, y: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of one set that one hop from the other reaches, both ways."""
    return held(flows_to(x, edges), y).unionByName(held(flows_to(y, edges), x)).distinct()


def dataflow(edges: DataFrame) -> DataFrame:
    return of_kind(edges, DATAFLOW)


#: What each rule of the checks wants: uses that a guard covers, or uses that none covers.
COVERED = ("auth_check_dominates", "buffer_size_check", "lock_dominates", "path_canonical", "sanitizer_dominates", "sql_param_bound", "xss_escape")
UNCOVERED = ("format_string_check", "unchecked_return")


def check(rule: str, uses: DataFrame, guards: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, node) of one check. A guard covers itself and, over a dominance edge, what it dominates."""
    if rule not in COVERED + UNCOVERED:
        raise ValueError(f"no such check: {rule}")
    covered = guards.select("node").unionByName(hop(guards, edges, DOMINANCE)).distinct()
    found = held(uses, covered) if rule in COVERED else lacking(uses, covered)
    return found.select(F.lit(rule).alias("rule"), "node")
