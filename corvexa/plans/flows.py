"""Predicates, labels, taint steps and rules over a property graph derived from parts and their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvexa.operators import flow, graph
from corvexa.plans.graphs import walk_sql
from corvexa.registry import query, table

_N = "nodes AS (SELECT p_partkey AS node, p_size % 20 AS kind, CAST(1 AS BIGINT) << (p_partkey % 6) AS tags FROM part)"
_E = "edges AS (SELECT DISTINCT p_partkey AS src, (p_partkey * m + p_size) % (SELECT count(*) FROM part) AS dst, CAST(1 AS BIGINT) << ((p_partkey + m) % 6) AS kind, m % 3 AS slot FROM part, (SELECT unnest([3, 5, 8]) AS m))"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    return p.select(F.col("p_partkey").alias("node"), (F.col("p_size") % 20).alias("kind"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p_partkey") % 6).cast("int")).alias("tags"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    n = p.count()
    e = p.withColumn("m", F.explode(F.array(F.lit(3), F.lit(5), F.lit(8))))
    kind = F.call_function("shiftleft", F.lit(1).cast("long"), ((F.col("p_partkey") + F.col("m")) % 6).cast("int"))
    return e.select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * F.col("m") + F.col("p_size")) % n).alias("dst"), kind.alias("kind"), (F.col("m") % 3).alias("slot")).distinct()


def some(spark: SparkSession, sf_dir: str, of: int, mod: int) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey").where(F.col("p_partkey") % mod == of).select(F.col("p_partkey").alias("node"))


def _sql(body: str) -> str:
    return f"WITH {_N}, {_E}, x AS (SELECT node FROM nodes WHERE node % 11 = 1), y AS (SELECT node FROM nodes WHERE node % 3 = 2), z AS (SELECT node FROM nodes WHERE node % 7 = 3) {body}"


def _sets(spark, sf_dir):
    return some(spark, sf_dir, 1, 11), some(spark, sf_dir, 2, 3), some(spark, sf_dir, 3, 7)


@query(_sql("SELECT node FROM nodes WHERE kind = 7"))
def node_kind_eq(spark, sf_dir):
    return flow.kind_is(nodes(spark, sf_dir), 7)


@query(_sql("SELECT node FROM nodes WHERE kind BETWEEN 3 AND 5"))
def literal_of(spark, sf_dir):
    return flow.literals(nodes(spark, sf_dir))


for _name, _bit in (("in_file", flow.IN_FILE), ("in_function", flow.IN_FUNCTION), ("in_package", flow.IN_PACKAGE)):

    @query(_sql(f"SELECT node FROM nodes WHERE tags & {_bit} <> 0"), name=_name)
    def _region(spark, sf_dir, bit=_bit):
        return flow.tagged(nodes(spark, sf_dir), bit)


@query(_sql("SELECT dst AS node FROM edges JOIN x ON node = src WHERE kind & 6 <> 0 UNION SELECT src FROM edges JOIN x ON node = dst WHERE kind & 6 <> 0"))
def edge_predicate(spark, sf_dir):
    """Nodes that an edge of a family joins to a set, either way."""
    return flow.linked(_sets(spark, sf_dir)[0], edges(spark, sf_dir), flow.ALIAS | flow.CALL_ARG)


@query(_sql("SELECT DISTINCT src AS node FROM edges JOIN z ON node = dst WHERE kind & 4 <> 0 AND src IN (SELECT node FROM nodes WHERE kind < 10)"))
def call_to(spark, sf_dir):
    """Call sites of some callees on the graph."""
    return flow.calls_to(nodes(spark, sf_dir).where("kind < 10"), _sets(spark, sf_dir)[2], edges(spark, sf_dir))


@query(_sql("SELECT node FROM nodes WHERE tags & 20 <> 0"))
def label_by_family(spark, sf_dir):
    return flow.tagged(nodes(spark, sf_dir), 20)


def _hop_sql(mask: int, more: str = "", backward: bool = False) -> str:
    near, far = ("dst", "src") if backward else ("src", "dst")
    return _sql(f"SELECT DISTINCT {far} AS node FROM edges JOIN x ON node = {near} WHERE kind & {mask} <> 0{more}")


_STEPS = {
    "flows_to": (_hop_sql(flow.DATAFLOW), lambda x, e: flow.flows_to(x, e)),
    "flows_to_alias_only": (_hop_sql(flow.ALIAS), lambda x, e: flow.flows_to_alias_only(x, e)),
    "bounded_by_comparison": (_hop_sql(flow.DOMINANCE, backward=True), lambda x, e: flow.bounded_by_comparison(x, e)),
    "dominance_predecessors": (_hop_sql(flow.DOMINANCE | flow.BLOCK, backward=True), lambda x, e: flow.dominance_predecessors(x, e)),
    "arg_of": (_hop_sql(flow.CALL_ARG), lambda x, e: flow.arg_of(x, e)),
    "arg_of_slot": (_hop_sql(flow.CALL_ARG, " AND slot = 2"), lambda x, e: flow.arg_of(x, e, 2)),
    "size_argument_of": (_hop_sql(flow.CALL_ARG, backward=True), lambda x, e: flow.size_argument_of(x, e)),
    "return_value_of": (_hop_sql(flow.RETURN), lambda x, e: flow.return_value_of(x, e)),
}
for _name, (_q, _f) in _STEPS.items():

    @query(_q, name=_name)
    def _step(spark, sf_dir, f=_f):
        return f(_sets(spark, sf_dir)[0], edges(spark, sf_dir))


@query(_sql("SELECT DISTINCT dst AS node FROM edges JOIN (SELECT node FROM x WHERE node NOT IN (SELECT node FROM z)) s ON s.node = src WHERE kind & 1 <> 0"))
def sanitized_by(spark, sf_dir):
    x, _, z = _sets(spark, sf_dir)
    return flow.sanitized_flow(x, z, edges(spark, sf_dir))


@query(_sql("SELECT count(DISTINCT dst) > 0 AS found, count(DISTINCT dst) AS hits FROM edges JOIN x ON x.node = src WHERE kind & 1 <> 0 AND dst IN (SELECT node FROM y)"))
def flows_to_to_sink(spark, sf_dir):
    """Taint pollution: does one hop from the sources meet a labelled sink, and how many."""
    x, y, _ = _sets(spark, sf_dir)
    return flow.reaches_sink(x, y, edges(spark, sf_dir))


@query(_sql("SELECT node FROM x WHERE node NOT IN (SELECT node FROM z)"))
def taint_kill(spark, sf_dir):
    x, _, z = _sets(spark, sf_dir)
    return flow.lacking(x, z)


@query(_sql("SELECT node FROM x WHERE node IN (SELECT node FROM y)"))
def check_dominates(spark, sf_dir):
    x, y, _ = _sets(spark, sf_dir)
    return flow.held(x, y)


for _k, _rule in enumerate(flow.COVERED + flow.UNCOVERED):
    _not = "NOT " if _rule in flow.UNCOVERED else ""

    @query(_sql(f"SELECT '{_rule}' AS rule, node FROM nodes WHERE kind IN ({_k}, {_k + 9}) AND node {_not}IN (SELECT node FROM nodes g WHERE node % 5 = {_k % 5} UNION SELECT dst FROM edges WHERE kind & 8 <> 0 AND src % 5 = {_k % 5})"), name=_rule)
    def _check(spark, sf_dir, rule=_rule, k=_k):
        """Uses of one kind of node against the guards of the rule."""
        n = nodes(spark, sf_dir)
        return flow.check(rule, n.where(F.col("kind").isin(k, k + 9)).select("node"), some(spark, sf_dir, k % 5, 5), edges(spark, sf_dir))


@query(_sql("SELECT node FROM x WHERE node IN (SELECT node FROM y) AND node NOT IN (SELECT node FROM z)"))
def integer_overflow_arith(spark, sf_dir):
    return flow.overflow_risk(*_sets(spark, sf_dir))


@query(_sql("SELECT DISTINCT dst AS node FROM edges JOIN x ON x.node = src WHERE kind & 1 <> 0 AND dst IN (SELECT node FROM y) UNION SELECT DISTINCT dst FROM edges JOIN y ON y.node = src WHERE kind & 1 <> 0 AND dst IN (SELECT node FROM x)"))
def aliases_dataflow(spark, sf_dir):
    x, y, _ = _sets(spark, sf_dir)
    return flow.aliases(x, y, edges(spark, sf_dir))


@query(_sql("SELECT node, depth FROM w").replace("WITH ", "WITH RECURSIVE ", 1).replace(" SELECT node, depth FROM w", ", " + walk_sql("w", "SELECT node, 0 FROM x", "(SELECT src, dst FROM edges WHERE kind & 1 <> 0 AND src NOT IN (SELECT node FROM z))") + " SELECT node, depth FROM w", 1))
def taint_closure_sanitized(spark, sf_dir):
    """The taint step driven to its fixpoint: sanitizers are reached but pass nothing on."""
    x, _, z = _sets(spark, sf_dir)
    e = edges(spark, sf_dir)
    open_ = flow.dataflow(e).join(z.withColumnRenamed("node", "src"), "src", "left_anti")
    return graph.closure(x, open_)
