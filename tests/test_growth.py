"""Plans and methods whose cost must not outgrow their input."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corvexa import registry
from corvexa.operators import circuits, dense, graph, layers, parse, syntax
from corvexa.plans import layers as plan_layers
from corvexa.plans import scalars

from .conftest import SMALL, oracle_rows, spark_rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["common_subexpressions", "constant_folding", "shunting_yard"])
def test_expressions_need_no_group_of_their_own(spark, name):
    """Thousands of expressions go to Python in one batch, not one data frame each."""
    p = plan(registry.queries()[name](spark, SMALL))
    assert "FlatMapGroups" not in p and "MapInArrow" in p


@pytest.mark.parametrize("name", ["c_statement_tree", "c_control_edges", "c_semantic_graph", "typedef_uses", "c_names", "moved_uses", "c_basic_blocks"])
def test_files_are_parsed_from_their_texts(spark, name):
    """No token rows are shuffled or gathered, and nothing is joined or sent to the driver."""
    p = plan(registry.queries()[name](spark, SMALL))
    assert "Generate" not in p and "Aggregate" not in p and "Join" not in p and p.count("Exchange") == 1


TEXTS = ["", " ", "L\"a\\\"b\" u8\"c\" u'd' 'e'", "a <: 1 :> <% %> %: %:%: ## <<= ... ->", "0x1Fu 1.5e-3f .5 12UL 1e5 7 x1 _y while _Bool é $ @ `", "\"open 'open", '"a\\\r" "b\\\u2028" c', "int f(){return 1;}"]


def test_lexing_agrees_with_token_rows(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, s string")
    want = {(r["k"], r["pos"], r["token"], r["kind"]) for r in parse.tokens(df, "k", "s").collect()}
    assert {(k, n, t, parse.kind_of(t)) for k, s in enumerate(TEXTS) for n, t in enumerate(parse.lexed(s))} == want


def test_texts_and_token_rows_give_the_same(spark):
    df = spark.createDataFrame([(1, "typedef int T; T f(T a) { do { a--; if (a) continue; } while (a); return a; }"), (2, ""), (3, None), (4, "int g; { ( ;")], "k long, s string")
    rows, texts = parse.tokens(df, "k", "s"), parse.sources(df, "k", "s")
    for f in (syntax.nodes, syntax.control_edges, syntax.names, syntax.semantic_edges, parse.postfix):
        assert sorted(map(str, f(rows, "k").collect())) == sorted(map(str, f(texts, "k").collect()))
    assert sorted(syntax.blocks_of_files(texts, "k").collect()) == sorted(syntax.basic_blocks(syntax.control_edges(rows, "k"), "k").collect())


def test_long_straight_runs_and_circles():
    run = [(n, n + 1, "next") for n in range(100_000)]  # quadratic, were each node followed to the start
    assert set(syntax._blocks(run)) == {(n, 0) for n in range(100_001)}
    assert dict(syntax._blocks([(1, 2, "next"), (2, 1, "back"), (2, 3, "false"), (3, 4, "next"), (3, 4, "next")])) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_near_pairs_of_crowded_places(spark, monkeypatch):
    """Places are compared, not points; all pairs come out, over several blocks too, and nothing is broadcast."""
    monkeypatch.setattr(graph, "_BLOCK", 4)
    points = [(k, (k % 3) * 15 - 20, (k % 2) * 30) for k in range(40)]
    found = graph.near_pairs(spark.createDataFrame(points, "id long, x long, y long"), 20)
    want = {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 400}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "Broadcast" not in plan(registry.queries()["vietoris_rips_edges"](spark, SMALL))


def test_first_value_among_equal_lines(spark, tmp_path):
    """Of lines of one number the first in the file counts, whatever its value."""
    spark.createDataFrame([(5, 9, 1, 1), (5, 2, 1, 1), (5, 1, 1, 2), (6, 7, 3, 1)], "l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(5,), (6,), (7,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["key"]: (r["value"], r["found"]) for r in registry.queries()["hash_insert_lookup"](spark, str(tmp_path)).collect()}
    assert got == {5: (9, True), 6: (7, True), 7: (None, False)}


def test_orthogonal_steps_sum_in_order():
    """Every sum is taken from its first term on, to the last bit."""
    rng = np.random.default_rng(3)

    def product(x, y):
        out = [[0.0] * len(y[0]) for _ in x]
        for i, row in enumerate(x):
            for j in range(len(y[0])):
                for k, v in enumerate(row):
                    out[i][j] += v * y[k][j]
        return out

    for m in rng.standard_normal((20, 4, 16)):
        s = 0.0
        for v in m.ravel().tolist():
            s += v * v
        x = [[v / (math.sqrt(s) + 1e-7) for v in r] for r in m.tolist()]
        for _ in range(5):
            g = product(x, [list(c) for c in zip(*x, strict=True)])
            p = [[-4.7750 * u + 2.0315 * w for u, w in zip(a, b, strict=True)] for a, b in zip(g, product(g, g), strict=True)]
            x = [[3.4445 * u + w for u, w in zip(a, b, strict=True)] for a, b in zip(x, product(p, x), strict=True)]
        assert dense.newton_schulz(m).tolist() == x
    assert np.allclose(dense.newton_schulz(m.T), dense.newton_schulz(m).T)


def test_texts_are_scanned_and_scored_in_one_pass(spark):
    for name in ("sharded_automata", "post_process"):
        p = plan(registry.queries()[name](spark, SMALL))
        assert "Exchange" not in p and p.count("MapInArrow") == 1


def test_no_sketch_a_pair(spark):
    """The sketch belongs to a nation, not to each customer of one."""
    p = plan(registry.queries()["approximate_distinct"](spark, SMALL))
    assert "hyperloglog" in p.lower() or "approx_count_distinct" in p.lower()
    assert not any("approx_count_distinct" in line and "keys=[c_nationkey" in line and "c_custkey" in line.split("functions=")[0] for line in p.splitlines())


def test_equal_formulas_are_compiled_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(circuits, "compile_cnf", lambda cs: made.append(cs) or [("true",)])
    circuits._models.cache_clear()
    assert circuits._models(((1, 2),), 2) == circuits._models(((1, 2),), 2) == 4 and len(made) == 1
    circuits._models.cache_clear()


def test_deviations_are_worked_out_before_the_values_are_dealt(spark):
    p = plan(registry.queries()["gptq_round_clip"](spark, SMALL))
    assert p.lower().index("generate") < p.index("aggregate(")


def test_paths_send_no_parents(spark):
    t = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "node long, parent long")
    assert {r["node"]: r["path"] for r in graph.paths(t, t).collect()} == {1: [1], 2: [2, 1], 3: [3, 2, 1]}


def test_closures_work_out_their_edges_once(spark):
    """What the edges are made of is read in one round, not in each."""
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda v: seen.add(1) or v, "long").asNondeterministic()
    e = spark.createDataFrame([(k, k + 1) for k in range(6)], "src long, dst long").select(counted("src").alias("src"), "dst")
    out = graph.closure(spark.createDataFrame([(0,)], "node long"), e)
    assert {r["node"]: r["depth"] for r in out.collect()} == {k: k for k in range(7)} and seen.value == 6


def test_channels_are_summed_where_they_are_dealt(spark):
    assert plan(registry.queries()["channel_mix"](spark, SMALL)).count("Exchange hashpartitioning") == 1


def test_more_nodes_make_more_tasks_not_larger_ones(spark, oracle, monkeypatch):
    monkeypatch.setattr(plan_layers, "_NODES", 10, raising=False)
    df = registry.queries()["channel_mix"](spark, SMALL)
    assert spark_rows(df) == oracle_rows(oracle, registry.oracle_sql()["channel_mix"])
    each = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.countDistinct("i").alias("n")).collect()]
    assert sum(each) == 200 and max(each) <= 30  # 200 parts in the session's four partitions were 50 a task


def test_channels_of_repeated_missing_and_negative_nodes(spark, tmp_path):
    keys = [None, None, -5, -300_001, 0, 7, 7, 7, 1 << 40, -(1 << 40)]
    pq.write_table(pa.table({"p_partkey": pa.array(keys, pa.int64())}), tmp_path / "part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    df = registry.queries()["channel_mix"](spark, str(tmp_path))
    assert spark_rows(df) == oracle_rows(con, registry.oracle_sql()["channel_mix"])


def test_channels_of_rows_and_of_positions_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(layers, "DEALT", 16, raising=False)
    x, w = {i: [(i * 7919 + k * 104729) % 262144 for k in range(4)] for i in range(50)}, [[k * 30_000 + j for k in range(4)] for j in range(3)]
    a = spark.createDataFrame([(i, k, v) for i, row in x.items() for k, v in enumerate(row)], "i long, k long, v long")
    b = spark.createDataFrame([(k, j, v) for j, row in enumerate(w) for k, v in enumerate(row)], "k long, j long, v long")
    nodes = spark.createDataFrame([(i, *row) for i, row in x.items()], "i long, a long, b long, c long, d long")
    mixed = nodes.select("i", F.posexplode(layers.mix_fixed([F.col(c) for c in "abcd"], w)).alias("j", "v"))
    out = layers.contract_fixed(a, F.broadcast(b))
    assert plan(out).count("Exchange hashpartitioning") == 1 and "hashpartitioning(i" in plan(out) and ", 13)" in plan(out)
    got = {(r["i"], r["j"]): r["v"] for r in out.collect()}
    assert got == {(r["i"], r["j"]): r["v"] for r in mixed.collect()} == {(i, j): sum(p * q >> 16 for p, q in zip(x[i], w[j], strict=True)) for i in x for j in range(3)}


def test_exchange_of_slots_within_and_across_ranges(spark):
    rows = [(0, k, k % 3, (k + 1) % 3) for k in range(3000)] + [(s, k, k, k + 1) for s in range(1, 200) for k in range(3)]
    df = spark.createDataFrame(rows, "slot long, o long, e long, d long")
    got = {r["slot"]: (r["final"], r["swaps"]) for r in scalars.compare_exchange(df, "slot", "o", "e", "d").collect()}
    assert got == {0: (0, 3000), **{s: (3, 3) for s in range(1, 200)}}
