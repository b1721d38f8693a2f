"""Whole jobs: queries on fixtures that reach beyond the small tables; loops to their end."""

import random

import pytest

from corvexa import registry
from corvexa.operators import dense, graph, parse, semiring

QUERIES = registry.queries()


def test_lookup_meets_rows_beyond_the_first_200(spark, tmp_path):
    spark.createDataFrame([(k, [float(k)] * 4) for k in range(300)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(k, 1, k) for k in range(700)], "l_orderkey long, l_linenumber long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["l_orderkey"]: r["first"] for r in QUERIES["embedding_lookup"](spark, str(tmp_path)).collect()}
    assert got == {k: float(k % 300) for k in range(700)}


def test_every_target_has_its_place(spark, tmp_path):
    spark.range(1500).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["pos"]: r["v"] for r in QUERIES["functor_apply"](spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(range(4499), 0) | {k * 3 + 1: k % 50 + 1 for k in range(1500)}


def test_neighbours_of_copies(spark):
    """Copies at distance 0, in order of their ids; fewer points than asked for."""
    v = spark.createDataFrame([(k, [float(k // 4), 1.0]) for k in range(12)], "id long, v array<double>")
    got = {(r["query"], r["rank"]): (r["id"], r["distance"]) for r in dense.nearest(v, v, 3).collect()}
    assert len(got) == 36 and [got[5, n] for n in (1, 2, 3)] == [(4, 0.0), (6, 0.0), (7, 0.0)]
    assert dense.nearest(v.where("id < 2"), v.where("id < 3"), 3).count() == 4 and dense.nearest(v.limit(0), v, 3).count() == 0


def test_taint_goes_on_beyond_twelve_hops(spark, tmp_path):
    chain = [111, *[p for p in range(3, 300, 6) if p % 7 != 3 and p % 11 != 1][:14]]
    rows = [(p, (to - 3 * p) % 300) for p, to in zip(chain, [*chain[1:], chain[-1]], strict=True)]
    spark.createDataFrame(rows + [(0, 0)] * (300 - len(rows)), "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["node"]: r["depth"] for r in QUERIES["taint_closure_sanitized"](spark, str(tmp_path)).collect()}
    assert got == {p: k for k, p in enumerate(chain)}


def test_long_chains(spark):
    """Chains of over 200 hops: no loop stops early."""
    n = 205
    e = spark.createDataFrame([(k, k + 1) for k in range(n)], "src long, dst long")
    one = spark.createDataFrame([(0,)], "node long")
    assert {(r["node"], r["depth"]) for r in graph.closure(one, e).collect()} == {(k, k) for k in range(n + 1)}
    assert {r["component"] for r in graph.components(e).collect()} == {0}
    tree = spark.createDataFrame([(k, k - 1 if k % 41 else None) for k in range(n)], "node long, parent long")
    got = {r["node"]: r["path"] for r in graph.paths(tree, tree).collect()}
    assert got == {k: list(range(k, k - k % 41 - 1, -1)) for k in range(n)}
    with pytest.raises(RuntimeError):
        graph.paths(tree, tree, 20)
    knot = spark.createDataFrame([(0, 1), (1, 0)], "node long, parent long")
    with pytest.raises(RuntimeError):
        graph.paths(knot, knot)


def test_levels_of_a_ladder(spark):
    e = spark.createDataFrame([(k, k + d) for k in range(20) for d in (1, 2)], "src long, dst long")
    assert {r["node"]: r["level"] for r in graph.levels(e).collect()} == {k: k for k in range(21)} | {21: 20}
    with pytest.raises(RuntimeError):
        graph.levels(e, 10)


def test_strong_components(spark):
    rng = random.Random(6)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(75)} | {(100, 101), (101, 102), (102, 100), (102, 103), (7, 7)}
    reach = {n: {n} for e in edges for n in e}
    for _ in reach:
        for a, b in edges:
            reach[a] |= reach[b]
    want = {n: min(m for m in reach[n] if n in reach[m]) for n in reach}
    assert {r["node"]: r["component"] for r in graph.strong_components(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()} == want


def test_loops_end_by_themselves_or_say_so(spark):
    e = spark.createDataFrame([(k, k + 1, 1) for k in range(4)], "src long, dst long, kind int")
    one = spark.createDataFrame([(0,)], "node long")
    assert graph.closure(one, e, rounds=4).count() == 5
    with pytest.raises(RuntimeError):
        graph.closure(one, e, rounds=2)
    toks = parse.tokens(spark.createDataFrame([(1, "M0 ;")], "k long, s string"), "k", "s")
    macros = spark.createDataFrame([(f"M{k}", [f"M{k + 1}"]) for k in range(9)], "name string, body array<string>")
    assert [r["token"] for r in parse.expand_macros(toks, macros, "k").orderBy("pos").collect()] == ["M9", ";"]
    with pytest.raises(RuntimeError):
        parse.expand_macros(toks, macros, "k", 3)
    state = spark.createDataFrame([(0, 0, 1)], "i long, k long, v long")
    rules = spark.createDataFrame([(k, k + 1, 2) for k in range(5)], "k long, j long, v long")
    assert semiring.lineage_closure(state, rules)[0].count() == 6
    with pytest.raises(RuntimeError):
        semiring.lineage_closure(state, rules, 2)
