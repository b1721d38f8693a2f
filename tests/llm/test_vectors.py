"""Vector searches against brute force, with ties, nulls, copies and hot vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvexa.llm import neighbours, voronoi

SCHEMA = "vec_id long, embedding array<double>, score string, id string, v string, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], *["x"] * 4) for i, v in rows], SCHEMA)


def vectors(n=900, d=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, d))
    x = centres[rng.integers(0, 9, n)] + 0.3 * rng.normal(size=(n, d))
    x[::5] = x[3]  # a hot vector
    return [(k, v) for k, v in enumerate(x)]


ODD = [(1001, None), (1002, [None] * 12), (1003, [float("nan")] * 12), (1004, [float("inf")] * 12), (1005, []), (None, [1.0] * 12)]


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "BLOCK", 64)
    rows = vectors()
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in voronoi.exact_top_k(frame(spark, rows + ODD)).collect()}
    x = np.floor(np.array([v for _, v in rows]) * 1024).astype(np.int64)
    want = {}
    for q in range(0, len(rows), 100):
        s = x @ x[q]
        best = [j for j in np.lexsort((np.arange(len(rows)), -s)) if j != q][:10]
        want |= {(q, k + 1): (int(j), int(s[j])) for k, j in enumerate(best)}
    assert got == want


def test_top_k_leaves_out_cells_that_cannot_matter(spark, monkeypatch):
    """On clustered vectors the bounds rule most rows out, and the answers stay exact."""
    monkeypatch.setattr(voronoi, "BLOCK", 128)
    rng = np.random.default_rng(8)
    centres = 6 * rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 4000)] + 0.2 * rng.normal(size=(4000, 16))
    report: dict = {}
    found = voronoi.exact_top_k(frame(spark, list(enumerate(x))), report=report).collect()
    whole = np.floor(x * 1024).astype(np.int64)
    for q in range(0, 4000, 100):
        s = whole @ whole[q]
        want = [int(j) for j in np.lexsort((np.arange(4000), -s)) if j != q][:10]
        assert [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert report["visited"] < 0.3


def test_shorter_vectors_and_repeated_ids(spark):
    """A shorter vector has zeros up to the longest one's length; rows that repeat an id count once, with the least vector."""
    rows = [(0, [1.0, 0.0, 2.0]), (1, [5.0]), (2, [0.0, 1.0, 1.0]), (2, [0.0, 1.0, 9.0])]
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in voronoi.exact_top_k(frame(spark, rows)).collect())
    assert got == [(1, 1, 5 << 20), (2, 2, 2 << 20)]
    near = sorted((r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(frame(spark, rows)).collect())
    assert near == [(1, 2, np.sqrt(3)), (2, 1, np.sqrt(20))]


def test_few_rows_and_none(spark):
    few = frame(spark, [(0, [1.0, 2.0]), (100, [2.0, 1.0]), (7, [0.0, 0.0])])
    assert voronoi.exact_top_k(few).count() == 4
    assert neighbours.nearest(few).count() == 2  # zero vectors take no part
    assert voronoi.exact_top_k(few.limit(0)).count() == 0 and neighbours.nearest(few.limit(0)).count() == 0


def test_products_beyond_doubles():
    q, x = np.full((1, 4), 1 << 40, dtype=np.int64), np.full((1, 4), 1 << 19, dtype=np.int64)
    assert voronoi.products(q, x)[0, 0] == 4 << 59


@pytest.mark.parametrize("shard", [200, 4096])
def test_neighbours_recall_and_scores(spark, shard):
    rows = vectors(1500)
    found = neighbours.nearest(frame(spark, rows + ODD), shard_rows=shard).collect()
    x = np.array([v for _, v in rows])
    hit = n = 0
    for q in range(0, len(rows), 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        want = set(np.lexsort((np.arange(len(x)), d))[:10].tolist())
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [r[0] for r in mine] == list(range(1, 11)) and len({r[1] for r in mine}) == 10
        assert all(abs(s - np.sqrt(d[j])) < 1e-9 for _, j, s in mine)
        assert [r[1:] for r in mine] == [(j, s) for s, j in sorted((s, j) for _, j, s in mine)]
        hit, n = hit + len(want & {r[1] for r in mine}), n + 10
    assert hit >= 0.9 * n


def test_unique_vectors_per_query_of_copies(spark):
    same = frame(spark, [(k, [1.0, 2.0, 3.0]) for k in range(0, 300)])
    out = neighbours.nearest(same).groupBy("query_id").agg(F.collect_set("vec_id").alias("x")).collect()
    assert {r["query_id"]: sorted(r["x"])[:2] for r in out} == {0: [1, 2], 100: [0, 1], 200: [0, 1]}


def test_recall_over_several_full_shards(spark):
    """Evenly spread vectors, the hardest ones, in shards of production size."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(9000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found: dict = {}
    for r in neighbours.nearest(df).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 9000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(found[q] & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 10 * len(found) and len(found) == 90
