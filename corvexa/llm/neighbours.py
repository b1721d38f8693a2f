"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Equal vectors share one vertex: its class keeps the k + 1 smallest ids, and as ties go to smaller ids no further copy
can be among k answers. Vertices are dealt to shards of about SHARD rows. A shard's graph is built in growing batches:
a greedy search from the medoid proposes neighbours, relaxed pruning (a candidate goes if an already chosen neighbour
is nearer to it, by the factor ALPHA, than the vertex is) keeps edges of different directions, and each edge's reverse
is added and pruned alike. Vertices that the medoid doesn't reach get an edge from their nearest reached vertex.
Every query searches every shard with a beam, and the shards' answers are merged. The graphs are written to the shared
folder once, and each is read once: a task holds one shard's graph, and the queries stream past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, session_of
from .vectors import best, matrix, streamed, valid_vectors

SHARD, DEGREE, BEAM, ALPHA = 4096, 28, 64, 1.2
#: Free places of a vertex for edges that keep all vertices within reach.
SPARE = 4


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the ``width`` best vertices found for each query, nearest first (-1: none).

    All queries advance together: each step expands every query's nearest unexpanded vertex.
    """
    n, rows = len(q), np.arange(len(q))[:, None]
    ids = np.full((n, width), -1, dtype=np.int64)
    away = np.full((n, width), np.inf)
    done = np.ones((n, width), dtype=bool)
    ids[:, 0], done[:, 0] = start, False
    away[:, 0] = ((q - x[start]) ** 2).sum(axis=1)
    live = np.arange(n)
    while len(live):
        at = (~done[live]).argmax(axis=1)
        new = edges[ids[live, at]]
        done[live, at] = True
        new = np.where((new[:, :, None] == ids[live][:, None, :]).any(axis=2), -1, new)
        d = np.einsum("brd,brd->br", g := x[new] - q[live][:, None, :], g)
        d[new < 0] = np.inf
        all_ids, all_away = np.concatenate([ids[live], new], axis=1), np.concatenate([away[live], d], axis=1)
        all_done = np.concatenate([done[live], new < 0], axis=1)
        order = np.argsort(all_away, axis=1, kind="stable")[:, :width]
        r = rows[: len(live)]
        ids[live], away[live], done[live] = all_ids[r, order], all_away[r, order], all_done[r, order]
        live = live[~done[live].all(axis=1)]
    ids[np.isinf(away)] = -1
    return ids, away


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each point, up to ``degree`` candidates of different directions, nearest first (-1: none)."""
    c = np.where(candidates == points[:, None], -1, candidates)
    c = np.sort(c, axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    v = x[c]
    d = ((v - x[points][:, None, :]) ** 2).sum(axis=2)
    d[c < 0] = np.inf
    square = (v**2).sum(axis=2)
    mutual = square[:, :, None] + square[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
    out = np.full((len(points), degree), -1, dtype=np.int64)
    rows, alive = np.arange(len(points)), d.copy()
    for k in range(degree):
        best_at = alive.argmin(axis=1)
        some = np.isfinite(alive[rows, best_at])
        if not some.any():
            break
        out[some, k] = c[rows, best_at][some]
        # Squared distances, so the factor is squared too.
        gone = alpha * alpha * mutual[rows, best_at] <= d
        gone[rows, best_at] = True
        alive[gone & some[:, None]] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, width: int = BEAM, alpha: float = ALPHA, seed: int = 5) -> tuple[np.ndarray, int]:
    """Edges (a row of vertex numbers for each vertex, -1 where none) and the start vertex."""
    n, rng = len(x), np.random.default_rng(seed)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n, degree + SPARE), -1, dtype=np.int64)
    order = rng.permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at, size = 1, 1
    while at < n:
        points = order[at : at + size]
        found, _ = beam_search(x, edges, start, x[points], width)
        # Points of one batch don't see each other yet: those of the same batch are candidates too.
        mates = np.broadcast_to(points, (len(points), len(points))) if len(points) <= 16 else rng.choice(points, (len(points), 16))
        edges[points, :degree] = robust_prune(x, points, np.concatenate([found, mates], axis=1), degree, alpha)
        _add_reverse(x, edges, points, degree, alpha)
        at += len(points)
        size = min(256, 2 * size)
    # A second look at all points on the finished graph, in larger batches.
    for at in range(0, n, 512):
        points = order[at : at + 512]
        found, _ = beam_search(x, edges, start, x[points], width)
        edges[points, :degree] = robust_prune(x, points, np.concatenate([found, edges[points]], axis=1), degree, alpha)
        _add_reverse(x, edges, points, degree, alpha)
    _reach_all(x, edges, start, degree)
    return edges, start


def _add_reverse(x: np.ndarray, edges: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> None:
    to = edges[points, :degree]
    source = np.repeat(points, degree)[to.ravel() >= 0]
    to = to.ravel()[to.ravel() >= 0]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    place = np.arange(len(to)) - np.searchsorted(to, to)
    turn = place // degree
    for t in range(int(turn.max(initial=-1)) + 1):
        now = turn == t
        target = np.unique(to[now])
        more = np.full((len(target), degree), -1, dtype=np.int64)
        more[np.searchsorted(target, to[now]), place[now] % degree] = source[now]
        edges[target, :degree] = robust_prune(x, target, np.concatenate([edges[target, :degree], more], axis=1), degree, alpha)


def _reach_all(x: np.ndarray, edges: np.ndarray, start: int, degree: int) -> None:
    n = len(x)
    seen = np.zeros(n, dtype=bool)
    seen[start] = True
    front = np.array([start])
    while True:
        while len(front):
            new = np.unique(edges[front].ravel())
            new = new[new >= 0]
            front = new[~seen[new]]
            seen[front] = True
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return
        # The nearest reached vertex with a free place takes the first lost one; what hangs on it is then reached too.
        u = int(lost[0])
        d = ((x - x[u]) ** 2).sum(axis=1)
        d[~seen | (edges >= 0).all(axis=1)] = np.inf
        v = int(d.argmin())
        edges[v, np.flatnonzero(edges[v] < 0)[-1]] = u
        seen[u] = True
        front = np.array([u])


def nearest(table: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): of the rows whose id is divisible by ``every`` the k nearest rows found.

    The score is the Euclidean distance in doubles. Null ids and vectors that are null, zero, or hold null or
    non-finite components take no part; an empty table gives no rows.
    """
    spark = session_of(table)
    bounded_batches(spark)
    ws = Workspace(spark, "graph")
    rows = valid_vectors(ws, table, key, vector, zero=False)
    # k + 1 ids of each distinct vector; the filter on the rank is applied before the shuffle too.
    order = Window.partitionBy("h", "v").orderBy("id")
    ranked = rows.withColumn("h", F.xxhash64("v")).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1)
    ranked = ws.save(ranked.withColumn("rep", F.min("id").over(Window.partitionBy("h", "v"))).select("rep", "id", "v"), "classes")
    reps = ranked.where("rep = id")
    shards = max(1, -(-reps.count() // shard_rows))
    dealt = reps.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "id", "v")

    def build(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by("id").combine_chunks()
        edges, start = build_graph(matrix(part.column("v").combine_chunks()))
        flag = np.zeros(len(edges), dtype=bool)
        flag[start] = True
        return pa.table({"shard": part.column("shard"), "id": part.column("id"), "v": part.column("v"), "at": pa.array(np.arange(len(edges))), "edges": pa.array(edges.tolist(), type=pa.list_(pa.int64())), "start": pa.array(flag)})

    index = ws.save(dealt.groupBy("shard").applyInArrow(build, "shard long, id long, v array<double>, at long, edges array<long>, start boolean"), "index")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    nothing = {"at": F.lit(None).cast("long"), "edges": F.lit(None).cast("array<long>"), "start": F.lit(False)}
    sought = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("tag"), "id", "v").withColumns(nothing)

    def load(t: pa.Table) -> tuple:
        start = int(np.flatnonzero(t.column("start").combine_chunks().to_numpy(zero_copy_only=False))[0])
        return t.column("id").to_numpy(), matrix(t.column("v")), matrix(t.column("edges")), start

    def ask(index: tuple, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x_ids, x, edges, start = index
        for lo in range(0, part.num_rows, 256):
            now = part.slice(lo, 256)
            q_ids, q = now.column("id").to_numpy(), matrix(now.column("v"))
            found, _ = beam_search(x, edges, start, q, max(BEAM, 2 * k))
            one, col = np.nonzero(found[:, : k + 1] >= 0)
            p = found[one, col]
            away = np.sqrt(((x[p] - q[one]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[one]), pa.array(x_ids[p]), pa.array(away)], names=["query_id", "vec_id", "score"])

    found = streamed(index.withColumn("tag", F.lit(0)).unionByName(sought), "shard", load, ask, "query_id long, vec_id long, score double", order="at")
    # k + 1 classes of a query hold its k nearest rows; then classes become their rows.
    classes = best(found, k + 1, ascending=True).select("query_id", F.col("vec_id").alias("rep"), "score")
    rows_of = ranked.select("rep", F.col("id").alias("vec_id"))
    return best(classes.join(rows_of, "rep").where("vec_id <> query_id"), k, ascending=True)
