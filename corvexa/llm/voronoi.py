"""Exact top-k by integer inner product: a Voronoi kNN join.

Pivots are a bounded sample of the vectors, about the root of their number. Each row joins the cell of its nearest
pivot; a cell's summary is its count, its radius, its least and largest norm and its widest angle to the pivot. Whole
cells are put together into buckets of neighbouring pivots, and a bucket is dealt in blocks, so no hot cell fills a task.

A query first meets one block of the bucket whose pivot suits it best; its k-th best score there is a floor for the
answer. Then it is sent to the blocks of just those buckets that have a cell whose bound reaches the floor, and there
meets the rows of those cells only. For a query q and a cell of pivot c, radius r, norms from l to m and angle a, a
score is at most the least of q.c + |q| r, |q| m, and |q| times m (or l, where negative) times the cosine of the angle
of q and c less a. Bounds carry a slack above rounding errors; nothing that could matter is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, hash_bound, map_batches, session_of
from .vectors import best, matrix, streamed, top_of_each, valid_vectors

#: Pivots at most (they and their summaries are what is broadcast), and rows of a block.
PIVOTS, BLOCK = 4096, 4096


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where they hold the sums, else in longs, else in Python's integers."""
    top = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * q.shape[1]
    if top < 2.0**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if top < 2.0**62:
        return q @ x.T
    exact = q.astype(object) @ x.T.astype(object)
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(axis=1))


def _cosines(dots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of products with norms a and b; 1 where a norm is 0."""
    size = a * b
    return np.where(size > 0, np.clip(dots / np.where(size > 0, size, 1.0), -1.0, 1.0), 1.0)


class Cells:
    """Pivots and summaries of their cells."""

    def __init__(self, centres: np.ndarray, rows: list):
        self.ids = np.array([r["cell"] for r in rows])
        self.heart = centres[self.ids]
        self.size = _norms(self.heart)
        self.count, self.radius, self.least, self.most, cosine = (np.array([r[c] for r in rows], dtype=np.float64) for c in ("n", "r", "l", "m", "c"))
        self.angle = np.arccos(np.clip(cosine, -1.0, 1.0))
        self.bucket = self._buckets()

    def _buckets(self) -> np.ndarray:
        """Numbers of buckets: a walk over the pivots, each time to the nearest one left, cut at about BLOCK rows."""
        left = np.ones(len(self.ids), dtype=bool)
        out, now, rows, at = np.zeros(len(self.ids), dtype=np.int64), 0, 0.0, 0
        for _ in range(len(self.ids)):
            if rows and rows + self.count[at] > BLOCK:
                now, rows = now + 1, 0.0
            out[at], left[at], rows = now, False, rows + self.count[at]
            away = ((self.heart - self.heart[at]) ** 2).sum(axis=1)
            away[~left] = np.inf
            at = int(away.argmin())
        return out

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products with the pivots, and upper bounds of scores, a row for each query and a column for each cell."""
        length = _norms(q)[:, None] * (1 + 1e-9)
        mid = q @ self.heart.T
        ball, norm = mid + length * self.radius, length * self.most
        gap = np.maximum(0.0, np.arccos(_cosines(mid, length, self.size)) - self.angle - 1e-6)
        turn = np.cos(gap)
        cone = length * np.where(turn > 0, self.most * turn, self.least * turn)
        return mid, np.minimum(np.minimum(ball, norm), cone) + 1e-9 * length * (self.radius + self.most) + 1


def exact_top_k(table: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by ``every``.

    Components become floor(scale * x). Null ids, and vectors that are null or hold null or non-finite components,
    take no part; an empty table gives no rows. ``report`` gets ``cells``, and ``visited``: the share of cells, by
    their rows, that a query meets after its first block.
    """
    spark = session_of(table)
    bounded_batches(spark)
    ws = Workspace(spark, "voronoi")
    rows = valid_vectors(ws, table, key, vector, zero=True)
    rows = ws.save(rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")), "integers")
    n = rows.count()
    wanted = max(1, min(PIVOTS, int(n**0.5)))
    sample = rows.where(F.xxhash64("id") <= hash_bound(min(1.0, (3 * wanted + 30) / max(1, n)))).collect()
    pivots = sorted({tuple(r["v"]) for r in sorted(sample, key=lambda r: r["id"])[:wanted]})
    if not pivots:  # a small table whose ids all hash high
        pivots = sorted({tuple(r["v"]) for r in rows.limit(1).collect()})
    if not pivots:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centres = np.array(pivots, dtype=np.float64)
    squares, sizes = (centres**2).sum(axis=1), _norms(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = matrix(part.column(1)).astype(np.float64)
                dots = x @ centres.T
                cell = (squares - 2 * dots).argmin(axis=1)
                norm = _norms(x)
                cosine = _cosines(dots[np.arange(len(x)), cell], norm, sizes[cell])
                away = _norms(x - centres[cell]) * (1 + 1e-9)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(away), pa.array(norm), pa.array(cosine)], names=["id", "v", "cell", "away", "norm", "cosine"])

    data = ws.save(rows.transform(map_batches, assign, "id long, v array<long>, cell long, away double, norm double, cosine double"), "cells")
    # A row for each pivot.
    summary = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r"), (F.min("norm") * (1 - 1e-9)).alias("l"), (F.max("norm") * (1 + 1e-9)).alias("m"), F.min("cosine").alias("c"))
    cells = Cells(centres, summary.orderBy("cell").collect())
    buckets = int(cells.bucket.max()) + 1
    held = np.bincount(cells.bucket, weights=cells.count, minlength=buckets)
    blocks = np.maximum(1, -(-held // BLOCK)).astype(np.int64)
    first = np.cumsum(blocks) - blocks
    place = {int(c): int(b) for c, b in zip(cells.ids, cells.bucket, strict=True)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bucket = np.array([place[c] for c in b.column(2).to_pylist()])
                unit = first[bucket] + np.mod(b.column(3).to_numpy(), blocks[bucket])
                yield pa.RecordBatch.from_arrays([pa.array(unit), b.column(0), b.column(1), b.column(2)], names=["unit", "id", "v", "cell"])

    none = F.lit(None).cast("array<long>")
    dealt = data.select("id", "v", "cell", F.xxhash64("id").alias("h")).transform(map_batches, deal, "unit long, id long, v array<long>, cell long")
    dealt = dealt.select("unit", F.lit(0).alias("tag"), "id", "v", "cell", none.alias("cells"), F.lit(None).cast("long").alias("floor"))
    asked = data.where(F.pmod("id", F.lit(every)) == 0).select("id", "v", F.xxhash64("id").alias("h"))
    schema = "unit long, id long, v array<long>, cells array<long>, floor long"

    def batch(unit, ids, v, lists, floor) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(unit, type=pa.int64()), ids, v, pa.array(lists, type=pa.list_(pa.int64())), pa.array(floor, type=pa.int64())], names=["unit", "id", "v", "cells", "floor"])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with one block of its likeliest bucket."""
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                mid, _ = cells.bounds(matrix(part.column(1)).astype(np.float64))
                bucket = cells.bucket[mid.argmax(axis=1)]
                unit = first[bucket] + np.mod(part.column(2).to_numpy(), blocks[bucket])
                yield batch(unit, part.column(0), part.column(1), [None] * part.num_rows, [None] * part.num_rows)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the blocks of the buckets that have a cell within its reach, and those cells."""
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                _, high = cells.bounds(matrix(part.column(1)).astype(np.float64))
                floor = part.column(2).to_pylist()
                reach = high >= np.array([-np.inf if f is None else float(f) for f in floor])[:, None]
                one, units, lists = [], [], []
                for q in range(len(reach)):
                    at_ = np.flatnonzero(reach[q])
                    for bucket in np.unique(cells.bucket[at_]).tolist():
                        mine = cells.ids[at_[cells.bucket[at_] == bucket]].tolist()
                        for u in range(int(first[bucket]), int(first[bucket] + blocks[bucket])):
                            one.append(q)
                            units.append(u)
                            lists.append(mine)
                picked = part.take(pa.array(one, type=pa.int64()))
                yield batch(units, picked.column(0), picked.column(1), lists, [floor[q] for q in one])

    def load(t: pa.Table) -> tuple:
        return t.column("id").to_numpy(), matrix(t.column("v")), t.column("cell").to_numpy()

    def ask(block: tuple, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, x, cell = block
        own = np.unique(cell)
        where = np.searchsorted(own, cell)
        for at in range(0, part.num_rows, 256):
            now = part.slice(at, 256)
            q_ids, lists = now.column("id").to_numpy(), now.column("cells").to_pylist()
            wanted_cells = np.array([np.isin(own, c) if c is not None else np.ones(len(own), dtype=bool) for c in lists])
            if not (columns := np.flatnonzero(wanted_cells.any(axis=0)[where])).size:
                continue
            scores = products(matrix(now.column("v")), x[columns])
            some = wanted_cells[:, where[columns]] & (q_ids[:, None] != ids[columns])
            row, to = top_of_each(scores, some, k)
            floor = np.array([-(1 << 63) if f is None else f for f in now.column("floor").to_pylist()])
            enough = scores[row, to] >= floor[row]
            row, to = row[enough], to[enough]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids[columns[to]]), pa.array(scores[row, to])], names=["query_id", "vec_id", "score"])

    def meet(queries: DataFrame) -> DataFrame:
        return streamed(dealt.unionByName(queries.withColumns({"tag": F.lit(1), "cell": F.lit(None).cast("long")})), "unit", load, ask, "query_id long, vec_id long, score long")

    likely = meet(asked.transform(map_batches, start, schema))
    floors = best(likely, k, ascending=False).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    routed = ws.save(asked.select("id", "v").join(floors, "id", "left").select("id", "v", "floor").transform(map_batches, route, schema), "routed")
    if report is not None:
        sizes_of = {int(c): float(m) for c, m in zip(cells.ids, cells.count, strict=True)}
        met = routed.select("id", F.explode("cells").alias("cell")).distinct().groupBy("cell").count().collect()
        report |= {"cells": len(cells.ids), "visited": sum(r["count"] * sizes_of[r["cell"]] for r in met) / max(1, asked.count() * n)}
    return best(meet(routed), k, ascending=False)
