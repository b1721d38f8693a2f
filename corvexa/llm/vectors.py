"""What the vector searches share: valid rows, blocks of data that queries stream past, final ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, map_batches


def valid_vectors(ws: Workspace, table: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """(id, v): rows with an id whose vector is whole and finite (and, unless ``zero``, not all zeros).

    Shorter vectors count as having zeros up to the longest one's length. Rows that repeat an id count once, with
    their least vector.
    """
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = ws.save(rows.where(finite if zero else finite & F.exists("v", lambda x: x != 0)), "vectors")
    stats = rows.agg(F.min(F.size("v")), F.max(F.size("v")), F.count("*")).first()
    if stats[0] != stats[1]:
        rows = ws.save(rows.select("id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(stats[1]) - F.size("v"))).alias("v")), "padded")
    if rows.select("id").distinct().count() < stats[2]:
        rows = ws.save(rows.groupBy("id").agg(F.min("v").alias("v")), "once")
    return rows


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column whose lists have one length, as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def streamed(rows: DataFrame, unit: str, load: Callable[[pa.Table], object], ask: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, order: str = "id") -> DataFrame:
    """Queries (tag 1) that stream past the data (tag 0) of their unit: a task holds the data of one unit and one batch.

    ``load`` makes what is held from a unit's data rows, in order of ``order``; ``ask`` answers a batch of queries.
    Units are of bounded size; queries of a unit may be any number, and data are sent once.
    """
    dealt = rows.repartition(unit).sortWithinPartitions(unit, "tag", order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            u, t = b.column(unit).to_numpy(), b.column("tag").to_numpy()
            cuts = [0, *(np.flatnonzero((u[1:] != u[:-1]) | (t[1:] != t[:-1])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if u[lo] != now:
                    now, held, ready = u[lo], [], None
                part = b.slice(lo, hi - lo)
                if t[lo] == 0:
                    held.append(part)
                elif held or ready is not None:
                    if ready is None:
                        ready, held = load(pa.Table.from_batches(held).combine_chunks()), []
                    yield from ask(ready, part)

    return dealt.transform(map_batches, run, schema)


def top_of_each(scores: np.ndarray, some: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores of each row among its ``some`` columns; ties go to the lower column."""
    width = scores.shape[1]
    least = np.iinfo(scores.dtype).min if scores.dtype.kind == "i" else -np.inf
    masked = np.where(some, scores, least)
    if width > k:
        kth = np.partition(masked, width - k, axis=1)[:, width - k]
        some = some & (masked >= kth[:, None])
    row, column = np.nonzero(some)
    s = scores[row, column]
    # Descending without negation, which the least long doesn't bear.
    order = np.lexsort((column, ~s if s.dtype.kind == "i" else -s, row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], column[keep]


def best(found: DataFrame, k: int, ascending: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query; ties go to the smaller id.

    The rank filter is also applied before the shuffle, so a task sends k rows of a query at most.
    """
    order = Window.partitionBy("query_id").orderBy(F.asc("score") if ascending else F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
