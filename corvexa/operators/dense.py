"""Dense numeric operators: array expressions in the JVM, position tables for matrices, NumPy blocks for small solves."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvexa.functions.arrow import with_columns

#: Rows of a block of vectors.
BLOCK = 8192


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def scale(v: Column, k: Column) -> Column:
    return F.transform(v, lambda x: x * k)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def rms_normed(v: Column, eps: float = 1e-6) -> Column:
    return scale(v, 1 / F.sqrt(dot(v, v) / F.size(v) + eps))


def l2_normed(v: Column, eps: float = 1e-12) -> Column:
    return scale(v, 1 / F.sqrt(dot(v, v) + eps))


def softmaxed(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return scale(e, 1 / total(e))


def bhattacharyya(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda x, y: F.sqrt(F.greatest(x, F.lit(0.0)) * F.greatest(y, F.lit(0.0)))))


def linear(v: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """weights[k][i]: a fixed matrix in the plan; larger ones belong in ``matmul``."""
    columns = zip(*weights, strict=True)
    return F.array(*[dot(v, F.array(*map(F.lit, w))) + b for w, b in zip(columns, bias, strict=True)])


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(batch, i, j, v) of position tables a(batch, i, k, v) and b(batch, k, j, v); sums combine before the shuffle."""
    both = a.select("batch", "i", "k", F.col("v").alias("x")).join(b.select("batch", "k", "j", F.col("v").alias("y")), ["batch", "k"])
    return both.groupBy("batch", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def stencil(grid: DataFrame, kernel: dict[tuple[int, int], float]) -> DataFrame:
    """(y, x, v): weighted sums of neighbours, zero outside. Every cell is sent to the cells it touches and summed."""
    taps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("w")) for (dy, dx), w in kernel.items()])
    sent = grid.select("y", "x", "v", F.explode(taps).alias("t"))
    sent = sent.select((F.col("y") - F.col("t.dy")).alias("y"), (F.col("x") - F.col("t.dx")).alias("x"), (F.col("v") * F.col("t.w")).alias("v"))
    return sent.groupBy("y", "x").agg(F.sum("v").alias("v")).join(grid.select("y", "x"), ["y", "x"], "left_semi")


def patches(grid: DataFrame, radius: int = 1) -> DataFrame:
    """(y, x, patch): the flattened neighbourhood of each cell, 0 outside."""
    side = range(-radius, radius + 1)
    at = [(dy, dx) for dy in side for dx in side]
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate(at)])
    sent = grid.select("y", "x", "v", F.explode(taps).alias("t")).select((F.col("y") - F.col("t.dy")).alias("y"), (F.col("x") - F.col("t.dx")).alias("x"), F.col("t.k").alias("k"), "v")
    maps = sent.groupBy("y", "x").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m")).join(grid.select("y", "x"), ["y", "x"], "left_semi")
    return maps.select("y", "x", F.array(*[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0.0)) for k in range(len(at))]).alias("patch"))


def with_fft(df: DataFrame, vector: str, into: str = "spectrum") -> DataFrame:
    """Complex spectrum of an array column, as alternating real and imaginary parts."""

    def one(v):
        if v is None:
            return None
        z = np.fft.fft(np.array(v, dtype=np.float64))
        return np.stack([z.real, z.imag], axis=1).ravel().tolist()

    return with_columns(df, vector, f"{into} array<double>", lambda vs: [[one(v) for v in vs]])


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of matrices, each sum taken term by term from the first: it depends on no library's order or fused steps."""
    out = np.zeros((*x.shape[:-1], y.shape[-1]))
    for k in range(x.shape[-1]):
        out += x[..., :, k, None] * y[..., None, k, :]
    return out


def newton_schulz(m: np.ndarray, steps: int = 5) -> np.ndarray:
    """The nearest orthogonal matrix, by a fixed quintic polynomial; of each matrix of a stack.

    The steps multiply errors of the last place, so that sums in another order differ in the sixth decimal at times.
    """
    a, b, c = 3.4445, -4.7750, 2.0315
    flat = m.reshape(*m.shape[:-2], 1, -1)
    x = m / (np.sqrt(_products(flat, np.swapaxes(flat, -1, -2))) + 1e-7)
    flip = x.shape[-2] > x.shape[-1]
    x = np.swapaxes(x, -1, -2) if flip else x
    for _ in range(steps):
        g = _products(x, np.swapaxes(x, -1, -2))
        x = a * x + _products(b * g + c * _products(g, g), x)
    return np.swapaxes(x, -1, -2) if flip else x


def orthogonal_blocks(vs: list, rows: int, steps: int = 5, scale: Callable[[int, int], float] = lambda r, c: 1.0) -> list:
    """``newton_schulz`` of flattened blocks, those of one size in one go, times ``scale`` of their shape; null stays null."""
    out: list = [None] * len(vs)
    sizes: dict[int, list[int]] = {}
    for k, v in enumerate(vs):
        if v is not None:
            sizes.setdefault(len(v), []).append(k)
    for ks in sizes.values():
        m = np.array([vs[k] for k in ks], dtype=np.float64).reshape(len(ks), rows, -1)
        done = (newton_schulz(m, steps) * scale(*m.shape[1:])).reshape(len(ks), -1).tolist()
        for k, v in zip(ks, done, strict=True):
            out[k] = v
    return out


def with_orthogonal(df: DataFrame, block: str, rows: int, into: str = "orthogonal", steps: int = 5) -> DataFrame:
    """Blocks of ``rows`` rows, flattened, each made orthogonal."""
    return with_columns(df, block, f"{into} array<double>", lambda vs: [orthogonal_blocks(vs, rows, steps)])


def with_inverse(df: DataFrame, block: str, size: int, damping: float = 0.0, into: str = "inverse") -> DataFrame:
    """Inverse of each square block plus damping times the identity."""
    one = lambda v: None if v is None else np.linalg.inv(np.array(v, dtype=np.float64).reshape(size, size) + damping * np.eye(size)).ravel().tolist()
    return with_columns(df, block, f"{into} array<double>", lambda vs: [[one(v) for v in vs]])


def unpack_fields(word: Column, bits: int, count: int, signed: bool = False) -> Column:
    """Fields of a packed word, lowest first."""
    top, half = (1 << bits) - 1, 1 << (bits - 1)
    field = lambda k: F.call_function("shiftright", word, (k * bits).cast("int")).bitwiseAND(F.lit(top))
    sign = (lambda x: F.when(x >= half, x - (top + 1)).otherwise(x)) if signed else (lambda x: x)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: sign(field(k)))


def int4_products(df: DataFrame, key: str, vector: str, weights: DataFrame) -> DataFrame:
    """(key, r, y): each vector times the rows of weights(r, words, scale), eight signed 4-bit weights to a word."""
    if weights.count() > BLOCK:
        raise ValueError("the matrix has too many rows to broadcast")
    fields = F.flatten(F.transform("words", lambda w: unpack_fields(w, 4, 8, signed=True)))
    both = df.select(key, vector).crossJoin(F.broadcast(weights.select("r", fields.alias("__w"), "scale")))  # rows of a checked number
    return both.select(key, "r", (dot(F.col(vector), F.col("__w")) * F.col("scale")).alias("y"))


def gram(pairs: DataFrame, coefficients: DataFrame) -> DataFrame:
    """(i, j, v): the coefficient c of each pair(i, j, pair); 0 where there is none."""
    return pairs.join(coefficients, "pair", "left").select("i", "j", F.coalesce("c", F.lit(0).cast("long")).alias("v"))


def pack_fields(fields: Column, bits: int) -> Column:
    low = F.transform(fields, lambda x, k: F.call_function("shiftleft", x.cast("long").bitwiseAND(F.lit((1 << bits) - 1)), (k * bits).cast("int")))
    return F.aggregate(low, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def rope(v: Column, position: Column, dims: int, base: float = 10_000.0, backward: bool = False) -> Column:
    """Rotary embedding of the first ``dims`` components, in pairs (k, k + dims / 2); the rest passes through."""
    half, sign = dims // 2, -1.0 if backward else 1.0
    parts = []
    for k in range(half):
        t = position * float(base ** (-2.0 * k / dims))
        parts.append((F.get(v, F.lit(k)), F.get(v, F.lit(k + half)), F.cos(t), F.sin(t) * sign))
    first = [a * c - b * s for a, b, c, s in parts]
    second = [b * c + a * s for a, b, c, s in parts]
    return F.concat(F.array(*first, *second), F.slice(v, dims + 1, F.greatest(F.size(v) - dims, F.lit(0))))


def nearest(points: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "v") -> DataFrame:
    """(query, rank, key, distance): exact k nearest of each query, other than itself; ties go to the smaller key.

    Blocks of queries meet blocks of points, so neither side is broadcast. A tile picks candidates by a matrix product
    with a margin for its rounding, and sums the squares of those in the order of the components. Vectors have one length.
    """
    from pyspark.sql import Window

    def cells(n: int) -> int:
        return max(1, -(-n // BLOCK))

    def blocks(side: DataFrame, own: str, other: str, own_n: int, other_n: int) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_n - 1).cast("long")))
        return side.select(F.pmod(F.xxhash64(key), F.lit(own_n).cast("long")).alias(own), F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).select(own, "id", "v", each.alias(other))

    def solve(qs: pa.Table, ps: pa.Table) -> pa.Table:
        (q_ids, q), (p_ids, p) = _rows(qs), _rows(ps)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        squares = (p * p).sum(axis=1)
        for at in range(0, len(q) if len(p) else 0, 64):
            x, own = q[at : at + 64], q_ids[at : at + 64]
            length = (x * x).sum(axis=1)
            near = squares - 2 * (x @ p.T) + length[:, None]
            near[own[:, None] == p_ids] = np.inf
            kth = np.partition(near, min(k, len(p)) - 1, axis=1)[:, min(k, len(p)) - 1]
            margin = 1e-9 * (length + squares.max()) + 1e-300
            one, to = np.nonzero((near <= (kth + margin)[:, None]) & np.isfinite(near))
            exact = np.zeros(len(one))
            for j in range(p.shape[1]):
                exact += (p[to, j] - x[one, j]) ** 2
            order = np.lexsort((p_ids[to], exact, one))
            one, to, exact = one[order], to[order], exact[order]
            keep = np.arange(len(one)) - np.searchsorted(one, one) < k
            out.append((own[one[keep]], p_ids[to[keep]], exact[keep]))
        return pa.table({n: np.concatenate(c) for n, c in zip(("query", key, "distance"), zip(*out, strict=True), strict=True)})

    n, m = cells(queries.count()), cells(points.count())
    asked = blocks(queries, "chunk", "block", n, m).groupBy("chunk", "block")
    held = blocks(points, "block", "chunk", m, n).groupBy("chunk", "block")
    pairs = asked.cogroup(held).applyInArrow(solve, f"query long, `{key}` long, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", key))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def _rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the matrix of a block's vectors."""
    v = t.column("v").combine_chunks()
    flat = (pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v).flatten().to_numpy(zero_copy_only=False)
    return t.column("id").to_numpy(), flat.reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 0))
