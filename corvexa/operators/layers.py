"""Network layers on array columns, and on position tables where weights are large: linear, normed, gated, experts, recurrent."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvexa.functions import activations as A
from corvexa.functions.arrow import bounded, dealt, with_columns

from .dense import dot, orthogonal_blocks, rms_normed

#: Cells of a layer whose weights are sent to all tasks, at most.
MAX_LAYER = 1 << 22
#: Rows a task takes, about, where it keeps sums for them.
DEALT = 1 << 16


def layer(weights: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """One row (w: rows of the matrix, b: biases) of weights(j, k, w) and bias(j, b). It is checked before it is broadcast."""
    if weights.count() > MAX_LAYER:
        raise ValueError("the layer is too large to broadcast; use dense.matmul")
    rows = weights.groupBy("j").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda e: e["w"]).alias("row"))
    rows = rows.join(bias, "j", "left") if bias is not None else rows.withColumn("b", F.lit(None).cast("double"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("j", "row", F.coalesce("b", F.lit(0.0)).alias("b")))).alias("x"))
    return one.select(F.transform("x", lambda e: e["row"]).alias("w"), F.transform("x", lambda e: e["b"]).alias("b"))


def affine(df: DataFrame, vector: Column, one: DataFrame, into: str, bias: bool = True) -> DataFrame:
    """``df`` with ``into``: the layer's rows times the vector, plus the biases."""
    both = df.crossJoin(F.broadcast(one.select(F.col("w").alias("__w"), F.col("b").alias("__b"))))  # one row of a checked size
    y = F.transform("__w", lambda r, j: dot(r, vector) + (F.get("__b", j) if bias else F.lit(0.0)))
    return both.withColumn(into, y).drop("__w", "__b")


def tiled(df: DataFrame, vector: Column, one: DataFrame, into: str, tile: int) -> DataFrame:
    """``affine`` by partial sums over tiles of the inner index."""
    both = df.crossJoin(F.broadcast(one.select(F.col("w").alias("__w"), F.col("b").alias("__b"))))  # one row of a checked size
    starts = F.sequence(F.lit(1), F.size(vector), F.lit(tile))
    y = F.transform("__w", lambda r, j: F.aggregate(starts, F.get("__b", j), lambda s, at: s + dot(F.slice(r, at, tile), F.slice(vector, at, tile))))
    return both.withColumn(into, y).drop("__w", "__b")


def gated_rms_norm(v: Column, weight: Column, gate: Column, eps: float = 1e-6) -> Column:
    """RMS norm, learned scale, then the gate's SiLU."""
    scaled = F.zip_with(rms_normed(v, eps), weight, lambda x, w: x * w)
    return F.zip_with(scaled, gate, lambda x, g: x * A.silu(g))


def expert(df: DataFrame, vector: Column, gate: DataFrame, up: DataFrame, down: DataFrame, into: str) -> DataFrame:
    """One expert: down(SwiGLU(gate(x), up(x)))."""
    h = affine(affine(df, vector, gate, "__g"), vector, up, "__u")
    h = h.withColumn("__h", F.zip_with("__g", "__u", A.swiglu))
    return affine(h, F.col("__h"), down, into).drop("__g", "__u", "__h")


def mlp_backward(df: DataFrame, vector: Column, grad: Column, first: DataFrame, second: DataFrame) -> DataFrame:
    """``df`` with ``dh`` (gradients of the hidden units before their relu) and ``dx``, for a gradient of the outputs."""
    out = affine(df, vector, first, "__pre")
    both = out.crossJoin(F.broadcast(first.select(F.col("w").alias("__w1")))).crossJoin(F.broadcast(second.select(F.col("w").alias("__w2"))))  # one row each
    column = lambda w, k: F.transform(w, lambda r: F.get(r, k))
    dh = F.transform("__pre", lambda p, u: F.when(p > 0, dot(grad, column("__w2", u))).otherwise(F.lit(0.0)))
    both = both.withColumn("dh", dh)
    # The sum of the first layer's rows, each times its unit's gradient.
    dx = F.aggregate(F.arrays_zip("__w1", "dh"), F.transform(vector, lambda _: F.lit(0.0)), lambda s, e: F.zip_with(s, e["__w1"], lambda a, w: a + w * e["dh"]))
    return both.withColumn("dx", dx).drop("__pre", "__w1", "__w2")


def route(scores: DataFrame, k: int, *by: str) -> DataFrame:
    """(by..., expert, weight) of the k best scores(by..., expert, s): softmax over the chosen ones; ties go to the smaller expert."""
    top = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("s"), "expert"))).where(F.col("rank") <= k)
    w = Window.partitionBy(*by)
    e = F.exp(F.col("s") - F.max("s").over(w))
    return top.withColumn("e", e).withColumn("weight", F.col("e") / F.sum("e").over(w)).select(*by, "expert", "rank", "weight")


def packed_fields(rows: DataFrame, by: list[str], bits: int) -> DataFrame:
    """(by..., word, packed): values of rows(by..., flat, code) at their flat places, as many in a 32-bit word as fit."""
    n = 32 // bits
    word = F.call_function("div", F.col("flat"), F.lit(n).cast("long"))
    code = F.call_function("shiftleft", F.col("code").cast("long"), ((F.col("flat") % n) * bits).cast("int"))
    return rows.groupBy(*by, word.alias("word")).agg(F.bit_or(code).alias("packed"))


def unpacked_fields(words: DataFrame, by: list[str], bits: int) -> DataFrame:
    """(by..., flat, code) of words(by..., word, packed)."""
    n = 32 // bits
    each = words.select(*by, "word", "packed", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("at"))
    code = F.call_function("shiftright", F.col("packed"), F.col("at") * bits).bitwiseAND(F.lit((1 << bits) - 1))
    return each.select(*by, (F.col("word") * n + F.col("at")).alias("flat"), code.alias("code"))


def gated_delta(rows: DataFrame, head: str, order: str, chunk: int = 64) -> DataFrame:
    """(head, order, out): the gated delta recurrence over rows(head, order, q, k, v, decay, beta), a matrix state a head.

    S decays by exp(decay); the error of its reading at the normalised key, times sigmoid(beta), is written there; the
    normalised query reads it. A head's rows stream past in order, ``chunk`` at a time, so a task holds one state.
    """
    kind = dict(rows.dtypes)[head]
    dealt = rows.select(head, order, "q", "k", "v", "decay", "beta").repartition(head).sortWithinPartitions(head, order)

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True) + 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            for lo in range(0, b.num_rows, chunk):
                part = b.slice(lo, chunk)
                heads = part.column(0).to_pylist()
                q, k, v = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) for c in (2, 3, 4))
                q, k = unit(q), unit(k)
                decay, beta = np.exp(part.column(5).to_numpy()), 1 / (1 + np.exp(-part.column(6).to_numpy()))
                out = np.empty_like(v)
                for t, h in enumerate(heads):
                    if h != now:
                        now, state = h, np.zeros((k.shape[1], v.shape[1]))
                    state = state * decay[t]
                    state = state + np.outer(k[t], (v[t] - k[t] @ state) * beta[t])
                    out[t] = q[t] @ state
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out.tolist(), type=pa.list_(pa.float64()))], names=[head, order, "out"])

    return bounded(dealt).mapInArrow(run, f"`{head}` {kind}, `{order}` {dict(rows.dtypes)[order]}, out array<double>")


def linear_recurrence(rows: DataFrame, sequence: str, order: str, keep: str, add: str) -> DataFrame:
    """(sequence, order, h) of h = keep h + add along each sequence, from 0. Rows stream past in order; a task holds one number."""
    kinds = dict(rows.dtypes)
    dealt = rows.select(sequence, order, F.col(keep).cast("double").alias("__a"), F.col(add).cast("double").alias("__b")).repartition(sequence).sortWithinPartitions(sequence, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, 0.0
        for b in batches:
            out = []
            for s, a, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if s != now:
                    now, h = s, 0.0
                h = a * h + x
                out.append(h)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, type=pa.float64())], names=[sequence, order, "h"])

    return bounded(dealt).mapInArrow(run, f"`{sequence}` {kinds[sequence]}, `{order}` {kinds[order]}, h double")


def muon(df: DataFrame, param: str, grad: str, momentum: str, rows: int, rate: float, decay: float, steps: int = 5, row_scale: bool = False) -> DataFrame:
    """``df`` with ``updated`` and ``buffer``: momentum, Nesterov look-ahead, orthogonalised blocks of ``rows`` rows, step.

    With ``row_scale`` the step grows by the root of rows over columns, where there are more rows.
    """
    m, g = F.col(momentum), F.col(grad)
    buffer = F.zip_with(m, g, lambda x, y: x * decay + y)
    out = df.withColumn("buffer", buffer).withColumn("__n", F.zip_with(g, buffer, lambda x, y: x + y * decay))

    scale = lambda r, c: max(1.0, r / c) ** 0.5 if row_scale else 1.0
    out = with_columns(out, "__n", "__o array<double>", lambda vs: [orthogonal_blocks(vs, rows, steps, scale)])
    return out.withColumn("updated", F.zip_with(F.col(param), F.col("__o"), lambda p, o: p - rate * o)).drop("__n", "__o")


def mix_fixed(features: list[Column], weights: list[list[int]]) -> Column:
    """A row's whole-numbered features mixed by each row of ``weights`` in 16.16 fixed point: each product shifted, then summed.

    For small weights, which become part of the generated code; larger ones go to ``contract_fixed``. Sums are not yet taken
    modulo 2**32, so they can be added up; a null feature makes them null.
    """
    mixed = lambda row: functools.reduce(operator.add, (F.shiftright(x * F.lit(w).cast("long"), 16) for x, w in zip(features, row, strict=True)))
    return F.array(*[mixed(row) for row in weights])


def contract_fixed(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """(by..., i, j, v) of a(by..., i, k, v) and b(by..., k, j, v) in 16.16 fixed point: each product shifted, sums modulo 2**32.

    ``a`` is dealt by the keys of its sums: where ``b`` is broadcast, a task holds the sums of about ``DEALT`` rows at any size.
    """
    both = dealt(a.select(*by, "i", "k", F.col("v").alias("x")), DEALT, *by, "i").join(b.select(*by, "k", "j", F.col("v").alias("y")), [*by, "k"])
    return both.groupBy(*by, "i", "j").agg(F.pmod(F.sum(F.shiftright(F.col("x") * F.col("y"), 16)), F.lit(1 << 32)).alias("v"))
