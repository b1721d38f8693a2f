"""Small algebras as column expressions: multivectors, fractional derivatives, layer gradients."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def geometric_product(a: list[Column], b: list[Column]) -> list[Column]:
    """Scalar, e1, e2 and e12 parts of the product of two plane multivectors."""
    s, x, y, p = a
    t, u, v, q = b
    return [s * t + x * u + y * v - p * q, s * u + x * t - y * q + p * v, s * v + y * t + x * q - p * u, s * q + p * t + x * v - y * u]


def grunwald_weights(order: float, n: int) -> list[float]:
    """Weights of the n newest values in a fractional derivative."""
    w = [1.0]
    for k in range(1, n):
        w.append(w[-1] * (k - 1 - order) / k)
    return w


def fractional_derivative(values: Column, order: float, n: int) -> Column:
    """Of an array, oldest first: the weighted sum of each value and the n - 1 before it."""
    w = F.array(*map(F.lit, grunwald_weights(order, n)))
    return F.transform(values, lambda _, k: F.aggregate(F.sequence(F.lit(0), F.least(k, F.lit(n - 1))), F.lit(0.0), lambda s, j: s + F.get(w, j) * F.get(values, k - j)))


def relu_layer_gradients(x: Column, w1: Column, w2: Column, grad: Column) -> tuple[Column, Column, Column]:
    """Of y = w2 * relu(w1 * x): gradients of x, w1 and w2."""
    h = F.greatest(w1 * x, F.lit(0.0))
    back = F.when(w1 * x > 0, grad * w2).otherwise(F.lit(0.0))
    return back * w1, back * x, grad * h
