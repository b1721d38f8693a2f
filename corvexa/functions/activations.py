"""Activations, gates, their derivatives and optimiser steps as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def swiglu(gate: Column, up: Column) -> Column:
    return silu(gate) * up


def leaky_relu_sq(x: Column, slope: float = 0.5) -> Column:
    y = F.greatest(x * slope, x)
    return y * y


def leaky_relu_sq_grad(x: Column, grad: Column, slope: float = 0.5) -> Column:
    return grad * F.when(x > 0, 2 * x).otherwise(2 * slope * slope * x)


def softcap(x: Column, cap: float) -> Column:
    return F.tanh(x / cap) * cap


def softcap_grad(x: Column, grad: Column, cap: float) -> Column:
    t = F.tanh(x / cap)
    return grad * (1 - t * t)


def sigmoid_gate(branch: Column, gate: Column) -> Column:
    return branch * sigmoid(gate)


def skip_gate(branch: Column, skip: Column, gate: Column) -> Column:
    s = sigmoid(gate)
    return s * branch + (1 - s) * skip


def skip_gate_grad(branch: Column, skip: Column, gate: Column, grad: Column) -> tuple[Column, Column, Column]:
    """Gradients of branch, skip and gate."""
    s = sigmoid(gate)
    return grad * s, grad * (1 - s), grad * (branch - skip) * s * (1 - s)


def adamw(p: Column, g: Column, m: Column, v: Column, step: int, rate: float = 1e-3, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, decay: float = 0.01) -> tuple[Column, Column, Column]:
    """New parameter, first and second moment."""
    m, v = b1 * m + (1 - b1) * g, b2 * v + (1 - b2) * g * g
    return p - rate * (m / (1 - b1**step) / (F.sqrt(v / (1 - b2**step)) + eps) + decay * p), m, v


def scale_grad(x: Column, scale: Column, grad: Column) -> tuple[Column, Column]:
    """Of x * scale: gradients of x and of the scale."""
    return grad * scale, grad * x


def residual_grad(grad: Column) -> tuple[Column, Column, Column]:
    """Of x + attention + mlp: each gets the gradient as it is."""
    return grad, grad, grad


def ema(old: Column, new: Column, decay: float) -> Column:
    return decay * old + (1 - decay) * new


def gptq_round(x: Column, scale: Column, top: int) -> Column:
    return F.least(F.greatest(F.round(x / scale), F.lit(0.0)), F.lit(float(top)))


def clip(x: Column, k: Column) -> Column:
    return F.least(F.greatest(x, -k), k)


def rk4(y: Column, k1: Column, k2: Column, k3: Column, k4: Column, h: float) -> Column:
    return y + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)


def hard_threshold(z: Column, t: Column) -> Column:
    """Sign-magnitude words whose magnitude reaches the threshold; others become 0."""
    return F.when(z.bitwiseAND(F.lit(0x7FFFFFFF)) >= t, z).otherwise(F.lit(0).cast("long"))
