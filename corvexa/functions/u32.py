"""Arithmetic of unsigned 32-bit numbers kept in BIGINT columns: wrapping, saturating, shifts, bit tricks.

Everything stays in 64-bit integer code (no decimals, no strings), so whole-stage codegen covers it. Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD, MAX = 1 << 32, (1 << 32) - 1


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def wrap(x) -> Column:
    return F.pmod(_c(x), F.lit(WORD))


def add(a, b) -> Column:
    return wrap(_c(a) + _c(b))


def sub(a, b) -> Column:
    return wrap(_c(a) - _c(b))


def _halves(a, b) -> tuple[Column, Column]:
    """a times the upper and the lower 16 bits of b; both stay below 2**48."""
    a, b = _c(a), _c(b)
    return a * F.shiftright(b, 16), a * b.bitwiseAND(F.lit(65535))


def mul(a, b) -> Column:
    high, low = _halves(a, b)
    return wrap(F.shiftleft(high.bitwiseAND(F.lit(MAX)), 16) + low)


def mul_high(a, b) -> Column:
    high, low = _halves(a, b)
    return F.shiftright(high + F.shiftright(low, 16), 16)


def div(a, b) -> Column:
    """Division by zero gives the largest value."""
    return F.coalesce(F.call_function("div", _c(a), F.nullif(_c(b), F.lit(0).cast("long"))), F.when(_c(a).isNotNull() & (_c(b) == 0), F.lit(MAX).cast("long")))


def mod(a, b) -> Column:
    """The remainder of division by zero is 0."""
    return F.when(_c(b) == 0, F.lit(0).cast("long")).otherwise(_c(a) % F.nullif(_c(b), F.lit(0).cast("long")))


def abs_diff(a, b) -> Column:
    return F.abs(_c(a) - _c(b))


def saturating_add(a, b) -> Column:
    return F.least(_c(a) + _c(b), F.lit(MAX))


def saturating_sub(a, b) -> Column:
    return F.greatest(_c(a) - _c(b), F.lit(0))


def saturating_mul(a, b) -> Column:
    return F.when(mul_high(a, b) > 0, F.lit(MAX)).otherwise(mul(a, b))


def _by(name: str, x, n) -> Column:
    """Shift amounts are masked with 31."""
    return F.call_function(name, _c(x), _c(n).bitwiseAND(F.lit(31)).cast("int"))


def shl(a, n) -> Column:
    return _by("shiftleft", a, n).bitwiseAND(F.lit(MAX))


def shr(a, n) -> Column:
    return _by("shiftright", a, n)


def rotate_left(a, n) -> Column:
    return shl(a, n).bitwiseOR(F.call_function("shiftright", _c(a), (F.lit(32) - _c(n).bitwiseAND(F.lit(31))).cast("int")))


def rotate_right(a, n) -> Column:
    return rotate_left(a, F.lit(32) - _c(n).bitwiseAND(F.lit(31)))


def bit_not(x) -> Column:
    return F.lit(MAX) - _c(x)


def negate(x) -> Column:
    return wrap(-_c(x))


def popcount(x) -> Column:
    return F.bit_count(_c(x)).cast("long")


def ctz(x) -> Column:
    x = _c(x)
    return F.when(x == 0, F.lit(32).cast("long")).otherwise(popcount(x.bitwiseAND(-x) - 1))


def clz(x) -> Column:
    x = _c(x)
    for s in (1, 2, 4, 8, 16):
        x = x.bitwiseOR(F.shiftright(x, s))
    return F.lit(32) - popcount(x)


def reverse_bits(x) -> Column:
    x = _c(x)
    for s, m in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF)):
        x = F.shiftleft(x.bitwiseAND(F.lit(m)), s).bitwiseOR(F.shiftright(x, s).bitwiseAND(F.lit(m)))
    return F.shiftleft(x.bitwiseAND(F.lit(65535)), 16).bitwiseOR(F.shiftright(x, 16))


def unpack(x, bits: int, at: int) -> Column:
    """The ``at``-th field of ``bits`` bits, from the lowest."""
    return F.shiftright(_c(x), bits * at).bitwiseAND(F.lit((1 << bits) - 1))


def avg_floor(a, b) -> Column:
    a, b = _c(a), _c(b)
    return a.bitwiseAND(b) + F.shiftright(a.bitwiseXOR(b), 1)


def clamp(x, lo, hi) -> Column:
    return F.least(F.greatest(_c(x), _c(lo)), _c(hi))


def fma(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with one rounding: the product's rounding error, found by splitting both factors, is added to the sum."""
    split = lambda x: (lambda t: t - (t - x))(x * 134217729.0)
    a, b, c = a.cast("double"), b.cast("double"), c.cast("double")
    p, ah, bh = a * b, split(a), split(b)
    al, bl = a - ah, b - bh
    low = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    s = p + c
    v = s - p
    return s + (((p - (s - v)) + (c - v)) + low)
