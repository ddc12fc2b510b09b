"""Bit-exact int8 inference as Column expressions: numbers are bigint, vectors array<bigint>, weights array columns of one row.

Shifts are arithmetic. ANSI mode raises on overflow of + - *, which the supported sizes never reach.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base-2 exponential in Q16.
LOG2E = 94548
EXP_C2, EXP_C1, EXP_C0 = 11279, -44047, 65536
EXP_BITS = 16
FRAC = 7


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def big(x: int) -> Column:
    return F.lit(x).cast("bigint")


def saturated(x: Column) -> Column:
    return F.greatest(F.least(x, big(127)), big(-128))


def requant(acc: Column, shift: int) -> Column:
    """Half-up rounding right shift, then int8."""
    return saturated(F.shiftright(acc + big(1 << (shift - 1) if shift > 0 else 0), shift))


def requant_even(acc: Column, shift: Column) -> Column:
    """Right shift with ties to even, then int8; no shift for shift <= 0."""
    def shifted(s: Column) -> Column:
        unit = F.pow(F.lit(2.0), s).cast("bigint")
        floor = F.floor(acc / unit).cast("bigint")  # exact: accumulators are far below 2^53
        rest = acc - floor * unit
        up = (rest * 2 > unit) | ((rest * 2 == unit) & (F.pmod(floor, big(2)) == 1))
        return saturated(floor + F.when(up, big(1)).otherwise(big(0)))

    return F.when(shift <= 0, saturated(acc)).otherwise(shifted(shift))


def bit_length(x: Column) -> Column:
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def dynamic_shift(values: Column) -> Column:
    """The shift that brings a vector's largest magnitude into seven bits."""
    return F.greatest(F.lit(0), bit_length(F.array_max(F.transform(values, F.abs))) - 7)


def isqrt(x: Column) -> Column:
    return F.floor(F.sqrt(x.cast("double"))).cast("bigint")


def exp_neg(d: Column, frac: int) -> Column:
    """exp(d) of d <= 0 in Q(frac), as Q16."""
    shift = frac + 16

    def body(m: Column) -> Column:
        z = F.shiftright(m, shift)
        f = F.shiftright(m - z * big(1 << shift), shift - EXP_BITS)
        p = F.shiftright(big(EXP_C2) * f * f, 2 * EXP_BITS) + F.shiftright(big(EXP_C1) * f, EXP_BITS) + big(EXP_C0)
        return F.when(z > EXP_BITS, big(0)).otherwise(F.floor(p / F.pow(F.lit(2.0), z)).cast("bigint"))

    return let(-F.least(d, big(0)) * big(LOG2E), body)


def score_shift(raw: Column, scale: int, shift: int) -> Column:
    return F.shiftright(raw * big(scale) + big(1 << (shift - 1) if shift > 0 else 0), shift)


def quantized(x: Column, frac: int = FRAC) -> Column:
    return saturated(F.bround(x * float(1 << frac), 0).cast("bigint"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), big(0), lambda s, x: s + x)


def linear(x: Column, weights: Column, bias: Column, frac: int = FRAC) -> Column:
    """Accumulators of a layer: weights are array<array<bigint>> by output, biases are aligned to the products."""
    return F.zip_with(weights, bias, lambda w, b: dot(w, x) + b * big(1 << frac))


def tokenizer(x: Column, weights: Column, bias: Column, frac: int = FRAC) -> Column:
    """Each feature times its row of weights, plus its row of biases."""
    return F.flatten(F.transform(F.arrays_zip(x.alias("x"), weights.alias("w"), bias.alias("b")), lambda r: F.zip_with(r["w"], r["b"], lambda w, b: requant(r["x"] * w + b * big(1 << frac), frac))))


def layer_norm(x: Column, gamma: Column, beta: Column, width: int, eps: int, recip: int = 24, out: int = FRAC, frac: int = FRAC) -> Column:
    total = lambda a: F.aggregate(a, big(0), lambda s, v: s + v)

    def scaled(s: Column) -> Column:
        v = big(width) * total(F.transform(x, lambda a: a * a)) - s * s
        root = F.greatest(big(1), isqrt(v + big(eps)))
        return let(let(root, lambda r: F.call_function("div", big(1 << recip) + F.shiftright(r, 1), r)), lambda inv: F.transform(
            F.arrays_zip(x.alias("x"), gamma.alias("g"), beta.alias("b")),
            lambda r: requant((big(width) * r["x"] - s) * inv * r["g"] + r["b"] * big(1 << recip), frac + recip - out)))

    return let(total(x), scaled)


def feed_forward(x: Column, w1: Column, b1: Column, w2: Column, b2: Column, frac: int = FRAC) -> Column:
    hidden = F.transform(linear(x, w1, b1, frac), lambda a: F.greatest(requant(a, frac), big(0)))
    return let(hidden, lambda h: F.transform(linear(h, w2, b2, frac), lambda a: requant(a, frac)))


def mlp(x: Column, w1: Column, b1: Column, w2: Column, b2: Column, w3: Column, b3: Column) -> Column:
    """Struct of y and shift; every layer's accumulators share one shift that follows from the largest."""
    layer = lambda v, w, b: F.zip_with(w, b, lambda r, c: dot(r, v) + c)
    narrow = lambda a: let(a, lambda v: let(dynamic_shift(v), lambda s: F.transform(v, lambda e: requant_even(e, s))))
    positive = lambda a: F.transform(a, lambda e: F.greatest(e, big(0)))
    one = narrow(positive(layer(x, w1, b1)))
    two = let(one, lambda v: narrow(positive(layer(v, w2, b2))))
    last = let(two, lambda v: dot(v, w3) + b3)
    return let(last, lambda a: let(dynamic_shift(F.array(a)), lambda s: F.struct(requant_even(a, s).alias("y"), s.cast("bigint").alias("shift"))))
