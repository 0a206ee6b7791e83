"""Integer arithmetic of the kernels as Columns over BIGINT; shifts are arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shr(v: Column, n: int) -> Column:
    return F.shiftright(v, n)


def round2(v: Column, n: int) -> Column:
    """v / 2**n, halves up."""
    return F.shiftright(v + ((1 << n) >> 1), n)


def shifted(v: Column, n: Column) -> Column:
    """v * 2**n for a column n, toward minus infinity if n is negative."""
    v = v.cast("bigint")
    return F.when(n < 0, F.call_function("shiftright", v, (-n).cast("int"))).otherwise(F.call_function("shiftleft", v, n.cast("int")))


def signed_round2(v: Column, n: int) -> Column:
    """The magnitude of v / 2**n, halves up, with v's sign."""
    return F.when(v < 0, -round2(-v, n)).otherwise(round2(v, n))


def clip(v: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v)).cast("bigint")


def floor_log2(v: Column) -> Column:
    """The position of the highest bit of v > 0, from the length of its binary form."""
    return F.length(F.bin(v)) - 1


def reciprocal(d: Column) -> Column:
    """(mantissa, shift) with 2**shift / d near mantissa, for d > 0: the mantissa of nine bits comes from the eight highest bits of d, rounded."""
    top = floor_log2(d)
    rest = d - shifted(F.lit(1), top)
    f = F.when(top > 7, shifted(rest + shifted(F.lit(1), F.greatest(top - 8, F.lit(0))), F.least(7 - top, F.lit(0)))).otherwise(shifted(rest, F.greatest(7 - top, F.lit(0))))
    return F.struct(F.floor((2 * 65536 + 128 + f) / (2 * (128 + f))).alias("mantissa"), (top + 9).cast("bigint").alias("shift"))


def divided(v: Column, by: int) -> Column:
    """v / by by the reciprocal of a constant, halves up."""
    top = by.bit_length() - 1
    mantissa = (2 * 65536 + 128 + (f := by - (1 << top) << 7 - top)) // (2 * (128 + f))
    return round2(v * mantissa, top + 9)


def lfsr(state: Column) -> Column:
    """The next state of the 16-bit grain register: taps 0, 1, 3 and 12, the new bit comes in at the top."""
    bit = state.bitwiseXOR(shr(state, 1)).bitwiseXOR(shr(state, 3)).bitwiseXOR(shr(state, 12)).bitwiseAND(F.lit(1))
    return shr(state, 1).bitwiseOR(F.shiftleft(bit, 15))


def lfsr_after(state: Column, steps: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state.cast("bigint"), lambda s, _: lfsr(s).cast("bigint"))


def dot(values: Column, weights) -> Column:
    """The sum of products of an array and a list of integers or a second array."""
    other = F.array(*[F.lit(int(w)).cast("bigint") for w in weights]) if isinstance(weights, (list, tuple)) else weights
    return F.aggregate(F.zip_with(values, other, lambda a, b: a * b), F.lit(0).cast("bigint"), lambda s, v: s + v)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, v: s + v)

