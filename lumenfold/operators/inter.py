"""Prediction from other blocks and motion vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.integer import clip, round2, shifted, shr
from ..sources.planes import hold
from .intra import N, each

#: An 8-tap half-sample filter, and the invalid-vector marker's lower bound.
HALF = [-1, 6, -19, 78, 78, -19, 6, -1]
INVALID_FROM = 2048


def sad(a: str = "px", b: str = "px2") -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0).cast("bigint"), lambda s, v: s + v)


def sad_alternate_lines(a: str = "px", b: str = "px2") -> Column:
    """The sum over every second line only."""
    even = F.transform(F.sequence(F.lit(0), F.lit(N * N // 2 - 1)), lambda i: F.abs(F.col(a)[F.shiftright(i, 3) * 16 + i.bitwiseAND(F.lit(7))] - F.col(b)[F.shiftright(i, 3) * 16 + i.bitwiseAND(F.lit(7))]))
    return F.aggregate(even, F.lit(0).cast("bigint"), lambda s, v: s + v)


def best_match(blocks: DataFrame, reach: int = 4) -> DataFrame:
    """(block_id, best, sad): of the `reach` blocks with the next ids, the one of least SAD, the first of equal ones.

    An equi-join on shifted ids; each block meets `reach` others at most.
    """
    other = blocks.select(F.col("px").alias("px2"), F.explode(F.sequence(F.col("block_id") - reach, F.col("block_id") - 1)).alias("for"), F.col("block_id").alias("other"))
    met = blocks.join(other, F.col("block_id") == F.col("for")).select("block_id", "other", sad().alias("sad"))
    return met.groupBy("block_id").agg(F.min_by("other", F.struct("sad", "other")).alias("best"), F.min("sad").alias("sad"))


def compound(df: DataFrame) -> DataFrame:
    """avg, weighted, masked, by_difference: four ways to mix px and px2."""
    w, m = F.col("block_id") % 15 + 1, lambda i: F.shiftright(i, 3) * 4 + i.bitwiseAND(F.lit(7)) * 4
    mix = lambda a, b, k: shr(a * k + b * (64 - k) + 32, 6)
    df = hold(df, _w=w)
    return df.withColumns({
        "avg": F.zip_with("px", "px2", lambda a, b: round2(a + b, 1)),
        "weighted": F.zip_with("px", "px2", lambda a, b: shr(a * F.col("_w") + b * (16 - F.col("_w")) + 8, 4)),
        "masked": F.transform("px", lambda a, i: mix(a, F.col("px2")[i], m(i)).cast("bigint")),
        "by_difference": F.zip_with("px", "px2", lambda a, b: mix(a, b, F.least(38 + round2(F.abs(a - b), 4), F.lit(64))).cast("bigint")),
    })


def masked(df: DataFrame, sign: int = 0) -> DataFrame:
    """masked, mask: px and px2 with four more bits, mixed by a weight that grows with their difference; and the weights' means over 2x2 samples, halves down with sign 1."""
    weight = F.zip_with("px", "px2", lambda a, b: F.least(38 + shr(F.abs(16 * a - 16 * b) + 8, 8), F.lit(64)).cast("bigint"))
    df = hold(df, _m=weight)
    mixed = F.transform("px", lambda a, i: clip(shr(16 * a * F.col("_m")[i] + 16 * F.col("px2")[i] * (64 - F.col("_m")[i]) + (32 << 4), 10), 0, 255))
    four = lambda i: reduce(lambda a, b: a + b, [F.col("_m")[(F.shiftright(i, 2) * 2 + dy) * N + i.bitwiseAND(F.lit(3)) * 2 + dx] for dy in (0, 1) for dx in (0, 1)])
    return df.withColumns({"masked": mixed, "mask": F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: shr(four(i) + 2 - sign, 2).cast("bigint"))})


def wedge(df: DataFrame) -> DataFrame:
    """wedge: px and px2 on the two sides of a line through the block's middle, whose slope is from its id, with a soft edge."""
    slope = F.col("block_id") % 9 - 4
    df = hold(df, _k=slope)
    weight = lambda y, x: clip(32 + 4 * (2 * x - 7) + F.col("_k") * (2 * y - 7), 0, 64)
    return df.withColumn("wedge", each(lambda y, x: shr(F.col("px")[y * N + x] * weight(y, x) + F.col("px2")[y * N + x] * (64 - weight(y, x)) + 32, 6)))


def bilinear(df: DataFrame, part: int = 5) -> DataFrame:
    """bilinear: between each sample and its right neighbour, `part` sixteenths; the last column repeats."""
    at = lambda y, x: F.col("px")[y * N + F.least(F.lit(N - 1), x)]
    return df.withColumn("bilinear", each(lambda y, x: round2(16 * at(y, x) + part * (at(y, x + 1) - at(y, x)), 4)))


def eight_tap(df: DataFrame) -> DataFrame:
    """eight_tap: the half-sample filter along lines, then down columns, with a rounding after each; edges repeat."""
    edge = lambda v: F.greatest(F.lit(0), F.least(F.lit(N - 1), v))
    run = lambda src, at: sum((src[at(k - 3)] * w for k, w in enumerate(HALF)), F.lit(0))
    df = hold(df, _h=each(lambda y, x: round2(run(F.col("px"), lambda d: y * N + edge(x + d)), 7)))
    return df.withColumn("eight_tap", each(lambda y, x: clip(round2(run(F.col("_h"), lambda d: edge(y + d) * N + x), 7), 0, 255)))


def _bucket(size: Column, starts: list[int]) -> Column:
    """How many of the starts `size` has reached."""
    return sum((F.when(size >= start, 1).otherwise(0) for start in starts), F.lit(0))


def quantize_component(v: Column) -> Column:
    """A signed code of seven bits for a vector component; null from INVALID_FROM on.

    Sizes below 32 are their own code. Above, each octave is a bucket of 16 codes in steps of 2, 4, ... 64.
    """
    size = F.abs(v).cast("bigint")
    octave = _bucket(size, [32 << k for k in range(6)])
    code = shifted(size, -octave) + 16 * octave
    return F.when(size < INVALID_FROM, code * F.sign(v).cast("bigint")).cast("bigint")


def dequantize_component(code: Column) -> Column:
    """The size at which the bucket step of a code begins, with its sign."""
    size = F.abs(code)
    octave = _bucket(size, [32 + 16 * k for k in range(6)])
    return (shifted(size - 16 * octave, octave) * F.sign(code).cast("bigint")).cast("bigint")


def project_component(v: Column, num: Column, den: Column, low: int = -(1 << 15), high: int = (1 << 15) - 1) -> Column:
    """v * num / den by the reciprocal 16384 / den, halves away from zero; den 0 gives 0."""
    n = clip(num, -31, 31)
    d = F.greatest(F.lit(0), F.least(F.lit(31), den))
    p = v * n * F.when(d == 0, 0).otherwise(F.floor(F.lit(16384) / F.greatest(d, F.lit(1))))
    return clip(shr((p + 8192 - F.when(p < 0, 1).otherwise(0)).cast("bigint"), 14), low, high)


def affine_sums(points: DataFrame, key: str) -> DataFrame:
    """Of each key, the least-squares slope of y on x as num / den, and n; one grouped aggregate with partial sums."""
    s = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    return s.select(key, "n", (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")).alias("num"), (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")).alias("den"))
