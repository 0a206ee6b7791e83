"""Intra prediction of 8x8 blocks from their edges; each function adds array columns to (block_id, px, ...).

The block's own first line and first column serve as its edges, `top` and `left`, so prediction of
one block doesn't wait for another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.integer import clip, floor_log2, reciprocal, round2, shifted, shr, signed_round2, total
from ..sources.planes import hold

N = 8
#: Weights of the smooth predictor for areas from 64 to 512.
SMOOTH = [32, 16, 8, 4, 2, 1, 0, 0]


def with_edges(df: DataFrame) -> DataFrame:
    return hold(df, top=F.slice("px", 1, N), left=F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda y: F.col("px")[y * N]))


def each(f):
    """An array of 64 from f(y, x)."""
    return F.transform(F.sequence(F.lit(0), F.lit(N * N - 1)), lambda i: f(F.shiftright(i, 3), i.bitwiseAND(F.lit(N - 1))).cast("bigint"))


def dc(df: DataFrame) -> DataFrame:
    """dc, dc_top, dc_left: the rounded means of both edges, and of one."""
    top, left = total(F.col("top")), total(F.col("left"))
    return df.withColumns({"dc": shr(top + left + N, 4), "dc_top": shr(top + N // 2, 3), "dc_left": shr(left + N // 2, 3)})


def vertical_horizontal(df: DataFrame) -> DataFrame:
    return df.withColumns({"v": each(lambda y, x: F.col("top")[x]), "h": each(lambda y, x: F.col("left")[y])})


def paeth(df: DataFrame) -> DataFrame:
    """Of left, top and corner, the one nearest to left + top - corner, in this order at equal distance."""

    def nearest(y, x):
        left, top, corner = F.col("left")[y], F.col("top")[x], F.col("px")[0]
        base = left + top - corner
        a, b, c = F.abs(left - base), F.abs(top - base), F.abs(corner - base)
        return F.when((a <= b) & (a <= c), left).when(b <= c, top).otherwise(corner)

    return df.withColumn("paeth", each(nearest))


def smooth(df: DataFrame) -> DataFrame:
    """smooth_v, smooth_h and their rounded mean; the far ends of the edges stand for what lies beyond them."""
    w = F.array(*map(F.lit, SMOOTH))

    def part(near, far, at):
        p = far + round2((near - far) * (N - 1 - at), 3)
        return p + shr((near - p) * w[at] + 32, 6)

    v = lambda y, x: part(F.col("top")[x], F.col("left")[N - 1], y)
    h = lambda y, x: part(F.col("left")[y], F.col("top")[N - 1], x)
    return df.withColumns({"smooth_v": each(v), "smooth_h": each(h), "smooth": each(lambda y, x: shr(v(y, x) + h(y, x) + 1, 1))})


def ibp(df: DataFrame, step: int = 64) -> DataFrame:
    """ibp: top and left blended by 128 * position / (row + position) in units of 1/64 sample, rounded."""

    def blend(y, x):
        row, at = (y + 1) * 64, (x + 1) * step
        w = F.floor((128 * at + F.floor((row + at) / 2)) / (row + at))
        return shr(F.col("top")[x] * (128 - w) + F.col("left")[y] * w + 64, 7)

    return df.withColumn("ibp", each(blend))


def directional(df: DataFrame, dx: int = 40) -> DataFrame:
    """directional: from the top edge, dx/64 sample to the right for each line down, between two neighbours in steps of 1/32."""

    def at(y, x):
        position = (y + 1) * dx
        base, part = x + F.shiftright(position, 6), F.shiftright(position.bitwiseAND(F.lit(63)), 1)
        one, two = F.col("top")[F.least(F.lit(N - 1), base)], F.col("top")[F.least(F.lit(N - 1), base + 1)]
        return shr(one * (32 - part) + two * part + 16, 5)

    return df.withColumn("directional", each(at))


def filtered_edge(df: DataFrame) -> DataFrame:
    """edge1, edge2, edge3: the top edge under the three smoothing kernels, ends repeated."""
    kernels = {1: {-1: 4, 0: 8, 1: 4}, 2: {-1: 5, 0: 6, 1: 5}, 3: {-2: 2, -1: 4, 0: 4, 1: 4, 2: 2}}

    def run(kernel):
        at = lambda i: F.col("top")[F.greatest(F.lit(0), F.least(F.lit(N - 1), i))]
        return F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda i: shr(sum((at(i + d) * k for d, k in kernel.items()), F.lit(8)), 4).cast("bigint"))

    return df.withColumns({f"edge{k}": run(v) for k, v in kernels.items()})


def palette(df: DataFrame) -> DataFrame:
    """palette: each sample by one of eight colours of its block, through indices packed two to a byte."""
    low, high = F.col("low"), F.col("high")
    colours = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: low + F.floor(((high - low) * k + 3) / 7))
    df = hold(hold(df, low=F.array_min("px"), high=F.array_max("px")), colours=colours, packed=F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: shr(F.col("px")[2 * i], 5) + shr(F.col("px")[2 * i + 1], 5) * 16))
    index = lambda i: F.when(i % 2 == 0, F.col("packed")[F.shiftright(i, 1)].bitwiseAND(F.lit(7))).otherwise(shr(F.col("packed")[F.shiftright(i, 1)], 4)).cast("int")
    return df.withColumn("palette", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("colours")[index(i)].cast("bigint")))


def chroma_from_luma(df: DataFrame) -> DataFrame:
    """cfl: the mean of px2 plus alpha / 2**11 of what px has above its own mean, alpha from the block's id."""
    alpha = F.col("block_id") % 33 - 16
    mean, dc_ = shr(total(F.transform("px", lambda v: v * 8)) + 32, 6), shr(total(F.col("px2")) + 32, 6)
    df = hold(df, _alpha=alpha, _mean=mean, _dc=dc_)
    return df.withColumn("cfl", F.transform("px", lambda v: clip(F.col("_dc") + signed_round2(F.col("_alpha") * (v * 8 - F.col("_mean")), 11), 0, 255)))


def implicit_alpha(df: DataFrame) -> DataFrame:
    """num, den: the least-squares slope of px2 on px, as 64 times the covariance over 64 times the variance."""
    sx, sy = total(F.col("px")), total(F.col("px2"))
    sxy, sxx = total(F.zip_with("px", "px2", lambda a, b: a * b)), total(F.transform("px", lambda a: a * a))
    return df.withColumns({"num": 64 * sxy - sx * sy, "den": 64 * sxx - sx * sx})


def linear_morph(df: DataFrame) -> DataFrame:
    """morph: (alpha * sample + beta) / 256, alpha and beta from the block's id."""
    alpha, beta = 200 + F.col("block_id") % 100, 128 * (F.col("block_id") % 16)
    return hold(df, _a=alpha, _b=beta).withColumn("morph", F.transform("px", lambda v: clip(shr(F.col("_a") * v + F.col("_b"), 8), 0, 255)))


def dpcm(df: DataFrame) -> DataFrame:
    """dpcm: running sums along each line of the residual 128 below the samples."""
    line = lambda y: F.slice("px", y * N + 1, N)
    return df.withColumn("dpcm", each(lambda y, x: F.aggregate(F.slice(line(y), 1, x + 1), F.lit(0).cast("bigint"), lambda s, v: s + v - 128)))


def model_alpha(num: Column, den: Column) -> Column:
    """num / den in units of 1/256, by the reciprocal of den and the nine highest bits of num, at most 511; 0 where either is 0 or the quotient is too small."""
    size = F.greatest(F.abs(num), F.lit(1))
    top = floor_log2(size)
    head = F.when(top > 7, shifted(size + shifted(F.lit(1), F.greatest(top - 8, F.lit(0))), F.least(7 - top, F.lit(0)))).otherwise(shifted(size, F.greatest(7 - top, F.lit(0))))
    below = reciprocal(F.greatest(den, F.lit(1)))
    shift = below["shift"] - 1 - top
    value = F.when(shift < 0, 511).otherwise(F.least(shifted(below["mantissa"] * head, -F.greatest(shift, F.lit(0))), F.lit(511)))
    return F.when((num != 0) & (den != 0) & (shift <= 17), value * F.sign(num).cast("bigint")).otherwise(0).cast("bigint")
