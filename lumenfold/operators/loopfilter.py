"""In-loop filters over 8x8 blocks (arrays) and over whole planes (lines with the lines around them)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.integer import clip, floor_log2, shr, signed_round2
from ..sources.planes import hold, lines, with_lines_around
from .intra import N, each
from .transform import dequant_step

#: The two taps (dy, dx) of each of the eight directions.
DIRECTIONS = [[(-1, 1), (-2, 2)], [(0, 1), (-1, 2)], [(0, 1), (0, 2)], [(0, 1), (1, 2)], [(1, 1), (2, 2)], [(1, 0), (2, 1)], [(1, 0), (2, 0)], [(1, 0), (2, -1)]]
#: Multipliers of the deblocking threshold and of the ramp, by filter width.
Q_MULT, W_MULT = [32, 25, 19, 19, 0, 18, 0, 17], [85, 51, 37, 28, 0, 20, 0, 15]


def line_of(direction: int, y: int, x: int) -> int:
    """The line of a sample in one of the eight families of parallel lines of an 8x8 block."""
    return [y + x, y + x // 2, y, 3 + y - x // 2, 7 + y - x, 3 - y // 2 + x, x, y // 2 + x][direction]


def cdef_direction(df: DataFrame) -> DataFrame:
    """(block_id, direction, variance): the family whose line sums vary most, the first of equal ones.

    The cost of a family is the sum over its lines of sum**2 * 840 / length. Every line sum is a
    short dot product inside the block's row, so nothing is shuffled.
    """
    costs = []
    for d in range(8):
        members: dict[int, list[int]] = {}
        for y in range(N):
            for x in range(N):
                members.setdefault(line_of(d, y, x), []).append(y * N + x)
        groups = F.array(*[F.struct(F.array(*map(F.lit, m)).alias("at"), F.lit(840 // len(m)).cast("bigint").alias("w")) for m in members.values()])
        sums = F.transform(groups, lambda g: F.struct(F.aggregate(g["at"], F.lit(0).cast("bigint"), lambda s, i: s + F.col("px")[i] - 128).alias("s"), g["w"].alias("w")))
        costs.append(F.aggregate(sums, F.lit(0).cast("bigint"), lambda a, t: a + t["s"] * t["s"] * t["w"]))
    found = hold(hold(df, cost=F.array(*costs)), direction=F.expr("array_position(cost, array_max(cost)) - 1"))
    return found.withColumn("variance", shr(F.array_max("cost") - F.col("cost")[F.col("direction").bitwiseXOR(F.lit(4)).cast("int")], 10))


def luma_strength(strength: int, variance: Column) -> Column:
    """0 without variance; else more of the strength the larger it is."""
    high = shr(variance, 6)
    i = F.when(high > 0, F.least(floor_log2(F.greatest(high, F.lit(1))), F.lit(12))).otherwise(0)
    return F.when(variance == 0, 0).otherwise(shr(strength * (4 + i) + 8, 4)).cast("bigint")


#: What stands for a sample that isn't available.
OUTSIDE = -(1 << 20)


def cdef_blocks(padded: np.ndarray, d: int, primary: int, secondary: int, damping: int) -> np.ndarray:
    """8x8 blocks of one direction, given with two samples around them, OUTSIDE where there are none.

    Each sample moves towards its neighbours along the direction and, weaker, along those two steps
    off it; unavailable neighbours neither move a sample nor bound it.
    """
    shift_p, shift_s = max(0, damping - primary.bit_length() + 1) if primary else 0, damping - secondary.bit_length() + 1 if secondary else 0
    strong = 4 - (primary & 1)
    px = padded[:, 2 : 2 + N, 2 : 2 + N]
    total, low, high = np.zeros_like(px), px, px
    for k in range(2):
        for turn, strength, shift, weight in ((0, primary, shift_p, (strong, strong & 3 | 2)[k]), (2, secondary, shift_s, 2 - k), (6, secondary, shift_s, 2 - k)):
            dy, dx = DIRECTIONS[(d + turn) % 8][k]
            for y, x in ((dy, dx), (-dy, -dx)) if strength else ():
                there = padded[:, 2 + y : 2 + y + N, 2 + x : 2 + x + N]
                there = np.where(there == OUTSIDE, px, there)  # an unavailable neighbour is as good as an equal one
                diff = there - px
                size = np.abs(diff)
                total = total + weight * np.sign(diff) * np.minimum(size, np.maximum(0, strength - (size >> shift)))
                low, high = np.minimum(low, there), np.maximum(high, there)
    value = px + ((total - (total < 0) + 8) >> 4)
    return np.clip(value, low, high) if primary and secondary else value


def cdef_filter(df: DataFrame, primary: int, secondary: int, damping: int = 5) -> DataFrame:
    """(block_id, cdef): blocks filtered on their own: neighbours outside the block are unavailable.

    Twelve taps for each sample are too many for lambdas over arrays, so whole Arrow batches of
    blocks are filtered as NumPy planes, those of one direction together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            px = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N, N)
            direction, out = batch.column(2).to_numpy(zero_copy_only=False), px.copy()
            around = np.pad(px, ((0, 0), (2, 2), (2, 2)), constant_values=OUTSIDE)
            for d in np.unique(direction) if primary or secondary else ():
                out[direction == d] = cdef_blocks(around[direction == d], int(d), primary, secondary, damping)
            offsets = pa.array(np.arange(0, 64 * len(px) + 1, 64), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))], names=["block_id", "cdef"])

    return df.select("block_id", "px", F.col("direction").cast("bigint").alias("direction")).mapInArrow(run, "block_id long, cdef array<long>")


#: The places (dy, dx) of the first of two opposite neighbours that a frame may choose.
CCSO_PLACES = [(-1, 0), (0, -1), (-1, -1), (-1, 1), (-1, -2), (1, -2), (0, 2)]


def ccso(packed: DataFrame, offsets: list[int], q: int = 8, shift: int = 6, taps: tuple = (0, 1), two_sided: bool = True) -> DataFrame:
    """ccso: each sample plus an offset by its band and by how it compares with two opposite neighbours; missing ones repeat it.

    offsets: 128 entries by 32 * first score + 8 * second score + band. A score is 0 for a lower
    neighbour, 1, or, if two_sided, 2 for a higher one.
    """
    dy, dx = taps
    table = F.array(*[F.lit(o).cast("bigint") for o in offsets])
    around = with_lines_around(packed, abs(dy)) if dy else packed.withColumn("around", F.array("line"))
    reach = abs(dy)

    def score(diff):
        return F.when((diff > q) & F.lit(two_sided), 2).when(diff < -q, 0).otherwise(1)

    def at(d, i, v):
        return F.coalesce(F.when(i + d[1] >= 0, F.get(F.col("around")[reach + d[0]], i + d[1])), v)

    one = lambda v, i: clip(v + table[(score(at((dy, dx), i, v) - v) * 32 + score(at((-dy, -dx), i, v) - v) * 8 + shr(v, shift)).cast("int")], 0, 255)
    return around.withColumn("ccso", F.transform("line", one))


def _sample(reach: int):
    """at(i, dy, dx): a sample of the lines around, coordinates cut to the plane's edges."""
    width = F.size("line") - 1

    def at(i, dy, dx):
        line = F.coalesce(F.col("around")[reach + dy], *[F.col("around")[reach + k] for k in range(dy - (dy > 0) + (dy < 0), 0, -1 if dy > 0 else 1)], F.col("line")) if dy else F.col("line")
        return line[F.greatest(F.lit(0), F.least(width, i + dx))]

    return at


def wiener(samples: DataFrame, taps: dict[tuple[int, int], int]) -> DataFrame:
    """wiener: each sample plus the weighted second differences with pairs of opposite neighbours, in units of 1/128."""
    reach = max(abs(dy) for dy, _ in taps)
    at = _sample(reach)
    one = lambda m, i: clip(shr(128 * m + sum(((at(i, dy, dx) + at(i, -dy, -dx) - 2 * m) * c for (dy, dx), c in taps.items()), F.lit(0)) + 64, 7), 0, 255)
    return with_lines_around(lines(samples), reach).withColumn("wiener", F.transform("line", one))


def second_differences(samples: DataFrame) -> DataFrame:
    """vertical, diagonal, antidiagonal: magnitudes of second differences at each sample."""
    at = _sample(1)
    d = lambda dx: F.transform("line", lambda m, i: F.abs(at(i, -1, dx) - 2 * m + at(i, 1, -dx)))
    return with_lines_around(lines(samples), 1).withColumns({"vertical": d(0), "diagonal": d(1), "antidiagonal": d(-1)})


def gdf_gradients(samples: DataFrame) -> DataFrame:
    """g0..g3: gradients 2b - a - c in four directions at each sample (across lines, along them, and on both diagonals)."""
    at = _sample(1)
    steps = [(1, 0), (0, 1), (1, 1), (1, -1)]
    return with_lines_around(lines(samples), 1).withColumns({f"g{k}": _gradient(at, dy, dx) for k, (dy, dx) in enumerate(steps)})


def _gradient(at, dy: int, dx: int) -> Column:
    return F.transform("line", lambda m, i: F.abs(2 * m - at(i, -dy, -dx) - at(i, dy, dx)))


def gdf_cells(gradients: DataFrame) -> DataFrame:
    """(cy, cx, class, g0..g3) of each 2x2 cell: class bit 0 says g0 <= g1, bit 1 says g2 <= g3."""
    cells = gradients.groupBy(F.floor(F.col("y") / 2).alias("cy"), F.floor(F.col("x") / 2).alias("cx")).agg(*[F.sum(f"g{k}").alias(f"g{k}") for k in range(4)])
    return cells.withColumn("class", (F.when(F.col("g0") <= F.col("g1"), 1).otherwise(0) + F.when(F.col("g2") <= F.col("g3"), 2).otherwise(0)).cast("bigint"))


def gdf_apply(v: Column, error: Column, scale: int) -> Column:
    return clip(v + signed_round2(error * scale, 4), 0, 255)


def q_threshold(index: Column) -> Column:
    """The deblocking threshold of a quantiser index."""
    return shr(dequant_step(clip(index, 0, 255)) + 4, 9)


#: By how many sixteenths of the threshold the step over an edge may differ, for filters of 4, 6 and 8 samples.
Q_WIDE = {4: 45, 6: 40, 8: 32}


def deblock(df: DataFrame, q: int, side: int, most: int = 4, groups: tuple[int, ...] = (0,)) -> DataFrame:
    """filter_width (one for each group of four lines, filter_width2 for a second) and left, right: the edge between px and px2, its right neighbour, smoothed along lines.

    The width comes from second derivatives of the first and last line of a group against the
    thresholds; the step over the edge is then spread over that many samples on both sides, less the
    further away they are. most: 1, 3, 4, 6 or 8 samples.
    """
    p = lambda y, d: F.col("px2")[y * N + d] if d >= 0 else F.col("px")[y * N + N + d]  # noqa: E731  d: distance from the edge

    def width_of(g: int) -> Column:
        mean = lambda f: shr(f(g) + f(g + 3) + 1, 1)
        second = {d: mean(lambda y, d=d: F.abs(p(y, d - 1) - 2 * p(y, d) + p(y, d + 1))) for d in range(-2, 2)}
        high, across = F.greatest(second[-2], second[1]), second[-1] + second[0]

        def straight(k):
            """How far both sides are from a straight line over k samples, the larger one."""
            left = mean(lambda y: F.abs(p(y, -1) - p(y, -1 - k) - k * (p(y, -1) - p(y, -2))))
            right = mean(lambda y: F.abs(p(y, 0) - p(y, k) - k * (p(y, 0) - p(y, 1))))
            return F.greatest(left, right)

        width = F.when(high > side, 0)
        if most > 1:
            width = width.when((high > side >> 2) | (across > 4 * q), 1).when((high > side >> 3) | (across > 3 * q) | (straight(3) > (side * 3) >> 4), 2)
        before = 3
        for wide in (w for w in Q_WIDE if w <= most):
            width = width.when((across * 16 > q * Q_WIDE[wide]) | (straight(min(7, wide)) > (side * wide) >> 4), before)
            before = wide
        return width.otherwise(most).cast("bigint")

    names = ["filter_width", "filter_width2"][: len(groups)]
    df = hold(df, **{name: width_of(g) for name, g in zip(names, groups)})
    of = lambda y: F.when(y < 4, F.col(names[0])).otherwise(F.col(names[-1]) if len(names) > 1 else F.lit(0))
    bound = lambda w: q * F.array(*[F.lit(v).cast("bigint") for v in Q_MULT])[F.greatest(w - 1, F.lit(0)).cast("int")]
    ramp = lambda w: F.array(*[F.lit(v).cast("bigint") for v in W_MULT])[F.greatest(w - 1, F.lit(0)).cast("int")]
    delta = lambda y: F.greatest(-bound(of(y)), F.least(bound(of(y)), 4 * (3 * (p(y, 0) - p(y, -1)) - (p(y, 1) - p(y, -2)))))
    step = lambda y, j: shr(delta(y) * ramp(of(y)) * (of(y) - j) + 1024, 11)
    inside = lambda y, j: of(y) > j
    return df.withColumns({
        "left": each(lambda y, x: F.when(inside(y, 7 - x), clip(F.col("px")[y * N + x] + step(y, 7 - x), 0, 255)).otherwise(F.col("px")[y * N + x])),
        "right": each(lambda y, x: F.when(inside(y, x), clip(F.col("px2")[y * N + x] - step(y, x), 0, 255)).otherwise(F.col("px2")[y * N + x])),
    })
