"""Deblocking of whole images: edges along lines first, then, over what that wrote, edges along columns.

A pass works on groups of four lines (or columns), whose whole length one row holds: edges are
smoothed in order, each reading what the one before left, so no split along a line would be exact.
An image's size bounds a row; images, and groups of an image, are spread over tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.planes import hold
from .blockmath import over_blocks
from .loopfilter import Q_MULT, Q_WIDE, W_MULT

#: Samples between edges, and lines that are decided together.
STEP, GROUP = 8, 4
#: What stands where an image has no sample.
MISSING = 128


def smooth_edges(lines: np.ndarray, most: np.ndarray, q: np.ndarray, side: np.ndarray, keep_left: np.ndarray, keep_right: np.ndarray) -> np.ndarray:
    """Groups of lines (n, GROUP, length) with their edges, at every STEP samples, smoothed in order.

    Of each edge (n, length / STEP - 1): most, how many samples may change on both sides (0, 1, 3 or
    4; 0 for none), the thresholds of the step over it and of second derivatives, and whether a side
    stays as it is. The number of samples is decided on the first and last line of a group.
    """
    out = lines.astype(np.int64).copy()
    ends = out[:, [0, -1]]
    for e in range(most.shape[1]):
        at = (e + 1) * STEP
        ends = out[:, [0, -1]]
        p = lambda d: ends[:, :, at + d]  # noqa: E731, B023
        mean = lambda x: x.sum(1) + 1 >> 1
        second = {d: mean(np.abs(p(d - 1) - 2 * p(d) + p(d + 1))) for d in range(-2, 2)}
        straight = lambda k: np.maximum(mean(np.abs(p(-1) - p(-1 - k) - k * (p(-1) - p(-2)))), mean(np.abs(p(0) - p(k) - k * (p(0) - p(1)))))  # noqa: E731, B023
        high, across = np.maximum(second[-2], second[1]), second[-1] + second[0]
        limit, step, wanted = side[:, e], q[:, e], most[:, e]
        cases = [
            (wanted == 0) | (high > limit), wanted == 1, (high > limit >> 2) | (across > 4 * step), (high > limit >> 3) | (across > 3 * step) | (straight(3) > 3 * limit >> 4), wanted == 3,
            (across * 16 > step * Q_WIDE[4]) | (straight(4) > limit * 4 >> 4),
        ]
        width = np.select(cases, [0, 1, 1, 2, 3, 3], 4)
        near = out[:, :, at - 2 : at + 2]
        bound = (step * np.array([0, *Q_MULT])[width])[:, None]
        delta = np.clip(4 * (3 * (near[..., 2] - near[..., 1]) - (near[..., 3] - near[..., 0])), -bound, bound)
        for j in range(GROUP):
            change = delta * (np.array([0, *W_MULT])[width] * (width - j))[:, None] + 1024 >> 11
            for place, sign, kept in ((at - 1 - j, 1, keep_left), (at + j, -1, keep_right)):
                new = np.clip(out[:, :, place] + sign * change, 0, 255)
                out[:, :, place] = np.where(((width > j) & ~kept[:, e].astype(bool))[:, None], new, out[:, :, place])
    return out


def _pass(samples: DataFrame, along: str, across: str, length: int, edge) -> DataFrame:
    """(image, y, x, v) after the edges at every STEP samples of coordinate `along`; edge(group, number) gives the arrays' elements."""
    line = F.col(across) % GROUP
    place = (line * length + F.col(along)).cast("int")
    grouped = samples.groupBy("image", F.floor(F.col(across) / GROUP).alias("group")).agg(F.map_from_entries(F.collect_list(F.struct(place, "v"))).alias("m"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(GROUP * length - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(MISSING)).cast("bigint"))
    numbers = F.sequence(F.lit(1), F.lit(length // STEP - 1))
    names = ("most", "q", "side", "keep_left", "keep_right")
    of_edges = lambda name: F.transform(numbers, lambda e: edge(F.col("group"), e)[name].cast("bigint"))
    rows = hold(grouped, v=whole, **{name: of_edges(name) for name in names})
    key = F.col("image") * (1 << 20) + F.col("group")  # groups of an image are far fewer than 2**20
    compute = lambda v, *rest: (smooth_edges(v.reshape(len(v), GROUP, length), *rest),)
    found = over_blocks(rows.withColumn("block_id", key), ["v", *names], [], compute, "v")
    one = found.select("block_id", F.posexplode("v").alias("i", "v"))
    i, group = F.col("i").cast("bigint"), F.col("block_id") % (1 << 20)
    where = {along: i % length, across: group * GROUP + F.floor(i / length)}
    return one.select(F.floor(F.col("block_id") / (1 << 20)).alias("image"), *[where[c].cast("bigint").alias(c) for c in ("y", "x")], "v")


def deblock_images(samples: DataFrame, width: int, height: int, edge) -> DataFrame:
    """(image, y, x, v) of images of that size, multiples of STEP and GROUP, deblocked: vertical edges, then horizontal ones.

    edge(image, y, x, vertical, e): a dict of Columns for an edge at a sample: most, q, side,
    keep_left and keep_right (of a horizontal edge: above and below), see `smooth_edges`. Missing
    samples count as MISSING; repeated ones of a place raise an error.
    """
    upright = lambda group, e: edge(F.col("image"), group * GROUP, e * STEP, True)
    level = lambda group, e: edge(F.col("image"), e * STEP, group * GROUP, False)
    return _pass(_pass(samples, "x", "y", width, upright), "y", "x", height, level)


def block_edges(size: int, tile: int):
    """Edges of square blocks of `size` with a class, a quantiser index and a lossless flag made of their place; none on seams of tiles."""
    def edge(image: Column, y: Column, x: Column, vertical: bool) -> dict[str, Column]:
        by, bx = F.floor(y / size), F.floor(x / size)
        ly, lx = (by, bx - 1) if vertical else (by - 1, bx)
        index = lambda r, c: (image * 13 + r * 7 + c * 5) % 120 + 60
        lossless = lambda r, c: F.when((image + r * 3 + c) % 11 == 0, 1).otherwise(0)
        q = 8 + F.shiftright((index(by, bx) + index(ly, lx) + 1).cast("bigint"), 3)
        kind = (image + 3 * bx + 5 * by) % 4
        most = F.when((x if vertical else y) % tile == 0, 0).otherwise(F.when(kind == 0, 0).when(kind == 1, 1).when(kind == 2, 3).otherwise(4))
        return {"most": most, "q": q, "side": 6 * q, "keep_left": lossless(ly, lx), "keep_right": lossless(by, bx)}

    return edge
