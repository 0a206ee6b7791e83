"""Prediction by models: three taps fitted to a block's edge, and matrices over means of its edges; NumPy over batches of blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .blockmath import over_blocks

#: Middles, highest points and curvatures of the parabolas that stand for reciprocals, by the three highest bits behind the first.
MIDDLES, HEIGHTS, CURVES = [4822, 5952, 6624, 6792, 6408, 5424, 3792, 1466], [12784, 12054, 11670, 11583, 11764, 12195, 12870, 13782], [214, 153, 113, 86, 67, 53, 43, 35]
#: Bits that a product may have; weights of a matrix: modes, places of an 8x8 grid, means of edges.
PRODUCT_BITS, MODES, MEANS = 29, 6, 11


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of the magnitude, 1 at least."""
    return np.frexp(np.maximum(np.abs(v), 1).astype(float))[1].astype(np.int64)


def product(a: np.ndarray, b: np.ndarray, shift: np.ndarray | int) -> np.ndarray:
    """a * b / 2**shift, halves away from zero, in PRODUCT_BITS bits: what both factors have above that they lose first, at their low ends."""
    over = np.maximum(_size(a) + _size(b) - PRODUCT_BITS, 0)
    p = (a >> (over >> 1)) * (b >> over - (over >> 1))
    rest = np.maximum(shift - over, 0)
    return np.sign(p) * (np.abs(p) + (1 << rest >> 1) >> rest)


def reciprocal(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mantissa, shift) so that x / d is about x * mantissa / 2**shift / 2**16 * 2**16, from a parabola in one of eight ranges."""
    d = np.maximum(np.abs(d), 1)
    shift = _size(d) - 1
    down = np.maximum(shift - 14, 0)
    head = np.clip(np.where(shift >= 14, d + (1 << down >> 1) >> down, d << np.maximum(14 - shift, 0)), 1, 32767) & 16383
    part = head >> 11
    middle, height, curve = (np.array(t, np.int64)[part] for t in (MIDDLES, HEIGHTS, CURVES))
    off = head - middle
    return (curve * (off * off >> 14) >> 8) - (off >> 1) + height << 2, shift


def solve(matrix: list[list[np.ndarray]], right: list[np.ndarray]) -> list[np.ndarray]:
    """The solution of symmetric normal equations, in units of 2**-16: elimination in integers, a reciprocal for each pivot."""
    m, v = [list(row) for row in matrix], list(right)
    n = len(v)
    for k in range(n):
        mantissa, shift = reciprocal(m[k][k])
        m[k] = [product(x, mantissa, shift) if j > k else x for j, x in enumerate(m[k])]
        v[k] = product(v[k], mantissa, shift)
        for i in range(k + 1, n):
            v[i] = v[i] - product(m[i][k], v[k], 16)
            m[i] = [x - product(m[i][k], m[k][j], 16) if j > k else x for j, x in enumerate(m[i])]
    for k in range(n - 2, -1, -1):
        v[k] = v[k] - sum(product(m[k][j], v[j], 16) for j in range(k + 1, n))
    return v


def three_taps(luma: np.ndarray, chroma: np.ndarray, direction: np.ndarray, size: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(three coefficients, prediction) of chroma blocks by luma: a neighbouring sample, the sample's square and a constant.

    direction: 0 the sample itself, 1 the one above, 2 the one on the left, at the border itself. The
    model is fitted to the first line and the first column of both blocks; samples have 8 bits.
    """
    n = len(luma)
    luma = luma.astype(np.int64).reshape(n, size, size)
    above, left = (np.concatenate((luma[:, :1], luma[:, :-1]), 1), np.concatenate((luma[:, :, :1], luma[:, :, :-1]), 2))
    near = np.where(direction[:, None, None] == 1, above, np.where(direction[:, None, None] == 2, left, luma))
    inputs = [near, luma * luma + 128 >> 8]
    edge = lambda x: np.concatenate((x.reshape(n, size, size)[:, 0], x.reshape(n, size, size)[:, 1:, 0]), 1)
    taps = [*map(edge, inputs), np.full((n, 2 * size - 1), 128, np.int64)]
    count = 2 * size - 1
    up = 6 - (count.bit_length() - 1) - 1  # the count is no power of two
    scaled = lambda x: x << up if up >= 0 else x >> -up
    matrix = [[scaled((a * b).sum(1)) + 2 * (i == j) for j, b in enumerate(taps)] for i, a in enumerate(taps)]
    weights = solve(matrix, [scaled((a * edge(chroma.astype(np.int64))).sum(1)) for a in taps])
    constant = product(weights[2], np.full(n, 128, np.int64), 16)
    found = sum(product(np.broadcast_to(w[:, None, None], x.shape), x, 16) for w, x in zip(weights, inputs)) + constant[:, None, None]
    return np.stack(weights, 1), np.clip(found, 0, 255)


def three_tap_blocks(df: DataFrame) -> DataFrame:
    """(block_id, weights, predicted) of pairs of blocks px (luma) and px2 (chroma), with a direction."""
    return over_blocks(df, ["px", "px2"], ["direction"], three_taps, "weights, predicted")


def spread_weights(mode: int, place: int, mean: int) -> int:
    """A stand-in for a trained table of weights, in units of 1/4096: all about 1/11, some more, some less."""
    return 372 + ((mode * 7 + place * 13 + mean * 29) % 61 - 30) * 8


def matrix_table(weight=spread_weights) -> np.ndarray:
    """Weights by mode, place and mean, less what takes away the sum of all means; a table of its own can be given as a function."""
    return 4096 + np.array([[[weight(m, p, i) for i in range(MEANS)] for p in range(64)] for m in range(MODES)], np.int64)


def _means(edge: np.ndarray, parts: int) -> np.ndarray:
    """Rounded means of equal parts of an edge."""
    step = edge.shape[1] // parts
    return edge.reshape(len(edge), parts, step).sum(2) + (step >> 1) >> step.bit_length() - 1


def _filled(before: np.ndarray, known: np.ndarray, step: int) -> np.ndarray:
    """Along the last axis, the samples between those known, each step-th: linear from the one before."""
    one = np.concatenate((before[..., None], known[..., :-1]), -1)
    at = np.arange(1, step + 1)
    return (one[..., None] * (step - at) + known[..., None] * at >> step.bit_length() - 1).reshape(*known.shape[:-1], -1)


def matrix_predict(corner: np.ndarray, top: np.ndarray, left: np.ndarray, mode: np.ndarray, turned: np.ndarray, table: np.ndarray, width: int, height: int) -> np.ndarray:
    """Blocks of that size from means of their edges by a matrix, with lines and columns between filled in.

    top and left: the samples beside the block and a quarter of its side beyond; turned: both edges change places. Samples have 8 bits.
    """
    n = len(corner)
    along, down = _means(top[:, :width], 4), _means(left[:, :height], 4)
    beyond, below = _means(top[:, width : width + width // 4], 1), _means(left[:, height : height + height // 4], 1)
    straight, crossed = np.concatenate((corner[:, None], along, down, beyond, below), 1), np.concatenate((corner[:, None], down, along, below, beyond), 1)
    means = np.where(turned[:, None] > 0, crossed, straight).astype(np.int64)
    grid = np.einsum("npi,ni->np", table[mode], means) + 2048 >> 12
    grid = np.clip(grid - means.sum(1)[:, None], 0, 255).reshape(n, 8, 8)
    grid = np.where(turned[:, None, None] > 0, grid.transpose(0, 2, 1), grid)
    # a side of 4 takes every other place of the grid, one above 8 has several samples for each
    grid = grid[:, :: max(8 // height, 1), :: max(8 // width, 1)]
    sx, sy = max(width // 8, 1), max(height // 8, 1)
    lines = _filled(left[:, sy - 1 : height : sy], grid, sx)
    return _filled(top[:, :width], lines.transpose(0, 2, 1), sy).transpose(0, 2, 1)


def matrix_blocks(df: DataFrame, size: int, table: np.ndarray) -> DataFrame:
    """(block_id, predicted) of blocks (px, mode, turned): the first samples of px are the top edge, the last ones, backwards, the left edge, and number 31 the corner."""
    compute = lambda px, mode, turned: (matrix_predict(px[:, 31], px[:, : size * 5 // 4], px[:, ::-1][:, : size * 5 // 4], mode, turned, table, size, size),)
    return over_blocks(df, ["px"], ["mode", "turned"], compute, "predicted")
