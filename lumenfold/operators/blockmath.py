"""Kernels on blocks whose positions depend on angles, phases or sizes: NumPy over Arrow batches of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import cos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The 8-tap filters of the phases 1 to 15, in units of 1/64.
PHASES = [
    [0, 1, -3, 63, 4, -1, 0, 0], [0, 1, -5, 61, 9, -2, 0, 0], [0, 1, -6, 58, 14, -4, 1, 0], [0, 1, -7, 55, 19, -5, 1, 0], [0, 1, -7, 51, 24, -6, 1, 0],
    [0, 1, -8, 47, 29, -6, 1, 0], [0, 1, -7, 42, 33, -6, 1, 0], [0, 1, -7, 38, 38, -7, 1, 0], [0, 1, -6, 33, 42, -7, 1, 0], [0, 1, -6, 29, 47, -8, 1, 0],
    [0, 1, -6, 24, 51, -7, 1, 0], [0, 1, -5, 19, 55, -7, 1, 0], [0, 1, -4, 14, 58, -6, 1, 0], [0, 0, -2, 9, 61, -5, 1, 0], [0, 0, -1, 4, 63, -3, 1, 0],
]


def over_blocks(df: DataFrame, arrays: list[str], scalars: list[str], compute: Callable, columns: str, key: str = "block_id") -> DataFrame:
    """(key, *columns), the columns arrays of BIGINT: compute gets the named arrays as (n, length) and scalars as (n,) and returns as many (n, m)."""
    names = columns.split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            given = [batch.column(1 + i).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for i in range(len(arrays))]
            given += [batch.column(1 + len(arrays) + i).to_numpy(zero_copy_only=False) for i in range(len(scalars))]
            out = []
            for found in compute(*given):
                found = np.ascontiguousarray(found.reshape(n, -1), np.int64)
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * found.shape[1], pa.int32()), pa.array(found.reshape(-1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=[key, *names])

    picked = df.select(F.col(key).cast("bigint").alias(key), *arrays, *[F.col(s).cast("bigint").alias(s) for s in scalars])
    return picked.mapInArrow(run, f"{key} long, " + ", ".join(f"{n} array<long>" for n in names))


def _between(edge: np.ndarray, base: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Between the samples `base` and base + 1 of each row of edge, in units of 1/32."""
    one, two = (np.take_along_axis(edge, x.reshape(len(edge), -1), 1).reshape(x.shape) for x in (base, base + 1))
    return one * (32 - part) + two * part + 16 >> 5


def directional(edges: np.ndarray, dx: np.ndarray, dy: np.ndarray, size: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Square blocks predicted from the top edge alone, from both edges, and from the left edge alone.

    edges: 2 * size samples of the left edge from the bottom up, the corner, 2 * size of the top edge. dx,
    dy: samples to move for each line, or column, in units of 1/64.
    """
    reach = 2 * size
    y, x = (k[None].astype(np.int64) for k in np.mgrid[0:size, 0:size])
    dx, dy = dx[:, None, None], dy[:, None, None]
    top = np.concatenate((edges[:, reach + 1 :], edges[:, -1:]), 1)
    left = np.concatenate((edges[:, reach - 1 :: -1], edges[:, :1]), 1)

    def along(edge, position, step):
        base = (position >> 6) + step
        return np.where(base > reach - 1, edge[:, reach - 1, None, None], _between(edge, np.minimum(base, reach - 1), (position & 63) >> 1))

    from_top, from_left = along(top, dx * (y + 1) + 0 * x, x), along(left, dy * (x + 1) + 0 * y, y)
    # of both: the line through a sample meets the top edge, corner included, or else the left one
    at_top, at_left = 64 * x - (y + 1) * dx, 64 * y - (x + 1) * dy
    corner = edges[:, reach : reach + 1]
    meets_top = _between(np.concatenate((corner, top), 1), np.maximum(at_top >> 6, -1) + 1, (at_top & 63) >> 1)
    meets_left = _between(np.concatenate((corner, left), 1), np.maximum(at_left >> 6, -1) + 1, (at_left & 63) >> 1)
    return from_top, np.where(at_top < -64, meets_left, meets_top), from_left


def cosine_matrix(n: int) -> np.ndarray:
    """Row k: the weights of n inputs in output k of the inverse transform of 4, 8, 16 or 32 points.

    Weights are 64 * sqrt(2) * cosines, rounded, but for one that is 83 where that gives 84; those of input 0 are 64.
    """
    units = np.outer(2 * np.arange(n) + 1, np.arange(n)) * (32 // n)
    size = np.array([[round(64 * sqrt(2) * cos(i * pi / 64)) for i in row] for row in units.tolist()])
    size[np.abs(size) == 84] = np.sign(size[np.abs(size) == 84]) * 83
    size[:, 0] = 64
    return size


def inverse_2d(coefs: np.ndarray, rows: np.ndarray, columns: np.ndarray, middle: int, last: int, low: int = -(1 << 15), high: int = (1 << 15) - 1) -> np.ndarray:
    """(n, h, w) coefficients under `rows` (w x w) along lines, rounded by 2**middle and clipped, then `columns` (h x h), rounded by 2**last.

    A block of which one side is twice the other is first scaled by 181/256.
    """
    h, w = coefs.shape[1:]
    if max(h, w) == 2 * min(h, w):
        coefs = coefs * 181 + 128 >> 8
    half = np.clip((coefs @ rows.T) + (1 << middle >> 1) >> middle, low, high)
    return (columns @ half) + (1 << last >> 1) >> last


def sub_sample(px: np.ndarray, mx: np.ndarray, my: np.ndarray, size: int = 8) -> np.ndarray:
    """Blocks moved by mx / 16 and my / 16 of a sample: eight taps along lines, then down columns; edges repeat.

    With both phases the lines keep four more bits; with one, the sum is rounded once; with none, samples stay.
    """
    filters = np.array([[0, 0, 0, 64, 0, 0, 0, 0], *PHASES])
    at = np.clip(np.arange(size)[:, None] + np.arange(-3, 5)[None], 0, size - 1)
    px = px.reshape(-1, size, size)
    fh, fv = filters[mx], filters[my]
    lines = np.einsum("nyxk,nk->nyx", px[:, :, at], fh)
    both = np.einsum("nykx,nk->nyx", (lines + 2 >> 2)[:, at, :], fv) + 512 >> 10
    down = np.einsum("nykx,nk->nyx", px[:, at, :], fv) + 32 >> 6
    mx, my = mx[:, None, None], my[:, None, None]
    return np.clip(np.where(mx == 0, np.where(my == 0, px, down), np.where(my == 0, lines + 34 >> 6, both)), 0, 255)


def refine(a: np.ndarray, b: np.ndarray, implicit: np.ndarray, size: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(dy, dx): by how much the middle windows of two blocks are best moved, in opposite directions, by two samples at most.

    Every second line counts. The first of the least sums wins; implicit: staying costs an eighth less, and is kept below 2 for each sample.
    """
    a, b = a.reshape(-1, 8, 8), b.reshape(-1, 8, 8)
    cost = lambda dy, dx: np.abs(a[:, 2 + dy : 2 + dy + size : 2, 2 + dx : 2 + dx + size] - b[:, 2 - dy : 2 - dy + size : 2, 2 - dx : 2 - dx + size]).sum((1, 2))
    stay = cost(0, 0) * 7 + 7 >> 3
    done = (implicit == 1) & (stay < 2 * size * size)
    best = np.where(implicit == 1, stay, np.iinfo(np.int64).max)
    found = np.zeros((len(a), 2), np.int64)
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            if dy or dx:
                now = cost(dy, dx)
                better = ~done & (now < best)
                best, found = np.where(better, now, best), np.where(better[:, None], [[dy, dx]], found)
    return found[:, 0], found[:, 1]


def flow_sums(a: np.ndarray, b: np.ndarray, da: int, db: int, size: int = 8) -> np.ndarray:
    """(n, 5): squares and products of both gradients of da * a + db * b, and their products with a - b, over a block.

    A gradient weighs the two neighbours on each side 42 and -5, edges repeated and doubled there, and
    is rounded by 2**7; both squares begin at the number of samples.
    """
    a, b = a.reshape(-1, size, size), b.reshape(-1, size, size)
    v, w = da * a + db * b, a - b
    k = np.arange(size)
    near = lambda d: np.clip(k + d, 0, size - 1)
    double = 1 + ((k == 0) | (k == size - 1))

    def gradient(m):  # along the last axis
        g = ((m[..., near(1)] - m[..., near(-1)]) * 42 - (m[..., near(2)] - m[..., near(-2)]) * 5) * double
        return g + 63 + (g > 0) >> 7

    gx, gy = gradient(v), gradient(v.swapaxes(1, 2)).swapaxes(1, 2)
    total = lambda p, q: (p * q).sum((1, 2))
    return np.stack([size * size + total(gx, gx), total(gx, gy), size * size + total(gy, gy), total(gx, w), total(gy, w)], 1)
