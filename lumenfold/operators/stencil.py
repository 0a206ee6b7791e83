"""Filters over bands of lines: NumPy on a few lines at a time, which Spark brings together with the lines around them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.planes import lines, with_lines_around
from .loopfilter import OUTSIDE, cdef_blocks, line_of

#: Factors of the three features and of the skip count of a class; weights of skips, step and their product, and offsets, of the four measures.
NORMALIZER = (3739, 3273, 3074, 7)
MODE_WEIGHTS = ((-527, 15325, 321), (26436, -17705, 17905), (366, -147, -194), (202, -267, -179))
MODE_OFFSETS = (-547, -21565, -573, -680)


def over_bands(samples: DataFrame, step: int, before: int, after: int, compute: Callable, columns: str) -> DataFrame:
    """(y, *columns) of each band of `step` lines of a plane (y, x, v), columns being arrays of BIGINT.

    compute gets (y, lines y - before to y + step - 1 + after), None for lines outside the plane, and
    returns a list of flat arrays. Bands meet the lines around them in windows of bounded size.
    """
    reach = max(before, step - 1 + after)
    names = columns.split(", ")
    packed = with_lines_around(lines(samples), reach).where(F.col("y") % step == 0)
    around = packed.select("y", F.slice("around", reach - before + 1, before + step + after).alias("around"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            rows = []
            for y, near in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.append(compute(y, [None if one is None else np.array(one, np.int64) for one in near]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i in range(len(names)))], names=["y", *names])

    return around.mapInArrow(run, "y long, " + ", ".join(f"{n} array<long>" for n in names))


def spread_band(bands: DataFrame, *arrays: str, width: int) -> DataFrame:
    """A row (y, x, ...) for each position of flat arrays that hold lines of `width`."""
    zipped = F.arrays_zip(*arrays) if len(arrays) > 1 else F.transform(arrays[0], lambda v: F.struct(v.alias(arrays[0])))
    i = F.col("i").cast("bigint")
    return bands.select("y", F.posexplode(zipped).alias("i", "s")).select((F.col("y") + F.floor(i / width)).cast("bigint").alias("y"), (i % width).alias("x"), *[F.col("s")[a].alias(a) for a in arrays])


def _filled(near: list, home: int) -> list[np.ndarray]:
    """Lines outside the plane replaced by the nearest one inside; near[home] is inside."""
    out = list(near)
    for i in range(home - 1, -1, -1):
        out[i] = out[i + 1] if out[i] is None else out[i]
    for i in range(home + 1, len(out)):
        out[i] = out[i - 1] if out[i] is None else out[i]
    return out


def padded(near: list, home: int, left: int, right: int) -> np.ndarray:
    """The lines as one array, with the plane's edges repeated on all sides; lines may differ in width."""
    filled = _filled(near, home)
    width = max(map(len, filled))
    return np.stack([np.pad(one, (left, right + width - len(one)), mode="edge") for one in filled])


def _second_differences(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertical, antidiagonal and diagonal magnitudes at all inner samples."""
    up, middle, down = p[:-2], 2 * p[1:-1, 1:-1], p[2:]
    return tuple(np.abs(a - middle + b) for a, b in ((up[:, 1:-1], down[:, 1:-1]), (up[:, 2:], down[:, :-2]), (up[:, :-2], down[:, 2:])))


def _window_sums(p: np.ndarray, blocks: int) -> list[np.ndarray]:
    """The sums of second differences over the 6x6 samples around each 4x4 block; p begins two samples before the first block and line."""
    out = []
    for d in _second_differences(p):
        total = np.concatenate(([0], np.cumsum(d.sum(0))))
        at = 4 * np.arange(blocks)
        out.append(total[at + 6] - total[at])
    return out


def class_features(samples: DataFrame) -> DataFrame:
    """(y, vertical, antidiagonal, diagonal): for each band of four lines, the features of its 4x4 blocks over 6x6 windows, the plane's edges repeated."""

    def compute(y: int, near: list) -> list:
        blocks = -(-len(near[2]) // 4)
        return [x.tolist() for x in _window_sums(padded(near, 2, 2, 6), blocks)]

    return over_bands(samples, 4, 2, 2, compute, "vertical, antidiagonal, diagonal")


def class_index(features: list, skips, base_q: int):
    """A block's class from its features (vertical, antidiagonal, diagonal) and its weighted count of skipped neighbours, as a Column: four measures of three bits each."""
    from ..functions.integer import clip, shr

    tskip = skips * NORMALIZER[3]
    prod = shr(tskip * base_q + 128, 8)

    def measure(i: int):
        a, b, c = MODE_WEIGHTS[i]
        q = a * (tskip * 32) + b * base_q + c * prod
        rounded = F.when(q < 0, -shr(-q + (1 << 12), 13)).otherwise(shr(q + (1 << 12), 13))
        return 255 * (MODE_OFFSETS[i] + rounded)

    def bin_of(q):
        return shr(clip(shr(F.greatest(F.lit(0), q) + (1 << 13), 14), 0, 255), 5)

    out = bin_of(measure(0)) * 512
    for i, feature in enumerate(features):
        out = out + bin_of(feature * NORMALIZER[i] + measure(i + 1)) * (1 << 3 * (2 - i))
    return out.cast("bigint")


def classified_filter(samples: DataFrame, filters: list[tuple[int, list[tuple[int, int, int]]]]) -> DataFrame:
    """(y, filtered): each 4x4 block under the filter of its largest feature, the first of equal ones.

    filters: for each feature a centre weight and taps (dy, dx, weight) up to two samples away, which
    also apply to the opposite neighbour. (centre * sample + sums of pairs + 64) >> 7, clipped.
    """

    def compute(y: int, near: list) -> list:
        own = [one for one in near[2:6] if one is not None]
        width = len(own[0])
        blocks = -(-width // 4)
        p = padded(near, 2, 2, 6)
        kind = np.repeat(np.argmax(np.stack(_window_sums(p, blocks)), 0), 4)[:width]
        at = lambda dy, dx: p[2 + dy : 2 + dy + len(own), 2 + dx : 2 + dx + width]
        out = np.zeros((len(own), width), np.int64)
        for n, (centre, taps) in enumerate(filters):
            value = centre * at(0, 0) + sum(c * (at(dy, dx) + at(-dy, -dx)) for dy, dx, c in taps)
            out = np.where(kind[None, :] == n, np.clip(value + 64 >> 7, 0, 255), out)
        return [np.concatenate([line[: len(one)] for line, one in zip(out, own)]).tolist()]

    return over_bands(samples, 4, 2, 2, compute, "filtered")


def wiener_with_luma(luma: DataFrame, chroma: Callable, taps: list[tuple[int, int, int]], luma_taps: list[tuple[int, int, int]]) -> DataFrame:
    """(y, filtered): a chroma plane of the luma's size under symmetric taps on itself and one-sided taps on the luma's differences.

    chroma gives a line of chroma from (y, a line of luma); reach is two lines and samples at most.
    """

    def compute(y: int, near: list) -> list:
        other = [None if one is None else chroma(y + k - 2, one) for k, one in enumerate(near)]
        l, c = padded(near, 2, 2, 2), padded(other, 2, 2, 2)  # noqa: E741
        width = len(near[2])
        at = lambda p, dy, dx: p[2 + dy, 2 + dx : 2 + dx + width]
        m = at(c, 0, 0)
        total = 128 * m + sum(w * (at(c, dy, dx) + at(c, -dy, -dx) - 2 * m) for dy, dx, w in taps) + sum(w * (at(l, dy, dx) - at(l, 0, 0)) for dy, dx, w in luma_taps)
        return [np.clip(total + 64 >> 7, 0, 255).tolist()]

    return over_bands(luma, 1, 2, 2, compute, "filtered")


_LINES = []
for _d in range(8):
    _m = np.zeros((16, 64), np.int64)
    for _k in range(64):
        _m[line_of(_d, _k // 8, _k % 8), _k] = 1
    _n = _m.sum(1)
    _LINES.append((_m, np.where(_n, 840 // np.maximum(_n, 1), 0)))


def directions(px: np.ndarray) -> np.ndarray:
    """The direction of each 8x8 block of an array (n, 64): the family of lines whose sums vary most, the first of equal ones."""
    costs = [((px - 128) @ m.T) ** 2 @ w for m, w in _LINES]
    return np.argmax(np.stack(costs), 0)


def cdef_plane(samples: DataFrame, primary: int, secondary: int, damping: int = 5) -> DataFrame:
    """(y, cdef): bands of eight lines, each whole 8x8 block filtered along its direction, with the samples of the blocks around it.

    Samples outside the plane are unavailable. Blocks that aren't whole stay as they are, but serve as neighbours.
    """

    def compute(y: int, near: list) -> list:
        own = [one for one in near[2:10] if one is not None]
        out, blocks = [one.copy() for one in own], min(map(len, own)) // 8
        if len(own) == 8 and blocks:
            width = max(len(one) for one in near if one is not None)
            p = np.full((12, width + 4), OUTSIDE)
            for k, one in enumerate(near):
                if one is not None:
                    p[k, 2 : 2 + len(one)] = one
            tiles = np.stack([p[:, 8 * b : 8 * b + 12] for b in range(blocks)])
            found = directions(tiles[:, 2:10, 2:10].reshape(blocks, 64))
            for d in np.unique(found):
                for b, tile in zip(np.flatnonzero(found == d), cdef_blocks(tiles[found == d], int(d), primary, secondary, damping)):
                    for line, new in zip(out, tile):
                        line[8 * b : 8 * b + 8] = new
        return [np.concatenate(out).tolist()]

    return over_bands(samples, 8, 2, 2, compute, "cdef")
