"""Motion fields: vectors sent along themselves to cells of another field, holes filled, neighbours averaged, gaps between samples closed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.integer import clip, shr
from ..sources.planes import hold
from .blockmath import over_blocks

#: Cells in a side of the blocks inside which vectors may land, be filled and be averaged; samples of a cell are 1/64 of it.
BLOCK, CELL = 8, 64
#: Stands for no vector in arrays of components.
NONE = -(1 << 15)


def scaled(v: Column, factor: Column) -> Column:
    """v * factor / 2**14, halves away from zero."""
    p = v * factor
    return clip(shr((p + 8192 - F.when(p < 0, 1).otherwise(0)).cast("bigint"), 14), -65535, 65535)


def project(vectors: DataFrame, rows: int, columns: int, edge: int = BLOCK) -> DataFrame:
    """(field, y, x, mv_y, mv_x, reference): the vector that lands on each cell of each field.

    vectors: field, source, y, x, mv_y, mv_x, factor (how far the field lies along the vector, in
    units of 2**-14), reference (its distance, negative for the other direction), wanted. A vector
    goes back along itself by its factor, and lands if that is inside the field, and if it comes from
    the rows of the block of BLOCK cells that it lands in, or from its columns and `edge` more.
    Vectors of one cell are taken in the order of source, y and x: the first stays, but one that is
    wanted replaces one of another distance. A cell is reached by few vectors: those of a block and
    its edges, once for each source; the order of repeated ones is that of their components. Vectors
    with nulls don't land.
    """
    at = lambda start, v: start - F.sign(v).cast("bigint") * shr(F.abs(v), 6)
    moved = hold(vectors, _dy=scaled(F.col("mv_y"), -F.col("factor")), _dx=scaled(F.col("mv_x"), -F.col("factor")))
    moved = hold(moved, to_y=at(F.col("y"), F.col("_dy")), to_x=at(F.col("x"), F.col("_dx")))
    begin = lambda c: F.floor(F.col(c) / BLOCK) * BLOCK
    inside = (F.col("to_y") >= 0) & (F.col("to_y") < rows) & (F.col("to_x") >= 0) & (F.col("to_x") < columns)
    near = (F.col("y") >= begin("to_y")) & (F.col("y") < begin("to_y") + BLOCK) & (F.col("x") >= begin("to_x") - edge) & (F.col("x") < begin("to_x") + BLOCK + edge)
    sign = F.when(F.col("reference") < 0, -1).otherwise(1)
    landed = F.struct("source", "y", "x", (F.col("mv_y") * sign).alias("mv_y"), (F.col("mv_x") * sign).alias("mv_x"), F.abs("reference").alias("reference"), "wanted")
    cells = moved.where(inside & near).groupBy("field", "to_y", "to_x").agg(F.sort_array(F.collect_list(landed)).alias("all"))
    keep = lambda held, v: F.when(v["wanted"] & (v["reference"] != held["reference"]), v).otherwise(held)
    found = cells.select("field", F.col("to_y").alias("y"), F.col("to_x").alias("x"), F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.col("all")[0], keep).alias("v"))
    return found.select("field", "y", "x", "v.mv_y", "v.mv_x", "v.reference")


def block_fields(cells: DataFrame) -> DataFrame:
    """(field, by, bx, vy, vx): the vectors of each block of BLOCK cells as arrays, NONE where there is none. A group holds the cells of a block."""
    place = (F.col("y") % BLOCK) * BLOCK + F.col("x") % BLOCK
    grouped = cells.groupBy("field", F.floor(F.col("y") / BLOCK).alias("by"), F.floor(F.col("x") / BLOCK).alias("bx"))
    found = grouped.agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int"), F.struct("mv_y", "mv_x")))).alias("m"))
    part = lambda name: F.transform(F.sequence(F.lit(0), F.lit(BLOCK * BLOCK - 1)), lambda i: F.coalesce(F.try_element_at("m", i)[name], F.lit(NONE)).cast("bigint"))
    return found.select("field", "by", "bx", part("mv_y").alias("vy"), part("mv_x").alias("vx"))


def _filled(vy: np.ndarray, vx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Holes take the vector above or on the left, as it is once its own turn is over; those that have neither, the one on the right or below."""
    n, at = len(vy), np.arange(BLOCK)
    both = np.stack([vy, vx], -1).reshape(n, BLOCK, BLOCK, 2).copy()
    for y in range(BLOCK):
        row = both[:, y]
        if y:
            row = np.where((row[..., :1] == NONE), both[:, y - 1], row)
        last = np.maximum.accumulate(np.where(row[..., 0] != NONE, at, -1), axis=1)
        taken = np.take_along_axis(row, np.maximum(last, 0)[..., None], 1)
        both[:, y] = np.where(last[..., None] >= 0, taken, NONE)
    none = np.full_like(both[:, :, :1], NONE)
    right, below = np.concatenate((both[:, :, 1:], none), 2), np.concatenate((both[:, 1:], none.transpose(0, 2, 1, 3)), 1)
    found = np.where(both[..., :1] != NONE, both, np.where(right[..., :1] != NONE, right, below))
    return found[..., 0].reshape(n, -1), found[..., 1].reshape(n, -1)


def fill_holes(fields: DataFrame) -> DataFrame:
    """(block_id, fy, fx): blocks of vectors (vy, vx) whose holes are filled from their neighbours, in the order of lines; NONE where a block has no vector."""
    return over_blocks(fields, ["vy", "vx"], [], _filled, "fy, fx")


def _smoothed(vy: np.ndarray, vx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(vy)
    there = (vy != NONE).reshape(n, BLOCK, BLOCK)
    padded = np.pad(there, ((0, 0), (1, 1), (1, 1)))
    cross = lambda p: p[:, 1:-1, 1:-1] + p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:]
    count = cross(padded.astype(np.int64))
    out = []
    for v in (vy, vx):
        total = cross(np.pad(np.where(there, v.reshape(n, BLOCK, BLOCK), 0), ((0, 0), (1, 1), (1, 1))))
        mean = total * (65536 // np.maximum(count, 1)) + 32768 - (total < 0) >> 16
        out.append(np.where(count > 0, mean, NONE).reshape(n, -1))
    return out[0], out[1]


def smooth(fields: DataFrame) -> DataFrame:
    """(block_id, sy, sx): each cell's mean over itself and its four neighbours in the block that have vectors; NONE where none has."""
    return over_blocks(fields, ["vy", "vx"], [], _smoothed, "sy, sx")


def _closed(vy: np.ndarray, vx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, half = len(vy), BLOCK // 2
    out = []
    mask = (vy != NONE).reshape(n, BLOCK, BLOCK)[:, ::2, ::2]
    pad = lambda x: np.pad(x, ((0, 0), (0, 1), (0, 1)))
    there = pad(mask)
    r, b, d = there[:, :-1, 1:], there[:, 1:, :-1], there[:, 1:, 1:]
    for v in (vy, vx):
        own = v.reshape(n, BLOCK, BLOCK)[:, ::2, ::2]
        all_ = pad(own)
        right, below, across = all_[:, :-1, 1:] * r, all_[:, 1:, :-1] * b, all_[:, 1:, 1:] * d
        mean = lambda total: total + (total > 0) >> 1
        total, count = own + right + below + across, 1 + r.astype(np.int64) + b + d
        middle = np.select([count == 1, count == 2, count == 3], [own, mean(total), total * 85 + 128 - (total < 0) >> 8], total + 1 + (total > 0) >> 2)
        whole = np.empty((n, half, 2, half, 2), np.int64)
        whole[:, :, 0, :, 0], whole[:, :, 0, :, 1], whole[:, :, 1, :, 0], whole[:, :, 1, :, 1] = own, np.where(r, mean(own + right), own), np.where(b, mean(own + below), own), middle
        whole = np.where(mask[:, :, None, :, None], whole, NONE)
        out.append(whole.reshape(n, -1))
    return out[0], out[1]


def close_gaps(fields: DataFrame) -> DataFrame:
    """(block_id, gy, gx): fields known at every second cell of every second line, with what lies between: means of two, three or four known neighbours; NONE beside an unknown cell."""
    return over_blocks(fields, ["vy", "vx"], [], _closed, "gy, gx")
