"""Restoration of whole images in stripes: a filter by units over one snapshot, lines beyond a stripe from an earlier one, and a correction from gradients.

A stripe sees its own lines as the last filter left them, and the lines beside it as they were before
that; beyond the image the nearest line repeats. The correction is worked out before the filter and
added after it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blockmath import over_blocks

#: Lines beside a stripe that filters read; what stands where an image has no sample.
REACH, MISSING = 3, 128


def spread_error(kind: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A stand-in for a trained table of corrections, by class and size of a cell's gradients."""
    return (kind * 37 + size * 11) % 33 - 16


def _correction(p: np.ndarray, error) -> np.ndarray:
    """By 2x2 cells of p, which has one sample more on all sides: gradients in four directions, their class, the table's entry."""
    n, height, width = p.shape
    m = p[:, 1:-1, 1:-1]
    steps = [(1, 0), (0, 1), (1, 1), (1, -1)]
    of = lambda dy, dx: p[:, 1 + dy : height - 1 + dy, 1 + dx : width - 1 + dx]
    cells = [np.abs(2 * m - of(dy, dx) - of(-dy, -dx)).reshape(n, (height - 2) // 2, 2, (width - 2) // 2, 2).sum((2, 4)) for dy, dx in steps]
    kind = (cells[0] <= cells[1]) + 2 * (cells[2] <= cells[3])
    return error(kind, sum(cells) >> 3).repeat(2, 1).repeat(2, 2)


def restore_stripes(lines: np.ndarray, filtered: np.ndarray, scale: np.ndarray, taps: dict[tuple[int, int], int], unit: int, error=spread_error) -> np.ndarray:
    """Stripes (n, height + 2 * REACH, width), their lines beside included; filtered and scale by unit of columns: whether the filter is on, and how strong the correction is, 0 for none."""
    n, height, width = lines.shape[0], lines.shape[1] - 2 * REACH, lines.shape[2]
    p = np.pad(lines.astype(np.int64), ((0, 0), (0, 0), (REACH, REACH)), mode="edge")
    near = lambda dy, dx: p[:, REACH + dy : REACH + dy + height, REACH + dx : REACH + dx + width]
    own = near(0, 0)
    off = _correction(p[:, REACH - 1 : REACH + height + 1, REACH - 1 : REACH + width + 1], error)
    total = 128 * own + sum((near(dy, dx) + near(-dy, -dx) - 2 * own) * c for (dy, dx), c in taps.items())
    of_column = lambda x: x.repeat(unit, 1)[:, None, :width]
    out = np.where(of_column(filtered) > 0, np.clip(total + 64 >> 7, 0, 255), own)
    change = off * of_column(scale)
    return np.clip(out + np.sign(change) * (np.abs(change) + 8 >> 4), 0, 255)


def restore_images(before: DataFrame, after: DataFrame, width: int, height: int, taps: dict[tuple[int, int], int], units, unit: int = 32, stripe: int = 16, first: int = 8) -> DataFrame:
    """(image, y, x, v) of images restored; before and after: (image, y, x, v), the snapshots that lines beside a stripe and its own come from.

    The first stripe has `first` lines, the others `stripe`, all even; units(image, row, column) gives
    Columns filtered (0 or 1) and scale for each unit of columns in a stripe, row being the unit of
    the stripe's first line. A group holds a stripe with REACH lines on both sides. Missing samples
    count as MISSING; a stripe without any sample is not returned.
    """
    number = lambda y: F.floor((y + stripe - first) / stripe).cast("bigint")
    begin = lambda s: F.when(s == 0, 0).otherwise(s * stripe - stripe + first)
    last = number(F.lit(height - 1))
    own = after.select("image", number(F.col("y")).alias("s"), "y", "x", "v")
    sides = before.withColumn("s", F.explode(F.array_distinct(F.array(number(F.col("y") - REACH), number(F.col("y") + REACH)))))
    beside = sides.where((F.col("s") != number(F.col("y"))) & (F.col("s") >= 0) & (F.col("s") <= last)).select("image", "s", "y", "x", "v")
    tall = stripe + 2 * REACH
    place = ((F.col("y") - begin(F.col("s")) + REACH) * width + F.col("x")).cast("int")
    grouped = own.unionByName(beside).groupBy("image", "s").agg(F.map_from_entries(F.collect_list(F.struct(place, "v"))).alias("m"))
    # lines beyond the image repeat its first or last one; of a short stripe, lines beyond its sides are not read
    top, bottom = F.greatest(F.lit(0), REACH - begin(F.col("s"))), F.least(F.lit(tall - 1), height - 1 - begin(F.col("s")) + REACH)
    line = lambda i: F.greatest(top, F.least(bottom, F.floor(i / width)))
    size = lambda s: F.when(s == 0, first).otherwise(stripe)
    whole = F.transform(F.sequence(F.lit(0), F.lit(tall * width - 1)), lambda i: F.coalesce(F.try_element_at("m", (line(i) * width + i % width).cast("int")), F.lit(MISSING)).cast("bigint"))
    columns = F.sequence(F.lit(0), F.lit(-(-width // unit) - 1))
    of_units = lambda name: F.transform(columns, lambda c: units(F.col("image"), F.floor(begin(F.col("s")) / unit), c)[name].cast("bigint"))
    key = F.col("image") * (1 << 16) + F.col("s")
    rows = grouped.select(key.alias("block_id"), whole.alias("v"), of_units("filtered").alias("filtered"), of_units("scale").alias("scale"), size(F.col("s")).alias("lines"))

    def compute(v, filtered, scale, lines):
        v, out = v.reshape(len(v), tall, width), np.zeros((len(v), stripe, width), np.int64)
        for h in np.unique(lines):
            some = lines == h
            out[some, :h] = restore_stripes(v[some, : h + 2 * REACH], filtered[some], scale[some], taps, unit)
        return (out,)

    found = over_blocks(rows, ["v", "filtered", "scale"], ["lines"], compute, "v").select("block_id", F.posexplode("v").alias("i", "v"))
    i, s = F.col("i").cast("bigint"), F.col("block_id") % (1 << 16)
    y = begin(s) + F.floor(i / width)
    return found.where((F.floor(i / width) < size(s)) & (y < height)).select(F.floor(F.col("block_id") / (1 << 16)).alias("image"), y.cast("bigint").alias("y"), (i % width).alias("x"), "v")
