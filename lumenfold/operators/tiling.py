"""Tile layouts, and ranking of reference frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.integer import shr


#: Tiles along a side that a frame may have.
MOST_TILES = 64


def uniform_tiles(size: Column, log2_tiles: int, log2_unit: int = 6) -> Column:
    """The first unit of each tile when `size` samples are cut into 2**log2_tiles tiles of nearly equal whole units; null above MOST_TILES.

    Full units are shared out evenly; the first tiles get one more each of what is left over.
    """
    full = F.greatest(F.lit(1), shr(size + 7, log2_unit))
    units = 1 + shr(size - 1, log2_unit)
    base = shr(full, log2_tiles)
    extra = full - base * (1 << log2_tiles) + F.when(base == 0, units - full).otherwise(0)
    first = lambda k: k * base + F.least(k, F.greatest(extra, F.lit(0)))
    starts = F.transform(F.sequence(F.lit(0), F.lit((1 << log2_tiles) - 1)), lambda k: first(k).cast("bigint"))
    found = F.array_distinct(F.filter(starts, lambda s: s < units))
    return F.when(F.size(found) <= MOST_TILES, found)


def rank_references(frames: DataFrame, group: str, score: str, order: str, k: int) -> DataFrame:
    """The k frames of each group of least score, the latest of equal ones first, with their rank from 0.

    The rank filter is pushed into the window, which keeps k rows of a group on each side of the shuffle.
    """
    w = Window.partitionBy(group).orderBy(F.col(score), F.col(order).desc())
    return frames.withColumn("rank", (F.row_number().over(w) - 1).cast("bigint")).where(F.col("rank") < k)
