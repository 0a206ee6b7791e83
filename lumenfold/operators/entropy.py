"""Adaptive probability models: cumulative distributions in units of 1/32768, kept as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.integer import shr

#: Symbols of a tile at most, so that a tile's ordered symbols are a bounded array.
TILE = 64


def update(cdf: Column, symbol: Column, rate: Column) -> Column:
    """Entries before the symbol move towards 32768, the others towards 0, by 1 / 2**rate of the way."""
    step = lambda v: F.call_function("shiftright", v, rate.cast("int"))
    return F.transform(cdf, lambda p, i: F.when(i < symbol, p + step(32768 - p)).otherwise(p - step(p)))


def adapt(tiles: DataFrame, symbols: str, size: int) -> DataFrame:
    """cdf, count: a uniform distribution of `size` + 1 symbols after all symbols of the tile, in order.

    The rate grows with the count, 4, 5 and then 6 from 32 symbols on, one more for over three symbols.
    """
    start = F.struct(F.array(*[F.lit(32768 * (size - i) // (size + 1)).cast("bigint") for i in range(size)]).alias("cdf"), F.lit(0).cast("bigint").alias("count"))

    def step(a, symbol):
        rate = 4 + shr(a["count"], 4) + int(size > 2)
        return F.struct(update(a["cdf"], symbol, rate).alias("cdf"), F.least(F.lit(32), a["count"] + 1).cast("bigint").alias("count"))

    return tiles.withColumn("_state", F.aggregate(symbols, start, step)).withColumns({"cdf": F.col("_state.cdf"), "count": F.col("_state.count")}).drop("_state")


def average_tiles(models: DataFrame, key: str, log2: int) -> DataFrame:
    """(key, pos, p): the sum over 2**log2 tiles of each entry / 2**log2; shifts come first, so partial sums add up alike."""
    entries = models.select(key, F.posexplode("cdf").alias("pos", "p"))
    return entries.groupBy(key, "pos").agg(F.sum(shr(F.col("p"), log2)).cast("bigint").alias("p")).withColumn("pos", F.col("pos").cast("bigint"))


def average_two(primary: str, secondary: str) -> Column:
    """Seven parts of the first and one of the second."""
    return F.zip_with(primary, secondary, lambda a, b: shr(7 * a + b + 4, 3))


def reset_count(count: Column) -> Column:
    return F.floor(count * 3 / 4).cast("bigint")
