"""Sample planes as DataFrames: 8x8 blocks as arrays, whole planes as rows of samples.

An array is row-major; a plane has a row (y, x, v) for each sample. Values are BIGINT throughout, so
that ANSI arithmetic never overflows in a kernel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples in a line of the plane that the events table is read as.
WIDTH = 100
#: Lines of a band, in which windows over lines run; each band also gets the lines of its halo.
BAND = 64
#: Rows that a task is worth starting for.
LEAST = 256


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each computed once for a row.

    The optimizer merges neighbouring projections, and an array that is merged into a lambda would be
    computed anew for every element that the lambda reads; a generator of one row stands between them.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, most: int, *by: str) -> DataFrame:
    """df in partitions of about `most` rows, or in two for each core if these have LEAST rows: for rows from which much is made.

    To Spark a file is as many partitions as it has groups of rows, which can be one for a million rows.
    """
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, math.ceil(n / most), min(math.ceil(n / LEAST), 2 * cores)), *by)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block_id, px): each embedding as an 8x8 block of 8-bit samples."""
    sample = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 0.6) * 212.5))).cast("bigint")
    found = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("block_id"), "embedding")
    return hold(found, px=F.transform("embedding", sample)).select("block_id", "px")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block_id, px, px2): each block and the one with the next id."""
    one = blocks(spark, sf_dir)
    return one.join(one.select((F.col("block_id") - 1).alias("block_id"), F.col("px").alias("px2")), "block_id")


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, v): the events as one plane, WIDTH samples to a line."""
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor("value"))).cast("bigint")
    return read(spark, sf_dir, "events").select((F.floor(F.col("event_id") / WIDTH)).cast("bigint").alias("y"), (F.col("event_id") % WIDTH).alias("x"), v.alias("v"))


def lines(samples: DataFrame) -> DataFrame:
    """(y, line): the samples of each line of a plane in the order of x; a line is bounded by the plane's width."""
    return samples.groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda s: s["v"]).alias("line"))


def with_lines_around(packed: DataFrame, reach: int) -> DataFrame:
    """(y, line, around): around[reach + d] is the line d below, null outside the plane.

    Lines are dealt to bands with a halo of `reach` lines, so a window holds BAND + 2 * reach lines
    however tall the plane is.
    """
    from pyspark.sql import Window

    bands = F.array_distinct(F.transform(F.array(F.lit(-reach), F.lit(0), F.lit(reach)), lambda d: F.floor((F.col("y") + d) / BAND)))
    dealt = packed.withColumn("band", F.explode(bands))
    w = Window.partitionBy("band").orderBy("y")
    at = lambda d: F.lag("line", -d).over(w) if d < 0 else F.lead("line", d).over(w)
    around = [F.col("line") if d == 0 else F.when((F.lag("y", -d).over(w) if d < 0 else F.lead("y", d).over(w)) == F.col("y") + d, F.lag("line", -d).over(w) if d < 0 else at(d)) for d in range(-reach, reach + 1)]
    return dealt.withColumn("around", F.array(*around)).where(F.floor(F.col("y") / BAND) == F.col("band")).select("y", "line", "around")


def spread_block(df: DataFrame, *arrays: str, width: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row (block_id, y, x, ...) for each position of the named arrays, with the columns in keep."""
    zipped = F.arrays_zip(*arrays) if len(arrays) > 1 else F.transform(arrays[0], lambda v: F.struct(v.alias(arrays[0])))
    out = df.select("block_id", *keep, F.posexplode(zipped).alias("i", "s"))
    i = F.col("i").cast("bigint")
    return out.select("block_id", *keep, F.floor(i / width).cast("bigint").alias("y"), (i % width).alias("x"), *[F.col("s")[a].alias(a) for a in arrays])


def spread_line(df: DataFrame, *arrays: str) -> DataFrame:
    """A row (y, x, ...) for each position of the named arrays of a line."""
    zipped = F.arrays_zip(*arrays) if len(arrays) > 1 else F.transform(arrays[0], lambda v: F.struct(v.alias(arrays[0])))
    out = df.select("y", F.posexplode(zipped).alias("i", "s"))
    return out.select("y", F.col("i").cast("bigint").alias("x"), *[F.col("s")[a].alias(a) for a in arrays])


def pack(samples: DataFrame, image: str, bits: int = 8) -> DataFrame:
    """(image, packed): the samples of each image without padding, a byte each, or two little-endian ones above 8 bits."""
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    code = byte(F.col("v")) if bits == 8 else F.concat(byte(F.col("v") % 256), byte(F.floor(F.col("v") / 256)))
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", code.alias("h"))))
    return samples.groupBy(image).agg(F.unhex(F.array_join(F.transform(ordered, lambda s: s["h"]), "")).alias("packed"))


def clip8(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("bigint")
