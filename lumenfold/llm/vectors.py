"""What the searches over vectors share: rows that take part, and a stated query set against all rows in blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of vectors, as doubles, in one block of rows; a task holds one such block and one of queries.
BLOCK_BYTES = 16 << 20


def finite(vector: str) -> Column:
    """Whether a column of arrays of numbers is neither null nor holds a null or non-finite component."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def commonest_length(rows: DataFrame, vector: str) -> int:
    """The number of components that most rows have, the larger of several; 0 for an empty table."""
    got = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return max(got["d"], 0) if got else 0


def matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Rows of d doubles from a column of lists of d numbers."""
    parts = [np.asarray(c.flatten(), np.float64) for c in column.chunks]
    return np.concatenate(parts).reshape(-1, d) if parts else np.zeros((0, d))


def in_blocks(rows: DataFrame, row_key: str, queries: DataFrame, query_key: str, d: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What work returns for each pair of a block of rows and a block of queries, two tables just written.

    Blocks are dealt by hashes of the keys, so no value gathers anywhere. Each row goes to every
    block of queries and each query to every block of rows: n/B and q/B copies with B rows in
    BLOCK_BYTES, which is what comparing a stated set with all rows costs at least. Few queries are
    dealt to more blocks, so that all cores have work.
    """
    most, n, q = max(256, BLOCK_BYTES // (8 * max(d, 1))), rows.count(), queries.count()
    row_blocks = max(1, math.ceil(n / most))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    query_blocks = max(1, math.ceil(q / most), min(math.ceil(q / 64), math.ceil(2 * cores / row_blocks)))

    def dealt(df: DataFrame, key: str, own: str, blocks: int, other: str, copies: int) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(own)
        return df.withColumn("_own", block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumnRenamed("_own", own)

    left = dealt(rows, row_key, "_r", row_blocks, "_q", query_blocks)
    right = dealt(queries, query_key, "_q", query_blocks, "_r", row_blocks)
    return left.groupBy("_r", "_q").cogroup(right.groupBy("_r", "_q")).applyInArrow(work, schema)
