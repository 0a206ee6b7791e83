"""Hard negatives by a vertical scan: dimensions are read one after another, and bounds on the rest drop candidates.

Every block of rows is kept by dimension, with the least and greatest value of each. For an anchor
the dimensions come in the order of its components' magnitudes, STEP at a time. What the dimensions
not yet read can add lies between two sums of least and greatest contributions; a candidate whose
bounds leave it out of every window, or below enough that are surely inside, leaves the bitmap. The
few left at the end have exact integer scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import commonest_length, finite, in_blocks, matrix

#: Components are multiplied by this and floored.
SCALE = 256
#: Dimensions read between two looks at the bounds.
STEP = 8
#: Magnitude, after scaling, from which on a row takes no part: products of larger ones might not fit in 63 bits.
MOST = 1 << 26


class Columns:
    """A block of rows by dimension."""

    def __init__(self, values: np.ndarray):
        self.by_dim = np.ascontiguousarray(values.T)  # a row for each dimension
        self.least, self.most = self.by_dim.min(1), self.by_dim.max(1)

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the candidates that keep(partial, low, high) never drops.

        keep is given partial sums and what the other dimensions add at least and at most, and says which stay.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.least, anchor * self.most])[:, order]
        low, high = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (ends.min(0), ends.max(0)))
        rows = np.flatnonzero(bitmap)
        partial = np.zeros(len(rows), np.int64)
        for at in range(0, len(order), STEP):
            for dim in order[at : at + STEP]:
                partial += anchor[dim] * self.by_dim[dim][rows]
            to = min(at + STEP, len(order))
            stays = keep(partial, low[to], high[to])
            rows, partial = rows[stays], partial[stays]
        return rows, partial


def _at_least(partial: np.ndarray, low: int, high: int, k: int) -> np.ndarray:
    """Which may be among the k highest, ties included."""
    if len(partial) <= k:
        return np.ones(len(partial), bool)
    return partial + high >= np.partition(partial, len(partial) - k)[len(partial) - k] + low


def _in_windows(partial: np.ndarray, low: int, high: int, windows: list[tuple[int, int]], k: int) -> np.ndarray:
    """Which may be among the k highest within any of the windows, ties included."""
    stays = np.zeros(len(partial), bool)
    for least, most in windows:
        may = (partial + high >= least) & (partial + low <= most)
        sure = partial[(partial + low >= least) & (partial + high <= most)]
        if len(sure) >= k:
            may &= partial + high >= np.partition(sure, len(sure) - k)[len(sure) - k] + low
        stays |= may
    return stays


def window(positive: int, least: int, most: int) -> tuple[int, int]:
    """The integers n with least * positive <= 100 * n <= most * positive, as (first, last)."""
    return -(-least * positive // 100), most * positive // 100


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties by the smaller id."""
    return np.lexsort((ids[rows], -scores))[:k]


def mine(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, wrong: int = 7, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """For each anchor and each of its positives the hardest negatives of the window: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's components are floor(256 * x); where vec_id is divisible by `wrong` its label is
    (label + 1) % 10. Anchors are rows whose vec_id is divisible by `every`. Positives are the
    first rows of the anchor's label, itself left out; negatives the first rows of other labels with
    least * positive_score <= 100 * negative_score <= most * positive_score: highest inner product
    first, ties by smaller vec_id. Fewer are returned where there are fewer.

    Rows with a null vec_id, label or vector, a null or non-finite component, another than the
    commonest length, or a component of 2**26 or more after scaling, take no part. Rows that repeat
    are rows like any other: an anchor leaves out itself alone. An empty table gives no rows; other
    columns are not read.
    """
    named = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).cast("long").alias("label"))
    named = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("vector"))
    named = named.where(F.forall("vector", lambda x: F.abs(x) < MOST / SCALE))
    d = commonest_length(named, "vector")
    used = named.where((F.size("vector") == d) & (F.size("vector") > 0)).select(
        "vec_id", F.when(F.col("vec_id") % wrong == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("vector", lambda x: F.floor(x * SCALE).cast("int")).alias("vector"), F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(used, "scaled")
    anchors = rows.where(F.col("vec_id") % every == 0)

    def opened(block: pa.Table) -> tuple[Columns, np.ndarray, np.ndarray, np.ndarray]:
        return Columns(matrix(block.column("vector"), d).astype(np.int64)), *(np.asarray(block.column(c)) for c in ("row", "vec_id", "label"))

    def nearest(block: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if len(block) and len(asked):
            columns, row, ids, labels = opened(block)
            for a, own, kind in zip(matrix(asked.column("vector"), d).astype(np.int64), asked.column("row").to_pylist(), asked.column("label").to_pylist()):
                got, scores = columns.scan(a, (labels == kind) & (row != own), lambda *x: _at_least(*x, positives))
                first = _best(got, scores, ids, positives)
                found += [(own, s, i, r) for s, i, r in zip(scores[first].tolist(), ids[got[first]].tolist(), row[got[first]].tolist())]
        return pa.table({name: pa.array([x[i] for x in found], pa.int64()) for i, name in enumerate(("_anchor", "positive_score", "positive_id", "positive_row"))})

    near = in_blocks(rows, "row", materialize(anchors, "anchors"), "row", d, nearest, "_anchor long, positive_score long, positive_id long, positive_row long")
    order = Window.partitionBy("_anchor").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    lists = near.groupBy("_anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score", "positive_id"))).alias("near"))
    # two arrays beside the anchor: at most `positives` scores and ids each
    asked = anchors.join(lists, F.col("row") == F.col("_anchor")).select("row", "label", "vector", "vec_id", F.col("near.positive_score").alias("scores"), F.col("near.positive_id").alias("positive_ids"))
    asked = materialize(asked, "anchors")

    def hardest(block: pa.Table, some: pa.Table) -> pa.Table:
        found = []
        if len(block) and len(some):
            columns, _, ids, labels = opened(block)
            for a, own, kind, scores in zip(matrix(some.column("vector"), d).astype(np.int64), some.column("row").to_pylist(), some.column("label").to_pylist(), some.column("scores").to_pylist()):
                windows = [window(s, least, most) for s in scores]
                got, inner = columns.scan(a, labels != kind, lambda *x: _in_windows(*x, list(set(windows)), negatives))
                for n, (first, last) in enumerate(windows):
                    inside = np.flatnonzero((inner >= first) & (inner <= last))
                    chosen = inside[_best(got[inside], inner[inside], ids, negatives)]
                    found += [(own, n, s, i) for s, i in zip(inner[chosen].tolist(), ids[got[chosen]].tolist())]
        return pa.table({name: pa.array([x[i] for x in found], pa.int64()) for i, name in enumerate(("_anchor", "place", "negative_score", "negative_id"))})

    hard = in_blocks(rows, "row", asked, "row", d, hardest, "_anchor long, place long, negative_score long, negative_id long")
    order = Window.partitionBy("_anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    known = asked.select(F.col("row").alias("_row"), F.col("vec_id").alias("anchor_id"), "positive_ids", "scores")
    at = lambda column: F.element_at(column, (F.col("place") + 1).cast("int"))
    return hard.join(known, F.col("_anchor") == F.col("_row")).select("anchor_id", at("positive_ids").alias("positive_id"), "rank", "negative_id", at("scores").alias("positive_score"), "negative_score")
