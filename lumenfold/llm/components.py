"""Connected components of an edge table by alternating stars, in joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rounds after which something must be wrong: alternating stars need about log2 of the longest path.
MOST_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """(u, least): the smaller of u and its least neighbour."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over directed edges (u, v): neighbours of u on one side are linked to the least of its neighbourhood.

    larger: the neighbours above u move; else those below u, and u itself.
    """
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).withColumnRenamed("u", "_u")
        moved = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        least = _least(edges).withColumnRenamed("u", "_u")
        below = edges.join(least, F.col("u") == F.col("_u"))
        moved = below.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(below.select("u", F.col("least").alias("v")))
    return moved.where("u <> v").distinct()


def _summary(edges: DataFrame) -> tuple:
    """How many distinct edges there are, and two sums of hashes of them: equal, but for a chance of 2**-128, for equal tables only."""
    sums = [F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(20,0)")) for seed in (1, 2)]
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge: edges has two columns of one orderable type.

    component is the least node that can be reached. Self loops, repeated edges and nulls are
    ignored. A node with very many neighbours is only ever a key of a grouped minimum or of a join
    that adaptive execution splits; no group is collected. Every round is written to the shared folder.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").distinct()
    now = materialize(now, "edges")
    known = _summary(now)
    for _ in range(MOST_ROUNDS):
        new = materialize(_star(_star(now, larger=True), larger=False), "edges")
        before, known = known, _summary(new)
        if known == before:
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        now = new
    raise RuntimeError("components did not settle")
