"""Partition trees from decisions, and which neighbours of their blocks are decoded before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.planes import hold

#: Units of 4 samples in a side of a superblock.
UNITS = 16
#: Parts of a side of 8, by kind of split: none, two, three (the middle one in two across), four of rising or mixed sizes, a square. Each: (rows, columns) of each part as (start, size) in eighths.
_HALVES, _QUARTERS, _RISING, _MIXED = [(0, 4), (4, 4)], [(0, 2), (2, 4), (6, 2)], [(0, 1), (1, 2), (3, 4), (7, 1)], [(0, 1), (1, 4), (5, 2), (7, 1)]
_ALL = (0, 8)
_THREE = [(_QUARTERS[0], _ALL), (_QUARTERS[1], _HALVES[0]), (_QUARTERS[1], _HALVES[1]), (_QUARTERS[2], _ALL)]
_turned = lambda parts: [(b, a) for a, b in parts]
_level = lambda sides: [(s, _ALL) for s in sides]
KINDS = [
    [], _level(_HALVES), _turned(_level(_HALVES)), _THREE, _turned(_THREE), _level(_RISING), _level(_MIXED), _turned(_level(_RISING)), _turned(_level(_MIXED)),
    [(a, b) for a in _HALVES for b in _HALVES],
]


def fits(kind: int, height: str, width: str) -> str:
    """SQL: whether every part of a block of that kind has whole units, one at least."""
    need = lambda i: max([8 // _greatest(part[i]) for part in KINDS[kind]], default=1)
    return f"({height} % {need(0)} = 0 AND {width} % {need(1)} = 0)"


def _greatest(side: tuple[int, int]) -> int:
    """The largest power of two that divides both the start and the size of a part, in eighths."""
    return next(p for p in (8, 4, 2, 1) if side[0] % p == 0 and side[1] % p == 0)


def _block(y: Column, x: Column, h: Column, w: Column) -> Column:
    return F.struct(*[v.cast("bigint").alias(n) for n, v in (("y", y), ("x", x), ("h", h), ("w", w))])


def partition_tree(superblocks: DataFrame, key: str, decisions: str, units: int = UNITS) -> DataFrame:
    """(key, ord, y, x, h, w): the blocks of each superblock in decode order, in units of 4 samples.

    decisions: an array of kinds (see KINDS) in the order in which they are read. Each is for the
    block whose turn it is; its parts come next, in order. A kind whose parts would not be whole
    units, or that is null or unknown, leaves the block whole; so do decisions that are lacking.
    """
    def step(s, kind):
        top, rest = s["waiting"][0], F.slice(s["waiting"], F.lit(2), F.size(s["waiting"]))
        eighth = lambda side, i: top[side] * i / 8
        parts = F.array().cast("array<struct<y:bigint,x:bigint,h:bigint,w:bigint>>")
        for k, split in enumerate(KINDS):
            if split:
                made = F.array(*[_block(top["y"] + eighth("h", a[0]), top["x"] + eighth("w", b[0]), eighth("h", a[1]), eighth("w", b[1])) for a, b in split])
                need = [max(8 // _greatest(p[i]) for p in split) for i in (0, 1)]
                parts = F.when((kind == k) & (top["h"] % need[0] == 0) & (top["w"] % need[1] == 0), made).otherwise(parts)
        whole = F.size(parts) == 0
        moved = F.struct(F.concat(parts, rest).alias("waiting"), F.when(whole, F.concat(s["done"], F.array(top))).otherwise(s["done"]).alias("done"))
        return F.when(F.size(s["waiting"]) > 0, moved).otherwise(s)

    one = _block(F.lit(0), F.lit(0), F.lit(units), F.lit(units))
    start = F.struct(F.array(one).alias("waiting"), F.array().cast("array<struct<y:bigint,x:bigint,h:bigint,w:bigint>>").alias("done"))
    found = hold(superblocks, _tree=F.aggregate(decisions, start, step))
    return found.select(key, F.posexplode(F.concat("_tree.done", "_tree.waiting")).alias("ord", "b")).select(key, F.col("ord").cast("bigint").alias("ord"), "b.*")


def availability(blocks: DataFrame, frame: str, order: list[str]) -> DataFrame:
    """blocks with top_right and bottom_left: how many units beside them, up to their width and height, are decoded before them.

    blocks: frame, y, x, h, w in units over the whole frame, and columns that order them by decoding.
    The units meet in a join on frame, line and column, so nothing is collected: one row for each
    unit of the frame, and one for each unit asked for. Units outside the frame are in no block, and end the run.
    """
    own = blocks.withColumn("_when", F.struct(*order))
    units = own.select(F.col(frame).alias("_f"), F.col("_when").alias("_before"), "y", "x", "h", F.posexplode(F.sequence(F.lit(0), (F.col("h") * F.col("w") - 1).cast("int"))).alias("_i", "_u"), "w")
    units = units.select("_f", "_before", (F.col("y") + F.floor(F.col("_u") / F.col("w"))).alias("_y"), (F.col("x") + F.col("_u") % F.col("w")).alias("_x"))
    run = lambda n: F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))
    right = own.select("*", F.lit("r").alias("side"), F.explode(run("w")).alias("k")).withColumns({"ask_y": F.col("y") - 1, "ask_x": F.col("x") + F.col("w") + F.col("k")})
    below = own.select("*", F.lit("b").alias("side"), F.explode(run("h")).alias("k")).withColumns({"ask_y": F.col("y") + F.col("h") + F.col("k"), "ask_x": F.col("x") - 1})
    asked = right.unionByName(below)
    met = asked.join(units, (F.col(frame) == F.col("_f")) & (F.col("ask_y") == F.col("_y")) & (F.col("ask_x") == F.col("_x")), "left")
    missing = F.when(F.coalesce(F.col("_before") < F.col("_when"), F.lit(False)), None).otherwise(F.col("k"))
    first = lambda side, size: F.coalesce(F.min(F.when(F.col("side") == side, missing)), F.first(size)).cast("bigint")
    return met.groupBy(*blocks.columns).agg(first("r", "w").alias("top_right"), first("b", "h").alias("bottom_left"))
