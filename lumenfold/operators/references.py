"""Which reference frames a frame uses: ranked by a score, nearest in time, and those that seed its models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.integer import floor_log2, shifted, shr

#: Slots of a frame, so windows over a frame's references hold as many rows at most; references that a frame names.
SLOTS, NAMED = 8, 7


def scored(refs: DataFrame) -> DataFrame:
    """refs (frame, slot, poc, qindex, layer, width, height, frame_poc, frame_layer) with `distance` and `score`: near, fine and large references score low.

    Where a frame has references after it, each step in time counts 64; else steps count less the more there are.
    """
    distance = F.col("frame_poc") - F.col("poc")
    df = refs.withColumn("distance", distance)
    later = F.max((F.col("distance") < 0).cast("int")).over(Window.partitionBy("frame")) > 0
    far = F.abs("distance") + F.col("frame_layer") - F.col("layer")
    none_later = 128 - shifted(F.lit(128), -F.greatest(F.least(far, F.lit(6)), F.lit(0))) + F.greatest(far - 6, F.lit(0))
    return df.withColumn("score", F.when(later, 64 * far).otherwise(none_later) - 32 * floor_log2(F.col("width") * F.col("height")) + F.col("qindex"))


def ranked(refs: DataFrame) -> DataFrame:
    """(frame, slot, score, rank) of the NAMED best references of each frame, from 0.

    Equal references (score, time and layer) count once. Of a full set, the one furthest in time on
    the side that has more coarse references (qindex from the middle of the range on) goes last, and
    so isn't named.
    """
    frame, order = Window.partitionBy("frame"), Window.partitionBy("frame").orderBy("score", "slot")
    again = F.row_number().over(Window.partitionBy("frame", "score", "poc", "layer").orderBy("slot"))
    df = scored(refs).withColumn("_again", again).where("_again = 1").withColumn("place", F.row_number().over(order) - 1)
    coarse = F.col("qindex") >= shr(F.max("qindex").over(frame) + F.min("qindex").over(frame) + 1, 1)
    df = df.withColumns({"_n": F.count(F.lit(1)).over(frame), "_past": F.when(coarse & (F.col("distance") > 0), F.col("distance")), "_next": F.when(coarse & (F.col("distance") < 0), -F.col("distance"))})
    df = df.withColumns({f"{c}_{f}": g(c).over(frame) for c in ("_past", "_next") for f, g in (("n", F.count), ("most", F.max))})
    place_of = lambda c: F.coalesce(F.min(F.when(F.col(c) == F.col(f"{c}_most"), F.col("place"))).over(frame), F.lit(0))
    df = df.withColumns({"_at_past": place_of("_past"), "_at_next": place_of("_next")})
    most = lambda c: F.coalesce(f"{c}_most", F.lit(0))
    more_past = (F.col("_past_n") > F.col("_next_n")) | ((F.col("_past_n") == F.col("_next_n")) & (most("_past") >= most("_next")))
    df = df.withColumn("_last", F.when(F.col("_n") == SLOTS, F.when(more_past, F.col("_at_past")).otherwise(F.col("_at_next"))))
    rank = F.when(F.col("place") == F.col("_last"), SLOTS - 1).otherwise(F.col("place") - F.when(F.col("place") > F.col("_last"), 1).otherwise(0))
    return df.select("frame", "slot", "score", rank.cast("bigint").alias("rank")).where(F.col("rank") < NAMED)


def interpolated_between(refs: DataFrame) -> DataFrame:
    """(frame, first, second): the slots that a frame is interpolated between: the nearest before it and the next one, or else the two nearest on the one side there is; null below two references."""
    in_time = F.array_sort(F.collect_list(F.struct("poc", "slot")))
    df = refs.groupBy("frame").agg(in_time.alias("order"), F.sum((F.col("poc") < F.col("frame_poc")).cast("int")).alias("past"), F.sum((F.col("poc") > F.col("frame_poc")).cast("int")).alias("future"))
    at = lambda k: F.get("order", k)["slot"]
    past, both = F.col("past"), (F.col("past") > 0) & (F.col("future") > 0)
    first = F.when(both | (past >= 2), at(past - 1)).otherwise(at(F.lit(0)))
    second = F.when(both, at(past)).when(past >= 2, at(past - 2)).otherwise(at(F.lit(1)))
    enough = F.size("order") >= 2
    return df.select("frame", F.when(enough, first).alias("first"), F.when(enough, second).alias("second"))


def model_seeds(refs: DataFrame, frame_qindex: str = "frame_qindex") -> DataFrame:
    """(frame, primary, secondary): of the references that are predicted themselves (`inter`), the two whose models seed a frame's.

    They are nearest in qindex, then in time, where twice the size counts for two steps, then the later ones.
    """
    key = F.struct(F.abs(F.col("qindex") - F.col(frame_qindex)).alias("q"), (F.abs(F.col("frame_poc") - F.col("poc")) - 2 * floor_log2(F.col("width") * F.col("height"))).alias("d"), (-F.col("poc")).alias("later"), "slot")
    best = refs.where("inter").groupBy("frame").agg(F.slice(F.array_sort(F.collect_list(key)), 1, 2).alias("best"))
    return best.select("frame", F.get("best", F.lit(0))["slot"].alias("primary"), F.get("best", F.lit(1))["slot"].alias("secondary"))
