"""What a container's tables say together: images, alpha, orientation, crop and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.isobmff import describe, integer, probe
from ..sources.planes import hold

#: Names of auxiliary images that are alpha planes.
ALPHA = ("urn:mpeg:mpegB:cicp:systems:auxiliary:alpha", "urn:mpeg:hevc:2015:auxid:1")


def described(files: DataFrame, *wanted: str, most_bytes: int = 1 << 28) -> DataFrame:
    """`describe`, of the wanted lists, of the files that the probe lets through."""
    return describe(files.where(probe(F.col("content"))), wanted, most_bytes)


def properties_of(item: Column) -> Column:
    """The properties (fourcc, raw) of an item in the order of association; indices without a property are skipped."""
    own = F.filter("associations", lambda a: (a["item_id"] == item) & (a["idx"] >= 1) & (a["idx"] <= F.size("properties")))
    return F.transform(own, lambda a: F.get("properties", a["idx"].cast("int") - 1))


def last_of(properties_: Column, *fourccs: str) -> Column:
    """The payload of the property of a type that is associated last; null if there is none."""
    return F.try_element_at(F.filter(properties_, lambda p: p["fourcc"].isin(*fourccs)), F.lit(-1))["raw"]


def item_properties(found: DataFrame) -> DataFrame:
    """(path, item_id, ord, fourcc, raw): each item's properties in the order of association; indices without a property are skipped."""
    each = found.select("path", "properties", F.inline("associations")).where((F.col("idx") >= 1) & (F.col("idx") <= F.size("properties")))
    return each.select("path", "item_id", "ord", F.get("properties", F.col("idx").cast("int") - 1).alias("p")).select("path", "item_id", "ord", "p.*")


def orientation(steps: Column, axis: Column) -> Column:
    """The name of a rotation by steps of 90 degrees anticlockwise and a mirror (null: none); pairs that have no name are Normal."""
    named = {(2, None): "Rotate180", (3, None): "Rotate90", (1, None): "Rotate270", (0, 0): "FlipH", (0, 1): "FlipV", (3, 0): "Transpose", (1, 0): "Transverse"}
    out = F.lit("Normal")
    for (s, a), name in named.items():
        out = F.when((steps == s) & (axis.isNull() if a is None else F.coalesce(axis == a, F.lit(False))), name).otherwise(out)
    return out


def orientation_of(properties_: Column) -> Column:
    """Rotation and mirror boxes applied in order, each to what the one before left.

    Each step goes by the name so far, so a mirror that met an unnamed pair is forgotten. An item has
    a bounded number of associations, and their fold is an array aggregate.
    """
    steps_of = lambda name: F.when(name == "Rotate180", 2).when(name.isin("Rotate90", "Transpose"), 3).when(name.isin("Rotate270", "Transverse"), 1).otherwise(0)
    axis_of = lambda name: F.when(name.isin("FlipH", "Transpose", "Transverse"), 0).when(name == "FlipV", 1)
    byte = lambda p: F.coalesce(integer(p["raw"], 0, 1), F.lit(0))
    step = lambda name, p: F.when(p["fourcc"] == "irot", orientation(byte(p) % 4, axis_of(name))).otherwise(orientation(steps_of(name), byte(p) % 2))
    return F.aggregate(F.filter(properties_, lambda p: p["fourcc"].isin("irot", "imir")), F.lit("Normal"), step)


def alpha_of(item: Column) -> Column:
    """The item of the last auxiliary reference to `item` that says it is alpha; null if there is none."""
    def names_alpha(r):
        raw = last_of(properties_of(r["from_id"]), "auxC")
        return F.regexp_replace(F.substring(raw, F.lit(5), F.length(raw)).cast("string"), "\x00.*$", "").isin(*ALPHA)

    return F.try_element_at(F.filter("references", lambda r: (r["ref_type"] == "auxl") & (r["to_id"] == item) & names_alpha(r)), F.lit(-1))["from_id"]


def images(files: DataFrame, most_bytes: int = 1 << 28) -> DataFrame:
    """One row per readable file, of its primary item: path, width, height, item_type, layout, bit_depth, colour (primaries, transfer, matrix, full_range),
    icc, orientation, h_spacing, v_spacing, has_alpha, premultiplied, crop (x, y, w, h), max_level, avg_level, errors.

    All of it comes from the file's own row, so nothing is shuffled. What a file doesn't say is null;
    of properties of a type the last associated counts; a property that is too short is null.
    """
    df = hold(described(files, "items", "properties", "associations", "references", "levels", most_bytes=most_bytes), p=properties_of(F.col("primary_id")), alpha_id=alpha_of(F.col("primary_id")))
    raw = {x: last_of(F.col("p"), x) for x in ("ispe", "pasp", "clap")}
    by_type = lambda *kinds: F.try_element_at(F.filter("p", lambda q: (q["fourcc"] == "colr") & F.substring(q["raw"], 1, 4).cast("string").isin(*kinds)), F.lit(-1))["raw"]
    df = hold(df, config=last_of(F.col("p"), "av1C", "av2C"), nclx=by_type("nclx"), profile=by_type("rICC", "prof"), **raw)
    at = lambda name, place, n=4: integer(F.col(name), place, n)
    # the numbers once for each row: what follows names them many times
    numbers = {"w": at("ispe", 4), "h": at("ispe", 8), "hs": at("pasp", 0), "vs": at("pasp", 4), "flags": at("config", 2, 1)} | {f"c{k}": at("clap", 4 * k) for k in range(8)}
    df = hold(df, **numbers)
    bit = lambda n: F.shiftright("flags", n).bitwiseAND(F.lit(1)) == 1
    both = lambda one, a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.col(one))
    signed = lambda k: F.col(f"c{k}") - F.when(F.col(f"c{k}") >= 1 << 31, 1 << 32).otherwise(0)
    df = hold(df, width=both("w", "w", "h"), height=both("h", "w", "h"), clap_=F.array(*[signed(k) for k in range(8)]))
    colour = F.when(F.length("nclx") >= 11, F.struct(integer(F.col("nclx"), 4, 2).alias("primaries"), integer(F.col("nclx"), 6, 2).alias("transfer"), integer(F.col("nclx"), 8, 2).alias("matrix"), (integer(F.col("nclx"), 10, 1) >= 128).alias("full_range")))
    own = lambda items_, field: F.try_element_at(F.filter(items_, lambda i: i["item_id"] == F.col("primary_id")), F.lit(1))[field]
    multiplied = F.exists("references", lambda r: (r["ref_type"] == "prem") & (r["from_id"] == F.col("primary_id")) & (r["to_id"] == F.col("alpha_id")))
    df = hold(df, rect=crop(F.col("width").cast("double"), F.col("height").cast("double"), *[F.col("clap_")[k] for k in range(8)]), turned=orientation_of(F.col("p")))
    return df.select(
        "path", "width", "height", own("items", "item_type").alias("item_type"),
        F.when(F.length("config") >= 4, F.when(bit(4), "I400").when(bit(3) & bit(2), "I420").when(bit(3), "I422").otherwise("I444")).alias("layout"),
        F.when(F.length("config") >= 4, F.when(bit(5), 12).when(bit(6), 10).otherwise(8)).cast("int").alias("bit_depth"),
        colour.alias("colour"), F.substring("profile", F.lit(5), F.length("profile")).alias("icc"),
        F.col("turned").alias("orientation"), both("hs", "hs", "vs").alias("h_spacing"), both("vs", "hs", "vs").alias("v_spacing"),
        F.col("alpha_id").isNotNull().alias("has_alpha"), F.coalesce(multiplied, F.lit(False)).alias("premultiplied"),
        F.col("rect").alias("crop"),
        own("levels", "max_level").alias("max_level"), own("levels", "avg_level").alias("avg_level"), "errors",
    )


def payloads(files: DataFrame, most_bytes: int = 1 << 28) -> DataFrame:
    """(path, item_id, payload): the units of each item's codec configuration and its extents, in order, out of the file; null if one ends beyond it, or if there are more than most_bytes."""
    return described(files, "payloads", most_bytes=most_bytes).select("path", F.inline("payloads"))


def crop(width: Column, height: Column, wn: Column, wd: Column, hn: Column, hd: Column, xn: Column, xd: Column, yn: Column, yd: Column) -> Column:
    """(x, y, w, h) of the clean aperture around the middle of an image, halves away from zero; null if it isn't inside."""
    cw, ch, xo, yo = (F.when(d != 0, n.cast("double") / d) for n, d in ((wn, wd), (hn, hd), (xn, xd), (yn, yd)))
    x = F.round((width - 1) / 2 + xo - (cw - 1) / 2).cast("bigint")
    y = F.round((height - 1) / 2 + yo - (ch - 1) / 2).cast("bigint")
    w, h = F.round(cw).cast("bigint"), F.round(ch).cast("bigint")
    good = (cw > 0) & (ch > 0) & (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= width) & (y + h <= height)
    return F.when(good, F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))
