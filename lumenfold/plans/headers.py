"""Queries over headers with conditional fields: bytes written from tables, read back by layout, each compared with SQL over the same tables.

What is written is a list of (kind, size, value, condition), with values and conditions in SQL that
both engines read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bitcodes
from ..operators import headers
from ..sources.planes import hold, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def coded(kind: str, n, value: str, when: str = "true") -> Column:
    """One field as a string of bits; empty where the condition doesn't hold."""
    v = F.expr(f"CAST({value} AS BIGINT)")
    bits = {
        "bits": lambda: bitcodes.bits(v, F.lit(n)), "signed": lambda: bitcodes.bits(F.pmod(v, F.lit(1 << n if isinstance(n, int) else 0)), F.lit(n)), "zeros": lambda: bitcodes.exp_golomb(v),
        "rice": lambda: bitcodes.golomb_rice(v, n), "below": lambda: bitcodes.quasi_uniform(v, F.expr(f"CAST({n} AS BIGINT)")),
    }[kind]()
    return F.when(F.expr(when), bits).otherwise(F.lit(""))


def with_payload(rows: DataFrame, bits: Column) -> DataFrame:
    """rows with `payload`, the bytes of a string of bits, which is put together once for each row."""
    return hold(hold(rows, _bits=bits), payload=headers.bytes_of(F.col("_bits")))


def _written(spark, sf_dir, table: str, columns: list[str], given: str, fields: list[tuple]):
    """A table's key columns with the header that its rows write; given: values named k and more, in SQL over the table."""
    rows = read(spark, sf_dir, table).selectExpr(*columns, *given)
    parts = range(0, len(fields), 40)  # one expression for all fields would be more than a method of generated code may hold
    for n in parts:
        rows = hold(rows, **{f"_part{n}": F.concat(*[coded(*f) for f in fields[n : n + 40]])})
    return with_payload(rows, F.concat(*[F.col(f"_part{n}") for n in parts])).select(*columns, "payload")


# segments

_SEGMENT = [("changed", "(k >> {i}) % 2"), ("difference", "(k * {j}) % 1024 - 512"), ("skip", "(c + {i}) % 2"), ("global_motion", "CASE WHEN (c + {i}) % 3 = 0 THEN 1 ELSE 0 END")]
_AT = [{name: v.format(i=i, j=7 + i) for name, v in _SEGMENT} for i in range(16)]
_SEGMENT_FIELDS = [("bits", 1, "k % 2")] + [f for i in range(16) for f in [(kind, n, _AT[i][name], f"(k % 2 = 1 OR {i} < 8)" + (f" AND {_AT[i]['changed']} = 1" if name == "difference" else "")) for name, kind, n in (("changed", "bits", 1), ("difference", "signed", 10), ("skip", "bits", 1), ("global_motion", "bits", 1))]]
_SEGMENT_SQL = " UNION ALL ".join(f"SELECT k, {i} AS segment, CASE WHEN {a['changed']} = 1 THEN greatest(-351, least(351, {a['difference']})) END AS delta, {a['skip']} AS skip, {a['global_motion']} AS global_motion FROM t WHERE k % 2 = 1 OR {i} < 8" for i, a in enumerate(_AT))


@query(f"WITH t AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders) SELECT k AS o_orderkey, segment, CAST(delta AS BIGINT) AS delta, CAST(skip AS BIGINT) AS skip, CAST(global_motion AS BIGINT) AS global_motion FROM ({_SEGMENT_SQL})")
def segment_headers(spark, sf_dir):
    """Segmentation parameters: 8 or 16 segments, each with a quantiser difference, if a bit says so, and two flags."""
    rows = _written(spark, sf_dir, "orders", ["o_orderkey"], ["o_orderkey AS k", "o_custkey AS c"], _SEGMENT_FIELDS)
    layout = [headers.Field("more"), headers.Let("_segments", lambda v: 8 << v["more"]), headers.SEGMENTS]
    found = headers.read_header(rows, "payload", layout).where("NOT error").select("o_orderkey", F.posexplode("segments").alias("segment", "s"))
    return found.select("o_orderkey", "segment", "s.delta", "s.skip", "s.global_motion")


# content interpretation

_ASPECT = "CASE WHEN k % 9 = 0 THEN 255 ELSE k % 20 END"
_CONTENT_FIELDS = [
    ("bits", 2, "k % 4"), *[("bits", 1, f"(k >> {i + 1}) % 2") for i in range(5)], ("bits", 1, "0"), ("rice", 2, "k % 7", "(k >> 1) % 2 = 1"),
    *[("bits", 8, f"(k * {m}) % 20", "(k >> 1) % 2 = 1 AND k % 7 = 0") for m in (3, 5, 11)], ("bits", 1, "k % 3 % 2", "(k >> 1) % 2 = 1"),
    ("zeros", 0, "k % 6", "(k >> 2) % 2 = 1"), ("zeros", 0, "k % 5", "(k >> 2) % 2 = 1 AND k % 4 <> 1"), ("bits", 8, _ASPECT, "(k >> 3) % 2 = 1"), *[("zeros", 0, f"1 + k % {m}", "(k >> 3) % 2 = 1 AND k % 9 = 0") for m in (300, 77)],
    ("bits", 32, "k % 13 * 65537", "(k >> 4) % 2 = 1"), ("bits", 32, "k * 257", "(k >> 4) % 2 = 1"), ("bits", 1, "(k >> 3) % 2", "(k >> 4) % 2 = 1"), ("zeros", 0, "k % 1000", "(k >> 4) % 2 = 1 AND (k >> 3) % 2 = 1"),
]
_BAD = "(k >> 4) % 2 = 1 AND (k % 13 = 0 OR k = 0)"
_by = lambda code, table, i: "CASE " + code + "".join(f" WHEN {n + 1} THEN {row[i]}" for n, row in enumerate(table)) + f" ELSE {2 if table is headers.DESCRIBED else 0} END"
_CONTENT_OUT = {
    "scan": "k % 4", **{name: f"CASE WHEN (k >> 1) % 2 = 1 THEN CASE WHEN k % 7 = 0 THEN (k * {m}) % 20 ELSE {_by('k % 7', headers.DESCRIBED, i)} END END" for i, (name, m) in enumerate((("primaries", 3), ("transfer", 5), ("matrix", 11)))},
    "full_range": "CASE WHEN (k >> 1) % 2 = 1 THEN k % 3 % 2 END", "chroma_first": "CASE WHEN (k >> 2) % 2 = 1 THEN k % 6 END", "chroma_second": "CASE WHEN (k >> 2) % 2 = 1 THEN CASE WHEN k % 4 = 1 THEN k % 6 ELSE k % 5 END END",
    **{name: f"CASE WHEN (k >> 3) % 2 = 1 THEN CASE WHEN k % 9 = 0 THEN 1 + k % {m} ELSE {_by('k % 20', headers.ASPECTS, i)} END END" for i, (name, m) in enumerate((("sample_width", 300), ("sample_height", 77)))},
    "tick": "CASE WHEN (k >> 4) % 2 = 1 THEN k % 13 * 65537 END", "time_scale": "CASE WHEN (k >> 4) % 2 = 1 THEN k * 257 END", "ticks": f"CASE WHEN (k >> 4) % 2 = 1 AND (k >> 3) % 2 = 1 AND NOT ({_BAD}) THEN 1 + k % 1000 END",
}


@query(f"WITH t AS (SELECT p_partkey AS k FROM part) SELECT k AS p_partkey, {', '.join(f'CAST({v} AS BIGINT) AS {n}' for n, v in _CONTENT_OUT.items())}, {_BAD} AS error FROM t")
def content_interpretations(spark, sf_dir):
    """How pictures are to be shown: described or explicit colours, chroma places, sample aspects by code or explicit, timing; a time of 0 is an error."""
    rows = _written(spark, sf_dir, "part", ["p_partkey"], ["p_partkey AS k"], _CONTENT_FIELDS)
    return headers.read_header(rows, "payload", headers.CONTENT).select("p_partkey", *_CONTENT_OUT, "error")


# film grain

_COUNT = {"y": "k % 5", "u": "CASE WHEN k % 4 = 0 THEN 0 ELSE k % 3 END", "v": "CASE WHEN k % 4 = 0 THEN 0 ELSE k % 6 % 4 END"}
_USED = {"y": "k % 5 > 0", **{p: f"(k % 4 = 0 OR {_COUNT[p]} > 0)" for p in "uv"}}
_WEIGHTS = {p: f"2 * (k % 3) * (k % 3 + 1){' + CASE WHEN k % 5 > 0 THEN 1 ELSE 0 END' if p != 'y' else ''}" for p in "yuv"}
_point = lambda p, i: f"(k * {3 + i + ord(p) % 7}) % 32"
_scale = lambda p, i: f"(k + {i * 5 + ord(p)}) % 64"
_weight = lambda p, i: f"(k * {i + 2} + {ord(p)}) % 64"
_GRAIN_FIELDS = [
    ("bits", 1, "CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END"),
    *[f for p in "yuv" for f in [("bits", 4, _COUNT[p], "true" if p == "y" else "k % 4 <> 0"), ("bits", 3, "4", f"{_COUNT[p]} > 0"), ("bits", 2, "1", f"{_COUNT[p]} > 0"), *[x for i in range(4) for x in [("bits", 5, _point(p, i), f"{_COUNT[p]} > {i}"), ("bits", 6, _scale(p, i), f"{_COUNT[p]} > {i}")]]]],
    ("bits", 2, "k % 4"), ("bits", 2, "k % 3"), *[f for p in "yuv" for f in [("bits", 2, "1", _USED[p]), *[("bits", 6, _weight(p, i), f"{_USED[p]} AND {_WEIGHTS[p]} > {i}") for i in range(13)]]],
    ("bits", 2, "k % 4"), ("bits", 2, "(k >> 2) % 4"), *[("bits", n, f"(k * {m}) % {1 << n}", f"{_COUNT[p]} > 0") for p in "uv" for n, m in ((8, 3), (8, 5), (9, 7))], ("bits", 1, "(k >> 1) % 2"), ("bits", 1, "(k >> 2) % 2"), ("bits", 1, "(k >> 3) % 2", "(k >> 2) % 2 = 1"), ("bits", 1, "(k >> 4) % 2"),
]
_texts = lambda count, parts: " || ".join(f"CASE WHEN {count} > {i} THEN ' ' || {x} ELSE '' END" for i, x in enumerate(parts))
_GRAIN_TEXT = {
    **{f"{p}_points": _texts(_COUNT[p], [" || ':' || ".join((f"CAST({' + '.join(_point(p, j) for j in range(i + 1))} AS VARCHAR)", f"CAST({_scale(p, i)} AS VARCHAR)")) for i in range(4)]) for p in "yuv"},
    **{f"{p}_weights": f"CASE WHEN {_USED[p]} THEN {_texts(_WEIGHTS[p], [f'CAST({_weight(p, i)} - 32 AS VARCHAR)' for i in range(13)])} ELSE '' END" for p in "yuv"},
}
_GRAIN_OUT = {
    "from_luma": "CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END", "scaling_shift": "k % 4 + 8", "lag": "k % 3", "weight_shift": "k % 4 + 6", "grain_shift": "(k >> 2) % 4",
    **{f"{p}_{x}": f"CASE WHEN {_COUNT[p]} > 0 THEN (k * {m}) % {1 << n} - {1 << n - 1} END" for p in "uv" for x, n, m in (("mult", 8, 3), ("luma_mult", 8, 5), ("offset", 9, 7))},
    "overlap": "(k >> 1) % 2", "clip": "(k >> 2) % 2", "identity": "CASE WHEN (k >> 2) % 2 = 1 THEN (k >> 3) % 2 END", "large_blocks": "(k >> 4) % 2",
}


@query(f"WITH t AS (SELECT c_custkey AS k FROM customer) SELECT k AS c_custkey, {', '.join(f'CAST({v} AS BIGINT) AS {n}' for n, v in _GRAIN_OUT.items())}, {', '.join(f'{v} AS {n}' for n, v in _GRAIN_TEXT.items())} FROM t")
def film_grain_headers(spark, sf_dir):
    """Film-grain parameters: scaling points whose places add up, regression weights by lag and planes, factors of chroma."""
    rows = _written(spark, sf_dir, "customer", ["c_custkey"], ["c_custkey AS k"], _GRAIN_FIELDS)
    found = headers.read_header(rows, "payload", headers.grain(2)).where("NOT error")
    text = lambda name, one: F.array_join(F.transform(name, lambda x: F.concat(F.lit(" "), one(x))), "").alias(name)
    points = [text(f"{p}_points", lambda x: F.concat_ws(":", x["place"].cast("string"), x["scale"].cast("string"))) for p in "yuv"]
    return found.select("c_custkey", *_GRAIN_OUT, *points, *[text(f"{p}_weights", lambda x: x["weight"].cast("string")) for p in "yuv"])


# tiles one by one

_FRAME = "64 + (k * 37) % 4000 AS width, 64 + (k * 53) % 2200 AS height, k % 2 AS sb128, CASE WHEN k % 3 = 0 THEN 31 ELSE k % 20 END AS level, (k >> 1) % 2 AS tier"
_doublings = lambda size, target: f"(length(bin(2 * (({target} + {size} - 1) // {size}) - 1)) - 1)"
_TILES = f"""WITH RECURSIVE t AS (SELECT p_partkey AS k FROM part), f AS (SELECT k, {_FRAME} FROM t),
s AS (SELECT *, (width + (64 << sb128) - 1) >> (6 + sb128) AS across, (height + (64 << sb128) - 1) >> (6 + sb128) AS down, CASE WHEN level >= 14 THEN 1 ELSE 0 END AS h, CASE WHEN level >= 18 THEN 1 ELSE 0 END AS hh FROM f),
m AS (SELECT *, CASE WHEN level = 31 THEN across ELSE 4096 >> (6 + sb128 - hh - h * tier) END AS widest, CASE WHEN level = 31 THEN across * down ELSE (4096 * 2304) >> (12 + 2 * sb128 - h - hh - h * tier) END AS largest FROM s),
n AS (SELECT k, across, down, widest, greatest({_doublings('largest', '(across * down)')}, {_doublings('widest', 'across')}) AS tiles FROM m),
c(k, i, place, size) AS (SELECT k, 0, CAST(0 AS BIGINT), least(1 + (k * 3) % 5, across, widest) FROM n UNION ALL SELECT c.k, i + 1, place + size, least(1 + (c.k * (i + 4)) % 5, across - place - size, widest) FROM c JOIN n ON n.k = c.k AND place + size < across),
d AS (SELECT n.k, any_value(down) AS down, greatest(any_value(CASE WHEN tiles > 0 THEN (across * down) >> (tiles + 1) ELSE across * down END) // max(size), 1) AS tallest FROM c JOIN n ON n.k = c.k GROUP BY n.k),
r(k, i, place, size) AS (SELECT k, 0, CAST(0 AS BIGINT), least(1 + (k * 5) % 7, down, tallest) FROM d UNION ALL SELECT r.k, i + 1, place + size, least(1 + (r.k * (i + 6)) % 7, down - place - size, tallest) FROM r JOIN d ON d.k = r.k AND place + size < down)
SELECT k AS p_partkey, 'columns' AS side, CAST(i AS BIGINT) AS tile, CAST(place AS BIGINT) AS start, CAST(size AS BIGINT) AS length FROM c UNION ALL SELECT k, 'rows', i, place, size FROM r"""


@query(_TILES)
def explicit_tiles(spark, sf_dir):
    """Tiles of a frame whose sizes are written one by one, each in a code that depends on what the ones before left; rows no taller than the widest column lets them be."""
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey AS k").selectExpr("*", *_FRAME.split(", "))
    rows = hold(rows, across=F.expr("(width + shiftleft(64, int(sb128)) - 1) div shiftleft(64, int(sb128))"), down=F.expr("(height + shiftleft(64, int(sb128)) - 1) div shiftleft(64, int(sb128))"))
    limits = {"widest": "CASE WHEN level = 31 THEN across ELSE shiftright(4096, int(6 + sb128 - int(level >= 18) - int(level >= 14) * tier)) END", "largest": "CASE WHEN level = 31 THEN across * down ELSE shiftright(4096 * 2304, int(12 + 2 * sb128 - int(level >= 14) - int(level >= 18) - int(level >= 14) * tier)) END"}
    rows = hold(rows, **{n: F.expr(x).cast("bigint") for n, x in limits.items()})
    log2 = lambda size, target: F.length(F.bin(2 * F.call_function("div", F.col(target) + F.col(size) - 1, F.col(size)) - 1)) - 1
    rows = hold(rows.withColumn("area", F.col("across") * F.col("down")), tiles=F.greatest(log2("largest", "area"), log2("widest", "across")))

    def sizes(of: str, most: str, first: int, step: int, wide: int):
        """(bits, longest) of one side's sizes, in a fold."""
        def one(s, i):
            left = F.least(F.col(of) - s["at"], F.col(most))
            size = F.least(1 + (F.col("k") * (i + first)) % wide, left)
            bits = F.when(left > 1, bitcodes.quasi_uniform(size - 1, F.greatest(left, F.lit(2)))).otherwise(F.lit(""))
            go = s["at"] < F.col(of)
            return F.struct(F.when(go, s["at"] + size).otherwise(s["at"]).cast("bigint").alias("at"), F.when(go, F.concat(s["bits"], bits)).otherwise(s["bits"]).alias("bits"), F.when(go, F.greatest(s["longest"], size)).otherwise(s["longest"]).cast("bigint").alias("longest"))

        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("bits"), F.lit(1).cast("bigint").alias("longest"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), start, one)

    rows = hold(rows, columns_=sizes("across", "widest", 3, 1, 5))
    rows = hold(rows, tallest=F.greatest(F.call_function("div", F.when(F.col("tiles") > 0, F.expr("shiftright(area, int(tiles + 1))")).otherwise(F.col("area")), F.col("columns_.longest")), F.lit(1)))
    rows = hold(rows, rows_=sizes("down", "tallest", 5, 1, 7))
    head = [coded(*x) for x in (("bits", 13, "width"), ("bits", 13, "height"), ("bits", 1, "sb128"), ("bits", 5, "level"), ("bits", 1, "tier"), ("bits", 1, "0"))]
    written = with_payload(rows, F.concat(*head, F.col("columns_.bits"), F.col("rows_.bits"))).select("p_partkey", "payload")
    layout = [headers.Field("width", 13), headers.Field("height", 13), headers.Field("sb128"), headers.Field("level", 5), headers.Field("tier"), *headers.tile_layout()]
    found = headers.read_header(written, "payload", layout).where("NOT error")
    side = lambda name: found.select("p_partkey", F.lit(name).alias("side"), F.posexplode(name).alias("tile", "t")).select("p_partkey", "side", F.col("tile").cast("bigint").alias("tile"), "t.start", "t.length")
    return side("columns").unionByName(side("rows"))


# sequence headers

_R, _F = "k % 5 = 0", "k % 5 <> 0"  # short headers and whole ones
_LAYOUT, _C = "k % 4", "k % 4 <> 1"
_MODES, _TIP = "(k * 3) % 16", "CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN 1 ELSE 2 END"
_REFS = "CASE WHEN k % 2 = 1 THEN k % 8 + 1 ELSE 8 END"
_bit = lambda shift: f"(k >> {shift}) % 2"
_flag = lambda shift, when="true": ("bits", 1, _bit(shift), when)
_one = lambda test, when="true": ("bits", 1, f"CASE WHEN {test} THEN 1 ELSE 0 END", when)
_SEQUENCE_FIELDS = [
    ("zeros", 0, "k % 7"), ("bits", 5, "k % 9"), _one(_R), ("bits", 5, "k % 22"), ("bits", 1, _bit(1), f"k % 22 >= 4 AND {_F}"), ("zeros", 0, _LAYOUT), ("zeros", 0, "k % 3"),
    ("bits", 3, "k % 8", _F), ("bits", 1, _bit(2), _F), ("bits", 2, "k % 4", _F), ("bits", 3, "k % 3", _F), ("bits", 1, "k % 2", f"{_F} AND k % 3 = 1"), ("bits", 2, "k % 2", f"{_F} AND k % 3 = 2"), ("bits", 1, _bit(3), _F),
    ("bits", 4, "12"), ("bits", 4, "11"), ("bits", 13, "(k * 37) % 3000 + 63"), ("bits", 12, "(k * 53) % 2000 + 63"), _flag(2), *[("zeros", 0, f"(k + {i}) % 9", f"{_bit(2)} = 1") for i in range(4)],
    ("bits", 1, _bit(4), _F), ("bits", 4, "k % 16", f"{_F} AND {_bit(4)} = 1"), ("bits", 1, _bit(3), _F), ("bits", 32, "k * 1001", f"{_F} AND {_bit(3)} = 1"), ("bits", 1, _bit(5), f"{_F} AND {_bit(3)} = 1"), *[("zeros", 0, f"k % {m}", f"{_F} AND {_bit(3)} = 1 AND {_bit(5)} = 1") for m in (50, 60)], ("bits", 1, _bit(6), f"{_F} AND {_bit(3)} = 1 AND {_bit(5)} = 1"),
    ("bits", 1, _bit(1), f"{_F} AND k % 3 > 0"), *[("bits", m + 1, f"(k + {m}) % {2 << m}", f"{_F} AND k % 3 >= {m} AND {_bit(1)} = 1") for m in (1, 2)],
    ("bits", 1, _bit(2), f"{_F} AND k % 4 > 0"), ("bits", 1, _bit(3), f"{_F} AND k % 4 > 0 AND {_bit(2)} = 1 AND k % 3 > 0"), *[("bits", t + 1, f"(k * {m + 2} + {t}) % {2 << t}", f"{_F} AND {_bit(2)} = 1 AND k % 4 >= {t} AND ({m} = 0 OR {_bit(3)} = 1 AND k % 3 >= {m})") for m in range(3) for t in (1, 2, 3)],
    _one("k % 3 = 2"), _one("k % 3 = 1", "k % 3 <> 2"), _flag(1, _C), _flag(2, f"{_C} AND {_bit(1)} = 1 AND {_F}"), _flag(3), _flag(4, f"{_bit(3)} = 1"), _flag(2), _flag(5, f"{_bit(2)} = 1"),
    _flag(1), _flag(3), _flag(4, f"{_bit(3)} = 1"), *[f for i in range(16) for f in [(kind, n, f"(k + {i}) % {m}" + (" - 600" if name == "difference" else ""), f"{_bit(3)} = 1 AND ({i} < 8 OR {_bit(1)} = 1)" + (f" AND (k + {i}) % 2 = 1" if name == "difference" else "")) for name, kind, n, m in (("changed", "bits", 1, 2), ("difference", "signed", 11 - 1, 512), ("skip", "bits", 1, 2), ("global", "bits", 1, 2))]],
    *[_flag(i) for i in (1, 2, 3, 4)], ("bits", 2, "k % 4", _C), _flag(5), _flag(6),
    ("bits", 4, _MODES, _F), _flag(2, f"{_F} AND {_MODES} <> 0"), _flag(3, f"{_F} AND ({_MODES} >> 1) % 2 = 1"), _flag(4, _F), _flag(5, _F), _flag(6, f"{_F} AND {_bit(5)} = 1"), ("bits", 4, "k % 16", _F),
    _flag(1), _flag(2), _flag(3, f"{_bit(2)} = 0"), _flag(3, _F), ("bits", 1, "k % 2", _F), ("bits", 4, "k % 8", f"{_F} AND k % 2 = 1"), ("bits", 3, "k % 8", _F), ("below", "5", "k % 5", _F), _flag(2, _F), ("below", "3", "k % 3"), _flag(1), ("bits", 2, "(k >> 2) % 4", _F),
    _one(f"{_TIP} > 0", _F), _one(f"{_TIP} = 2", f"{_F} AND {_TIP} > 0"), _flag(3, f"{_F} AND {_TIP} > 0"), _flag(4, _F), _flag(5), *[_flag(i, _F) for i in (1, 2, 3)], _flag(4, f"{_F} AND {_TIP} = 1 AND {_bit(3)} = 1"), ("bits", 2, "k % 3", _F), _flag(4, _F), _flag(5, f"{_F} AND {_TIP} > 0 AND (k % 3 > 0 OR {_bit(4)} = 1)"), *[_flag(i, _F) for i in (1, 2, 3, 4, 5, 6)],
    _one("k % 3 = 0", _F), _one("k % 3 = 1", f"{_F} AND k % 3 <> 0"), _one("k % 4 = 0", f"{_F} AND k % 3 <> 2"), _one("k % 4 = 1", f"{_F} AND k % 3 <> 2 AND k % 4 <> 0"),
    _flag(1), _flag(2, f"{_bit(1)} = 0"), _flag(3), _flag(4), _flag(5, _C), _flag(6, _F), _flag(1), _flag(2, _C), _flag(3), _flag(4, f"{_F} AND {_bit(3)} = 1"), _flag(5, f"NOT ({_bit(3)} = 1 AND ({_R} OR {_bit(4)} = 0))"), _flag(1, _F), _flag(2, f"{_F} AND {_bit(1)} = 1"),
    _flag(1, _C), _flag(2), ("bits", 5, "k % 32", f"{_bit(2)} = 0"), _flag(3, f"{_bit(2)} = 0"), ("bits", 5, "(k * 3) % 32", f"{_C} AND {_bit(2)} = 0"), _flag(4, f"{_C} AND {_bit(2)} = 0"), ("bits", 5, "(k * 5) % 32", _C), _flag(5, _C),
    _flag(1), _flag(2), _flag(3), _flag(4, f"{_bit(3)} = 1 AND k % 3 = 0"), _flag(4), *[_flag(i, f"{_bit(4)} = 1") for i in (1, 2, 3)], _flag(5, f"{_bit(4)} = 1 AND {_bit(3)} = 1"), _flag(2), _flag(3, f"{_bit(2)} = 1"), _one("k % 4 = 0", _F), _one("k % 4 = 1", f"{_F} AND k % 4 <> 0"), ("bits", 2, "k % 4"),
    ("bits", 1, "0"), _flag(6),
]
_SEQUENCE_OUT = {
    "id": "k % 7", "profile": "k % 9", "reduced": f"CASE WHEN {_R} THEN 1 ELSE 0 END", "level": "k % 22", "tier": f"CASE WHEN k % 22 >= 4 AND {_F} THEN {_bit(1)} END", "layout": _LAYOUT, "bit_depth": "CASE WHEN k % 3 = 2 THEN 12 WHEN k % 3 = 0 THEN 10 ELSE 8 END",
    "temporal_layers": f"CASE WHEN {_F} THEN k % 4 END", "layer_count": f"CASE WHEN {_F} AND k % 3 > 0 THEN k % 2 + 1 ELSE 1 END", "width": "(k * 37) % 3000 + 64", "height": "(k * 53) % 2000 + 64", "crop_right": f"CASE WHEN {_bit(2)} = 1 THEN (k + 1) % 9 END",
    "decoding_tick": f"CASE WHEN {_F} AND {_bit(3)} = 1 THEN k * 1001 END", "encoder_delay": f"CASE WHEN {_F} AND {_bit(3)} = 1 AND {_bit(5)} = 1 THEN k % 60 END", "sb128": "k % 3", "aspect_log2": f"CASE WHEN {_bit(2)} = 1 THEN 1 + {_bit(5)} ELSE 3 END", "split_chroma": f"CASE WHEN {_C} THEN {_bit(1)} END",
    "cfl_filter": f"CASE WHEN {_C} THEN k % 4 % 3 END", "motion_modes": f"1 + CASE WHEN {_F} THEN " + " + ".join(f"{2 << i} * (({_MODES} >> {3 - i}) % 2)" for i in range(4)) + " ELSE 0 END", "six_parameters": f"CASE WHEN {_F} AND ({_MODES} >> 1) % 2 = 1 THEN {_bit(3)} END", "hint_bits": f"CASE WHEN {_F} THEN k % 16 + 1 END",
    "reorder": f"CASE WHEN {_bit(2)} = 1 THEN 0 ELSE 2 - {_bit(3)} END", '"references"': f"CASE WHEN {_R} THEN 2 ELSE {_REFS} END", "list_bits": f"CASE WHEN {_F} THEN k % 5 + 1 ELSE 1 END", "tip": f"CASE WHEN {_F} THEN {_TIP} ELSE 0 END", "tip_refine": f"CASE WHEN {_F} AND {_TIP} > 0 AND (k % 3 > 0 OR {_bit(4)} = 1) THEN {_bit(5)} END",
    "screen_content": f"CASE WHEN {_R} OR k % 3 = 0 THEN 2 WHEN k % 3 = 1 THEN 1 ELSE 0 END", "whole_vectors": f"CASE WHEN {_R} OR k % 3 = 2 OR k % 4 = 0 THEN 2 WHEN k % 4 = 1 THEN 1 ELSE 0 END", "identity_intra": f"CASE WHEN {_bit(1)} = 1 THEN 1 ELSE {_bit(2)} END", "trellis": f"{_bit(3)} + CASE WHEN {_F} AND {_bit(3)} = 1 THEN {_bit(4)} ELSE 0 END",
    "average": f"CASE WHEN {_R} THEN 1 ELSE {_bit(1)} END", "y_dc": f"CASE WHEN {_bit(2)} = 0 THEN k % 32 - 23 END", "uv_dc": f"CASE WHEN {_C} THEN CASE WHEN {_bit(2)} = 1 THEN (k * 5) % 32 - 23 ELSE (k * 3) % 32 - 23 END END", "uv_ac": f"CASE WHEN {_C} THEN (k * 5) % 32 - 23 END",
    "gdf_unit": f"CASE WHEN {_bit(3)} = 1 AND k % 3 = 0 THEN {_bit(4)} END", "no_chroma_filter": f"CASE WHEN {_bit(4)} = 1 THEN CASE WHEN {_bit(3)} = 1 THEN {_bit(5)} ELSE {_bit(2)} END END", "cdef_on_skipped": f"CASE WHEN {_R} THEN 2 WHEN k % 4 = 0 THEN 1 WHEN k % 4 = 1 THEN 0 ELSE 2 END", "deblock_bits": "k % 4 + 2", "has_grain": _bit(6),
}


@query(f"WITH t AS (SELECT c_custkey AS k FROM customer) SELECT k AS c_custkey, {', '.join(f'CAST({v} AS BIGINT) AS {n}' for n, v in _SEQUENCE_OUT.items())} FROM t")
def sequence_headers(spark, sf_dir):
    """Sequence headers, short and whole ones: every field in its place, under the conditions that earlier ones set."""
    rows = _written(spark, sf_dir, "customer", ["c_custkey"], ["c_custkey AS k"], _SEQUENCE_FIELDS)
    return headers.read_header(rows, "payload", headers.SEQUENCE).where("NOT error").select("c_custkey", *[n.strip('"') for n in _SEQUENCE_OUT])


# quantiser matrices

_PLANES = 2
_ENDS = "k % 4 = 1"  # such sets end every matrix that isn't symmetric with a 0


def _value(t: int, c: int, i: str) -> str:
    return f"(20 + (k * ({i} + 1) + {c * 5 + t * 11}) % 40)"


_flagged = {"copied": lambda t, c: f"(k + {t + c}) % 3 = 0" if c else "false", "mirrored": lambda t, c: f"(k + {c}) % 2 = 0" if t == 0 else "false", "turned": lambda t, c: f"(k + {c}) % 4 = 0" if t == 2 else "false"}


def _matrix_bits(t: int, c: int) -> Column:
    """The bits of one matrix: flags, then differences in the order of the scan."""
    places = headers.diagonal(*headers.MATRICES[t])
    copied, mirrored, turned = (F.expr(_flagged[x](t, c)) for x in ("copied", "mirrored", "turned"))
    flag = lambda test: F.when(test, "1").otherwise("0")
    head = F.concat(flag(copied) if c else F.lit(""), F.when(~copied, flag(mirrored if t == 0 else turned)).otherwise("") if t != 1 else F.lit(""))
    mirror = F.array(*[F.lit(places.index((x, y)) if t == 0 and x > y else n) for n, (y, x) in enumerate(places)])
    ends = F.expr(_ENDS) & ~mirrored
    stop = 10 + F.col("k") % 15
    at = lambda n: F.col("k") * (n + 1) + (c * 5 + t * 11)
    value = lambda i: 20 + at(F.when(mirrored, F.get(mirror, i)).otherwise(i)) % 40

    def one(i):
        before = F.when(i == 0, 32).otherwise(value(i - 1))
        step = F.when(ends & (i == stop), -before).otherwise(value(i) - before)
        code = F.when(step > 0, 2 * step - 1).otherwise(-2 * step).cast("bigint")
        left_out = (mirrored & (F.get(mirror, i) != i)) | (ends & (i > stop))
        return F.when(left_out, "").otherwise(bitcodes.exp_golomb(code))

    return F.concat(head, F.when(copied | turned, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(len(places) - 1)), one), "")))


def _matrices_sql() -> str:
    """Every entry of every matrix: by its own place, its mirror's, the plane before or the turned second shape."""
    out = []
    for t, (height, width) in enumerate(headers.MATRICES):
        places = headers.diagonal(height, width)
        for c in range(_PLANES):
            rows = ", ".join(f"({y * width + x}, {n}, {places.index((x, y)) if t == 0 and x > y else n}, {headers.diagonal(*headers.MATRICES[1]).index((x, y)) if t == 2 else 0})" for n, (y, x) in enumerate(places))
            own = lambda c: f"CASE WHEN {_flagged['turned'](t, c)} THEN {ended(1, c, 'o')} WHEN {_flagged['mirrored'](t, c)} THEN {_value(t, c, 'm')} ELSE {ended(t, c, 'i')} END"  # noqa: E731, B023
            ended = lambda t, c, i: f"CASE WHEN {_ENDS} AND {i} >= 10 + k % 15 THEN {_value(t, c, '(9 + k % 15)')} ELSE {_value(t, c, i)} END"
            turned_own = own(c)
            if t == 2 and c:  # the second shape of this plane may itself be a copy
                turned_own = turned_own.replace(ended(1, c, "o"), f"CASE WHEN {_flagged['copied'](1, c)} THEN {ended(1, c - 1, 'o')} ELSE {ended(1, c, 'o')} END", 1)
            value = f"CASE WHEN {_flagged['copied'](t, c)} THEN {own(c - 1)} ELSE {turned_own} END" if c else own(c)
            out.append(f"SELECT k, {t} AS shape, {c} AS plane, place, {value} AS v FROM t, (VALUES {rows}) p(place, i, m, o) WHERE k % 7 <> 0")
    return " UNION ALL ".join(out)


@query(f"WITH t AS (SELECT s_suppkey AS k FROM supplier) SELECT k AS s_suppkey, CAST(shape AS INTEGER) AS shape, CAST(plane AS INTEGER) AS plane, CAST(place AS INTEGER) AS place, CAST(v AS BIGINT) AS weight FROM ({_matrices_sql()})")
def quantiser_matrix_sets(spark, sf_dir):
    """User quantiser matrices: differences along diagonals, symmetric ones, copies of the plane before, turned ones, ends that repeat; predefined sets have none."""
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("k"))
    bits = F.concat(F.when(F.col("k") % 7 == 0, "1").otherwise(F.concat(F.lit("0"), *[_matrix_bits(t, c) for t in range(3) for c in range(_PLANES)])))
    found = headers.read_header(with_payload(rows, bits).select("s_suppkey", "payload"), "payload", headers.matrix_set(_PLANES)).where("NOT error")
    each = [F.struct(F.lit(t).alias("shape"), F.lit(c).alias("plane"), F.col(f"m{t}{c}").alias("m")) for t in range(3) for c in range(_PLANES)]
    return found.select("s_suppkey", F.explode(F.array(*each)).alias("s")).select("s_suppkey", "s.shape", "s.plane", F.posexplode("s.m").alias("place", "weight"))
