"""Further kernels: chroma from luma filters, optical flow, warps, candidate lists, grain on chroma, tiles of a group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from ..functions.integer import clip, round2, shr
from ..operators import entropy, grain, rangecoder, transform
from ..operators.intra import N, each
from ..sources.isobmff import join, number
from ..sources.planes import blocks, hold, pairs, plane, read, spread_block
from .blocks import COLS, PQ, PX, _transform, _transform_sql, big
from .planes import _LFSR, PL

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The 8-point sine kernel.
ADST8 = [
    [11, 34, 54, 71, 84, 88, 79, 50], [28, 74, 89, 68, 17, -44, -83, -69], [44, 89, 48, -41, -89, -44, 50, 81], [58, 76, -34, -86, 10, 88, 6, -84],
    [70, 39, -87, 1, 86, -44, -59, 78], [79, -12, -66, 87, -35, -44, 86, -62], [86, -58, 12, 38, -75, 88, -74, 40], [89, -86, 79, -70, 58, -44, 29, -14],
]
#: Names of colour primaries by their code.
PRIMARIES = {1: "BT.709", 2: "unspecified", 4: "BT.470M", 5: "BT.470BG", 6: "BT.601", 7: "SMPTE 240", 8: "generic film", 9: "BT.2020", 10: "XYZ", 11: "SMPTE 431", 12: "SMPTE 432", 22: "EBU 3213"}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(_transform_sql(ADST8, transform.dct_matrix(8), 8, 7, 8))
def adst8_dct8_2d(spark, sf_dir):
    return _transform(spark, sf_dir, ADST8, transform.dct_matrix(8), 8, 7, 8)


@query(_transform_sql(ADST8[::-1], ADST8, 8, 7, 8))
def flipadst8_2d(spark, sf_dir):
    return _transform(spark, sf_dir, ADST8[::-1], ADST8, 8, 7, 8)


_C = "SELECT a.b, a.y // 2 AS y, a.x // 2 AS x, a.v AS c, l.v AS l, r.v AS r, u.v AS u, d.v AS d, dl.v AS dl, dr.v AS dr FROM px a JOIN px l ON l.b = a.b AND l.y = a.y AND l.x = greatest(0, a.x - 1) JOIN px r ON r.b = a.b AND r.y = a.y AND r.x = a.x + 1 JOIN px u ON u.b = a.b AND u.x = a.x AND u.y = greatest(0, a.y - 1) JOIN px d ON d.b = a.b AND d.x = a.x AND d.y = a.y + 1 JOIN px dl ON dl.b = a.b AND dl.y = a.y + 1 AND dl.x = greatest(0, a.x - 1) JOIN px dr ON dr.b = a.b AND dr.y = a.y + 1 AND dr.x = a.x + 1 WHERE a.y % 2 = 0 AND a.x % 2 = 0"


@query(f"WITH {PX}, c AS ({_C}) SELECT {COLS}, {big('(c + r + d + dr) >> 2', 'uniform')}, {big('(l + 2 * c + r + dl + 2 * d + dr) >> 3', 'strip')}, {big('(l + 4 * c + r + u + d) >> 3', 'cross_')} FROM c")
def cfl_luma_subsample(spark, sf_dir):
    """Luma at half size in both directions, by the three filters; edges repeat."""
    at = lambda y, x: F.col("px")[F.greatest(F.lit(0), y) * N + F.greatest(F.lit(0), x)]
    quarter = lambda f: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: f(F.shiftright(i, 2) * 2, i.bitwiseAND(F.lit(3)) * 2).cast("bigint"))
    df = blocks(spark, sf_dir).withColumns({
        "uniform": quarter(lambda y, x: shr(at(y, x) + at(y, x + 1) + at(y + 1, x) + at(y + 1, x + 1), 2)),
        "strip": quarter(lambda y, x: shr(at(y, x - 1) + 2 * at(y, x) + at(y, x + 1) + at(y + 1, x - 1) + 2 * at(y + 1, x) + at(y + 1, x + 1), 3)),
        "cross_": quarter(lambda y, x: shr(at(y, x - 1) + 4 * at(y, x) + at(y, x + 1) + at(y - 1, x) + at(y + 1, x), 3)),
    })
    return spread_block(df.select("block_id", "uniform", "strip", "cross_"), "uniform", "strip", "cross_", width=4)


_G = "SELECT a.b, a.y, a.x, r.m - l.m AS gx, d.m - u.m AS gy, a.v - a.w AS e FROM m a JOIN m l ON l.b = a.b AND l.y = a.y AND l.x = greatest(0, a.x - 1) JOIN m r ON r.b = a.b AND r.y = a.y AND r.x = least(7, a.x + 1) JOIN m u ON u.b = a.b AND u.x = a.x AND u.y = greatest(0, a.y - 1) JOIN m d ON d.b = a.b AND d.x = a.x AND d.y = least(7, a.y + 1)"


@query(f"WITH {PQ}, m AS (SELECT *, v + w AS m FROM pq), g AS ({_G}) SELECT b AS block_id, {', '.join(big(f'sum({e})', n) for e, n in (('gx * gx', 'sxx'), ('gx * gy', 'sxy'), ('gy * gy', 'syy'), ('gx * e', 'sxe'), ('gy * e', 'sye')))} FROM g GROUP BY b")
def optical_flow_sums(spark, sf_dir):
    """The sums of the 2x2 system for a block's motion between px and px2: products of gradients, and of those with the difference."""
    edge = lambda v: F.greatest(F.lit(0), F.least(F.lit(N - 1), v))
    at = lambda y, x: F.col("_m")[edge(y) * N + edge(x)]
    df = hold(pairs(spark, sf_dir), _m=F.zip_with("px", "px2", lambda a, b: a + b), _e=F.zip_with("px", "px2", lambda a, b: a - b))
    df = hold(df, _gx=each(lambda y, x: at(y, x + 1) - at(y, x - 1)), _gy=each(lambda y, x: at(y + 1, x) - at(y - 1, x)))
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return df.select("block_id", *[total(a, b).alias(n) for a, b, n in (("_gx", "_gx", "sxx"), ("_gx", "_gy", "sxy"), ("_gy", "_gy", "syy"), ("_gx", "_e", "sxe"), ("_gy", "_e", "sye"))])


_WARP = "greatest(0, least(7, ((65536 + (b % 7 - 3) * 2048) * x + (b % 5 - 2) * 4096 * y + 32768) >> 16))", "greatest(0, least(7, ((b % 3 - 1) * 4096 * x + (65536 - (b % 4) * 1024) * y + 32768) >> 16))"


@query(f"WITH {PX}, w AS (SELECT b, y, x, {_WARP[0]} AS sx, {_WARP[1]} AS sy FROM px) SELECT w.b AS block_id, CAST(w.y AS BIGINT) AS y, CAST(w.x AS BIGINT) AS x, p.v AS warped FROM w JOIN px p ON p.b = w.b AND p.y = w.sy AND p.x = w.sx")
def warp_affine(spark, sf_dir):
    """Each sample from where an affine matrix in units of 1/65536 points, to the nearest sample, edges repeated."""
    b = F.col("block_id")
    df = hold(blocks(spark, sf_dir), _a=65536 + (b % 7 - 3) * 2048, _b=(b % 5 - 2) * 4096, _c=(b % 3 - 1) * 4096, _d=65536 - (b % 4) * 1024)
    edge = lambda v: F.greatest(F.lit(0), F.least(F.lit(N - 1), v)).cast("int")
    return spread_block(df.withColumn("warped", each(lambda y, x: F.col("px")[edge(shr(F.col("_c") * x + F.col("_d") * y + 32768, 16)) * N + edge(shr(F.col("_a") * x + F.col("_b") * y + 32768, 16))])), "warped")


@query("WITH c AS (SELECT user_id, CAST(floor(value) AS BIGINT) % 32 AS mv, sum(event_id % 4 + 1) AS weight, min(event_id) AS first FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, first) - 1 AS rank FROM c) SELECT user_id, mv, CAST(weight AS BIGINT) AS weight, rank FROM r WHERE rank < 4")
def mv_candidates(spark, sf_dir):
    """Of each user's vectors, equal ones merged with their weights added, the four heaviest, the earliest of equal weight first."""
    found = read(spark, sf_dir, "events").groupBy("user_id", (F.floor("value").cast("bigint") % 32).alias("mv")).agg(F.sum(F.col("event_id") % 4 + 1).alias("weight"), F.min("event_id").alias("first"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("weight").desc(), "first")) - 1
    return found.withColumn("rank", rank.cast("bigint")).where("rank < 4").drop("first")


@query(f"WITH {PL} SELECT y // 4 AS by, x // 4 AS bx, {big('min(v >> 5)', 'segment')}, {big('count(DISTINCT v >> 5)', 'kinds')} FROM pl GROUP BY ALL")
def segment_prediction(spark, sf_dir):
    """The least segment of each 4x4 block of a map, and how many it holds."""
    s = shr(F.col("v"), 5)
    found = plane(spark, sf_dir).groupBy(F.floor(F.col("y") / 4).cast("bigint").alias("by"), F.floor(F.col("x") / 4).cast("bigint").alias("bx"))
    return found.agg(F.min(s).cast("bigint").alias("segment"), F.size(F.collect_set(s)).cast("bigint").alias("kinds"))


@query("WITH e AS (SELECT event_id // 100 AS y, event_id % 100 AS x, event_id, event_type FROM events) SELECT event_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY y ORDER BY x), false) AS edge FROM e")
def block_edges(spark, sf_dir):
    """Where the kind of a sample differs from its left neighbour's."""
    e = read(spark, sf_dir, "events")
    before = F.lag("event_type").over(Window.partitionBy(F.floor(F.col("event_id") / 100)).orderBy("event_id"))
    return e.select("event_id", F.coalesce(F.col("event_type") != before, F.lit(False)).alias("edge"))


_NOISE = f"r(event_id, s, n) AS (SELECT event_id, CAST((event_id * 40503 + 1) % 65536 AS BIGINT), 0 FROM events UNION ALL SELECT event_id, (s >> 1) | (({_LFSR}) << 15), n + 1 FROM r WHERE n < 16), g AS (SELECT r.event_id, (s >> 8) - 128 AS g, CAST(greatest(0, least(255, floor(value))) AS BIGINT) AS v FROM r JOIN events USING (event_id) WHERE n = 16)"


def _noise(spark, sf_dir) -> DataFrame:
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor("value"))).cast("bigint")
    return hold(read(spark, sf_dir, "events").select("event_id", "value"), v=v, g=grain.noise((F.col("event_id") * 40503 + 1) % 65536)).select("event_id", "v", "g")


@query(f"WITH RECURSIVE {_NOISE} SELECT a.event_id, {big('greatest(0, least(255, a.v + (((32 + greatest(0, least(255, ((((a.v + b.v + 1) >> 1) * 40 + a.v * 24) >> 6) - 3)) // 4) * a.g + 64) >> 7)))', 'grained')} FROM g a JOIN g b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0")
def grain_apply_chroma(spark, sf_dir):
    """Grain scaled by a mix of a sample and the mean of the two luma samples over it."""
    found = _noise(spark, sf_dir)
    right = found.select((F.col("event_id") - 1).alias("event_id"), F.col("v").alias("v2"))
    s = found.where("event_id % 2 = 0").join(right, "event_id")
    index = clip(shr(shr(F.col("v") + F.col("v2") + 1, 1) * 40 + F.col("v") * 24, 6) - 3, 0, 255)
    return s.select("event_id", grain.apply_luma(F.col("v"), 32 + F.floor(index / 4), F.col("g"), shift=7).alias("grained"))


@query(f"WITH RECURSIVE {_NOISE} SELECT a.event_id, {big('greatest(-128, least(127, (a.g * 27 + b.g * 17 + 16) >> 5))', 'blended')} FROM g a JOIN g b ON b.event_id = a.event_id + 1")
def grain_overlap(spark, sf_dir):
    """Two blocks' grain where they overlap: 27/32 of the old and 17/32 of the new, rounded and clipped."""
    found = _noise(spark, sf_dir)
    new = found.select((F.col("event_id") - 1).alias("event_id"), F.col("g").alias("g2"))
    return found.join(new, "event_id").select("event_id", clip(round2(F.col("g") * 27 + F.col("g2") * 17, 5), -128, 127).alias("blended"))


_TCQ = "xor(t.s & 4, (xor(sy.l & 1, t.s & 1)) << 2) | ((t.s & 6) >> 1)"


@query(f"WITH RECURSIVE sy AS (SELECT event_id // {entropy.TILE} AS tile, row_number() OVER (PARTITION BY event_id // {entropy.TILE} ORDER BY event_id) AS i, CAST(floor(abs(value)) AS BIGINT) AS l FROM events), t(tile, n, s) AS (SELECT DISTINCT tile, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM sy UNION ALL SELECT t.tile, n + 1, {_TCQ} FROM t JOIN sy ON sy.tile = t.tile AND sy.i = n + 1) SELECT tile, CAST(arg_max(s, n) AS BIGINT) AS state FROM t GROUP BY tile")
def trellis_state(spark, sf_dir):
    """The state of the trellis quantiser after a tile's levels in order."""
    e = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / entropy.TILE).cast("bigint").alias("tile"), F.struct("event_id", F.floor(F.abs("value")).cast("bigint").alias("l")).alias("e"))
    tiles = e.groupBy("tile").agg(F.array_sort(F.collect_list("e")).alias("list"))
    one = F.lit(1)
    step = lambda s, x: (s.bitwiseAND(F.lit(4)).bitwiseXOR(F.shiftleft(x["l"].bitwiseAND(one).bitwiseXOR(s.bitwiseAND(one)), 2)).bitwiseOR(shr(s.bitwiseAND(F.lit(6)), 1))).cast("bigint")
    return tiles.select("tile", F.aggregate("list", F.lit(0).cast("bigint"), step).alias("state"))


_NAMES = ", ".join(f"({k}, '{v}')" for k, v in PRIMARIES.items())


@query(f"WITH n(code, name) AS (VALUES {_NAMES}) SELECT p_partkey, coalesce(name, 'reserved') AS primaries FROM part LEFT JOIN n ON n.code = p_size % 24")
def colour_primaries(spark, sf_dir):
    """Codes of colour primaries by name; a dimension of a fixed size is broadcast."""
    names = spark.createDataFrame(list(PRIMARIES.items()), "code int, name string")
    return read(spark, sf_dir, "part").join(F.broadcast(names), F.col("p_size") % 24 == F.col("code"), "left").select("p_partkey", F.coalesce("name", F.lit("reserved")).alias("primaries"))


def slice_tiles(groups: DataFrame, prefix: int = 4) -> DataFrame:
    """groups (tiles, content, and any columns beside) with `payloads`: the bytes of each tile in order. Each tile but the last has its size less 1 before it.

    A group that ends too soon, or whose content or number of tiles is null, has null payloads; one
    without tiles has none. Other columns are passed on as they are.
    """
    names = [x for x in groups.columns if x not in ("tiles", "content")]

    def cut(n: int | None, b: bytes | None) -> list[bytes] | None:
        at, own = 0, []
        for tile in range(n) if n is not None and b is not None else ():
            size = len(b) - at
            if tile < n - 1:
                size = int.from_bytes(b[at : at + prefix], "little") + 1
                at += prefix
            if at + size > len(b):
                return None
            own.append(b[at : at + size])
            at += size
        return None if n is None or b is None else own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cut(n, b) for n, b in zip(batch.column("tiles").to_pylist(), batch.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array(found, pa.list_(pa.binary()))], names=[*names, "payloads"])

    return groups.mapInArrow(run, StructType([*groups.select(*names).schema.fields, StructField("payloads", ArrayType(BinaryType()))]))


@query("SELECT conv_id AS group_id, turn, coalesce(text, '') || '|' AS text FROM conversations")
def tile_slicing(spark, sf_dir):
    """Turns of a conversation, each with a mark at its end, as the tiles of groups, written with little-endian sizes of four bytes and cut apart again.

    A group has 64 tiles at most, so a conversation of any length, or the rows that have none, make
    as many groups as they need. A null or empty text is the mark alone; turns with the same number
    keep their texts.
    """
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit("|")).alias("text"))
    turns = turns.withColumn("salt", F.pmod(F.xxhash64("turn", "text"), F.lit(16)))  # a long conversation is dealt to several tasks
    placed = turns.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "salt").orderBy("turn", "text")) - 1)
    size = F.octet_length("text") - 1
    little = join(*[number(F.shiftright(size, 8 * k).bitwiseAND(F.lit(255)), 1) for k in range(4)]).data
    one = F.struct("n", "turn", F.hex(little).alias("head"), F.hex(F.encode("text", "utf-8")).alias("body"))
    groups = placed.groupBy("conv_id", "salt", F.floor(F.col("n") / 64).alias("group")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    hexes = F.transform("t", lambda x, i: F.when(i < F.size("t") - 1, F.concat(x["head"], x["body"])).otherwise(x["body"]))
    groups = groups.select(F.col("conv_id").alias("group_id"), F.size("t").cast("bigint").alias("tiles"), F.unhex(F.array_join(hexes, "")).alias("content"), F.transform("t", lambda x: x["turn"]).alias("turns"))
    found = slice_tiles(groups).select("group_id", F.explode(F.arrays_zip("turns", "payloads")).alias("t"))
    return found.select("group_id", F.col("t.turns").alias("turn"), F.decode("t.payloads", "utf-8").alias("text"))


@query("WITH c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) % 8192 AS pos, 8192 + (l_partkey % 16384) AS scale FROM lineitem) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (pos * scale + 8192) >> 14 AS scaled, ((pos * scale + 8192) >> 10) & 15 AS phase FROM c")
def scaled_reference(spark, sf_dir):
    """A position in a reference of another size, and its phase in sixteenths, by a factor in units of 1/16384."""
    pos, scale = F.floor("l_extendedprice").cast("bigint") % 8192, 8192 + F.col("l_partkey") % 16384
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", round2(pos * scale, 14).alias("scaled"), shr(pos * scale + 8192, 10).bitwiseAND(F.lit(15)).alias("phase"))




@query("WITH f AS (SELECT event_id // 256 AS stream_id, event_id, CAST(floor(abs(value)) AS BIGINT) % 256 AS mask FROM events) SELECT stream_id, CAST(k AS BIGINT) AS slot, max(event_id) AS frame FROM f, range(8) r(k) WHERE (mask >> k) & 1 = 1 GROUP BY stream_id, k")
def reference_refresh(spark, sf_dir):
    """The frame that each of a stream's eight reference slots holds at its end: the last whose refresh mask names the slot."""
    mask = F.floor(F.abs("value")).cast("bigint") % 256
    slots = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint")), lambda k: F.floor(mask / F.pow(F.lit(2), k)).cast("bigint") % 2 == 1)
    frames = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 256).cast("bigint").alias("stream_id"), "event_id", F.explode(slots).alias("slot"))
    return frames.groupBy("stream_id", "slot").agg(F.max("event_id").alias("frame"))


def _split(size: int, limit: int) -> str:
    return f"s AS s, {size * size} * q - s * s > {limit} AS split"


@query(f"""WITH {PX}, a AS (SELECT b, 0 AS y, 0 AS x, sum(v) AS s, sum(v * v) AS q FROM px GROUP BY b), a2 AS (SELECT b, y, x, {_split(8, 8_000_000)} FROM a),
c AS (SELECT px.b, px.y // 4 * 4 AS y, px.x // 4 * 4 AS x, sum(v) AS s, sum(v * v) AS q FROM px JOIN a2 ON a2.b = px.b AND split GROUP BY ALL), c2 AS (SELECT b, y, x, {_split(4, 300_000)} FROM c),
d AS (SELECT px.b, px.y // 2 * 2 AS y, px.x // 2 * 2 AS x, sum(v) AS s FROM px JOIN c2 ON c2.b = px.b AND c2.y = px.y // 4 * 4 AND c2.x = px.x // 4 * 4 AND split GROUP BY ALL)
SELECT b AS block_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(size AS BIGINT) AS size, CAST(s AS BIGINT) AS total FROM (SELECT b, y, x, 8 AS size, s FROM a2 WHERE NOT split UNION ALL SELECT b, y, x, 4, s FROM c2 WHERE NOT split UNION ALL SELECT b, y, x, 2, s FROM d)""")
def partition_quadtree(spark, sf_dir):
    """The leaves of each block when a square splits in four as long as it varies much, down to 2x2."""
    cell = lambda y, x, n: F.flatten(F.transform(F.sequence(y, y + n - 1), lambda r: F.slice("px", (r * N + x + 1).cast("int"), F.lit(n))))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, v: s + v)
    squares = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, v: s + v * v)
    now = blocks(spark, sf_dir).select("block_id", "px", F.lit(0).alias("y"), F.lit(0).alias("x"))
    leaves = None
    for size, limit in ((8, 8_000_000), (4, 300_000), (2, None)):
        now = hold(now, total=total(cell(F.col("y"), F.col("x"), size)), squares=squares(cell(F.col("y"), F.col("x"), size)))
        varied = F.lit(False) if limit is None else size * size * F.col("squares") - F.col("total") * F.col("total") > limit
        done = now.where(~varied).select("block_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.lit(size).cast("bigint").alias("size"), "total")
        leaves = done if leaves is None else leaves.unionByName(done)
        half = size // 2
        parts = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy in (0, half) for dx in (0, half)]))
        now = now.where(varied).select("block_id", "px", parts.alias("p")).select("block_id", "px", "p.y", "p.x")
    return leaves


@query(f"WITH {PL}, h AS (SELECT y, x, CASE WHEN v % 7 <> 0 THEN v END AS v FROM pl) SELECT y, x, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY y ORDER BY x), CAST(-1 AS BIGINT)) AS filled FROM h")
def hole_fill(spark, sf_dir):
    """Missing samples of a field from the nearest one to the left in their line; -1 where there is none."""
    v = F.when(F.col("v") % 7 != 0, F.col("v"))
    return plane(spark, sf_dir).select("y", "x", F.coalesce(F.last(v, ignorenulls=True).over(Window.partitionBy("y").orderBy("x")), F.lit(-1)).cast("bigint").alias("filled"))


@query(f"WITH s AS (SELECT event_id // {entropy.TILE} AS tile, event_id % {entropy.TILE} AS i, CAST(floor(abs(value)) AS BIGINT) % 5 AS s FROM events) SELECT tile, count(*) AS n, {big('sum((i + 1) * s)', 'checksum')} FROM s GROUP BY tile")
def range_coder_roundtrip(spark, sf_dir):
    """Each tile's symbols coded by an adaptive range coder and decoded again."""
    e = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / entropy.TILE).cast("bigint").alias("tile"), F.struct("event_id", (F.floor(F.abs("value")).cast("bigint") % 5).alias("s")).alias("e"))
    tiles = e.groupBy("tile").agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["s"]).alias("symbols"))
    found = rangecoder.decode_tiles(rangecoder.encode_tiles(tiles, 5), 5)
    weighted = F.aggregate(F.transform("symbols", lambda s, i: (i + 1) * s), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return found.select("tile", F.size("symbols").cast("bigint").alias("n"), weighted.alias("checksum"))
