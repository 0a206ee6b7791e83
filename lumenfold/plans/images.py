"""Queries over whole images of 64x64 samples made of events, each with the DuckDB SQL that it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deblocking, partition, restoration
from ..operators.loopfilter import Q_MULT, Q_WIDE, W_MULT
from ..sources.planes import read
from .planes import WIENER

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Samples in a side of an image.
SIDE = 64


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_IMAGES = f"ev AS (SELECT event_id // {SIDE * SIDE} AS image, event_id % {SIDE * SIDE} // {SIDE} AS y, event_id % {SIDE} AS x, CAST(greatest(0, least(255, 96 + floor(value / 4))) AS BIGINT) AS v FROM events), px0 AS (SELECT i.image, y.y, x.x, coalesce(v, {deblocking.MISSING}) AS v FROM (SELECT DISTINCT image FROM ev) i JOIN range(0, {SIDE}) y(y) ON true JOIN range(0, {SIDE}) x(x) ON true LEFT JOIN ev ON ev.image = i.image AND ev.y = y.y AND ev.x = x.x)"


def images(spark, sf_dir):
    """(image, y, x, v): every 4096 events as an image."""
    e = F.col("event_id")
    v = F.greatest(F.lit(0), F.least(F.lit(255), 96 + F.floor(F.col("value") / 4))).cast("bigint")
    return read(spark, sf_dir, "events").select(F.floor(e / (SIDE * SIDE)).alias("image"), F.floor(e % (SIDE * SIDE) / SIDE).alias("y"), (e % SIDE).alias("x"), v.alias("v"))


def _pass_sql(number: int, along: str, across: str) -> str:
    """Tables of one pass over px{number - 1}: lists of lines, edges taken in order by recursion, samples again."""
    line = lambda k, d: f"l{k}[pos + {d + 1}]"
    mean = lambda f: f"(({f(0)} + {f(3)} + 1) >> 1)"
    second = lambda d: mean(lambda k: f"abs({line(k, d - 1)} - 2 * {line(k, d)} + {line(k, d + 1)})")
    straight = lambda w: f"greatest({mean(lambda k: f'abs({line(k, -1)} - {line(k, -1 - w)} - {w} * ({line(k, -1)} - {line(k, -2)}))')}, {mean(lambda k: f'abs({line(k, 0)} - {line(k, w)} - {w} * ({line(k, 0)} - {line(k, 1)}))')})"
    here, there = (("g // 2", "e"), ("g // 2", "e - 1")) if along == "x" else (("e", "g // 2"), ("e - 1", "g // 2"))
    index = lambda b: f"((image * 13 + ({b[0]}) * 7 + ({b[1]}) * 5) % 120 + 60)"
    lossless = lambda b: f"((image + ({b[0]}) * 3 + ({b[1]})) % 11 = 0)"
    kind = f"(image + 3 * ({here[1]}) + 5 * ({here[0]})) % 4"
    width = f"CASE WHEN most = 0 OR high > side THEN 0 WHEN most = 1 OR high > side >> 2 OR across > 4 * q THEN 1 WHEN high > side >> 3 OR across > 3 * q OR s3 > (3 * side) >> 4 THEN 2 WHEN most = 3 OR across * 16 > q * {Q_WIDE[4]} OR s4 > (side * 4) >> 4 THEN 3 ELSE 4 END"
    by_width = lambda table: f"[0, {', '.join(map(str, table[:4]))}][w + 1]"
    delta = lambda k: f"greatest(-q * {by_width(Q_MULT)}, least(q * {by_width(Q_MULT)}, 4 * (3 * ({line(k, 0)} - {line(k, -1)}) - ({line(k, 1)} - {line(k, -2)}))))"
    change = lambda k, j: f"((d{k} * ({by_width(W_MULT)} * (w - {j})) + 1024) >> 11)"
    new = lambda k, d: f"CASE WHEN w > {-1 - d if d < 0 else d} AND NOT {'kl' if d < 0 else 'kr'} THEN greatest(0, least(255, {line(k, d)} {'+' if d < 0 else '-'} {change(k, -1 - d if d < 0 else d)})) ELSE {line(k, d)} END"
    lists = ", ".join(f"list_concat(l{k}[1:pos - 4], [{', '.join(new(k, d) for d in range(-4, 4))}], l{k}[pos + 5:{SIDE}]) AS l{k}" for k in range(4))
    step0 = f"SELECT image, g, e + 1 AS e, (e + 1) * 8 AS pos, l0, l1, l2, l3 FROM p{number} WHERE e < {SIDE // 8 - 1}"
    step1 = f"SELECT *, 8 + (({index(here)} + {index(there)} + 1) >> 3) AS q, CASE WHEN pos % 32 = 0 THEN 0 ELSE [0, 1, 3, 4][{kind} + 1] END AS most, {lossless(there)} AS kl, {lossless(here)} AS kr, greatest({second(-2)}, {second(1)}) AS high, {second(-1)} + {second(0)} AS across, {straight(3)} AS s3, {straight(4)} AS s4 FROM ({step0})"
    step2 = f"SELECT *, 6 * q AS side FROM ({step1})"
    step3 = f"SELECT *, {width} AS w FROM ({step2})"
    step4 = f"SELECT *, {', '.join(f'{delta(k)} AS d{k}' for k in range(4))} FROM ({step3})"
    first = ", ".join(f"list(v ORDER BY {along}) FILTER (WHERE {across} % 4 = {k}) AS l{k}" for k in range(4))
    last = " UNION ALL ".join(f"SELECT image, g * 4 + {k} AS {across}, unnest(range(0, {SIDE})) AS {along}, unnest(l{k}) AS v FROM p{number} WHERE e = {SIDE // 8 - 1}" for k in range(4))
    return f"p{number}(image, g, e, l0, l1, l2, l3) AS (SELECT image, {across} // 4 AS g, 0, {first} FROM px{number - 1} GROUP BY image, {across} // 4 UNION ALL SELECT image, g, e, {lists} FROM ({step4})), px{number} AS ({last})"


@query(f"WITH RECURSIVE {_IMAGES}, {_pass_sql(1, 'x', 'y')}, {_pass_sql(2, 'y', 'x')} SELECT image, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(v AS BIGINT) AS v FROM px2")
def deblock_plane(spark, sf_dir):
    """Whole images deblocked: columns of edges, then rows of them over the result; tiles of 32 samples keep their seams, lossless blocks their samples."""
    return deblocking.deblock_images(images(spark, sf_dir), SIDE, SIDE, deblocking.block_edges(8, 32))


# restoration

_LATER = "greatest(0, least(255, v + (image * 3 + y * 7 + x * 5) % 9 - 4))"
_STRIPE, _FIRST = 16, 8
_number = lambda y: f"(({y} + {_STRIPE - _FIRST}) // {_STRIPE})"
_PAIRS = ", ".join(f"({k}, {dy}, {dx}, {c}, {g})" for k, (dy, dx, c, g) in enumerate([(dy, dx, c, -1) for (dy, dx), c in WIENER.items()] + [(dy, dx, 0, g) for g, (dy, dx) in enumerate([(1, 0), (0, 1), (1, 1), (1, -1)])]))
_ROW = f"(CASE WHEN {_number('y')} = 0 THEN 0 ELSE {_number('y')} * {_STRIPE} - {_STRIPE - _FIRST} END // 32)"


@query(f"""WITH {_IMAGES}, s AS (SELECT image, y, x, v, {_LATER} AS w FROM px0), t(k, dy, dx, c, g) AS (VALUES {_PAIRS}), n AS MATERIALIZED (SELECT image, y, x, w, c, g, greatest(0, least({SIDE - 1}, y + dy)) AS ay, greatest(0, least({SIDE - 1}, x + dx)) AS ax, greatest(0, least({SIDE - 1}, y - dy)) AS oy, greatest(0, least({SIDE - 1}, x - dx)) AS ox FROM s, t),
d AS (SELECT p.image, p.y, p.x, p.w, c, g, CASE WHEN {_number('p.ay')} = {_number('p.y')} THEN a.w ELSE a.v END + CASE WHEN {_number('p.oy')} = {_number('p.y')} THEN b.w ELSE b.v END - 2 * p.w AS d
  FROM n p JOIN s a ON a.image = p.image AND a.y = p.ay AND a.x = p.ax JOIN s b ON b.image = p.image AND b.y = p.oy AND b.x = p.ox),
f AS (SELECT image, y, x, w, CAST(sum(c * d) AS BIGINT) AS total, {', '.join(f'max(abs(d)) FILTER (WHERE g = {g}) AS g{g}' for g in range(4))} FROM d GROUP BY image, y, x, w),
c AS (SELECT image, y // 2 AS cy, x // 2 AS cx, {', '.join(f'CAST(sum(g{g}) AS BIGINT) AS g{g}' for g in range(4))} FROM f GROUP BY ALL),
e AS (SELECT image, cy, cx, ((CASE WHEN g0 <= g1 THEN 1 ELSE 0 END + CASE WHEN g2 <= g3 THEN 2 ELSE 0 END) * 37 + ((g0 + g1 + g2 + g3) >> 3) * 11) % 33 - 16 AS err FROM c),
o AS (SELECT f.*, err * ((image + 5 * {_ROW} + 2 * (x // 32)) % 3 * 4) AS ch, CASE WHEN (image + {_ROW} + x // 32) % 2 = 0 THEN greatest(0, least(255, (128 * w + total + 64) >> 7)) ELSE w END AS r FROM f JOIN e USING (image) WHERE cy = y // 2 AND cx = x // 2)
SELECT image, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(greatest(0, least(255, r + sign(ch) * ((abs(ch) + 8) >> 4))) AS BIGINT) AS v FROM o""")
def restore_units(spark, sf_dir):
    """Images restored in stripes: a filter by units over the later snapshot, lines beside a stripe from the earlier one, corrections from gradients taken before and added after."""
    given = images(spark, sf_dir)
    place = F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)))
    grid = given.select("image").distinct().select("image", place.alias("i")).select("image", F.floor(F.col("i") / SIDE).alias("y"), (F.col("i") % SIDE).cast("bigint").alias("x"))
    before = grid.join(given, ["image", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(restoration.MISSING)).cast("bigint"))
    after = before.withColumn("v", F.greatest(F.lit(0), F.least(F.lit(255), F.col("v") + (F.col("image") * 3 + F.col("y") * 7 + F.col("x") * 5) % 9 - 4)).cast("bigint"))
    units = lambda image, row, column: {"filtered": F.when((image + row + column) % 2 == 0, 1).otherwise(0), "scale": (image + 5 * row + 2 * column) % 3 * 4}
    return restoration.restore_images(before, after, SIDE, SIDE, WIENER, units)


# partition trees

_DECISIONS = 48


def _child(k: int) -> str:
    parts = ", ".join(f"{{'y': top.y + top.h * {a[0]} // 8, 'x': top.x + top.w * {b[0]} // 8, 'h': top.h * {a[1]} // 8, 'w': top.w * {b[1]} // 8}}" for a, b in partition.KINDS[k])
    return f"WHEN kind = {k} AND {partition.fits(k, 'top.h', 'top.w')} THEN [{parts}]"


_KIND = "CASE WHEN user_id % 5 = 0 THEN 0 ELSE (user_id + event_id * 3) % 10 END"
_TREE = f"""dec AS (SELECT event_id // {_DECISIONS} AS sb, list({_KIND} ORDER BY event_id) AS kinds FROM events GROUP BY ALL),
walk(sb, n, kinds, waiting, leaf) AS (SELECT sb, 0, kinds, [{{'y': CAST(0 AS BIGINT), 'x': CAST(0 AS BIGINT), 'h': CAST(16 AS BIGINT), 'w': CAST(16 AS BIGINT)}}], CAST(NULL AS STRUCT(y BIGINT, x BIGINT, h BIGINT, w BIGINT)) FROM dec
  UNION ALL SELECT sb, n + 1, kinds, CASE WHEN parts IS NULL THEN waiting[2:] ELSE list_concat(parts, waiting[2:]) END, CASE WHEN parts IS NULL THEN top END
  FROM (SELECT *, CASE {' '.join(_child(k) for k in range(1, 10))} END AS parts FROM (SELECT *, waiting[1] AS top, kinds[n + 1] AS kind FROM walk WHERE len(waiting) > 0))),
tree AS (SELECT sb, row_number() OVER (PARTITION BY sb ORDER BY n) - 1 AS ord, leaf.y AS y, leaf.x AS x, leaf.h AS h, leaf.w AS w FROM walk WHERE leaf IS NOT NULL)"""


def _superblocks(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.when(u % 5 == 0, 0).otherwise((u + e * 3) % 10)
    rows = read(spark, sf_dir, "events").select(F.floor(e / _DECISIONS).alias("sb"), F.struct("event_id", kind.cast("bigint").alias("kind")).alias("d"))
    found = rows.groupBy("sb").agg(F.transform(F.array_sort(F.collect_list("d")), lambda d: d["kind"]).alias("kinds"))  # a superblock's decisions
    return partition.partition_tree(found, "sb", "kinds")


@query(f"WITH RECURSIVE {_TREE} SELECT * FROM tree")
def partition_trees(spark, sf_dir):
    """Superblocks split by decisions into blocks of ten kinds of parts, in decode order."""
    return _superblocks(spark, sf_dir)


@query(f"""WITH RECURSIVE {_TREE}, b AS (SELECT sb // 4 AS frame, sb * 1000 + ord AS o, sb % 4 // 2 * 16 + y AS y, sb % 2 * 16 + x AS x, h, w FROM tree),
u AS (SELECT frame, o, y + i AS y, x + j AS x FROM b, range(0, 16) r(i), range(0, 16) c(j) WHERE i < h AND j < w),
q AS (SELECT b.*, 'r' AS side, k, y - 1 AS ay, x + w + k AS ax FROM b, range(0, 16) t(k) WHERE k < w UNION ALL SELECT b.*, 'b', k, y + h + k, x - 1 FROM b, range(0, 16) t(k) WHERE k < h),
m AS (SELECT q.*, u.o AS before FROM q LEFT JOIN u ON u.frame = q.frame AND u.y = q.ay AND u.x = q.ax)
SELECT frame, o AS "order", y, x, h, w, coalesce(min(k) FILTER (WHERE side = 'r' AND (before IS NULL OR before >= o)), w) AS top_right, coalesce(min(k) FILTER (WHERE side = 'b' AND (before IS NULL OR before >= o)), h) AS bottom_left FROM m GROUP BY frame, o, y, x, h, w""")
def neighbour_availability(spark, sf_dir):
    """How far beyond its top right and bottom left corner a block finds neighbours that are decoded before it, over frames of four superblocks."""
    sb = F.col("sb")
    blocks = _superblocks(spark, sf_dir).select(F.floor(sb / 4).alias("frame"), (sb * 1000 + F.col("ord")).alias("order"), (F.floor(sb % 4 / 2) * 16 + F.col("y")).alias("y"), (sb % 2 * 16 + F.col("x")).alias("x"), "h", "w")
    return partition.availability(blocks, "frame", ["order"])
