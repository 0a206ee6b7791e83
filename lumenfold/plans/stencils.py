"""Queries of filters over a whole plane that reach over the edges of blocks and bands, each with its DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.integer import clip
from ..operators import loopfilter, stencil
from ..sources.planes import WIDTH, lines, pairs, plane, read, spread_block, spread_line
from .blocks import DIRECTION, PQ, PX, _Q, _STEPS, big
from .planes import CCSO, PL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


#: The plane with six more samples on all sides, its edges repeated; cy, cx: the sample that stands there.
_PAD = f"""{PL}, hp AS MATERIALIZED (SELECT r.y AS y, c.x AS x, pl.y AS cy, pl.x AS cx, pl.v FROM (SELECT unnest(range(-6, my + 7)) AS y, my FROM sz) r CROSS JOIN (SELECT unnest(range(-6, {WIDTH + 6})) AS x) c
  JOIN lw ON lw.y = greatest(0, least(my, r.y)) JOIN pl ON pl.y = lw.y AND pl.x = greatest(0, least(lw.mx, c.x)))"""
_FEATURES = f"""{_PAD}, hl AS MATERIALIZED (SELECT y, list(v ORDER BY x) AS l FROM hp GROUP BY y),
lap AS MATERIALIZED (SELECT m.y, m.x, abs(u.l[m.x + 7] - 2 * m.v + d.l[m.x + 7]) AS f0, abs(u.l[m.x + 8] - 2 * m.v + d.l[m.x + 6]) AS f1, abs(u.l[m.x + 6] - 2 * m.v + d.l[m.x + 8]) AS f2 FROM hp m
  JOIN hl u ON u.y = m.y - 1 JOIN hl d ON d.y = m.y + 1),
bk AS (SELECT DISTINCT y // 4 AS block_y, x // 4 AS block_x FROM pl),
ft AS MATERIALIZED (SELECT block_y, block_x, CAST(sum(f0) AS BIGINT) AS f0, CAST(sum(f1) AS BIGINT) AS f1, CAST(sum(f2) AS BIGINT) AS f2 FROM bk CROSS JOIN range(-1, 5) i(i) CROSS JOIN range(-1, 5) j(j) JOIN lap ON lap.y = 4 * block_y + i AND lap.x = 4 * block_x + j GROUP BY block_y, block_x)"""


def _blocks_of(found: DataFrame) -> DataFrame:
    zipped = found.select("y", F.posexplode(F.arrays_zip("vertical", "antidiagonal", "diagonal")).alias("block_x", "f"))
    return zipped.select(F.floor(F.col("y") / 4).cast("bigint").alias("block_y"), F.col("block_x").cast("bigint").alias("block_x"), "f.vertical", "f.antidiagonal", "f.diagonal")


@query(f"WITH {_FEATURES} SELECT block_y, block_x, f0 AS vertical, f1 AS antidiagonal, f2 AS diagonal FROM ft")
def pc_wiener_window_features(spark, sf_dir):
    return _blocks_of(stencil.class_features(plane(spark, sf_dir)))


_BASE_Q = 120


def _measure(i: int) -> str:
    a, b, c = stencil.MODE_WEIGHTS[i]
    q = f"({a} * (t * 32) + {b} * {_BASE_Q} + {c} * ((t * {_BASE_Q} + 128) >> 8))"
    return f"(255 * ({stencil.MODE_OFFSETS[i]} + CASE WHEN {q} < 0 THEN -((4096 - {q}) >> 13) ELSE ({q} + 4096) >> 13 END))"


_BIN = lambda q: f"(least(255, (greatest(0, {q}) + 8192) >> 14) >> 5)"
_CLASS = f"{_BIN(_measure(0))} * 512 + " + " + ".join(f"{_BIN(f'f{i} * {stencil.NORMALIZER[i]} + {_measure(i + 1)}')} * {1 << 3 * (2 - i)}" for i in range(3))


@query(f"""WITH {_FEATURES}, bh AS (SELECT my // 4 AS last FROM sz),
sk AS (SELECT block_y, block_x, CAST(sum(CASE WHEN (7 * greatest(0, least(last, block_y + dy)) + 3 * (block_x - block_x % 16 + greatest(0, least(15, block_x % 16 + dx)))) % 5 = 0 THEN [16, 4, 1][1 + abs(dy) + abs(dx)] ELSE 0 END) AS BIGINT) * {stencil.NORMALIZER[3]} AS t
  FROM bk CROSS JOIN bh CROSS JOIN range(-1, 2) i(dy) CROSS JOIN range(-1, 2) j(dx) GROUP BY block_y, block_x)
SELECT block_y, block_x, {big(_CLASS, 'class')} FROM ft JOIN sk USING (block_y, block_x)""")
def pc_wiener_classes(spark, sf_dir):
    """Each 4x4 block's class from its features and its skipped neighbours, block_y a rule for which blocks are skipped."""
    samples = plane(spark, sf_dir)
    last = samples.agg(F.floor(F.max("y") / 4)).first()[0] or 0
    block_y, block_x = F.col("block_y"), F.col("block_x")
    skipped = lambda dy, dx: F.when((7 * clip(block_y + dy, 0, last) + 3 * (block_x - block_x % 16 + clip(block_x % 16 + dx, 0, 15))) % 5 == 0, (16, 4, 1)[abs(dy) + abs(dx)]).otherwise(0)
    skips = reduce(lambda a, b: a + b, [skipped(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    found = _blocks_of(stencil.class_features(samples))
    return found.select("block_y", "block_x", stencil.class_index([F.col("vertical"), F.col("antidiagonal"), F.col("diagonal")], skips, _BASE_Q).alias("class"))


#: A filter for each of the three features.
FILTERS = [(80, [(0, 1, 10), (1, 0, 8), (1, 1, 4), (2, 0, 2)]), (96, [(1, 0, 12), (0, 2, 4)]), (72, [(0, 1, 12), (1, -1, 10), (2, 2, 6)])]
_TAPS = ", ".join(f"({n}, {dy}, {dx}, {c})" for n, (_, taps) in enumerate(FILTERS) for dy, dx, c in taps)


@query(f"""WITH {_FEATURES}, kd AS (SELECT block_y, block_x, CASE WHEN f0 >= f1 AND f0 >= f2 THEN 0 WHEN f1 >= f2 THEN 1 ELSE 2 END AS k FROM ft), taps(k, dy, dx, c) AS (VALUES {_TAPS}),
pk AS MATERIALIZED (SELECT p.y, p.x, p.v, kd.k, dy, dx, c FROM pl p JOIN kd ON kd.block_y = p.y // 4 AND kd.block_x = p.x // 4 JOIN taps ON taps.k = kd.k),
s AS (SELECT p.y, p.x, p.v, p.k, CAST(sum((a.l[p.x + dx + 7] + b.l[p.x - dx + 7]) * c) AS BIGINT) AS s FROM pk p JOIN hl a ON a.y = p.y + dy JOIN hl b ON b.y = p.y - dy GROUP BY p.y, p.x, p.v, p.k)
SELECT y, x, {big(f'greatest(0, least(255, (v * [{", ".join(str(c) for c, _ in FILTERS)}][k + 1] + s + 64) >> 7))', 'filtered')} FROM s""")
def pc_wiener_filter(spark, sf_dir):
    return stencil.spread_band(stencil.classified_filter(plane(spark, sf_dir), FILTERS), "filtered", width=WIDTH)


_CHROMA, _LUMA = [(0, 1, 10), (1, 0, -6), (1, 1, 4)], [(0, 1, 5), (0, -1, -3), (1, 0, 7), (-1, 0, 2)]
_C = lambda t: f"(({t}.v * 5 + {t}.cy * 3 + {t}.cx) % 256)"


@query(f"""WITH {_PAD}, ct(dy, dx, c) AS (VALUES {', '.join(map(str, _CHROMA))}), lt(dy, dx, c) AS (VALUES {', '.join(map(str, _LUMA))}), h AS (SELECT hp.* FROM hp JOIN pl ON pl.y = hp.y AND pl.x = hp.x),
a AS (SELECT h.y, h.x, CAST(sum(({_C('p')} + {_C('q')} - 2 * {_C('h')}) * c) AS BIGINT) AS s FROM h CROSS JOIN ct JOIN hp p ON p.y = h.y + dy AND p.x = h.x + dx JOIN hp q ON q.y = h.y - dy AND q.x = h.x - dx GROUP BY h.y, h.x),
b AS (SELECT h.y, h.x, CAST(sum((p.v - h.v) * c) AS BIGINT) AS s FROM h CROSS JOIN lt JOIN hp p ON p.y = h.y + dy AND p.x = h.x + dx GROUP BY h.y, h.x)
SELECT h.y, h.x, {big(f'greatest(0, least(255, (128 * {_C("h")} + a.s + b.s + 64) >> 7))', 'filtered')} FROM h JOIN a ON a.y = h.y AND a.x = h.x JOIN b ON b.y = h.y AND b.x = h.x""")
def wiener_chroma(spark, sf_dir):
    """A chroma plane, derived from the luma's samples and their places, under taps on itself and on the luma."""
    import numpy as np

    found = stencil.wiener_with_luma(plane(spark, sf_dir), lambda y, line: (line * 5 + y * 3 + np.arange(len(line))) % 256, _CHROMA, _LUMA)
    return spread_line(found, "filtered")


_TILES = f"{PL}, w AS (SELECT min(mx + 1) // 8 * 8 AS w FROM lw), px AS (SELECT (y // 8) * 1000 + x // 8 AS b, y % 8 AS y, x % 8 AS x, v FROM pl CROSS JOIN sz CROSS JOIN w WHERE x < w AND y < (my + 1) // 8 * 8)"
_DIRECTIONS = ", ".join(f"({d}, {k}, {y}, {x})" for d, two in enumerate(loopfilter.DIRECTIONS) for k, (y, x) in enumerate(two))


@query(f"""WITH {_TILES}{DIRECTION[len(PX):]}, taps(d, k, dy, dx) AS (VALUES {_DIRECTIONS}), turns(turn, strength, shift) AS (VALUES (0, 4, 3), (2, 2, 4), (6, 2, 4)), signs(s) AS (VALUES (1), (-1)),
ps AS (SELECT pl.*, dir.d FROM pl LEFT JOIN dir ON dir.b = (pl.y // 8) * 1000 + pl.x // 8),
n AS (SELECT p.y, p.x, p.v, t.v - p.v AS diff, t.v AS there, strength, shift, CASE WHEN turn = 0 THEN CASE k WHEN 0 THEN 4 ELSE 2 END ELSE 2 - k END AS weight
  FROM ps p CROSS JOIN turns CROSS JOIN signs JOIN taps ON taps.d = (p.d + turn) % 8 JOIN pl t ON t.y = p.y + s * dy AND t.x = p.x + s * dx WHERE p.d IS NOT NULL),
c AS (SELECT y, x, v, CAST(sum(weight * sign(diff) * least(abs(diff), greatest(0, strength - (abs(diff) >> shift)))) AS BIGINT) AS s, min(there) AS low, max(there) AS high FROM n GROUP BY y, x, v)
SELECT y, x, {big('greatest(least(v, low), least(greatest(v, high), v + ((s - CASE WHEN s < 0 THEN 1 ELSE 0 END + 8) >> 4)))', 'cdef')} FROM c UNION ALL SELECT y, x, v FROM ps WHERE d IS NULL""")
def cdef_plane_filter(spark, sf_dir):
    return stencil.spread_band(stencil.cdef_plane(plane(spark, sf_dir), 4, 2), "cdef", width=WIDTH)


_PLACES = ", ".join(f"({k}, {dy}, {dx})" for k, (dy, dx) in enumerate(loopfilter.CCSO_PLACES))
_SCORE = lambda d: f"CASE WHEN {d} > 8 AND place % 2 = 0 THEN 2 WHEN {d} < -8 THEN 0 ELSE 1 END"


@query(f"""WITH {PL}, places(place, dy, dx) AS (VALUES {_PLACES}), n AS (SELECT p.*, place, coalesce(a.v, p.v) - p.v AS a, coalesce(b.v, p.v) - p.v AS b FROM pl p CROSS JOIN places LEFT JOIN pl a ON a.y = p.y + dy AND a.x = p.x + dx LEFT JOIN pl b ON b.y = p.y - dy AND b.x = p.x - dx),
s AS (SELECT *, 32 * {_SCORE('a')} + 8 * {_SCORE('b')} + (v >> 6) AS i FROM n) SELECT {big('place', 'place')}, y, x, {big('greatest(0, least(255, v + (i * 5) % 15 - 7))', 'ccso')} FROM s""")
def ccso_places(spark, sf_dir):
    """Each of the seven places that a frame may choose, the odd ones with one-sided scores."""
    packed = lines(plane(spark, sf_dir))
    found = [spread_line(loopfilter.ccso(packed, CCSO, taps=place, two_sided=k % 2 == 0), "ccso").withColumn("place", F.lit(k).cast("bigint")) for k, place in enumerate(loopfilter.CCSO_PLACES)]
    return reduce(lambda a, b: a.unionByName(b), found)


def _wide_sql(q: int, side: int) -> str:
    p = lambda y, d: f"r[{8 * y + d + 1}]" if d >= 0 else f"l[{8 * y + 8 + d + 1}]"
    mult = lambda t, w: f"[{', '.join(map(str, t))}][greatest({w}, 1)]"

    def width(g: int) -> str:
        mean = lambda f: f"(({f(g)} + {f(g + 3)} + 1) >> 1)"
        sec = {d: mean(lambda y, d=d: f"abs({p(y, d - 1)} - 2 * {p(y, d)} + {p(y, d + 1)})") for d in range(-2, 2)}
        high, across = f"greatest({sec[-2]}, {sec[1]})", f"({sec[-1]} + {sec[0]})"
        line = lambda k: f"greatest({mean(lambda y: f'abs({p(y, -1)} - {p(y, -1 - k)} - {k} * ({p(y, -1)} - {p(y, -2)}))')}, {mean(lambda y: f'abs({p(y, 0)} - {p(y, k)} - {k} * ({p(y, 0)} - {p(y, 1)}))')})"
        return f"""CASE WHEN {high} > {side} THEN 0 WHEN {high} > {side >> 2} OR {across} > {4 * q} THEN 1 WHEN {high} > {side >> 3} OR {across} > {3 * q} OR {line(3)} > {side * 3 >> 4} THEN 2
          WHEN {across} * 16 > {q * 45} OR {line(4)} > {side * 4 >> 4} THEN 3 WHEN {across} * 16 > {q * 40} OR {line(6)} > {side * 6 >> 4} THEN 4 WHEN {across} * 16 > {q * 32} OR {line(7)} > {side * 8 >> 4} THEN 6 ELSE 8 END"""

    deltas = ", ".join(f"greatest(-{q} * {mult(loopfilter.Q_MULT, f'w{y // 4}')}, least({q} * {mult(loopfilter.Q_MULT, f'w{y // 4}')}, 4 * (3 * ({p(y, 0)} - {p(y, -1)}) - ({p(y, 1)} - {p(y, -2)}))))" for y in range(8))
    ramp = mult(loopfilter.W_MULT, "e.w")
    return f"""WITH {PQ}, a AS (SELECT b, list(v ORDER BY y, x) AS l, list(w ORDER BY y, x) AS r FROM pq GROUP BY b), w AS (SELECT *, {width(0)} AS w0, {width(4)} AS w1 FROM a), d AS (SELECT b, w0, w1, [{deltas}] AS d FROM w),
e AS (SELECT pq.b, pq.y, pq.x, pq.v, pq.w AS v2, CASE WHEN y < 4 THEN w0 ELSE w1 END AS w, d[CAST(y + 1 AS BIGINT)] AS d, w0, w1 FROM pq JOIN d ON d.b = pq.b)
SELECT b AS block_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(w0 AS BIGINT) AS filter_width, CAST(w1 AS BIGINT) AS filter_width2,
  CAST(CASE WHEN e.w > 7 - x THEN greatest(0, least(255, v + ((d * {ramp} * (e.w - (7 - x)) + 1024) >> 11))) ELSE v END AS BIGINT) AS "left",
  CAST(CASE WHEN e.w > x THEN greatest(0, least(255, v2 - ((d * {ramp} * (e.w - x) + 1024) >> 11))) ELSE v2 END AS BIGINT) AS "right" FROM e"""


@query(_wide_sql(60, 1200))
def deblock_wide(spark, sf_dir):
    """Filters of up to eight samples on both sides, decided for each group of four lines."""
    found = loopfilter.deblock(pairs(spark, sf_dir), 60, 1200, most=8, groups=(0, 4))
    return spread_block(found, "left", "right", keep=("filter_width", "filter_width2"))


@query(f"WITH q AS ({_Q}), s(i, m) AS (VALUES {_STEPS}), c AS (SELECT *, greatest(0, least(255, q + 8 * delta)) AS c FROM q) SELECT l_orderkey, l_linenumber, l_partkey, CAST((CASE WHEN c = 0 THEN 64 ELSE m * (1 << ((c - 1) // 24)) END + 4) >> 9 AS BIGINT) AS threshold FROM c LEFT JOIN s ON s.i = (c - 1) % 24")
def deblock_thresholds(spark, sf_dir):
    index = F.floor("l_quantity").cast("bigint") * 7 + 8 * (F.col("l_suppkey") % 41 - 20)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", loopfilter.q_threshold(index).alias("threshold"))
