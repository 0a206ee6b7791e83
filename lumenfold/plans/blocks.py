"""Queries over 8x8 blocks, each with the DuckDB SQL that it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inter, intra, loopfilter, transform
from ..sources.planes import blocks, hold, pairs, read, spread_block

PX = "px AS (SELECT vec_id AS b, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(greatest(0, least(255, floor((CAST(embedding[i] AS DOUBLE) + 0.6) * 212.5))) AS BIGINT) AS v FROM embeddings, range(1, 65) r(i))"
PQ = f"{PX}, pq AS (SELECT p.b, p.y, p.x, p.v, q.v AS w FROM px p JOIN px q ON q.b = p.b + 1 AND q.y = p.y AND q.x = p.x)"
EDGES = f"{PX}, t AS (SELECT b, x, v FROM px WHERE y = 0), l AS (SELECT b, y, v FROM px WHERE x = 0), e AS (SELECT px.b, px.y, px.x, px.v, t.v AS t, l.v AS l FROM px JOIN t ON t.b = px.b AND t.x = px.x JOIN l ON l.b = px.b AND l.y = px.y)"
COLS = "b AS block_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def big(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"


@query(f"WITH {PX} SELECT {COLS}, v FROM px")
def pixelise_blocks(spark, sf_dir):
    return spread_block(blocks(spark, sf_dir).withColumnRenamed("px", "v"), "v")


_DIRECTIONS = "(VALUES (0), (1), (2), (3), (4), (5), (6), (7)) d(d)"
_LINE = "CASE d WHEN 0 THEN y + x WHEN 1 THEN y + x // 2 WHEN 2 THEN y WHEN 3 THEN 3 + y - x // 2 WHEN 4 THEN 7 + y - x WHEN 5 THEN 3 - y // 2 + x WHEN 6 THEN x ELSE y // 2 + x END"
DIRECTION = f"{PX}, ls AS (SELECT b, d, {_LINE} AS k, sum(v - 128) AS s, count(*) AS n FROM px, {_DIRECTIONS} GROUP BY ALL), cs AS (SELECT b, d, sum(s * s * (840 // n)) AS c FROM ls GROUP BY ALL), bs AS (SELECT b, arg_max(d, c * 8 + 7 - d) AS d, max(c) AS c FROM cs GROUP BY b), dir AS (SELECT bs.b, bs.d, (CAST(bs.c AS BIGINT) - CAST(cs.c AS BIGINT)) >> 10 AS var FROM bs JOIN cs ON cs.b = bs.b AND cs.d = xor(bs.d, 4))"


@query(f"WITH {DIRECTION} SELECT b AS block_id, {big('d', 'direction')}, {big('var', 'variance')} FROM dir")
def cdef_direction(spark, sf_dir):
    return loopfilter.cdef_direction(blocks(spark, sf_dir)).select("block_id", F.col("direction").cast("bigint").alias("direction"), F.col("variance").cast("bigint").alias("variance"))


_TAPS = ", ".join(f"({d}, {k}, {y}, {x})" for d, two in enumerate(loopfilter.DIRECTIONS) for k, (y, x) in enumerate(two))
_CDEF = f"""WITH {DIRECTION}, taps(d, k, dy, dx) AS (VALUES {_TAPS}),
turns(turn, strength, shift) AS (VALUES (0, 4, 3), (2, 2, 4), (6, 2, 4)), signs(s) AS (VALUES (1), (-1)),
n AS (SELECT px.b, px.y, px.x, px.v, t.v - px.v AS diff, t.v AS there, strength, shift, CASE WHEN turn = 0 THEN CASE k WHEN 0 THEN 4 ELSE 2 END ELSE 2 - k END AS weight
  FROM px JOIN dir ON dir.b = px.b CROSS JOIN turns CROSS JOIN signs JOIN taps ON taps.d = (dir.d + turn) % 8 JOIN px t ON t.b = px.b AND t.y = px.y + s * dy AND t.x = px.x + s * dx),
c AS (SELECT b, y, x, v, sum(weight * sign(diff) * least(abs(diff), greatest(0, strength - (abs(diff) >> shift)))) AS s, min(there) AS low, max(there) AS high FROM n GROUP BY ALL)
SELECT {COLS}, {big('greatest(least(v, low), least(greatest(v, high), v + ((CAST(s AS BIGINT) - CASE WHEN s < 0 THEN 1 ELSE 0 END + 8) >> 4)))', 'v')} FROM c"""


@query(_CDEF)
def cdef_constrain_filter(spark, sf_dir):
    found = loopfilter.cdef_direction(blocks(spark, sf_dir))
    return spread_block(loopfilter.cdef_filter(found, 4, 2).select("block_id", F.col("cdef").alias("v")), "v")


@query(f"WITH {DIRECTION} SELECT b AS block_id, CASE WHEN var = 0 THEN 0 ELSE (10 * (4 + CASE WHEN var >> 6 > 0 THEN least(length(bin(var >> 6)) - 1, 12) ELSE 0 END) + 8) >> 4 END AS strength FROM dir")
def cdef_luma_strength(spark, sf_dir):
    return loopfilter.cdef_direction(blocks(spark, sf_dir)).select("block_id", loopfilter.luma_strength(10, F.col("variance")).alias("strength"))


@query(f"WITH {EDGES} SELECT b AS block_id, {big('(sum(t) FILTER (WHERE y = 0) + sum(l) FILTER (WHERE x = 0) + 8)::BIGINT >> 4', 'dc')}, {big('(sum(t) FILTER (WHERE y = 0) + 4)::BIGINT >> 3', 'dc_top')}, {big('(sum(l) FILTER (WHERE x = 0) + 4)::BIGINT >> 3', 'dc_left')} FROM e GROUP BY b")
def dc_pred(spark, sf_dir):
    return intra.dc(intra.with_edges(blocks(spark, sf_dir))).select("block_id", *[F.col(c).cast("bigint").alias(c) for c in ("dc", "dc_top", "dc_left")])


@query(f"WITH {EDGES} SELECT {COLS}, t AS v, l AS h FROM e")
def vertical_horizontal_pred(spark, sf_dir):
    return spread_block(intra.vertical_horizontal(intra.with_edges(blocks(spark, sf_dir))), "v", "h")


@query(f"WITH {EDGES}, k AS (SELECT e.*, px.v AS c FROM e JOIN px ON px.b = e.b AND px.y = 0 AND px.x = 0) SELECT {COLS}, CASE WHEN abs(t - c) <= abs(l - c) AND abs(t - c) <= abs(l + t - 2 * c) THEN l WHEN abs(l - c) <= abs(l + t - 2 * c) THEN t ELSE c END AS paeth FROM k")
def paeth_pred(spark, sf_dir):
    return spread_block(intra.paeth(intra.with_edges(blocks(spark, sf_dir))), "paeth")


_W = "CASE {0} WHEN 0 THEN 32 WHEN 1 THEN 16 WHEN 2 THEN 8 WHEN 3 THEN 4 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 0 END"
_SMOOTH = f"{EDGES}, f AS (SELECT e.*, b1.v AS bottom, r1.v AS right_ FROM e JOIN l b1 ON b1.b = e.b AND b1.y = 7 JOIN t r1 ON r1.b = e.b AND r1.x = 7), g AS (SELECT *, bottom + (((t - bottom) * (7 - y) + 4) >> 3) AS pv, right_ + (((l - right_) * (7 - x) + 4) >> 3) AS ph FROM f), h AS (SELECT b, y, x, pv + (((t - pv) * {_W.format('y')} + 32) >> 6) AS sv, ph + (((l - ph) * {_W.format('x')} + 32) >> 6) AS sh FROM g)"


@query(f"WITH {_SMOOTH} SELECT {COLS}, {big('sv', 'smooth_v')}, {big('sh', 'smooth_h')}, {big('(sv + sh + 1) >> 1', 'smooth')} FROM h")
def smooth_pred(spark, sf_dir):
    return spread_block(intra.smooth(intra.with_edges(blocks(spark, sf_dir))), "smooth_v", "smooth_h", "smooth")


@query(f"WITH {EDGES}, w AS (SELECT *, (128 * (x + 1) * 64 + ((y + 1) * 64 + (x + 1) * 64) // 2) // ((y + 1) * 64 + (x + 1) * 64) AS w FROM e) SELECT {COLS}, {big('(t * (128 - w) + l * w + 64) >> 7', 'ibp')} FROM w")
def ibp_blend(spark, sf_dir):
    return spread_block(intra.ibp(intra.with_edges(blocks(spark, sf_dir))), "ibp")


@query(f"WITH {EDGES}, o AS (SELECT b, y, x, x + (((y + 1) * 40) >> 6) AS k, (((y + 1) * 40) & 63) >> 1 AS f FROM e) SELECT o.b AS block_id, CAST(o.y AS BIGINT) AS y, CAST(o.x AS BIGINT) AS x, {big('(a.v * (32 - f) + c.v * f + 16) >> 5', 'directional')} FROM o JOIN t a ON a.b = o.b AND a.x = least(7, k) JOIN t c ON c.b = o.b AND c.x = least(7, k + 1)")
def directional_pred(spark, sf_dir):
    return spread_block(intra.directional(intra.with_edges(blocks(spark, sf_dir))), "directional")


_EDGE_KERNELS = "(VALUES (1, -1, 4), (1, 0, 8), (1, 1, 4), (2, -1, 5), (2, 0, 6), (2, 1, 5), (3, -2, 2), (3, -1, 4), (3, 0, 4), (3, 1, 4), (3, 2, 2)) k(k, d, w)"


@query(f"WITH {EDGES}, s AS (SELECT t.b, t.x, k, (CAST(sum(n.v * w) AS BIGINT) + 8) >> 4 AS v FROM t CROSS JOIN {_EDGE_KERNELS} JOIN t n ON n.b = t.b AND n.x = greatest(0, least(7, t.x + d)) GROUP BY ALL) SELECT b AS block_id, CAST(x AS BIGINT) AS x, {', '.join(big(f'max(v) FILTER (WHERE k = {k})', f'edge{k}') for k in (1, 2, 3))} FROM s GROUP BY b, x")
def edge_filter(spark, sf_dir):
    found = intra.filtered_edge(intra.with_edges(blocks(spark, sf_dir)))
    return spread_block(found.select("block_id", "edge1", "edge2", "edge3"), "edge1", "edge2", "edge3").drop("y")


@query(f"WITH {PX}, m AS (SELECT b, min(v) AS lo, max(v) AS hi FROM px GROUP BY b) SELECT px.b AS block_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, {big('lo + ((hi - lo) * (v >> 5) + 3) // 7', 'palette')} FROM px JOIN m ON m.b = px.b")
def palette_pred(spark, sf_dir):
    return spread_block(intra.palette(blocks(spark, sf_dir)), "palette")


@query(f"WITH {PQ}, m AS (SELECT b, (CAST(sum(v * 8) AS BIGINT) + 32) >> 6 AS mean, (CAST(sum(w) AS BIGINT) + 32) >> 6 AS dc FROM pq GROUP BY b), s AS (SELECT pq.b, y, x, dc, (b_.a) * (v * 8 - mean) AS k FROM pq JOIN m ON m.b = pq.b JOIN (SELECT DISTINCT b, b % 33 - 16 AS a FROM pq) b_ ON b_.b = pq.b) SELECT {COLS}, {big('greatest(0, least(255, dc + CASE WHEN k < 0 THEN -((1024 - k) >> 11) ELSE (k + 1024) >> 11 END))', 'cfl')} FROM s")
def cfl_predict(spark, sf_dir):
    return spread_block(intra.chroma_from_luma(pairs(spark, sf_dir)), "cfl")


@query(f"WITH {PQ} SELECT b AS block_id, {big('64 * sum(v * w) - sum(v) * sum(w)', 'num')}, {big('64 * sum(v * v) - sum(v) * sum(v)', 'den')} FROM pq GROUP BY b")
def cfl_implicit_alpha(spark, sf_dir):
    return intra.implicit_alpha(pairs(spark, sf_dir)).select("block_id", "num", "den")


@query(f"WITH {PX} SELECT {COLS}, {big('greatest(0, least(255, ((200 + b % 100) * v + 128 * (b % 16)) >> 8))', 'morph')} FROM px")
def morph_linear(spark, sf_dir):
    return spread_block(intra.linear_morph(blocks(spark, sf_dir)), "morph")


@query(f"WITH {PX} SELECT {COLS}, {big('sum(v - 128) OVER (PARTITION BY b, y ORDER BY x)', 'dpcm')} FROM px")
def dpcm_lines(spark, sf_dir):
    return spread_block(intra.dpcm(blocks(spark, sf_dir)), "dpcm")


def _weights(m: list[list[int]], name: str) -> str:
    return f"{name}(k, j, w) AS (VALUES {', '.join(f'({k}, {j}, {w})' for k, row in enumerate(m) for j, w in enumerate(row))})"


def _transform_sql(rows, columns, n, middle, last):
    return f"""WITH {PX}, {_weights(rows, 'rm')}, {_weights(columns, 'cm')},
f AS (SELECT b, y, k AS x, greatest(-32768, least(32767, (CAST(sum((v - 128) * w) AS BIGINT) + {(1 << middle) >> 1}) >> {middle})) AS v FROM px JOIN rm ON rm.j = px.x WHERE px.y < {n} AND px.x < {n} GROUP BY b, y, k),
g AS (SELECT b, k AS y, x, (CAST(sum(v * w) AS BIGINT) + {(1 << last) >> 1}) >> {last} AS v FROM f JOIN cm ON cm.j = f.y GROUP BY b, k, x)
SELECT {COLS}, {big('v', 'v')} FROM g"""


def _transform(spark, sf_dir, rows, columns, n, middle, last):
    df = transform.coefficients(blocks(spark, sf_dir))
    if n < 8:
        df = hold(df.withColumnRenamed("coef", "all"), coef=transform.corner("all", n))
    return spread_block(transform.separable(df, "coef", rows, columns, n, middle, last).select("block_id", F.col("residual").alias("v")), "v", width=n)


@query(_transform_sql(transform.dct_matrix(4), transform.dct_matrix(4), 4, 7, 8))
def idct4_2d(spark, sf_dir):
    return _transform(spark, sf_dir, transform.dct_matrix(4), transform.dct_matrix(4), 4, 7, 8)


@query(_transform_sql(transform.dct_matrix(8), transform.dct_matrix(8), 8, 7, 8))
def idct8_2d(spark, sf_dir):
    return _transform(spark, sf_dir, transform.dct_matrix(8), transform.dct_matrix(8), 8, 7, 8)


@query(_transform_sql(transform.ADST4, transform.dct_matrix(4), 4, 7, 8))
def adst4_dct4_2d(spark, sf_dir):
    return _transform(spark, sf_dir, transform.ADST4, transform.dct_matrix(4), 4, 7, 8)


@query(_transform_sql(transform.FLIPADST4, transform.ADST4, 4, 7, 8))
def flipadst4_2d(spark, sf_dir):
    return _transform(spark, sf_dir, transform.FLIPADST4, transform.ADST4, 4, 7, 8)


def _diagonal(n):
    return [[transform.IDENTITY[n] * (i == j) for j in range(n)] for i in range(n)]


@query(_transform_sql(_diagonal(8), _diagonal(8), 8, 7, 8))
def identity8_2d(spark, sf_dir):
    return _transform(spark, sf_dir, _diagonal(8), _diagonal(8), 8, 7, 8)


def _wht_sql():
    def lift(a, b, c, d):
        half = f"(({a} + {b} - {c} + {d}) >> 1)"
        return [f"({a} + {b} + {d} - {half})", f"({half} - {d})", f"({half} - {b})", f"({c} - {d} - {b} + {half})"]

    wide = ", ".join(f"max((v - 128) >> 3) FILTER (WHERE y = {y} AND x = {x}) AS i{4 * y + x}" for y in range(4) for x in range(4))
    lines = ", ".join(f"{e} AS t{4 * y + x}" for y in range(4) for x, e in enumerate(lift(*[f"i{4 * y + k}" for k in range(4)])))
    columns = ", ".join(f"{lift(*[f't{4 * k + x}' for k in range(4)])[y]} AS o{4 * y + x}" for y in range(4) for x in range(4))
    out = ", ".join(f"({y}, {x}, o{4 * y + x})" for y in range(4) for x in range(4))
    return f"WITH {PX}, a AS (SELECT b, {wide} FROM px WHERE y < 4 AND x < 4 GROUP BY b), c AS (SELECT b, {lines} FROM a), d AS (SELECT b, {columns} FROM c) SELECT {COLS}, {big('v', 'wht')} FROM d, LATERAL (VALUES {out}) o(y, x, v)"


@query(_wht_sql())
def wht4x4(spark, sf_dir):
    df = hold(transform.coefficients(blocks(spark, sf_dir)), c4=transform.corner("coef"))
    return spread_block(transform.walsh_hadamard(df), "wht", width=4)


#: A kernel for the secondary transform, 16 inputs and outputs, from a cosine rule.
def _secondary_kernel():
    from math import cos, pi

    return [[round(45 * cos(pi * (2 * x + 1) * y / 32)) if y else 32 for x in range(16)] for y in range(16)]


@query(f"WITH {PX}, {_weights(_secondary_kernel(), 'm')}, s AS (SELECT b, j AS pos, CAST(sum((v - 128) * w) AS BIGINT) AS s FROM px JOIN m ON m.k = px.y * 8 + px.x GROUP BY b, j) SELECT b AS block_id, {big('pos', 'pos')}, {big('greatest(-32768, least(32767, CASE WHEN s < 0 THEN -((64 - s) >> 7) ELSE (s + 64) >> 7 END))', 'v')} FROM s")
def secondary_tx(spark, sf_dir):
    found = transform.secondary(transform.coefficients(blocks(spark, sf_dir)), _secondary_kernel())
    return found.select("block_id", F.posexplode("secondary").alias("pos", "v")).select("block_id", F.col("pos").cast("bigint").alias("pos"), "v")


_CC = "SELECT b, y, x, v - 128 AS u, w - 128 AS v, b % 256 - 128 AS s, 200 - b % 100 AS c FROM pq"
_HALF = lambda e: f"greatest(-32768, least(32767, ({e} + 128 - CASE WHEN {e} < 0 THEN 1 ELSE 0 END) >> 8))"


@query(f"WITH {PQ}, r AS ({_CC}) SELECT {COLS}, {big(_HALF('(u * c - v * s)'), 'u')}, {big(_HALF('(u * s + v * c)'), 'v')} FROM r")
def cctx_rotate(spark, sf_dir):
    df = transform.coefficients(transform.coefficients(pairs(spark, sf_dir)), "px2", "coef2")
    return spread_block(transform.rotate_chroma(df, F.col("block_id") % 256 - 128, 200 - F.col("block_id") % 100), "u", "v")


@query(f"WITH {PQ} SELECT {COLS}, {big('greatest(0, least(255, v + ((w - 128 + 8) >> 4)))', 'sum')} FROM pq")
def residual_add(spark, sf_dir):
    return spread_block(transform.add_residual(transform.coefficients(pairs(spark, sf_dir), "px2"), "coef"), "sum")


_Q = "SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_quantity) AS BIGINT) * 7 AS q, l_suppkey % 41 - 20 AS delta FROM lineitem"
_STEPS = ", ".join(f"({i}, {s})" for i, s in enumerate(transform.STEPS))


@query(f"WITH q AS ({_Q}), s(i, m) AS (VALUES {_STEPS}) SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN q = 0 AND delta <= 0 THEN 0 ELSE greatest(1, least(255, q + delta)) END AS BIGINT) AS clipped, CAST(CASE WHEN q = 0 THEN 64 ELSE m * (1 << ((least(q, 351) - 1) // 24)) END AS BIGINT) AS step FROM q LEFT JOIN s ON s.i = (least(q, 351) - 1) % 24")
def dequant_step(spark, sf_dir):
    q = F.floor("l_quantity").cast("bigint") * 7
    delta = F.col("l_suppkey") % 41 - 20
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", transform.clip_qindex(q, delta).alias("clipped"), transform.dequant_step(q).alias("step"))


@query(f"WITH {PQ} SELECT b AS block_id, {big('sum(abs(v - w))', 'sad')}, {big('sum(abs(v - w)) FILTER (WHERE y % 2 = 0)', 'sad_even')} FROM pq GROUP BY b")
def sad_8x8(spark, sf_dir):
    return pairs(spark, sf_dir).select("block_id", inter.sad().alias("sad"), inter.sad_alternate_lines().alias("sad_even"))


@query(f"WITH {PX}, s AS (SELECT p.b, q.b AS o, sum(abs(p.v - q.v)) AS s FROM px p JOIN px q ON q.b BETWEEN p.b + 1 AND p.b + 4 AND q.y = p.y AND q.x = p.x GROUP BY ALL) SELECT b AS block_id, {big('arg_min(o, s * 10000000 + o)', 'best')}, {big('min(s)', 'sad')} FROM s GROUP BY b")
def sad_argmin(spark, sf_dir):
    return inter.best_match(blocks(spark, sf_dir))


_M = lambda m: f"(v * {m} + w * (64 - {m}) + 32) >> 6"


@query(f"WITH {PQ} SELECT {COLS}, {big('(v + w + 1) >> 1', 'avg')}, {big('(v * (b % 15 + 1) + w * (16 - (b % 15 + 1)) + 8) >> 4', 'weighted')}, {big(_M('(y * 4 + x * 4)'), 'masked')}, {big(_M('least(38 + ((abs(v - w) + 8) >> 4), 64)'), 'by_difference')} FROM pq")
def compound_blend(spark, sf_dir):
    return spread_block(inter.compound(pairs(spark, sf_dir)), "avg", "weighted", "masked", "by_difference")


@query(f"WITH {PQ}, m AS (SELECT *, greatest(0, least(64, 32 + 4 * (2 * x - 7) + (b % 9 - 4) * (2 * y - 7))) AS m FROM pq) SELECT {COLS}, {big(_M('m'), 'wedge')} FROM m")
def wedge_blend(spark, sf_dir):
    return spread_block(inter.wedge(pairs(spark, sf_dir)), "wedge")


@query(f"WITH {PX} SELECT p.b AS block_id, CAST(p.y AS BIGINT) AS y, CAST(p.x AS BIGINT) AS x, {big('(16 * p.v + 5 * (q.v - p.v) + 8) >> 4', 'bilinear')} FROM px p JOIN px q ON q.b = p.b AND q.y = p.y AND q.x = least(7, p.x + 1)")
def bilinear_mc(spark, sf_dir):
    return spread_block(inter.bilinear(blocks(spark, sf_dir)), "bilinear")


_HALF_TAPS = ", ".join(f"({k - 3}, {w})" for k, w in enumerate(inter.HALF))


@query(f"WITH {PX}, taps(d, w) AS (VALUES {_HALF_TAPS}), h AS (SELECT p.b, p.y, p.x, (CAST(sum(q.v * w) AS BIGINT) + 64) >> 7 AS v FROM px p CROSS JOIN taps JOIN px q ON q.b = p.b AND q.y = p.y AND q.x = greatest(0, least(7, p.x + d)) GROUP BY ALL), f AS (SELECT p.b, p.y, p.x, (CAST(sum(q.v * w) AS BIGINT) + 64) >> 7 AS v FROM h p CROSS JOIN taps JOIN h q ON q.b = p.b AND q.x = p.x AND q.y = greatest(0, least(7, p.y + d)) GROUP BY ALL) SELECT {COLS}, {big('greatest(0, least(255, v))', 'eight_tap')} FROM f")
def eight_tap_mc(spark, sf_dir):
    return spread_block(inter.eight_tap(blocks(spark, sf_dir)), "eight_tap")


def _deblock_sql(q, side):
    p = lambda y, d: f"r[{8 * y + d + 1}]" if d >= 0 else f"l[{8 * y + 8 + d + 1}]"
    mean = lambda f: f"(({f(0)} + {f(3)} + 1) >> 1)"
    sec = {d: mean(lambda y, d=d: f"abs({p(y, d - 1)} - 2 * {p(y, d)} + {p(y, d + 1)})") for d in range(-2, 2)}
    straight = lambda k: f"greatest({mean(lambda y: f'abs({p(y, -1)} - {p(y, -1 - k)} - {k} * ({p(y, -1)} - {p(y, -2)}))')}, {mean(lambda y: f'abs({p(y, 0)} - {p(y, k)} - {k} * ({p(y, 0)} - {p(y, 1)}))')})"
    mult = lambda t: f"[{', '.join(map(str, t))}][greatest(w, 1)]"
    lines = ", ".join(f"greatest(-{q} * {mult(loopfilter.Q_MULT)}, least({q} * {mult(loopfilter.Q_MULT)}, 4 * (3 * ({p(y, 0)} - {p(y, -1)}) - ({p(y, 1)} - {p(y, -2)})))) AS d{y}" for y in range(4))
    delta = "CASE y WHEN 0 THEN d0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END"
    ramp = mult(loopfilter.W_MULT)
    return f"""WITH {PQ}, a AS (SELECT b, list(v ORDER BY y, x) AS l, list(w ORDER BY y, x) AS r FROM pq GROUP BY b),
h AS (SELECT *, greatest({sec[-2]}, {sec[1]}) AS high, {sec[-1]} + {sec[0]} AS ac, {straight(3)} AS s3, {straight(4)} AS s4 FROM a),
w AS (SELECT *, CASE WHEN high > {side} THEN 0 WHEN high > {side >> 2} OR ac > {4 * q} THEN 1 WHEN high > {side >> 3} OR ac > {3 * q} OR s3 > {(side * 3) >> 4} THEN 2 WHEN ac * 16 > {q * 45} OR s4 > {(side * 4) >> 4} THEN 3 ELSE 4 END AS w FROM h),
d AS (SELECT b, w, {lines} FROM w)
SELECT pq.b AS block_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(d.w AS BIGINT) AS filter_width,
  CAST(CASE WHEN y < 4 AND d.w > 7 - x THEN greatest(0, least(255, v + (({delta} * {ramp.replace('w,', 'd.w,')} * (d.w - (7 - x)) + 1024) >> 11))) ELSE v END AS BIGINT) AS "left",
  CAST(CASE WHEN y < 4 AND d.w > x THEN greatest(0, least(255, pq.w - (({delta} * {ramp.replace('w,', 'd.w,')} * (d.w - x) + 1024) >> 11))) ELSE pq.w END AS BIGINT) AS "right"
FROM pq JOIN d ON d.b = pq.b"""


@query(_deblock_sql(20, 400))
def deblock_edge(spark, sf_dir):
    return spread_block(loopfilter.deblock(pairs(spark, sf_dir), 20, 400), "left", "right", keep=("filter_width",))


_MV = "SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice) AS BIGINT) % 4096 - 2048 AS v FROM lineitem"


@query(f"""WITH m AS ({_MV}), s AS (SELECT *, abs(v) AS a, CASE WHEN v = 0 THEN 0 ELSE greatest(0, least(6, length(bin(abs(v))) - 5)) END AS n FROM m),
c AS (SELECT *, ((a - CASE WHEN n > 0 THEN 16 << n ELSE 0 END) >> n) + (n + CASE WHEN n > 0 THEN 1 ELSE 0 END) * 16 AS code, ((a >> n) << n) AS back FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, {big('CASE WHEN a < 2048 THEN CASE WHEN v < 0 THEN -code ELSE code END END', 'code')}, {big('CASE WHEN a < 2048 THEN CASE WHEN v < 0 THEN -back ELSE back END END', 'back')} FROM c""")
def mv_quantize_roundtrip(spark, sf_dir):
    v = F.floor("l_extendedprice").cast("bigint") % 4096 - 2048
    rows = hold(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", v.alias("v")), code=inter.quantize_component(F.col("v")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "code", inter.dequantize_component(F.col("code")).alias("back"))


@query(f"WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice) AS BIGINT) % 4096 - 2048 AS v, l_suppkey % 71 - 35 AS num, l_linenumber - 1 AS den FROM lineitem), p AS (SELECT *, v * greatest(-31, least(31, num)) * CASE WHEN den = 0 THEN 0 ELSE 16384 // den END AS p FROM m) SELECT l_orderkey, l_linenumber, l_partkey, {big('greatest(-32768, least(32767, (p + 8192 - CASE WHEN p < 0 THEN 1 ELSE 0 END) >> 14))', 'projected')} FROM p")
def mv_projection(spark, sf_dir):
    v = F.floor("l_extendedprice").cast("bigint") % 4096 - 2048
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", inter.project_component(v, F.col("l_suppkey") % 71 - 35, (F.col("l_linenumber") - 1).cast("bigint")).alias("projected"))


@query(f"WITH p AS (SELECT l_suppkey, CAST(floor(l_quantity) AS BIGINT) AS x, CAST(floor(l_extendedprice / 100) AS BIGINT) AS y FROM lineitem) SELECT l_suppkey, count(*) AS n, {big('count(*) * sum(x * y) - sum(x) * sum(y)', 'num')}, {big('count(*) * sum(x * x) - sum(x) * sum(x)', 'den')} FROM p GROUP BY l_suppkey")
def affine_fit(spark, sf_dir):
    points = read(spark, sf_dir, "lineitem").select("l_suppkey", F.floor("l_quantity").cast("bigint").alias("x"), F.floor(F.col("l_extendedprice") / 100).cast("bigint").alias("y"))
    return inter.affine_sums(points, "l_suppkey")
