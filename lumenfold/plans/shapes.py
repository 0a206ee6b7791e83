"""Queries over blocks of other sizes, angles and phases, each with its DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.integer import divided, shr
from ..operators import blockmath, inter, intra
from ..operators.intra import with_edges
from ..sources.planes import blocks, hold, pairs, spread_block
from .blocks import COLS, EDGES, PQ, PX, big

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


#: Samples to move for each line, or column, in units of 1/64, by the block's id.
STEPS = [4096, 1024, 372, 178, 107, 64, 40, 15, 3]
_STEP = f"[{', '.join(map(str, STEPS))}]"
_E = "ed AS (SELECT b, x + 1 AS i, v FROM px WHERE y = 0 UNION ALL SELECT b - 1, x + 9, v FROM px WHERE y = 0 UNION ALL SELECT b, -1 - y, v FROM px WHERE x = 0 UNION ALL SELECT b - 1, -9 - y, v FROM px WHERE x = 0 UNION ALL SELECT b, 0, v FROM px WHERE y = 0 AND x = 0)"


def _mix(place: str, part: str, side: int) -> str:
    """Between the edge samples number `place` and the next one of a side, counted from the corner; beyond the last, number 16, they stay there."""
    at = lambda k: f"e[CAST(17 + {side} * least(16, {k}) AS BIGINT)]"
    return f"(({at(place)} * (32 - {part}) + {at(f'{place} + 1')} * {part} + 16) >> 5)"


@query(f"""WITH {PX}, {_E}, el AS MATERIALIZED (SELECT b, list(v ORDER BY i) AS e FROM ed GROUP BY b HAVING count(*) = 33),
o AS (SELECT px.b, y, x, e, (y + 1) * {_STEP}[b % 9 + 1] AS p1, (x + 1) * {_STEP}[(b // 9) % 9 + 1] AS p3 FROM px JOIN el USING (b)),
z AS (SELECT *, 64 * x - p1 AS pt, 64 * y - p3 AS pl FROM o)
SELECT {COLS}, {big(_mix('((p1 >> 6) + x + 1)', '((p1 & 63) >> 1)', 1), 'top_only')}, {big(_mix('((p3 >> 6) + y + 1)', '((p3 & 63) >> 1)', -1), 'left_only')},
  {big(f"CASE WHEN pt < -64 THEN {_mix('(greatest(pl >> 6, -1) + 1)', '((pl & 63) >> 1)', -1)} ELSE {_mix('(greatest(pt >> 6, -1) + 1)', '((pt & 63) >> 1)', 1)} END", 'either')} FROM z""")
def directional_zones(spark, sf_dir):
    """All three zones of directional prediction, the steps from the block's id; the next block's edges continue a block's own."""
    line = lambda of, step: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.col(of)[k * step])
    left = F.reverse(F.concat(line("px", 8), line("px2", 8)))
    table = F.array(*map(F.lit, STEPS))
    df = pairs(spark, sf_dir).withColumns({"edges": F.concat(left, F.slice("px", 1, 1), F.slice("px", 1, 8), F.slice("px2", 1, 8)), "dx": F.get(table, (F.col("block_id") % 9).cast("int")), "dy": F.get(table, (F.floor(F.col("block_id") / 9) % 9).cast("int"))})
    return spread_block(blockmath.over_blocks(df, ["edges"], ["dx", "dy"], blockmath.directional, "top_only, either, left_only"), "top_only", "either", "left_only")


#: Widths and heights of transforms beyond 8x8, and the shift between both passes.
SIZES = [(16, 16, 8), (32, 32, 9), (16, 8, 7), (8, 16, 7), (32, 16, 8), (16, 32, 8), (8, 32, 8)]
_SIZES = ", ".join(map(str, SIZES))
_COS = "CASE WHEN j = 0 THEN 64 WHEN abs(round(64 * sqrt(2) * cos((2 * k + 1) * j * (32 // n) * pi() / 64))) = 84 THEN 83 * sign(cos((2 * k + 1) * j * (32 // n) * pi() / 64)) ELSE round(64 * sqrt(2) * cos((2 * k + 1) * j * (32 // n) * pi() / 64)) END"


@query(f"""WITH {PX}, sizes(w, h, s) AS (VALUES {_SIZES}), cm AS (SELECT n, k, j, CAST({_COS} AS BIGINT) AS c FROM (VALUES (8), (16), (32)) n(n), range(32) k(k), range(32) j(j) WHERE k < n AND j < n),
ci AS (SELECT g * 16 + k AS b, y, x FROM (SELECT DISTINCT b // 16 AS g FROM px), range(16) k(k), range(8) y(y), range(8) x(x)),
cf AS (SELECT ci.b // 16 AS b, (ci.b % 16) * 2 + ci.y // 4 AS y, (ci.y % 4) * 8 + ci.x AS x, coalesce(px.v - 128, 0) AS v FROM ci LEFT JOIN px ON px.b = ci.b AND px.y = ci.y AND px.x = ci.x),
sc AS (SELECT b, w, h, s, y, x, CASE WHEN w = 2 * h OR h = 2 * w THEN (v * 181 + 128) >> 8 ELSE v END AS v FROM cf JOIN sizes ON x < w AND y < h),
f AS (SELECT b, w, h, s, y, k AS x, greatest(-32768, least(32767, (CAST(sum(v * c) AS BIGINT) + ((1 << s) >> 1)) >> s)) AS v FROM sc JOIN cm ON n = w AND j = x GROUP BY b, w, h, s, y, k),
g AS (SELECT b, w, h, k AS y, x, (CAST(sum(v * c) AS BIGINT) + 128) >> 8 AS v FROM f JOIN cm ON n = h AND j = y GROUP BY b, w, h, k, x)
SELECT {COLS}, w || 'x' || h AS size, {big('v', 'v')} FROM g""")
def idct_sizes_2d(spark, sf_dir):
    """Cosine transforms of 16 and 32 points, square and rectangular, over sixteen blocks' samples as one block's coefficients."""
    found = blocks(spark, sf_dir).groupBy(F.floor(F.col("block_id") / 16).cast("bigint").alias("group")).agg(F.array_sort(F.collect_list(F.struct("block_id", "px"))).alias("p"))
    member = lambda k: F.coalesce(F.get(F.filter("p", lambda q: q["block_id"] % 16 == k), F.lit(0))["px"], F.array_repeat(F.lit(128).cast("bigint"), 64))
    df = found.select(F.col("group").alias("block_id"), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), member)).alias("coef"))

    def compute(coef):
        coef = coef.reshape(-1, 32, 32) - 128
        return [blockmath.inverse_2d(coef[:, :h, :w], blockmath.cosine_matrix(w), blockmath.cosine_matrix(h), s, 8) for w, h, s in SIZES]

    names = [f"s{w}x{h}" for w, h, _ in SIZES]
    out = blockmath.over_blocks(df, ["coef"], [], compute, ", ".join(names))
    each = [spread_block(out.select("block_id", F.col(n).alias("v")), "v", width=w).withColumn("size", F.lit(f"{w}x{h}")) for n, (w, h, _) in zip(names, SIZES)]
    return reduce(lambda a, b: a.unionByName(b), each)


@query(f"""WITH {EDGES}, s(w, h) AS (VALUES (8, 8), (8, 4), (4, 8), (8, 2), (2, 8)), d AS (SELECT s.w, s.h, t.b, (SELECT 0) AS z FROM s, (SELECT DISTINCT b FROM px) t),
m AS (SELECT d.b, d.w, d.h, CAST((SELECT sum(v) FROM t WHERE t.b = d.b AND t.x < d.w) AS BIGINT) AS st, CAST((SELECT sum(v) FROM l WHERE l.b = d.b AND l.y < d.h) AS BIGINT) AS sl FROM d)
SELECT b AS block_id, w || 'x' || h AS size, {big('CASE w + h WHEN 16 THEN (st + sl + 8) >> 4 WHEN 12 THEN ((st + sl) * 341 + 2048) >> 12 ELSE ((st + sl) * 410 + 2048) >> 12 END', 'dc')}, {big('(st + w // 2) >> CASE w WHEN 8 THEN 3 WHEN 4 THEN 2 ELSE 1 END', 'dc_top')}, {big('(sl + h // 2) >> CASE h WHEN 8 THEN 3 WHEN 4 THEN 2 ELSE 1 END', 'dc_left')}, CAST(128 AS BIGINT) AS dc_none FROM m""")
def dc_pred_sizes(spark, sf_dir):
    """The rounded means of both edges of blocks of several shapes, by the reciprocal where their sum is no power of two; of one edge; and without any."""
    df = with_edges(blocks(spark, sf_dir))
    total = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0).cast("bigint"), lambda s, v: s + v)

    def one(w: int, h: int):
        top, left, n = total("top", w), total("left", h), w + h
        mean = shr(top + left + w, n.bit_length() - 1) if n & (n - 1) == 0 else divided(top + left, n)
        return df.select("block_id", F.lit(f"{w}x{h}").alias("size"), mean.alias("dc"), shr(top + w // 2, w.bit_length() - 1).alias("dc_top"), shr(left + h // 2, h.bit_length() - 1).alias("dc_left"), F.lit(128).cast("bigint").alias("dc_none"))

    return reduce(lambda a, b: a.unionByName(b), [one(w, h) for w, h in ((8, 8), (8, 4), (4, 8), (8, 2), (2, 8))])


_TAPS = ", ".join(f"({p}, {k - 3}, {w})" for p, taps in enumerate([[0, 0, 0, 64, 0, 0, 0, 0], *blockmath.PHASES]) for k, w in enumerate(taps))


@query(f"""WITH {PX}, tp(p, d, c) AS (VALUES {_TAPS}), o AS (SELECT *, b % 16 AS mx, (b // 16) % 16 AS my FROM px),
h AS (SELECT o.b, o.y, o.x, o.mx, o.my, o.v, CAST(sum(q.v * c) AS BIGINT) AS s FROM o JOIN tp ON tp.p = o.mx JOIN px q ON q.b = o.b AND q.y = o.y AND q.x = greatest(0, least(7, o.x + d)) GROUP BY ALL),
u AS (SELECT h.b, h.y, h.x, h.mx, h.my, h.v, h.s, CAST(sum(((q.s + 2) >> 2) * c) AS BIGINT) AS either, CAST(sum(q.v * c) AS BIGINT) AS down FROM h JOIN tp ON tp.p = h.my JOIN h q ON q.b = h.b AND q.x = h.x AND q.y = greatest(0, least(7, h.y + d)) GROUP BY ALL)
SELECT {COLS}, {big('greatest(0, least(255, CASE WHEN mx = 0 AND my = 0 THEN v WHEN mx = 0 THEN (down + 32) >> 6 WHEN my = 0 THEN (s + 34) >> 6 ELSE (either + 512) >> 10 END))', 'moved')} FROM u""")
def eight_tap_phases(spark, sf_dir):
    """Blocks moved by sixteenths of a sample, the phases from the block's id."""
    b = F.col("block_id")
    df = blocks(spark, sf_dir).withColumns({"mx": b % 16, "my": F.floor(b / 16) % 16})
    return spread_block(blockmath.over_blocks(df, ["px"], ["mx", "my"], lambda px, mx, my: [blockmath.sub_sample(px, mx, my)], "moved"), "moved")


@query(f"""WITH {PQ}, sd AS (SELECT p.b, dy, dx, sum(abs(p.v - q.w)) AS s FROM range(-2, 3) i(dy) CROSS JOIN range(-2, 3) j(dx) CROSS JOIN (VALUES (0), (2)) r(r) CROSS JOIN range(4) c(c) JOIN pq p ON p.y = 2 + dy + r AND p.x = 2 + dx + c JOIN pq q ON q.b = p.b AND q.y = 2 - dy + r AND q.x = 2 - dx + c GROUP BY ALL),
st AS (SELECT b, (s * 7 + 7) >> 3 AS stay FROM (SELECT b, CAST(s AS BIGINT) AS s FROM sd WHERE dy = 0 AND dx = 0)), mv AS (SELECT b, min(s) AS least, arg_min(dy, s * 100 + dy * 5 + dx) AS dy, arg_min(dx, s * 100 + dy * 5 + dx) AS dx FROM sd WHERE dy <> 0 OR dx <> 0 GROUP BY b)
SELECT b AS block_id, {', '.join(big(f'CASE WHEN b % 2 = 1 AND (stay < 32 OR least >= stay) THEN 0 ELSE {d} END', d) for d in ('dy', 'dx'))} FROM mv JOIN st USING (b)""")
def sad_refine(spark, sf_dir):
    """The best move of two blocks against each other within two samples; every second block may stay."""
    df = pairs(spark, sf_dir).withColumn("implicit", F.col("block_id") % 2)
    found = blockmath.over_blocks(df, ["px", "px2"], ["implicit"], lambda a, b, k: list(blockmath.refine(a, b, k)), "dy, dx")
    return found.select("block_id", F.col("dy")[0].alias("dy"), F.col("dx")[0].alias("dx"))


def _gradient(axis: str, other: str) -> str:
    at = lambda n, d: f"JOIN m {n} ON {n}.b = m.b AND {n}.{other} = m.{other} AND {n}.{axis} = greatest(0, least(7, m.{axis} + {d}))"
    g = f"(((p1.t - n1.t) * 42 - (p2.t - n2.t) * 5) * CASE WHEN m.{axis} IN (0, 7) THEN 2 ELSE 1 END)"
    return f"SELECT m.b, m.y, m.x, ({g} + 63 + CASE WHEN {g} > 0 THEN 1 ELSE 0 END) >> 7 AS g FROM m {at('n1', -1)} {at('p1', 1)} {at('n2', -2)} {at('p2', 2)}"


_FLOW = f"{PQ}, m AS (SELECT b, y, x, v - w AS e, 2 * v - w AS t FROM pq), gx AS ({_gradient('x', 'y')}), gy AS ({_gradient('y', 'x')}), fs AS (SELECT m.b, {', '.join(f'{start} + CAST(sum({e}) AS BIGINT) AS {n}' for start, e, n in ((64, 'gx.g * gx.g', 'su2'), (0, 'gx.g * gy.g', 'suv'), (64, 'gy.g * gy.g', 'sv2'), (0, 'gx.g * e', 'suw'), (0, 'gy.g * e', 'svw')))} FROM m JOIN gx ON gx.b = m.b AND gx.y = m.y AND gx.x = m.x JOIN gy ON gy.b = m.b AND gy.y = m.y AND gy.x = m.x GROUP BY m.b)"


@query(f"WITH {_FLOW} SELECT b AS block_id, su2, suv, sv2, suw, svw FROM fs")
def optical_flow_system(spark, sf_dir):
    """The 2x2 system of a block's motion, from four-tap gradients of a mix of both blocks."""
    found = blockmath.over_blocks(pairs(spark, sf_dir), ["px", "px2"], [], lambda a, b: [blockmath.flow_sums(a, b, 2, -1)], "s")
    return found.select("block_id", *[F.col("s")[i].alias(n) for i, n in enumerate(("su2", "suv", "sv2", "suw", "svw"))])


_BITS = lambda v: f"length(bin(greatest(1, abs({v}))))"
_CUT = lambda v: f"CASE WHEN r = 0 THEN {v} ELSE ({v} + ((1 << r) >> 1) - CASE WHEN {v} < 0 THEN 1 ELSE 0 END) >> r END AS {v}"
#: A reciprocal of d as (2**sh) / d: its mantissa from eight bits of d, rounded.
_RECIPROCAL = lambda d: f"65536 // (128 + f) + CASE WHEN 2 * (65536 % (128 + f)) >= 128 + f THEN 1 ELSE 0 END AS rc, sh0 + 9 AS sh FROM (SELECT *, CASE WHEN sh0 > 7 THEN ({d} - (1 << sh0) + (1 << (sh0 - 8))) >> (sh0 - 7) ELSE ({d} - (1 << sh0)) << (7 - sh0) END AS f FROM (SELECT *, length(bin({d})) - 1 AS sh0"
_SOLVED = lambda n, s: f"CASE WHEN {s} = 0 THEN 0 ELSE sign({s}) * CASE WHEN 3 + rb{n} - sh >= 0 THEN (CASE WHEN rb{n} > 0 THEN (abs({s}) + ((1 << rb{n}) >> 1)) >> rb{n} ELSE abs({s}) END) * rc * (1 << greatest(0, 3 + rb{n} - sh)) ELSE ((CASE WHEN rb{n} > 0 THEN (abs({s}) + ((1 << rb{n}) >> 1)) >> rb{n} ELSE abs({s}) END) * rc + ((1 << greatest(0, sh - 3 - rb{n})) >> 1)) >> greatest(0, sh - 3 - rb{n}) END END"


@query(f"""WITH {_FLOW}, r0 AS (SELECT *, greatest(0, greatest({_BITS('su2')} + {_BITS('sv2')}, {_BITS('sv2')} + {_BITS('suw')}, {_BITS('suv')} + {_BITS('svw')}, {_BITS('su2')} + {_BITS('svw')}, {_BITS('suv')} + {_BITS('suw')}) - 23) >> 1 AS r FROM fs),
c0 AS (SELECT b, {', '.join(map(_CUT, ('su2', 'suv', 'sv2', 'suw', 'svw')))} FROM r0), d0 AS (SELECT b, su2 * sv2 - suv * suv AS det, sv2 * suw - suv * svw AS s0, su2 * svw - suv * suw AS s1 FROM c0),
i0 AS (SELECT *, {_RECIPROCAL('det')} FROM d0 WHERE det > 0))), j0 AS (SELECT *, greatest(0, length(bin(greatest(1, abs(s0)))) - 1 + length(bin(rc)) - 1 - 22) AS rb0, greatest(0, length(bin(greatest(1, abs(s1)))) - 1 + length(bin(rc)) - 1 - 22) AS rb1 FROM i0),
k0 AS (SELECT b, {_SOLVED(0, 's0')} AS s0, {_SOLVED(1, 's1')} AS s1 FROM j0)
SELECT c0.b AS block_id, {', '.join(big(f'coalesce(greatest(-16, least(16, {k} * {s})), 0)', n) for k, s, n in ((-2, 's0', 'ax'), (-2, 's1', 'ay'), (-1, 's0', 'bx'), (-1, 's1', 'by_')))} FROM c0 LEFT JOIN k0 ON k0.b = c0.b""")
def optical_flow_vectors(spark, sf_dir):
    """The refinement of both vectors of a block that solves its system, by an integer reciprocal of the determinant, 16 at most."""
    from ..functions.integer import floor_log2, reciprocal, shifted

    names = ("su2", "suv", "sv2", "suw", "svw")
    bits = lambda c: floor_log2(F.greatest(F.lit(1), F.abs(F.col(c)))) + 1
    pair = lambda a, b: bits(a) + bits(b)
    df = hold(optical_flow_system(spark, sf_dir), r=shr(F.greatest(F.lit(0), F.greatest(pair("su2", "sv2"), pair("sv2", "suw"), pair("suv", "svw"), pair("su2", "svw"), pair("suv", "suw")) - 23), 1))
    half = lambda n: F.when(n > 0, shifted(F.lit(1), n - 1)).otherwise(0)
    cut = lambda c: F.when(F.col("r") == 0, F.col(c)).otherwise(shifted(F.col(c) + half(F.col("r")) - F.when(F.col(c) < 0, 1).otherwise(0), -F.col("r")))
    df = hold(df.select("block_id", *[cut(c).alias(c) for c in names]), det=F.col("su2") * F.col("sv2") - F.col("suv") * F.col("suv"), s0=F.col("sv2") * F.col("suw") - F.col("suv") * F.col("svw"), s1=F.col("su2") * F.col("svw") - F.col("suv") * F.col("suw"))
    df = hold(df, i=reciprocal(F.greatest(F.col("det"), F.lit(1))))

    def solved(s):
        inverse, shift, size = F.col("i.mantissa"), F.col("i.shift"), F.abs(s)
        down = F.greatest(F.lit(0), floor_log2(F.greatest(size, F.lit(1))) + floor_log2(inverse) - 22)
        up = 3 + down - shift
        small = shifted(size + half(down), -down) * inverse
        return F.sign(s).cast("bigint") * F.when(up >= 0, shifted(small, F.greatest(up, F.lit(0)))).otherwise(shifted(small + half(-up), F.least(up, F.lit(0))))

    df = hold(df, v0=solved(F.col("s0")), v1=solved(F.col("s1")))
    clip = lambda k, v: F.when(F.col("det") > 0, F.greatest(F.lit(-16), F.least(F.lit(16), k * F.col(v)))).otherwise(0).cast("bigint")
    return df.select("block_id", clip(-2, "v0").alias("ax"), clip(-2, "v1").alias("ay"), clip(-1, "v0").alias("bx"), clip(-1, "v1").alias("by_"))


_FIT = f"{PQ}, ft AS (SELECT b, CAST(64 * sum(v * w) - sum(v) * sum(w) AS BIGINT) AS num, CAST(64 * sum(v * v) - sum(v) * sum(v) AS BIGINT) AS den FROM pq GROUP BY b)"
_HEAD = lambda v, k: f"CASE WHEN {k} > 7 THEN ({v} + (1 << greatest(0, {k} - 8))) >> greatest(0, {k} - 7) ELSE {v} << greatest(0, 7 - {k}) END"


@query(f"""WITH {_FIT}, k AS (SELECT *, length(bin(greatest(1, abs(num)))) - 1 AS kn, length(bin(greatest(1, den))) - 1 AS kd FROM ft), h AS (SELECT *, {_HEAD('greatest(1, abs(num))', 'kn')} AS fn, {_HEAD('greatest(1, den) - (1 << kd)', 'kd')} AS fd FROM k WHERE kd <= 62),
a AS (SELECT b, num, den, kd - kn - 8 AS s, fn, (2 * 65536 + 128 + fd) // (2 * (128 + fd)) AS rc FROM h)
SELECT b AS block_id, {big('CASE WHEN num = 0 OR den = 0 OR s > 1 THEN 0 ELSE sign(num) * CASE WHEN 16 + s < 0 THEN 511 ELSE least(511, (rc * fn) >> greatest(0, 16 + s)) END END', 'alpha')} FROM a""")
def cfl_model_alpha(spark, sf_dir):
    """The slope of one block's samples on another's, by an integer reciprocal."""
    fitted = intra.implicit_alpha(pairs(spark, sf_dir)).select("block_id", "num", "den")
    return hold(fitted, n=F.col("num"), d=F.col("den")).select("block_id", intra.model_alpha(F.col("n"), F.col("d")).alias("alpha"))


@query(f"""WITH {PQ}, m AS (SELECT *, least(38 + ((abs(16 * v - 16 * w) + 8) >> 8), 64) AS m FROM pq), h AS (SELECT b, y // 2 AS y2, x // 2 AS x2, (CAST(sum(m) AS BIGINT) + 1) >> 2 AS mask FROM m GROUP BY ALL)
SELECT m.b AS block_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, {big('greatest(0, least(255, (16 * v * m + 16 * w * (64 - m) + 512) >> 10))', 'masked')}, {big('mask', 'mask')} FROM m JOIN h ON h.b = m.b AND h.y2 = m.y // 2 AND h.x2 = m.x // 2""")
def compound_difference_mask(spark, sf_dir):
    """Blocks mixed by their difference, beside the mask that the chroma of each sample gets."""
    df = inter.masked(pairs(spark, sf_dir), sign=1)
    wide = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("mask")[F.shiftright(i, 4) * 4 + F.shiftright(i.bitwiseAND(F.lit(7)), 1)])
    return spread_block(df.withColumn("mask", wide), "masked", "mask")
