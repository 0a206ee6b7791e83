"""Queries over a whole plane of samples, and over probability models and codes of event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bitcodes
from ..operators import entropy, grain, loopfilter, tiling
from ..sources.planes import WIDTH, dealt, hold, lines, pack, plane, read, spread_line, with_lines_around

PL = f"pl AS (SELECT event_id // {WIDTH} AS y, event_id % {WIDTH} AS x, CAST(greatest(0, least(255, floor(value))) AS BIGINT) AS v FROM events), sz AS (SELECT max(y) AS my FROM pl), lw AS (SELECT y, max(x) AS mx FROM pl GROUP BY y)"
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


def _taps(name: str, taps) -> str:
    return f"{name}(k, dy, dx, c) AS (VALUES {', '.join(str((k, *t)) for k, t in enumerate(taps))})"


#: Taps (dy, dx): weight of a symmetric filter over 3x3 and 5x1 samples.
WIENER = {(0, 1): 12, (1, 0): 12, (1, 1): 5, (1, -1): 5, (2, 0): -3, (0, 2): -3}
_NEAR = "JOIN lw a_l ON a_l.y = greatest(0, least((SELECT my FROM sz), p.y + {s} * dy)) JOIN pl {n} ON {n}.y = a_l.y AND {n}.x = greatest(0, least(a_l.mx, p.x + {s} * dx))"


def _pairs_sql(taps, value: str) -> str:
    """CTE q(y, x, v, k, c, a, b): each sample with both neighbours of each tap, cut to the plane."""
    return f"""{PL}, {_taps('taps', taps)},
one AS (SELECT p.y, p.x, p.v, k, c, n.v AS a FROM pl p CROSS JOIN taps {_NEAR.format(s='1', n='n')}),
two AS (SELECT p.y, p.x, k, n.v AS b FROM pl p CROSS JOIN taps {_NEAR.format(s='-1', n='n')}),
q AS (SELECT one.*, two.b FROM one JOIN two ON two.y = one.y AND two.x = one.x AND two.k = one.k) {value}"""


@query("WITH " + _pairs_sql([(*t, c) for t, c in WIENER.items()], f"SELECT y, x, {big('greatest(0, least(255, (128 * v + CAST(sum((a + b - 2 * v) * c) AS BIGINT) + 64) >> 7))', 'wiener')} FROM q GROUP BY y, x, v"))
def wiener_nonsep(spark, sf_dir):
    return spread_line(loopfilter.wiener(plane(spark, sf_dir), WIENER), "wiener")


@query("WITH " + _pairs_sql([(1, 0, 1), (1, -1, 1), (1, 1, 1)], "SELECT y, x, " + ", ".join(big(f"max(abs(a - 2 * v + b)) FILTER (WHERE k = {k})", n) for k, n in enumerate(("vertical", "diagonal", "antidiagonal"))) + " FROM q GROUP BY y, x"))
def pc_wiener_features(spark, sf_dir):
    return spread_line(loopfilter.second_differences(plane(spark, sf_dir)), "vertical", "diagonal", "antidiagonal")


@query("WITH " + _pairs_sql([(1, 0, 1), (0, 1, 1), (1, 1, 1), (1, -1, 1)], ", g AS (SELECT y, x, k, abs(2 * v - a - b) AS g FROM q), c AS (SELECT y // 2 AS cy, x // 2 AS cx, " + ", ".join(big(f"sum(g) FILTER (WHERE k = {k})", f"g{k}") for k in range(4)) + f" FROM g GROUP BY ALL) SELECT cy, cx, g0, g1, g2, g3, {big('CASE WHEN g0 <= g1 THEN 1 ELSE 0 END + CASE WHEN g2 <= g3 THEN 2 ELSE 0 END', 'class')} FROM c"))
def gdf_gradient(spark, sf_dir):
    gradients = spread_line(loopfilter.gdf_gradients(plane(spark, sf_dir)), "g0", "g1", "g2", "g3")
    return loopfilter.gdf_cells(gradients).withColumns({"cy": F.col("cy").cast("bigint"), "cx": F.col("cx").cast("bigint")})


@query(f"WITH {PL}, e AS (SELECT *, ((y * 7 + x * 3) % 63 - 31) * 9 AS k FROM pl) SELECT y, x, {big('greatest(0, least(255, v + CASE WHEN k < 0 THEN -((8 - k) >> 4) ELSE (k + 8) >> 4 END))', 'gdf')} FROM e")
def gdf_apply(spark, sf_dir):
    error = (F.col("y") * 7 + F.col("x") * 3) % 63 - 31
    return plane(spark, sf_dir).select("y", "x", loopfilter.gdf_apply(F.col("v"), error, 9).alias("gdf"))


#: Offsets of the 128 pairs of scores and bands, from a rule.
CCSO = [(i * 5) % 15 - 7 for i in range(128)]


@query(f"WITH {PL}, n AS (SELECT p.*, coalesce(u.v, p.v) - p.v AS a, coalesce(d.v, p.v) - p.v AS b FROM pl p LEFT JOIN pl u ON u.y = p.y - 1 AND u.x = p.x LEFT JOIN pl d ON d.y = p.y + 1 AND d.x = p.x), s AS (SELECT *, 32 * CASE WHEN a > 8 THEN 2 WHEN a < -8 THEN 0 ELSE 1 END + 8 * CASE WHEN b > 8 THEN 2 WHEN b < -8 THEN 0 ELSE 1 END + (v >> 6) AS i FROM n) SELECT y, x, {big('greatest(0, least(255, v + (i * 5) % 15 - 7))', 'ccso')} FROM s")
def ccso_classify_offset(spark, sf_dir):
    return spread_line(loopfilter.ccso(lines(plane(spark, sf_dir)), CCSO, taps=(-1, 0)), "ccso")


_LFSR = "xor(xor(s, s >> 1), xor(s >> 3, s >> 12)) & 1"


@query(f"WITH RECURSIVE r(event_id, s, n) AS (SELECT event_id, CAST((event_id * 40503 + 1) % 65536 AS BIGINT), 0 FROM events UNION ALL SELECT event_id, (s >> 1) | (({_LFSR}) << 15), n + 1 FROM r WHERE n < 16) SELECT event_id, s AS state, (s >> 8) - 128 AS noise FROM r WHERE n = 16")
def grain_lfsr(spark, sf_dir):
    from ..functions.integer import lfsr_after

    seed = (F.col("event_id") * 40503 + 1) % 65536
    return read(spark, sf_dir, "events").select("event_id", lfsr_after(seed, 16).alias("state"), grain.noise(seed).alias("noise"))


_POINTS = "pts AS (SELECT event_type, CAST(floor(value) AS BIGINT) // 32 * 32 AS x, CAST(count(*) % 200 AS BIGINT) AS y FROM events WHERE value >= 0 AND value < 256 GROUP BY 1, 2)"
_SCALED = f"""{_POINTS}, seg AS (SELECT event_type, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pts WINDOW w AS (PARTITION BY event_type ORDER BY x)),
ev AS (SELECT event_id, event_type, CAST(greatest(0, least(255, floor(value))) AS BIGINT) AS v FROM events),
sc AS (SELECT ev.*, coalesce(s.y + ((32768 + (v - s.x) * coalesce((s.ny - s.y) * ((65536 + (s.nx - s.x) // 2) // (s.nx - s.x)), 0)) >> 16), f.y) AS scaling
  FROM ev JOIN (SELECT event_type, arg_min(y, x) AS y FROM pts GROUP BY 1) f ON f.event_type = ev.event_type LEFT JOIN seg s ON s.event_type = ev.event_type AND v >= s.x AND v < coalesce(s.nx, 256))"""


def _scaled(spark, sf_dir):
    """Each event's sample with the scaling of its type's curve, whose points are counts by value band."""
    events = read(spark, sf_dir, "events")
    points = events.where("value >= 0 AND value < 256").groupBy("event_type", (F.floor(F.floor("value") / 32) * 32).cast("bigint").alias("x")).agg((F.count(F.lit(1)) % 200).alias("y"))
    samples = events.select("event_id", "event_type", F.greatest(F.lit(0), F.least(F.lit(255), F.floor("value"))).cast("bigint").alias("v"))
    return grain.scaling_of(samples, F.broadcast(grain.scaling_segments(points, "event_type")), "event_type")  # at most 9 pieces for each event type


@query(f"WITH {_SCALED} SELECT event_id, v, {big('scaling', 'scaling')} FROM sc")
def grain_scaling_lut(spark, sf_dir):
    return _scaled(spark, sf_dir).select("event_id", "v", F.col("scaling").cast("bigint").alias("scaling"))


@query(f"WITH RECURSIVE r(event_id, s, n) AS (SELECT event_id, CAST((event_id * 40503 + 1) % 65536 AS BIGINT), 0 FROM events UNION ALL SELECT event_id, (s >> 1) | (({_LFSR}) << 15), n + 1 FROM r WHERE n < 16), {_SCALED} SELECT sc.event_id, {big('greatest(0, least(255, v + ((scaling * ((s >> 8) - 128) + 128) >> 8)))', 'grained')} FROM sc JOIN r ON r.event_id = sc.event_id AND n = 16")
def grain_apply_luma(spark, sf_dir):
    seed = (F.col("event_id") * 40503 + 1) % 65536
    return _scaled(spark, sf_dir).select("event_id", grain.apply_luma(F.col("v"), F.col("scaling"), grain.noise(seed)).alias("grained"))


_SYMBOLS = f"sy AS (SELECT event_id // {entropy.TILE} AS tile, event_id, row_number() OVER (PARTITION BY event_id // {entropy.TILE} ORDER BY event_id) AS i, CAST(floor(abs(value)) AS BIGINT) % 4 AS s FROM events)"
_ADAPT = f"""{_SYMBOLS}, a(tile, n, p0, p1, p2, c) AS (SELECT DISTINCT tile, CAST(0 AS BIGINT), CAST(24576 AS BIGINT), CAST(16384 AS BIGINT), CAST(8192 AS BIGINT), CAST(0 AS BIGINT) FROM sy
  UNION ALL SELECT a.tile, n + 1, {', '.join(f'CASE WHEN {k} < s THEN p{k} + ((32768 - p{k}) >> (5 + (c >> 4))) ELSE p{k} - (p{k} >> (5 + (c >> 4))) END' for k in range(3))}, least(32, c + 1) FROM a JOIN sy ON sy.tile = a.tile AND sy.i = a.n + 1),
e AS (SELECT tile, arg_max(p0, n) AS p0, arg_max(p1, n) AS p1, arg_max(p2, n) AS p2, arg_max(c, n) AS c FROM a GROUP BY tile)"""


def _models(spark, sf_dir):
    """(tile, cdf, count): a model of four symbols adapted over each tile of the event stream."""
    symbols = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / entropy.TILE).cast("bigint").alias("tile"), "event_id", (F.floor(F.abs("value")).cast("bigint") % 4).alias("s"))
    tiles = symbols.groupBy("tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "s"))), lambda e: e["s"]).alias("symbols"))
    return entropy.adapt(tiles, "symbols", 3)


@query(f"WITH RECURSIVE {_ADAPT} SELECT tile, {big('p0', 'p0')}, {big('p1', 'p1')}, {big('p2', 'p2')}, {big('c', 'count')} FROM e")
def cdf_adapt_fold(spark, sf_dir):
    m = _models(spark, sf_dir)
    return m.select("tile", *[F.col("cdf")[i].alias(f"p{i}") for i in range(3)], "count")


@query(f"WITH RECURSIVE {_ADAPT}, u AS (SELECT tile // 8 AS frame, 0 AS pos, p0 AS p FROM e UNION ALL SELECT tile // 8, 1, p1 FROM e UNION ALL SELECT tile // 8, 2, p2 FROM e) SELECT frame, {big('pos', 'pos')}, {big('sum(p >> 3)', 'p')} FROM u GROUP BY frame, pos")
def cdf_tile_average(spark, sf_dir):
    return entropy.average_tiles(_models(spark, sf_dir).withColumn("frame", F.floor(F.col("tile") / 8).cast("bigint")), "frame", 3)


@query(f"WITH RECURSIVE {_ADAPT} SELECT a1.tile, {', '.join(big(f'(7 * a1.p{k} + b1.p{k} + 4) >> 3', f'p{k}') for k in range(3))}, {big('a1.c * 3 // 4', 'count')} FROM e a1 JOIN e b1 ON b1.tile = a1.tile + 1")
def cdf_pri_sec_average(spark, sf_dir):
    m = _models(spark, sf_dir)
    two = m.select((F.col("tile") - 1).alias("tile"), F.col("cdf").alias("cdf2"))
    mixed = m.join(two, "tile").select("tile", entropy.average_two("cdf", "cdf2").alias("p"), entropy.reset_count(F.col("count")).alias("count"))
    return mixed.select("tile", *[F.col("p")[i].alias(f"p{i}") for i in range(3)], "count")


@query("SELECT o_orderkey, repeat('0', length(bin(o_orderkey + 1)) - 1) || bin(o_orderkey + 1) AS code, o_orderkey AS back FROM orders")
def expgolomb_roundtrip(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", bitcodes.exp_golomb(F.col("o_orderkey")).alias("code")).withColumn("back", bitcodes.read_exp_golomb(F.col("code")))


#: Rows of a task that makes long codes.
CODES = 1 << 16


@query("SELECT o_orderkey, repeat('1', CAST(o_custkey >> 5 AS BIGINT)) || '0' || lpad(bin(o_custkey & 31), 5, '0') AS code, o_custkey AS back FROM orders")
def golomb_rice_roundtrip(spark, sf_dir):
    """A code has a one for every 32 of its number, so all codes together grow with orders times customers."""
    orders = dealt(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), CODES, "o_orderkey", "o_custkey")
    return orders.select("o_orderkey", bitcodes.golomb_rice(F.col("o_custkey"), 5).alias("code")).withColumn("back", bitcodes.read_golomb_rice(F.col("code"), 5))


@query("SELECT o_orderkey, o_custkey % (o_orderkey % 1000 + 3) AS back, CAST(length(bin(o_orderkey % 1000 + 3)) - CASE WHEN o_custkey % (o_orderkey % 1000 + 3) < (1 << length(bin(o_orderkey % 1000 + 3))) - (o_orderkey % 1000 + 3) THEN 1 ELSE 0 END AS BIGINT) AS bits FROM orders")
def quasi_uniform_roundtrip(spark, sf_dir):
    n = F.col("o_orderkey") % 1000 + 3
    coded = read(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), bitcodes.quasi_uniform(F.col("o_custkey") % n, n).alias("code"))
    return coded.select("o_orderkey", bitcodes.read_quasi_uniform(F.col("code"), F.col("n")).alias("back"), F.length("code").cast("bigint").alias("bits"))


@query("WITH o AS (SELECT o_orderkey, o_orderkey * 2654435761 AS v FROM orders) SELECT o_orderkey, v AS back, CAST(greatest(1, (length(bin(v)) + 6) // 7) AS BIGINT) AS bytes, lpad(upper(to_hex(v % 128 + CASE WHEN v >= 128 THEN 128 ELSE 0 END)), 2, '0') AS first_byte FROM o")
def leb128_roundtrip(spark, sf_dir):
    coded = read(spark, sf_dir, "orders").select("o_orderkey", bitcodes.leb128(F.col("o_orderkey") * 2654435761).alias("code"))
    return coded.select("o_orderkey", bitcodes.read_leb128(F.col("code")).alias("back"), F.floor(F.length("code") / 2).cast("bigint").alias("bytes"), F.substring("code", 1, 2).alias("first_byte"))


@query("WITH o AS (SELECT o_orderkey, o_custkey % 100 AS r, o_orderkey % 200 AS v FROM orders) SELECT o_orderkey, CAST(CASE WHEN v > 2 * r THEN v WHEN v >= r THEN 2 * (v - r) ELSE 2 * (r - v) - 1 END AS BIGINT) AS centred, v AS back FROM o")
def recenter_roundtrip(spark, sf_dir):
    r, v = F.col("o_custkey") % 100, F.col("o_orderkey") % 200
    return read(spark, sf_dir, "orders").select("o_orderkey", r.alias("r"), bitcodes.recenter(r, v).alias("centred")).select("o_orderkey", "centred", bitcodes.inverse_recenter(F.col("r"), F.col("centred")).alias("back"))


_UNIFORM = lambda x, n: f"(CASE WHEN {x} < (1 << length(bin({n}))) - {n} THEN CASE WHEN {n} = 1 THEN '' ELSE lpad(bin({x}), CAST(length(bin({n})) - 1 AS INTEGER), '0') END ELSE CASE WHEN length(bin({n})) = 1 THEN '' ELSE lpad(bin(({x} + (1 << length(bin({n}))) - {n}) >> 1), CAST(length(bin({n})) - 1 AS INTEGER), '0') END || (({x} + (1 << length(bin({n}))) - {n}) & 1) END)"


def _subexp_sql(first: int = 3) -> str:
    cases, start, size = [], 0, first
    for i in range(9):
        cases.append(f"WHEN n <= {start + 3 * (1 << size)} THEN '{'1' * i}' || {_UNIFORM(f'greatest(0, x - {start})', f'greatest(1, n - {start})')} WHEN x < {start + (1 << size)} THEN '{'1' * i}0' || lpad(bin(greatest(0, x - {start})), {size}, '0')")
        start, size = start + (1 << size), size + (i > 0)
    centred = lambda r, v: f"CASE WHEN {v} > 2 * ({r}) THEN {v} WHEN {v} >= {r} THEN 2 * ({v} - ({r})) ELSE 2 * (({r}) - ({v})) - 1 END"
    return f"WITH o AS (SELECT o_orderkey, 2 + o_custkey % 900 AS n, o_orderkey % (2 + o_custkey % 900) AS v, o_orderkey * 7 % (2 + o_custkey % 900) AS r FROM orders), x AS (SELECT *, CASE WHEN 2 * r <= n THEN {centred('r', 'v')} ELSE {centred('(n - 1 - r)', '(n - 1 - v)')} END AS x FROM o) SELECT o_orderkey, CASE {' '.join(cases)} END AS code, v AS back FROM x"


@query(_subexp_sql())
def subexponential_roundtrip(spark, sf_dir):
    n = 2 + F.col("o_custkey") % 900
    rows = read(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), (F.col("o_orderkey") % n).alias("v"), (F.col("o_orderkey") * 7 % n).alias("r"))
    n, code, x = F.col("n"), F.col("code"), F.col("x")
    rows = hold(rows, x=bitcodes.centred(F.col("r"), F.col("v"), n))
    rows = hold(hold(rows, i=bitcodes.sub_exponential_range(x, n)), code=bitcodes.sub_exponential(x, F.col("i"), n)).select("o_orderkey", "n", "r", "code")
    rows = hold(rows, i=bitcodes.sub_exponential_ones(code, n))
    rows = hold(rows, x=bitcodes.read_sub_exponential(code, F.col("i"), n))
    return rows.select("o_orderkey", "code", bitcodes.uncentred(F.col("r"), x, n).alias("back"))


@query(f"WITH o AS (SELECT o_orderkey, 2 + o_custkey % 50 AS n, o_orderkey % (2 + o_custkey % 50) AS v, o_custkey % (2 + o_custkey % 50) % 3 AS d FROM orders), p AS (SELECT *, v - CASE WHEN v > d THEN 1 ELSE 0 END AS w, n - 1 AS m FROM o) SELECT o_orderkey, CASE WHEN v = d THEN '0' ELSE '1' || {_UNIFORM('w', 'm')} END AS code, v AS back FROM p")
def default_uniform_roundtrip(spark, sf_dir):
    n = 2 + F.col("o_custkey") % 50
    rows = read(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), (F.col("o_orderkey") % n).alias("v"), (F.col("o_custkey") % n % 3).alias("d"))
    coded = rows.withColumn("code", bitcodes.or_default(F.col("d"), F.col("v"), F.col("n")))
    return coded.select("o_orderkey", "code", bitcodes.read_or_default(F.col("code"), F.col("d"), F.col("n")).alias("back"))


@query(f"WITH {PL}, s AS (SELECT p.y, p.x, l.v >> 5 AS l, a.v >> 5 AS a, al.v >> 5 AS al FROM pl p LEFT JOIN pl l ON l.y = p.y AND l.x = p.x - 1 LEFT JOIN pl a ON a.y = p.y - 1 AND a.x = p.x LEFT JOIN pl al ON al.y = p.y - 1 AND al.x = p.x - 1) SELECT y, x, {big('CASE WHEN l IS NOT NULL AND a IS NOT NULL THEN CASE WHEN a = al THEN a ELSE l END ELSE coalesce(l, a, 0) END', 'predicted')}, {big('CASE WHEN l IS NULL OR a IS NULL THEN 0 WHEN l = a AND al = l THEN 2 WHEN l = a OR al = l OR a = al THEN 1 ELSE 0 END', 'context')} FROM s")
def segment_contexts(spark, sf_dir):
    """Each block's segment as its left, upper and upper-left neighbours predict it, and how far these agree."""
    packed = lines(plane(spark, sf_dir).withColumn("v", F.shiftright("v", 5)))
    around = with_lines_around(packed, 1)
    left = lambda of, i: F.when(i > 0, F.get(of, i - 1))
    l, a, c = (lambda i: left(F.col("line"), i)), (lambda i: F.get(F.col("around")[0], i)), (lambda i: left(F.col("around")[0], i))  # noqa: E741,E731
    both = lambda i: l(i).isNotNull() & a(i).isNotNull()
    predicted = lambda v, i: F.when(both(i), F.when(a(i) == c(i), a(i)).otherwise(l(i))).otherwise(F.coalesce(l(i), a(i), F.lit(0))).cast("bigint")
    context = lambda v, i: F.when(~both(i), 0).when((l(i) == a(i)) & (c(i) == l(i)), 2).when((l(i) == a(i)) | (c(i) == l(i)) | (a(i) == c(i)), 1).otherwise(0).cast("bigint")
    return spread_line(around.withColumns({"predicted": F.transform("line", predicted), "context": F.transform("line", context)}), "predicted", "context")


@query("""WITH s AS (SELECT p_partkey, p_partkey * 37 % 4000 + p_size AS sz FROM part), f AS (SELECT p_partkey, greatest(1, (sz + 7) >> 6) AS f, 1 + ((sz - 1) >> 6) AS u FROM s), e AS (SELECT *, f >> 3 AS b, f - (f >> 3) * 8 + CASE WHEN f >> 3 = 0 THEN u - f ELSE 0 END AS x FROM f),
k AS (SELECT DISTINCT p_partkey, k * b + least(k, greatest(x, 0)) AS start, u FROM e, range(8) r(k)) SELECT p_partkey, CAST(start AS BIGINT) AS start FROM k WHERE start < u""")
def uniform_tiles(spark, sf_dir):
    size = F.col("p_partkey") * 37 % 4000 + F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(tiling.uniform_tiles(size, 3)).alias("start"))


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY abs(CAST(floor(value) AS BIGINT) - 50), event_id DESC) - 1 AS rank FROM events) SELECT * FROM r WHERE rank < 7")
def ref_rank_topk(spark, sf_dir):
    frames = read(spark, sf_dir, "events").select("user_id", "event_id", F.abs(F.floor("value").cast("bigint") - 50).alias("score"))
    return tiling.rank_references(frames, "user_id", "score", "event_id", 7).select("user_id", "event_id", "rank")


@query(f"WITH {PL} SELECT y AS image, lower(string_agg(lpad(to_hex(v), 2, '0'), '' ORDER BY x)) AS packed, count(*) AS bytes FROM pl GROUP BY y")
def pack_lines(spark, sf_dir):
    packed = pack(plane(spark, sf_dir).withColumn("image", F.col("y")), "image")
    return packed.select("image", F.lower(F.hex("packed")).alias("packed"), F.length("packed").cast("bigint").alias("bytes"))

