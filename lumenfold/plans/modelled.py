"""Queries of prediction by models and of motion fields, each with the DuckDB SQL that it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import modelled, motion
from ..sources.planes import blocks, pairs, read, spread_block
from .blocks import COLS, PQ, PX, big

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# three taps

_bits = lambda v: f"length(bin(greatest(abs({v}), 1)))"
_over = lambda a, b: f"greatest({_bits(a)} + {_bits(b)} - 29, 0)"


def _product(a: str, b: str, shift: str) -> str:
    over = _over(a, b)
    p, rest = f"(({a} >> ({over} >> 1)) * ({b} >> ({over} - ({over} >> 1))))", f"greatest({shift} - {over}, 0)"
    return f"CAST(sign({p}) * ((abs({p}) + ((1 << {rest}) >> 1)) >> {rest}) AS BIGINT)"


def _by_part(table: list[int]) -> str:
    return f"{table}[(head >> 11) + 1]"


def _pivot(k: int, before: str) -> str:
    """Steps of elimination by unknown k, each a table of its own."""
    m = f"m{k}{k}"
    head = f"greatest(1, least(32767, CASE WHEN z >= 14 THEN (greatest(abs({m}), 1) + ((1 << (greatest(z, 14) - 14)) >> 1)) >> (greatest(z, 14) - 14) ELSE greatest(abs({m}), 1) << (14 - least(z, 14)) END)) & 16383"
    out = [f"a{k} AS (SELECT *, {_bits(m)} - 1 AS z FROM {before})", f"b{k} AS (SELECT *, {head} AS head FROM a{k})", f"c{k} AS (SELECT *, head - {_by_part(modelled.MIDDLES)} AS off FROM b{k})"]
    out.append(f"d{k} AS (SELECT *, (({_by_part(modelled.CURVES)} * ((off * off) >> 14)) >> 8) - (off >> 1) + {_by_part(modelled.HEIGHTS)} AS q FROM c{k})")
    out.append(f"e{k} AS (SELECT * EXCLUDE (head, off, q), q * 4 AS r FROM d{k})")
    row = [f"{_product(f'm{k}{j}', 'r', 'z')} AS m{k}{j}" for j in range(k + 1, 3)] + [f"{_product(f'v{k}', 'r', 'z')} AS v{k}"]
    out.append(f"f{k} AS (SELECT * REPLACE ({', '.join(row)}) FROM e{k})")
    below = [f"m{i}{j} - {_product(f'm{i}{k}', f'm{k}{j}', '16')} AS m{i}{j}" for i in range(k + 1, 3) for j in range(k + 1, 3)] + [f"v{i} - {_product(f'm{i}{k}', f'v{k}', '16')} AS v{i}" for i in range(k + 1, 3)]
    out.append(f"g{k} AS (SELECT * EXCLUDE (z, r){f' REPLACE ({", ".join(below)})' if below else ''} FROM f{k})")
    return ", ".join(out)


_TAPS = f"""{PQ}, near AS (SELECT p.b, p.y, p.x, p.w, p.v AS own, n.v AS near, (p.v * p.v + 128) >> 8 AS sq FROM pq p JOIN px n ON n.b = p.b AND n.y = CASE WHEN p.b % 3 = 1 THEN greatest(p.y - 1, 0) ELSE p.y END AND n.x = CASE WHEN p.b % 3 = 2 THEN greatest(p.x - 1, 0) ELSE p.x END),
sums AS (SELECT b, {', '.join(f'CAST(sum({a} * {c}) << 2 AS BIGINT){" + 2" if i == j else ""} AS m{i}{j}' for i, a in enumerate(('near', 'sq', '128')) for j, c in enumerate(('near', 'sq', '128')))}, {', '.join(f'CAST(sum({a} * w) << 2 AS BIGINT) AS v{i}' for i, a in enumerate(('near', 'sq', '128')))} FROM near WHERE y = 0 OR x = 0 GROUP BY b),
{_pivot(0, 'sums')}, {_pivot(1, 'g0')}, {_pivot(2, 'g1')}, h1 AS (SELECT * REPLACE (v1 - {_product('m12', 'v2', '16')} AS v1) FROM g2), solved AS (SELECT b, v1, v2, v0 - ({_product('m01', 'v1', '16')} + {_product('m02', 'v2', '16')}) AS v0 FROM h1)"""


@query(f"WITH {_TAPS} SELECT b AS block_id, {', '.join(big(f'v{i}', f'w{i}') for i in range(3))} FROM solved")
def three_tap_weights(spark, sf_dir):
    """Chroma from luma by three taps: normal equations of a block's edge, solved in integers with reciprocals."""
    found = modelled.three_tap_blocks(pairs(spark, sf_dir).withColumn("direction", F.col("block_id") % 3))
    return found.select("block_id", *[F.col("weights")[i].alias(f"w{i}") for i in range(3)])


@query(f"WITH {_TAPS}, n2 AS (SELECT near.*, v0, v1, v2, CAST(128 AS BIGINT) AS mid FROM near JOIN solved USING (b)) SELECT {COLS}, {big(f'greatest(0, least(255, {_product("v0", "near", "16")} + {_product("v1", "sq", "16")} + {_product("v2", "mid", "16")}))', 'predicted')} FROM n2")
def three_tap_prediction(spark, sf_dir):
    """The chroma block that those taps predict from the luma block."""
    found = modelled.three_tap_blocks(pairs(spark, sf_dir).withColumn("direction", F.col("block_id") % 3))
    return spread_block(found.select("block_id", "predicted"), "predicted")


# matrices over edges


def _matrix_sql(size: int) -> str:
    part, step = size // 4, size // 8
    log, up = part.bit_length() - 1, step.bit_length() - 1
    mean = lambda name, first: f"SELECT b, {name} AS i, (sum(v) + {part >> 1}) >> {log} AS v FROM {first} GROUP BY ALL"
    top = f"SELECT b, i // {part} AS g, v FROM s WHERE i < {size + part}"
    left = f"SELECT b, (63 - i) // {part} AS g, v FROM s WHERE i > {63 - size - part}"
    turned = "(b // 8) % 2 = 1"
    between = lambda one, two, z: f"({one} * ({step} - {z} - 1) + {two} * ({z} + 1)) >> {up}"
    return f"""WITH {PX}, s AS (SELECT b, y * 8 + x AS i, v FROM px),
    m AS (SELECT b, CAST(0 AS BIGINT) AS i, v FROM s WHERE i = 31 UNION ALL {mean(f'CASE WHEN g = 4 THEN CASE WHEN {turned} THEN 10 ELSE 9 END WHEN {turned} THEN g + 5 ELSE g + 1 END', f'({top})')} UNION ALL {mean(f'CASE WHEN g = 4 THEN CASE WHEN {turned} THEN 9 ELSE 10 END WHEN {turned} THEN g + 1 ELSE g + 5 END', f'({left})')}),
    w AS (SELECT b, p, sum((372 + ((b % 6 * 7 + p * 13 + i * 29) % 61 - 30) * 8 + 4096) * v) AS q, sum(v) AS a FROM m, range(0, 64) r(p) GROUP BY ALL),
    g AS (SELECT b, CASE WHEN {turned} THEN p % 8 ELSE p // 8 END AS gy, CASE WHEN {turned} THEN p // 8 ELSE p % 8 END AS gx, greatest(0, least(255, ((CAST(q AS BIGINT) + 2048) >> 12) - CAST(a AS BIGINT))) AS v FROM w),
    l AS (SELECT g.b, g.gy, g.gx * {step} + z AS x, {between('coalesce(h.v, e.v)', 'g.v', 'z')} AS v FROM g JOIN range(0, {step}) t(z) ON true LEFT JOIN g h ON h.b = g.b AND h.gy = g.gy AND h.gx = g.gx - 1 LEFT JOIN s e ON e.b = g.b AND e.i = 63 - (g.gy * {step} + {step - 1})),
    o AS (SELECT l.b, l.gy * {step} + z AS y, l.x, {between('coalesce(h.v, e.v)', 'l.v', 'z')} AS v FROM l JOIN range(0, {step}) t(z) ON true LEFT JOIN l h ON h.b = l.b AND h.x = l.x AND h.gy = l.gy - 1 LEFT JOIN s e ON e.b = l.b AND e.i = l.x)
    SELECT {COLS}, {big('v', 'predicted')} FROM o"""


def _matrix(spark, sf_dir, size: int):
    rows = blocks(spark, sf_dir).withColumns({"mode": F.col("block_id") % 6, "turned": F.floor(F.col("block_id") / 8) % 2})
    return spread_block(modelled.matrix_blocks(rows, size, modelled.matrix_table()), "predicted", width=size)


@query(_matrix_sql(8))
def matrix_intra_8(spark, sf_dir):
    """8x8 blocks by a matrix over eleven means of their edges, straight and turned."""
    return _matrix(spark, sf_dir, 8)


@query(_matrix_sql(16))
def matrix_intra_16(spark, sf_dir):
    """16x16 blocks by the same matrices, with lines and columns between filled in."""
    return _matrix(spark, sf_dir, 16)


# motion fields

SIDE = 32  # cells in a line, and lines, of a field
_VECTORS = """v AS (SELECT event_id // 1024 - source AS field, source, event_id % 1024 // 32 AS y, event_id % 32 AS x, (user_id * 37 + event_id * 11) % 641 - 320 AS mv_y, (user_id * 53 + event_id * 7) % 1281 - 640 AS mv_x,
  (1 + event_id % 3) * (16384 // (1 + user_id % 4)) AS factor, (1 + user_id % 4) * CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END AS reference, user_id % 3 = 0 AS wanted FROM events, (VALUES (0), (1)) s(source) WHERE event_id % 7 <> 3)"""
_scaled = lambda v: f"greatest(-65535, least(65535, (({v}) * -factor + 8192 - CASE WHEN ({v}) * -factor < 0 THEN 1 ELSE 0 END) >> 14))"
_PROJECTED = f"""{_VECTORS}, sc AS (SELECT *, {_scaled('mv_y')} AS dy, {_scaled('mv_x')} AS dx FROM v), mv AS (SELECT *, y - sign(dy) * (abs(dy) >> 6) AS to_y, x - sign(dx) * (abs(dx) >> 6) AS to_x FROM sc),
ok AS (SELECT *, row_number() OVER (PARTITION BY field, to_y, to_x ORDER BY source, y, x) AS n FROM mv WHERE to_y BETWEEN 0 AND 31 AND to_x BETWEEN 0 AND 31 AND y // 8 = to_y // 8 AND x BETWEEN to_x // 8 * 8 - 8 AND to_x // 8 * 8 + 15),
fold(field, to_y, to_x, n, mv_y, mv_x, reference) AS (SELECT field, to_y, to_x, n, mv_y * sign(reference), mv_x * sign(reference), abs(reference) FROM ok WHERE n = 1
  UNION ALL SELECT f.field, f.to_y, f.to_x, o.n, CASE WHEN o.wanted AND abs(o.reference) <> f.reference THEN o.mv_y * sign(o.reference) ELSE f.mv_y END, CASE WHEN o.wanted AND abs(o.reference) <> f.reference THEN o.mv_x * sign(o.reference) ELSE f.mv_x END, CASE WHEN o.wanted THEN abs(o.reference) ELSE f.reference END
  FROM fold f JOIN ok o ON o.field = f.field AND o.to_y = f.to_y AND o.to_x = f.to_x AND o.n = f.n + 1),
cell AS (SELECT field, CAST(to_y AS BIGINT) AS y, CAST(to_x AS BIGINT) AS x, CAST(arg_max(mv_y, n) AS BIGINT) AS mv_y, CAST(arg_max(mv_x, n) AS BIGINT) AS mv_x, CAST(arg_max(reference, n) AS BIGINT) AS reference FROM fold GROUP BY field, to_y, to_x)"""


def _vectors(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    rows = read(spark, sf_dir, "events").where(e % 7 != 3).select("event_id", "user_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("source"))
    return rows.select(
        (F.floor(e / 1024) - F.col("source")).alias("field"), "source", F.floor(e % 1024 / SIDE).alias("y"), (e % SIDE).alias("x"), ((u * 37 + e * 11) % 641 - 320).alias("mv_y"), ((u * 53 + e * 7) % 1281 - 640).alias("mv_x"),
        ((1 + e % 3) * F.floor(F.lit(16384) / (1 + u % 4))).alias("factor"), ((1 + u % 4) * F.when(e % 5 == 0, -1).otherwise(1)).alias("reference"), (u % 3 == 0).alias("wanted"),
    )


def _fields(spark, sf_dir):
    """Blocks of projected vectors, written once by being grouped."""
    return motion.block_fields(motion.project(_vectors(spark, sf_dir), SIDE, SIDE))


@query(f"WITH RECURSIVE {_PROJECTED} SELECT * FROM cell")
def motion_projection(spark, sf_dir):
    """Vectors of two fields sent along themselves to the cells of a field between, the first on each cell, or one that is wanted more."""
    return motion.project(_vectors(spark, sf_dir), SIDE, SIDE)


_GRID = f"{_PROJECTED}, blk AS (SELECT DISTINCT field, y // 8 AS tile_y, x // 8 AS tile_x FROM cell), c0 AS (SELECT b.field, b.tile_y, b.tile_x, y.y, x.x, cell.mv_y, cell.mv_x FROM blk b JOIN range(0, 8) y(y) ON true JOIN range(0, 8) x(x) ON true LEFT JOIN cell ON cell.field = b.field AND cell.y = b.tile_y * 8 + y.y AND cell.x = b.tile_x * 8 + x.x)"
_ROWS = "r0 AS (SELECT field, tile_y, tile_x, y, x, last_value(s IGNORE NULLS) OVER w AS s FROM (SELECT *, CASE WHEN mv_y IS NOT NULL THEN {'a': mv_y, 'b': mv_x} END AS s FROM c0 WHERE y = 0) WINDOW w AS (PARTITION BY field, tile_y, tile_x ORDER BY x))" + "".join(
    f", r{k} AS (SELECT field, tile_y, tile_x, y, x, last_value(s IGNORE NULLS) OVER w AS s FROM (SELECT c.field, c.tile_y, c.tile_x, c.y, c.x, CASE WHEN c.mv_y IS NOT NULL THEN {{'a': c.mv_y, 'b': c.mv_x}} ELSE r.s END AS s FROM c0 c JOIN r{k - 1} r ON c.field = r.field AND c.tile_y = r.tile_y AND c.tile_x = r.tile_x AND c.x = r.x WHERE c.y = {k}) WINDOW w AS (PARTITION BY field, tile_y, tile_x ORDER BY x))"
    for k in range(1, 8)
)


@query(f"WITH RECURSIVE {_GRID}, {_ROWS}, t AS ({' UNION ALL '.join(f'SELECT * FROM r{k}' for k in range(8))}), z AS (SELECT t.field, t.tile_y, t.tile_x, t.y, t.x, coalesce(t.s, r.s, d.s) AS s FROM t LEFT JOIN t r ON r.field = t.field AND r.tile_y = t.tile_y AND r.tile_x = t.tile_x AND r.y = t.y AND r.x = t.x + 1 LEFT JOIN t d ON d.field = t.field AND d.tile_y = t.tile_y AND d.tile_x = t.tile_x AND d.x = t.x AND d.y = t.y + 1) SELECT field, tile_y * 8 + y AS y, tile_x * 8 + x AS x, s.a AS mv_y, s.b AS mv_x FROM z WHERE s IS NOT NULL")
def motion_hole_fill(spark, sf_dir):
    """Holes of projected fields filled from their neighbours in the order of lines, inside blocks of 8x8 cells."""
    fields = _fields(spark, sf_dir)
    return _chain(fields, motion.fill_holes, "fy", "fx")


@query(f"WITH RECURSIVE {_GRID}, n AS (SELECT c.field, c.tile_y, c.tile_x, c.y, c.x, CAST(sum(o.mv_y) AS BIGINT) AS sy, CAST(sum(o.mv_x) AS BIGINT) AS sx, count(o.mv_y) AS n FROM c0 c JOIN c0 o ON o.field = c.field AND o.tile_y = c.tile_y AND o.tile_x = c.tile_x AND abs(o.y - c.y) + abs(o.x - c.x) <= 1 GROUP BY ALL) SELECT field, tile_y * 8 + y AS y, tile_x * 8 + x AS x, CAST((sy * (65536 // n) + 32768 - CASE WHEN sy < 0 THEN 1 ELSE 0 END) >> 16 AS BIGINT) AS mv_y, CAST((sx * (65536 // n) + 32768 - CASE WHEN sx < 0 THEN 1 ELSE 0 END) >> 16 AS BIGINT) AS mv_x FROM n WHERE n > 0")
def motion_smoothing(spark, sf_dir):
    """Projected vectors averaged with their neighbours that have any, inside blocks."""
    return _chain(_fields(spark, sf_dir), motion.smooth, "sy", "sx")


_up = lambda t: f"((({t}) + CASE WHEN ({t}) > 0 THEN 1 ELSE 0 END) >> 1)"


def _gap_sql() -> str:
    part = lambda c: f"CASE k WHEN 0 THEN o.{c} WHEN 1 THEN CASE WHEN r.mv_y IS NULL THEN o.{c} ELSE {_up(f'o.{c} + r.{c}')} END WHEN 2 THEN CASE WHEN b.mv_y IS NULL THEN o.{c} ELSE {_up(f'o.{c} + b.{c}')} END ELSE CASE n WHEN 1 THEN o.{c} WHEN 2 THEN {_up(f't{c}')} WHEN 3 THEN (t{c} * 85 + 128 - CASE WHEN t{c} < 0 THEN 1 ELSE 0 END) >> 8 ELSE (t{c} + 1 + CASE WHEN t{c} > 0 THEN 1 ELSE 0 END) >> 2 END END"
    near = lambda a, dy, dx: f"LEFT JOIN c0 {a} ON {a}.field = o.field AND {a}.tile_y = o.tile_y AND {a}.tile_x = o.tile_x AND {a}.y = o.y + {dy} AND {a}.x = o.x + {dx}"
    total = lambda c: f"o.{c} + coalesce(r.{c}, 0) + coalesce(b.{c}, 0) + coalesce(d.{c}, 0) AS t{c}"
    inner = f"SELECT o.*, k.k, {total('mv_y')}, {total('mv_x')}, 1 + (r.mv_y IS NOT NULL)::INT + (b.mv_y IS NOT NULL)::INT + (d.mv_y IS NOT NULL)::INT AS n, r.mv_y AS ry, r.mv_x AS rx, b.mv_y AS by_, b.mv_x AS bx_ FROM c0 o JOIN range(0, 4) k(k) ON true {near('r', 0, 2)} {near('b', 2, 0)} {near('d', 2, 2)} WHERE o.y % 2 = 0 AND o.x % 2 = 0 AND o.mv_y IS NOT NULL"
    name = lambda s: s.replace("o.mv", "q.mv").replace("r.mv_y", "q.ry").replace("r.mv_x", "q.rx").replace("b.mv_y", "q.by_").replace("b.mv_x", "q.bx_")
    return f"SELECT field, tile_y * 8 + y + k // 2 AS y, tile_x * 8 + x + k % 2 AS x, CAST({name(part('mv_y'))} AS BIGINT) AS mv_y, CAST({name(part('mv_x'))} AS BIGINT) AS mv_x FROM ({inner}) q"


@query(f"WITH RECURSIVE {_GRID} {_gap_sql()}")
def motion_gaps(spark, sf_dir):
    """Fields known at every second cell, with what lies between from two, three or four neighbours."""
    return _chain(_fields(spark, sf_dir), motion.close_gaps, "gy", "gx")


def _chain(fields, step, y: str, x: str):
    """Cells of blocks after a step; a block's key is made of its field and place, so no join brings them together again."""
    key = (F.col("field") + 2) * 16 + F.col("by") * 4 + F.col("bx")
    found = step(fields.withColumn("block_id", key))
    cells = found.select("block_id", F.posexplode(F.arrays_zip(y, x)).alias("i", "v")).where(F.col("v")[y] != motion.NONE)
    i, b = F.col("i").cast("bigint"), F.col("block_id")
    return cells.select((F.floor(b / 16) - 2).alias("field"), (F.floor(b % 16 / 4) * 8 + F.floor(i / 8)).alias("y"), (b % 4 * 8 + i % 8).alias("x"), F.col("v")[y].alias("mv_y"), F.col("v")[x].alias("mv_x"))
