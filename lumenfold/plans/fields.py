"""Queries over header fields, reference frames and scalar rules, each with its DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.integer import clip, reciprocal, shifted
from ..operators import bitreader, grain, references
from ..sources import obu
from ..sources.isobmff import integer, join, number
from ..sources.planes import blocks, dealt, hold, read, spread_block
from .blocks import COLS, PX, big
from .containers import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Names of the unit types from 1 on.
UNIT_TYPES = [
    "sequence header", "temporal delimiter", "multi-frame header", "closed-loop key frame", "open-loop key frame", "leading tile group", "tile group", "metadata", "metadata group",
    "switch frame", "leading shown frame", "shown frame", "leading interpolated frame", "interpolated frame", "buffer removal timing", "layer configuration", "atlas segment", "operating points",
    "bridge frame", "multi-stream operation", "random access", "quantiser matrices", "film grain", "content interpretation", "padding",
]
#: Angles of the eight directional modes; from which angle on a rectangular block goes to the opposite side, by the ratio of its sides.
ANGLES, TURNS = (90, 180, 45, 135, 113, 157, 203, 67), (61, 73, 82, 86)
#: Fixed values: (sum of both sides up to, angle from, strength) of edge filters, for smooth neighbours and for others; 999: any larger sum.
SMOOTH_EDGES = [(8, 64, 2), (8, 40, 1), (16, 48, 2), (16, 20, 1), (24, 4, 3), (999, 0, 3)]
OTHER_EDGES = [(8, 56, 1), (16, 40, 1), (24, 32, 3), (24, 16, 2), (24, 8, 1), (32, 32, 3), (32, 4, 2), (32, 0, 1), (999, 0, 3)]
#: Fixed value: the metadata type of a mastering display.
MASTERING = 2


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


FIELDS = [("a", "unsigned", 3), ("b", "signed", 5), ("c", "zeros"), ("d", "below", 11), ("e", "rice", 2), (None, "align"), ("g", "unsigned", 12), (None, "skip", 7), ("h", "zeros"), ("i", "signed", 9)]


def _fields_sql() -> str:
    bits = "array_to_string(list_transform(range(1, length(x) + 1), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789ABCDEF', x[i])]), '')"
    number_of = lambda s: f"CAST(CASE WHEN {s} = '' THEN 0 ELSE list_sum(list_transform(range(1, length({s}) + 1), lambda i: CASE WHEN ({s})[i] = '1' THEN 1 << (length({s}) - i) ELSE 0 END)) END AS BIGINT)"
    out = [f"t0 AS (SELECT doc_id, {bits} AS s, CAST(0 AS BIGINT) AS pos, false AS bad FROM (SELECT doc_id, substr(hex(encode(coalesce(text, ''))), 1, 48) AS x FROM documents))"]
    kept: list[str] = []
    for k, (name, kind, *rest) in enumerate(FIELDS):
        n = rest[0] if rest else 0
        run = lambda c: f"(CASE WHEN strpos(substr(s, pos + 1), '{c}') = 0 THEN 9999 ELSE strpos(substr(s, pos + 1), '{c}') - 1 END)"
        fixed = number_of(f"substr(s, pos + 1, {n})")
        head = number_of(f"substr(s, pos + 1, {max(n.bit_length() - 1, 0)})")
        short = (1 << n.bit_length()) - n
        size, value = {
            "unsigned": (str(n), fixed), "signed": (str(n), f"{fixed} - CASE WHEN {fixed} >= {1 << max(n - 1, 0)} THEN {1 << n} ELSE 0 END"),
            "zeros": (f"2 * {run('1')} + 1", f"{number_of('substr(s, pos + 1 + ' + run('1') + ', ' + run('1') + ' + 1)')} - 1"),
            "rice": (f"{run('0')} + 1 + {n}", f"{run('0')} * {1 << n} + {number_of('substr(s, pos + 2 + ' + run('0') + f', {n})')}"),
            "below": (f"CASE WHEN {head} < {short} THEN {n.bit_length() - 1} ELSE {n.bit_length()} END", f"CASE WHEN {head} < {short} THEN {head} ELSE 2 * {head} - {short} + {number_of(f'substr(s, pos + {n.bit_length()}, 1)')} END"),
            "align": ("(8 - pos % 8) % 8", "0"), "skip": (str(n), "0"),
        }[kind]
        out.append(f"u{k} AS (SELECT *, bad OR pos + ({size}) > length(s) AS bad2, {size} AS size FROM t{k})")
        out.append(f"t{k + 1} AS (SELECT doc_id, s, CASE WHEN bad2 THEN pos ELSE pos + size END AS pos, bad2 AS bad{''.join(f', {c}' for c in kept)}{f', CASE WHEN NOT bad2 THEN {value} END AS {name}' if name else ''} FROM u{k})")
        kept += [name] if name else []
    return f"WITH {', '.join(out)} SELECT doc_id, CAST(pos AS INTEGER) AS position, bad AS error, {', '.join(big(c, c) for c in kept)} FROM t{len(FIELDS)}"


@query(_fields_sql())
def bit_fields(spark, sf_dir):
    """The first bytes of each document's text read as fields of a header, with the position and the error state."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.substring(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 1, 24).alias("payload"))
    return bitreader.read_fields(docs, F.col("payload"), FIELDS).drop("payload")


@query(f"WITH n(code, name) AS (VALUES {', '.join(str((i + 1, n)) for i, n in enumerate(UNIT_TYPES))}), k AS (SELECT event_id // 50 AS stream_id, CASE WHEN event_id % 3 = 0 THEN 8 ELSE 1 + event_id % 7 END AS code FROM events) SELECT stream_id, name, count(*) AS units FROM k JOIN n USING (code) GROUP BY ALL")
def unit_type_names(spark, sf_dir):
    """How many units of each type a stream has, by name; units of unknown types are ignored."""
    names = spark.createDataFrame(list(enumerate(UNIT_TYPES, 1)), "type int, name string")  # a dimension of a fixed size
    return obu.units(streams(spark, sf_dir)).where("error IS NULL").join(F.broadcast(names), "type").groupBy("stream_id", "name").agg(F.count(F.lit(1)).alias("units"))


_DISPLAY = ", ".join(f"(s_suppkey * {7 + k}) % 50000 AS p{k}" for k in range(8))


@query(f"SELECT s_suppkey, {_DISPLAY}, s_suppkey * 65537 AS most, s_suppkey % 5000 AS least FROM supplier")
def mastering_display(spark, sf_dir):
    """Primaries, white point and luminances of mastering displays, out of metadata units."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    unit = obu.unit(8, join(number(MASTERING, 1), *[number(k * (7 + i) % 50000, 2) for i in range(8)], number(k * 65537, 4), number(k % 5000, 4))).data
    found = obu.units(s.select(k.alias("stream_id"), unit.alias("content"))).where((F.col("type") == obu.METADATA) & (integer(F.col("payload"), 0, 1) == MASTERING))
    p = F.col("payload")
    return found.select(F.col("stream_id").alias("s_suppkey"), *[integer(p, 1 + 2 * i, 2).alias(f"p{i}") for i in range(8)], integer(p, 17, 4).alias("most"), integer(p, 21, 4).alias("least"))


_TG = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 + l_linenumber % 4 AS log2, (1 << (1 + l_linenumber % 4)) - l_partkey % 3 AS tiles, l_partkey % 2 AS named, l_suppkey % (1 << (1 + l_linenumber % 4)) AS first, (l_suppkey + l_partkey % 5) % (1 << (1 + l_linenumber % 4)) AS last FROM lineitem"


@query(f"WITH t AS ({_TG}), h AS (SELECT *, CASE WHEN tiles > 1 AND named = 1 THEN first ELSE 0 END AS f, CASE WHEN tiles > 1 AND named = 1 THEN last ELSE tiles - 1 END AS l FROM t) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {big('CASE WHEN l >= f AND l < tiles THEN f END', 'first_tile')}, {big('CASE WHEN l >= f AND l < tiles THEN l END', 'last_tile')} FROM h")
def tile_group_headers(spark, sf_dir):
    """The tiles of a group: all, unless a bit says that a first and last one follow; null where they make no range of tiles."""
    one = F.lit(1).cast("bigint")
    log2 = 1 + F.col("l_linenumber") % 4
    size = shifted(one, log2)
    tiles = size - F.col("l_partkey") % 3
    bits = lambda v, n: F.lpad(F.bin(v), n.cast("int"), "0")
    first, last = F.col("l_suppkey") % size, (F.col("l_suppkey") + F.col("l_partkey") % 5) % size
    text = F.concat((F.col("l_partkey") % 2).cast("string"), bits(first, log2), bits(last, log2))
    rows = hold(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), log2=log2.cast("int"), tiles=tiles, header=text)
    named = (F.col("tiles") > 1) & (F.substring("header", 1, 1) == "1")
    at = lambda k: F.conv(F.substring(F.col("header"), 2 + k * F.col("log2"), F.col("log2")), 2, 10).cast("bigint")
    found = hold(rows, f=F.when(named, at(0)).otherwise(0).cast("bigint"), l=F.when(named, at(1)).otherwise(F.col("tiles") - 1).cast("bigint"))
    good = (F.col("l") >= F.col("f")) & (F.col("l") < F.col("tiles"))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(good, F.col("f")).alias("first_tile"), F.when(good, F.col("l")).alias("last_tile"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(length(bin(2 * ((1 + l_partkey % 5000 + 1 + l_suppkey % 70 - 1) // (1 + l_suppkey % 70)) - 1)) - 1 AS BIGINT) AS log2 FROM lineitem")
def tile_log2(spark, sf_dir):
    """How often a size has to be doubled to reach a target: as many as the powers of two below their quotient."""
    size, target = 1 + F.col("l_suppkey") % 70, 1 + F.col("l_partkey") % 5000
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sum((F.when(size * (1 << k) < target, 1).otherwise(0) for k in range(13)), F.lit(0)).cast("bigint").alias("log2"))


_REFS = """rf AS (SELECT event_id // 16 AS frame, event_id % 16 AS slot, CAST(xor(event_id % 16, CAST(3 AS BIGINT)) * 2 + event_id // 16 % 2 AS BIGINT) AS poc, CAST(floor(abs(value)) AS BIGINT) % 200 AS qindex, event_id // 7 % 2 AS layer,
  64 * (1 + user_id % 8) AS width, 48 * (1 + user_id % 5) AS height, (event_id // 16) % 18 AS frame_poc, CAST(1 AS BIGINT) AS frame_layer, event_id // 16 * 13 % 200 AS frame_qindex, event_id % 5 <> 0 AS inter FROM events WHERE event_id % 16 < 8)"""


def _refs(spark, sf_dir) -> DataFrame:
    """References of frames from events: eight slots of every sixteen events."""
    e = F.col("event_id")
    frame = F.floor(e / 16).cast("bigint")
    return read(spark, sf_dir, "events").where(e % 16 < 8).select(
        frame.alias("frame"), (e % 16).alias("slot"), ((e % 16).bitwiseXOR(F.lit(3)) * 2 + frame % 2).alias("poc"), (F.floor(F.abs("value")).cast("bigint") % 200).alias("qindex"), (F.floor(e / 7) % 2).cast("bigint").alias("layer"),
        (64 * (1 + F.col("user_id") % 8)).alias("width"), (48 * (1 + F.col("user_id") % 5)).alias("height"), (frame % 18).alias("frame_poc"), F.lit(1).cast("bigint").alias("frame_layer"), (frame * 13 % 200).alias("frame_qindex"), (e % 5 != 0).alias("inter"),
    )


@query(f"""WITH {_REFS}, d AS (SELECT *, frame_poc - poc AS d, abs(frame_poc - poc) + frame_layer - layer AS far, max(CASE WHEN frame_poc < poc THEN 1 ELSE 0 END) OVER (PARTITION BY frame) AS later FROM rf),
s AS (SELECT *, CASE WHEN later = 1 THEN 64 * far ELSE 128 - (128 >> least(far, 6)) + greatest(far - 6, 0) END - 32 * (length(bin(width * height)) - 1) + qindex AS score FROM d),
u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY frame, score, poc, layer ORDER BY slot) = 1), p AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score, slot) - 1 AS place, count(*) OVER (PARTITION BY frame) AS n FROM u),
q AS (SELECT frame, (max(qindex) + min(qindex) + 1) >> 1 AS thr FROM p GROUP BY frame),
a AS (SELECT p.frame, count(*) FILTER (WHERE d > 0) AS n0, count(*) FILTER (WHERE d < 0) AS n1, coalesce(max(d) FILTER (WHERE d > 0), 0) AS m0, coalesce(max(-d) FILTER (WHERE d < 0), 0) AS m1, coalesce(arg_max(place, d * 16 - place) FILTER (WHERE d > 0), 0) AS f0, coalesce(arg_max(place, -d * 16 - place) FILTER (WHERE d < 0), 0) AS f1 FROM p JOIN q ON q.frame = p.frame WHERE qindex >= thr GROUP BY p.frame),
l AS (SELECT p.frame, slot, score, place, CASE WHEN n = 8 THEN CASE WHEN n0 > n1 OR (n0 = n1 AND m0 >= m1) THEN f0 ELSE f1 END END AS last FROM p JOIN a ON a.frame = p.frame),
r AS (SELECT frame, slot, score, CASE WHEN place = last THEN 7 WHEN place > last THEN place - 1 ELSE place END AS rank FROM l) SELECT frame, slot, {big('score', 'score')}, {big('rank', 'rank')} FROM r WHERE rank < 7""")
def reference_scores(spark, sf_dir):
    """The seven references of each frame in the order of their scores."""
    return references.ranked(_refs(spark, sf_dir)).withColumn("score", F.col("score").cast("bigint"))


@query(f"""WITH {_REFS}, o AS (SELECT frame, list(slot ORDER BY poc, slot) AS o, count(*) FILTER (WHERE poc < frame_poc) AS past, count(*) FILTER (WHERE poc > frame_poc) AS future FROM rf GROUP BY frame)
SELECT frame, CASE WHEN len(o) < 2 THEN NULL WHEN (past > 0 AND future > 0) OR past >= 2 THEN o[past] ELSE o[1] END AS first, CASE WHEN len(o) < 2 THEN NULL WHEN past > 0 AND future > 0 THEN o[past + 1] WHEN past >= 2 THEN o[past - 1] ELSE o[2] END AS second FROM o""")
def interpolation_references(spark, sf_dir):
    return references.interpolated_between(_refs(spark, sf_dir))


@query(f"WITH {_REFS}, o AS (SELECT frame, list(slot ORDER BY abs(qindex - frame_qindex), abs(frame_poc - poc) - 2 * (length(bin(width * height)) - 1), poc DESC, slot) AS o FROM rf WHERE inter GROUP BY frame) SELECT frame, o[1] AS primary_, o[2] AS secondary FROM o")
def model_seed_references(spark, sf_dir):
    return references.model_seeds(_refs(spark, sf_dir)).withColumnRenamed("primary", "primary_")


_WA = f"SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 8 AS mode, [{', '.join(map(str, ANGLES))}][l_partkey % 8 + 1] + (l_suppkey % 7 - 3) * 3 + CASE l_linenumber % 3 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS angle, l_orderkey % 9 - 4 AS rect FROM lineitem"
_TURN = f"[{', '.join(map(str, TURNS))}]"


@query(f"WITH w AS ({_WA}), t AS (SELECT *, CASE WHEN rect > 0 AND angle > 270 - {_TURN}[rect] THEN -180 WHEN rect < 0 AND angle < {_TURN}[-rect] THEN 180 ELSE 0 END AS turn FROM w) SELECT l_orderkey, l_linenumber, l_partkey, {big('angle + turn', 'angle')}, {big('CASE WHEN turn < 0 THEN 2 WHEN turn > 0 THEN 6 ELSE mode END', 'mode')} FROM t")
def wide_angles(spark, sf_dir):
    """Angles of directional modes; those that would leave a rectangular block's short side go to the opposite side, with the mode that lies there."""
    mode, line = F.col("l_partkey") % 8, F.col("l_linenumber") % 3
    angle = F.get(F.array(*map(F.lit, ANGLES)), mode.cast("int")) + (F.col("l_suppkey") % 7 - 3) * 3 + F.when(line == 1, 1).when(line == 2, -1).otherwise(0)
    rect = F.col("l_orderkey") % 9 - 4
    rows = hold(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), m=mode, angle0=angle, rect=rect)
    limit = F.get(F.array(*map(F.lit, TURNS)), (F.abs("rect") - 1).cast("int"))
    turn = F.when((F.col("rect") > 0) & (F.col("angle0") > 270 - limit), -180).when((F.col("rect") < 0) & (F.col("angle0") < limit), 180).otherwise(0)
    rows = hold(rows, turn=turn)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("angle0") + F.col("turn")).cast("bigint").alias("angle"), F.when(F.col("turn") < 0, 2).when(F.col("turn") > 0, 6).otherwise(F.col("m")).cast("bigint").alias("mode"))


def _edge_sql(rules: list[tuple]) -> str:
    before, out = 0, []
    for most in dict.fromkeys(r[0] for r in rules):
        inner = " ".join(f"WHEN angle >= {a} THEN {s}" for m, a, s in rules if m == most)
        out.append(f"WHEN total > {before} AND total <= {most} THEN CASE {inner} ELSE 0 END")
        before = most
    return f"CASE {' '.join(out)} END"


@query(f"WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, 4 + l_partkey % 16 * 4 AS total, l_suppkey % 90 AS angle, l_linenumber % 2 AS smooth FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, {big(f'CASE WHEN smooth = 1 THEN {_edge_sql(SMOOTH_EDGES)} ELSE {_edge_sql(OTHER_EDGES)} END', 'strength')} FROM s")
def edge_strengths(spark, sf_dir):
    """The strength of an edge's filter, from a block's size, how far its angle is from the axis, and whether its neighbours are smooth: the first rule that holds."""
    total, angle, smooth = 4 + F.col("l_partkey") % 16 * 4, F.col("l_suppkey") % 90, F.col("l_linenumber") % 2 == 1

    def strength(rules):
        least = {m: max([x for x in dict.fromkeys(r[0] for r in rules) if x < m], default=0) for m, _, _ in rules}
        return reduce(lambda c, r: c.when((total > least[r[0]]) & (total <= r[0]) & (angle >= r[1]), r[2]), rules[1:], F.when((total > least[rules[0][0]]) & (total <= rules[0][0]) & (angle >= rules[0][1]), rules[0][2])).otherwise(0)

    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(smooth, strength(SMOOTH_EDGES)).otherwise(strength(OTHER_EDGES)).cast("bigint").alias("strength"))


_RC = lambda d: f"(SELECT *, (2 * 65536 + 128 + f) // (2 * (128 + f)) AS rc, k + 9 AS sh FROM (SELECT *, CASE WHEN k > 7 THEN (abs({d}) - (1 << k) + (1 << (k - 8))) >> (k - 7) ELSE (abs({d}) - (1 << k)) << (7 - k) END AS f FROM (SELECT *, length(bin(greatest(1, abs({d})))) - 1 AS k"
_WMP = lambda v: f"greatest(-32768, least(32704, (({v} + 32 - CASE WHEN {v} < 0 THEN 1 ELSE 0 END) >> 6) * 64))"
_SGN = lambda v: f"(sign({v}) * ((abs({v}) + ((CAST(1 AS HUGEINT) << sh) >> 1)) >> sh))"


@query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, 65536 + (l_partkey % 2001 - 1000) * 16 AS a, (l_suppkey % 101 - 50) * 64 AS b, (l_orderkey % 97 - 48) * 64 AS c, 65536 + (l_linenumber - 3) * 512 AS d FROM lineitem),
r AS {_RC('a')} FROM m))), v AS (SELECT *, CAST(c AS HUGEINT) * 65536 * rc AS v1, CAST(b AS HUGEINT) * c * rc AS v2 FROM r),
s AS (SELECT *, {_WMP('(a - 65536)')} AS alpha, {_WMP('b')} AS beta, {_WMP(_SGN('v1'))} AS gamma, {_WMP(f'(d - {_SGN("v2")} - 65536)')} AS delta FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(big(x, x) for x in ('alpha', 'beta', 'gamma', 'delta'))}, 4 * abs(alpha) + 7 * abs(beta) < 196608 AND 4 * abs(gamma) + 4 * abs(delta) < 196608 AS valid FROM s""")
def shear_parameters(spark, sf_dir):
    """The two shears that an affine matrix is taken apart into, by an integer reciprocal, in steps of 64; valid where filters reach far enough."""
    a, b = 65536 + (F.col("l_partkey") % 2001 - 1000) * 16, (F.col("l_suppkey") % 101 - 50) * 64
    c, d = (F.col("l_orderkey") % 97 - 48) * 64, (65536 + (F.col("l_linenumber") - 3) * 512).cast("bigint")
    rows = hold(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), a=a, b=b, c=c, d=d)
    rows = hold(rows, r=reciprocal(F.col("a")))
    inverse, shift = F.col("r.mantissa"), F.col("r.shift")
    magnitude = lambda v: F.sign(v).cast("bigint") * shifted(F.abs(v) + shifted(F.lit(1), shift - 1), -shift)
    step = lambda v: clip(F.floor((v + 32 - F.when(v < 0, 1).otherwise(0)) / 64) * 64, -32768, 32704)
    rows = hold(rows, v1=magnitude(F.col("c") * 65536 * inverse), v2=magnitude(F.col("b") * F.col("c") * inverse))
    rows = hold(rows, alpha=step(F.col("a") - 65536), beta=step(F.col("b")), gamma=step(F.col("v1")), delta=step(F.col("d") - F.col("v2") - 65536))
    valid = (4 * F.abs("alpha") + 7 * F.abs("beta") < 0x30000) & (4 * F.abs("gamma") + 4 * F.abs("delta") < 0x30000)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "alpha", "beta", "gamma", "delta", valid.alias("valid"))


_PT = "pt AS (SELECT l_suppkey, CAST(floor(l_quantity) AS BIGINT) * 8 - 200 AS sx, CAST(floor(l_extendedprice / 100) AS BIGINT) % 400 - 200 AS sy, l_linenumber * 8 AS ox, l_partkey % 17 * 4 AS oy FROM lineitem)"
_SUMS = {"a00": "((sx * sx) >> 2) + sx * 2 + 8", "a01": "((sx * sy) >> 2) + sx + sy + 4", "a11": "((sy * sy) >> 2) + sy * 2 + 8", "bx0": "((sx * dx) >> 2) + sx + dx + 8", "bx1": "((sy * dx) >> 2) + sy + dx + 4", "by0": "((sx * dy) >> 2) + sx + dy + 4", "by1": "((sy * dy) >> 2) + sy + dy + 8"}
_AT = lambda p: f"((CAST({p} AS HUGEINT) * (sign(det) * rc) * (CAST(1 AS HUGEINT) << greatest(0, 16 - sh)) + ((CAST(1 AS HUGEINT) << greatest(0, sh - 16)) >> 1) - CASE WHEN CAST({p} AS HUGEINT) * sign(det) < 0 THEN 1 ELSE 0 END) >> greatest(0, sh - 16))"
_OFF = lambda v: f"greatest(-32704, least(32704, (({v} + 32 - CASE WHEN {v} < 0 THEN 1 ELSE 0 END) >> 6) * 64))"
_ON = lambda v: f"greatest(32832, least(98240, (({v} + 32 - CASE WHEN {v} < 65536 THEN 1 ELSE 0 END) >> 6) * 64))"


@query(f"""WITH {_PT}, p2 AS (SELECT *, sx + ox - 24 AS dx, sy + oy - 32 AS dy FROM pt), sm AS (SELECT l_suppkey, {', '.join(f'CAST(sum({e}) AS BIGINT) AS {n}' for n, e in _SUMS.items())} FROM p2 WHERE abs(sx - dx) < 256 AND abs(sy - dy) < 256 GROUP BY l_suppkey),
dt AS (SELECT *, CAST(a00 AS HUGEINT) * a11 - CAST(a01 AS HUGEINT) * a01 AS det FROM sm), d2 AS (SELECT * REPLACE (CAST(det AS BIGINT) AS det) FROM dt WHERE det <> 0), r AS {_RC('det')} FROM d2))),
w AS (SELECT l_suppkey, {_AT('(a11 * bx0 - a01 * bx1)')} AS m2, {_AT('(a00 * bx1 - a01 * bx0)')} AS m3, {_AT('(a11 * by0 - a01 * by1)')} AS m4, {_AT('(a00 * by1 - a01 * by0)')} AS m5 FROM r)
SELECT l_suppkey, {big(_ON('m2'), 'm2')}, {big(_OFF('m3'), 'm3')}, {big(_OFF('m4'), 'm4')}, {big(_ON('m5'), 'm5')} FROM w""")
def affine_matrix(spark, sf_dir):
    """The affine matrix that fits a group's pairs of points best, in integers: sums by group, a reciprocal of the determinant, and steps of 64.

    Points that move by 256 or more are left out; groups without a determinant have no matrix here.
    """
    points = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.floor("l_quantity").cast("bigint") * 8 - 200).alias("sx"), (F.floor(F.col("l_extendedprice") / 100).cast("bigint") % 400 - 200).alias("sy"), (F.col("l_linenumber") * 8).cast("bigint").alias("ox"), (F.col("l_partkey") % 17 * 4).alias("oy"))
    points = points.withColumns({"dx": F.col("sx") + F.col("ox") - 24, "dy": F.col("sy") + F.col("oy") - 32}).where("abs(sx - dx) < 256 AND abs(sy - dy) < 256")
    quarter = lambda p, q: F.shiftright(F.col(p) * F.col(q), 2)
    square = lambda p: quarter(p, p) + 2 * F.col(p) + 8
    cross = lambda p, q, c: quarter(p, q) + F.col(p) + F.col(q) + c
    sums = {"a00": square("sx"), "a01": cross("sx", "sy", 4), "a11": square("sy"), "bx0": cross("sx", "dx", 8), "bx1": cross("sy", "dx", 4), "by0": cross("sx", "dy", 4), "by1": cross("sy", "dy", 8)}
    c = F.col
    s = hold(points.groupBy("l_suppkey").agg(*[F.sum(v).alias(n) for n, v in sums.items()]), det=c("a00") * c("a11") - c("a01") * c("a01")).where("det <> 0")
    s = hold(s, r=reciprocal(F.abs("det")))
    wide, down = F.sign("det").cast("decimal(38,0)") * c("r.mantissa"), c("r.shift") - 16
    half = lambda: F.when(down > 0, shifted(F.lit(1), down - 1)).otherwise(0)

    def solved(p):
        product = p.cast("decimal(20,0)") * wide.cast("decimal(12,0)") * shifted(F.lit(1), F.greatest(-down, F.lit(0))).cast("decimal(6,0)")
        shifted_down = F.floor((product + half() - F.when(product < 0, 1).otherwise(0)) / shifted(F.lit(1), F.greatest(down, F.lit(0))).cast("decimal(19,0)"))
        return shifted_down.cast("bigint")

    s = hold(s, m2=solved(c("a11") * c("bx0") - c("a01") * c("bx1")), m3=solved(c("a00") * c("bx1") - c("a01") * c("bx0")), m4=solved(c("a11") * c("by0") - c("a01") * c("by1")), m5=solved(c("a00") * c("by1") - c("a01") * c("by0")))
    step = lambda v, middle, low, high: clip(F.shiftright(v + 32 - F.when(v < middle, 1).otherwise(0), 6) * 64, low, high)
    off, on = lambda v: step(c(v), 0, -32704, 32704).alias(v), lambda v: step(c(v), 65536, 32832, 98240).alias(v)
    return s.select("l_suppkey", on("m2"), off("m3"), off("m4"), on("m5"))


@query(f"""WITH {PX}, tri AS (SELECT b, list(v ORDER BY y, x) AS l FROM px GROUP BY b), sq AS (SELECT b, y, x, l, l[CAST(greatest(y, x) * (greatest(y, x) + 1) // 2 + least(y, x) + 1 AS BIGINT)] AS whole FROM tri CROSS JOIN range(8) y(y) CROSS JOIN range(8) x(x))
SELECT {COLS}, {big('whole', 'whole')}, {big('l[CAST(x * 8 + y + 1 AS BIGINT)]', 'transposed')}, {big('l[CAST((y // 2 * 2) * 8 + x // 2 * 2 + 1 AS BIGINT)]', 'sampled')} FROM sq""")
def quantiser_matrices(spark, sf_dir):
    """Square matrices out of a packed lower triangle, transposed ones, and every second entry of every second line, each entry twice in both directions."""
    i_ = F.sequence(F.lit(0), F.lit(63))
    at = lambda f: F.transform(i_, lambda i: F.col("px")[f(F.shiftright(i, 3), i.bitwiseAND(F.lit(7))).cast("int")])
    low, high = F.least, F.greatest
    df = blocks(spark, sf_dir).withColumns({"whole": at(lambda y, x: F.floor(high(y, x) * (high(y, x) + 1) / 2) + low(y, x)), "transposed": at(lambda y, x: x * 8 + y), "sampled": at(lambda y, x: F.shiftright(y, 1) * 16 + F.shiftright(x, 1) * 2)})
    return spread_block(df, "whole", "transposed", "sampled")


def grain_luts(spark, sf_dir):
    """Tables of grain of each supplier's seed and weights, summed up by line. Entries depend on those before them, which SQL would need a recursion over 6,000 steps for; a test fills them in plain Python."""
    k = F.col("key")
    weights = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: (k * 7 + i * 5) % 25 - 12)
    keys = dealt(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")), 4 * grain.ROWS, "key").groupBy("key").agg(F.count("*").alias("times"))
    return grain.lines_of(keys.select("key", (k * 40503 % 65536).alias("seed"), weights.alias("weights"), "times"), lag=2)


QUERIES["grain_luts"] = grain_luts
