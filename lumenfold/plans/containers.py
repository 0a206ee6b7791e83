"""Queries over containers and unit streams that Spark writes from the part, supplier and events tables.

Every part becomes a file with one image item, and every fifth one an alpha item too; the SQL
says from the part's own columns what parsing and joining the bytes has to give back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import container
from ..sources import obu
from ..sources.isobmff import box, choose, join, literal, number, probe, text
from ..sources.planes import hold, read
from ..streaming import session

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def files(spark, sf_dir) -> DataFrame:
    """(path, content): a type box, the data of two extents for item 1 and, with alpha, one for item 2, then the metadata."""
    k = F.col("p_partkey")
    alpha, mirror, twice = k % 5 == 0, k % 3 == 0, k % 7 == 0
    first, second = text(F.substring("p_name", 1, 3)), text(F.substring(F.col("p_name"), F.lit(4), F.length("p_name")))
    brand = choose(k % 4 == 3, literal(b"heic"), literal(b"avif"))
    level = obu.unit(8, join(number(1, 1), number(100 + k % 4000, 2), number(k % 400, 2)))
    head = box("ftyp", brand, number(0, 4), brand)
    kind = text(F.col("p_type"))
    data = box("mdat", first, literal(b"gap"), second, kind)
    base = head.size + 8

    def entry(item, kind_):
        wide = k % 4 == 1  # version 3, which has ids of four bytes; every sixth file has version 1
        version = F.when(wide, 3).when(k % 6 == 0, 1).otherwise(2)
        return box("infe", number(version * (1 << 24), 4), choose(wide, number(item, 4), number(item, 2)), number(0, 2), literal(kind_), number(0, 1))

    def count(n):
        return number(F.when(alpha, 2).otherwise(1), n)

    def reference(item):
        return choose(k % 2 == 1, number(item, 4), number(item, 2))

    meta = [
        box("pitm", number(0, 4), number(1, 2)),
        box("iinf", number(0, 4), count(2), entry(1, b"av02"), choose(alpha, entry(2, b"av02"))),
        box("iloc", number(0, 4), number(0x4400, 2), count(2),
            number(1, 2), number(0, 2), number(2, 2), number(base, 4), number(first.size, 4), number(base + first.size + 3, 4), number(second.size, 4),
            choose(alpha, join(number(2, 2), number(0, 2), number(1, 2), number(base + first.size + 3 + second.size, 4), number(kind.size, 4)))),
        box("iprp",
            box("ipco",
                box("ispe", number(0, 4), number(1, 4), number(1, 4)),
                box("ispe", number(0, 4), number(64 + k % 1000, 4), number(48 + F.col("p_size"), 4)),
                box("irot", number(k % 4, 1)),
                box("imir", number(k % 2, 1)),
                box("pasp", number(1 + k % 3, 4), number(1 + k % 2, 4)),
                box("auxC", number(0, 4), literal(container.ALPHA[0].encode() + b"\0")),
                box("av2C", number(0x81, 1), number(0, 1), number((k % 4) * 32 + (k % 2) * 16 + (F.floor(k / 5) % 4) * 4, 1), number((k % 2) * 16, 1), choose(k % 2 == 1, number(7, 1)), level),
                box("colr", literal(b"nclx"), number(1 + k % 12, 2), number(13, 2), number(k % 9, 2), number((k % 2) * 128, 1)),
                box("colr", literal(b"prof"), text(F.col("p_brand"))),
                box("clap", number(F.col("p_size") * 10, 4), number(3, 4), number(F.col("p_size") * 7, 4), number(8, 4), number(F.pmod(k % 9 - 4, F.lit(1 << 32)), 4), number(2, 4), number(F.pmod(k % 5 - 2, F.lit(1 << 32)), 4), number(4, 4))),
            box("ipma", number(0, 4), count(4),
                number(1, 2), number(F.when(mirror, 10).otherwise(9), 1), number(1, 1), number(0x82, 1), number(3, 1), choose(mirror, number(0x84, 1)), number(5, 1), number(99, 1), number(7, 1), number(8, 1), number(9, 1), number(10, 1),
                choose(alpha, join(number(2, 2), number(2, 1), number(1, 1), number(6, 1))))),
        choose(alpha, box("iref", number((k % 2) * (1 << 24), 4), box("auxl", reference(2), number(1, 2), reference(1)), choose(k % 10 == 0, box("prem", reference(1), number(1, 2), reference(2))))),
    ]
    late = choose(twice, box("meta", number(0, 4), box("pitm", number(0, 4), number(9, 2))))
    content = join(head, data, box("meta", number(0, 4), *meta), late).data
    return hold(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), path=F.concat(F.lit("part/"), k), content=content).select("path", "content")


_P = "p AS (SELECT *, 'part/' || p_partkey AS path, p_partkey % 4 AS rot, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 END AS axis FROM part), f AS (SELECT * FROM p WHERE p_partkey % 4 <> 3)"
_NAME = """CASE WHEN axis IS NULL THEN CASE rot WHEN 0 THEN 'Normal' WHEN 1 THEN 'Rotate270' WHEN 2 THEN 'Rotate180' ELSE 'Rotate90' END
  WHEN rot = 0 THEN CASE axis WHEN 0 THEN 'FlipH' ELSE 'FlipV' END WHEN rot = 3 AND axis = 0 THEN 'Transpose' WHEN rot = 1 AND axis = 0 THEN 'Transverse' ELSE 'Normal' END"""


@query(f"WITH {_P} SELECT path, p_partkey % 4 <> 3 AS readable FROM p")
def probe_filter(spark, sf_dir):
    return files(spark, sf_dir).select("path", probe(F.col("content")).alias("readable"))


_CROP = "SELECT p_partkey, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y, CASE WHEN ok THEN w END AS w, CASE WHEN ok THEN h END AS h FROM (SELECT *, x >= 0 AND y >= 0 AND w > 0 AND h > 0 AND x + w <= width AND y + h <= height AS ok FROM (SELECT p_partkey, width, height, CAST(round((width - 1) / 2 + xo - (cw - 1) / 2) AS BIGINT) AS x, CAST(round((height - 1) / 2 + yo - (ch - 1) / 2) AS BIGINT) AS y, CAST(round(cw) AS BIGINT) AS w, CAST(round(ch) AS BIGINT) AS h FROM (SELECT p_partkey, CAST(64 + p_partkey % 1000 AS DOUBLE) AS width, CAST(48 + p_size AS DOUBLE) AS height, p_size * 10 / 3 AS cw, p_size * 7 / 8 AS ch, (p_partkey % 9 - 4) / 2 AS xo, (p_partkey % 5 - 2) / 4 AS yo FROM part)))"


@query(f"""WITH {_P}, crops AS ({_CROP}) SELECT path, 64 + p_partkey % 1000 AS width, CAST(48 + p_size AS BIGINT) AS height, 'av02' AS item_type, {_NAME} AS orientation, 1 + p_partkey % 3 AS h_spacing, 1 + p_partkey % 2 AS v_spacing, p_partkey % 5 = 0 AS has_alpha, p_partkey % 10 = 0 AS premultiplied,
CASE WHEN p_partkey % 2 = 1 THEN 'I400' ELSE CASE p_partkey // 5 % 4 WHEN 3 THEN 'I420' WHEN 2 THEN 'I422' ELSE 'I444' END END AS layout, CAST(CASE p_partkey % 4 WHEN 1 THEN 12 WHEN 2 THEN 10 WHEN 3 THEN 12 ELSE 8 END AS INTEGER) AS bit_depth,
1 + p_partkey % 12 AS primaries, CAST(13 AS BIGINT) AS transfer, p_partkey % 9 AS matrix, p_partkey % 2 = 1 AS full_range, p_brand AS icc, c.x AS crop_x, c.y AS crop_y, c.w AS crop_w, c.h AS crop_h,
CAST(100 + p_partkey % 4000 AS INTEGER) AS max_level, CAST(p_partkey % 400 AS INTEGER) AS avg_level FROM f JOIN crops c USING (p_partkey)""")
def container_image_info(spark, sf_dir):
    found = container.images(files(spark, sf_dir))
    return found.select(
        "path", "width", "height", "item_type", "orientation", "h_spacing", "v_spacing", "has_alpha", "premultiplied", "layout", "bit_depth", "colour.*", F.col("icc").cast("string").alias("icc"),
        *[F.col(f"crop.{x}").alias(f"crop_{x}") for x in "xywh"], "max_level", "avg_level",
    )


_TYPES = "('ispe', 2 + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END), ('irot', 1), ('imir', CASE WHEN p_partkey % 3 = 0 THEN 1 END), ('pasp', 1), ('auxC', CASE WHEN p_partkey % 5 = 0 THEN 1 END), ('av2C', 1), ('colr', 2), ('clap', 1)"


@query(f"WITH {_P} SELECT path, fourcc, CAST(n AS BIGINT) AS n FROM f, LATERAL (VALUES {_TYPES}) v(fourcc, n) WHERE n IS NOT NULL")
def ipma_property_join(spark, sf_dir):
    found = container.item_properties(container.described(files(spark, sf_dir), "properties", "associations"))
    return found.groupBy("path", "fourcc").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_P} SELECT path, CAST(2 AS BIGINT) AS alpha_id FROM f WHERE p_partkey % 5 = 0")
def alpha_resolution(spark, sf_dir):
    found = container.described(files(spark, sf_dir), "properties", "associations", "references").select("path", container.alpha_of(F.col("primary_id")).alias("alpha_id"))
    return found.where("alpha_id IS NOT NULL")


@query(f"WITH {_P} SELECT path, {_NAME} AS orientation FROM f")
def orientation_from_irot_imir(spark, sf_dir):
    return container.described(files(spark, sf_dir), "properties", "associations").select("path", container.orientation_of(container.properties_of(F.lit(1))).alias("orientation"))


_UNIT = "'062001' || lpad(to_hex(100 + p_partkey % 4000), 4, '0') || lpad(to_hex(p_partkey % 400), 4, '0')"


@query(f"WITH {_P} SELECT path, CAST(1 AS BIGINT) AS item_id, upper({_UNIT}) || hex(encode(p_name)) AS payload FROM f UNION ALL SELECT path, 2, hex(encode(p_type)) FROM f WHERE p_partkey % 5 = 0")
def iloc_gather(spark, sf_dir):
    return container.payloads(files(spark, sf_dir)).select("path", "item_id", F.hex("payload").alias("payload"))


@query(f"WITH {_P} SELECT path, CAST(20 + CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 0 END + CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 0 END AS BIGINT) AS boxes, CAST(1 AS BIGINT) AS primary_id FROM f")
def box_inventory(spark, sf_dir):
    return container.described(files(spark, sf_dir), "boxes").select("path", F.size("boxes").cast("bigint").alias("boxes"), "primary_id")


@query(_CROP)
def clean_aperture_rect(spark, sf_dir):
    k, one = F.col("p_partkey"), F.lit(1)
    rect = container.crop((64 + k % 1000).cast("double"), (48 + F.col("p_size")).cast("double"), F.col("p_size") * 10, one * 3, F.col("p_size") * 7, one * 8, k % 9 - 4, one * 2, k % 5 - 2, one * 4)
    return read(spark, sf_dir, "part").select("p_partkey", rect.alias("r")).select("p_partkey", "r.x", "r.y", "r.w", "r.h")


_KIND = "CASE WHEN event_id % 3 = 0 THEN 8 ELSE 1 + event_id % 7 END"


def streams(spark, sf_dir) -> DataFrame:
    """(stream_id, content): 50 events to a stream, a unit for each; every third one says a light level."""
    e = F.col("event_id")
    level = join(number(1, 1), number(e % 60000, 2), number((e * 7) % 50000, 2))
    one = choose(e % 3 == 0, obu.unit(8, level), obu.unit(1 + e % 7, number(e % 65536, 2))).data
    units = read(spark, sf_dir, "events").select(F.floor(e / 50).cast("bigint").alias("stream_id"), e, F.hex(one).alias("hex"))
    joined = units.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "hex"))).alias("u"))
    return joined.select("stream_id", F.unhex(F.array_join(F.transform("u", lambda x: x["hex"]), "")).alias("content"))


@query("SELECT event_id // 50 AS stream_id, max(event_id) % 60000 AS max_level, (max(event_id) * 7) % 50000 AS avg_level FROM events WHERE event_id % 3 = 0 GROUP BY 1")
def cll_last_wins(spark, sf_dir):
    return obu.light_levels(obu.units(streams(spark, sf_dir)))


@query(f"SELECT event_id // 50 AS stream_id, CAST({_KIND} AS BIGINT) AS type, count(*) AS units, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 5 ELSE 2 END) AS BIGINT) AS bytes FROM events GROUP BY 1, 2")
def obu_inventory(spark, sf_dir):
    return obu.units(streams(spark, sf_dir)).where("error IS NULL").groupBy("stream_id", F.col("type").cast("bigint").alias("type")).agg(F.count(F.lit(1)).alias("units"), F.sum(F.length("payload")).alias("bytes"))


_FRAMES = f"f AS (SELECT event_id // {session.FRAMES} AS stream_id, event_id % {session.FRAMES} AS decode_ord, xor(event_id % {session.FRAMES}, 3) AS disp_order FROM events)"
_ORDERED = f"WITH {_FRAMES} SELECT stream_id, decode_ord, disp_order, row_number() OVER (PARTITION BY stream_id ORDER BY disp_order) - 1 AS out_seq FROM f"


@query(_ORDERED)
def display_order_reorder(spark, sf_dir):
    return session.display_order(session.frames(read(spark, sf_dir, "events")))


@query(_ORDERED)
def stateful_session(spark, sf_dir):
    return session.run_stream(spark, f"{sf_dir}/events.parquet").drop("error")


def session_resets(spark, sf_dir):
    """Streams with new sequences and faults, in display order. What a fault loses depends on the buffer's history, so it has no SQL; a test replays it in plain Python."""
    return session.run_stream(spark, f"{sf_dir}/events.parquet", session.broken_frames)


QUERIES["session_resets"] = session_resets
