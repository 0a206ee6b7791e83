"""ISOBMFF/HEIF containers as tables: boxes, items, extents, properties, associations and references.

Only the walk over nested boxes and variable-length lists runs in Python, on Arrow batches of files;
what the fields of a box mean is left to Columns, so Catalyst can prune and push down.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Brands of a file that is probed as readable; boxes that hold boxes, and the bytes before those.
BRANDS = ("avif", "avis", "av02")
CONTAINERS = {b"meta": 4, b"iprp": 0, b"ipco": 0, b"iref": 4, b"iinf": 6}
#: Boxes that are read of one file unless more are asked for, and how deep they may lie in each other.
MOST_BOXES, MOST_DEPTH = 10_000, 32
#: Bytes that sizes and places in an extent list may have.
WIDTHS = (0, 1, 2, 4, 8)
#: Files, and bytes of files, that are described in one Arrow batch at most, unless one file is larger.
ROWS, BYTES = 256, 8 << 20


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file under path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def probe(content: Column) -> Column:
    """Whether a file starts with a type box of a known brand; a plain predicate, to be put before any parser."""
    return (F.length(content) >= 12) & (F.substring(content, 5, 4) == F.lit(b"ftyp")) & F.substring(content, 9, 4).cast("string").isin(*BRANDS)


def integer(content: Column, at, n: int) -> Column:
    """The big-endian integer of n bytes from position `at` (from 0) on; null if there are fewer."""
    part = F.substring(content, F.lit(at + 1) if isinstance(at, int) else at + 1, F.lit(n))
    return F.when(F.length(part) == n, F.conv(F.hex(part), 16, 10).cast("bigint"))


class Box(NamedTuple):
    depth: int
    parent: int  # the number of the box around it, -1 for none
    fourcc: bytes
    offset: int
    length: int
    head: int  # bytes before the payload


def _walk(data, out: list[Box], most_boxes: int) -> None:
    """Append the boxes of a file in order; their payloads stay where they are.

    A box that says less than its own head for its size is an error, as are too many or too deep
    ones; one that ends beyond what is around it ends the walk there without one.
    """
    around = [(0, len(data), -1)]  # where the walk stands, where it ends, the box around it; the innermost last
    while around:
        at, end, parent = around.pop()
        if at + 8 > end:
            continue
        size, fourcc = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                continue
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        if size < head:
            raise ValueError(f"box size {size} at {at}")
        if at + size > end:
            continue
        if len(out) >= most_boxes:
            raise ValueError("too many boxes")
        if len(around) >= MOST_DEPTH:
            raise ValueError("boxes lie too deep")
        depth = out[parent].depth + 1 if parent >= 0 else 0
        out.append(Box(depth, parent, fourcc, at, size, head))
        around.append((at + size, end, parent))
        if fourcc in CONTAINERS:
            around.append((at + head + CONTAINERS[fourcc], at + size, len(out) - 1))


class _Bits:
    """Big-endian numbers out of a payload, one after the other; IndexError at its end."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.data):
            raise IndexError
        self.at += n
        return int.from_bytes(self.data[self.at - n : self.at], "big")


def _narrow(item: int) -> int:
    """Item ids are of 16 bits; larger ones are read as 0, which is no item."""
    return item if item < 65536 else 0


def _primary(b) -> int:
    r = _Bits(b)
    version = r.take(4) >> 24
    return _narrow(r.take(4 if version else 2))


def _item(b) -> tuple[int, str]:
    """(id, type) of an entry; version 0 has no type."""
    r = _Bits(b)
    version = r.take(4) >> 24
    item = _narrow(r.take(4 if version > 2 else 2))
    r.take(2)
    return item, (r.take(4) if version else 0).to_bytes(4, "big").decode("latin-1")


def _associations(b) -> Iterator[tuple]:
    """(item, ord, idx, essential)"""
    r = _Bits(b)
    head = r.take(4)
    for _ in range(r.take(4)):
        item = _narrow(r.take(4 if head >> 24 else 2))
        for k in range(r.take(1)):
            wide = 1 + (head & 1)
            code = r.take(wide)
            yield item, k, code & (1 << 8 * wide - 1) - 1, bool(code >> 8 * wide - 1)


def _extents(b) -> Iterator[tuple]:
    """(item, ord, offset, length) of what lies in the file itself; other construction methods are skipped.

    ValueError for numbers of an odd size, and for places beyond 63 bits.
    """
    r = _Bits(b)
    version = r.take(4) >> 24
    sizes = r.take(2)
    offset, length, base, index = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version in (1, 2) else 0
    if not {offset, length, base, index} <= set(WIDTHS):
        raise ValueError(f"iloc has numbers of {offset}, {length}, {base} and {index} bytes")
    for _ in range(r.take(2 if version < 2 else 4)):
        item = r.take(2 if version < 2 else 4)
        method = r.take(2) & 15 if version in (1, 2) else 0
        r.take(2)
        start = r.take(base)
        for k in range(r.take(2)):
            r.take(index)
            row = (item, k, start + r.take(offset), r.take(length))
            if row[2] + row[3] >= 1 << 63:
                raise ValueError(f"iloc names a place beyond any file for item {item}")
            if method == 0:
                yield row


def _references(b, kind: bytes, version: int) -> Iterator[tuple]:
    """(type, from, to)"""
    r, wide = _Bits(b), 4 if version else 2
    of = _narrow(r.take(wide))
    for _ in range(r.take(2)):
        yield kind.decode("latin-1"), of, _narrow(r.take(wide))


def _config_units(raw: bytes) -> bytes:
    """The units in a codec configuration, behind its four bytes, or five if a delay is present."""
    return raw[5 if len(raw) > 3 and raw[3] & 16 else 4 :]


#: What `describe` can list of each file.
LISTS = {
    "boxes": "ord int, depth int, parent int, fourcc string, offset bigint, length bigint",
    "items": "item_id bigint, item_type string",
    "properties": "fourcc string, raw binary",
    "associations": "item_id bigint, ord bigint, idx bigint, essential boolean",
    "references": "ref_type string, from_id bigint, ord bigint, to_id bigint",
    "extents": "item_id bigint, ord bigint, offset bigint, length bigint",
    "payloads": "item_id bigint, payload binary",
    "levels": "item_id bigint, max_level int, avg_level int",
}


def _described(data, wanted: tuple[str, ...], most_bytes: int, most_boxes: int, light) -> dict:
    """What one file says of itself: the wanted lists as tuples. Each keeps what comes before a fault, and `errors` names the faults."""
    found: list[Box] = []
    errors = []
    try:
        _walk(data, found, most_boxes)
    except ValueError as e:
        errors.append(str(e))
    first: dict[bytes, int] = {}
    for n, box in enumerate(found):
        first.setdefault(box.fourcc, n)
    inside = lambda box: bytes(data[box.offset + box.head : box.offset + box.length])

    def read(kind: bytes, parse) -> list:
        out: list = []
        if kind in first:
            try:
                for row in parse(inside(found[first[kind]])):
                    out.append(row)
            except IndexError:
                errors.append(f"{kind.decode()} ends too soon")
            except ValueError as e:
                errors.append(str(e))
        return out

    primary = read(b"pitm", lambda b: [_primary(b)])
    out = {"primary_id": primary[0] if primary else None, "errors": errors}
    whole_items = "payloads" in wanted or "levels" in wanted
    if "boxes" in wanted:
        out["boxes"] = [(n, b.depth, b.parent, b.fourcc.decode("latin-1"), b.offset, b.length) for n, b in enumerate(found)]
    if "items" in wanted:
        items: dict[int, str] = {}
        for box in found:
            if box.fourcc == b"infe":
                try:
                    item, kind = _item(inside(box))
                    items.setdefault(item, kind)
                except IndexError:
                    errors.append("infe ends too soon")
        out["items"] = list(items.items())
    if "properties" in wanted or whole_items:
        out["properties"] = [(b.fourcc.decode("latin-1"), inside(b)) for b in found if b.parent == first.get(b"ipco", -2)]
    if "associations" in wanted or whole_items:
        out["associations"] = read(b"ipma", _associations)
    if "references" in wanted:
        references, holder = [], first.get(b"iref", -2)
        for box in found:
            if box.parent == holder:
                try:
                    for row in _references(inside(box), box.fourcc, data[found[holder].offset + found[holder].head]):
                        references.append((row[0], row[1], len(references), row[2]))
                except IndexError:
                    errors.append(f"{box.fourcc.decode('latin-1')} ends too soon")
        out["references"] = references
    if "extents" in wanted or whole_items:
        out["extents"] = read(b"iloc", _extents)
    if whole_items:
        config, of_item, out["payloads"], out["levels"] = {}, {}, [], []
        for item, _, idx, _ in out["associations"]:
            if 0 < idx <= len(out["properties"]) and out["properties"][idx - 1][0] in ("av1C", "av2C"):
                config[item] = _config_units(out["properties"][idx - 1][1])
        for item, _, offset, length in out["extents"]:
            of_item.setdefault(item, []).append((offset, length))
        for item, own in of_item.items():
            if sum(n for _, n in own) + len(config.get(item, b"")) > most_bytes:
                errors.append(f"item {item} is larger than {most_bytes} bytes")
                whole = None
            elif any(a + n > len(data) for a, n in own):
                errors.append(f"item {item} ends beyond the file")
                whole = None
            else:
                parts = [x for x in (config.get(item, b""), *(data[a : a + n] for a, n in own)) if len(x)]
                whole = parts[0] if len(parts) == 1 else b"".join(parts)  # one part is a slice of the file, not a copy
            if "payloads" in wanted:
                out["payloads"].append((item, whole))
            if "levels" in wanted:
                out["levels"].append((item, *(light(whole) if whole is not None else (None, None))))
    return out


def describe(files: DataFrame, wanted: tuple[str, ...] = tuple(LISTS), most_bytes: int = 1 << 28, most_boxes: int = MOST_BOXES) -> DataFrame:
    """One row per file (path, content): path, primary_id, the wanted lists (see LISTS) as arrays, errors.

    One pass over the files, without a shuffle; only what is wanted is read and leaves it. payloads
    are the bytes of every item, its codec configuration's units before its extents, and levels the
    last content light level in them; an item of over most_bytes, or that ends beyond the file, has
    null for them and an error. Of boxes after the first most_boxes, or deeper than MOST_DEPTH, only
    an error is left. Lists are read whole; one that ends too soon, or holds numbers of an odd size
    or beyond 63 bits, keeps the rows before that and gives an error. Null and empty files give empty
    lists; no content of a file raises an exception. Repeated paths are read one by one.
    """
    from .obu import last_light_level

    ddl = "path string, primary_id long, " + "".join(f"{x} array<struct<{LISTS[x]}>>, " for x in wanted) + "errors array<string>"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def table(rows: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([r[x] for r in rows], schema.field(x).type) for x in ("path", "primary_id")]
        for name in wanted:
            kind = schema.field(name).type
            ends = np.cumsum([0] + [len(r[name]) for r in rows], dtype=np.int32)
            fields = list(zip(*(v for r in rows for v in r[name]))) or [()] * kind.value_type.num_fields
            parts = [pa.array(x, kind.value_type.field(i).type) for i, x in enumerate(fields)]
            columns.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, fields=list(kind.value_type))).cast(kind))
        return pa.RecordBatch.from_arrays([*columns, pa.array([r["errors"] for r in rows], pa.list_(pa.string()))], schema=schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer()
                rows.append({"path": path} | _described(memoryview(data) if data is not None else b"", wanted, most_bytes, most_boxes, last_light_level))
                size += len(data) if data is not None else 0
                if len(rows) == ROWS or size > BYTES:
                    yield table(rows)
                    rows, size = [], 0
            if rows:
                yield table(rows)

    return files.select("path", "content").mapInArrow(parse, ddl)


def boxes(described: DataFrame) -> DataFrame:
    """(path, ord, depth, parent, fourcc, offset, length, error): the boxes of each file in order, and a row for each error."""
    found = described.select("path", F.inline("boxes"), F.lit(None).cast("string").alias("error"))
    return found.unionByName(described.select("path", F.explode("errors").alias("error")), allowMissingColumns=True)


def items(described: DataFrame) -> DataFrame:
    """(path, item_id, item_type); the first entry of an id counts."""
    return described.select("path", F.inline("items"))


def properties(described: DataFrame) -> DataFrame:
    """(path, idx, fourcc, raw): the property boxes of the first property container, numbered from 1."""
    return described.select("path", F.posexplode("properties").alias("i", "p")).select("path", (F.col("i") + 1).cast("bigint").alias("idx"), "p.fourcc", "p.raw")


def associations(described: DataFrame) -> DataFrame:
    """(path, item_id, ord, idx, essential)."""
    return described.select("path", F.inline("associations"))


def extents(described: DataFrame) -> DataFrame:
    """(path, item_id, ord, offset, length): ranges of the file; other construction methods are skipped."""
    return described.select("path", F.inline("extents"))


def references(described: DataFrame) -> DataFrame:
    """(path, ref_type, from_id, ord, to_id) of the boxes in the reference box."""
    return described.select("path", F.inline("references"))


class Bytes(NamedTuple):
    """Bytes to write, and how many they are; the size is kept beside, so that nested boxes don't repeat what is in them."""

    data: Column
    size: Column


def number(v, n: int) -> Bytes:
    """v as n big-endian bytes."""
    return Bytes(F.unhex(F.lpad(F.hex((v if isinstance(v, Column) else F.lit(v)).cast("bigint")), 2 * n, "0")), F.lit(n))


def text(v: Column) -> Bytes:
    return Bytes(F.encode(v, "utf-8"), F.octet_length(v))


def literal(v: bytes) -> Bytes:
    return Bytes(F.lit(v), F.lit(len(v)))


def join(*parts: Bytes) -> Bytes:
    return Bytes(F.concat(*[p.data for p in parts]), reduce(lambda a, b: a + b, [p.size for p in parts])) if parts else literal(b"")


def choose(condition: Column, then: Bytes, otherwise: Bytes | None = None) -> Bytes:
    otherwise = otherwise or literal(b"")
    return Bytes(F.when(condition, then.data).otherwise(otherwise.data), F.when(condition, then.size).otherwise(otherwise.size))


def box(fourcc: str, *payload: Bytes) -> Bytes:
    """The bytes of a box around a payload."""
    whole = join(*payload)
    return join(number(whole.size + 8, 4), literal(fourcc.encode()), whole)
