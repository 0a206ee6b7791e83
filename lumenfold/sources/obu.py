"""Length-prefixed unit streams: one row for each unit of a stream, with its header fields."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .isobmff import Bytes, integer, join, number

#: The unit type of metadata, and the metadata type of content light levels.
METADATA, LIGHT_LEVEL = 8, 1


def _units(data: bytes) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(ord, type, tlayer, mlayer, xlayer, payload) of each unit; ValueError for a length of over eight bytes or beyond the end."""
    at = n = 0
    while at < len(data):
        size = shift = 0
        for _ in range(8):
            if at >= len(data):
                raise ValueError("length cut off")
            byte = data[at]
            at += 1
            size |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        else:
            raise ValueError("length of over eight bytes")
        if at + size > len(data):
            raise ValueError("unit cut off")
        body, at = data[at : at + size], at + size
        if body:
            head = 2 if body[0] & 128 else 1
            if len(body) < head:
                raise ValueError("header cut off")
            extension = body[1] if head == 2 else 0
            yield n, body[0] >> 2 & 31, body[0] & 3, extension >> 5, extension & 31, body[head:]
        n += 1


def units(streams: DataFrame) -> DataFrame:
    """(stream_id, ord, type, tlayer, mlayer, xlayer, payload, error) of streams (stream_id, content).

    A malformed stream gives its units up to the fault and a row with the error.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["stream_id", "ord", "type", "tlayer", "mlayer", "xlayer", "payload", "error"]
        kinds = [pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.string()]
        for batch in batches:
            rows = []
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    for unit in _units(content or b""):
                        rows.append((key, *unit, None))
                except ValueError as e:
                    rows.append((key, None, None, None, None, None, None, str(e)))
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return streams.select(F.col("stream_id").cast("long").alias("stream_id"), "content").mapInArrow(parse, "stream_id long, ord int, type int, tlayer int, mlayer int, xlayer int, payload binary, error string")


def light_levels(found: DataFrame) -> DataFrame:
    """(stream_id, max_level, avg_level): the last content light level of each stream."""
    p = F.col("payload")
    levels = found.where((F.col("type") == METADATA) & (integer(p, 0, 1) == LIGHT_LEVEL)).select("stream_id", "ord", integer(p, 1, 2).alias("most"), integer(p, 3, 2).alias("average"))
    return levels.groupBy("stream_id").agg(F.max_by("most", "ord").alias("max_level"), F.max_by("average", "ord").alias("avg_level"))


def last_light_level(data: bytes) -> tuple[int | None, int | None]:
    """(maximum, average) of the last content light level in a run of units; a fault ends the run."""
    level = (None, None)
    try:
        for _, kind, _, _, _, payload in _units(data):
            if kind == METADATA and len(payload) > 4 and payload[0] == LIGHT_LEVEL:
                level = (int.from_bytes(payload[1:3], "big"), int.from_bytes(payload[3:5], "big"))
    except ValueError:
        pass
    return level


def unit(kind, payload: Bytes) -> Bytes:
    """The bytes of a unit of under 127 bytes without extension layers."""
    return join(number(payload.size + 1, 1), number(F.shiftleft(kind, 2) if isinstance(kind, Column) else kind << 2, 1), payload)
