"""Headers whose fields depend on fields read before: a layout says what follows what, a batch of payloads is read at once.

A layout is a list of steps. A step may be for some payloads only (`when`), take its size from
earlier values, or be a loop that goes on as long as a condition holds. Every step is done for all
payloads of an Arrow batch together, as arrays of bit positions and values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What conditions and sizes are worked out from: the values so far, by name, an array over payloads each; 0 where a field was not read.
Values = dict


class Field(NamedTuple):
    """A field of the payload.

    kind: bits (n of them, 32 at most), signed (n bits, two's complement), zeros (a run of z zeros, a
    one, z bits: 2**z - 1 and what those say; 32 zeros are 2**32 - 1), rice (a run of ones, a zero, n
    bits), below (less than n in the fewest bits, the shorter form first; nothing is read if n is 1).
    """

    name: str
    n: int | Callable[[Values], np.ndarray] = 1
    kind: str = "bits"
    when: Callable[[Values], np.ndarray] | None = None


class Let(NamedTuple):
    """A value worked out from earlier ones; one whose name begins with an underscore is not returned."""

    name: str
    value: Callable[[Values], np.ndarray]
    when: Callable[[Values], np.ndarray] | None = None


class Check(NamedTuple):
    """A payload for which it doesn't hold is in error from here on."""

    good: Callable[[Values], np.ndarray]


class Loop(NamedTuple):
    """Steps repeated while `going` holds, `most` times at most; `_i` counts from 0. A list of structs is returned."""

    name: str
    most: int
    going: Callable[[Values], np.ndarray]
    steps: list


class When(NamedTuple):
    """Steps for some payloads only; loops among them are empty for others."""

    condition: Callable[[Values], np.ndarray]
    steps: list


class Gather(NamedTuple):
    """A list of values by name, for each payload that gets here; their names may begin with underscores."""

    name: str
    values: list[str]


class _Reading:
    """Bits of all payloads of a batch, one place in each, and the values so far."""

    def __init__(self, payloads: list[bytes]):
        sizes = np.array([len(p) for p in payloads], np.int64)
        self.data = np.frombuffer(b"".join(payloads) + bytes(16), np.uint8)
        self.eight = np.ndarray((len(self.data) - 7,), ">u8", self.data, strides=(1,))
        self.start = (np.cumsum(sizes) - sizes) * 8
        self.at, self.end = self.start.copy(), self.start + sizes * 8
        self.error = np.zeros(len(payloads), bool)
        self.values: Values = {"_i": np.zeros(len(payloads), np.int64)}
        self.present: dict[str, np.ndarray] = {}

    def peek(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next n bits, 57 at most, as unsigned numbers; beyond the last payload there are zeros."""
        at = np.minimum(at, len(self.data) * 8 - 128 + 7)
        window = self.eight[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        return np.where(n > 0, window >> (64 - np.maximum(n, 1)).astype(np.uint64), np.uint64(0)).astype(np.int64)

    def field(self, step: Field, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, bits) of a field at every place."""
        ones = np.ones(len(self.at), np.int64)
        n = np.broadcast_to(step.n(self.values) if callable(step.n) else step.n, ones.shape).astype(np.int64)
        if step.kind in ("bits", "signed"):
            n = np.where(active, n, 0)
            got = self.peek(self.at, n)
            return got - np.where((step.kind == "signed") & (n > 0) & (got >> np.maximum(n - 1, 0) == 1), 1 << n, 0), n
        if step.kind in ("zeros", "rice"):
            head = self.peek(self.at, 33 * ones)
            run = 33 - np.frexp((head if step.kind == "zeros" else (1 << 33) - 1 - head).astype(float))[1].astype(np.int64)
            if step.kind == "rice":
                run = np.minimum(run, 32 - n)
                return np.where(run + n == 32, (1 << 32) - 1, (run << n) + self.peek(self.at + run + 1, n)), np.where(run + n == 32, run, run + 1 + n)
            return np.where(run >= 32, (1 << 32) - 1, (1 << np.minimum(run, 31)) - 1 + self.peek(self.at + run + 1, np.minimum(run, 31))), np.where(run >= 32, 32, 2 * run + 1)
        if step.kind == "below":
            n = np.maximum(n, 1)
            long = np.frexp(n.astype(float))[1].astype(np.int64)
            short, head = (1 << long) - n, self.peek(self.at, long - 1)
            wide = head >= short
            got = np.where(wide, 2 * head - short + self.peek(self.at + long - 1, ones), head)
            return np.where(n > 1, got, 0), np.where(n > 1, long - 1 + wide, 0)
        raise ValueError(f"unknown kind of field {step.kind!r}")

    def run(self, steps: list, active: np.ndarray, out: dict) -> None:
        """Do the steps where active; out gets (values, where they are present) by name, and for a loop a list of such dicts."""
        for step in steps:
            now = active & ~self.error
            if isinstance(step, Loop):
                rounds: list = []
                own, self.values["_i"] = self.values["_i"], np.zeros(len(self.at), np.int64)
                for i in range(step.most):
                    now = now & ~self.error & step.going(self.values)
                    if not now.any():
                        break
                    found: dict = {"": now.copy()}
                    self.run(step.steps, now, found)
                    rounds.append(found)
                    self.values["_i"] = self.values["_i"] + 1
                out[step.name], self.values["_i"] = rounds, own
                continue
            if isinstance(step, When):
                self.run(step.steps, now & step.condition(self.values), out)
                continue
            if isinstance(step, Gather):
                out[step.name] = (np.stack([self.values[x] for x in step.values], 1), now)
                continue
            if isinstance(step, Check):
                self.error |= now & ~step.good(self.values)
                continue
            if step.when is not None:
                now = now & step.when(self.values)
            if isinstance(step, Let):
                got = np.broadcast_to(step.value(self.values), now.shape)
            else:
                got, size = self.field(step, now)
                bad = now & (self.at + size > self.end)
                self.error |= bad
                now = now & ~bad
                self.at = np.where(now, self.at + size, self.at)
            self.values[step.name] = np.where(now, got, self.values.get(step.name, np.zeros(len(now), np.int64)))
            before = out.get(step.name)  # a step of the same name for other payloads
            out[step.name] = (self.values[step.name], now if before is None else now | before[1])


def _names(steps: list) -> dict[str, Loop | Gather | None]:
    """What a layout returns, in order; loops and lists by themselves."""
    found: dict[str, Loop | Gather | None] = {}
    for s in steps:
        if isinstance(s, When):
            found |= _names(s.steps)
        elif not isinstance(s, Check) and not s.name.startswith("_"):
            found[s.name] = s if isinstance(s, (Loop, Gather)) else None
    return found


def _ddl(steps: list) -> str:
    kind = lambda s: "bigint" if s is None else "array<bigint>" if isinstance(s, Gather) else f"array<struct<{_ddl(s.steps)}>>"
    return ", ".join(f"{name} {kind(s)}" for name, s in _names(steps).items())


def _whole(found: dict, step: Gather, rows: int) -> pa.Array:
    values, there = found.get(step.name, (np.zeros((rows, len(step.values)), np.int64), np.zeros(rows, bool)))
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * values.shape[1], pa.int32()), pa.array(values.reshape(-1), pa.int64()), mask=pa.array(~there))


def _column(found: dict, name: str, rows: int) -> pa.Array:
    values, there = found.get(name, (np.zeros(rows, np.int64), np.zeros(rows, bool)))
    return pa.array(values, pa.int64(), mask=~there)


def _list(rounds: list, loop: Loop, rows: int) -> pa.Array:
    """A list for each payload: its rounds in order."""
    there = np.stack([r[""] for r in rounds], 1) if rounds else np.zeros((rows, 0), bool)
    ends = np.concatenate(([0], np.cumsum(there.sum(1)))).astype(np.int32)
    parts = []
    for name in _names(loop.steps):
        pairs = [r.get(name, (np.zeros(rows, np.int64), np.zeros(rows, bool))) for r in rounds]
        values, own = (np.stack(x, 1)[there] if rounds else np.zeros(0, np.int64) for x in zip(*pairs)) if rounds else (np.zeros(0, np.int64), np.zeros(0, bool))
        parts.append(pa.array(values, pa.int64(), mask=~own.astype(bool)))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, names=list(_names(loop.steps))))


def read_header(df: DataFrame, payload: str, layout: list) -> DataFrame:
    """df without its payload, with a column for each field, `position` (bits read) and `error`.

    A field that would end beyond its payload, or a check that fails, sets `error`; what was read
    before stays, and all after it is null (loops end there). A field for other payloads only is null.
    A null payload is empty. Loops are lists of structs.
    """
    others = [c for c in df.columns if c != payload]
    schema = StructType([*df.select(*others).schema.fields, *StructType.fromDDL(f"{_ddl(layout)}, position int, error boolean").fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = len(batch), {}
            reading = _Reading([x or b"" for x in batch.column(payload).to_pylist()])
            reading.run(layout, np.ones(rows, bool), found)
            columns = [_column(found, name, rows) if s is None else _whole(found, s, rows) if isinstance(s, Gather) else _list(found.get(name, []), s, rows) for name, s in _names(layout).items()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *columns, pa.array((reading.at - reading.start).astype(np.int32)), pa.array(reading.error)], names=[*others, *_names(layout), "position", "error"])

    return df.mapInArrow(parse, schema)


def bytes_of(bits: Column) -> Column:
    """A string of 0 and 1 as bytes, with zeros up to a whole one."""
    whole = F.rpad(bits, (F.ceil(F.length(bits) / 8) * 8).cast("int"), "0")
    byte = lambda i: F.lpad(F.conv(F.substring(whole, 8 * i + 1, F.lit(8)), 2, 16), 2, "0")
    return F.when(F.length(bits) > 0, F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), (F.length(whole) / 8).cast("int") - 1), byte), ""))).otherwise(F.lit(b""))


# What the layouts below have in common: conditions on values by name.
def _is(name: str, *values: int) -> Callable[[Values], np.ndarray]:
    return lambda v: np.isin(v[name], values)


def _not(name: str, *values: int) -> Callable[[Values], np.ndarray]:
    return lambda v: ~np.isin(v[name], values)


def _both(*conditions: Callable[[Values], np.ndarray]) -> Callable[[Values], np.ndarray]:
    return lambda v: np.logical_and.reduce([c(v) for c in conditions])


#: Segments, as many as `_segments` says: a quantiser difference if a bit announces it, and two flags.
SEGMENTS = Loop("segments", 16, lambda v: v["_i"] < v["_segments"], [Field("changed"), Field("difference", 10, "signed", _is("changed", 1)), Let("delta", lambda v: np.clip(v["difference"], -351, 351), _is("changed", 1)), Field("skip"), Field("global_motion")])

#: Sides of a sample by its code from 1 to 16; primaries, transfer and matrix of the described kinds 1 to 5.
ASPECTS = [(1, 1), (12, 11), (10, 11), (16, 11), (40, 33), (24, 11), (20, 11), (32, 11), (80, 33), (18, 11), (15, 11), (64, 33), (160, 99), (4, 3), (3, 2), (2, 1)]
DESCRIBED = [(1, 1, 1), (9, 16, 9), (9, 18, 9), (1, 13, 0), (1, 13, 5)]


def _named(table: list[tuple], column: int, code: str, first: int = 1) -> Callable[[Values], np.ndarray]:
    known = np.array([2 if table is DESCRIBED else 0, *[row[column] for row in table]])  # 2: unknown
    return lambda v: known[np.where((v[code] >= first) & (v[code] < first + len(table)), v[code] - first + 1, 0)]


#: How pictures are to be shown: scan, colours, places of chroma samples, sample aspect, timing.
CONTENT = [
    Field("scan", 2), *[Field(x) for x in ("has_colour", "has_chroma", "has_aspect", "has_timing", "has_extension", "_reserved")],
    Field("kind", 2, "rice", _is("has_colour", 1)),
    *[Field(x, 8, when=_both(_is("has_colour", 1), _is("kind", 0))) for x in ("primaries", "transfer", "matrix")],
    *[Let(x, _named(DESCRIBED, i, "kind"), _both(_is("has_colour", 1), _not("kind", 0))) for i, x in enumerate(("primaries", "transfer", "matrix"))],
    Field("full_range", when=_is("has_colour", 1)),
    Field("chroma_first", 0, "zeros", _is("has_chroma", 1)), Field("chroma_second", 0, "zeros", _both(_is("has_chroma", 1), _not("scan", 1))), Let("chroma_second", lambda v: v["chroma_first"], _both(_is("has_chroma", 1), _is("scan", 1))),
    Field("aspect", 8, when=_is("has_aspect", 1)),
    *[Field(x, 0, "zeros", _both(_is("has_aspect", 1), _is("aspect", 255))) for x in ("sample_width", "sample_height")],
    *[Let(x, _named(ASPECTS, i, "aspect"), _both(_is("has_aspect", 1), _not("aspect", 255))) for i, x in enumerate(("sample_width", "sample_height"))],
    Field("tick", 32, when=_is("has_timing", 1)), Field("time_scale", 32, when=_is("has_timing", 1)), Check(lambda v: (v["has_timing"] == 0) | (v["tick"] > 0) & (v["time_scale"] > 0)),
    Field("equal_interval", when=_is("has_timing", 1)), Field("_ticks", 0, "zeros", _both(_is("has_timing", 1), _is("equal_interval", 1))), Check(lambda v: v["_ticks"] < (1 << 32) - 1), Let("ticks", lambda v: v["_ticks"] + 1, _both(_is("has_timing", 1), _is("equal_interval", 1))),
]


def _grain_points(plane: str, when: Callable[[Values], np.ndarray]) -> list:
    """Up to 14 points of a scaling function; places are written as steps from the one before."""
    some = _both(when, lambda v: v[f"{plane}_count"] > 0)
    return [
        Field(f"{plane}_count", 4, when=when), Check(lambda v: v[f"{plane}_count"] <= 14), Field("_index", 3, when=some), Field("_scale", 2, when=some), Let("_place", lambda v: 0),
        Loop(f"{plane}_points", 14, lambda v: when(v) & (v["_i"] < v[f"{plane}_count"]), [Field("_step", lambda v: 1 + v["_index"]), Let("_place", lambda v: v["_place"] + v["_step"]), Check(lambda v: v["_place"] <= 255), Let("place", lambda v: v["_place"]), Field("scale", lambda v: 5 + v["_scale"])]),
    ]


def _grain_weights(plane: str) -> list:
    """Coefficients of a plane's auto-regression: as many as its lag reaches, one more for the luma beside chroma."""
    used = (lambda v: v["y_count"] > 0) if plane == "y" else (lambda v: (v[f"{plane}_count"] > 0) | (v["from_luma"] > 0))
    count = lambda v: 2 * v["lag"] * (v["lag"] + 1) + ((v["y_count"] > 0) if plane != "y" else 0)
    return [Field("_wide", 2, when=used), Loop(f"{plane}_weights", 25, lambda v: used(v) & (v["_i"] < count(v)), [Field("_w", lambda v: 5 + v["_wide"]), Let("weight", lambda v: v["_w"] - (1 << 4 + v["_wide"]))])]


def grain(layout: int) -> list:
    """Film-grain parameters of pictures without chroma (0), or with a quarter (1), half (2) or all (3) of its samples."""
    chroma = lambda v: (v["from_luma"] == 0) & (layout > 0)
    paired = [Check(lambda v: (v["u_count"] > 0) == (v["v_count"] > 0))] if layout == 1 else []
    mults = [Field(f"_{p}_{x}", n, when=lambda v, p=p: v[f"{p}_count"] > 0) for p in "uv" for x, n in (("mult", 8), ("luma_mult", 8), ("offset", 9))]
    lets = [Let(f"{p}_{x}", lambda v, p=p, x=x, n=n: v[f"_{p}_{x}"] - (1 << n - 1), lambda v, p=p: v[f"{p}_count"] > 0) for p in "uv" for x, n in (("mult", 8), ("luma_mult", 8), ("offset", 9))]
    return [
        *([Field("from_luma")] if layout else [Let("from_luma", lambda v: 0)]), *_grain_points("y", lambda v: v["from_luma"] >= 0), *_grain_points("u", chroma), *_grain_points("v", chroma), *paired,
        Field("_shift", 2), Let("scaling_shift", lambda v: v["_shift"] + 8), Field("lag", 2), *[x for p in "yuv" for x in _grain_weights(p)],
        Field("_weight_shift", 2), Let("weight_shift", lambda v: v["_weight_shift"] + 6), Field("grain_shift", 2), *mults, *lets, Field("overlap"), Field("clip"), Field("identity", when=_is("clip", 1)), Field("large_blocks"),
    ]


def _log2(size: np.ndarray, target: np.ndarray) -> np.ndarray:
    """How often a size is doubled until it reaches a target."""
    return sum((size << k < target).astype(np.int64) for k in range(20))


def _tile_limits(v: Values) -> tuple[np.ndarray, ...]:
    """(superblocks across and down, widest tile, largest tile, fewest doublings of columns and of all tiles) by level and tier; level 31 has no limits."""
    unit = 6 + v["sb128"]
    across, down = (v["width"] + (1 << unit) - 1) >> unit, (v["height"] + (1 << unit) - 1) >> unit
    high, higher, tiered = v["level"] >= 14, v["level"] >= 18, (v["level"] >= 14) & (v["tier"] > 0)
    widest = np.where(v["level"] == 31, across, 4096 >> (unit - higher - tiered))
    largest = np.where(v["level"] == 31, across * down, 4096 * 2304 >> (2 * unit - high - higher - tiered))
    least = _log2(widest, across)
    return across, down, widest, largest, least, np.maximum(_log2(largest, across * down), least)


def _explicit(name: str, side: str, limit: str, most: int, when: Callable[[Values], np.ndarray]) -> list:
    """Tiles one after the other: each is at most as long as the limit and as what is left, so each step reads what the last one left."""
    return [
        Let(f"_{name}_at", lambda v: 0), Let(f"_{name}_longest", lambda v: 1),
        Loop(name, most, lambda v: when(v) & (v[f"_{name}_at"] < v[side]), [
            Let("start", lambda v: v[f"_{name}_at"]), Field("_length", lambda v: np.minimum(v[side] - v[f"_{name}_at"], v[limit]), "below"),
            Let("length", lambda v: v["_length"] + 1), Let(f"_{name}_at", lambda v: v[f"_{name}_at"] + v["length"]), Let(f"_{name}_longest", lambda v: np.maximum(v[f"_{name}_longest"], v["length"])),
        ]), Check(lambda v: ~when(v) | (v[f"_{name}_at"] >= v[side])),
    ]


def tile_layout(most_columns: int = 64, most_rows: int = 64) -> list:
    """Tiles of a frame whose values width, height, sb128, level and tier are known: uniform ones by the doublings of their numbers, others one by one."""
    explicit = _is("uniform", 0)
    counted = lambda name, side, start, most: [
        Let(f"log2_{name}", start, _is("uniform", 1)), Let("_more", lambda v: 1),
        Loop(f"_{name}_bits", 7, lambda v: (v["uniform"] == 1) & (v["_more"] == 1) & (v[f"log2_{name}"] < _log2(np.ones_like(v[side]), np.minimum(v[side], most))), [Field("_more"), Let(f"log2_{name}", lambda v: v[f"log2_{name}"] + v["_more"])]),
        Let(f"log2_{name}", lambda v: v[f"log2_{name}"], _is("uniform", 1)),
    ]
    return [
        Field("uniform"), *[Let(f"_{n}", lambda v, i=i: _tile_limits(v)[i]) for i, n in enumerate(("across", "down", "widest", "largest", "least", "tiles"))],
        *counted("columns", "_across", lambda v: v["_least"], most_columns), *counted("rows", "_down", lambda v: np.maximum(v["_tiles"] - v["log2_columns"], 0), most_rows),
        *_explicit("columns", "_across", "_widest", most_columns, explicit),
        Let("_tallest", lambda v: np.maximum(np.where(v["_tiles"] > 0, v["_across"] * v["_down"] >> v["_tiles"] + 1, v["_across"] * v["_down"]) // v["_columns_longest"], 1)),
        *_explicit("rows", "_down", "_tallest", most_rows, explicit),
    ]


_FULL, _COLOUR = _is("reduced", 0), _not("layout", 1)


def _adaptive(name: str, when: Callable[[Values], np.ndarray] | None = None, yes: tuple[int, int] = (2, 1)) -> list:
    """A choice of two bits: a one alone is yes[0], then a one is yes[1], else 0."""
    asked = lambda v: np.ones(len(v["_i"]), bool) if when is None else when(v)
    more = lambda v: asked(v) & (v[f"_{name}0"] == 0)
    return [Field(f"_{name}0", when=asked), Field(f"_{name}1", when=more), Let(name, lambda v: np.where(v[f"_{name}0"] == 1, yes[0], np.where(v[f"_{name}1"] == 1, yes[1], 0)), asked)]


def _flags(*names: str, when: Callable[[Values], np.ndarray] | None = None) -> list:
    return [Field(x, when=when) for x in names]


#: The sequence header. layout: 0 quarter chroma, 1 none, 2 all, 3 half; choices of three: 0 off, 1 on, 2 by frame.
SEQUENCE = [
    Field("id", 0, "zeros"), Field("profile", 5), Check(lambda v: (v["profile"] <= 8) | (v["profile"] == 31)), Field("reduced"), Field("level", 5), Field("tier", when=lambda v: (v["level"] >= 4) & (v["reduced"] == 0)),
    Field("layout", 0, "zeros"), Check(lambda v: v["layout"] <= 3), Field("_depth", 0, "zeros"), Check(lambda v: v["_depth"] <= 2), Let("bit_depth", lambda v: np.where(v["_depth"] == 2, 12, np.where(v["_depth"] == 0, 10, 8))),
    Field("layer_configuration", 3, when=_FULL), Field("still", when=_FULL), Field("temporal_layers", 2, when=_FULL), Field("embedded_layers", 3, when=_FULL),
    Field("_layers", lambda v: np.frexp(v["embedded_layers"].astype(float))[1], when=_both(_FULL, _not("embedded_layers", 0))), Let("layer_count", lambda v: v["_layers"] + 1), Check(lambda v: v["layer_count"] <= v["embedded_layers"] + 1), Field("monotonic", when=_FULL),
    Field("_width_bits", 4), Field("_height_bits", 4), Field("_width", lambda v: v["_width_bits"] + 1), Field("_height", lambda v: v["_height_bits"] + 1), Let("width", lambda v: v["_width"] + 1), Let("height", lambda v: v["_height"] + 1),
    Field("cropped"), *[Field(f"crop_{x}", 0, "zeros", _is("cropped", 1)) for x in ("left", "right", "top", "bottom")],
    Field("_display", when=_FULL), Field("display_delay", 4, when=_is("_display", 1)), Field("has_decoder_model", when=_FULL), Field("decoding_tick", 32, when=_is("has_decoder_model", 1)), Field("_buffers", when=_is("has_decoder_model", 1)),
    *[Field(x, 0, "zeros", _is("_buffers", 1)) for x in ("decoder_delay", "encoder_delay")], Field("low_delay", when=_is("_buffers", 1)),
    Field("_embedded_map", when=_not("embedded_layers", 0)), Loop("embedded_dependencies", 7, lambda v: (v["_embedded_map"] == 1) & (v["_i"] < v["embedded_layers"]), [Field("map", lambda v: v["_i"] + 2)]),
    Field("_temporal_map", when=_not("temporal_layers", 0)), Field("_each", when=_both(_is("_temporal_map", 1), _not("embedded_layers", 0))),
    Loop("temporal_dependencies", 24, lambda v: (v["_temporal_map"] == 1) & (v["_i"] < v["temporal_layers"] * np.where(v["_each"] == 1, v["embedded_layers"] + 1, 1)), [Field("map", lambda v: v["_i"] % np.maximum(v["temporal_layers"], 1) + 2)]),
    *_adaptive("sb128"), Field("split_chroma", when=_COLOUR), Field("split_chroma_more", when=_both(_is("split_chroma", 1), _FULL)), Field("more_partitions"), Field("uneven_partitions", when=_is("more_partitions", 1)),
    Field("_narrow"), Field("_narrower", when=_is("_narrow", 1)), Let("aspect_log2", lambda v: np.where(v["_narrow"] == 1, 1 + v["_narrower"], 3)),
    Field("more_segments"), Field("has_segments"), Field("adaptive_segments", when=_is("has_segments", 1)), Let("_segments", lambda v: np.where(v["has_segments"] == 1, 8 << v["more_segments"], 0)), SEGMENTS,
    *_flags("intra_matrix", "intra_edge_filter", "intra_lines", "cfl"), Field("_cfl_filter", 2, when=_COLOUR), Let("cfl_filter", lambda v: v["_cfl_filter"] % 3, _COLOUR), *_flags("mhccp", "bidirectional"),
    Field("_modes", 4, when=_FULL), Let("motion_modes", lambda v: 1 + sum((v["_modes"] >> 3 - k & 1) << k + 1 for k in range(4))), Field("frame_motion_modes", when=_both(_FULL, _not("_modes", 0))), Field("six_parameters", when=lambda v: (v["reduced"] == 0) & (v["motion_modes"] & 8 > 0)),
    *_flags("masked_compound", "reference_fields", when=_FULL), Field("fewer_fields", when=_is("reference_fields", 1)), Field("_hint_bits", 4, when=_FULL), Let("hint_bits", lambda v: v["_hint_bits"] + 1, _FULL),
    Field("vector_bank"), Field("_keep_order"), Field("_strict", when=_is("_keep_order", 0)), Let("reorder", lambda v: np.where(v["_keep_order"] == 1, 0, 2 - v["_strict"])),
    Field("explicit_references", when=_FULL), Field("_few", when=_FULL), Field("_references", 4, when=_is("_few", 1)), Let("references", lambda v: np.where(v["reduced"] == 1, 2, np.where(v["_few"] == 1, v["_references"] + 1, 8))), Check(lambda v: v["references"] <= 8),
    Field("long_term_bits", 3, when=_FULL), Field("_list_bits", 5, "below", _FULL), Let("list_bits", lambda v: v["_list_bits"] + 1), Field("frame_list_bits", when=_FULL), Field("_copy_bits", 3, "below"), Let("copy_list_bits", lambda v: v["_copy_bits"] + 1), Field("frame_copy_list_bits"), Field("same_references", 2, when=_FULL),
    Field("_tip", when=_FULL), Field("_tip_fixed", when=_is("_tip", 1)), Let("tip", lambda v: np.where(v["_tip"] == 1, 1 + v["_tip_fixed"], 0)), Field("tip_holes", when=_is("_tip", 1)), Field("trajectories", when=_FULL), Field("bawp"),
    *_flags("weighted_compound", "implicit_mask", "sub_block_deblocking", when=_FULL), Field("tip_quantiser", when=_both(_is("tip", 1), _is("sub_block_deblocking", 1))), Field("flow", 2, when=_FULL), Field("refine", when=_FULL), Field("tip_refine", when=lambda v: (v["tip"] > 0) & (v["flow"] + v["refine"] > 0)),
    *_flags("backward_reference", "adaptive_difference", "derived_sign", "flexible_precision", "global_motion", "short_refresh", when=_FULL),
    *_adaptive("screen_content", _FULL), *_adaptive("whole_vectors", _both(_FULL, _not("screen_content", 0))), *[Let(x, lambda v: 2, _both(_is("reduced", *w), _is("screen_content", *s))) for x, w, s in (("whole_vectors", (0,), (0,)), ("screen_content", (1,), (0,)), ("whole_vectors", (1,), (2,)))],
    Field("forward_skip"), Field("_identity", when=_is("forward_skip", 0)), Let("identity_intra", lambda v: np.maximum(v["forward_skip"], v["_identity"])), *_flags("secondary_intra", "secondary_inter"), Field("chroma_mean_only", when=_COLOUR), Field("inter_kernels", when=_FULL), Field("fewer_transforms"), Field("chroma_rotation", when=_COLOUR),
    Field("_trellis"), Field("_trellis_frame", when=_both(_FULL, _is("_trellis", 1))), Let("trellis", lambda v: v["_trellis"] + v["_trellis_frame"]), Field("parity_hiding", when=_not("trellis", 1)),
    Field("_average", when=_FULL), Let("average", lambda v: np.maximum(v["reduced"], v["_average"])), Field("_average_all", when=_both(_FULL, _is("average", 1))), Let("average_all", lambda v: np.maximum(v["reduced"], v["_average_all"]), _is("average", 1)),
    Field("separate_chroma", when=_COLOUR), Field("equal_steps"), Field("_y_dc", 5, when=_is("equal_steps", 0)), Let("y_dc", lambda v: v["_y_dc"] - 23, _is("equal_steps", 0)), Field("y_dc_frame", when=_is("equal_steps", 0)),
    Field("_uv_dc", 5, when=_both(_COLOUR, _is("equal_steps", 0))), Let("uv_dc", lambda v: v["_uv_dc"] - 23, _both(_COLOUR, _is("equal_steps", 0))), Field("uv_dc_frame", when=_both(_COLOUR, _is("equal_steps", 0))),
    Field("_uv_ac", 5, when=_COLOUR), Let("uv_ac", lambda v: v["_uv_ac"] - 23, _COLOUR), Field("uv_ac_frame", when=_COLOUR), Let("uv_dc", lambda v: v["uv_ac"], _both(_COLOUR, _is("equal_steps", 1))),
    *_flags("filters_stop_at_tiles", "cdef", "gdf"), Field("gdf_unit", when=_both(_is("gdf", 1), _is("sb128", 0))), Field("restoration"), *[Field(x, when=_is("restoration", 1)) for x in ("no_classified", "no_luma_filter", "_own_chroma")], Field("_no_chroma", when=_is("_own_chroma", 1)),
    Let("no_chroma_filter", lambda v: np.where(v["_own_chroma"] == 1, v["_no_chroma"], v["no_luma_filter"]), _is("restoration", 1)), Field("ccso"), Field("ccso_unit", when=_is("ccso", 1)),
    *_adaptive("_always", _FULL), Let("cdef_on_skipped", lambda v: np.where((v["reduced"] == 1) | (v["_always"] == 0), 2, v["_always"] - 1)), Field("_deblock_bits", 2), Let("deblock_bits", lambda v: v["_deblock_bits"] + 2),
    Field("has_tiles"), Field("adaptive_tiles", when=_is("has_tiles", 1)), When(_is("has_tiles", 1), tile_layout()), Field("has_grain"),
]


def diagonal(height: int, width: int) -> list[tuple[int, int]]:
    """The places of a block by diagonals, each from its lowest line up."""
    return [(y, d - y) for d in range(height + width - 1) for y in range(min(d, height - 1), -1, -1) if d - y < width]


#: Sides (height, width) of the matrices of a set.
MATRICES = ((8, 8), (4, 8), (8, 4))


def _matrix(shape: int, plane: int) -> list:
    """One matrix: a copy of the plane before, for the last shape the second one turned, or differences along diagonals; the first shape may be symmetric; a value of 0 repeats the last one to the end."""
    (height, width), own = MATRICES[shape], f"_m{shape}{plane}"
    copied, mirrored, turned = (f"{own}_{x}" for x in ("copied", "mirrored", "turned"))
    fresh = lambda v: (v[copied] == 0) & (v[turned] == 0)
    steps: list = [Let(copied, lambda v: 0), Let(mirrored, lambda v: 0), Let(turned, lambda v: 0), Let("_last", lambda v: 32), Let("_ended", lambda v: 0)]
    if plane:
        steps.append(Field(copied))
    if shape != 1:
        steps.append(Field(mirrored if shape == 0 else turned, when=_is(copied, 0)))
    for y, x in diagonal(height, width):
        name, other = f"{own}_{y}_{x}", f"{own}_{x}_{y}"
        above = lambda v: (v[mirrored] == 1) & fresh(v)
        read = fresh
        if shape == 0 and x > y:
            steps.append(Let("_last", lambda v, other=other: v[other], above))
            read = lambda v: fresh(v) & (v[mirrored] == 0)
        coded = lambda v, read=read: read(v) & (v["_ended"] == 0)
        steps += [
            Field("_code", 0, "zeros", coded), Check(lambda v, coded=coded: ~coded(v) | (v["_code"] <= 256) & (v["_code"] != 255)),
            Let("_new", lambda v: (v["_last"] + np.where(v["_code"] % 2 == 1, v["_code"] + 1 >> 1, -(v["_code"] + 1 >> 1))) % 256, coded), Let("_zero", lambda v, coded=coded: coded(v) & (v["_new"] == 0)),
            Let("_last", lambda v: v["_new"], lambda v, coded=coded: coded(v) & (v["_zero"] == 0)), Let("_ended", lambda v: 1, _is("_zero", 1)), Let(name, lambda v: v["_last"]),
        ]
        if plane:
            steps.append(Let(name, lambda v, y=y, x=x: v[f"_m{shape}{plane - 1}_{y}_{x}"], _is(copied, 1)))
        if shape == 2:
            steps.append(Let(name, lambda v, y=y, x=x: v[f"_m1{plane}_{x}_{y}"], _both(_is(copied, 0), _is(turned, 1))))
    return [*steps, Gather(f"m{shape}{plane}", [f"{own}_{y}_{x}" for y in range(height) for x in range(width)])]


def matrix_set(planes: int) -> list:
    """A set of quantiser matrices, of three shapes for each plane, in lines; null where a bit says that the predefined ones are meant."""
    return [Field("predefined"), When(_is("predefined", 0), [x for shape in range(3) for plane in range(planes) for x in _matrix(shape, plane)])]
