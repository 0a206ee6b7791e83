"""A range coder with adaptive models, a tile at a time: tiles are rows, so Spark deals them to tasks.

The interval of a symbol is a share of the range by its cumulative distribution; the model learns
from each symbol as in `entropy.update`. Coding is serial inside a tile and nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FULL = 15


class Model:
    """A distribution of `size` symbols that starts uniform; edges fall from 32768 to 0."""

    def __init__(self, size: int):
        self.size, self.count = size, 0
        self.cdf = [32768 * (size - 1 - i) // size for i in range(size - 1)]

    def bounds(self, symbol: int, span: int) -> tuple[int, int]:
        """(upper, lower) edge of the symbol in a span, each symbol at least one unit wide."""
        edge = lambda i: span if i < 0 else 0 if i == self.size - 1 else ((span - self.size) * self.cdf[i] >> 15) + self.size - 1 - i
        return edge(symbol - 1), edge(symbol)

    def learn(self, symbol: int) -> None:
        rate = 4 + (self.count >> 4) + (self.size > 3)
        self.cdf = [p + ((32768 - p) >> rate) if i < symbol else p - (p >> rate) for i, p in enumerate(self.cdf)]
        self.count = min(32, self.count + 1)


def encode(symbols: list[int], size: int) -> bytes:
    model, low, span, shifted = Model(size), 0, 1 << FULL, 0
    for s in symbols:
        upper, lower = model.bounds(s, span)
        low, span = low + span - upper, upper - lower
        d = FULL + 1 - span.bit_length()
        low, span, shifted = low << d, span << d, shifted + d
        model.learn(s)
    n = shifted + FULL
    return ((low + span - 1) << (-n % 8)).to_bytes(-(-n // 8) + 1, "big")


def decode(data: bytes, n: int, size: int) -> list[int]:
    model, span, bits = Model(size), 1 << FULL, 8 * len(data)
    code, at, out = int.from_bytes(data, "big"), FULL + 8, []
    value = code >> (bits - at)
    for _ in range(n):
        s = next(k for k in range(size) if value < span - model.bounds(k, span)[1])
        upper, lower = model.bounds(s, span)
        value, span = value - (span - upper), upper - lower
        d = FULL + 1 - span.bit_length()
        at += d
        value, span = value << d | (code >> max(bits - at, 0) << max(at - bits, 0)) & ((1 << d) - 1), span << d
        model.learn(s)
        out.append(s)
    return out


def encode_tiles(tiles: DataFrame, size: int) -> DataFrame:
    """(tile, n, data) of tiles (tile, symbols)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in symbols], pa.int64()), pa.array([encode(s, size) for s in symbols], pa.binary())], names=["tile", "n", "data"])

    return tiles.select("tile", "symbols").mapInArrow(run, "tile long, n long, data binary")


def decode_tiles(coded: DataFrame, size: int) -> DataFrame:
    """(tile, symbols) of coded tiles (tile, n, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode(d, n, size) for n, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["tile", "symbols"])

    return coded.select("tile", "n", "data").mapInArrow(run, "tile long, symbols array<long>")
