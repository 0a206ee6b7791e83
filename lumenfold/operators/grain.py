"""Film grain: noise from a shift register, scaled by the sample it is added to; and tables of grain that depends on its neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.integer import clip, lfsr_after, shr


def noise(seed: Column, steps: int = 16, bits: int = 8) -> Column:
    """A signed number of `bits` bits: the top of the register after some steps from the seed."""
    return shr(lfsr_after(seed, steps), 16 - bits) - (1 << (bits - 1))


def scaling_segments(points: DataFrame, key: str) -> DataFrame:
    """(key, from, to, y, delta): the pieces of each key's curve through its points (x, y); flat before the first and after the last.

    A key's points are bounded by the 256 values that x can take.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("x")
    dx = F.lead("x").over(w) - F.col("x")
    delta = (F.lead("y").over(w) - F.col("y")) * F.floor((65536 + F.floor(dx / 2)) / dx)
    inner = points.select(key, F.col("x").alias("from"), F.coalesce(F.lead("x").over(w), F.lit(256)).cast("bigint").alias("to"), "y", F.coalesce(delta, F.lit(0)).cast("bigint").alias("delta"))
    first = points.groupBy(key).agg(F.min("x").alias("to"), F.min_by("y", "x").alias("y")).where(F.col("to") > 0)
    return inner.unionByName(first.select(key, F.lit(0).cast("bigint").alias("from"), "to", "y", F.lit(0).cast("bigint").alias("delta")))


def scaling_of(samples: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """samples (key, v, ...) with `scaling`: a range join of each sample with the piece that holds it, within its key."""
    s = segments.withColumnRenamed(key, "_key")
    joined = samples.join(s, (F.col(key) == F.col("_key")) & (F.col("v") >= F.col("from")) & (F.col("v") < F.col("to")))
    return joined.withColumn("scaling", F.col("y") + shr(32768 + (F.col("v") - F.col("from")) * F.col("delta"), 16)).drop("_key", "from", "to", "y", "delta")


def apply_luma(v: Column, scaling: Column, grain: Column, shift: int = 8, low: int = 0, high: int = 255) -> Column:
    """The sample plus its scaled grain, rounded, in a range."""
    return clip(v + shr(scaling * grain + ((1 << shift) >> 1), shift), low, high)


#: Lines and columns of a table of grain; those at its edges that depend on no neighbours; what the seeds of both chroma tables differ by.
HEIGHT, GRAIN_WIDTH, MARGIN = 73, 82, 3
CHROMA_SEEDS = (0xB524, 0x49D8)


def normal_noise(size: int = 2048, spread: int = 512) -> np.ndarray:
    """Numbers with a normal distribution: its quantiles in an order that jumps about."""
    normal = NormalDist()
    quantiles = np.array([round(spread * normal.inv_cdf((i + 0.5) / size)) for i in range(size)])
    return quantiles[np.arange(size) * 1103 % size]


def _draws(seeds: np.ndarray, n: int, bits: int = 11) -> np.ndarray:
    """(n, seeds): the top bits of each register after every step."""
    state, out = seeds.astype(np.int64), np.empty((n, len(seeds)), np.int64)
    for i in range(n):
        bit = (state ^ state >> 1 ^ state >> 3 ^ state >> 12) & 1
        state = state >> 1 | bit << 15
        out[i] = state >> 16 - bits
    return out


@cache
def _register(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(states, place): the register's states in the order in which they follow each other, and each one's place there, with n more behind it.

    All states but zero form one round; zero follows itself.
    """
    states, state = [], 1
    while not states or state != 1:
        states.append(state)
        state = state >> 1 | ((state ^ state >> 1 ^ state >> 3 ^ state >> 12) & 1) << 15
    place = np.full(1 << 16, len(states) + n)
    place[states] = np.arange(len(states))
    return np.array(states + states[:n] + [0] * (n + 1)), place


def _drawn(seeds: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(HEIGHT, GRAIN_WIDTH, seeds): each seed's entries in the order of a table, read off the register's round; step by step if a seed has more than 16 bits or a sign."""
    n = HEIGHT * GRAIN_WIDTH
    if ((seeds < 0) | (seeds >= 1 << 16)).any():
        return entries[_draws(seeds, n)].reshape(HEIGHT, GRAIN_WIDTH, -1)
    states, place = _register(n)
    rows = np.lib.stride_tricks.sliding_window_view(entries[states >> 5], n)[place[seeds] + 1]
    return np.ascontiguousarray(rows.T).reshape(HEIGHT, GRAIN_WIDTH, -1)


def grain_tables(seeds: np.ndarray, weights: np.ndarray, lag: int, shift: int, scale: int, noise: np.ndarray, luma: np.ndarray | None = None) -> np.ndarray:
    """(HEIGHT, GRAIN_WIDTH, seeds) tables of grain, all of one lag together; weights are (places, seeds).

    Each entry is noise / 2**(4 + scale), plus, inside the margins, the weighted sum of the entries up
    to `lag` lines above and columns beside it that are done, and with luma of that table's entry,
    divided by 2**shift; roundings are halves up, and entries are cut to eight bits. What lines above
    and luma add is summed up for a whole line; only entries to the left go one by one. The numbers
    have as few bytes as hold every sum.
    """
    entries = noise.astype(np.int64) + (1 << 4 + scale >> 1) >> 4 + scale
    above = [(dy, dx) for dy in range(-lag, 0) for dx in range(-lag, lag + 1)]
    places = len(above) + lag
    weights = weights[: places + (luma is not None)]
    most = max(128, int(np.abs(entries).max())) * (int(np.abs(weights).max(initial=0)) * len(weights) + GRAIN_WIDTH) + (1 << shift)
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    out, weights = _drawn(seeds, entries.astype(kind)), np.ascontiguousarray(weights, kind)
    if not len(weights):
        return out
    first, last = MARGIN, GRAIN_WIDTH - MARGIN
    total = np.empty((GRAIN_WIDTH, len(seeds)), kind)
    whole, few = np.empty((last - first, len(seeds)), kind), np.empty((lag, len(seeds)), kind)
    shifts, low, high = (np.full(len(seeds), v, kind) for v in (shift, -128, 127))
    beside = np.ascontiguousarray(weights[len(above) : places][::-1])
    for y in range(MARGIN, HEIGHT):
        line, inside = out[y], total[first:last]
        total[:] = 1 << shift >> 1
        for weight, (dy, dx) in zip(weights, above):
            inside += np.multiply(out[y + dy, first + dx : last + dx], weight, out=whole)
        if luma is not None:
            inside += np.multiply(luma[y, first:last], weights[places], out=whole)
        for x in range(first - lag, last):
            if x >= first:
                sums = total[x]
                np.right_shift(sums, shifts, out=sums)
                np.add(sums, line[x], out=sums)
                np.maximum(sums, low, out=sums)
                np.minimum(sums, high, out=line[x])
            if lag:
                right = total[x + 1 : x + 1 + lag]
                np.add(right, np.multiply(beside, line[x], out=few), out=right)
    return out


def _planes(batches: Iterator[pa.RecordBatch], lag: int, shift: int, scale: int, noise: np.ndarray) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Of at most ROWS rows of parameters at a time: those rows, and the number and the tables of each plane."""
    places = 2 * lag * (lag + 1)
    for batch in batches:
        step = -(-batch.num_rows // max(1, -(-batch.num_rows // ROWS)))
        for at in range(0, batch.num_rows, max(1, step)):
            part = batch.slice(at, step)
            seeds = part.column(1).to_numpy(zero_copy_only=False)
            weights = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(seeds), -1).T
            luma = grain_tables(seeds, weights, lag, shift, scale, noise)
            yield part, 0, luma
            chroma = grain_tables(np.concatenate([seeds ^ turn for turn in CHROMA_SEEDS]), np.tile(weights[: places + 1], len(CHROMA_SEEDS)), lag, shift, scale, noise, np.tile(luma, len(CHROMA_SEEDS)))
            for plane in range(len(CHROMA_SEEDS)):
                yield part, plane + 1, chroma[:, :, plane * len(seeds) : (plane + 1) * len(seeds)]


def tables_of(parameters: DataFrame, lag: int, shift: int = 7, scale: int = 0, noise: np.ndarray | None = None) -> DataFrame:
    """(key, plane, grain): the luma table and both chroma tables of full size of each row of parameters (key, seed, weights), as flat arrays.

    weights: for each place before an entry, line by line, and last for the luma's entry. Rows of an
    Arrow batch are filled together, entry by entry, at most ROWS sets of tables at a time.
    """
    noise = normal_noise() if noise is None else noise

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, plane, found in _planes(batches, lag, shift, scale, noise):
            flat = found.reshape(HEIGHT * GRAIN_WIDTH, -1)
            for at in range(0, part.num_rows, OUT):
                some = flat[:, at : at + OUT].T.astype(np.int64)
                offsets = pa.array(np.arange(len(some) + 1) * HEIGHT * GRAIN_WIDTH, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, OUT), pa.array([plane] * len(some), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(some.reshape(-1)))], names=["key", "plane", "grain"])

    return parameters.select("key", "seed", "weights").mapInArrow(run, "key long, plane long, grain array<long>")


def lines_of(parameters: DataFrame, lag: int, shift: int = 7, scale: int = 0, noise: np.ndarray | None = None) -> DataFrame:
    """(key, plane, y, total, least, most): the lines of those tables summed up, without a row for each entry.

    parameters (key, seed, weights, times): a row stands for `times` equal ones, whose lines are one.
    """
    noise = normal_noise() if noise is None else noise

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, plane, found in _planes(batches, lag, shift, scale, noise):
            keys, times = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            lines = [np.add.reduce(found, 1, np.int64 if found.itemsize > 4 else found.dtype) * times, found.min(1), found.max(1)]
            columns = [np.tile(keys, HEIGHT), np.full(HEIGHT * len(keys), plane), np.repeat(np.arange(HEIGHT), len(keys)), *[v.reshape(-1).astype(np.int64) for v in lines]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "plane", "y", "total", "least", "most"])

    return parameters.select("key", "seed", "weights", "times").mapInArrow(run, "key long, plane long, y long, total long, least long, most long")


#: Sets of tables that a task fills together (40 MB where two bytes hold the sums), and how many of them it hands out as arrays at a time.
ROWS, OUT = 1024, 200
