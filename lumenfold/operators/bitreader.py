"""Fields of different lengths read one after the other from payloads, as Columns over strings of bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bitcodes import value
from ..sources.planes import hold


def bits_of(payload: Column) -> Column:
    """A binary column as a string of 0 and 1, the most significant bit of each byte first."""
    digits = F.hex(payload)
    four = lambda i: F.lpad(F.bin(F.conv(F.substring(digits, i, F.lit(1)), 16, 10).cast("bigint")), 4, "0")
    return F.when(F.length(digits) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(digits)), four), "")).otherwise(F.lit(""))


def read_fields(df: DataFrame, payload: Column, fields: list[tuple]) -> DataFrame:
    """df with a column for each named field, `position` (bits read) and `error`.

    fields: (name, kind[, n]) with the kinds unsigned and signed (n bits, two's complement), zeros (a
    run of zeros, a one, as many bits again), rice (a run of ones, a zero, n bits), below (less than
    n, in the fewest bits, the shorter form first), skip (n bits) and align (to the next byte). A
    field that would end beyond the payload is null, as are all after it, and `error` is set; the
    position then stays where that field began. A null payload is empty.
    """
    df = hold(df, _bits=bits_of(F.coalesce(payload, F.lit(b""))))
    df = hold(df, position=F.lit(0), error=F.lit(False))
    for name, kind, *rest in fields:
        n = rest[0] if rest else 0
        part = lambda start, size: F.substring(F.col("_bits"), (F.col("position") + 1 + start).cast("int"), size if isinstance(size, Column) else F.lit(size))
        left = F.substring(F.col("_bits"), F.col("position") + 1, F.length("_bits"))
        if kind in ("unsigned", "signed"):
            size, found = F.lit(n), value(part(0, n))
            if kind == "signed":
                found = found - F.when(found >= 1 << n - 1, 1 << n).otherwise(0)
        elif kind == "zeros":
            run = F.instr(left, "1") - 1
            size, found = F.when(run < 0, F.length("_bits") + 1).otherwise(2 * run + 1), value(part(F.greatest(run, F.lit(0)), run + 1)) - 1
        elif kind == "rice":
            run = F.instr(left, "0") - 1
            size, found = F.when(run < 0, F.length("_bits") + 1).otherwise(run + 1 + n), run * (1 << n) + value(part(F.greatest(run, F.lit(0)) + 1, n))
        elif kind == "below":
            long = n.bit_length()
            short = (1 << long) - n
            head = value(part(0, long - 1))
            size, found = F.when(head < short, long - 1).otherwise(long), F.when(head < short, head).otherwise(2 * head - short + value(part(long - 1, 1)))
        elif kind == "align":
            size, found = F.pmod(-F.col("position"), F.lit(8)), F.lit(None).cast("bigint")
        elif kind == "skip":
            size, found = F.lit(n), F.lit(None).cast("bigint")
        else:
            raise ValueError(f"unknown kind of field {kind!r}")
        df = hold(df, _size=size.cast("int"), _found=found.cast("bigint"))
        df = hold(df, _bad=F.col("error") | (F.col("position") + F.col("_size") > F.length("_bits")))
        moved = F.when(F.col("_bad"), F.col("position")).otherwise(F.col("position") + F.col("_size"))
        kept = [c for c in df.columns if c not in ("position", "error", "_size", "_found", "_bad")]
        df = df.select(*kept, moved.cast("int").alias("position"), F.col("_bad").alias("error"), *([F.when(~F.col("_bad"), F.col("_found")).alias(name)] if name else []))
        df = hold(df.withColumnsRenamed({"position": "_p", "error": "_e"}), position=F.col("_p"), error=F.col("_e")).drop("_p", "_e")
    return df.drop("_bits")
