"""Inverse transforms and residuals of blocks held as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.integer import clip, round2, shr, signed_round2
from ..sources.planes import hold

#: The cosine coefficients of the 4- and 8-point transforms, and the 4-point sine kernel and its flipped form.
DCT4_EVEN, DCT4_ODD = 64, (83, 35)
DCT8_ODD = [[89, 75, 50, 18], [75, -18, -89, -50], [50, -89, 18, 75], [18, -50, 75, -89]]
ADST4 = [[18, 50, 75, 89], [50, 89, 18, -75], [75, 18, -89, 50], [89, -75, 50, -18]]
FLIPADST4 = [[89, 75, 50, 18], [75, -18, -89, -50], [50, -89, 18, 75], [18, -50, 75, -89]]
#: Factors of the identity transforms; mantissas of the 24 dequantisation steps of an octave.
IDENTITY = {4: 128, 8: 181, 16: 256, 32: 362}
STEPS = [40, 41, 43, 44, 45, 47, 48, 49, 51, 52, 54, 55, 57, 59, 60, 62, 64, 66, 68, 70, 72, 74, 76, 78]


def dct_matrix(n: int) -> list[list[int]]:
    """Row k: the weights of the n inputs in output k. Odd inputs mirror with the sign turned, even ones come from the half-size transform."""
    if n == 4:
        a, (b, c) = DCT4_EVEN, DCT4_ODD
        return [[a, b, a, c], [a, c, -a, -b], [a, -c, -a, b], [a, -b, a, -c]]
    half = dct_matrix(n // 2)
    out = []
    for k in range(n):
        m, sign = (k, 1) if k < n // 2 else (n - 1 - k, -1)
        out.append([half[m][j // 2] if j % 2 == 0 else sign * DCT8_ODD[m][j // 2] for j in range(n)])
    return out


def _matrix(m: list[list[int]]) -> Column:
    return F.array(*[F.array(*[F.lit(v).cast("bigint") for v in row]) for row in m])


def _times(matrix: Column, line) -> Column:
    """Sum over j of matrix[k][j] * line(j), for the k that the caller put into `matrix`."""
    return F.aggregate(F.transform(matrix, lambda w, j: w * line(j)), F.lit(0).cast("bigint"), lambda s, v: s + v)


def separable(df: DataFrame, coefs: str, rows: list[list[int]], columns: list[list[int]], n: int, middle: int, last: int, low: int = -(1 << 15), high: int = (1 << 15) - 1) -> DataFrame:
    """residual: `rows` over each line of n x n coefficients, rounded by 2**middle and clipped, then `columns` over each column, rounded by 2**last."""
    i_, shift = F.sequence(F.lit(0), F.lit(n * n - 1)), n.bit_length() - 1
    df = hold(df, _rows=_matrix(rows), _columns=_matrix(columns))
    df = hold(df, _half=F.transform(i_, lambda i: clip(round2(_times(F.col("_rows")[i.bitwiseAND(F.lit(n - 1))], lambda j: F.col(coefs)[F.shiftright(i, shift) * n + j]), middle), low, high)))
    return hold(df, residual=F.transform(i_, lambda i: round2(_times(F.col("_columns")[F.shiftright(i, shift)], lambda j: F.col("_half")[j * n + i.bitwiseAND(F.lit(n - 1))]), last).cast("bigint")))


def coefficients(df: DataFrame, source: str = "px", name: str = "coef") -> DataFrame:
    """The samples of a block less 128, taken for its coefficients."""
    return hold(df, **{name: F.transform(source, lambda v: v - 128)})


def corner(coefs: str, n: int = 4, width: int = 8) -> Column:
    """The n x n coefficients at the top left."""
    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: F.col(coefs)[F.floor(i / n).cast("int") * width + i % n])


def walsh_hadamard(df: DataFrame, coefs: str = "c4") -> DataFrame:
    """wht: the lossless 4x4 transform; inputs lose three bits, then each line and each column is lifted."""

    def lift(a, b, c, d):
        """Sums of the inputs, corrected by one half of their alternating sum, which makes the steps reversible in integers."""
        half = shr(a + b - c + d, 1)
        return [a + b + d - half, half - d, half - b, c - d - b + half]

    df = hold(df, **{f"_i{k}": shr(F.col(coefs)[k], 3) for k in range(16)})
    lines = [lift(*[F.col(f"_i{4 * y + x}") for x in range(4)]) for y in range(4)]
    df = hold(df, **{f"_t{4 * y + x}": lines[y][x] for y in range(4) for x in range(4)})
    columns = [lift(*[F.col(f"_t{4 * y + x}") for y in range(4)]) for x in range(4)]
    return df.withColumn("wht", F.array(*[columns[x][y].cast("bigint") for y in range(4) for x in range(4)]))


def secondary(df: DataFrame, kernel: list[list[int]], coefs: str = "coef", bits: int = 8) -> DataFrame:
    """secondary: each output from a column of the kernel over the first inputs, rounded by 2**7 on its magnitude and clipped."""
    m = _matrix([list(c) for c in zip(*kernel)])
    limit = 128 << bits
    return df.withColumn("secondary", F.transform(m, lambda w: clip(signed_round2(_times(w, lambda j: F.col(coefs)[j]), 7), -limit, limit - 1)))


def rotate_chroma(df: DataFrame, sine: Column, cosine: Column, u: str = "coef", v: str = "coef2", bits: int = 8) -> DataFrame:
    """u, v: both planes' coefficients turned by an angle given in units of 1/256."""
    low, high = -(1 << (bits + 7)), (1 << (bits + 7)) - 1
    half = lambda x: clip(shr(x + 128 - F.when(x < 0, 1).otherwise(0), 8), low, high)
    df = hold(df, _s=sine, _c=cosine)
    return df.withColumns({"u": F.zip_with(u, v, lambda a, b: half(a * F.col("_c") - b * F.col("_s"))), "v": F.zip_with(u, v, lambda a, b: half(a * F.col("_s") + b * F.col("_c")))})


def add_residual(df: DataFrame, residual: str, shift: int = 4) -> DataFrame:
    """sum: the samples plus the rounded residual, clipped to 8 bits."""
    return df.withColumn("sum", F.zip_with("px", residual, lambda p, r: clip(p + round2(r, shift), 0, 255)))


def clip_qindex(index: Column, delta: Column, most: int = 255) -> Column:
    """0 stays 0 without a positive delta; else the sum from 1 to most."""
    return F.when((index == 0) & (delta <= 0), 0).otherwise(clip(index + delta, 1, most)).cast("bigint")


def dequant_step(index: Column) -> Column:
    """64 for 0, else a mantissa of 24 to an octave."""
    q = F.greatest(F.lit(0), F.least(F.lit(351), index)).cast("bigint")
    table = F.array(*[F.lit(s).cast("bigint") for s in STEPS])
    octave = F.floor((q - 1) / 24).cast("int")
    return F.when(q == 0, 64).otherwise(table[(F.pmod(q - 1, F.lit(24))).cast("int")] * F.pow(F.lit(2), octave).cast("bigint")).cast("bigint")
