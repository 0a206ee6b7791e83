"""The reader of conditional headers against one that reads bit by bit, over whole, cut and random payloads."""

import random

import numpy as np
import pytest

from lumenfold.operators import headers
from lumenfold.operators.headers import Check, Field, Gather, Let, Loop, When


class Bits:
    def __init__(self, data):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def take(self, n):
        if self.at + n > len(self.bits):
            raise EOFError
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def field(self, kind, n):
        start = self.at
        try:
            if kind == "bits":
                return self.take(n)
            if kind == "signed":
                v = self.take(n)
                return v - (1 << n) if n and v >> n - 1 else v
            if kind == "zeros":
                z = 0
                while not self.take(1):
                    z += 1
                    if z == 32:
                        return (1 << 32) - 1
                return (1 << z) - 1 + self.take(z)
            if kind == "rice":
                ones = 0
                while ones < 32 - n and self.take(1):
                    ones += 1
                return (1 << 32) - 1 if ones + n == 32 else (ones << n) + self.take(n)
            if n <= 1:
                return 0
            long = n.bit_length()
            v, short = self.take(long - 1), (1 << long) - n
            return v if v < short else 2 * v - short + self.take(1)
        except EOFError:
            self.at = start
            raise


def one_by_one(data, steps):
    """(fields, position, error) of one payload."""
    r, values, failed = Bits(data), {"_i": 0}, [False]

    def get(f):
        return int(np.asarray(f({k: np.array([v]) for k, v in values.items()})).reshape(-1)[0])

    def run(steps, out):
        for s in steps:
            if failed[0]:
                return
            if isinstance(s, Loop):
                own, values["_i"], rounds = values["_i"], 0, []
                while values["_i"] < s.most and not failed[0] and get(s.going):
                    rounds.append({})
                    run(s.steps, rounds[-1])
                    values["_i"] += 1
                out[s.name], values["_i"] = rounds, own
            elif isinstance(s, When):
                if get(s.condition):
                    run(s.steps, out)
            elif isinstance(s, Gather):
                out[s.name] = [values[x] for x in s.values]
            elif isinstance(s, Check):
                failed[0] = not get(s.good)
            elif s.when is not None and not get(s.when):
                values.setdefault(s.name, 0)
            elif isinstance(s, Let):
                out[s.name] = values[s.name] = get(s.value)
            else:
                try:
                    out[s.name] = values[s.name] = r.field(s.kind, get(s.n) if callable(s.n) else s.n)
                except EOFError:
                    failed[0] = True
                    values.setdefault(s.name, 0)

    def named(out, steps):
        return {n: [named(x, s.steps) for x in out.get(n, [])] if isinstance(s, Loop) else out.get(n) for n, s in headers._names(steps).items()}

    out = {}
    for name in every(steps):
        values.setdefault(name, 0)
    run(steps, out)
    return named(out, steps), r.at, failed[0]


def every(steps):
    for s in steps:
        if isinstance(s, (Loop, When)):
            yield from every(s.steps)
        elif not isinstance(s, (Check, Gather)):
            yield s.name


MIXED = [
    Field("a", 3), Field("b", 0, "zeros"), Field("c", 4, "signed", lambda v: v["a"] > 2), Let("d", lambda v: v["a"] * 2), Field("e", 1, "rice"), Field("f", lambda v: v["d"] + 2, "below"),
    Loop("g", 5, lambda v: v["_i"] < v["a"], [Field("x", lambda v: v["_i"] + 1), Field("y", 2, when=lambda v: v["x"] > 0), Let("_sum", lambda v: v["x"] + 1), Check(lambda v: v["_sum"] < 30)]), When(lambda v: v["a"] % 2 == 1, [Field("h", 32), Loop("k", 3, lambda v: v["h"] % 3 > v["_i"], [Field("z", 5)])]), Field("last"),
]


@pytest.mark.parametrize("layout", [MIXED, headers.CONTENT, headers.grain(0), headers.grain(1), headers.grain(3), headers.SEQUENCE, headers.matrix_set(2)])
def test_reader_against_bit_by_bit(spark, layout):
    rng = random.Random(4)
    data = [None, b"", b"\xff", b"\0" * 9, b"\xff" * 40] + [bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, 5, 20, 90]))) for _ in range(150)] + [bytes(rng.choice((0, 3, 128, 224)) for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(data)), "a_key int, payload binary")
    got = {r["a_key"]: r.asDict(recursive=True) for r in headers.read_header(df, "payload", layout).collect()}
    for i, x in enumerate(data):
        fields, at, error = one_by_one(x or b"", layout)
        assert got[i] == {"a_key": i, **fields, "position": at, "error": error}


def test_header_of_no_rows(spark):
    assert headers.read_header(spark.createDataFrame([], "payload binary"), "payload", MIXED).count() == 0


def test_symmetric_matrices_that_end_early(spark):
    """Places above the diagonal are their mirrors, also behind a 0; from there on the others repeat what came before them."""
    zeros = lambda v: "0" * ((v + 1).bit_length() - 1) + f"{v + 1:b}"
    places = headers.diagonal(8, 8)
    differences = [5, -3, 1, 2]  # of (0, 0), (1, 0), (2, 0), (1, 1); (0, 1) and (0, 2) are mirrors
    ends = 32 + 5 - 3 + 1 + 2  # what would follow is (3, 0): its 0 ends the matrix
    assert places[:7] == [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2), (3, 0)]
    before = {(0, 0): 37, (1, 0): 34, (0, 1): 34, (2, 0): 35, (1, 1): ends, (0, 2): 35}
    bits = "0" + "1" + "".join(zeros(2 * d - 1 if d > 0 else -2 * d) for d in [*differences, -35])
    rest = zeros(2 * 32)  # the other shapes end at once: -32 makes 0
    bits += rest + "0" + rest
    data = int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")
    got = headers.read_header(spark.createDataFrame([(data,)], "payload binary"), "payload", headers.matrix_set(1)).first()
    last, want = 32, {}
    for y, x in places:
        last = before[y, x] if (y, x) in before else want[x, y] if x > y else last
        want[y, x] = last
    assert not got["error"] and got["m00"] == [want[y, x] for y in range(8) for x in range(8)]
    assert got["m10"] == [32] * 32 and got["m20"] == [32] * 32 and got["position"] == len(bits)
