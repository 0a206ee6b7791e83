"""Parsers on whole, truncated and corrupted bytes: rows or an error row, never an exception."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import bitcodes
from lumenfold.operators import container
from lumenfold.plans import containers
from lumenfold.sources import isobmff, obu
from lumenfold.streaming import session

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def some(spark):
    return containers.files(spark, DIR).limit(6).collect()


def frame(spark, contents):
    return spark.createDataFrame([(str(i), None if c is None else bytes(c)) for i, c in enumerate(contents)], "path string, content binary")


def test_truncated_and_corrupted_files(spark, some):
    rng = random.Random(1)
    contents = [None, b"", b"\0" * 7]
    for r in some:
        whole = bytes(r["content"])
        contents += [whole[: rng.randrange(len(whole))] for _ in range(5)]
        for _ in range(5):
            bad = bytearray(whole)
            for _ in range(3):
                bad[rng.randrange(len(bad))] = rng.randrange(256)
            contents.append(bytes(bad))
    files = frame(spark, contents)
    found = isobmff.describe(files, most_bytes=1 << 20).cache()
    assert found.count() == len(contents) and isobmff.boxes(found).count() > 0
    assert container.images(files).count() <= len(contents) and container.payloads(files).count() >= 0
    for table in (isobmff.items, isobmff.properties, isobmff.associations, isobmff.extents, isobmff.references):
        assert table(found).count() >= 0


def test_items_larger_than_allowed_or_beyond_the_file(spark, some):
    got = container.payloads(frame(spark, [r["content"] for r in some]), 9).collect()
    assert got and all(r["payload"] is None or len(r["payload"]) <= 9 for r in got)
    iloc = struct.pack(">IHH", 0, 0x4400, 1) + struct.pack(">HHHII", 1, 0, 1, 0, 10_000)
    box = lambda kind, body: struct.pack(">I4s", len(body) + 8, kind) + body
    whole = box(b"ftyp", b"avif\0\0\0\0") + box(b"meta", bytes(4) + box(b"iloc", iloc) + box(b"ipma", struct.pack(">II", 0, 2) + struct.pack(">HBB", 1, 1, 0x81)))
    row = container.described(frame(spark, [whole]), *isobmff.LISTS, most_bytes=1 << 20).first()
    assert [(p["item_id"], p["payload"]) for p in row["payloads"]] == [(1, None)]
    assert sorted(row["errors"]) == ["ipma ends too soon", "item 1 ends beyond the file"] and [a["idx"] for a in row["associations"]] == [1]


def test_box_sizes(spark):
    box = lambda kind, body, size=None: struct.pack(">I4s", len(body) + 8 if size is None else size, kind) + body
    large = struct.pack(">I4sQ", 1, b"free", 20) + b"abcd"
    got = isobmff.boxes(isobmff.describe(frame(spark, [box(b"free", b"xy") + large, box(b"free", b"") + box(b"skip", b"", 0), box(b"free", b"") + box(b"skip", b"", 99)]))).collect()
    by = lambda p: [(r["fourcc"], r["length"], r["error"] is not None) for r in sorted(got, key=lambda r: (r["ord"] is None, r["ord"])) if r["path"] == p]
    assert by("0") == [("free", 10, False), ("free", 20, False)]
    assert by("1") == [("free", 8, False), (None, None, True)]
    assert by("2") == [("free", 8, False)]


def test_hostile_files_give_error_rows(spark):
    """Places beyond 63 bits, numbers of odd sizes, thousands of nested boxes, more boxes than allowed: one file never ends the job."""
    box = lambda kind, body: struct.pack(">I4s", len(body) + 8, kind) + body
    lists = lambda sizes, *rest: box(b"ftyp", b"avif\0\0\0\0") + box(b"meta", bytes(4) + box(b"iloc", struct.pack(">IHH", 0, sizes, 1) + b"".join(rest)))
    far = lists(0x8800, struct.pack(">HHHQQ", 1, 0, 1, (1 << 64) - 1, 1))
    sum_ = lists(0x8880, struct.pack(">HHQHQQ", 1, 0, (1 << 63) - 1, 1, 5, 5))
    odd = lists(0xFF00, bytes(64))
    deep = b""
    for _ in range(3000):
        deep = box(b"meta", bytes(4) + deep)
    deep, many = box(b"ftyp", b"avif\0\0\0\0") + deep, box(b"free", b"") * 50
    found = {r["path"]: r for r in isobmff.describe(frame(spark, [far, sum_, odd, deep, many]), most_boxes=40).collect()}
    assert [found[str(i)]["extents"] for i in range(3)] == [[], [], []] and [found[str(i)]["payloads"] for i in range(3)] == [[], [], []]
    assert "beyond any file" in found["0"]["errors"][0] and "beyond any file" in found["1"]["errors"][0] and "15, 15" in found["2"]["errors"][0]
    assert found["3"]["errors"] == ["boxes lie too deep"] and len(found["3"]["boxes"]) == isobmff.MOST_DEPTH + 1
    assert found["4"]["errors"] == ["too many boxes"] and len(found["4"]["boxes"]) == 40
    assert container.images(frame(spark, [far, sum_, odd, deep])).count() == 4


def test_only_wanted_lists_are_returned(spark, some):
    files = frame(spark, [r["content"] for r in some] + [None])
    whole = {r["path"]: r for r in isobmff.describe(files).collect()}
    for wanted in (("levels",), ("payloads", "boxes"), ()):
        got = isobmff.describe(files, wanted)
        assert got.columns == ["path", "primary_id", *wanted, "errors"]
        assert all(r[x] == whole[r["path"]][x] for r in got.collect() for x in wanted)


def test_tiles_of_groups(spark):
    from lumenfold.plans.more import slice_tiles

    content = (2).to_bytes(4, "little") + b"abc" + (0).to_bytes(4, "little") + b"d" + b"efg"
    rows = [(None, 3, content, "x"), (1, 2, content[:5], "y"), (2, 0, b"", "z"), (3, None, b"", "z"), (4, 1, None, None), (5, 1, b"", "t")]
    got = slice_tiles(spark.createDataFrame(rows, "id long, tiles long, content binary, turns string")).collect()
    assert {r["id"]: (r["turns"], r["payloads"]) for r in got} == {None: ("x", [b"abc", b"d", b"efg"]), 1: ("y", None), 2: ("z", []), 3: ("z", None), 4: (None, None), 5: ("t", [b""])}


def test_tiles_of_a_null_and_of_a_long_conversation(spark, tmp_path):
    from collections import Counter

    from lumenfold.plans import more

    rows = [(None, 1, "user", "a"), (None, None, "user", None), (7, 1, None, "é"), (7, 1, None, "é")] + [(9, i % 700, "x", f"t{i % 50}") for i in range(3000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = more.tile_slicing(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter((c, t, (x or "") + "|") for c, t, _, x in rows)


def test_files_of_a_folder(spark, some, tmp_path):
    for i, r in enumerate(some):
        (tmp_path / f"{i}.avif").write_bytes(bytes(r["content"]))
    (tmp_path / "note.txt").write_text("no image")
    found = isobmff.read_files(spark, str(tmp_path))
    assert found.count() == 7 and container.images(found).count() == found.where(isobmff.probe(F.col("content"))).count()


def test_units(spark):
    long_ = bytes([0x80] * 8)
    streams = [(0, bytes([2, 0x20, 9, 0, 3, 0x84, 0x45, 7])), (1, bytes([5, 1])), (2, long_), (3, None), (4, bytes([1, 0x80]))]
    rows = obu.units(spark.createDataFrame(streams, "stream_id long, content binary")).collect()
    assert [(r["type"], r["tlayer"], r["mlayer"], r["xlayer"], bytes(r["payload"])) for r in rows if r["stream_id"] == 0] == [(8, 0, 0, 0, b"\x09"), (1, 0, 2, 5, b"\x07")]
    assert {r["stream_id"]: r["error"] is not None for r in rows if r["stream_id"]} == {1: True, 2: True, 4: True}


@pytest.mark.parametrize("v", [0, 1, 2, 127, 128, 300, 65535, 65536, (1 << 32) - 1, 1 << 40])
def test_codes_round_trip(spark, v):
    c = F.lit(v).cast("bigint")
    row = spark.range(1).select(
        bitcodes.read_leb128(bitcodes.leb128(c)).alias("leb"), bitcodes.read_exp_golomb(bitcodes.exp_golomb(c % 70000)).alias("exp"),
        bitcodes.read_golomb_rice(bitcodes.golomb_rice(c % 5000, 3), 3).alias("rice"), bitcodes.inverse_recenter(F.lit(50), bitcodes.recenter(F.lit(50), c)).alias("centre"),
        *[bitcodes.read_quasi_uniform(bitcodes.quasi_uniform(c % n, F.lit(n)), F.lit(n)).alias(f"q{n}") for n in (2, 3, 5, 8, 100)],
    ).first()
    assert (row["leb"], row["exp"], row["rice"], row["centre"]) == (v, v % 70000, v % 5000, v)
    assert [row[f"q{n}"] for n in (2, 3, 5, 8, 100)] == [v % n for n in (2, 3, 5, 8, 100)]


def test_golomb_rice_of_any_length(spark):
    """Short and long codes, codes that more bits follow, texts that are none, and null."""
    values = [0, 1, 31, 32, 63, 255 * 32, 256 * 32 + 31, 257 * 32, 8000 * 32 + 5, 1 << 21, -3, None]
    for k in (0, 1, 5):
        df = spark.createDataFrame([(v,) for v in values if v is None or v >> k <= 1 << 17], "v long").withColumn("code", bitcodes.golomb_rice(F.col("v"), k))
        after = [bitcodes.read_golomb_rice(F.concat("code", F.lit(x)), k).alias(f"a{i}") for i, x in enumerate(("", "0", "1", "10110", "0" * 40, "1" * 40))]
        for r in df.select("*", *after).collect():
            v = r["v"]
            assert r["code"] == (None if v is None else "1" * (v >> k) + "0" + format(v & (1 << k) - 1, "b").zfill(k)[:k])
            assert [r[f"a{i}"] for i in range(6)] == [v if v is None or v >= 0 else v & (1 << k) - 1] * 6
    texts = spark.createDataFrame([(x,) for x in ("1011010", "1101111111010", "01111101111", "1110111011111")], "code string")
    assert [r[0] for r in texts.select(bitcodes.read_golomb_rice(F.col("code"), 5)).collect()] == [32 + 26, 64 + 31, 31, 96 + 29]


def test_long_golomb_rice_codes_are_read_in_words(spark):
    """Reading a code takes much less than searching its characters one by one."""
    import time

    coded = spark.range(0, 60, 1, 1).select(bitcodes.golomb_rice(F.col("id") + (1 << 25), 5).alias("code"))

    def seconds(c):
        took = []
        for _ in range(3):
            began = time.time()
            coded.select("code", c.alias("read")).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return min(took)

    assert 3 * seconds(bitcodes.read_golomb_rice(F.col("code"), 5)) < seconds(F.instr("code", "0"))


def test_long_codes_are_dealt_to_all_cores(spark, tmp_path):
    from lumenfold import registry

    spark.range(5000).selectExpr("id AS o_orderkey", "id * 300 AS o_custkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    made = registry.queries()["golomb_rice_roundtrip"](spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == 8
    assert made.selectExpr("count(*)", "count_if(back = o_orderkey * 300)", "sum(length(code))").first()[:] == (5000, 5000, sum((i * 300 >> 5) + 6 for i in range(5000)))


def test_orientation_pairs(spark):
    rows = spark.createDataFrame([(s, a) for s in range(4) for a in (None, 0, 1)], "s int, a int").select("s", "a", container.orientation(F.col("s"), F.col("a")).alias("name")).collect()
    names = {(r["s"], r["a"]): r["name"] for r in rows}
    assert names[2, 0] == names[2, 1] == names[3, 1] == names[1, 1] == names[0, None] == "Normal"
    assert names[3, 0] == "Transpose" and names[1, 0] == "Transverse" and names[0, 0] == "FlipH" and names[0, 1] == "FlipV"


def test_session_emits_in_display_order():
    rng = random.Random(2)
    for _ in range(50):
        shown = list(range(60))
        for at in range(0, 60, 4):
            part = shown[at : at + 4]
            rng.shuffle(part)
            shown[at : at + 4] = part
        now, out = session.Session(), []
        for n, order in enumerate(shown):
            out += now.push(n, order % (1 << session.BITS))
        out += now.flush()
        assert [o[1] for o in out] == sorted(shown) and [o[2] for o in out] == list(range(60))


def replayed(rows):
    """The session's rows, replayed one by one over lists: (decode_ord, disp_order, out_seq, error)."""
    out, waiting, highest, seq = [], [], 0, 0

    def show(n):
        nonlocal seq
        for order, decode_ord in waiting[:n]:
            out.append((decode_ord, order, seq, False))
            seq += 1
        del waiting[:n]

    for decode_ord, hint, kind in rows:
        if kind == session.ERROR:
            waiting, highest = [], 0
            out.append((decode_ord, None, None, True))
            continue
        if kind == session.NEW_SEQUENCE:
            show(len(waiting))
            highest = 0
        order = hint
        while order <= highest - 32:
            order += 64
        highest = max(highest, order)
        waiting.append((order, decode_ord))
        waiting.sort()
        if len(waiting) > 8:
            n = 1
            while n < len(waiting) and waiting[n][0] == waiting[n - 1][0] + 1:
                n += 1
            show(n)
    show(len(waiting))
    return out


def test_streams_over_several_micro_batches(spark, tmp_path):
    """One file a trigger gives what one trigger for all gives; new sequences and faults included."""
    events = spark.read.parquet(f"{DIR}/events.parquet").where("event_id < 700").orderBy("event_id")
    for n in range(5):
        events.where(f"event_id >= {n * 140} AND event_id < {n * 140 + 140}").coalesce(1).write.parquet(str(tmp_path / "events" / f"part={n}"))
    folder, key = str(tmp_path / "flat"), lambda r: (r["stream_id"], r["decode_ord"])
    import glob
    import os
    import shutil

    os.mkdir(folder)
    for n in range(5):
        shutil.copy(glob.glob(str(tmp_path / "events" / f"part={n}" / "*.parquet"))[0], f"{folder}/{n}.parquet")
        os.utime(f"{folder}/{n}.parquet", (n + 1, n + 1))
    decoded = session.broken_frames(events).collect()
    for decode, want in ((session.frames, None), (session.broken_frames, decoded)):
        one = sorted((tuple(r) for r in session.run_stream(spark, folder, decode, 1).collect()), key=str)
        assert one == sorted((tuple(r) for r in session.run_stream(spark, folder, decode).collect()), key=str)
        if want:
            expected = []
            for stream in {r["stream_id"] for r in want}:
                own = sorted((r for r in want if r["stream_id"] == stream), key=key)
                expected += [(stream, *x) for x in replayed([(r["decode_ord"], r["hint"], r["kind"]) for r in own])]
            assert one == sorted(expected, key=str) and any(x[4] for x in one)


def test_range_coder():
    from lumenfold.operators.rangecoder import decode, encode

    rng = random.Random(3)
    for _ in range(200):
        size, n, p = rng.randint(2, 8), rng.randint(0, 200), rng.random()
        symbols = [rng.randrange(size) if rng.random() < p else 0 for _ in range(n)]
        assert decode(encode(symbols, size), n, size) == symbols
    assert len(encode([0] * 1000, 4)) < 25


def test_long_lists_are_read_whole():
    n = 5000
    ipma = struct.pack(">II", 0, n) + b"".join(struct.pack(">HBB", i + 1, 1, 0x81) for i in range(n))
    assert list(isobmff._associations(ipma)) == [(i + 1, 0, 1, True) for i in range(n)]
    iloc = struct.pack(">IHH", 0, 0x4400, n) + b"".join(struct.pack(">HHHII", i + 1, 0, 1, i, 7) for i in range(n))
    assert list(isobmff._extents(iloc)) == [(i + 1, 0, i, 7) for i in range(n)]
