"""Searches over vectors and the audit of sources against plain Python, over nulls, odd vectors, ties, repeated rows and clashing columns."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenfold.llm import divergence, hard_negatives, nearest, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, digest string, row long, vector string, _q int"


def vector_rows(n=900, d=16, seed=5):
    """Vectors in loose clusters, with a vector that a third of the rows share, zeros, nulls, other lengths and repeated ids."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    x = (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * 0.6).astype(np.float32)
    x[rng.permutation(n)[: n // 3]] = x[7]
    rows = [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(x)]
    rows += [(n + 20, None, 1), (n + 40, [0.0] * d, 1), (n + 60, [None] + [1.0] * (d - 1), 2), (n + 80, [float("nan")] * d, 2), (n + 100, [float("inf")] + [1.0] * (d - 1), 2)]
    rows += [(n + 120, [1.0] * (d - 1), 1), (n + 140, [], 1), (None, [1.0] * d, 1), (700, x[3].tolist(), 3), (700, x[3].tolist(), 3), (700, x[9].tolist(), None), (-40, x[11].tolist(), 0), (-100, (-x[11]).tolist(), 0)]
    return [(*r, "d", 1, "v", 2) for r in rows]


def usable(rows, zero):
    found = [(r[0], np.array(r[1], np.float64), r[2]) for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == 16 and None not in r[1]]
    return [r for r in found if np.isfinite(r[1]).all() and (zero or r[1].any())]


# 11


@pytest.mark.parametrize("block_bytes", [16 << 20, 1 << 15])
def test_nearest_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", block_bytes)
    rows = vector_rows()
    got = defaultdict(list)
    for r in nearest.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    every = usable(rows, zero=False)
    asked = Counter(r[0] for r in every if r[0] % 20 == 0)
    assert set(got) == set(asked) and asked[700] == 4
    recalls = []
    for at, (own, q, _) in enumerate(every):
        if own % 20 == 0:
            want = sorted((-float(np.cumsum(q * v)[-1]), i) for n, (i, v, _) in enumerate(every) if n != at)[:20]
            found = sorted(got[own])
            assert [r for r, _, _ in found] == sorted(list(range(1, 21)) * asked[own])
            if asked[own] == 1:
                assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
                assert len(Counter(i for _, i, _ in found) - Counter(r[0] for n, r in enumerate(every) if n != at)) == 0
                recalls.append(sum((Counter((-s, i) for _, i, s in found) & Counter(want)).values()) / 20)
    assert np.mean(recalls) >= 0.95


def test_nearest_finds_all_of_few_and_copes_with_none(spark):
    rows = [(i, [float(i + 1), 1.0, -2.0], 0) for i in range(15)] + [(20, [5.0, 5.0, 5.0], 0)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = nearest.nearest(df).collect()
    assert Counter(r["query_id"] for r in got) == {0: 16, 20: 32}
    want = sorted((-(-2.0 * -2 + 1 + v[0]) if i != 20 else -(5.0 + 5 - 10), i) for i, v, _ in rows if i != 0)
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == [(i, -s) for s, i in want]
    assert nearest.nearest(df.limit(0)).count() == 0 and nearest.nearest(df.where("vec_id = 20").limit(1)).count() == 0
    assert nearest.nearest(df).dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")] == nearest.nearest(df.limit(0)).dtypes


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 16, (3000, 4)).astype(np.uint16)
    code = codes[0] ^ np.uint16(0b101)
    known = nearest.Block(np.zeros((3000, 1)), codes)
    apart = nearest._distances(codes.view(np.uint64), np.ascontiguousarray(code).view(np.uint64))
    seen = set()
    for level, rows in enumerate(known.probes(code)):
        seen |= set(rows.tolist())
        assert set(np.flatnonzero(apart <= 4 * level + 3).tolist()) <= seen


def test_recall_on_the_given_vectors(spark):
    """No structure in these vectors: the radius has to reach far, and still a fifth is not looked at."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in table.collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    found = defaultdict(set)
    for r in nearest.nearest(table).collect():
        found[r["query_id"]].add(r["vec_id"])
    recalls = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        recalls.append(len(found[ids[i]] & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20)
    assert np.mean(recalls) >= 0.9


# 13


def mined(rows, every=100, wrong=7):
    known = [(i, np.floor(256 * v).astype(int).tolist(), (c + 1) % 10 if i % wrong == 0 else c) for i, v, c in usable(rows, zero=True) if c is not None]
    found = []
    for at, (anchor, a, kind) in enumerate(known):
        if anchor % every == 0:
            scores = [(-sum(x * y for x, y in zip(a, v)), i, c) for n, (i, v, c) in enumerate(known) if n != at]
            others = sorted((s, i) for s, i, c in scores if c != kind)
            for less, positive in sorted((s, i) for s, i, c in scores if c == kind)[:5]:
                inside = [(-s, i) for s, i in others if 30 * -less <= 100 * -s <= 90 * -less][:10]
                found += [(anchor, positive, n + 1, i, -less, s) for n, (s, i) in enumerate(inside)]
    return sorted(found)


@pytest.mark.parametrize("block_bytes", [16 << 20, 1 << 15])
def test_hard_negatives_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", block_bytes)
    rows = vector_rows()
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), every=25)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows, every=25)
    assert len(want) > 500 and sorted(map(tuple, got.collect())) == want
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = hard_negatives.mine(spark.createDataFrame([(0, [1.0], 1, None, None, None, None)], SCHEMA))
    assert alone.count() == 0


def test_bounds_drop_candidates():
    rng = np.random.default_rng(4)
    values = rng.integers(-80, 80, (4000, 64))
    values[:40] = values[0] + rng.integers(-3, 4, (40, 64))
    columns, left = hard_negatives.Columns(values), []

    def keep(partial, low, high):
        left.append(len(partial))
        return hard_negatives._at_least(partial, low, high, 5)

    rows, scores = columns.scan(values[0], np.ones(4000, bool), keep)
    exact = values @ values[0]
    assert set(np.argsort(-exact)[:5]) <= set(rows) and (scores == exact[rows]).all()
    assert left == sorted(left, reverse=True) and left[-1] < 400


@pytest.mark.parametrize("positive", [-7, 0, 1, 99, 100, 333])
def test_window(positive):
    first, last = hard_negatives.window(positive, 30, 90)
    assert [n for n in range(-400, 400) if 30 * positive <= 100 * n <= 90 * positive] == list(range(first, last + 1))


# 12

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audited(rows, min_docs):
    docs = [((r[2] or ""), (r[3] or ""), TERM.findall((r[1] or "").translate(LOWER))) for r in rows]
    df = Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= min_docs:
            kept[lang].append(t)
    n, whole = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        n[lang, source].update(t for t in terms if df[lang, t] >= min_docs)
        whole[lang].update(t for t in terms if df[lang, t] >= min_docs)
    found = []
    for lang, source in n:
        v = len(kept[lang])
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)  # noqa: E731, B023
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        own = n[lang, source]
        pairs = [(-sum(apart(share(own, t), share(n[lang, s], t)) for t in kept[lang]), s.encode()) for x, s in n if x == lang and s != source]
        terms = [(-apart(share(own, t), share(whole[lang], t)), t.encode()) for t in own if share(own, t) > share(whole[lang], t)]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
            found += [(lang, source, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(items)]
    return sorted(found)


@pytest.mark.parametrize("sizes", [None, {"VOCABULARY": 5, "SOURCES": 2, "COUNTS": 20, "CLASSES": 1}])
def test_divergence_against_plain_python(spark, monkeypatch, rows, docs, sizes):
    for k, v in (sizes or {}).items():
        monkeypatch.setattr(divergence, k, v)
    got = divergence.audit(docs, min_docs=10)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    want = audited(rows, 10)
    assert {x[2] for x in want} == {"pair", "term"} and sorted(map(tuple, got.collect())) == want


def test_divergence_without_terms(spark, docs, empty, rows):
    assert divergence.audit(empty).count() == 0
    got = divergence.audit(docs, min_docs=1000).collect()  # no term is kept: every pair is 0 apart
    assert {(r["part"], r["value"]) for r in got} == {("pair", 0)} and sorted(map(tuple, got)) == audited(rows, 1000)


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    cases = [(0, 1, 1), (7, 7, 1), (10**12, 10**15, 3), (123456789012, 987654321987, 1000), (5, 10**15, 10**6)]
    df = spark.createDataFrame(cases, "n long, total long, terms long")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [1 + 10**9 * (n + 2) // (total + 2 * terms) for n, total, terms in cases]
