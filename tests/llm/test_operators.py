"""Every operator against a plain Python version, over nulls, empty and long texts, ties, and clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenfold.llm import common, components, exact_dedup, language_id, licenses, mixing, packing, quality_classifier, quality_rules, repeated_passages, simhash, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1


def test_linear_time_score_equals_all_pairs():
    rng = np.random.default_rng(1)
    width = quality_classifier.BUCKETS + len(quality_classifier.STATISTICS)
    k = len(quality_classifier.STATISTICS)
    model = quality_classifier.Model(0.3, rng.normal(size=width), rng.normal(size=(width, 4)), np.zeros(k), np.ones(k))
    bucket, weight, stats = np.array([3, 9, 700]), np.array([0.2, 0.5, 0.7]), rng.uniform(-1, 1, (2, k))
    got = quality_classifier.raw_scores(model, np.array([0, 3, 3]), bucket, weight, stats)
    for i, inputs in enumerate([dict(zip(bucket, weight)), {}]):
        x = inputs | {quality_classifier.BUCKETS + j: v for j, v in enumerate(stats[i])}
        want = 0.3 + sum(model.weights[a] * v for a, v in x.items())
        keys = sorted(x)
        want += sum(model.factors[a] @ model.factors[b] * x[a] * x[b] for n, a in enumerate(keys) for b in keys[n + 1 :])
        assert got[i] == pytest.approx(want)


def test_classifier(spark, docs, labels, rows, empty):
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    again = quality_classifier.score(docs.repartition(1), quality_classifier.train(docs.repartition(2), labels)).collect()
    assert {(r["doc_id"], r["score"]) for r in got} == {(r["doc_id"], r["score"]) for r in again}
    good = quality_classifier.keep_good(docs, labels)
    assert good.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in good.collect()) == sorted(r["doc_id"] or -1 for r in got if r["predicted"])
    assert quality_classifier.score(empty, model).count() == 0
    flat = quality_classifier.score(docs, quality_classifier.train(docs, labels.limit(0))).collect()
    assert {r["score"] for r in flat} == {0.5}


def plain_score(model, text, n_chars):
    """The score of one text, over its words and characters one by one and all pairs of inputs."""
    from lumenfold.llm import words as w

    known = quality_classifier
    tokens, data = (text or "").encode().split(), (text or "").encode()
    buckets = Counter(int(w.hash_words(np.frombuffer(t, np.uint8), w.find_words(np.frombuffer(t, np.uint8), np.array([0, len(t)])))[0] % known.BUCKETS) for t in tokens)
    x = {b: np.log1p(n) for b, n in buckets.items()}
    norm = sum(v * v for v in x.values()) ** 0.5
    x = {b: v / norm for b, v in x.items()}
    share = lambda inside: sum(map(inside, data)) / max(len(data), 1)
    marks, n = b"#*$%&|<>!", max(len(tokens), 1)
    stats = {
        "words": np.log1p(len(tokens)), "word bytes": sum(map(len, tokens)) / n, "upper case": share(lambda c: 65 <= c <= 90), "digits": share(lambda c: 48 <= c <= 57), "symbols": share(lambda c: c in b"#*$%&<>"),
        "bars": share(lambda c: c == 124), "exclamations": share(lambda c: c == 33), "beyond ASCII": share(lambda c: c > 127), "line ends": share(lambda c: c == 10), "distinct words": len(set(tokens)) / n,
        "commonest word": max(Counter(tokens).values(), default=0) / n, "words ending in a mark": sum(t[-1] in marks for t in tokens) / n, "words of upper case": sum(65 <= t[0] <= 90 and 65 <= (t + b" ")[1] <= 90 for t in tokens) / n,
        "full stops": share(lambda c: c == 46), "n_chars": np.log1p(max(n_chars or 0, 0)), "n_chars missing": float(n_chars is None),
    }
    for i, name in enumerate(known.STATISTICS):
        x[known.BUCKETS + i] = min(4, max(-4, (stats[name] - model.mean[i]) / model.spread[i]))
    total, keys = model.bias + sum(model.weights[a] * v for a, v in x.items()), sorted(x)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            total += model.factors[a] @ model.factors[b] * x[a] * x[b]
    return 1 / (1 + np.exp(-min(30, max(-30, total))))


def test_scores_against_plain_python(spark, docs, labels, rows):
    model = quality_classifier.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    for r in rows:
        if len(r[1] or "") < 3000:
            assert got[r[0]] == pytest.approx(plain_score(model, r[1], r[4]), abs=1e-9)


def test_training_takes_one_row_of_a_repeated_doc_id(spark, docs, labels):
    again = docs.union(docs.where("doc_id < 30")).union(docs.where("doc_id < 30").withColumn("text", F.substring("text", 1, 20)))
    one, two = quality_classifier.train(docs, labels), quality_classifier.train(again, labels)
    assert one.bias == two.bias and np.array_equal(one.weights, two.weights)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = quality_classifier.score(docs, quality_classifier.train(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    bad, good = [r["score"] for r in scored if not r["quality"]], [r["score"] for r in scored if r["quality"]]
    assert sum(b < g for b in bad for g in good) / (len(bad) * len(good)) > 0.95


# 2


def test_targets_fill_up():
    def want(sizes):
        left, out, total = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}, {}, 1.5 * sum(sizes.values())
        while True:
            level = (total - sum(out.values())) / sum(left.values()) if left else 0
            over = [s for s in left if level * left[s] > 2 * sizes[s]]
            if not over:
                return out | {s: level * w for s, w in left.items()}
            for s in over:
                out[s] = 2.0 * sizes[s]
                del left[s]

    test_targets_fill_up.want = want
    assert want({"a": 10, "b": 10, "c": 10}) == {"a": 20, "b": 25 / 3, "c": 50 / 3}


def test_mixing(spark, docs, rows, empty):
    test_targets_fill_up()
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes["\U0010ffff" if r[3] is None else r[3]] += len(words(r[1]))
    goal = test_targets_fill_up.want(sizes)
    taken, largest = Counter(), Counter()
    for r in got:
        s = "\U0010ffff" if r["source"] is None else r["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(goal[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - goal[s]) <= largest[s] / 2 for s in goal)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0
    repeated = mixing.repeat_by_mix(docs.where("doc_id IS NOT NULL"))
    assert repeated.columns == docs.columns and Counter(r["doc_id"] for r in repeated.collect()) == {r["doc_id"]: r["copies"] if r["size"] else 1 for r in mixing.mix(docs.where("doc_id IS NOT NULL")).collect() if r["copies"] or not r["size"]}


def test_mixing_does_not_depend_on_splits(spark, docs):
    rng = random.Random(9)
    many = spark.createDataFrame([(i if i % 5 else i % 3 or None, "w " * rng.randint(1, 40) + f"t{i % 700}", f"s{i % 2}") for i in range(9000)], "doc_id long, text string, source string")
    same = spark.createDataFrame([(1, "a b c", "s")] * 200 + [(None, "a b", "s")] * 100, "doc_id long, text string, source string")
    for given in (docs, many, same):
        first = sorted(map(str, mixing.mix(given).collect()))
        assert len(first) == given.count()
        assert sorted(map(str, mixing.mix(given.repartition(7)).collect())) == first
        assert sorted(map(str, mixing.mix(given.coalesce(1)).collect())) == first
    got = mixing.mix(same).collect()
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 1.5
    assert len({r["copies"] for r in got if r["doc_id"]}) == 2


def test_mixing_of_many_equal_or_null_ids(spark, monkeypatch):
    """A third of all rows equal, a third with a null doc_id: no group of a meeting is much larger than FAN."""
    given = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id")).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("a b c")).otherwise(F.concat(F.lit("w "), F.col("id").cast("string"))).alias("text"), F.lit("s").alias("source"))
    given = given.union(spark.createDataFrame([(1, "x y", "t")], given.schema))
    sizes, write = [], mixing.materialize

    def watched(df, name):
        found = write(df, name)
        if name == "met0":
            sizes.append(found.agg(F.max(F.size("out"))).first()[0])
        return found

    monkeypatch.setattr(mixing, "materialize", watched)
    got = mixing.mix(given)
    assert got.count() == 30_001 and sizes[0] < 3 * mixing.FAN
    one = got.where("source = 's'").agg({"taken": "sum", "target": "max"}).first()
    assert abs(one["sum(taken)"] - one["max(target)"]) <= 2


def test_targets_of_many_sources(spark):
    """More sources than a range holds, against filling up in plain Python."""
    sizes = {f"s{i:05}": (i * 7919) % 997 for i in range(3000)}
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(sorted(sizes))}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        level = (total - sum(2 * sizes[k] for k in stopped)) / sum(weight[k] for k in sizes if k not in stopped)
        more = {k for k in sizes if k not in stopped and level * weight[k] > 2 * sizes[k]}
        if not more:
            break
        stopped |= more
    assert all(got[k] == pytest.approx(2 * sizes[k] if k in stopped else level * weight[k]) for k in sizes)


def test_running_sums(spark):
    from lumenfold.llm.common import running

    given = spark.createDataFrame([(i, (i * 37) % 101, i % 5) for i in range(1, 500)], "id long, key long, v long")
    got = running(given, [F.col("key"), F.col("id").desc()], {"before": "v", "rank": "id"}, "sums").collect()
    order, seen, ids = sorted(got, key=lambda r: (r["key"], -r["id"])), 0, 0
    for r in order:
        assert (r["before"], r["rank"]) == (seen, ids)
        seen, ids = seen + r["v"], ids + r["id"]


def test_mixing_in_several_levels_keeps_words(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "w " * rng.randint(1, 40), f"s{i % 2}") for i in range(9000)], "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert len(got) == 2 and all(abs(r["sum(taken)"] - r["max(target)"]) <= 20 for r in got)


# 3


def test_segment_tree_equals_encoding_anew():
    import public_tokenizers

    counter, rng = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), random.Random(2)
    parts = ["a", "bc", " ", "  ", "\n", "'s", "'", "12", "é", "!!", " the", "\t", "漢字"]
    for _ in range(300):
        now = "".join(rng.choice(parts) for _ in range(rng.randint(0, 400)))
        tree = token_counts.SegmentTree(counter, now)
        for _ in range(8):
            at, delete, insert = rng.randint(0, len(now) + 2), rng.randint(0, 9), "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))
            begin = min(at, len(now))
            now = now[:begin] + insert + now[begin + delete :]
            assert tree.edit(at, delete, insert) == len(counter.encoding.encode_ordinary(now))
            assert tree.text() == now and [x for leaf in tree.leaves for x in leaf] == counter.cut(now)


def test_recount(spark, docs, rows, empty):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoding = token_counts.Counter(path, pattern).encoding
    edits = token_counts.sample_edits(docs.where("doc_id IS NOT NULL"))
    script = defaultdict(list)
    for e in edits.collect():
        script[e["doc_id"]].append(e)
    got = by_id(token_counts.recount(docs, edits, path, pattern))
    assert len(got) == len(rows)
    for r in rows:
        text = r[1] or ""
        assert got[r[0]]["tokens_before"] == len(encoding.encode_ordinary(text))
        for e in sorted(script[r[0]], key=lambda e: e["seq"]):
            text = text[: e["at"]] + e["insert"] + text[e["at"] + e["delete"] :]
        assert got[r[0]]["tokens_after"] == len(encoding.encode_ordinary(text)) and got[r[0]]["chars_after"] == len(text)
    assert sum(r["reencoded"] for r in got.values()) < 0.2 * sum(r["pretokens"] for r in got.values())
    assert token_counts.recount(empty, edits, path, pattern).count() == 0


def test_stored_trees_spare_what_edits_leave_alone(spark, docs, rows):
    """Documents without edits keep what is stored, right or not; leaves that an edit doesn't touch are neither cut nor encoded."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    trees = token_counts.build_trees(docs, path, pattern).withColumn("tokens", F.when(F.col("doc_id") == 3, F.col("tokens")).otherwise(-5)).cache()
    edits = spark.createDataFrame([(3, 1, 2, 1, "xyz"), (None, 1, 0, 5, "lost"), (10**6, 1, 0, 0, "unknown")], "doc_id long, seq long, at long, delete long, insert string")
    got = token_counts.update(docs, trees, edits, path, pattern).collect()
    assert len(got) == len(rows) and {(r["tokens_after"], r["edits"]) for r in got if r["doc_id"] != 3} == {(-5, 0)}
    text = next(r[1] for r in rows if r[0] == 3)
    counter = token_counts.Counter(path, pattern)
    assert [r["tokens_after"] for r in got if r["doc_id"] == 3] == [len(counter.encoding.encode_ordinary(text[:2] + "xyz" + text[3:]))]

    class Watched(token_counts.Counter):
        asked = 0

        def __call__(self, piece):
            self.asked += 1
            return super().__call__(piece)

    long = "The thing, and 12 more: l'été  \n" * 4000
    stored = token_counts.SegmentTree(counter, long).stored()
    watched = Watched(path, pattern)
    tree = token_counts.SegmentTree(watched, long, stored)
    for at, insert in ((70_000, "new"), (5, " "), (len(long), "end"), (70_001, "\n\n")):
        long = long[:at] + insert + long[at:]
        assert tree.edit(at, 0, insert) == len(counter.encoding.encode_ordinary(long))
    assert watched.asked < 100 and sum(isinstance(x, list) for x in tree.leaves) < 10 and tree.text() == long


def test_recount_of_repeated_ids(spark):
    """Rows that share a doc_id: each text gets the edits; whole repeats are counted alike."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    given = spark.createDataFrame([(1, "one two")] * 50 + [(1, "three"), (1, None), (None, "four"), (None, "five")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 0, "b "), (1, 1, 0, 0, "a ")], "doc_id long, seq long, at long, delete long, insert string")
    got = Counter((r["doc_id"], r["tokens_before"], r["chars_after"], r["edits"]) for r in token_counts.recount(given, edits, path, pattern).collect())
    size = lambda t: len(token_counts.Counter(path, pattern).encoding.encode_ordinary(t))
    assert got == {(1, size("one two"), 11, 2): 50, (1, size("three"), 9, 2): 1, (1, 0, 4, 2): 1, (None, size("four"), 4, 0): 2}


# 4


def thue_morse(n):
    """A word of a and b, and that with both exchanged: polynomial hashes modulo a power of two can't tell them apart."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_a_polynomial_hash_confuses(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [x for n in (1024, 2048) for x in thue_morse(n)]
    texts += [f"{a} {' '.join(f'w{i}' for i in range(49))}" for a in texts] + [f"{texts[0]} {' '.join(f'w{i}' for i in range(49))} tail"]
    rows = list(enumerate(texts))
    given = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in repeated_passages.removal_digests(given).collect())
    want = removed([(i, words(t)) for i, t in rows])
    assert {r[0]: r[1:] for r in got} == want and got[-1][2] == 50 and all(r[2] == 0 for r in got[:-1])
    from tokenizers import Tokenizer

    ids = {r["doc_id"]: r["ids"] for r in packing.pieces(given, path, capacity=1 << 20, keep_ids=True).collect()}
    tokenizer = Tokenizer.from_file(path)
    assert all(ids[i] == tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in rows)


def test_ids_where_all_hashes_are_equal(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "fold_keys", lambda low, high: low % np.uint64(2))
    texts = ["the thing of others", "others of the thing, the x" * 3, "", "a\x00 a"]
    data = [t.encode() for t in texts]
    ids, first = packing.WordIds(path)(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_word_keys_and_run_names():
    from lumenfold.llm import words as w

    rng = random.Random(8)
    some = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(1, 20))) for _ in range(3000)]
    data = np.frombuffer(b" ".join(some), np.uint8)
    found = w.find_words(data, np.array([0, len(data)]))
    low, high = w.word_keys(data, found.starts, found.ends)
    keys = dict(zip(some, zip(low.tolist(), high.tolist())))
    assert all(keys[x] == k for x, k in zip(some, zip(low.tolist(), high.tolist()))) and len(set(keys.values())) == len(keys)
    names = w.word_names(low, high) % 3
    for size in (1, 2, 5, 8, 50):
        runs, seen = w.run_names(names, size), {}
        assert len(runs) == len(names) - size + 1
        assert all(seen.setdefault(tuple(names[i : i + size]), r) == r for i, r in enumerate(runs.tolist())) and len(seen) == len(set(runs.tolist()))


def removed(rows):
    first = {}
    for doc_id, w in rows:
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = {}
    for doc_id, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < doc_id:
                gone[i : i + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc_id] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("shard_bytes", [6 << 20, 900])
def test_repeated_passages(spark, docs, rows, empty, monkeypatch, shard_bytes):
    monkeypatch.setattr(repeated_passages, "SHARD_BYTES", shard_bytes)
    got = by_id(repeated_passages.removal_digests(docs))
    want = removed([(r[0], words(r[1])) for r in rows if r[0] is not None])
    assert len(got) == len(rows) and got.pop(None)["n_removed"] == 0
    assert {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in got.items()} == want
    assert sum(x[1] > 0 for x in want.values()) > 10
    assert repeated_passages.removal_digests(empty).count() == 0


# 5


@pytest.mark.parametrize("shard_bytes", [6 << 20, 900])
def test_repeated_passages_of_rows_that_share_a_doc_id(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(repeated_passages, "SHARD_BYTES", shard_bytes)
    rng = random.Random(6)
    w = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    passage = w(70)
    rows = [(1, f"{w(5)} {passage}"), (2, None), (2, f"{w(9)} {passage} {w(3)}"), (2, w(60)), (2, ""), (2, None), (1, None)]
    rows += [(i, f"{passage} {w(20)}") for i in range(3, 9)]
    got = repeated_passages.removal_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = []
    for doc_id, text in rows:
        kept = words(text)
        if doc_id > 1 and passage in (text or ""):
            kept = words(text.replace(passage, ""))
        want.append((doc_id, len(words(text)), len(words(text)) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_language_id(spark, docs, empty):
    known = spark.createDataFrame([("the thing of this and that whether " * 5, "en"), ("le que dans une pas aux être " * 5, "fr"), (None, "fr"), ("x", None)], "text string, lang string")
    pages = spark.createDataFrame(
        [(1, "http://a.example.fr/x", "<html lang='fr'><body>dans une que</body>", 0), (2, "http://a.example.fr/y", "<html><p>", 0), (3, None, None, 0), (4, "http://b.example.uk/", "<HTML LANG=en><script>le que dans</script>the thing that", 0), (5, "http://b.example.uk/", "", 0)] * 2,
        "page_id long, url string, html string, lang int",
    )
    got = {(r["page_id"], r["lang"], round(r["probability"], 9)) for r in language_id.identify(pages, known).collect()}
    assert {(p, lang) for p, lang, _ in got if p != 3} == {(1, "fr"), (2, "fr"), (4, "en"), (5, "en")} and len(got) == 5
    assert language_id.identify(pages.limit(0), known).count() == 0
    assert {r["lang"] for r in language_id.identify(pages, known.limit(0)).collect()} == {None}


def test_posteriors_against_plain_python(spark):
    """Every page's posterior from its n-grams, markup, address, host and domain, one by one."""
    L = language_id
    known = [("the thing of this and that whether " * 5, "en"), ("le que dans une pas aux être " * 5, "fr"), ("der und nicht ist das " * 4, "de"), (None, "fr"), ("x", None)]
    pages = [
        (1, "http://a.example.co.uk/x", "<html lang='fr'><body>dans une que</body>"), (2, "http://b.example.co.uk/y", "<p>the thing"), (3, None, None), (4, "http://a.other.co.uk/", "das und"), (5, "https://u:p@sub.site.fr:80/de/", ""),
        (6, "http://sub.site.fr/", "<script>the the the</script>que"), (7, "http://10.0.0.1/", "ist nicht " * 3000), (8, "ftp://10.0.0.1", "<html lang=xx>"), (2, "http://b.example.co.uk/y", "<p>the thing"),
    ]
    got = L.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(known, "text string, lang string")).collect()
    langs = ["de", "en", "fr"]

    def buckets(text):
        b = text.encode()
        return [(int.from_bytes(b[i : i + L.GRAM], "big") * 0x9E3779B97F4A7C15 % 2**64) >> (64 - L.BITS) for i in range(len(b) - L.GRAM + 1)]

    counts = {g: Counter(x for t, own in known if own == g and t for x in buckets(t)) for g in langs}
    logp = lambda g, x: np.log((counts[g][x] + L.PSEUDO) / (sum(counts[g].values()) + L.PSEUDO * 2**L.BITS))
    hosts = {1: "a.example.co.uk", 2: "b.example.co.uk", 3: "", 4: "a.other.co.uk", 5: "sub.site.fr", 6: "sub.site.fr", 7: "10.0.0.1", 8: "10.0.0.1"}
    domains = {1: "example.co.uk", 2: "example.co.uk", 3: "", 4: "other.co.uk", 5: "site.fr", 6: "site.fr", 7: "10.0.0.1", 8: "10.0.0.1"}
    bodies = {1: "  dans une que ", 2: " the thing", 3: "", 4: "das und", 5: "", 6: " que", 7: "ist nicht " * 3000, 8: " "}
    declared, addressed = {1: "fr"}, {1: "en", 2: "en", 4: "en", 5: "de", 6: "fr"}
    says = lambda named, g, right: 0.0 if named is None else np.log(right if named == g else (1 - right) / 2)
    p = {}
    for page in hosts:
        score = np.array([sum(logp(g, x) for x in buckets(bodies[page])) / L.TEMPER + says(declared.get(page), g, L.DECLARED) + says(addressed.get(page), g, L.ADDRESSED) for g in langs])
        p[page] = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
    every = [r[0] for r in pages]
    root = (sum(p[q] for q in every) + 1) / (len(every) + len(langs))
    for r in got:
        page = r["page_id"]
        others = lambda by: sum((p[q] for q in every if by[q] == by[page]), np.zeros(3)) - p[page]
        smoothed = lambda n, above, weight: (n + weight * above) / (n.sum() + weight)
        prior = smoothed(others(hosts), smoothed(others(domains), root, L.DOMAIN_WEIGHT), L.HOST_WEIGHT)
        posterior = p[page] * prior / (p[page] * prior).sum()
        assert r["lang"] == langs[int(np.argmax(posterior))] and r["probability"] == pytest.approx(posterior.max(), rel=1e-6)
        assert (r["host"], r["declared"], r["addressed"]) == (hosts[page], declared.get(page), addressed.get(page))
    assert len(got) == len(pages)


def test_equal_posteriors_go_to_the_first_language(spark):
    known = spark.createDataFrame([("abc", "b"), ("abc", "a")], "text string, lang string")
    got = language_id.identify(spark.createDataFrame([(1, "x", "zzz")], "page_id long, url string, html string"), known).first()
    assert got["lang"] == "a" and got["probability"] == pytest.approx(0.5)


def test_languages_of_unseen_documents(spark):
    """Texts of known language, without markup or address, by a model of other texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL")
    pages = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("page_id"), F.lit("").alias("url"), F.col("text").alias("html"), F.col("lang").alias("true"))
    got = language_id.identify(pages, docs.where("doc_id % 2 = 1")).join(pages.select("page_id", "true"), "page_id")
    right = got.agg(F.avg((F.col("lang") == F.col("true")).cast("double"))).first()[0]
    assert right > 0.95


def test_languages_in_several_tables(spark, monkeypatch):
    """More languages than one table holds, and hot hosts apart from others, give the same posteriors."""
    rng = random.Random(6)
    known = spark.createDataFrame([(" ".join(f"{rng.choice('abcdefgh')}{i}x" for _ in range(20)), f"l{i:03d}") for i in range(70)], "text string, lang string")
    pages = spark.createDataFrame([(i, f"http://{'big' if i % 3 else f'h{i}'}.example.com/", f"<p>a{i % 70}x b{i % 70}x c{i % 70}x") for i in range(140)], "page_id long, url string, html string")
    found = lambda: sorted((r["page_id"], r["lang"], round(r["probability"], 9)) for r in language_id.identify(pages, known).collect())
    several = found()
    monkeypatch.setattr(language_id, "TABLE", 100)
    assert several == found() and sum(lang == f"l{i % 70:03d}" for i, lang, _ in several) > 120
    monkeypatch.setattr(language_id, "HOT", 10)
    monkeypatch.setattr(language_id, "is_small", lambda df: False)
    assert several == found()


def test_long_pages_of_tags_take_linear_time(spark):
    """Pages of 2 MB that open tags and never close them, or close one at the end, and a plain one: each in a second."""
    import time

    n = 2 << 20
    texts = ["<head " * (n // 6), "<script " * (n // 8), "<!--" * (n // 4), "<" * n, "<html " * (n // 6), "<style " * (n // 7) + "</style>", "word " * (n // 5), "<nav></nav> " * (n // 12), "<b " * (n // 3) + ">"]
    sizes = []
    for text in texts:
        began = time.process_time()
        sizes.append(len(language_id.visible(text)))
        assert time.process_time() - began < 1
    assert sizes[:5] == [len(t) for t in texts[:5]] and sizes[5] == 1 and sizes[6] == len(texts[6]) and sizes[7] == 2 * (n // 12) and sizes[8] == 1
    pages = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    assert language_id.identify(pages, spark.createDataFrame([("word", "en"), ("mot", "fr")], "text string, lang string")).count() == len(texts)


@pytest.mark.parametrize(
    "page,text",
    [
        ("<head>a</head>b<script>c</script>d<!-- e -->f<nav>g</nav>h", " b d f h"), ("<HEAD>a<b>c", " a c"), ("<script>a</script>b<script>c", " b c"), ("a < b", "a < b"), ("a <b> c <d", "a   c <d"), (None, ""), ("<style>x</STYLE>ÿ\n<p\n>z", " ÿ\n z"),
        ("<header>a</header>b", " a b"), ("<nav>İ</nav>é<!-- > --> x", " é  x"),
    ],
)
def test_visible_text(page, text):
    assert language_id.visible(page).decode() == text


def test_language_of_given_pages(spark):
    d = "/root/testdata/sf0.01"
    got = language_id.identify(spark.read.parquet(f"{d}/pages.parquet"), spark.read.parquet(f"{d}/documents.parquet")).collect()
    assert all(0 < r["probability"] <= 1 + 1e-9 for r in got) and sum(r["lang"] == r["declared"] for r in got if r["declared"]) > 0.9 * len(got)


# 6


def test_many_notices_in_one_text(spark):
    """Thousands of notices behind letters of two bytes: every span is the notice itself, in time linear in the text."""
    one = "Ünd füllt die Zeile. Released under the MIT License. "
    found = licenses.scan(spark.createDataFrame([(1, one * 4000), (2, None), (3, "")], "doc_id long, text string")).where("license = 'MIT'").collect()
    at = one.index("Released")
    assert sorted(r["start_char"] for r in found) == [at + len(one) * i for i in range(4000)]
    assert {r["end_char"] - r["start_char"] for r in found} == {len("Released under the MIT License")} and {r["coverage"] for r in found} == {1.0}


def test_licenses(spark, docs, rows, empty):
    names = licenses.TEMPLATES
    rng, texts = random.Random(5), []
    for i in range(40):
        name = rng.choice(sorted(names))
        notice = names[name].split()
        if i % 3 == 0 and len(notice) > 12:
            notice[5] = "another"
        texts.append((i, "Ünder it\n" * rng.randint(0, 5) + " ".join(notice).upper() + " " + " tail" * rng.randint(0, 9), name))
    got = defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect():
        got[r["doc_id"]].append(r)
    plain = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    for doc_id, text, name in texts:
        hit = [r for r in got[doc_id] if r["license"] == name]
        assert len(hit) == 1 and hit[0]["coverage"] >= 0.8
        if hit[0]["coverage"] == 1:
            assert plain(text[hit[0]["start_char"] : hit[0]["end_char"]]) == plain(names[name])
    assert licenses.scan(docs).count() == 0 and licenses.scan(empty).count() == 0


def common_words(a, b):
    """The most words that match in order."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


def naive_passages(template, text, coverage=0.8):
    """(matched, first, last) from left to right, by trying all spans of a text that has fingerprints everywhere."""
    limit, out, at = len(template) + licenses.slack_of(len(template)), [], 0
    match = lambda a, b: common_words(template, text[a : b + 1])
    while True:
        spans = [(b, -a) for b in range(at, len(text)) for a in range(max(at, b - limit + 1), b + 1) if match(a, b) >= coverage * len(template)]
        if not spans:
            return out
        first = -min(spans)[1]
        ends = range(first, min(first + limit, len(text)))
        last = max((b for b in ends if match(first, b) >= coverage * len(template)), key=lambda b: (2 * match(first, b) - (b - first), -b))
        out.append((match(first, last), first, last))
        at = last + 1


@pytest.mark.parametrize("name", ["reserved", "MIT", "CC-BY-NC-4.0", "Apache-2.0"])
def test_notices_that_stand_again_close_by(spark, name):
    notice = licenses.TEMPLATES[name]
    texts = [(k, "before it " * (k % 3) + f"{notice}\n" * k) for k in range(1, 8)] + [(9, f"{notice} and {notice} or else {notice}")]
    got = Counter(r["doc_id"] for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).where(f"license = '{name}' AND coverage = 1").collect())
    assert got == {k: 3 if k == 9 else k for k, _ in texts}


def test_whole_license_texts_with_edits(spark):
    rng, whole = random.Random(8), licenses.whole_texts()
    assert {"MIT-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "Apache-2.0-text", "GPL-3.0-text", "LGPL-2.1-text", "MPL-2.0-text", "ISC-text", "Unlicense-text"} <= set(whole)
    rows, most = [], {}
    for i, (name, text) in enumerate(whole.items()):
        own = text.split()
        edited = [x if rng.random() < 0.93 else "edited" for x in own]
        edited[len(own) // 2 : len(own) // 2] = ["inserted"] * min(12, len(own) // 10)
        cut = own[: int(0.7 * len(own))]
        rows += [(3 * i, f"Copyright Ünder\n\n{text}\n\nafter it"), (3 * i + 1, "x " * 40 + " ".join(edited)), (3 * i + 2, " ".join(cut))]
        most |= {3 * i: name, 3 * i + 1: name, 3 * i + 2: None}
    found = defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        found[r["doc_id"]].append(r)
    texts = dict(rows)
    for doc_id, name in most.items():
        own = [r for r in found[doc_id] if r["license"] == name]
        if doc_id % 3 == 2:
            name = list(whole)[doc_id // 3]
            assert not [r for r in found[doc_id] if r["license"] == name]
        else:
            assert len(own) == 1 and own[0]["matched_words"] == max(r["matched_words"] for r in found[doc_id])
            assert own[0]["coverage"] == 1 if doc_id % 3 == 0 else 0.8 <= own[0]["coverage"] < 1
        if doc_id % 3 == 0:
            span = texts[doc_id][own[0]["start_char"] : own[0]["end_char"]]
            assert re.findall(r"[a-z0-9]+", span.lower()) == re.findall(r"[a-z0-9]+", whole[name].lower())


@pytest.mark.parametrize("seed", range(4))
def test_passages_against_all_spans(seed):
    rng = random.Random(seed)
    for _ in range(25):
        template = [rng.randint(0, 5) for _ in range(rng.randint(3, 9))]
        text = []
        for _ in range(rng.randint(1, 4)):
            text += [x if rng.random() < 0.85 else rng.randint(6, 9) for x in template if rng.random() < 0.95] + [rng.randint(0, 9) for _ in range(rng.choice([0, 0, 1, 4]))]
        got = licenses.passages(licenses._Masks(np.array(template, np.uint64)), np.array(text, np.uint64), list(range(max(1, len(text) - 2))))
        assert list(got) == naive_passages(template, text)


def test_exact_notices_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect() if r["coverage"] == 1}
    for r in docs.collect():
        for name, notice in licenses.TEMPLATES.items():
            if notice in r["text"]:
                assert (r["doc_id"], name) in got


# 7


def test_packing(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, keep_ids=True).collect()
    pieces = {(r["doc_id"], r["piece"]): r for r in got}
    n = 0
    for r in rows:
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 2048):
            p, part = pieces[(r[0], at // 2048)], ids[at : at + 2048]
            assert (p["start"], p["length"], p["ids"], p["ids_crc32"]) == (at, len(part), part, zlib.crc32(np.array(part, "<u4").tobytes()))
            n += 1
    assert n == len(got)
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got], 2048)
    assert packing.pack_documents(empty, path).count() == 0


def check_sequences(placed, capacity):
    by = defaultdict(list)
    for sequence, offset, length in placed:
        by[sequence].append((offset, length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng, capacity = random.Random(seed), 100
    counts = Counter(min(capacity, 1 + int(rng.expovariate(1 / rng.choice([5, 30, 60])))) for _ in range(rng.choice([1, 40, 900])))
    used, placed = Counter(), []
    for length, a, b, sequence, offset, each in packing.plan(counts, capacity):
        assert used[length] == a
        used[length] = b
        placed += [(sequence + k // each, offset + k % each * length, length) for k in range(b - a)]
    assert used == counts
    n, total = check_sequences(placed, capacity), sum(k * v for k, v in counts.items())
    large = sum(v for k, v in counts.items() if 2 * k > capacity)
    assert n <= max(large, 1.25 * total / capacity + 1) + 1


# 8


def test_cuckoo_filter_against_a_dict():
    rng, index, live = random.Random(6), exact_dedup.CuckooFilter(2), {}
    keys = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)]
    for i in range(20_000):
        key = rng.choice(keys)
        if key in live:
            assert index.get(key) == live[key]
            if rng.random() < 0.6:
                assert index.delete(key)
                del live[key]
        else:
            assert index.get(key) is None and not index.delete(key)
            live[key] = i
            index.insert(key, i)
    assert dict(index.items()) == live and index.count == len(live) and index.resizes > 0


def test_exact_groups(spark, docs, rows, empty):
    got = exact_dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256((r[1] or "").translate(LOWER).encode()).hexdigest()].append(r[0])
    want = []
    for digest, ids in groups.items():
        last = max((i for i in ids if i is not None), default=None)
        want += [(i, last, len(ids), i == last, digest) for i in ids]
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == Counter(want)
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(w[0] or -1 for w in want if w[3])


def test_index_updates(spark, docs):
    digests = exact_dedup.with_digest(docs.where("doc_id IS NOT NULL"))
    index = exact_dedup.live_digests(digests, 100)
    half, rest = digests.where("doc_id % 2 = 0"), digests.where("doc_id % 2 = 1")
    grown = exact_dedup.update_index(exact_dedup.live_digests(half, 100), rest, half.limit(0))
    as_set = lambda x: {(bytes(r["digest"]), r["keep_id"], r["group_size"]) for r in x.collect()}
    assert as_set(grown) == as_set(index)
    emptied = exact_dedup.update_index(index, half.limit(0), index.selectExpr("digest", "keep_id AS doc_id"))
    assert emptied.count() == 0


# 9


def naive_fingerprint(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(fps, distance=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_groups(spark, docs, rows, empty):
    got = by_id(simhash.near_groups(docs))
    assert len(got) == len(rows)
    fps = [naive_fingerprint(r[1]) for r in rows]
    for r, fp, root in zip(rows, fps, naive_components(fps)):
        assert got[r[0]]["fingerprint"] == f"{fp:016x}" and got[r[0]]["component_id"] == rows[root][0]
    assert simhash.near_groups(empty).count() == 0
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in got.values()}


@pytest.mark.parametrize("bucket", [4000, 3])
def test_links_span_all_components(spark, bucket):
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for start in list(fps)[:4]:
        x = start
        for _ in range(25):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(x)
    fps = sorted(fps)
    signed = [simhash._signed(x) for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket=bucket)
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 3 for r in links.collect())
    got = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    want = naive_components(fps)
    groups = defaultdict(set)
    for x, root in zip(signed, want):
        groups[root].add(x)
    assert all({got.get(x, x) for x in g} == {min(g)} for g in groups.values())


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(7, 7), (None, 3), (5, 6)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


# 10


def naive_base(text):
    w, text = words(text), text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    times = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if times[tuple(w[i : i + 3])] > 1}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_rules(spark, docs, labels, rows, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = by_id(quality_rules.quality_rules(docs, labels))
    assert len(got) == len(rows)
    trusted = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    bucket = lambda g: int.from_bytes(g, "big") * 0x9E3779B97F4A7C15 % (1 << 64) >> (64 - quality_rules.BITS)
    raw, target = np.zeros(1 << quality_rules.BITS), np.zeros(1 << quality_rules.BITS)
    for r in rows:
        b = (r[1] or "").encode()
        for i in range(len(b) - 3):
            raw[bucket(b[i : i + 4])] += 1
            target[bucket(b[i : i + 4])] += r[0] in trusted and r[0] is not None
    ratio = np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    for r in rows:
        base, g = naive_base(r[1]), got[r[0]]
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        b = (r[1] or "").encode()
        llr = np.mean([ratio[bucket(b[i : i + 4])] for i in range(len(b) - 3)]) if len(b) > 3 else 0.0
        assert tuple(g[n] for n in names) == base and g["base_failed"] == failed and g["llr"] == pytest.approx(llr, abs=1e-5)
        assert g["kept"] == (not failed and g["llr"] >= quality_rules.THRESHOLD)
    assert quality_rules.quality_rules(empty, labels).count() == 0
    again = by_id(quality_rules.quality_rules(docs.repartition(1), labels))
    assert all(again[k]["llr"] == v["llr"] for k, v in got.items())


# shared


def test_shared_folder_and_release(spark):
    from types import SimpleNamespace

    from lumenfold.llm import common

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None, set=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_dir(cluster)
    before = common.written(spark)
    df = common.materialize(spark.range(5), "five")
    (path,) = set(common.written(spark)) - set(before)
    assert df.count() == 5 and os.path.isdir(path.removeprefix("file://"))
    common.release(spark, [path])
    assert not os.path.exists(path.removeprefix("file://")) and common.written(spark) == before


def test_broadcasts_are_bounded_by_bytes(spark):
    from lumenfold.llm import common

    df = spark.createDataFrame([(i, "x" * 1000) for i in range(100)], "id long, text string")
    assert common.is_small(df, 200_000) and not common.is_small(df, 100_000)
    with pytest.raises(TypeError):
        common.is_small(spark.createDataFrame([([1],)], "a array<int>"))


def test_rows_keep_their_place(spark, tmp_path):
    from lumenfold.llm import common

    spark.range(1000).repartition(4).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    named, row = common.with_row(table)
    first = {tuple(r) for r in named.select("id", f"{row}.file", f"{row}.at").collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert {tuple(r) for r in named.select("id", f"{row}.file", f"{row}.at").collect()} == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({x[1:] for x in first}) == 1000
    twice, row = common.with_row(table.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("_row")))
    assert twice.select(f"`{row}`").distinct().count() == 2000 and row not in ("_row",)


def test_steps_and_texts():
    import pyarrow as pa

    column = pa.array(["zzz", "ab", None, "", "çd", "x" * 50], pa.string()).slice(1)
    data, offsets = common.texts_of(column)
    assert [bytes(data[a:b]).decode() for a, b in zip(offsets, offsets[1:])] == ["ab", "", "", "çd", "x" * 50]
    assert list(common.steps(offsets, 4)) == [(0, 3), (3, 4), (4, 5)]
    assert list(common.steps(np.zeros(1, np.int64))) == []
