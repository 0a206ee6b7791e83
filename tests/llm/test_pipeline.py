"""The stages of corpus_pipeline against what their operators say, each on its own input."""

from collections import Counter

import pytest


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, d).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages_keep_the_columns(spark, stages):
    first = stages[0][0].columns
    assert all(after.columns == first for _, after in stages[:-1])
    assert all(after.count() <= before.count() for before, after in stages[:3])


def test_decisions_take_effect(spark, stages):
    from lumenfold.llm import exact_dedup, mixing

    before, after = stages[1]
    assert exact_dedup.exact_groups(after).where("NOT kept").isEmpty()
    assert after.count() == exact_dedup.exact_groups(before).where("kept").count()
    before, after = stages[2]
    assert {r["doc_id"] for r in after.collect()} == first_of_each(before.collect())
    before, after = stages[3]
    assert Counter(r["doc_id"] for r in after.collect()) == {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect() if r["copies"]}
    before, after = stages[4]
    assert Counter(r["doc_id"] for r in after.where("piece = 0").collect()) == Counter(r["doc_id"] for r in before.collect())


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def first_of_each(rows, least=0.8):
    """The smallest doc_id of each component of pairs whose sets of five-word shingles are that similar, all pairs compared."""
    sets, group = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len(a & b) >= least * len(a | b):
                group[root(i)] = root(j)
    found = {}
    for i, r in enumerate(rows):
        found[root(i)] = min(found.get(root(i), r["doc_id"]), r["doc_id"])
    return set(found.values())


def test_near_copies_are_caught_and_others_stay(spark):
    """Pairs at 0.8 to 0.95, a large group of near copies, and pairs at 0.6 to 0.79 that must stay."""
    import random

    from corpus_pipeline import near

    rng, rows, caught, free = random.Random(8), [], [], []
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    common = [word() for _ in range(60)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n)]

    def edited(words, least, most):
        while True:
            new = list(words)
            for at in rng.sample(range(len(new) - len(new) // 14), rng.randint(1, max(1, len(new) // 14))):
                new[at : at + 1] = rng.choice([[word()], [], [new[at], word()]])
            a, b = shingles(" ".join(words)), shingles(" ".join(new))
            if least <= len(a & b) / len(a | b) < most:
                return new

    for i in range(240):
        first = prose(rng.randint(60, 500))
        low = i % 4 == 3
        rows += [(2 * i, " ".join(first)), (2 * i + 1, " ".join(edited(first, *((0.6, 0.78) if low else (0.8, 0.95)))))]
        (free if low else caught).append(2 * i + 1)
    base = prose(300)
    rows += [(1000 + i, " ".join(edited(base, 0.9, 1.0))) for i in range(60)]
    left = {r["doc_id"] for r in near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert sum(i not in left for i in caught) >= 0.9 * len(caught)
    assert set(free) <= left and {2 * i for i in range(240)} <= left
    assert 1000 in left and sum(1000 <= i for i in left) <= 3


def short_copies():
    """Short texts in pairs and families whose shingles are near the threshold on both sides, and texts that share long passages."""
    import random

    rng, rows = random.Random(5), []
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    passage = [word() for _ in range(60)]
    for i in range(300):
        words = [word() for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(1, 3)):
            rows.append(" ".join(words))
            words = words[rng.choice([0, 0, 1, 2, 3]) :] + [word() for _ in range(rng.randint(0, 4))]
    rows += [" ".join(passage + [word() for _ in range(rng.randint(5, 25))]) for _ in range(80)]
    rows += ["", " ", "\t"] + ["\n".join(x.split()) for x in rows[:40]]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("distance, block", [(40, 1000), (-1, 7)])
def test_no_near_pair_is_lost(spark, monkeypatch, distance, block):
    """Exactly the components of brute force stay, whatever the SimHash keys miss."""
    from corpus_pipeline import near
    from lumenfold.llm import simhash

    monkeypatch.setattr(simhash, "WIDE_DISTANCE", distance)
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    docs = spark.createDataFrame(short_copies(), "doc_id long, text string")
    assert {r["doc_id"] for r in near(spark, docs, "").collect()} == first_of_each(docs.collect())


def test_pairs_across_components_meet_exactly(spark, monkeypatch):
    """Without any star every near pair is a candidate, also where a shingle has many rows and is dealt to blocks."""
    from itertools import combinations

    from lumenfold.llm import common, simhash

    monkeypatch.setattr(simhash, "BLOCK", 7)
    docs = short_copies()
    named, row = common.with_row(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = common.materialize(simhash.wide_fingerprints(named, row).withColumn("id", simhash.F.col("doc_id")), "fingerprints")
    none = spark.createDataFrame([], "node long, component long")
    across = common.materialize(simhash.pairs_across(simhash.shared_shingles(rows, none), 0.8), "candidates")
    sets = {i: shingles(text) for i, text in docs}
    want = {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want and want <= {tuple(r) for r in across.collect()}
    assert {tuple(r) for r in simhash.verified(across, named, row, rows).collect()} == want


def family():
    """Short copies, and a large family of texts that are alike but for a few just under the similarity, so that they share most shingles."""
    import random

    rng, rows = random.Random(6), short_copies()
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(300)]
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(300), 8):
            words[at] = word()
        rows.append((5000 + i, " ".join(words)))
        if i < 3:
            rows.append((6000 + i, " ".join([*words[3:], word()])))
    return rows


def test_a_family_under_the_threshold_gives_few_candidates(spark, monkeypatch):
    """Where many rows share a shingle, pairs that can't be near make no rows, and no near pair is lost, in one block or more."""
    from itertools import combinations

    from lumenfold.llm import common, simhash

    docs = family()
    named, row = common.with_row(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = common.materialize(simhash.wide_fingerprints(named, row).withColumn("id", simhash.F.col("doc_id")), "fingerprints")
    shared = simhash.shared_shingles(rows, spark.createDataFrame([], "node long, component long"))
    sets = {i: shingles(text) for i, text in docs}
    want = {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    want = {(min(x), max(x)) for x in want}
    of_family = {x for x in want if x[0] >= 5000}
    assert len(of_family) >= 3
    for few, block in ((simhash.FEW, simhash.BLOCK), (3, 7)):
        monkeypatch.setattr(simhash, "FEW", few)
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {tuple(r) for r in simhash.pairs_across(shared, 0.8, rows).collect()}
        assert want <= got and all(a < b for a, b in got)
        assert sum(a >= 5000 for a, _ in got) <= 200 + 2 * len(of_family)


def test_clean_documents_stay(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1")
    before, after = (x.join(labels, "doc_id").count() for x in stages[0])
    assert after >= 0.98 * before


def test_run(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns) and got.count() > 100


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_stages_on_odd_and_empty_tables(spark, docs, empty, kind):
    """Nulls in every column, empty and long texts, repeated rows and clashing names; and no rows at all."""
    import corpus_pipeline

    given = docs.union(docs.where("doc_id IN (3, 4)")) if kind == "odd" else empty
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, given, "/root/testdata/sf0.001")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == given.columns
        assert (got.count() > 0) == (kind == "odd")


def test_columns_that_clash_with_helpers(spark, docs):
    """Columns named like those that the operators add inside keep their values, in every stage."""
    from pyspark.sql import functions as F

    import corpus_pipeline

    names = ["_gone", "_id", "_copy", "_copies", "_scored_text", "_scored_chars", "_row", "_file", "_at", "_rows_copies", "_metadata", "file", "at", "digest", "fp", "n", "_fp", "_first", "copied", "kept", "size", "source_size", "salt"]
    given = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names if n not in docs.columns])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, given, "/root/testdata/sf0.001")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == given.columns and got.select("_gone", "_row", "_metadata").distinct().collect() == [("own _gone", "own _row", "own _metadata")]
        assert got.count() > 0


def test_repeated_rows_are_decided_one_by_one(spark):
    """Whole repeats, null ids and near copies under one id: exactly one row of each group stays, and the mix weighs each row."""
    from corpus_pipeline import exact, mixed, near

    words = " ".join(f"w{i}" for i in range(300))
    rows = [(1, "a b c", "s")] * 40 + [(None, "a B c", "s")] * 20 + [(None, "p q r", "s")] * 3 + [(2, words, "s"), (2, words + " x", "s"), (None, words + " y", "s")]
    given = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(map(tuple, exact(spark, given, "").collect()), key=str) == sorted([(1, "a b c", "s"), (None, "p q r", "s"), *rows[-3:]], key=str)
    left = near(spark, given, "").collect()
    assert Counter(r["text"].split()[0] for r in left) == {"a": 1, "p": 1, "w0": 1} and {r["doc_id"] for r in left} == {1, None, 2}
    taken = mixed(spark, given, "").collect()
    total = sum(len(t.split()) for _, t, _ in rows)
    assert abs(sum(len(r["text"].split()) for r in taken) - 1.5 * total) <= 151
    assert max(Counter(r["text"] for r in taken)["a b c"], 1) <= 80


def test_a_run_leaves_only_the_last_stage(spark):
    import corpus_pipeline
    from lumenfold.llm.common import release, written

    release(spark)
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 100 and {p.rsplit("/", 1)[1].split("-")[0] for p in written(spark)} == {"pieces", "buckets", "mixing"}
    assert got.selectExpr("bool_and(size(ids) = length)").first()[0]
    release(spark)


def test_near_dedup_leaves_only_what_its_result_reads(spark):
    """Its own tables go while it runs: later stages find their disk free, and the result still reads what it needs."""
    from corpus_pipeline import near
    from lumenfold.llm.common import written

    before = written(spark)
    docs = spark.createDataFrame(short_copies(), "doc_id long, text string")
    left = near(spark, docs, "")
    assert [p.rsplit("/", 1)[1].split("-")[0] for p in written(spark) if p not in before] == ["rows", "gone"]
    assert {r["doc_id"] for r in left.collect()} == first_of_each(docs.collect())
