import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, digest string, first int"
WORDS = "the of and thing wher onde ration stable ingly théé über la que dans ist nicht und eine para con".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "er", "ing", ""]) for _ in range(n))


def corpus():
    """Documents with copies, near copies, shared passages, junk, nulls, empty and long texts, and columns with clashing names."""
    rng = random.Random(3)
    passage, base = prose(rng, 80), prose(rng, 300)
    texts = [prose(rng, rng.choice([1, 2, 3, 20, 49, 50, 51, 120, 400])) for _ in range(60)]
    texts += [f"{prose(rng, 30)}\n{passage} {prose(rng, 40)}" for _ in range(8)]
    texts += [base, base, base.upper(), base + " x", base.replace(" of ", " off ", 1), base]
    texts += [" ".join(w + rng.choice(["***", "&&&", "###"]) for w in prose(rng, 150).split()) for _ in range(12)]
    texts += ["The " * 120, "", None, "   \t\n ", None, "one", "a b c d\x1ce", "\x0b\x0c", prose(rng, 21_000), "x" * 50_000, "ÄÖ ÉÈ", "äÖ ÉÈ"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "b", None, "é"]), None if t is None or i % 7 == 0 else len(t), "r", "k", "d", 1) for i, t in enumerate(texts)]
    return rows + [(None, "no number here " * 20, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    junk = lambda t: t is None or "***" in t or "###" in t or t.startswith("The The")
    return spark.createDataFrame([(r[0], None if r[0] == 1 else int(not junk(r[1])), 0) for r in rows if r[0] is not None and r[0] % 3 != 1 or r[0] is None], "doc_id long, quality int, toxic int")
