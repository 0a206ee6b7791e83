"""How the sources of a language diverge: count vectors of documents, sums by group, a divergence of smoothed shares.

CountVectorizer, with minDF and the greatest vocabSize, learns the terms of all languages at once, as
a term's name begins with its language, and turns every document into an exact sparse vector of
counts. Its vocabulary goes through the driver; so terms are dealt to buckets of about VOCABULARY
kept terms, and each bucket has a vectoriser of its own. The vectors are written and
read back as plain indices and values, which are summed by group. All arithmetic is on integers.

Pairs of sources are compared in blocks: a task has the terms of one bucket that occur in two blocks
of sources, and returns a partial sum for each of their pairs. Terms that neither block has add the
same to every pair of absent shares, so they are only counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, small_side, steps, texts_of
from .words import LOWER, Words, find_words, hash_words, mix

#: Whether a byte is no part of a term: terms are runs of ASCII letters and of characters beyond ASCII.
BETWEEN = np.array([x < 0x80 and not chr(x).isalpha() for x in range(256)])
#: Kept terms in a vectoriser's vocabulary, about.
VOCABULARY = 1 << 19
#: One in so many terms is counted to size the buckets.
CLASSES = 64
#: Sources in a block, about, and counts in a task's bucket of terms, about.
SOURCES, COUNTS = 128, 1 << 14
#: Shares are in units of 1 / UNIT. Shares are worked out in three steps of THOUSAND, so totals may reach 2**63 / 1000.
UNIT, THOUSAND = 1_000_000_000, 1000
_NUL = "\x00"


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)), exactly, by long division in thousands."""
    whole, rest, found = total + 2 * terms, n + 2, F.lit(0).cast("long")
    for _ in range(3):
        found = found * THOUSAND + _div(rest * THOUSAND, whole)
        rest = (rest * THOUSAND) % whole
    return found + 1


def _div(a: Column, b: Column) -> Column:
    """The integer quotient of two whole numbers that aren't negative."""
    return F.call_function("div", a, b)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); shares are at most about 10**9, so squares fit."""
    return _div((p - q) * (p - q), p + q)


def _words_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, Words]]:
    """(first text, end, lower-case bytes, terms) of some texts of a batch at a time."""
    data, offsets = texts_of(batch.column("text"))
    for a, b in steps(offsets):
        lower = LOWER[data[offsets[a] : offsets[b]]]
        yield a, b, lower, find_words(lower, offsets[a : b + 1] - offsets[a], BETWEEN)


def kept_terms(docs: DataFrame, min_docs: int) -> int:
    """About how many terms all languages keep: counted exactly for one hash class of terms in CLASSES. It sizes buckets and decides nothing."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salt = np.array([xxhash.xxh64_intdigest(x, 1) for x in batch.column("lang").to_pylist()], np.uint64)
            for a, b, lower, words in _words_of(batch):
                # a class is told by a term's first bytes and its size, so that others need no hash
                sizes = words.ends - words.starts
                head = sum(lower[np.minimum(words.starts + i, words.ends - 1)].astype(np.int64) * m for i, m in enumerate((7, 31, 101)))
                inside = np.flatnonzero((head + 13 * sizes) % CLASSES == 0)
                some_words = words._replace(starts=words.starts[inside], ends=words.ends[inside], text=words.text[inside])
                names = mix(hash_words(lower, some_words) ^ salt[a:b][some_words.text])
                found = np.unique(np.stack([some_words.text.astype(np.uint64), names]), axis=1)[1]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["term"])

    return CLASSES * docs.select("lang", "text").mapInArrow(some, "term long").groupBy("term").count().where(F.col("count") >= min_docs).count()


def term_lists(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, lang, source, terms) of each document for each bucket that has any of its terms: every occurrence, as its language, NUL and the term."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = [x.encode() + _NUL.encode() for x in batch.column("lang").to_pylist()]
            for a, b, lower, words in _words_of(batch):
                own = np.zeros(len(words.starts), np.int64) if buckets == 1 else (hash_words(lower, words) % np.uint64(buckets)).astype(np.int64)
                group = words.text * buckets + own
                order = np.argsort(group, kind="stable")
                # each term's bytes behind those of its language
                names = list(dict.fromkeys(langs[a:b]))
                at = np.cumsum([len(lower)] + [len(x) for x in names])
                place = {x: i for i, x in enumerate(names)}
                lang = np.array([place[x] for x in langs[a:b]], np.int64)[words.text[order]]
                begins, sizes = (np.column_stack(x).reshape(-1) for x in ((at[lang], words.starts[order]), (at[lang + 1] - at[lang], words.ends[order] - words.starts[order])))
                ends = np.cumsum(sizes)
                whole = np.concatenate((lower, np.frombuffer(b"".join(names), np.uint8)))
                data = whole[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
                offsets = np.concatenate(([0], ends[1::2])).astype(np.int32)
                terms = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
                there, first = np.unique(group[order], return_index=True)
                spans = pa.array(np.append(first, len(order)), pa.int32())
                text = pa.array(a + there // buckets)
                yield pa.RecordBatch.from_arrays([pa.array(there % buckets, pa.int32()), batch.column("lang").take(text), batch.column("source").take(text), pa.ListArray.from_arrays(spans, terms)], names=["bucket", "lang", "source", "terms"])

    return docs.mapInArrow(lists, "bucket int, lang string, source string, terms array<string>")


def document_vectors(docs: DataFrame, min_docs: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """For each bucket of terms (vocabulary: index, lang, term; vectors: lang, source, indices, values of every document with terms), written to the shared folder."""
    spark = docs.sparkSession
    buckets = max(1, math.ceil(kept_terms(docs, min_docs) / VOCABULARY))
    path = new_path(spark, "terms")
    term_lists(docs, buckets).write.partitionBy("bucket").parquet(path)
    for (b,) in sorted(spark.read.schema("lang string, bucket int").parquet(path).select("bucket").distinct().collect()):
        own = spark.read.schema("lang string, source string, terms array<string>").parquet(f"{path}/bucket={b}")
        # documents that have a term count, not how often they have it, so fitting needs each term of a document once
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=(1 << 31) - 1).fit(own.select(F.array_distinct("terms").alias("terms")))
        # the model's own files hold the vocabulary as one row, which so never comes to Python
        saved = new_path(spark, "vocabulary")
        model.save(saved)
        name = F.substring_index("name", _NUL, -1)
        vocabulary = spark.read.schema("vocabulary array<string>").parquet(f"{saved}/data").select(F.posexplode("vocabulary").alias("index", "name"))
        vocabulary = vocabulary.select("index", F.substring("name", F.lit(1), F.length("name") - F.length(name) - 1).alias("lang"), name.alias("term"))
        to = new_path(spark, "document-vectors")
        model.transform(own).select("lang", "source", "vector").write.parquet(to)
        vectors = spark.read.schema("lang string, source string, vector struct<type: tinyint, size: int, indices: array<int>, values: array<double>>").parquet(to)
        yield materialize(vocabulary, "vocabulary-terms"), vectors.select("lang", "source", "vector.indices", "vector.values")


def term_counts(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, index, n): the sums of the vectors of each group, for the terms that it has."""
    named = vectors.join(small_side(groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "group")), (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s")))
    one = named.select("group", "values", F.posexplode("indices").alias("at", "index")).select("group", "index", F.col("values")[F.col("at")].alias("n"))
    return one.groupBy("group", "index").agg(F.sum("n").cast("long").alias("n"))  # doubles are exact to 2**53


def _pair_sums(shares: DataFrame, rows: int, groups: DataFrame) -> DataFrame:
    """(a, b, sum, terms) for each pair of groups of a language, in one row or more: sums over terms, and how many terms that were.

    shares: language, group, bucket, index, p of the terms that a group has, so many rows; groups: language, group, absent, the share of one that it hasn't.
    """
    most = groups.groupBy("language").count().agg(F.max("count")).first()[0] or 1
    blocks, buckets = math.ceil(most / SOURCES), max(1, math.ceil(rows / COUNTS))

    def dealt(df: DataFrame) -> DataFrame:
        own = df.withColumn("_own", F.pmod(F.xxhash64("group"), F.lit(blocks))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return own.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))

    left = dealt(shares.select("language", "group", "p", F.xxhash64("bucket", "index").alias("term")).withColumn("_t", F.pmod("term", F.lit(buckets)).cast("int")))
    right = dealt(groups.select(F.col("language").alias("_language"), "group", "absent").withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))))

    def compare(some: pa.Table, of: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(of.column("group")))
        group, own = (np.asarray(of.column(x))[order] for x in ("group", "_own"))
        absent = np.asarray(of.column("absent").fill_null(1))[order]
        terms, at = np.unique(np.asarray(some.column("term")), return_inverse=True)
        who, p = np.searchsorted(group, np.asarray(some.column("group"))), np.asarray(some.column("p"))
        sums, width = np.zeros((len(group),) * 2, np.int64), max(1, (1 << 19) // max(len(group), 1))
        for first in range(0, len(terms), width):
            inside = (at >= first) & (at < first + width)
            dense = np.repeat(absent[:, None], min(width, len(terms) - first), 1)
            dense[who[inside], at[inside] - first] = p[inside]
            for a in range(len(group) - 1):
                less, both = dense[a] - dense[a + 1 :], dense[a] + dense[a + 1 :]
                sums[a, a + 1 :] += (less * less // both).sum(1)
        # within one block all pairs, between two those across
        a, b = np.triu_indices(len(group), 1)
        if len(group) and of.column("_i")[0] != of.column("_j")[0]:
            across = own[a] != own[b]
            a, b = a[across], b[across]
        return pa.table({"a": group[a], "b": group[b], "sum": sums[a, b], "terms": np.full(len(a), len(terms), np.int64)})

    keys = ["_i", "_j", "_t"]
    return left.groupBy("language", *keys).cogroup(right.groupBy("_language", *keys)).applyInArrow(compare, "a long, b long, sum long, terms long")


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and the terms it is given to.

    A language keeps the terms that at least min_docs of its documents have. A group's share of a
    kept term is p = 1 + floor(10**9 * (n + 2) / (N + 2 * V)), with n its occurrences there, N those
    of all kept terms and V their number. Part `pair`: for each other source of the language the sum
    over all kept terms of floor((p - q)**2 / (p + q)), 0 where none are kept. Part `term`: the `top`
    terms that the source uses more than the language as a whole does. Ranks start at 1 for each
    group and part, by value, the largest first, ties by the UTF-8 bytes of the item.

    Null language, source and text count as empty; a group without terms has its pairs too. Texts of
    any length are read whole; rows that repeat are documents like any other; an empty table gives
    no rows; other columns are not read.
    """
    spark, named = docs.sparkSession, docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    groups = materialize(named.select("lang", "source").distinct().withColumn("group", F.monotonically_increasing_id()), "groups")
    counts, names = spark.createDataFrame([], "bucket int, group long, index int, n long"), spark.createDataFrame([], "bucket int, index int, lang string, term string")
    for i, (vocabulary, vectors) in enumerate(document_vectors(named, min_docs)):
        own = lambda df, i=i: df.withColumn("bucket", F.lit(i))
        names = names.unionByName(own(vocabulary))
        counts = counts.unionByName(own(materialize(term_counts(vectors, groups), "term-counts")))

    # what each group and each language has
    totals = names.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("terms"))
    own = counts.groupBy(F.col("group").alias("_group")).agg(F.sum("n").alias("total"))
    groups = groups.join(totals, F.col("lang") == F.col("_lang"), "left").join(own, F.col("group") == F.col("_group"), "left")
    groups = groups.select("lang", "source", "group", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total"))
    whole = groups.groupBy(F.col("lang").alias("_lang")).agg(F.sum("total").alias("lang_total"), F.min("group").alias("language"))
    groups = groups.join(whole, F.col("lang") == F.col("_lang")).drop("_lang")
    groups = materialize(groups.withColumn("absent", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))), "groups")

    of_group = small_side(groups.select(F.col("group").alias("_group"), "language", "terms", "total", "lang_total"))
    shares = counts.join(of_group, F.col("group") == F.col("_group")).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    of_term = counts.groupBy(F.col("bucket").alias("_bucket"), F.col("index").alias("_index")).agg(F.sum("n").alias("lang_n"))
    used = shares.join(of_term, (F.col("bucket") == F.col("_bucket")) & (F.col("index") == F.col("_index"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
    given = used.where("p > q").select("group", "bucket", "index", apart(F.col("p"), F.col("q")).alias("value"))
    # the highest values with all that tie with the last, then by name
    given = given.withColumn("_place", F.rank().over(Window.partitionBy("group").orderBy(F.desc("value")))).where(F.col("_place") <= top)
    named_terms = names.select(F.col("bucket").alias("_bucket"), F.col("index").alias("_index"), F.col("term").alias("item"))
    given = given.join(named_terms, (F.col("bucket") == F.col("_bucket")) & (F.col("index") == F.col("_index")))
    known = small_side(groups.select(F.col("group").alias("_group"), "lang", "source"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    given = given.join(known, F.col("group") == F.col("_group")).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    given = given.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    sums = _pair_sums(shares, counts.count(), groups).groupBy("a", "b").agg(F.sum("sum").alias("sum"), F.sum("terms").alias("seen"))
    for side in ("a", "b"):
        known = groups.select(F.col("group").alias("_group"), F.col("source").alias(f"source_{side}"), F.col("absent").alias(f"absent_{side}"), *[F.col(x) for x in ("lang", "terms") if side == "a"])
        sums = sums.join(small_side(known), F.col(side) == F.col("_group")).drop("_group")
    unseen = F.coalesce((F.col("terms") - F.col("seen")) * apart(F.col("absent_a"), F.col("absent_b")), F.lit(0))
    sums = sums.withColumn("value", F.when(F.col("terms") > 0, F.col("sum") + unseen).otherwise(F.lit(0)))
    both = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    pairs = sums.select("lang", both.alias("_p"), "value").select("lang", "_p.source", F.lit("pair").alias("part"), "_p.item", "value")
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(given)
