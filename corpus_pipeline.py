"""From raw documents to packed sequences, in five stages of lumenfold.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Stages 1 to 4
return the columns of documents; the last returns a row for each piece of a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import exact_dedup, mixing, packing, quality_classifier, simhash
from lumenfold.llm.common import new_path, read_table, release, tune, written
from lumenfold.llm.registry import word_tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on this input, rejects go; null and empty texts are scored like any.

    Rows that repeat stay or go together; a text of any length is scored whole; an empty table stays
    empty; columns may have any names.
    """
    tune(spark)
    return quality_classifier.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, A-Z in lower case, the one with the largest doc_id stays; null texts count as empty.

    Of several with that doc_id, or of rows without any, the first in the files stays. Texts of any
    length are compared whole; an empty table stays empty; columns may have any names.
    """
    tune(spark)
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, by five-word shingles of a similarity of 0.8 or more, the row with the smallest doc_id stays.

    Candidates are found by SimHash keys, what these miss by shared rare shingles (see
    `simhash.keep_one_of_each`), and verified on whole texts: no such pair is lost.
    Texts without words, null included, are one group. Of several rows with that doc_id, or of rows
    without any, the first in the files stays. An empty table stays empty; columns may have any names.
    """
    tune(spark)
    return simhash.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: 0 to 2 times; a document without words, null included, once.

    Rows that repeat, or have a null doc_id, are rounded each on its own; null is a source of its own.
    Whole texts are counted; an empty table stays empty; columns may have any names.
    """
    tune(spark)
    return mixing.repeat_by_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row, its repeats included, in sequences of at most 2048 tokens; row tells repeats apart.

    ids are the tokens themselves. A null or empty text is one piece, the separator; a null doc_id
    stays null; longer texts are cut; an empty table gives no rows; other columns are not read.
    """
    tune(spark)
    return packing.pack_documents(docs, word_tokenizer(), keep_ids=True)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mixed), ("best-fit packing", packed)]

#: Hashed models, fingerprints and tokenizers are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read by the next.

    What a stage wrote for itself is deleted when its result is written, and that result when the
    next one is; the last stage's files stay until `lumenfold.llm.common.release`.
    """
    docs, last = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        before = written(spark)
        found = stage(spark, docs, sf_dir)
        own = [x for x in written(spark) if x not in before]
        path = new_path(spark, name.replace(" ", "-"))
        found.write.parquet(path)
        del found
        release(spark, own + last)
        docs, last = spark.read.parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
