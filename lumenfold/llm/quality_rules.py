"""Quality rules: counts of structure, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are estimated from all documents: one from the trusted
target (documents that `labels` marks as of quality 1), one from the whole raw corpus. A document's
verdict is its log-likelihood ratio per n-gram against a fixed threshold. Ratios are rounded to
integers of 2**-20 before they are summed, so a score never depends on how rows were batched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side, steps, texts_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: log2 of the number of hash buckets; bytes in an n-gram; pseudo-count of a bucket.
BITS, GRAM, PSEUDO = 14, 4, 1.0
#: Least log-likelihood ratio per n-gram, in nats, of a document that is kept.
THRESHOLD = -0.2
SCALE = 1 << 20


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text; null has no words."""
    text = text or ""
    words = text.encode().split()  # at the six ASCII white-space bytes only
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        covered = 0  # words before this one are counted
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated


def gram_buckets(data: np.ndarray, offsets: np.ndarray, n: int = GRAM, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, first n-gram of each text and one more entry); no n-gram crosses texts."""
    if len(data) < n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = np.zeros(len(data) - n + 1, np.uint64)
    for i in range(n):
        code = (code << np.uint64(8)) | data[i : len(data) - n + 1 + i]
    bucket = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    sizes = np.maximum(np.diff(offsets) - n + 1, 0)
    first = np.concatenate(([0], np.cumsum(sizes)))
    within = np.arange(first[-1]) - np.repeat(first[:-1], sizes)
    return bucket[np.repeat(offsets[:-1], sizes) + within], first


def gram_counts(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(bucket, raw, target): n-grams of all documents, and of those labelled with quality 1.

    Each task adds up its own rows first, so a shuffle gets a row for each bucket and task at most.
    """
    trusted = labels.groupBy(F.col("doc_id").cast("long").alias("_trusted")).agg(F.max("quality").alias("_quality")).where("_quality = 1 AND _trusted IS NOT NULL").select("_trusted")
    marked = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text")).join(small_side(materialize(trusted, "trusted")), F.col("_id") == F.col("_trusted"), "left").select("_text", F.col("_trusted").isNotNull().alias("_in"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            data, offsets = texts_of(batch.column(0))
            inside = np.asarray(batch.column(1))
            for a, b in steps(offsets):
                bucket, first = gram_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                raw += np.bincount(bucket, minlength=1 << BITS)
                target += np.bincount(bucket[np.repeat(inside[a:b], np.diff(first))], minlength=1 << BITS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    return marked.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratios(counts: DataFrame) -> np.ndarray:
    """The log-likelihood ratio of every bucket, in units of 1 / SCALE; 2**BITS rows come to the driver at most.

    Without a single trusted n-gram there is nothing to compare with, and every ratio is 0.
    """
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.any():
        return np.zeros(1 << BITS, np.int64)
    share = [(x + PSEUDO) / (x.sum() + PSEUDO * len(x)) for x in (target, raw)]
    return np.rint(np.log(share[0] / share[1]) * SCALE).astype(np.int64)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    base_failed: under 50 words, or over half of the words in three-word windows that the text holds
    twice or more. kept: not base_failed, and llr (nats per n-gram) is at least the threshold.
    Null and empty texts have no words and fail; a text without n-grams has llr 0. Labels of a
    repeated doc_id count as quality 1 if any of them is; null labels count as none.
    """
    ratio = ratios(gram_counts(docs, labels, text, id_col))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            llr = []
            for a, b in steps(offsets):
                bucket, first = gram_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total = np.concatenate(([0], np.cumsum(ratio[bucket])))[first]
                llr.append(np.diff(total) / SCALE / np.maximum(np.diff(first), 1))
            llr = np.concatenate(llr) if llr else np.zeros(0)
            base = np.array([base_counts(x) for x in batch.column(1).to_pylist()], np.int64).reshape(-1, 5)
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(base[:, i]) for i in range(5)), pa.array(failed), pa.array(~failed & (llr >= threshold)), pa.array(llr)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double")
