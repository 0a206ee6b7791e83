"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Pairwise interactions have rank FACTORS and are scored in linear time: their sum is half of the
square of the weighted factor sum minus the sum of the squared weighted factors. The model is fitted
by Adam on at most SAMPLE labelled documents outside the held-out fold; every document is scored
inside the scan, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, texts_of, unused
from .words import find_words, hash_words, mix

#: Hash buckets of words; factors of an interaction; labelled documents that are fitted on, at most.
BUCKETS, FACTORS, SAMPLE = 2048, 8, 6000
EPOCHS, BATCH, RATE, DECAY = 30, 128, 0.01, 1e-4
#: A document is predicted to be of quality 1 from this score on.
THRESHOLD = 0.3
STATISTICS = ("words", "word bytes", "upper case", "digits", "symbols", "bars", "exclamations", "beyond ASCII", "line ends", "distinct words", "commonest word", "words ending in a mark", "words of upper case", "full stops", "n_chars", "n_chars missing")
_CLASSES = {"upper case": range(0x41, 0x5B), "digits": range(0x30, 0x3A), "symbols": b"#*$%&<>", "bars": b"|", "exclamations": b"!", "beyond ASCII": range(0x80, 0x100), "line ends": b"\n", "full stops": b"."}
_CLASS = np.zeros(256, np.int64)
for _i, _bytes in enumerate(_CLASSES.values(), 1):
    _CLASS[list(_bytes)] = _i
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#*$%&|<>!")] = True


class Model(NamedTuple):
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


def featurize(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each text and one more, word buckets, their weights, statistics of each text).

    Weights are log(1 + count), scaled to length 1 for each text. n_chars is NaN where missing.
    """
    n = len(offsets) - 1
    words = find_words(data, offsets)
    hashes = hash_words(data, words)
    per_text = np.diff(words.first)
    key, count = np.unique(words.text * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    owner, weight = key // BUCKETS, np.log1p(count)
    weight /= np.sqrt(np.bincount(owner, weight * weight, n))[owner]
    _, at, times = np.unique(hashes ^ mix(words.text.astype(np.uint64)), return_index=True, return_counts=True)
    commonest = np.zeros(n, np.int64)
    np.maximum.at(commonest, words.text[at], times)
    size, some = np.maximum(np.diff(offsets), 1), np.maximum(per_text, 1)
    text_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    share = np.bincount(text_of_byte * (len(_CLASSES) + 1) + _CLASS[data], minlength=n * (len(_CLASSES) + 1)).reshape(n, -1) / size[:, None]
    by = dict(zip(_CLASSES, share.T[1:]))
    last, upper = data[words.ends - 1] if len(words.ends) else data[:0], _CLASS[data[words.starts]] == 1 if len(words.starts) else np.zeros(0, bool)
    second = np.minimum(words.starts + 1, max(len(data) - 1, 0))
    upper = upper & (_CLASS[data[second]] == 1) if len(words.starts) else upper
    by |= {
        "words": np.log1p(per_text),
        "word bytes": np.bincount(words.text, words.ends - words.starts, n) / some,
        "distinct words": np.bincount(words.text[at], minlength=n) / some,
        "commonest word": commonest / some,
        "words ending in a mark": np.bincount(words.text, _MARKS[last], n) / some,
        "words of upper case": np.bincount(words.text, upper, n) / some,
        "n_chars": np.log1p(np.maximum(np.nan_to_num(n_chars), 0)),
        "n_chars missing": np.isnan(n_chars).astype(float),
    }
    return np.searchsorted(owner, np.arange(n + 1)), key % BUCKETS, weight, np.column_stack([by[x] for x in STATISTICS])


def raw_scores(model: Model, first: np.ndarray, bucket: np.ndarray, weight: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Scores before the logistic function, of every text in time linear in its entries."""
    n = len(first) - 1
    z = np.clip((stats - model.mean) / model.spread, -4, 4)
    v = model.factors
    owner = np.repeat(np.arange(n), np.diff(first))
    linear = model.bias + np.bincount(owner, weight * model.weights[bucket], n) + (z * model.weights[BUCKETS:]).sum(1)
    pairs = np.zeros(n)
    for f in range(v.shape[1]):
        x = weight * v[bucket, f]
        total = np.bincount(owner, x, n) + (z * v[BUCKETS:, f]).sum(1)
        squares = np.bincount(owner, x * x, n) + ((z * v[BUCKETS:, f]) ** 2).sum(1)
        pairs += total * total - squares
    return linear + pairs / 2


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 11) -> Model:
    """rows: (buckets, weights, statistics) of each labelled document. With one class only, its share is the score of all."""
    rng = np.random.default_rng(seed)
    n, width = len(rows), BUCKETS + len(STATISTICS)
    share = (labels.sum() + 0.5) / (n + 1)
    model = Model(float(np.log(share / (1 - share))), np.zeros(width), np.zeros((width, FACTORS)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    if not 0 < labels.sum() < n:
        return model
    stats = np.array([r[2] for r in rows])
    mean, spread = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    x = np.zeros((n, width), np.float32)
    for i, (bucket, weight, _) in enumerate(rows):
        x[i, bucket] = weight
    x[:, BUCKETS:] = np.clip((stats - mean) / spread, -4, 4)
    params = [np.array([model.bias]), np.zeros(width), rng.normal(0, 0.01, (width, FACTORS))]
    moment, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            xb, y = x[order[at : at + BATCH]], labels[order[at : at + BATCH]]
            b, w, v = params
            total = xb @ v
            score = b[0] + xb @ w + ((total**2).sum(1) - (xb**2 @ v**2).sum(1)) / 2
            g = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / len(y)
            grads = [np.array([g.sum()]), xb.T @ g + DECAY * w, xb.T @ (g[:, None] * total) - v * ((xb**2).T @ g)[:, None] + DECAY * v]
            t += 1
            for p, d, m, s in zip(params, grads, moment, second):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Model(float(params[0][0]), params[1], params[2], mean, spread)


def held_out(id_col: str = "doc_id"):
    """Column: whether crc32 of doc_id as text is a multiple of 5; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _inputs(docs: DataFrame, text: str, id_col: str, n_chars: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(n_chars).cast("double").alias("n_chars"), held_out(id_col).alias("held_out"))


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple]]:
    data, offsets = texts_of(batch.column("text"))
    n_chars = batch.column("n_chars").to_numpy(zero_copy_only=False)
    for a, b in steps(offsets):
        yield a, b, featurize(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n_chars[a:b])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", id_col: str = "doc_id", n_chars: str = "n_chars") -> Model:
    """Fit on `sample` labelled documents at most, none of them held out: the first by a hash of doc_id.

    Of rows that share a doc_id the one with the longest text is taken, of equally long ones the one
    whose text has the least hash, of repeated ones any; a doc_id labelled 0 and 1 counts as 1;
    ties of the hash of doc_id are broken by doc_id. Null labels and null doc_ids are not used.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(F.max("quality").alias("label"))
    chosen = known.orderBy(F.xxhash64("_labelled"), "_labelled").limit(sample)
    rows = _inputs(docs, text, id_col, n_chars).join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled"))
    # a doc_id that many rows share: each task sends one of them at most
    one = rows.groupBy("doc_id", "label").agg(F.max_by(F.struct("text", "n_chars"), F.struct(F.octet_length("text"), -F.xxhash64("text"), "n_chars")).alias("one")).select("doc_id", "label", "one.text", "one.n_chars")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, (first, bucket, weight, stats) in _batches(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("label")[a:b], pa.array(np.split(bucket, first[1:-1]), pa.list_(pa.int32())), pa.array(np.split(weight, first[1:-1]), pa.list_(pa.float64())), pa.array(list(stats), pa.list_(pa.float64()))], names=["doc_id", "label", "bucket", "weight", "stats"])

    got = one.mapInArrow(sparse, "doc_id long, label int, bucket array<int>, weight array<double>, stats array<double>").toPandas().sort_values("doc_id", kind="stable")
    return fit(list(zip(got["bucket"], got["weight"], got["stats"])), got["label"].to_numpy(float))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text", id_col: str = "doc_id", n_chars: str = "n_chars") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from the threshold on).

    Null and empty texts are scored from their statistics alone. Only text and n_chars enter a score,
    so repeated rows have equal scores, and equal scores no order; a null doc_id counts as held out;
    an empty table gives no rows. Texts of any length are scored whole.
    """

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [raw_scores(model, *f) for _, _, f in _batches(batch)]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(found) if found else np.zeros(0), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return _inputs(docs, text, id_col, n_chars).mapInArrow(scores, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier predicts to be of quality 1, with all their columns, scored where they are read."""
    model = train(docs, labels)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(batch.num_columns - 2))
            n_chars = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            z = [raw_scores(model, *featurize(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n_chars[a:b])) for a, b in steps(offsets)]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(z) if z else np.zeros(0), -30, 30)))
            good = batch.filter(pa.array(p >= threshold))
            yield pa.RecordBatch.from_arrays(good.columns[:-2], names=good.schema.names[:-2])

    added = [F.col("text").alias(unused("_scored_text", docs)), F.col("n_chars").cast("double").alias(unused("_scored_chars", docs))]
    return docs.select("*", *added).mapInArrow(choose, docs.schema)
