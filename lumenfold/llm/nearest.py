"""Approximate nearest neighbours by multi-index hashing, reranked with floats.

A rotation learned on a bounded sample (SAMPLE rows; iterative quantisation) turns every vector into
a code of BITS bits, split into substrings of 16. In each block of rows every substring has an index:
its values in order, with the rows of each. Two codes that differ in at most r bits have a substring
that differs in at most r // (BITS / 16), so probing all values within that distance in all indexes
retrieves every code within the radius. The radius grows for each query on its own until codes beyond
it would not be nearer than the k-th best found: the sample also tells how far apart in bits COVER of
the pairs of a given nearness are. Where few codes are near, it grows to all bits and finds all rows.

Nearness is the inner product. Rows get one more component that brings all to one length, so that
larger inner products are smaller angles; queries get 0 there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import commonest_length, finite, in_blocks, matrix

#: Bits of a code, a multiple of 16; distinct vectors that the rotation is fitted on; share of near pairs that the radius must cover.
BITS, SAMPLE, COVER = 64, 8192, 0.98
#: Steps in which nearness (the cosine, from -1 to 1) is told apart when reach is learned, and pairs that a step needs.
STEPS, LEAST_PAIRS = 100, 50
#: Parts in which the rows of one vector are ranked before they meet.
SALTS = 8


class Model(NamedTuple):
    longest: float  # the greatest length of a vector
    mean: np.ndarray
    rotation: np.ndarray
    reach: np.ndarray  # by step of nearness: bits within which COVER of such pairs lie, and of all nearer ones


def _lifted(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors with the component that makes all as long as the longest; queries are stretched to that length instead."""
    norm = np.sqrt((x * x).sum(1))
    if query:
        return np.column_stack([x * (longest / norm)[:, None], np.zeros(len(x))])
    return np.column_stack([x, np.sqrt(np.maximum(longest**2 - norm**2, 0))])


def encode(model: Model, x: np.ndarray, query: bool = False) -> np.ndarray:
    """Codes of the rows of x, one row of BITS / 16 unsigned 16-bit substrings each."""
    on = (_lifted(x, model.longest, query) - model.mean) @ model.rotation > 0
    return np.packbits(on, axis=1, bitorder="little").view(np.uint16)


def _distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Bits in which rows of 64-bit words differ from one code."""
    return np.bitwise_count(codes ^ code).sum(1, dtype=np.int16)


def _rotation(x: np.ndarray, bits: int, rounds: int = 30) -> np.ndarray:
    """Iterative quantisation of centred rows: orthogonal blocks of directions, rotated until their signs lie near the values."""
    rng, parts = np.random.default_rng(11), []
    axes = np.linalg.eigh(x.T @ x / max(len(x), 1))[1][:, ::-1]
    for at in range(0, bits, x.shape[1]):
        own = axes[:, : min(bits - at, x.shape[1])]
        turn = np.linalg.qr(rng.normal(size=(own.shape[1],) * 2))[0]
        for _ in range(rounds):
            values = x @ own @ turn
            left, _, right = np.linalg.svd(np.sign(values).T @ (x @ own))
            turn = (left @ right).T
        parts.append(own @ turn)
    return np.column_stack(parts)


def _reach(model: Model, x: np.ndarray) -> np.ndarray:
    """For each step of nearness the bits within which COVER of the sample's pairs of that nearness, or of a greater one, lie."""
    asked = x[:512]
    near = _lifted(asked, model.longest, True) @ _lifted(x, model.longest, False).T / model.longest**2
    codes, step = encode(model, x).view(np.uint64), np.clip(((near + 1) / 2 * STEPS).astype(int), 0, STEPS - 1)
    apart = np.stack([_distances(codes, code) for code in encode(model, asked, True).view(np.uint64)])
    step[np.arange(len(asked)), np.arange(len(asked))] = -1
    reach, known = np.full(STEPS, BITS), BITS
    for s in range(STEPS):  # a step with few pairs takes what a lower one needs, which is more
        found = apart[step == s]
        known = int(np.ceil(np.quantile(found, COVER))) if len(found) >= LEAST_PAIRS else known
        reach[s] = known
    return np.maximum.accumulate(reach[::-1])[::-1]


def fit(x: np.ndarray, longest: float) -> Model:
    """The model of a sample of vectors; with too few of them every radius is all bits."""
    lifted = _lifted(x, longest, False)
    mean = lifted.mean(0)
    model = Model(longest, mean, _rotation(lifted - mean, BITS), np.full(STEPS, BITS))
    return model._replace(reach=_reach(model, x))


class Block:
    """The substring indexes of a block of rows."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray):
        self.vectors, self.words, self.index = vectors, np.ascontiguousarray(codes).view(np.uint64), []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            values, sizes = np.unique(codes[order, j], return_counts=True)
            self.index.append((values, sizes, order))

    def probes(self, code: np.ndarray) -> Iterator[np.ndarray]:
        """For each number of bits from 0 to 16 the rows with a substring that differs in just so many from the code's, of all indexes."""
        lists = []
        for (values, sizes, order), own in zip(self.index, code):
            apart = np.repeat(np.bitwise_count(values ^ own), sizes)
            lists.append((order[np.argsort(apart, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(apart, minlength=17))))))
        for level in range(17):
            yield np.concatenate([rows[ends[level] : ends[level + 1]] for rows, ends in lists])

    def nearest(self, query: np.ndarray, code: np.ndarray, k: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """(rows, inner products) of at least the k nearest found, and of all that tie with the last."""
        width, length, word = len(self.index), float(np.sqrt(query @ query)) * model.longest, np.ascontiguousarray(code).view(np.uint64)
        unknown = BITS + 1
        bits = np.full(len(self.words), unknown, np.int16)  # distances of codes that were retrieved and not yet ranked
        ranked = np.zeros(len(self.words), bool)
        kept, scores, need = np.zeros(0, np.int64), np.zeros(0), BITS
        for level, new in enumerate(self.probes(code)):
            new = new[(bits[new] == unknown) & ~ranked[new]]
            bits[new] = _distances(self.words[new], word)
            radius = width * level + width - 1  # every code within it has been retrieved
            while True:
                inside = np.flatnonzero(bits <= min(radius, need))
                if len(scores) < k and len(inside) > 8 * k:  # the nearest codes first: they tell how far to go
                    inside = inside[np.argpartition(bits[inside], 4 * k)[: 4 * k]]
                if not len(inside):
                    break
                bits[inside], ranked[inside] = unknown, True
                kept, scores = np.append(kept, inside), np.append(scores, self.vectors[inside] @ query)
                if len(scores) >= k:
                    worst = np.partition(scores, len(scores) - k)[len(scores) - k]
                    need = int(model.reach[min(max(int((worst / length + 1) / 2 * STEPS), 0), STEPS - 1)])
                    few = scores >= worst - 1e-9 * length
                    kept, scores = kept[few], scores[few]
            if len(scores) >= k and need <= radius:
                break
        # products added in order, so that equal vectors have equal scores
        return kept, np.cumsum(self.vectors[kept] * query, axis=1)[:, -1]


def _digest(vector: np.ndarray) -> bytes:
    return hashlib.blake2b((vector + 0.0).tobytes(), digest_size=20).digest()


def _usable(embeddings: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, vector of doubles, digest) of the rows that take part, and the number of components."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite("vector") & F.exists("vector", lambda x: x != 0))
    d = commonest_length(rows, "vector")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [_digest(x) for x in matrix(pa.chunked_array([batch.column(1)]), d)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=["vec_id", "vector", "digest"])

    return rows.where(F.size("vector") == d).mapInArrow(named, "vec_id long, vector array<double>, digest binary"), d


def _distinct(rows: DataFrame, most: int) -> DataFrame:
    """(digest, vector, ids: the `most` smallest vec_ids that have it) of every distinct vector.

    The rows of a vector, however many, are ranked in SALTS parts before they meet, and each task
    that reads them passes on no more than `most` of a part.
    """
    salted = rows.select("digest", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt"))
    for keys in (["digest", "salt"], ["digest"]):
        salted = salted.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("place") <= most)
    ids = salted.groupBy(F.col("digest").alias("_digest")).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    vectors = rows.groupBy("digest").agg(F.first("vector").alias("vector"))
    return vectors.join(ids, F.col("digest") == F.col("_digest")).select("digest", "vector", "ids")


def build_index(embeddings: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame, Model | None, int]:
    """(all rows: vec_id, digest; index: digest, vector, ids, code of every distinct vector; model; number of components), written to the shared folder."""
    usable, d = _usable(embeddings, id_col, vector)
    rows = materialize(usable, "vectors")
    index = materialize(_distinct(rows, k + 1), "distinct-vectors")
    longest = index.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)))).first()[0]
    if longest is None:
        return rows, index.withColumn("code", F.lit(b"")), None, d
    sample = index.orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE).select("vector").toArrow()
    model = fit(matrix(sample.column(0), d), longest)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = encode(model, matrix(pa.chunked_array([batch.column(1)]), d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in codes], pa.binary())], names=[*batch.schema.names, "code"])

    return rows, materialize(index.mapInArrow(coded, "digest binary, vector array<double>, ids array<long>, code binary"), "codes"), model, d


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row whose vec_id is divisible by `every`, the k nearest found among all other rows: query_id, rank from 1, vec_id, score.

    score is the inner product in double precision, the products added in the order of components;
    ties go to the smaller vec_id. With k rows or fewer besides the query's own, all are returned.
    Rows with a null vec_id, and vectors that are null, zero, of another than the commonest length,
    or hold null or non-finite components, take no part. Equal vectors (told apart by 160 bits of
    BLAKE2b) are searched once and returned row by row; rows that share a vec_id are rows like any
    other, and each query row leaves out itself alone. An empty table gives no rows; other columns
    are not read.
    """
    rows, index, model, d = build_index(embeddings, k, id_col, vector)
    schema = "_asked binary, score double, ids array<long>, same boolean"
    asking = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("digest").alias("_own"))
    if model is None:
        return asking.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    wanted = asking.select("_own").distinct()
    queries = materialize(index.join(wanted, F.col("digest") == F.col("_own"), "left_semi").select("digest", "vector"), "queries")

    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(block) or not len(asked):
            return pa.table({"_asked": pa.array([], pa.binary()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64())), "same": pa.array([], pa.bool_())})
        codes = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint16).reshape(len(block), -1)
        known, x = Block(matrix(block.column("vector"), d), codes), matrix(asked.column("vector"), d)
        at, found, scores = [], [], []
        digests = np.array(block.column("digest").to_pylist(), object)
        for i, code in enumerate(encode(model, x, True)):
            rows_of, score = known.nearest(x[i], code, k + 1, model)
            # of those that tie with the last one, the vectors of the smallest ids go on
            if len(rows_of) > k + 1:
                least = np.array([block.column("ids")[r.item()].values[0].as_py() for r in rows_of])
                first = np.lexsort((least, -score))[: k + 1]
                rows_of, score = rows_of[first], score[first]
            at.append(np.full(len(rows_of), i))
            found.append(rows_of)
            scores.append(score)
        at, found = np.concatenate(at), np.concatenate(found)
        own = asked.column("digest").take(pa.array(at)).combine_chunks()
        same = [a == b for a, b in zip(own.to_pylist(), digests[found])]
        return pa.table({"_asked": own, "score": np.concatenate(scores), "ids": block.column("ids").take(pa.array(found)), "same": pa.array(same, pa.bool_())})

    hits = in_blocks(index, "digest", queries, "digest", d, search, schema)
    last = Window.partitionBy("_asked").orderBy(F.desc("score"), F.element_at("ids", 1))
    best = hits.withColumn("place", F.row_number().over(last)).where(F.col("place") <= k + 1)
    rows_of = F.flatten(F.collect_list(F.transform("ids", lambda x: F.struct((-F.col("score")).alias("less"), x.alias("vec_id"), F.col("same").alias("same")))))
    lists = best.groupBy("_asked").agg(F.slice(F.array_sort(rows_of), 1, k + 1).alias("found"))
    joined = asking.join(lists, F.col("_own") == F.col("_asked"))
    own = F.array_position(F.transform("found", lambda x: x["same"] & (x["vec_id"] == F.col("query_id"))), True)
    others = F.slice(F.filter("found", lambda x, i: i + 1 != F.col("_at")), 1, k)
    ranked = joined.withColumn("_at", own).select("query_id", F.posexplode(others).alias("place", "one"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("one")["vec_id"].alias("vec_id"), (-F.col("one")["less"]).alias("score"))
