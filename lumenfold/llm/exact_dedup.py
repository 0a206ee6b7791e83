"""Exact deduplication with a sharded cuckoo filter over the digests of live texts.

Digests are computed inside the scan, pre-aggregated before any shuffle, and dealt by digest to
shards of bounded size. Every shard keeps a cuckoo filter whose buckets also hold the stored keys:
a hit is verified against them, which are SHA-256 of the whole content and stand for it; a newer copy deletes the entry of the older one and takes its
place, and a filter that overflows is rebuilt at twice its size from the stored keys.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_places, materialize, place_of, small_side, with_row

#: Partial rows of one digest that can reach a shard, at most.
SALTS = 16
#: Partial rows in a shard, about.
SHARD_ROWS = 20_000


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four slots, each with its stored key and value.

    Keys are byte strings of at least 12 uniformly distributed bytes, such as SHA-256 digests.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 64, seed: int = 7):
        self.size = 1 << max(1, (buckets - 1).bit_length())
        self.rows: list[list[tuple[int, bytes, object]]] = [[] for _ in range(self.size)]
        self.random, self.resizes, self.false_hits, self.count = random.Random(seed), 0, 0, 0

    @staticmethod
    def mark(key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") or 1

    def _pair(self, key: bytes) -> tuple[int, int, int]:
        mark, one = self.mark(key), int.from_bytes(key[:8], "little") & (self.size - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self.size - 1))

    def get(self, key: bytes, default=None):
        """The value stored for key: fingerprints first, then the stored key decides."""
        mark, one, two = self._pair(key)
        for bucket in (one, two):
            for found, stored, value in self.rows[bucket]:
                if found == mark:
                    if stored == key:
                        return value
                    self.false_hits += 1
        return default

    def delete(self, key: bytes) -> bool:
        mark, one, two = self._pair(key)
        for bucket in (one, two):
            row = self.rows[bucket]
            for i, (found, stored, _) in enumerate(row):
                if found == mark and stored == key:
                    row.pop(i)
                    self.count -= 1
                    return True
        return False

    def insert(self, key: bytes, value: object) -> None:
        """key must not be live."""
        entry = (self.mark(key), key, value)
        while (entry := self._place(entry)) is not None:
            self._grow()
        self.count += 1

    def _place(self, entry: tuple) -> tuple | None:
        """None if it found room, else the entry that was left over."""
        _, one, two = self._pair(entry[1])
        for bucket in (one, two):
            if len(self.rows[bucket]) < self.SLOTS:
                self.rows[bucket].append(entry)
                return None
        bucket = self.random.choice((one, two))
        for _ in range(self.KICKS):
            at = self.random.randrange(self.SLOTS)
            entry, self.rows[bucket][at] = self.rows[bucket][at], entry
            bucket = self._other(bucket, entry[0])
            if len(self.rows[bucket]) < self.SLOTS:
                self.rows[bucket].append(entry)
                return None
        return entry

    def _grow(self) -> None:
        """Twice the buckets, filled anew from the stored keys."""
        self.resizes += 1
        waiting = [x for row in self.rows for x in row]
        while waiting:
            self.size *= 2
            self.rows = [[] for _ in range(self.size)]
            if all(self._place(x) is None for x in waiting):
                return

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((key, value) for row in self.rows for _, key, value in row)


def ascii_lower_sha256(text: str | None) -> bytes:
    """SHA-256 of the UTF-8 text with A-Z, and no other letter, in lower case; null counts as empty."""
    return hashlib.sha256((text or "").encode().lower()).digest()


def with_digest(docs: DataFrame, text: str = "text", id_col: str = "doc_id", place: str | None = None) -> DataFrame:
    """(doc_id long, digest binary) of every row; place: a struct (file, at) that tells rows apart, whose fields are added."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256((x.as_buffer().to_pybytes() if x.is_valid else b"").lower()).digest() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), *batch.columns[2:]], names=["doc_id", "digest", *batch.schema.names[2:]])

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), *place_of(place)]
    return docs.select(*columns).mapInArrow(digests, "doc_id long, digest binary" + ", file long, at long" * bool(place))


def _index_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Live entries after every partial row of a shard went through its cuckoo filter."""
    index = CuckooFilter(len(pdf) // CuckooFilter.SLOTS + 1)
    for digest, newest, rows in zip(pdf["digest"], pdf["newest"], pdf["rows"]):
        digest, newest = bytes(digest), None if pd.isna(newest) else int(newest)
        if (live := index.get(digest)) is not None:
            index.delete(digest)
            newest, rows = max((x for x in (newest, live[0]) if x is not None), default=None), rows + live[1]
        index.insert(digest, (newest, int(rows)))
    found = list(index.items())
    return pd.DataFrame({"digest": [k for k, _ in found], "keep_id": pd.array([v[0] for _, v in found], "Int64"), "group_size": [v[1] for _, v in found]})


def live_digests(rows: DataFrame, n_rows: int) -> DataFrame:
    """(digest, keep_id, group_size) of each distinct digest of rows (doc_id, digest).

    A digest that a third of all rows share comes to its shard as at most SALTS partial rows.
    """
    partial = rows.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.max("doc_id").alias("newest"), F.count(F.lit(1)).alias("rows"))
    shards = max(1, n_rows // SHARD_ROWS)
    return partial.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards))).groupBy("shard").applyInPandas(_index_shard, "digest binary, keep_id long, group_size long")


def update_index(index: DataFrame, inserts: DataFrame, deletes: DataFrame, shards: int = 64) -> DataFrame:
    """A live index (digest, keep_id, group_size) after deletions, then insertions, both (doc_id, digest).

    A deletion takes the digest out if it names the live doc_id; an insertion of a live digest
    keeps the larger doc_id. Repeated deletions, and those of digests that are not live, do nothing.
    """
    kinds = [index.selectExpr("digest", "keep_id AS id", "group_size AS rows", "0 AS step"), deletes.selectExpr("digest", "doc_id AS id", "0L AS rows", "1 AS step").distinct(), inserts.groupBy("digest").agg(F.max("doc_id").alias("id"), F.count(F.lit(1)).alias("rows")).selectExpr("digest", "id", "rows", "2 AS step")]

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        live = CuckooFilter(len(pdf) // CuckooFilter.SLOTS + 1)
        for digest, id_, rows, step in pdf.sort_values("step")[["digest", "id", "rows", "step"]].itertuples(index=False):
            digest, id_ = bytes(digest), None if pd.isna(id_) else int(id_)
            old = live.get(digest)
            if step == 1:
                if old is not None and old[0] == id_:
                    live.delete(digest)
                continue
            if old is not None:
                live.delete(digest)
                id_, rows = max((x for x in (id_, old[0]) if x is not None), default=None), rows + old[1]
            live.insert(digest, (id_, int(rows)))
        found = list(live.items())
        return pd.DataFrame({"digest": [k for k, _ in found], "keep_id": pd.array([v[0] for _, v in found], "Int64"), "group_size": [v[1] for _, v in found]})

    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return every.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards))).groupBy("shard").applyInPandas(apply, index.select("digest", "keep_id", "group_size").schema)


def exact_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the row with the largest doc_id stays.
    Null text counts as empty. A null doc_id is smaller than any other, and stays only where its
    group has no other. Rows that share text and doc_id are all reported alike. An empty table
    gives no rows. Columns other than the two named are not read.
    """
    rows = materialize(with_digest(docs, text, id_col), "digests")
    live = live_digests(rows, rows.count())
    copies = materialize(live.where("group_size > 1").withColumnRenamed("digest", "copied"), "live")
    return rows.join(small_side(copies), F.col("digest") == F.col("copied"), "left").select(
        "doc_id",
        F.when(F.col("copied").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("copied").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Of rows with equal texts (see `exact_groups`) the one with the largest doc_id, with all its columns.

    Rows are told apart by where they stand in their files; of several with that doc_id, or of those
    of a group without any doc_id, the first in the files stays. Other columns may have any names.
    """
    named, row = with_row(docs)
    rows = materialize(with_digest(named, text, id_col, row), "digests")
    copies = materialize(live_digests(rows, rows.count()).where("group_size > 1").select(F.col("digest").alias("copied"), "keep_id"), "live")
    groups = materialize(rows.join(small_side(copies), F.col("digest") == F.col("copied")), "copies")
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(F.col("digest").alias("kept")).agg(F.min(F.struct("file", "at")).alias("place"))
    stay = materialize(stay.select("kept", F.col("place.file").alias("kept_file"), F.col("place.at").alias("kept_at")), "stay")
    gone = groups.join(small_side(stay), F.col("digest") == F.col("kept")).where("file <> kept_file OR at <> kept_at").select("file", "at")
    return at_places(named, row, materialize(gone, "gone"), "left_anti").select(*docs.columns)
