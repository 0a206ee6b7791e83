"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents are tokenised inside the scan and cut into pieces of at most CAPACITY tokens. How many
pieces of each length there are (CAPACITY counts at most, whatever the size of the corpus) decides
the packing: pieces above a third of the capacity are matched greedily, at most two in a sequence;
smaller ones, the longest first, go where they leave the least room. That plan says which sequence
and offset the k-th piece of a length gets; pieces are numbered by Spark within buckets of a hash,
and joined to the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, running, steps, texts_of
from .words import find_words, fold_keys, word_keys

CAPACITY, SEPARATOR = 2048, 0
#: Distinct words whose ids a Python worker remembers, about 40 bytes each; beyond that it begins anew.
REMEMBERED = 500_000
#: New words that are encoded in one call.
CHUNK = 200
#: Pieces of one length in a hash bucket, about; one task numbers those of one bucket.
BUCKET_ROWS = 500


class WordIds:
    """Ids of whole texts by a tokenizer that never joins characters across ASCII white space and drops it.

    Each distinct word is encoded once and remembered with its key (see `word_keys`), in the order
    of a hash of the key. A word whose hash is taken by another word is encoded each time it comes,
    so ids equal those of encoding the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted by hash; slots are places in the next four
        self.low, self.high, self.begins, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0  # a word's ids are pool[begins : begins + sizes]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Add words' ids to the pool: (where each begins, how many). Lines of CHUNK words are encoded; the place where an id begins says whose it is."""
        ids, sizes = [], []
        for at in range(0, len(words), CHUNK):
            part = words[at : at + CHUNK]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *map(len, part)]) + np.arange(len(part) + 1)
            sizes.append(np.diff(np.searchsorted(np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids)), starts)))
            ids.append(np.asarray(e.ids, "<u4"))
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(len(self.pool), len(ids)), "<u4")))
        self.pool[self.used : self.used + len(ids)] = ids
        begins = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        return begins, sizes

    def _learn(self, hashes: np.ndarray, low: np.ndarray, high: np.ndarray, words: list[str]) -> None:
        begins, sizes = self._encode(words)
        at = np.searchsorted(self.hashes, hashes)
        self.slots = np.insert(self.slots, at, np.arange(len(self.low), len(self.low) + len(low), dtype=np.int32))
        self.hashes = np.insert(self.hashes, at, hashes)
        for name, more in (("low", low), ("high", high), ("begins", begins), ("sizes", sizes)):
            setattr(self, name, np.concatenate((getattr(self, name), more)))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and one more entry), without special tokens."""
        if len(self.hashes) > REMEMBERED:
            self._forget()
        words = find_words(data, offsets)
        if not len(words.starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        low, high = word_keys(data, words.starts, words.ends)
        distinct, at, which = np.unique(fold_keys(low, high), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.hashes)
        new[inside] = self.hashes[place[inside]] != distinct[inside]
        whole = data.tobytes()
        spelled = lambda some: [whole[a:b].decode() for a, b in zip(words.starts[some].tolist(), words.ends[some].tolist())]
        if new.any():
            self._learn(distinct[new], low[at[new]], high[at[new]], spelled(at[new]))
            place = np.searchsorted(self.hashes, distinct)
        place = self.slots[place[which]]
        begins, sizes = self.begins[place], self.sizes[place]
        others = np.flatnonzero((self.low[place] != low) | (self.high[place] != high))
        if len(others):
            begins[others], sizes[others] = self._encode(spelled(others))
        total = np.concatenate(([0], np.cumsum(sizes)))
        return self.pool[np.repeat(begins - total[:-1], sizes) + np.arange(total[-1])], total[words.first]


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """The encoder of this Python worker, which is kept from one partition to the next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32[, ids]) of every document's ids, followed by the separator.

    row tells rows of docs apart that share a doc_id. Null and empty texts give one piece, the
    separator; a null doc_id stays null; a text of any length is cut into pieces, none longer than
    `capacity`; rows that repeat give their pieces each time; an empty table gives no rows.
    """
    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.asarray([SEPARATOR], "<u4").tobytes()
        names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 + keep_ids]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            data, offsets = texts_of(batch.column(2))
            row_ids, doc_ids, out, kept = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], []
            for a, b in steps(offsets):
                ids, first = encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids, first = ids.tobytes(), (4 * first).tolist()
                for i in range(a, b):
                    own = ids[first[i - a] : first[i - a + 1]] + end
                    for n, at in enumerate(range(0, len(own), 4 * capacity)):
                        piece = own[at : at + 4 * capacity]
                        out.append((row_ids[i], doc_ids[i], n, at // 4, len(piece) // 4, zlib.crc32(piece)))
                        if keep_ids:
                            kept.append(piece)
            columns = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 6, kinds)]
            if keep_ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in kept)])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(kept), "<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """How counts[length] pieces fill sequences: (length, from, to, sequence, offset, each).

    The pieces of this length numbered from..to-1 go to the sequences from `sequence` on, `each` of
    them to one, the first at `offset`. Work and result grow with the number of distinct lengths.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    open_: dict[int, list[tuple[int, int]]] = {}  # by remaining room: (first sequence, number of sequences)

    def place(length: int, n: int, sequence: int, offset: int, each: int) -> None:
        out.append((length, used[length], used[length] + n, sequence, offset, each))
        used[length] += n
        left[length] -= n

    def add(room: int, sequence: int, n: int) -> None:
        if room and n:
            open_.setdefault(room, []).append((sequence, n))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:  # the longest first, each with the longest that still fits beside it
        while left[length]:
            mate = next((m for m in large if m <= min(capacity - length, length) and left[m] > (m == length)), None)
            n = left[length] if mate is None else left[length] // 2 if mate == length else min(left[length], left[mate])
            place(length, n, sequences, 0, 1)
            if mate:
                place(mate, n, sequences, length, 1)
            add(capacity - length - (mate or 0), sequences, n)
            sequences += n
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            room = min((r for r in open_ if r >= length), default=0)
            if room:
                sequence, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            else:
                room, sequence, n = capacity, sequences, -(-left[length] // (capacity // length))
                sequences += n
            each = room // length
            full, rest = min(n, left[length] // each), 0
            if full:
                place(length, full * each, sequence, capacity - room, each)
                add(room - each * length, sequence, full)
            if full < n and left[length]:
                rest = left[length]
                place(length, rest, sequence + full, capacity - room, rest)
                add(room - rest * length, sequence + full, 1)
            add(room, sequence + full + bool(rest), n - full - bool(rest))
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every row of cut (with row, piece and length) and its sequence_id and offset.

    No sequence holds more than `capacity` tokens, and offsets in a sequence leave no gaps.
    Lengths must be from 1 to capacity. Pieces of one length are alike; row and piece, which tell
    rows apart, decide who takes which place. An empty table gives no rows.
    """
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a row for each of `capacity` lengths at most
    before = dict(zip(sorted(histogram), accumulate((histogram[n] for n in sorted(histogram)), initial=0)))
    lengths = spark.createDataFrame([(n, max(1, c // BUCKET_ROWS), before[n]) for n, c in histogram.items()], "_of_length long, _buckets long, _shorter long")
    dealt = cut.join(F.broadcast(lengths), F.col("length") == F.col("_of_length")).withColumn("_bucket", F.pmod(F.xxhash64("row", "piece"), F.col("_buckets")))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    sums = running(sizes, ["length", "_bucket"], {"_sum": "_n"}, "buckets").select(F.col("length").alias("_length"), F.col("_bucket").alias("_of"), "_sum")
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("row", "piece")) - 1
    numbered = dealt.withColumn("_within", within).join(sums, (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_of"))).withColumn("_k", F.col("_sum") - F.col("_shorter") + F.col("_within"))
    # at most some dozens of rows for each of `capacity` lengths, so the plan's size is bounded
    planned = spark.createDataFrame(plan(histogram, capacity), "_l long, _from long, _to long, _sequence long, _offset long, _each long")
    joined = numbered.join(F.broadcast(planned), (F.col("length") == F.col("_l")) & (F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_to")))
    place = F.col("_k") - F.col("_from")
    return joined.select(
        *cut.columns,
        (F.col("_sequence") + F.floor(place / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (place % F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset, row.

    keep_ids adds the token ids themselves, so that sequences can be trained on as they are. Nulls,
    empty and very long texts, ties, repeated rows and empty tables are treated as `pieces` and
    `pack` say: every row of docs is packed whole, its repeats too; among pieces of one length, a
    hash of their row decides which goes where.
    """
    cut = materialize(pieces(docs, tokenizer, capacity, keep_ids), "pieces")
    if not keep_ids:
        return pack(cut, capacity)
    # the ids move once, to their places, and not through the numbering
    placed = pack(cut.select("row", "piece", "length"), capacity).select(F.col("row").alias("_row"), F.col("piece").alias("_piece"), "sequence_id", "offset")
    return cut.join(placed, (F.col("row") == F.col("_row")) & (F.col("piece") == F.col("_piece"))).select(*cut.columns, "sequence_id", "offset")
