"""Substring deduplication: passages of WINDOW words that an earlier document has too are removed.

Every window of WINDOW words is represented by the least hash of the phrases of PHRASE words in it,
so equal windows have the same representative, and few phrases represent any window. Phrases that
recur in different texts are confirmed by a grouped count. The words around each of them, and no
more, go to the shard of the first document that has it; there the phrases are compiled into an
Aho-Corasick automaton, which streams all that came to the shard and locates every occurrence.
Windows around occurrences are compared word for word. Where so much surrounds one phrase that it is
dealt to several tasks, each compares its own, and only windows of their first documents are
compared between tasks, by a digest. Hashes choose what is sent; they decide nothing.
Texts with the same words throughout are compared as wholes, and only the first takes part in this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side, steps, texts_of
from .words import find_words, hash_words, mix, run_names, word_keys, word_names

WINDOW, PHRASE = 50, 8
#: Bytes of text in a shard, about. A phrase that has more around it is dealt to several tasks.
SHARD_BYTES = 6 << 20
#: Between two pieces of a shard; no word is a line end.
BETWEEN = " \n "
_EMPTY = hashlib.sha256(b"").digest()


def phrase_hashes(hashes: np.ndarray, phrase: int = PHRASE) -> np.ndarray:
    """The hash of the `phrase` words from each word on, fewer at the end."""
    n = max(len(hashes) - phrase + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(phrase):
        out = mix(out + hashes[i : n + i])
    return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from running minima forwards and backwards in blocks of that width."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = np.full(-(-len(x) // width) * width, np.uint64(2**64 - 1))
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, 1).reshape(-1)
    backward = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def words_of(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_bytes, digest of the words, phrases): the hashes that represent the text's windows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            n_words, digests, phrases = [], [], []
            for a, b in steps(offsets):
                part, base = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                words = find_words(part, base)
                least = sliding_least(phrase_hashes(hash_words(part, words)), WINDOW - PHRASE + 1)
                whole = part.tobytes()
                for i in range(b - a):
                    first, last = words.first[i], words.first[i + 1]
                    n_words.append(last - first)
                    digests.append(hashlib.sha256(b" ".join(whole[base[i] : base[i + 1]].split())).digest())
                    phrases.append(np.unique(least[first : last - WINDOW + 1]).view(np.int64) if last - first >= WINDOW else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(digests, pa.binary()), pa.array(phrases, pa.list_(pa.int64()))], names=["doc_id", "n_words", "n_bytes", "digest", "phrases"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(read, "doc_id long, n_words long, n_bytes long, digest binary, phrases array<long>")


def routed_texts(docs: DataFrame, firsts: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, digest, routes: array of (hot, group, part, wanted)) of the texts that hold a phrase that recurs.

    What surrounds a phrase goes where the first document with that phrase goes: to a shard of many,
    or, if all its surroundings are too large together (hot), to several parts of a group of their own.
    wanted: the recurring phrases of this text that go there. digest: the text that is meant, as
    rows that share a doc_id come with each other's routes.
    """
    held = firsts.select("first", "digest", "n_bytes", "n_words", F.explode("phrases").alias("phrase"))
    recurring = held.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("home")).where("n > 1").select(F.col("phrase").alias("_phrase"), "home")
    recurring = materialize(recurring, "recurring")
    most = F.least(F.col("n_bytes"), F.ceil(F.count(F.lit(1)) * (2 * WINDOW - PHRASE) * F.col("n_bytes") / F.col("n_words")))  # of bytes that surround them
    routes = held.join(recurring, F.col("phrase") == F.col("_phrase")).groupBy("first", "digest", "n_bytes", "n_words", "home").agg(F.collect_set("phrase").alias("wanted"), most.alias("around"))
    routes = materialize(routes.select("first", "digest", "home", "wanted", "around"), "routes")
    dealt = routes.groupBy(F.col("home").alias("_home")).agg(F.ceil(F.sum("around") / SHARD_BYTES).alias("parts"))
    shards = max(1, 2 * (routes.agg(F.sum("around")).first()[0] or 0) // SHARD_BYTES)  # half full on the average
    hot = F.col("parts") > 1
    group, part = F.when(hot, F.col("home")).otherwise(F.pmod(F.xxhash64("home"), F.lit(shards))), F.when(hot, F.pmod(F.xxhash64("digest"), F.col("parts"))).otherwise(0)
    by_group = routes.join(dealt, F.col("home") == F.col("_home")).groupBy("first", "digest", hot.alias("hot"), group.alias("group"), part.alias("part")).agg(F.flatten(F.collect_list("wanted")).alias("wanted"))
    grouped = by_group.groupBy(F.col("first").alias("_first"), "digest").agg(F.collect_list(F.struct("hot", "group", "part", "wanted")).alias("routes"))
    ids = small_side(materialize(routes.select(F.col("first").alias("_id")).distinct(), "held"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
    return materialize(own.join(grouped, F.col("doc_id") == F.col("_first")).select("doc_id", "text", "digest", "routes"), "texts")


def surroundings(texts: DataFrame) -> DataFrame:
    """(hot, group, part, doc_id, digest, at, places, piece): the words around the wanted phrases of each text, joined by one space.

    A piece holds every window of WINDOW words that holds one of the phrases of its group; pieces
    that touch are one. at: the piece's first word; places: where in it the phrases begin.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, digest, routes in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode().split()
                if hashlib.sha256(b" ".join(words)).digest() != digest:
                    continue
                data = np.frombuffer(text.encode(), np.uint8)
                own, out = phrase_hashes(hash_words(data, find_words(data, np.array([0, len(data)])))), []
                for route in routes:
                    found = np.flatnonzero(np.isin(own, np.asarray(route["wanted"], np.int64).view(np.uint64)))
                    begins, ends = np.maximum(found + PHRASE - WINDOW, 0), np.minimum(found + WINDOW, len(words))
                    cuts = np.flatnonzero(begins[1:] > ends[:-1]) + 1
                    for some in np.split(np.arange(len(found)), cuts):
                        a, b = int(begins[some[0]]), int(ends[some[-1]])
                        out.append((route["hot"], route["group"], route["part"], doc_id, digest, a, (found[some] - a).tolist(), b" ".join(words[a:b]).decode()))
                if out:
                    kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["hot", "group", "part", "doc_id", "digest", "at", "places", "piece"])

    return texts.select("doc_id", "text", "digest", "routes").mapInArrow(cut, "hot boolean, group long, part long, doc_id long, digest binary, at long, places array<int>, piece string")


def locate(line: str, data: np.ndarray, spaces: np.ndarray, phrases: list[str]) -> np.ndarray:
    """The word with which each occurrence of a phrase ends in a line of words; spaces: the bytes of the space before each word and after the last."""
    automaton = ahocorasick.Automaton()
    for phrase in phrases:
        automaton.add_word(f" {phrase} ", 1)
    automaton.make_automaton()
    at = (np.cumsum((data & 0xC0) != 0x80) - 1)[spaces]  # the same in characters
    return np.searchsorted(at, np.fromiter((end for end, _ in automaton.iter(line)), np.int64)) - 1


def _ranges(number: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, start, end): the words that the windows at `starts` cover in each numbered piece, as disjoint ranges; both in order."""
    cut = np.flatnonzero((np.diff(number) != 0) | (np.diff(starts) > WINDOW)) + 1
    first, last = np.append(0, cut)[: len(starts)], np.append(cut, len(starts))[: len(starts)] - 1
    return number[first], starts[first], starts[last] + WINDOW


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a shard's pieces tell: ranges of words that repeat, and windows of a hot group that other parts have to compare.

    The shard's phrases are compiled into an automaton, which finds every occurrence in all pieces.
    Windows around occurrences are equal where all their words are. One whose document isn't the
    first of the shard to have it repeats. The first is known to be the first of all where the
    shard has all pieces with its phrases; else (hot) its window is returned under a digest of its words.
    """
    ids, at, digests, hot = pdf["doc_id"].to_numpy(), pdf["at"].to_numpy(), pdf["digest"].to_numpy(), bool(pdf["hot"].iloc[0])
    line = f" {BETWEEN.join(pdf['piece'])} "
    data = np.frombuffer(line.encode(), np.uint8)
    spaces = np.flatnonzero(data == 0x20)
    starts, ends = spaces[:-1] + 1, spaces[1:]
    breaks = np.flatnonzero((ends - starts == 1) & (data[starts] == 0x0A))
    first = np.append(0, breaks + 1)  # of each piece
    piece = np.searchsorted(breaks, np.arange(len(starts)), side="right")
    piece[breaks] = -1
    names = word_names(*word_keys(data, starts, ends))
    places = pdf["places"]
    where = np.repeat(first, places.map(len)) + np.concatenate(places.to_list())
    chosen = where[np.unique(run_names(names, PHRASE)[where], return_index=True)[1]]
    found = locate(line, data, spaces, [data[starts[i] : ends[i + PHRASE - 1]].tobytes().decode() for i in chosen.tolist()]) - PHRASE + 1
    n = len(starts) - WINDOW + 1
    if n <= 0:
        n, found = 0, found[:0]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(found + PHRASE - WINDOW, 0), 1)
    np.add.at(change, np.minimum(found + 1, n), -1)
    windows = np.flatnonzero((np.cumsum(change[:n]) > 0) & (piece[:n] == piece[WINDOW - 1 :]) & (piece[:n] >= 0)) if n else np.zeros(0, np.int64)
    owner = piece[windows]
    same, doc = run_names(names, WINDOW)[windows], ids[owner]
    order = np.argsort(same, kind="stable")
    new = np.flatnonzero(np.diff(same[order], prepend=-1))
    least = np.empty_like(doc)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], new), np.diff(np.append(new, len(order)))) if len(order) else doc
    repeated = least < doc
    number, begin, end = _ranges(owner[repeated], windows[repeated])
    shift = at - first
    out = pd.DataFrame({"doc_id": ids[number], "digest": digests[number], "start": begin + shift[number], "end": end + shift[number], "window": None})
    if hot:
        open_, number = windows[~repeated], owner[~repeated]
        marks = [hashlib.blake2b(data[a:b], digest_size=20).digest() for a, b in zip(starts[open_].tolist(), ends[open_ + WINDOW - 1].tolist())]
        begin = open_ + shift[number]
        out = pd.concat([out, pd.DataFrame({"doc_id": ids[number], "digest": digests[number], "start": begin, "end": begin + WINDOW, "window": marks})])
    return out


def _search(docs: DataFrame, text: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(what `repeats` returns, the texts that were searched)."""
    base = materialize(words_of(docs, text, id_col), "words")
    firsts = base.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("n_bytes").alias("n_bytes"), F.first("n_words").alias("n_words"), F.first("phrases").alias("phrases"))
    firsts = materialize(firsts, "firsts")
    texts = routed_texts(docs, firsts, text, id_col)
    found = surroundings(texts).groupBy("group", "part").applyInPandas(_shard, "doc_id long, digest binary, start long, end long, window binary")
    found = materialize(found, "found")
    waiting = found.where("window IS NOT NULL")
    earlier = waiting.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(F.col("window").alias("_window"), "least")
    more = waiting.join(earlier, F.col("window") == F.col("_window")).where("least < doc_id")
    runs = found.where("window IS NULL").drop("window").unionByName(more.select("doc_id", "digest", "start", "end"))
    spans = runs.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    spans = materialize(spans, "spans").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "spans")
    first_of = firsts.select(F.col("digest").alias("_of"), "first")
    whole = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    joined = base.select("doc_id", "digest", "n_words").join(first_of, F.col("digest") == F.col("_of"), "left").join(spans, (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("_id")), "left")
    return joined.select("doc_id", "digest", "n_words", whole.alias("whole"), F.when(~whole, F.col("spans")).alias("spans")), texts


def repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, digest, n_words, whole (all its words repeat), spans (other ranges of words that repeat).

    A word repeats if a window of WINDOW consecutive words over it also stands in a document with a
    smaller doc_id. Null and empty texts have no words; texts of under WINDOW words have no spans.
    A null doc_id is neither before nor after another, and rows of one doc_id aren't before each
    other. An empty table gives no rows.
    """
    return _search(docs, text, id_col)[0]


def kept_words(words: list[bytes], spans) -> list[bytes]:
    """The words outside all spans, which are sorted by start and may overlap."""
    out, at = [], 0
    for span in spans:
        out += words[at : max(span["start"], at)]
        at = max(at, span["end"])
    return out + words[at:]


def cut_texts(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, digest, n_removed, kept): what is left of each text (doc_id, text) that has spans, as words joined by one space."""
    some = found.where("spans IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("digest", "spans")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, cuts in zip(*(c.to_pylist() for c in batch.columns)):
                words = (text or "").encode().split()
                digest = hashlib.sha256(b" ".join(words)).digest()
                for one in cuts:
                    if one["digest"] == digest:
                        kept = kept_words(words, one["spans"])
                        out.append((doc_id, digest, len(words) - len(kept), b" ".join(kept).decode()))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.string()))], names=["doc_id", "digest", "n_removed", "kept"])

    return texts.select("doc_id", "text").join(some, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "cuts").mapInArrow(cut, "doc_id long, digest binary, n_removed long, kept string")


def removal_digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (lowercase hex) after `repeats` are removed."""
    found, texts = _search(docs, text, id_col)
    found = materialize(found, "repeats")
    cut = cut_texts(texts, found).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("n_removed").alias("_removed"), F.sha2("kept", 256).alias("_kept")).dropDuplicates(["_id", "_digest"])
    joined = found.join(cut, (F.col("doc_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.lit(_EMPTY.hex())).otherwise(F.coalesce("_kept", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
