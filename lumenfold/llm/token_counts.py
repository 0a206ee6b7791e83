"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A byte-level BPE never merges across the pre-tokens that its pattern cuts, so a document's count is
the sum of its pre-tokens' counts. The tree holds characters and tokens of every node, and its
leaves are stored. An edit walks down to the leaves that it touches, cuts and encodes only from the
pre-token before it to the first old boundary that the new cuts meet again, and updates the sums on
the way up; other leaves are neither cut nor encoded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_small, materialize

#: Pre-tokens of a leaf when a tree is built; a leaf of SPLIT times as many is split.
LEAF, SPLIT = 64, 8
#: Distinct pre-tokens whose counts a Python worker remembers, at most.
REMEMBERED = 300_000
_LEAVES = ("leaf_chars", "leaf_tokens", "leaf_pretokens")


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text)


class SegmentTree:
    """Pre-tokens of one text in leaves, with the characters and tokens under every node of a binary tree.

    Node 1 is the root, node i has the children 2i and 2i + 1, and leaf k is node size + k. A leaf
    that comes from a stored tree is its place in the text until an edit needs its pre-tokens.
    """

    def __init__(self, counter: Counter, text: str, stored: tuple[list[int], list[int], list[int]] | None = None):
        """stored: characters, tokens and pre-tokens of each leaf of this text's tree; without it the text is cut and encoded."""
        self.counter, self.source, self.encoded = counter, text, 0
        if stored is None:
            pieces = counter.cut(text)
            self._plant([self._counted(pieces[i : i + LEAF]) for i in range(0, len(pieces), LEAF)])
        else:
            self._plant(list(zip(accumulate(stored[0], initial=0), *stored)))

    def _counted(self, leaf: list[str]) -> tuple[list[str], int, int, int]:
        return leaf, sum(map(len, leaf)), sum(map(self.counter, leaf)), len(leaf)

    def _plant(self, leaves: list[tuple]) -> None:
        """leaves: pre-tokens or their place in the source, then characters, tokens and pre-tokens."""
        leaves = leaves or [([], 0, 0, 0)]
        self.leaves, self.counts = [x[0] for x in leaves], [x[3] for x in leaves]
        self.size = 1 << (len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, (_, chars, tokens, _) in enumerate(leaves):
            self.chars[self.size + k], self.tokens[self.size + k] = chars, tokens
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def stored(self) -> tuple[list[int], list[int], list[int]]:
        """Characters, tokens and pre-tokens of each leaf."""
        n = len(self.leaves)
        return self.chars[self.size : self.size + n], self.tokens[self.size : self.size + n], self.counts

    def _leaf(self, k: int) -> list[str]:
        if isinstance(self.leaves[k], int):
            found = self.counter.pattern.finditer(self.source, self.leaves[k])
            self.leaves[k] = [m.group() for m in islice(found, self.counts[k])]
        return self.leaves[k]

    def _sum(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, k: int, leaf: list[str], chars: int, tokens: int) -> None:
        self.leaves[k], self.counts[k] = leaf, len(leaf)
        i = self.size + k
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self._sum(i)

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character `at`; the last leaf for the end."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at >= before + self.chars[i] and (self.chars[i + 1] or at < before + self.chars[i]):
                before += self.chars[i]
                i += 1
        return min(i - self.size, len(self.leaves) - 1), before

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    @property
    def pretokens(self) -> int:
        return sum(self.counts)

    def text(self) -> str:
        return "".join(x for k in range(len(self.leaves)) for x in self._leaf(k))

    def edit(self, at: int, delete: int, insert: str) -> int:
        """Replace `delete` characters from `at` on by `insert`; returns the new total. Both are cut to the text's length."""
        at = max(0, min(at, self.length))
        delete = max(0, min(delete, self.length - at))
        # begin at the pre-token before the one that holds the character before the edit: only these can change
        first, start = self._find(max(at - 1, 0))
        while first and (start >= at or self._position(first, start, at)[0] < 1):
            first -= 1
            start -= self.chars[self.size + first]
        index, begin = self._position(first, start, at)
        index, begin = max(index - 1, 0), begin - (len(self._leaf(first)[index - 1]) if index > 0 else 0)
        # old pre-tokens from there on, and where each ends in the new text
        last, kept = first, self._leaf(first)[:index]
        old = self._leaf(first)[index:]
        shift = len(insert) - delete
        while last + 1 < len(self.leaves) and begin + sum(map(len, old)) < at + delete:
            last += 1
            old += self._leaf(last)
        while True:
            joined = "".join(old)
            text = joined[: at - begin] + insert + joined[at - begin + delete :]
            ends, position = {}, begin
            for n, piece in enumerate(old):
                ends[position + shift] = n  # an old boundary, in the new text, and the old pieces before it
                position += len(piece)
            new, position, met = [], begin, len(old)
            for found in self.counter.pattern.finditer(text):
                if position >= at + len(insert) and position in ends and position - shift >= at + delete and new:
                    met = ends[position]
                    break
                new.append(found.group())
                position += len(new[-1])
            if met < len(old) or last + 1 >= len(self.leaves):
                break
            last += 1  # no old boundary was met inside these leaves
            old += self._leaf(last)
        self.encoded += met + len(new)
        tokens = sum(self.tokens[self.size + first : self.size + last + 1]) + sum(map(self.counter, new)) - sum(map(self.counter, old[:met]))
        chars = sum(self.chars[self.size + first : self.size + last + 1]) + shift
        for k in range(first + 1, last + 1):
            self._set(k, [], 0, 0)
        self._set(first, kept + new + old[met:], chars, tokens)
        if self.counts[first] > LEAF * SPLIT:
            whole, leaves = self.leaves[first], list(zip(self.leaves, *self.stored()))
            leaves[first : first + 1] = [self._counted(whole[i : i + LEAF]) for i in range(0, len(whole), LEAF)]
            self._plant(leaves)
        return self.total

    def _position(self, leaf: int, start: int, at: int) -> tuple[int, int]:
        """(index, first character) of the last pre-token of a leaf that begins before `at`; (0, start) if none does."""
        index, begin = 0, start
        for i, piece in enumerate(self._leaf(leaf)):
            if start >= at:
                break
            index, begin = i, start
            start += len(piece)
        return index, begin


def build_trees(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, digest of its text, pretokens, tokens, chars, and those of each leaf: leaf_chars, leaf_tokens, leaf_pretokens.

    This is the index to store: it has no text, and `update` never encodes again what edits leave
    alone. Null and empty texts have a tree with one empty leaf; texts of any length are cut whole;
    an empty table gives no rows.
    """
    schema = "doc_id long, digest binary, pretokens long, tokens long, chars long, leaf_chars array<int>, leaf_tokens array<int>, leaf_pretokens array<int>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks_path, pattern)
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3]
        names = ["doc_id", "digest", "pretokens", "tokens", "chars", "leaf_chars", "leaf_tokens", "leaf_pretokens"]
        for batch in batches:
            out = []
            for one in batch.column(1).to_pylist():
                tree = SegmentTree(counter, one or "")
                out.append((_digest(one), tree.pretokens, tree.total, tree.length, *tree.stored()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 7, kinds))], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(build, schema)


def _digest(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode()).digest()


def _distinct_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, text) of docs (doc_id, text); of rows that repeat a task sends few."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bytes]] = set()
        for batch in batches:
            digests, new = [_digest(x) for x in batch.column(1).to_pylist()], []
            for key in zip(batch.column(0).to_pylist(), digests):
                new.append(key not in seen)
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.add(key)
            found = pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), batch.column(1)], names=["doc_id", "digest", "text"])
            yield found.filter(pa.array(new, pa.bool_()))

    return docs.mapInArrow(read, "doc_id long, digest binary, text string")


def update(docs: DataFrame, trees: DataFrame, edits: DataFrame, ranks_path: str, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of trees: doc_id, tokens_before, tokens_after, pretokens, reencoded, edits, chars_after.

    trees: what `build_trees` made of docs, stored. edits: doc_id, seq, at, delete, insert; the edits
    of a document apply in the order of seq (ties in the order of at, delete, insert), each to the
    text that the one before left. Characters are Unicode code points; positions beyond the text
    mean its end. reencoded: pre-tokens that edits encoded, the new ones and those they replace.
    Null text is empty; null numbers are 0 and a null insert is empty; edits of unknown documents,
    and those with a null doc_id, are ignored; each text of a doc_id that repeats gets its edits.
    Of documents that repeat whole, few are shuffled, and of those without edits none, unless the
    edited ones are too many to broadcast their ids: what moves grows with the edits and the texts
    they change. Rows stream in order, so a task holds one
    document's tree at a time, however many edits it has.
    """
    changes = edits.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(x).cast("long"), F.lit(0)).alias(x) for x in ("seq", "at", "delete")], F.coalesce(F.col("insert"), F.lit("")).alias("insert"))
    edited = materialize(changes.select(F.col("doc_id").alias("_edited")).distinct(), "edited")
    same = F.col("doc_id") == F.col("_edited")
    all_texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    # where edits name so many documents that their ids can't be broadcast, the shuffle that brings texts and edits together drops the others
    texts = _distinct_texts(all_texts.join(F.broadcast(edited), same, "left_semi") if is_small(edited) else all_texts)
    own = trees.join(edited, same, "left_semi").groupBy("doc_id", "digest").agg(*[F.first(x).alias(x) for x in _LEAVES])
    own = materialize(own, "edited-trees")
    changes = changes.join(own.select(F.col("doc_id").alias("_id"), "digest"), F.col("doc_id") == F.col("_id")).drop("_id")
    rows = texts.select("doc_id", "digest", F.lit(1).alias("kind"), F.coalesce("text", F.lit("")).alias("insert"))
    rows = rows.unionByName(own.withColumn("kind", F.lit(0)), allowMissingColumns=True).unionByName(changes.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    rows = rows.repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "kind", "seq", "at", "delete", "insert")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks_path, pattern)
        now, stored, source, tree, done, out = None, None, "", None, 0, []

        def close() -> None:
            if done:
                out.append((*now, tree.total, tree.pretokens, tree.encoded, done, tree.length))

        def table() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 7, kinds)], names=["_id", "_digest", "_tokens", "_pretokens", "_encoded", "_edits", "_chars"])

        for batch in batches:
            for doc_id, digest, kind, at, delete, insert, *leaves in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "digest", "kind", "at", "delete", "insert", *_LEAVES))):
                if (doc_id, digest) != now:
                    close()
                    now, stored, source, tree, done = (doc_id, digest), None, "", None, 0
                if kind == 0:
                    stored = tuple(leaves)
                elif kind == 1:
                    source = insert
                else:
                    tree = tree or SegmentTree(counter, source, stored)
                    done += 1
                    tree.edit(at, delete, insert)
            yield table()
            out.clear()
        close()
        yield table()

    changed = rows.mapInArrow(apply, "_id long, _digest binary, _tokens long, _pretokens long, _encoded long, _edits long, _chars long")
    changed = materialize(changed, "changed")
    joined = trees.select("doc_id", "digest", "tokens", "pretokens", "chars").join(changed, (F.col("doc_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    new = lambda x, y, z: F.coalesce(x, y).alias(z)
    return joined.select("doc_id", F.col("tokens").alias("tokens_before"), new("_tokens", "tokens", "tokens_after"), new("_pretokens", "pretokens", "pretokens"), new("_encoded", F.lit(0), "reencoded"), new("_edits", F.lit(0), "edits"), new("_chars", "chars", "chars_after"))


def recount(docs: DataFrame, edits: DataFrame, ranks_path: str, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Store the trees of docs, then `update` them by edits: one row per document, as there."""
    return update(docs, materialize(build_trees(docs, ranks_path, pattern, text, id_col), "trees"), edits, ranks_path, pattern, text, id_col)


def sample_edits(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Two edits of every document, derived from its own columns: a replacement inside, then an insertion at its middle."""
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    first = F.struct(F.lit(1).cast("long").alias("seq"), F.pmod(F.xxhash64(id_col), size + 1).cast("long").alias("at"), F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(12)).alias("delete"), F.concat(F.lit(" "), F.coalesce("source", F.lit("none")), F.lit(": ")).alias("insert"))
    second = F.struct(F.lit(2).cast("long").alias("seq"), F.floor(size / 2).cast("long").alias("at"), F.lit(0).cast("long").alias("delete"), F.coalesce("lang", F.lit("??")).alias("insert"))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(first, second)).alias("e")).select("doc_id", "e.*")
