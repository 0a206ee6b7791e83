"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distances, components.

A fingerprint of 64 bits is split into BLOCKS blocks. Two that differ in at most DISTANCE bits agree
on at least BLOCKS - DISTANCE whole blocks, so they meet under the key of some choice of that many
blocks. Only distinct fingerprints take part, and a bucket gives links that span its components,
never all its pairs. Buckets above BUCKET fingerprints are left to a second exact way, whose groups
are bounded by the number of words of 64 bits near one word.

Filtering (`keep_one_of_each`) is for near duplicates by shingles, which three of 64 bits would
rarely catch: there fingerprints have 256 bits, of distinct words, so that edits move few bits, keys
are choices of four blocks of eight bits, and candidates are verified on their shingles. Keys miss
some; those share one of their rarest shingles, and are looked for among rows still apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_places, keep_last, materialize, place_of, small_side, steps, texts_of, with_row, written
from .components import connected_components
from .words import LOWER, Words, find_words, hash_words, mix

WIDTH, SEED, DISTANCE, BLOCKS = 3, 42, 3, 6
#: Fingerprints of a bucket that are compared with each other, at most.
BUCKET = 4000
#: Of wide fingerprints, of 256 bits: blocks, their bits, rounds of keys of four blocks, differing bits of a candidate at most.
#: Keys have 4 * PART_BITS bits, which tell some billions of texts apart; far above that, more bits and rounds are needed.
PARTS, PART_BITS, ROUNDS, WIDE_DISTANCE = 32, 8, 10, 40
#: Words in a shingle by which candidates are verified, and the least Jaccard similarity of near duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: Shingles known as common, at most, counted in one of so many texts; rows with one shingle that meet in one task, about.
COMMON, EVERY, BLOCK = 1 << 18, 16, 1000
#: Rows with one shingle whose pairs are joined, at most; pairs of more rows are compared by their parities before they become rows.
FEW = 16
#: What bounds in floating point are eased by, so that rounding loses no pair.
_SLACK = 1e-9
#: Bits of a set's parities, a multiple of 64: each tells whether an odd number of its shingles fall there.
PARITIES = 1024
_SEED = 0x9E3779B97F4A7C15 >> 3


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The SimHash of a whole text as an unsigned integer; 0 for a text without words, null included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, 1 << 16):
        to = min(at + (1 << 16), n)
        h = np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())), np.uint64, to - at)
        # a column of bits at a time, from eight bytes at once
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", place: str | None = None) -> DataFrame:
    """(doc_id, fp long: the 64 bits as a signed integer) of every row; place: a struct (file, at) that tells rows apart, whose fields are added."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), *place_of(place)]
    return docs.select(*columns).mapInArrow(compute, "doc_id long, fp long" + ", file long, at long" * bool(place))


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Every choice of blocks - distance blocks, as a mask of 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def spanning_links(found: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that join exactly the fingerprints joined by pairs within the distance: each new one in breadth-first order."""
    waiting, links = found.astype(np.int64), []
    while len(waiting) > 1:
        edge, waiting = [waiting[0]], waiting[1:]
        while edge and len(waiting):
            x = edge.pop()
            near = np.bitwise_count((waiting ^ x).view(np.uint64)) <= distance
            if near.any():
                links += [(int(x), int(y)) for y in waiting[near]]
                edge += list(waiting[near])
                waiting = waiting[~near]
    return links


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [link for x in batch.column(0) for link in spanning_links(x.values.to_numpy())]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _near_words(distance: int) -> np.ndarray:
    """Masks of one to `distance` bits, by their number of bits, the empty mask first."""
    return np.array([sum(1 << b for b in bits) for n in range(distance + 1) for bits in combinations(range(64), n)], np.uint64)


def links_by_neighbours(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) spanning exactly the components of pairs within the distance, without buckets.

    Two words differ in at most d bits if and only if some word lies within floor(d/2) bits of one
    and ceil(d/2) of the other. So every fingerprint is sent to all words within ceil(d/2) bits; at
    each such word, if any came from within floor(d/2) bits, one of those links to all that came.
    A word gets no more fingerprints than there are words around it, and none meets another twice
    for nothing: rows grow in proportion to fingerprints.
    """
    near = _near_words(-(-distance // 2))
    inner = len(_near_words(distance // 2))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(0))
            for at in range(0, len(own), 100):
                some = own[at : at + 100]
                words = (some.view(np.uint64)[:, None] ^ near[None, :]).reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.repeat(some, len(near))), pa.array(np.tile(np.arange(len(near)) < inner, len(some)))], names=["word", "fp", "inner"])

    sent = fps.select("fp").mapInArrow(spread, "word long, fp long, inner boolean")
    at_word = sent.groupBy("word").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("hub"), F.collect_set("fp").alias("all"))
    return at_word.where("hub IS NOT NULL AND size(all) > 1").select(F.col("hub").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within the distance that span all components of such pairs.

    fps: fp long, distinct.
    """
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in block_masks(blocks, distance)])
    keyed = fps.select("fp", F.posexplode(masks).alias("mask", "bits")).select("fp", F.xxhash64(F.col("fp").bitwiseAND(F.col("bits")), "mask").alias("key"))
    sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    pairs = sizes.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    many = sizes.where("n > 2").select(F.col("key").alias("_key"), "n")
    kept = keyed.join(many, F.col("key") == F.col("_key"))
    small = kept.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("all"))
    found = pairs.unionByName(small.select("all").mapInArrow(_bucket_links, "a long, b long"))
    if not sizes.where(F.col("n") > bucket).isEmpty():
        found = found.unionByName(links_by_neighbours(kept.where(F.col("n") > bucket).select("fp").distinct(), distance))
    return found.distinct()


def components_of(rows: DataFrame, distance: int, first: Column) -> DataFrame:
    """(fp, first: the least value of that column in the component) of every fingerprint of rows whose component has more than one row."""
    distinct = materialize(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    joined = connected_components(links(distinct.select("fp"), distance))
    linked = distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component"))
    # a component's rows meet only as partial sums, and in a join that adaptive execution can split
    groups = linked.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("rows")).where("rows > 1").select(F.col("component").alias("_component"), F.col("first").alias("_first"))
    return linked.join(groups, F.col("component") == F.col("_component")).select(F.col("fp").alias("_fp"), "_first")


def near_groups(docs: DataFrame, distance: int = DISTANCE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id.

    component_id is the smallest doc_id that can be reached over links between fingerprints that
    differ in at most `distance` bits, the document itself included. Null and empty texts share
    fingerprint 0 and are linked like any other. Null doc_ids count as none: a component of them
    alone has a null component_id. Rows that repeat are returned as often. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, text, id_col), "fingerprints")
    known = components_of(rows, distance, F.col("doc_id"))
    return rows.join(known, F.col("fp") == F.col("_fp"), "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("_fp").isNull(), F.col("doc_id")).otherwise(F.col("_first")).alias("component_id"))


def wide_fingerprint(names: np.ndarray, words: Words, texts: int) -> np.ndarray:
    """For each text four words of 64 bits: a SimHash of 256 bits over its distinct words, whose hashes are given; zeros for a text without any."""
    order = np.lexsort((names, words.text))
    names, text = names[order], words.text[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    names, text = names[new], text[new]
    out = np.zeros((texts, 4), np.uint64)
    if len(names):
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        sizes = np.diff(np.append(first, len(text)))
        for i in range(4):
            bits = np.unpackbits(mix(names + np.uint64((i + 1) * _SEED)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
            out[text[first], i] = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def shingle_sets(names: np.ndarray, words: Words, width: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its shingles, from those of its words; of fewer words the whole sequence, of none nothing."""
    n = max(len(names) - width + 1, 0)
    found, out = np.zeros(n, np.uint64), []
    for i in range(width):
        found = mix(found + names[i : i + n])
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(found[a : b - width + 1]))
        else:
            whole = np.zeros(min(b - a, 1), np.uint64)
            for x in names[a:b]:
                whole = mix(whole + x)
            out.append(whole)
    return out


def _hashed(column: pa.Array) -> Iterator[tuple[np.ndarray, Words]]:
    """(hashes of words, words) of some texts of a column at a time, A-Z in lower case."""
    data, offsets = texts_of(column)
    for a, b in steps(offsets):
        lower = LOWER[data[offsets[a] : offsets[b]]]
        words = find_words(lower, offsets[a : b + 1] - offsets[a])
        yield hash_words(lower, words), words


def common_shingles(named: DataFrame, row: str, text: str = "text") -> np.ndarray:
    """Hashes of shingles that many texts have, the rarest first, COMMON at most.

    They are counted in one text of up to EVERY. They only order shingles, see `rare_first`: whatever they are, no link is lost.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for names, words in _hashed(batch.column(0)) for x in shingle_sets(names, words)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["shingle"])

    every = min(EVERY, max(1, named.count() // 8192))
    some = named.where(F.pmod(F.xxhash64(*place_of(row)), F.lit(every)) == 0).select(F.col(text).alias("text"))
    often = some.mapInArrow(shingles, "shingle long").groupBy("shingle").count().where("count > 3").orderBy(F.desc("count"), "shingle").limit(COMMON)
    return often.select("shingle").toArrow().column(0).to_numpy()[::-1].view(np.uint64)


def rare_first(sets: list[np.ndarray], common: tuple[np.ndarray, np.ndarray], least: float) -> list[np.ndarray]:
    """Of each set the first shingles in one order of all shingles, sorted in it: those of `common` come last. Two sets of that similarity share one of these.

    common: shingles, sorted by hash, and their places, as two arrays. At least `least` of a set's n
    shingles are in the other set too, so they cannot all come after its first n - ceil(least * n) + 1.
    Empty sets share a shingle 0.
    A shingle is given by its place in the order, for which one bit of its hash is left out: shingles
    that so fall together make candidates, and lose none.
    """
    shingles, places = common
    whole = np.concatenate([np.zeros(0, np.uint64), *sets])
    order = whole >> np.uint64(1)
    if len(shingles):
        at = np.minimum(np.searchsorted(shingles, whole), len(shingles) - 1)
        known = shingles[at] == whole
        order[known] = places[at[known]] | np.uint64(1 << 63)
    out, end = [], 0
    for x in sets:
        end, n = end + len(x), len(x)
        out.append(np.sort(order[end - n : end])[: n - math.ceil(least * n * (1 - _SLACK)) + 1] if n else np.zeros(1, np.uint64))
    return out


def parities(shingles: np.ndarray) -> np.ndarray:
    """PARITIES bits of a set, in words of 64: where two sets have unlike bits, one has a shingle that the other hasn't."""
    odd = np.bincount((shingles >> np.uint64(32)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_fingerprints(docs: DataFrame, place: str, least: float = SIMILAR, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, w0 to w3, size, rare, odd, file, at) of every row: its wide fingerprint, how many shingles it has, their parities, and the first of them in an order by which any two sets of that similarity share one; place: a struct (file, at) that tells rows apart."""
    often = common_shingles(docs, place, text)
    by_hash = np.argsort(often)
    common = often[by_hash], by_hash.astype(np.uint64)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, rare, odd = [np.zeros((0, 4), np.uint64)], [], [], [np.zeros(0, np.int64)]
            for names, words in _hashed(batch.column(1)):
                sets = shingle_sets(names, words)
                found.append(wide_fingerprint(names, words, len(sets)))
                sizes += [len(x) for x in sets]
                rare += rare_first(sets, common, least)
                odd += [parities(x) for x in sets]
            wide = np.concatenate(found).view(np.int64)
            spans = pa.array(np.cumsum([0] + [len(x) for x in rare]), pa.int32())
            lists = pa.ListArray.from_arrays(spans, pa.array(np.concatenate([np.zeros(0, np.uint64), *rare]).view(np.int64)))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * (PARITIES // 64), pa.int32()), pa.array(np.concatenate(odd)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(wide[:, i]) for i in range(4)], pa.array(sizes, pa.int64()), lists, bits, *batch.columns[2:]], names=["doc_id", "w0", "w1", "w2", "w3", "size", "rare", "odd", *batch.schema.names[2:]])

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), *place_of(place)]
    return docs.select(*columns).mapInArrow(compute, "doc_id long, w0 long, w1 long, w2 long, w3 long, size long, rare array<long>, odd array<long>, file long, at long")


def _key_blocks() -> np.ndarray:
    """Which four of the PARTS blocks make each key: rounds in which every block has a turn, each with another order of them."""
    rng = np.random.default_rng(WIDTH)
    return np.concatenate([rng.permutation(PARTS).reshape(-1, 4) for _ in range(ROUNDS)])


def wide_keys(rows: DataFrame) -> DataFrame:
    """(key, id): each wide fingerprint under every choice of four blocks."""
    chosen = _key_blocks()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                some = batch.slice(at, 2000)
                bits = np.unpackbits(np.column_stack([np.asarray(some.column(i + 1)) for i in range(4)]).view(np.uint8), axis=1, bitorder="little")
                blocks = bits[:, : PARTS * PART_BITS].reshape(len(some), PARTS, PART_BITS) @ (1 << np.arange(PART_BITS, dtype=np.int64))
                key = np.zeros((len(some), len(chosen)), np.int64)
                for i in range(4):
                    key = key << PART_BITS | blocks[:, chosen[:, i]]
                key |= np.arange(len(chosen), dtype=np.int64) << 4 * PART_BITS
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), pa.array(np.repeat(np.asarray(some.column(0)), len(chosen)))], names=["key", "id"])

    return rows.select("id", "w0", "w1", "w2", "w3").mapInArrow(spread, "key long, id long")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _may_be_near(least: float, place: str | None = None) -> Column:
    """Whether rows of size and _size shingles may be that similar; with place and _place, if the shingle there is the first that they share."""
    left = [F.col(x) if place is None else F.col(x) - F.col(x.replace("size", place)) for x in ("size", "_size")]
    return F.least(*left) >= F.lit(least / (1 + least) * (1 - _SLACK)) * (F.col("size") + F.col("_size"))


def simhash_pairs(rows: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(a, b): ids of rows that share a key and differ in at most WIDE_DISTANCE bits, as stars around the least id of each key, as far as their sizes allow that similarity."""
    keyed = wide_keys(rows)
    sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n > 1"), "buckets")
    many = sizes.where("n > 2").select(F.col("key").alias("_key"), "a")
    # not small_side: both tables grow with rows, so the join is the same at any size
    stars = keyed.join(many, F.col("key") == F.col("_key")).where("id <> a").select("a", F.col("id").alias("b"))
    pairs = materialize(sizes.where("n = 2").select("a", "b").unionByName(stars).distinct(), "candidates")
    for side, size in (("a", "size"), ("b", "_size")):
        known = rows.select(F.col("id").alias(f"id_{side}"), F.col("size").alias(size), *[F.col(f"w{i}").alias(f"{side}{i}") for i in range(4)])
        pairs = pairs.join(known, F.col(side) == F.col(f"id_{side}"))
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(4)), F.lit(0))
    return pairs.where((apart <= WIDE_DISTANCE) & _may_be_near(least)).select("a", "b")


def _with_component(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """rows with the column component: that of their id, or the id itself."""
    others = [c for c in rows.columns if c != "component"]
    known = joined.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return rows.select(*others).join(known, F.col("id") == F.col("_node"), "left").select(*others, F.coalesce("_component", "id").alias("component"))


def shared_shingles(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """(key, id, place, size, component), written: the shingles of `rare` that rows of several components have, with their place there.

    joined: node, component, of the rows that have links.
    """
    rows = materialize(_with_component(rows.select("id", "size", "rare"), joined), "rare")
    keyed = rows.select("id", "size", "component", F.posexplode("rare").alias("place", "key"))
    shared = keyed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select(F.col("key").alias("_key"))
    # not small_side: both tables grow with rows, so the join is the same at any size
    return materialize(keyed.join(materialize(shared, "buckets"), F.col("key") == F.col("_key")).select("key", "id", "place", "size", "component"), "shared")


def pairs_with_least(shared: DataFrame, least: float) -> DataFrame:
    """(a, b): ids of rows that share a shingle with the least id that has it, of another component, as far as their sizes and its places allow that similarity."""
    first = shared.groupBy("key").agg(F.min(F.struct("id", "place", "size", "component")).alias("_a")).select(F.col("key").alias("_key"), *[F.col(f"_a.{c}").alias(f"_{c}") for c in ("id", "place", "size", "component")])
    return shared.join(first, F.col("key") == F.col("_key")).where((F.col("component") != F.col("_component")) & _may_be_near(least, "place")).select(F.col("_id").alias("a"), F.col("id").alias("b")).distinct()


def pairs_across(shared: DataFrame, least: float, rows: DataFrame | None = None) -> DataFrame:
    """(a, b), a the less: all pairs of ids of different components that share a shingle, as far as their sizes and its places allow that similarity.

    rows: id, odd. With these, pairs of a shingle that more than FEW rows have come only as far as
    their parities allow it too, so that a large family of texts just under the similarity gives no
    row for each of its pairs: they are compared where they meet, in blocks of about BLOCK rows.
    """
    apart = shared.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.min("component").alias("_first"), F.max("component").alias("_last")).where("_first < _last")
    apart = materialize(apart.select("_key", "_n"), "buckets")
    few, many = (apart, None) if rows is None else (apart.where(F.col("_n") <= FEW), materialize(apart.where(F.col("_n") > FEW), "buckets"))
    dealt = _in_blocks(shared, few)
    right = dealt.select(*[F.col(c).alias(f"_{c}") for c in dealt.columns])
    same = [F.col(c) == F.col(f"_{c}") for c in ("key", "i", "j")]
    once = (F.col("id") < F.col("_id")) & ((F.col("i") == F.col("j")) | (F.col("own") != F.col("_own")))
    both = dealt.join(right, [*same, F.col("component") != F.col("_component"), once, _may_be_near(least, "place")])
    pairs = both.select(F.col("id").alias("a"), F.col("_id").alias("b"))
    if rows is not None:
        members = materialize(_in_blocks(shared, many), "large")
        wanted = materialize(members.select("id").distinct(), "ids")
        odd = rows.select(F.col("id").alias("_id"), "odd").join(small_side(wanted), F.col("_id") == F.col("id"), "left_semi")
        members = members.join(odd, F.col("id") == F.col("_id"))
        groups = members.groupBy("key", "i", "j").agg(F.collect_list(F.struct("id", "place", "size", "component", "own", "odd")).alias("all")).select("all", (F.col("i") != F.col("j")).alias("across"))
        pairs = pairs.unionByName(groups.mapInArrow(_group_pairs(least), "a long, b long"))
    return pairs.distinct()


def _in_blocks(shared: DataFrame, counted: DataFrame) -> DataFrame:
    """The rows of shared whose key is in counted (_key, _n), for each pair (i, j) of blocks of that key that theirs (own) is in."""
    blocks = F.ceil(F.col("_n") / F.lit(BLOCK)).cast("long")
    dealt = shared.join(small_side(counted), F.col("key") == F.col("_key"))
    dealt = dealt.select(*shared.columns, F.pmod(F.xxhash64("id"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    return dealt.select(*shared.columns, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _group_pairs(least: float):
    """For mapInArrow: lists of rows with one shingle, of one block or two, to pairs (a, b) of their ids, as `pairs_across` has them."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, across = batch.column(0), batch.column(1).to_pylist()
            ends = np.cumsum(lists.value_lengths().to_numpy())
            fields = dict(zip(("id", "place", "size", "component", "own", "odd"), lists.flatten().flatten()))
            bits = fields.pop("odd").flatten().to_numpy().view(np.uint64).reshape(-1, PARITIES // 64)
            fields, found = {name: x.to_numpy() for name, x in fields.items()}, [np.zeros((0, 2), np.int64)]
            for first, end, two in zip(np.append(0, ends), ends, across):
                order = first + np.argsort(fields["id"][first:end])
                id, place, size, component, own = (x[order] for x in fields.values())
                odd, left = bits[order], size - place
                for i in range(len(order) - 1):
                    sizes = size[i] + size[i + 1 :]
                    near = (component[i + 1 :] != component[i]) & (np.minimum(left[i], left[i + 1 :]) >= least / (1 + least) * (1 - _SLACK) * sizes)
                    if two:
                        near &= own[i + 1 :] != own[i]
                    some = i + 1 + np.flatnonzero(near)
                    unlike = np.bitwise_count(odd[some] ^ odd[i]).sum(1, dtype=np.int64)
                    some = some[unlike <= (1 - least) / (1 + least) * (1 + _SLACK) * (size[i] + size[some])]
                    if len(some):
                        found.append(np.column_stack((np.full(len(some), id[i]), id[some])))
            pairs = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return compare


def verified(pairs: DataFrame, named: DataFrame, row: str, rows: DataFrame, least: float = SIMILAR, text: str = "text") -> DataFrame:
    """Those of the pairs (a, b), just written, whose sets of five-word shingles have at least that similarity, on all shingles of both whole texts.

    First go pairs whose parities are unlike in more places than so similar sets have shingles apart:
    each place takes one shingle at least, so none of that similarity goes.
    """
    both = pairs
    for side in ("a", "b"):
        both = both.join(rows.select(F.col("id").alias(f"id_{side}"), F.col("size").alias(f"size_{side}"), F.col("odd").alias(f"odd_{side}")), F.col(side) == F.col(f"id_{side}"))
    unlike = sum((F.bit_count(F.col("odd_a")[i].bitwiseXOR(F.col("odd_b")[i])) for i in range(PARITIES // 64)), F.lit(0))
    most = F.lit((1 - least) / (1 + least) * (1 + _SLACK)) * (F.col("size_a") + F.col("size_b"))
    pairs = materialize(both.where(unlike <= most).select("a", "b"), "candidates")

    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    places = materialize(rows.join(wanted, "id", "left_semi").select("id", F.col("file").alias("_file"), F.col("at").alias("_at")), "places")
    texts = named.select(F.col(text).alias("text"), *place_of(row)).join(small_side(places), (F.col("file") == F.col("_file")) & (F.col("at") == F.col("_at"))).select("id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for names, words in _hashed(batch.column(1)) for x in shingle_sets(names, words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "shingles"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array([similarity(x, y) >= least for x, y in zip(one, two)], pa.bool_()))

    known = materialize(texts.mapInArrow(sets, "id long, shingles binary"), "shingles")
    one, two = (known.select(F.col("id").alias(f"id_{x}"), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    both = pairs.join(two, F.col("b") == F.col("id_b")).join(one, F.col("a") == F.col("id_a")).select("a", "b", "of_a", "of_b")
    return both.mapInArrow(alike, "a long, b long")


def near_components(named: DataFrame, row: str, rows: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(node, component): the components of rows whose sets of five-word shingles have at least that similarity, of all rows with such links.

    rows: what `wide_fingerprints` returns of named, with a long id, just written. Rows that share a
    SimHash key meet its least id only, so candidates grow with rows. What these stars miss is found
    exactly: two rows of that similarity share one of their rare shingles, so where such a shingle
    has rows of different components, they are verified and joined, first with the least id that
    has it, then all pairs that are still apart.
    """
    spark, before = rows.sparkSession, written(rows.sparkSession)
    links = materialize(verified(materialize(simhash_pairs(rows, least), "candidates"), named, row, rows, least), "links")
    keep_last(spark, before)
    before = written(spark)
    joined = connected_components(links)
    keep_last(spark, before)
    before = written(spark)
    shared, seen = shared_shingles(rows, joined), None
    keep_last(spark, before)
    for candidates in (pairs_with_least, partial(pairs_across, rows=rows)):
        before = written(spark)
        pairs = candidates(shared, least)
        if seen is not None:
            pairs = pairs.join(seen.select(F.col("a").alias("_a"), F.col("b").alias("_b")), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")
        seen = materialize(pairs, "candidates")
        keep_last(spark, before)
        before = written(spark)
        more = materialize(verified(seen, named, row, rows, least), "links")
        keep_last(spark, before)
        if not more.isEmpty():
            links = links.unionByName(more)
            before = written(spark)
            joined = connected_components(links)
            keep_last(spark, before)
            shared = _with_component(shared, joined)
    return joined


def keep_one_of_each(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Of each component of near duplicates the row with the smallest doc_id, with all its columns.

    Rows are near if the sets of five-word shingles of their whole texts, A-Z in lower case, have a
    Jaccard similarity of `least` or more (texts of fewer words: if they are the same words); texts
    without words, null included, are one group. No such pair is lost: most come from keys of SimHash
    fingerprints of 256 bits over distinct words, the rest by shared rare shingles, exactly (see
    `near_components`). Rows are told apart by where they stand in their files; of several with that
    doc_id, or of a component without any doc_id, the first in the files stays. An empty table stays
    empty; other columns may have any names.
    """
    named, row = with_row(docs)
    before = written(docs.sparkSession)
    rows = materialize(wide_fingerprints(named, row, least).withColumn("id", F.monotonically_increasing_id()), "fingerprints")
    joined = near_components(named, row, rows, least)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "file", "at")
    members = materialize(rows.join(joined, F.col("id") == F.col("node")).select("component", order.alias("row")), "members")
    stays = members.groupBy(F.col("component").alias("_component")).agg(F.min("row").alias("first"))
    gone = members.join(stays, F.col("component") == F.col("_component")).where(F.col("row") != F.col("first")).select("row.file", "row.at")
    gone = materialize(gone, "gone")
    del rows, joined, members, stays
    keep_last(docs.sparkSession, before)
    return at_places(named, row, gone, "left_anti").select(*docs.columns)
