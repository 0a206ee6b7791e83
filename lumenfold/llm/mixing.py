"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source starts with the same number of copies, target / size of its source,
whose fractional part is rounded. Two documents with fractions meet, and as many words as make one
of them integral move from one to the other, in a random direction that keeps both expectations;
so a source's words change only in its very last document. Documents of a source meet in groups of
about FAN, what is left of each group meets again in the next level, and so on: a reduction tree.
The last document is rounded together with the one of the last group whose change makes up best for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, at_places, materialize, place_of, running, small_side, unused, with_row

#: Weights of sources in code-point order, repeating; share of all words that the mix takes; most copies.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Documents that meet in one group, about.
FAN = 64

_DOC = "struct<size:bigint,doc_id:bigint,hash:bigint,file:bigint,at:bigint,p:double>"
_DONE = "array<struct<doc_id:bigint,size:bigint,file:bigint,at:bigint,up:boolean>>"


def sized(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", place: str | None = None) -> DataFrame:
    """(hash, doc_id, source, size): the number of words of every text, and a hash of it, the same wherever the text is read.

    place: a struct (file, at) that tells rows apart, whose fields are added.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.xxhash64(F.col(text)).alias("hash"), F.col(id_col).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), *place_of(place))


_SAME = ("hash", "doc_id", "source", "size")


def apart(rows: DataFrame) -> DataFrame:
    """rows with (file, at, salt): those that are equal in all of `sized` are numbered, so that a third of all rows being equal deals no group more than its share."""
    times = rows.groupBy(*_SAME).agg(F.count(F.lit(1)).alias("_n"))
    at = times.select(*_SAME, "_n", F.lit(0).cast("long").alias("file"), F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("at"))
    return at.withColumn("salt", F.when(F.col("_n") > 1, F.col("at")).otherwise(0)).drop("_n")


def apart_by_place(rows: DataFrame) -> DataFrame:
    """The same for rows that have places of their own: these tell equal rows apart."""
    names = [f"_{c}" for c in _SAME]
    repeated = small_side(materialize(rows.groupBy(*_SAME).count().where("count > 1").select(*_SAME).toDF(*names), "repeated"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(_SAME, names)])
    joined = rows.join(repeated.withColumn("_again", F.lit(True)), same, "left")
    return joined.select(*rows.columns, F.when(F.col("_again"), F.xxhash64("file", "at")).otherwise(0).alias("salt"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, documents, target, whole, part) of every source, however many there are.

    Targets are level * weight, except where that is above most * size; sources stop there in the
    order of size / weight, and the level is the first that needs no further stop.
    """
    every = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("documents"))
    every = running(every.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], {"rank": "one"}, "ranked")
    every = every.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    every = every.withColumn("stop", most * F.col("source_size")).withColumn("until", F.col("stop") / F.col("weight"))
    every = materialize(running(every, [F.col("until"), F.col("source").asc_nulls_last()], {"stopped": "stop", "past": "weight"}, "filled"), "levels")
    sums = every.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(share * (sums["size"] or 0)) - F.col("stopped")) / (F.lit(sums["weight"] or 1) - F.col("past"))
    first = every.where(level <= F.col("until")).agg(F.min_by(level, F.struct("until", F.col("source").isNull().alias("last"), "source"))).first()[0]
    target = F.least(F.col("stop").cast("double"), F.lit(float("inf") if first is None else first) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return every.withColumn("target", target).select("source", "source_size", "documents", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part"))


def _meet(items: str, seed: int) -> Column:
    """Fold an array of documents, largest first, into (c: the one left with a fraction, out: those that are settled).

    The random number of a meeting hashes what both documents are and how many meetings came before, so that equal rows meet at random too.
    """
    settle = "named_struct('doc_id', {0}.doc_id, 'size', {0}.size, 'file', {0}.file, 'at', {0}.at, 'up', {1})"
    stay = "named_struct('size', {0}.size, 'doc_id', {0}.doc_id, 'hash', {0}.hash, 'file', {0}.file, 'at', {0}.at, 'p', greatest(0D, least(1D, {1})))"
    return F.expr(f"""
      aggregate(slice({items}, 2, size({items})), named_struct('c', {items}[0], 'out', CAST(array() AS {_DONE})), (a, x) ->
        element_at(transform(array(named_struct(
            'c_up', (1 - a.c.p) * a.c.size, 'c_down', a.c.p * a.c.size, 'x_up', (1 - x.p) * x.size, 'x_down', x.p * x.size,
            'u', shiftrightunsigned(xxhash64(a.c.doc_id, x.doc_id, a.c.hash, x.hash, size(a.out), {seed}), 11) / 9007199254740992D)), s ->
          element_at(transform(array(s.u * (least(s.c_up, s.x_down) + least(s.c_down, s.x_up)) < least(s.c_down, s.x_up)), up ->
            IF(IF(up, s.c_up <= s.x_down, s.c_down <= s.x_up),
              named_struct('c', {stay.format("x", "IF(up, x.p - s.c_up / x.size, x.p + s.c_down / x.size)")}, 'out', concat(a.out, array({settle.format("a.c", "up")}))),
              named_struct('c', {stay.format("a.c", "IF(up, a.c.p + s.x_down / a.c.size, a.c.p - s.x_up / a.c.size)")}, 'out', concat(a.out, array({settle.format("x", "NOT up")}))))), 1)), 1))
    """)


def _close() -> Column:
    """(off, at, up): how to round the last document c, and which place of `out` in the last group to change (-1: none), to be nearest the target."""
    return F.expr("""
      array_min(flatten(transform(array(false, true), up ->
        transform(concat(array(named_struct('at', -1, 'gain', 0L)), transform(out, (o, i) -> named_struct('at', i, 'gain', IF(o.up, -o.size, o.size)))), o ->
          named_struct('off', abs((IF(up, 1, 0) - c.p) * c.size + o.gain), 'at', o.at, 'up', up)))))
    """)


def _mixed(rows: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: int) -> DataFrame:
    """(source, doc_id, size, file, at, source_size, target, copies) of rows as `apart` gives them."""
    goals = materialize(targets(rows, weights, share, most), "targets")
    known = small_side(goals.withColumnRenamed("source", "_source"))
    same = F.col("source").eqNullSafe(F.col("_source"))
    at = rows.join(known, same, "left")
    fraction = (F.col("size") > 0) & (F.col("part") > 0)
    groups = F.greatest(F.lit(1), F.ceil(F.col("documents") / FAN))
    slot = F.pmod(F.xxhash64("doc_id", "hash", "salt", F.lit(seed)), groups)
    meeting = at.where(fraction).select("source", slot.alias("slot"), groups.alias("groups"), F.struct("size", "doc_id", "hash", "file", "at", F.col("part").alias("p")).cast(_DOC).alias("doc"))
    most_documents = goals.agg(F.max("documents")).first()[0] or 0
    columns = ("source", "doc_id", "size", "file", "at", "up")
    settled = [at.where(~fraction).withColumn("up", F.lit(False)).select(*columns)]
    level, left = 0, -(-most_documents // FAN)
    while True:
        met = meeting.groupBy("source", "slot", "groups").agg(F.sort_array(F.collect_list("doc"), asc=False).alias("items"))
        met = materialize(met.withColumn("met", _meet("items", seed + level)).select("source", "slot", "groups", "met.c", "met.out"), f"met{level}")
        if left <= 1:
            break
        settled.append(met.select("source", F.inline("out")).select(*columns))
        groups = F.greatest(F.lit(1), F.ceil(F.col("groups") / FAN))
        meeting = met.select("source", F.pmod(F.xxhash64("slot", F.lit(seed)), groups).alias("slot"), groups.alias("groups"), F.col("c").alias("doc"))
        left, level = -(-left // FAN), level + 1
    last = met.withColumn("close", _close())
    changed = F.expr("transform(out, (o, i) -> named_struct('doc_id', o.doc_id, 'size', o.size, 'file', o.file, 'at', o.at, 'up', o.up <> (i = close.at)))").cast(_DONE)
    settled.append(last.select("source", F.inline(changed)).select(*columns))
    settled.append(last.select("source", "c.doc_id", "c.size", "c.file", "c.at", "close.up"))
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    return every.join(known, same, "left").select("source", "doc_id", "size", "file", "at", "source_size", "target", (F.col("whole") + F.col("up").cast("int")).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 5, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, copies.

    A document is taken 0 to `most` times, whole. The last document of a source that is left with a
    fraction goes to the nearer number, unless changing another of its group as well comes nearer
    still, so a source misses its target by half of that document at most. Null text has size 0 and takes nothing; null is a source of its own, the last; rows that
    share a doc_id are rounded on their own; an empty table gives no rows. Equal tables give equal
    mixes however they are split: doc_id, text and source alone decide, and rows that are equal in
    these stand for each other: they are numbered. Groups are dealt by all of these, so no key makes a large one.
    """
    rows = materialize(apart(sized(docs, text, id_col, source)), "sizes")
    return _mixed(rows, weights, share, most, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def repeat_by_mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns.

    Rows are told apart by where they stand in their files, so rows that repeat, or share a doc_id
    or a null one, are rounded each on its own; documents without words are taken once. An empty
    table gives no rows. Other columns may have any names.
    """
    named, row = with_row(docs)
    times = unused("_rows_copies", named)
    rows = materialize(apart_by_place(materialize(sized(named, place=row), "sizes")), "sizes")
    copies = _mixed(rows, WEIGHTS, SHARE, MOST, 5).select("file", "at", F.when(F.col("size") > 0, F.col("copies")).otherwise(1).cast("int").alias(times)).where(F.col(times) > 0)
    joined = at_places(named, row, materialize(copies, "copies"), "inner")
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(f"{times}_n")).select(*docs.columns)
