"""Display order of decoded frames: in a batch by a window, in a stream by keyed state.

A frame carries the low bits of its display order. The session restores the whole order from the
highest one seen, keeps frames that have to wait in a buffer of SLOTS, and emits a frame once its
turn has come: those before it first, then those that directly follow. A new sequence emits all
that waits and begins anew; an error drops it. What still waits when a stream's input is used up is
read from the stored state and emitted by a batch query, so streams need no mark at their end.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frames of a stream; bits of the order that a frame carries; frames that may wait.
FRAMES, BITS, SLOTS = 256, 6, 8
#: What a row of a session says: a frame, that a new sequence begins, or that the input was faulty.
FRAME, NEW_SEQUENCE, ERROR = "frame", "new sequence", "error"
_OUT = "stream_id long, decode_ord long, disp_order long, out_seq long, error boolean"
_STATE = "seq long, highest long, waiting array<struct<decode_ord:bigint,disp_order:bigint>>"


def frames(events: DataFrame) -> DataFrame:
    """(stream_id, decode_ord, hint, disp_order): the events as frames that are decoded up to three places off their order."""
    order = F.col("event_id") % FRAMES
    shown = order.bitwiseXOR(F.lit(3))
    return events.select(F.floor(F.col("event_id") / FRAMES).cast("bigint").alias("stream_id"), order.alias("decode_ord"), (shown % (1 << BITS)).alias("hint"), shown.alias("disp_order"))


def display_order(decoded: DataFrame) -> DataFrame:
    """The place of each frame in its stream's display order, from the whole order."""
    seq = F.row_number().over(Window.partitionBy("stream_id").orderBy("disp_order")) - 1
    return decoded.select("stream_id", "decode_ord", "disp_order", seq.cast("bigint").alias("out_seq"))


def broken_frames(events: DataFrame) -> DataFrame:
    """(stream_id, decode_ord, hint, kind): frames whose order begins anew every 96 events, where a new sequence begins; every 61st event is a fault."""
    number = F.col("event_id") % FRAMES
    shown = (number % 96).bitwiseXOR(F.lit(3))
    kind = F.when(F.col("event_id") % 61 == 60, ERROR).when((number % 96 == 0) & (number > 0), NEW_SEQUENCE).otherwise(FRAME)
    return events.select(F.floor(F.col("event_id") / FRAMES).cast("bigint").alias("stream_id"), number.alias("decode_ord"), (shown % (1 << BITS)).alias("hint"), kind.alias("kind"))


def restore(hint: int, highest: int) -> int:
    """The least order with these low bits that is above the highest so far less half a turn; never below the hint itself."""
    turn = 1 << BITS
    low = highest - turn // 2 + 1
    return max(hint, low + (hint - low) % turn)


class Session:
    """The state of one stream: what waits, the highest order so far, and how many frames are out."""

    def __init__(self, seq: int = 0, highest: int = 0, waiting=()):
        self.seq, self.highest, self.waiting = seq, highest, [tuple(w) for w in waiting]

    def push(self, decode_ord: int, hint: int) -> Iterator[tuple]:
        order = restore(hint, self.highest)
        self.highest = max(self.highest, order)
        self.waiting.append((decode_ord, order))
        if len(self.waiting) > SLOTS:
            yield from self._emit(min(self.waiting, key=lambda w: w[1]))

    def _emit(self, trigger: tuple[int, int]) -> Iterator[tuple]:
        """The trigger, those before it and those that directly follow, in display order."""
        ready, reach = [], trigger[1]
        for w in sorted(self.waiting, key=lambda w: w[1]):
            if w[1] <= reach + (w[1] > trigger[1]):
                ready.append(w)
                reach = max(reach, w[1])
        for w in ready:
            self.waiting.remove(w)
            yield (*w, self.seq, False)
            self.seq += 1

    def flush(self) -> Iterator[tuple]:
        """All that waits, in display order."""
        if self.waiting:
            yield from self._emit(max(self.waiting, key=lambda w: w[1]))

    def new_sequence(self) -> Iterator[tuple]:
        """What waits comes out, and orders begin anew."""
        yield from self.flush()
        self.highest = 0

    def fail(self, decode_ord: int) -> Iterator[tuple]:
        """What waits is lost, orders begin anew, and a row says so."""
        self.waiting, self.highest = [], 0
        yield decode_ord, None, None, True


def reorder(decoded: DataFrame) -> DataFrame:
    """A stream of rows (stream_id, decode_ord, hint, kind) in display order; what waits at the end stays in the state.

    Rows of a stream must arrive in decode order from one micro-batch to the next; inside a
    micro-batch they are sorted. A null kind is a frame. An error gives a row with error and
    decode_ord only.
    """

    def step(key, chunks, state):
        rows = pd.concat(list(chunks)).sort_values("decode_ord")
        now = Session(*state.get) if state.exists else Session()
        out = []
        for decode_ord, hint, kind in zip(rows["decode_ord"], rows["hint"], rows["kind"]):
            if kind == ERROR:
                out += now.fail(int(decode_ord))
                continue
            if kind == NEW_SEQUENCE:
                out += now.new_sequence()
            out += now.push(int(decode_ord), int(hint))
        state.update((now.seq, now.highest, now.waiting))
        found = pd.DataFrame([(key[0], *o) for o in out], columns=["stream_id", "decode_ord", "disp_order", "out_seq", "error"])
        yield found.astype({"disp_order": "Int64", "out_seq": "Int64"})

    return decoded.groupBy("stream_id").applyInPandasWithState(step, _OUT, _STATE, "append", "NoTimeout")


def left_waiting(spark: SparkSession, state: str) -> DataFrame:
    """The rows that a stream's end would emit: what the state in a checkpoint still holds, in display order."""
    held = spark.read.format("statestore").load(state).select("key.stream_id", F.col("value.groupState.*"))
    each = held.select("stream_id", "seq", F.posexplode(F.array_sort(F.transform("waiting", lambda w: F.struct(w["disp_order"].alias("disp_order"), w["decode_ord"].alias("decode_ord"))))).alias("k", "w"))
    return each.select("stream_id", "w.decode_ord", "w.disp_order", (F.col("seq") + F.col("k")).alias("out_seq"), F.lit(False).alias("error"))


def run_stream(spark: SparkSession, path: str, decode=frames, files_per_trigger: int | None = None) -> DataFrame:
    """Read a table of events as a stream until its files are used up, reorder, write to a table of files, and read that with what still waits.

    path: a Parquet file or a folder of them. decode: from events to rows (stream_id, decode_ord,
    hint[, kind]). files_per_trigger: files of a micro-batch at most; the result doesn't depend on it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='spark-session-')}"
    base = f"{shared}/session-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a pattern, since a stream takes a single file by a pattern only
    found = decode(reader.parquet(f"{path[:-1]}[{path[-1]}]"))
    kind = F.col("kind") if "kind" in found.columns else F.lit(FRAME)
    rows = found.select("stream_id", "decode_ord", "hint", F.coalesce(kind, F.lit(FRAME)).alias("kind"))
    done = reorder(rows).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(_OUT).parquet(f"{base}/out").unionByName(left_waiting(spark, f"{base}/state"))
