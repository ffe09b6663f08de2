"""Structured Streaming forms. Each equals its batch twin on the same rows in event-time order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.bitstream import PPS, SPS, frame_size, split_units


def stream_mix(samples: DataFrame, tick: str = "20 milliseconds", watermark: str = "1 second") -> DataFrame:
    """Per mix and tick the sum of the samples there (mix_id, ts, v), clipped to -1 .. 1, and how many
    inputs had some. Samples later than the watermark are dropped."""
    late = samples.withWatermark("ts", watermark)
    total = late.groupBy("mix_id", F.window("ts", tick).alias("w")).agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    return total.select("mix_id", F.col("w.start").alias("tick"), F.greatest(F.least("s", F.lit(1.0)), F.lit(-1.0)).alias("v"), "n")


def stream_event_counts(events: DataFrame, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Errors and drops per element (element_id, event, ts) and window of a live bus."""
    kept = events.where(F.col("event").isin("Error", "Dropped")).withWatermark("ts", watermark)
    out = kept.groupBy("element_id", F.window("ts", window).alias("w")).agg(F.count_if(F.col("event") == "Error").alias("errors"), F.count_if(F.col("event") == "Dropped").alias("drops"))
    return out.select("element_id", F.col("w.start").alias("window_start"), "errors", "drops")


class LatestFrame(StatefulProcessor):
    """State: the place of an input's newest event and its frame_id, null after an end or a seek. The
    place is kept then too, so that a frame from before the end, arriving late, doesn't live again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "seq long, frame_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in rows:  # chunk by chunk: a hot input is never held as a whole
            top = pdf.iloc[int(pdf["seq"].to_numpy().argmax())]
            last = top if last is None or top["seq"] >= last["seq"] else last
        if last is None or (self.newest.exists() and self.newest.get()[0] > last["seq"]):
            return
        frame = int(last["frame_id"]) if last["event"] == "frame" else None
        self.newest.update((int(last["seq"]), frame))
        yield pd.DataFrame({"input": [key[0]], "seq": [int(last["seq"])], "frame_id": pd.array([frame], dtype="Int64")})

    def close(self) -> None:
        pass


def stream_latest(frames: DataFrame) -> DataFrame:
    """After each batch the newest frame of each input (input, seq, event, frame_id) that changed;
    null after an event other than 'frame'. Rows may arrive in any order: the highest seq counts."""
    return frames.groupBy("input").transformWithStateInPandas(LatestFrame(), "input long, seq long, frame_id long", "Update", "None")


#: Buckets to which streams are dealt by a hash. Every call for a key of the state costs some ten milliseconds,
#: whatever it holds; a bucket has many streams and few enough rows.
BUCKETS = 512


def _packs(rows: pa.Table) -> list[tuple]:
    """``rows`` as Arrow streams of some thousand rows each."""
    out = []
    for batch in rows.combine_chunks().to_batches(max_chunksize=8192):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_batch(batch)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpacked(packs: Iterator[tuple], types: dict[str, pa.DataType]) -> pa.Table:
    return pa.concat_tables([pa.schema(types).empty_table(), *(pa.ipc.open_stream(bytes(p[0])).read_all() for p in packs)])


def _tuples(rows: pa.Table) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in rows.columns), strict=True)


class InOrder(StatefulProcessor):
    """Hands the rows of each stream on in the order of their event time, however they arrive.

    The key is a bucket of streams. State: the rows that the watermark hasn't passed, and what ``take``
    keeps of each stream. A timer at the time of the first of a batch's rows, or of those that stay,
    releases all that are due, in order of the first of ``types``: stream_id, ms, the event time in
    milliseconds, and others. What is held is bounded by the watermark's delay; rows that come later than that
    are dropped by Spark, as in any windowed aggregation."""

    #: Of the rows, stream_id and ms first, and of what is kept of a stream, its stream_id first.
    types: dict[str, pa.DataType]
    kept_types: dict[str, pa.DataType]
    out: dict[str, str]
    #: How many of the columns give the order.
    ordered = 4

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Rows go to the state in packs: as rows of their own each would be pickled and converted singly.
        self.held = handle.getListState("held", "rows binary")
        self.kept = handle.getListState("kept", "rows binary")

    def take(self, stream: int, kept: tuple | None, rows: Iterator[tuple], out: list[tuple]) -> tuple | None:
        """Adds to ``out`` what follows from a stream's next rows, which are in order; gives what is kept of it now."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for pdf in rows:
            if len(pdf):
                self.held.appendList(_packs(pa.Table.from_pandas(pdf[list(self.types)], pa.schema(self.types), preserve_index=False)))
                first.append(int(pdf["ms"].min()))
        if first:
            self._wake_at(min(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = _unpacked(self.held.get(), self.types)
        is_due = pc.less_equal(rows["ms"], passed)
        due, later = rows.filter(is_due), rows.filter(pc.invert(is_due))
        if not len(due):  # an earlier timer has released them
            return
        if len(later):
            self.held.put(_packs(later))
            self._wake_at(pc.min(later["ms"]).as_py(), passed)
        else:
            self.held.clear()
        kept, out = {k[0]: k[1:] for k in _tuples(_unpacked(self.kept.get(), self.kept_types))}, []
        in_order = due.sort_by([(c, "ascending") for c in list(self.types)[: self.ordered]])
        for stream, own in groupby(_tuples(in_order), itemgetter(0)):
            kept[stream] = self.take(stream, kept.get(stream), own, out)
        if left := [(stream, *k) for stream, k in kept.items() if k is not None]:
            columns = zip(zip(*left, strict=True), self.kept_types.values(), strict=True)
            self.kept.put(_packs(pa.table([pa.array(c, t) for c, t in columns], names=list(self.kept_types))))
        else:
            self.kept.clear()
        if out:
            yield self._frame(out)

    def _wake_at(self, ms: int, passed: int | None = None) -> None:
        """One timer is enough; those up to ``passed`` are going off now."""
        if not any(t <= ms and (passed is None or t > passed) for t in self.handle.listTimers()):
            self.handle.registerTimer(ms)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        columns = list(zip(*rows, strict=True))
        return pd.DataFrame({c: pd.array(v, dtype=t) if t else pd.Series(list(v), dtype=object) for (c, t), v in zip(self.out.items(), columns, strict=True)})

    def close(self) -> None:
        pass


def _in_buckets(rows: DataFrame, buckets: int, processor: InOrder, schema: str) -> DataFrame:
    dealt = rows.withColumn("stream_id", F.col("stream_id").cast("bigint")).withColumn("bucket", F.pmod(F.xxhash64("stream_id"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(processor, schema, "Append", "EventTime")


class Segmenter(InOrder):
    """Kept: number and start of the open segment, its packets and bytes so far."""

    types = dict.fromkeys(["stream_id", "ms", "pts", "seq"], pa.int64()) | dict.fromkeys(["is_cut", "is_end"], pa.bool_()) | {"size": pa.int64()}
    kept_types = dict.fromkeys(["stream_id", "segment", "start", "packets", "bytes"], pa.int64())
    out = dict.fromkeys(["stream_id", "segment", "start_pts", "packets", "bytes"], "Int64")

    def __init__(self, duration: int):
        self.duration = duration

    def take(self, stream, kept, rows, out) -> tuple | None:
        for _, _, pts, _, is_cut, is_end, size in rows:
            if kept is None:
                kept = (0, pts, 0, 0)
            elif is_cut and pts - kept[1] >= self.duration:
                out.append((stream, *kept))
                kept = (kept[0] + 1, pts, 0, 0)
            kept = (kept[0], kept[1], kept[2] + 1, kept[3] + size)
            if is_end:
                out.append((stream, *kept))
                kept = None
        return kept


def stream_segment(packets: DataFrame, duration: int, buckets: int = BUCKETS) -> DataFrame:
    """Closed segments of live packets (stream_id, ts, pts, seq, kind, is_key, size, has_video, is_end),
    which may arrive in any order within the watermark of ts. A stream without video (has_video is known
    from its tracks) may cut at any packet. The open segment stays in the state until the stream's last
    packet (is_end) closes it; packets after that begin a stream anew. Order is that of ts, pts, seq.
    Packets without stream, ts or pts are in no segment; other nulls count as 0 or false. Streams share the
    state's keys, ``buckets`` in all, so a key has many."""
    is_cut = ~F.col("has_video") | (F.col("is_key") & (F.col("kind") == "video"))
    rows = packets.select("stream_id", "ts", F.unix_millis("ts").alias("ms"), F.col("pts").cast("bigint").alias("pts"), F.coalesce("seq", F.lit(0)).cast("bigint").alias("seq"), F.coalesce(is_cut, F.lit(False)).alias("is_cut"), F.coalesce("is_end", F.lit(False)).alias("is_end"), F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
    rows = rows.where("stream_id is not null and ts is not null and pts is not null")
    return _in_buckets(rows, buckets, Segmenter(duration), "stream_id long, segment long, start_pts long, packets long, bytes long")


class CodecProbe(InOrder):
    """Kept: the codec of the run and its number, both parameter sets seen in it, and whether it was told."""

    types = dict.fromkeys(["stream_id", "ms", "seq"], pa.int64()) | {"codec": pa.string(), "payload": pa.binary()}
    kept_types = {"stream_id": pa.int64(), "codec": pa.string(), "run": pa.int64(), "sps": pa.binary(), "pps": pa.binary(), "told": pa.bool_()}
    ordered = 3
    out = {"stream_id": "Int64", "run": "Int64", "codec": None, "ready_seq": "Int64", "sps": None, "pps": None, "width": "Int32", "height": "Int32"}

    def take(self, stream, kept, rows, out) -> tuple | None:
        codec, run, sps, pps, told = kept or (None, -1, None, None, False)
        for _, _, seq, own, payload in rows:
            if run < 0 or own != codec:
                codec, run, sps, pps, told = own, run + 1, None, None, False
            if told:
                continue
            size = (None, None)
            if codec == "H264":
                for unit in split_units(payload) if payload is not None else ():
                    if unit[0] & 31 == SPS:
                        sps = unit
                    elif unit[0] & 31 == PPS:
                        pps = unit
                size = read_size(sps) if sps is not None and pps is not None else None
            if size is not None:
                told = True
                out.append((stream, run, codec, seq, sps, pps, *size))
        return codec, run, sps, pps, told


#: A stream repeats its parameter sets: a worker reads each distinct one once.
read_size = lru_cache(maxsize=4096)(frame_size)


def stream_probe_codec(packets: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(stream_id, run, codec, ready_seq, sps, pps, width, height) of live packets (stream_id, ts, seq,
    codec, payload), once for each codec run, as soon as the watermark of ts has passed the payload that
    makes it ready; the rules are those of ``probe_codec``. The sets may come in different payloads and
    batches, which may arrive in any order within the watermark; a change of codec forgets them. Order is
    that of ts, seq: the batch twin's, if a stream's ts doesn't fall as seq rises. Packets without stream,
    ts or seq are left out; a null codec is one of its own, a null payload holds no set.
    Streams share the state's keys, ``buckets`` in all."""
    rows = packets.select("stream_id", "ts", F.unix_millis("ts").alias("ms"), "seq", "codec", "payload").where("stream_id is not null and ts is not null and seq is not null")
    return _in_buckets(rows, buckets, CodecProbe(), "stream_id long, run long, codec string, ready_seq long, sps binary, pps binary, width int, height int")


class Finalizer(StatefulProcessor):
    """State: the tracks done so far and when; a file is told once. With ``ttl_ms`` a file of which
    nothing was heard for so long, in event time, is forgotten; without it its few rows stay."""

    def __init__(self, expected: int, ttl_ms: int | None = None):
        self.expected, self.ttl_ms = expected, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getMapState("done", "track int", "at long")
        self.told = handle.getValueState("told", "at long")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, newest, told = [], None, self.told.exists()
        for chunk in rows:
            if self.ttl_ms is not None:
                newest = max(newest or 0, int(chunk["ms"].max()))
            if told:
                continue
            pdf = chunk.groupby("track_id", as_index=False)["at"].min()
            for track, at in zip(pdf["track_id"], pdf["at"], strict=True):
                if not self.done.containsKey((int(track),)) or self.done.getValue((int(track),))[0] > at:
                    self.done.updateValue((int(track),), (int(at),))
        if not told:
            ends = [v[0] for _, v in self.done.iterator()]
            if len(ends) >= self.expected:
                self.told.update((max(ends),))
                out = [(key[0], max(ends))]
        if newest is not None:
            self._wait_until(newest + self.ttl_ms)
        yield pd.DataFrame(out, columns=["file_id", "finalized_at"]).astype("int64")

    def _wait_until(self, ms: int) -> None:
        if self.due.exists():
            if self.due.get()[0] >= ms:
                return
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.done, self.told, self.due):
            state.clear()
        yield pd.DataFrame({"file_id": [], "finalized_at": []}).astype("int64")

    def close(self) -> None:
        pass


def stream_finalize(track_events: DataFrame, expected: int, ttl_ms: int | None = None) -> DataFrame:
    """Each file once, when all its tracks reported Eos or Stop (file_id, track_id, event, at).

    With ``ttl_ms`` the events also have ts, with a watermark, and a file that was silent for so long
    behind it is forgotten, told or not; should it report again it begins anew."""
    ends = track_events.where(F.col("event").isin("Eos", "Stop"))
    columns = ["file_id", "track_id", "at"]
    if ttl_ms is not None:
        ends, columns = ends.withColumn("ms", F.unix_millis("ts")), [*columns, "ms", "ts"]
    grouped = ends.select(*columns).groupBy("file_id")
    return grouped.transformWithStateInPandas(Finalizer(expected, ttl_ms), "file_id long, finalized_at long", "Append", "None" if ttl_ms is None else "EventTime")


def foreach_sink(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, on_error: Callable[[int, Exception], None] | None = None) -> StreamingQuery:
    """Hands each micro-batch to user code. With ``on_error`` a failing batch is reported and the
    stream goes on; without it the stream stops."""

    def each(batch: DataFrame, epoch: int) -> None:
        try:
            fn(batch, epoch)
        except Exception as e:  # noqa: BLE001  user code may raise anything
            if on_error is None:
                raise
            on_error(epoch, e)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
