"""Window operators over one stream's order. Streams of more than ``most`` rows are cut and spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import rescale, to_ns
from .asof import Cuts, asof, find_cuts, last_known, previous, running_sum, scan
from .greedy import greedy
from .staging import clustered, stage

NOMINAL_NS = 40_000_000


def with_first(rows: DataFrame, value: str, keys: list[str], order: str, name: str, skip_nulls: bool = True) -> DataFrame:
    """``rows`` with the first ``value`` of their keys as ``name``. It comes from one row per key, so
    that no stream has to be sorted, or held, as a whole; rows with a null key get null."""
    at = F.when(F.col(value).isNotNull(), F.col(order)) if skip_nulls else F.col(order)
    return rows.join(rows.groupBy(*keys).agg(F.min_by(value, at).alias(name)), keys, "left")


def pace_schedule(buffers: DataFrame, start_ns: str = "start_ns", keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """due_ns: the shared start plus the time since the stream's first pts; at once for an earlier
    pts, null without one. late_ns: arrival_ns minus that. error where it exceeds 64 bits."""
    since = to_ns(F.greatest(F.col("pts") - F.col("_first"), F.lit(0)), F.col("tb_num"), F.col("tb_den"))
    out = with_first(buffers, "pts", list(keys), "seq", "_first").withColumn("_since", since).drop("_first")
    due = F.col(start_ns).cast("decimal(20,0)") + F.col("_since")
    fits = due <= F.lit((1 << 63) - 1).cast("decimal(20,0)")
    out = out.withColumn("due_ns", F.when(fits, due).cast("bigint")).withColumn("error", F.when(F.col("pts").isNotNull() & ~F.coalesce(fits, F.lit(False)), "timestamp_overflow"))
    return out.withColumn("late_ns", F.col("arrival_ns") - F.col("due_ns")).drop("_since")


def observed_duration(frames: DataFrame, resets: DataFrame | None = None, at: str = "pts_ns", most: int | None = None) -> DataFrame:
    """duration_ns of each frame: the last positive step between frames so far, 40 ms before any;
    ``resets`` (stream_id, at, seq) begin anew."""
    rows, cuts = frames.withColumn("epoch", F.lit(0).cast("bigint")), find_cuts(frames, ["stream_id"], "seq", most)
    if resets is not None:
        marks = resets.select("stream_id", "seq").withColumn("_r", F.lit(1))
        both = frames.withColumn("_r", F.lit(0)).unionByName(marks, allowMissingColumns=True)
        # A frame has the resets before it; of one place in the order the reset comes later.
        rows = running_sum(both, "_r", ["stream_id"], ["seq", "_r"], "epoch", cuts).where("_r = 0").drop("_r")
    keys = ["stream_id", "epoch"]
    step = F.col(at) - F.col("_last")
    rows = previous(rows, [at], keys, ["seq"], ["_last"], cuts).withColumn("duration_ns", F.when(step > 0, step)).drop("_last")
    rows = last_known(rows, "duration_ns", keys, ["seq"], cuts)
    return rows.withColumn("duration_ns", F.coalesce("duration_ns", F.lit(NOMINAL_NS).cast("bigint")))


def playback_position(asks: DataFrame, samples: DataFrame, most: int | None = None) -> DataFrame:
    """master and position_ns at each ask (stream_id, wall_ns, and for frames seq and pts_ns).

    Before any sample the wall clock is master: a stream's first frame sets the origin, its pts at its
    time; an ask that is no frame finds none. Audio that registers (the first sample) takes over: while
    it primes the position is held at the last one, audio's or the wall's; then it runs on from the
    sample if that is running, never beyond what was submitted, and the first sample after priming
    never goes back behind the held position. After a sample that ended (``ended``, where samples have
    that column) the wall carries on from its position until the next one.
    """
    if "ended" not in samples.columns:
        samples = samples.withColumn("ended", F.lit(False))
    if "pts_ns" in asks.columns:
        origin = asks.where("pts_ns is not null").groupBy("stream_id").agg(F.min(F.struct("wall_ns", "seq", "pts_ns")).alias("_o"))
    else:
        origin = asks.select("stream_id", F.struct("wall_ns", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("bigint").alias("pts_ns")).alias("_o")).limit(0)
    took = samples.groupBy("stream_id").agg(F.min("wall_ns").alias("_took"))
    wall = lambda at: F.col("_o.pts_ns") + at - F.col("_o.wall_ns")
    # One row per stream: its origin, and the wall's position when audio took over.
    base = took.join(origin, "stream_id", "full").withColumn("_handed", F.when(F.col("_o.wall_ns") < F.col("_took"), wall(F.col("_took"))))

    keys, order = ["stream_id"], ["wall_ns", "seq"]
    cuts = find_cuts(asks.select("stream_id", "wall_ns").unionByName(samples.select("stream_id", "wall_ns")), keys, "wall_ns", most)
    played = samples.withColumn("_own", F.when(~F.col("priming"), F.col("position_ns")))
    played = previous(played, ["_own", "priming"], keys, order, ["held", "_primed"], cuts)
    played = played.join(base.select("stream_id", "_handed"), "stream_id", "left").withColumn("held", F.coalesce("held", "_handed"))
    after = F.coalesce("_primed", F.lit(True)) & ~F.col("priming") & ~F.coalesce("ended", F.lit(False))
    played = played.withColumn("position_ns", F.when(after, F.greatest("position_ns", F.coalesce("held", "position_ns"))).otherwise(F.col("position_ns")))
    played = played.withColumn("submitted_ns", F.greatest("submitted_ns", "position_ns"))
    value = F.struct(F.col("wall_ns").alias("since"), "position_ns", "submitted_ns", "running", "priming", "held", F.coalesce("ended", F.lit(False)).alias("ended"))
    got = asof(asks, played, keys, "wall_ns", value, "seq", cuts=cuts).join(base.select("stream_id", "_o"), "stream_id", "left")

    elapsed = F.col("wall_ns") - F.col("known.since")
    run = F.col("known.position_ns") + F.when(F.col("known.running"), elapsed).otherwise(F.lit(0))
    position = (
        F.when(F.col("known").isNull(), wall(F.col("wall_ns"))).when(F.col("known.priming"), F.col("known.held"))
        .when(F.col("known.ended"), F.col("known.position_ns") + elapsed).otherwise(F.least(run, F.col("known.submitted_ns")))
    )
    master = (
        F.when(F.col("known").isNull(), F.when(F.col("_o.pts_ns").isNull() | (F.col("wall_ns") < F.col("_o.wall_ns")), "none").otherwise("wall"))
        .when(F.col("known.priming"), "priming").when(F.col("known.ended"), "wall").otherwise("audio")
    )
    return got.withColumn("master", master).withColumn("position_ns", F.when(F.col("master") != "none", position)).drop("known", "_o")


def sync_video(frames: DataFrame, samples: DataFrame, most: int | None = None) -> DataFrame:
    """decision of each frame (stream_id, seq, wall_ns, pts_ns) against the playback position when it
    arrives, and wait_ns. Without a master a frame renders; while audio primes it holds; ahead, it
    waits; later than one frame's duration it drops, but never where the wall is master."""
    timed = playback_position(observed_duration(frames, most=most), samples, most)
    ahead = F.col("pts_ns") - F.col("position_ns")
    audio = F.col("master") == "audio"
    decision: Column = (
        F.when(F.col("master") == "none", "Render").when((F.col("master") == "priming") | (audio & F.col("position_ns").isNull()), "Hold")
        .when(ahead > 0, "Wait").when(audio & (-ahead > F.col("duration_ns")), "Drop").otherwise("Render")
    )
    return timed.withColumn("decision", decision).withColumn("wait_ns", F.when(decision == "Wait", ahead))


def splice_timeline(packets: DataFrame, most: int | None = None) -> DataFrame:
    """out_pts and out_dts that stay monotone across seeks: the first packet after a seek (``seek``
    is true) comes one tick after the last. Packets without pts neither need nor settle a seek;
    several seeks in a row are one; with nothing before it a seek shifts nothing."""
    real = F.col("pts").isNotNull()
    keys, order = ["stream_id"], ["seq"]
    cuts = find_cuts(packets, keys, "seq", most)
    rows = running_sum(packets.withColumn("_seek", F.col("seek").cast("bigint")), "_seek", keys, order, "_seeks", cuts)
    rows = rows.withColumn("_seeks", F.col("_seeks") + F.col("_seek")).drop("_seek")
    timed = rows.where(real).withColumn("_raw", F.coalesce("dts", "pts"))
    timed = previous(timed, ["_raw", "_seeks"], keys, order, ["_last", "_seen"], cuts)
    new = F.col("_seeks") > F.coalesce("_seen", F.lit(0))
    timed = timed.withColumn("_jump", F.when(new & F.col("_last").isNotNull(), F.col("_last") + 1 - F.col("_raw")).otherwise(F.lit(0)))
    timed = running_sum(timed, "_jump", keys, order, "_before", cuts).withColumn("offset", F.col("_before") + F.col("_jump"))
    out = timed.drop("_jump", "_before", "_raw", "_last", "_seen").unionByName(rows.where(~real).withColumn("offset", F.lit(None).cast("bigint")))
    return out.withColumn("out_pts", F.col("pts") + F.col("offset")).withColumn("out_dts", F.col("dts") + F.col("offset")).drop("_seeks")


def zero_base(packets: DataFrame, keys: tuple[str, ...] = ("stream_id", "track_id")) -> DataFrame:
    """A track whose first pts is negative moves up so that it starts at 0; spacing stays."""
    return with_first(packets, "pts", list(keys), "seq", "_first").withColumn("pts", F.col("pts") + F.greatest(-F.col("_first"), F.lit(0))).drop("_first")


def contiguous_pts(frames: DataFrame, in_num: int, in_den: int, rate: int, most: int | None = None) -> DataFrame:
    """out_pts: the first pts in samples of ``rate`` (0 if none) and the samples before the frame.
    ``frames``: input, frame_idx, pts, n_samples."""
    based = with_first(frames, "pts", ["input"], "frame_idx", "_first", skip_nulls=False)
    based = based.withColumn("_first", F.coalesce(rescale(F.col("_first"), in_num, in_den, 1, rate), F.lit(0)))
    summed = running_sum(based, "n_samples", ["input"], ["frame_idx"], "_before", find_cuts(frames, ["input"], "frame_idx", most))
    return summed.withColumn("out_pts", F.col("_first") + F.col("_before")).drop("_first", "_before")


def active_time(runs: DataFrame, pauses: DataFrame) -> DataFrame:
    """Per run (run_id, start, end): the time not covered by its pauses (run_id, start, end), which
    are clipped to it; an open pause lasts to the end; never below 0."""
    p = pauses.select("run_id", F.col("start").alias("p0"), F.col("end").alias("p1"))
    joined = runs.join(p, "run_id", "left")
    paused = F.greatest(F.least(F.coalesce("p1", "end"), "end") - F.greatest("p0", "start"), F.lit(0))
    total = joined.groupBy("run_id", "start", "end").agg(F.coalesce(F.sum(paused), F.lit(0)).alias("paused"))
    return total.withColumn("active", F.greatest(F.col("end") - F.col("start") - F.col("paused"), F.lit(0)))


def cadence(ticks: DataFrame, interval: int, pauses: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """The schedule of ticks (source, n, now): due of each and how many were missed before the next.

    The next is due one interval after the last; if that is past at ``now``, one interval from now.
    ``pauses`` (source, now, paused_for) end at their now, before a tick of that instant, and move what is
    due by their length, so that the phase is kept; if that is past even so, the next tick is one interval
    from now. A pause before the first tick moves nothing, as that one is due at once.

    Ticks lie sorted in partitions by source and are folded batch by batch: only what is due last is
    carried on, so a source of any length needs no more memory. Runs on time are filled in one step,
    only late ticks and pauses are looped over. Where a source has more than ``most`` events, all go the way
    of ``_cadence_by_scans``. Ticks without a source or time are in no schedule.
    """
    rows = ticks.select("source", F.col("n").cast("bigint").alias("n"), F.col("now").cast("bigint").alias("now"), F.lit(-1).cast("bigint").alias("paused_for"))
    order = ["n"]
    if pauses is not None:
        ends = pauses.where("paused_for >= 0").select("source", F.lit(0).cast("bigint").alias("n"), F.col("now").cast("bigint").alias("now"), F.col("paused_for").cast("bigint").alias("paused_for"))
        rows, order = rows.unionByName(ends), ["now", "_is_tick", "n"]
    rows = rows.where("source is not null and now is not null").withColumn("_is_tick", F.col("paused_for") < 0)
    if cuts := find_cuts(rows, ["source"], order[0], most):
        return _cadence_by_scans(rows, interval, order, cuts, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = next_due = None
        for pdf in batches:
            sources, now, held = (pdf[c].to_numpy(np.int64) for c in ("source", "now", "paused_for"))
            is_tick = held < 0
            due, missed = np.empty(len(now), np.int64), np.zeros(len(now), np.int64)
            for lo, hi in _runs(sources):
                if sources[lo] != source:
                    source, next_due = sources[lo], None
                for i, end in _runs(is_tick[lo:hi]):
                    i, end = lo + i, lo + end
                    if not is_tick[i]:
                        for k in range(i, end) if next_due is not None else ():
                            next_due += held[k]
                            next_due = now[k] + interval if next_due < now[k] else next_due
                        continue
                    at = now[i] if next_due is None else next_due
                    while i < end:
                        steps = np.arange(end - i, dtype=np.int64) * interval
                        late = np.flatnonzero(now[i:end] > at + steps + interval)
                        j = i + (late[0] if len(late) else end - i - 1)
                        due[i : j + 1] = at + steps[: j - i + 1]
                        if len(late):
                            missed[j] = (now[j] - due[j]) // interval
                        at = now[j] + interval if len(late) else due[j] + interval
                        i = j + 1
                    next_due = at
            yield pdf.drop(columns="paused_for").assign(due=due, missed=missed)[is_tick]

    parts = clustered(rows, "source").sortWithinPartitions("source", *order).drop("_is_tick")
    return parts.mapInPandas(run, "source long, n long, now long, due long, missed long")


def _cadence_by_scans(rows: DataFrame, interval: int, order: list[str], cuts: Cuts, most: int | None) -> DataFrame:
    """The same without a fold. Let P be the pauses up to an event, i the number of the last tick there and
    k = now - P - i * interval: how far the event is behind an even cadence. From a tick or a pause that set
    the schedule anew, at k, the next that does so is the first whose k is more than one interval higher. As
    that is also the first so high of all events, only those matter that are higher than all before, and
    these form a greedy chain. A tick is then due at P + i * interval + the k that was set last before it."""
    keys = ["source"]
    held = F.when(F.col("_is_tick"), 0).otherwise(F.col("paused_for")).cast("bigint")
    rows = rows.withColumns({"_held": held, "_one": F.col("_is_tick").cast("bigint")})
    rows = scan(rows, keys, order, {"_p": ("sum", "_held"), "_i": ("sum", "_one")}, cuts)
    rows = rows.withColumn("_p", F.col("_p") + F.col("_held")).withColumn("_i", F.col("_i") - 1 + F.col("_one"))
    rows = rows.withColumn("_k", F.when(F.col("_i") >= 0, F.col("now") - F.col("_p") - F.col("_i") * interval))
    rows = scan(rows, keys, order, {"_most": ("max", "_k")}, cuts).withColumn("_k", F.when(F.col("_most").isNull() | (F.col("_k") > F.col("_most")), F.col("_k")))
    rows = stage(rows.select("source", "n", "now", *[c for c in order if c not in ("n", "now")], *(["_is_tick"] if "_is_tick" not in order else []), "_p", "_i", "_k"), "cadence")
    points = rows.where("_k is not null").select(F.col("source").cast("bigint").alias("key"), F.col("_k").alias("v"))
    chain = greedy(points, points.groupBy("key").agg(F.min("v").alias("v")), interval + 1, most)
    chain = chain.select(F.col("key").alias("source"), F.col("v").alias("_k"), F.col("v").alias("_set"))
    rows = scan(rows.join(chain, ["source", "_k"], "left"), keys, order, {"_since": ("previous", "_set")}, cuts).where("_is_tick")
    due = F.coalesce(F.col("_since") + F.col("_p") + F.col("_i") * interval, F.col("now"))
    late = F.col("now") - due > interval
    missed = F.when(late, F.call_function("div", F.col("now") - due, F.lit(interval).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    return rows.select(F.col("source").cast("bigint").alias("source"), "n", "now", due.alias("due"), missed.alias("missed"))


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """First place and end of each stretch of equal keys."""
    ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
    return [(lo, hi) for lo, hi in zip([0, *ends], ends, strict=False) if lo < hi]
