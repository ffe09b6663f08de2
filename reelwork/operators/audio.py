"""Sample streams: mixing, ramps, silence, re-chunking and resampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.audio import effective_gain
from ..functions.time import rescale
from .asof import asof, find_cuts, previous, running_sum, scan
from .ranges import stepped
from .staging import clustered


def sample_rows(frames: DataFrame, *keep: str) -> DataFrame:
    """One row per sample: at is its index on the input's timeline."""
    return frames.select("input", *keep, "pts", F.posexplode("samples").alias("_i", "v")).withColumn("at", F.col("pts") + F.col("_i")).drop("_i", "pts")


def mix_audio(frames: DataFrame, size: int, channels: int = 1) -> DataFrame:
    """(mix_id, block, pts, samples): the sum of all inputs sample by sample, clipped to -1 .. 1, in blocks
    of ``size`` samples of each of ``channels``, which lie packed side by side and stay apart.

    ``frames``: mix_id, input, pts, samples (packed too). They are cut where blocks end, so a block's part
    is the unit that is shuffled and not a sample, and frames need not lie on the blocks' grid nor have one
    length. Parts are summed in the order of their inputs, which makes float sums repeatable. A missing
    input is silence, and a mix runs on from its first block to its last: blocks in which all inputs are
    missing are rows of zeros. Samples that don't make up all channels end a frame unused.
    """
    n, whole = F.lit(size).cast("bigint"), F.floor(F.size("samples") / channels)
    first, last = F.col("pts") - F.pmod("pts", n), F.col("pts") + whole - 1
    parts = frames.where(whole > 0).withColumn("_start", F.explode(F.sequence(first, last - F.pmod(last, n), n)))
    skip = F.greatest(F.col("_start") - F.col("pts"), F.lit(0))
    take = F.least(F.col("_start") + size - F.col("pts"), whole) - skip
    own = F.slice("samples", (skip * channels + 1).cast("int"), (take * channels).cast("int"))
    part = F.struct("input", ((F.col("pts") + skip - F.col("_start")) * channels).cast("int").alias("at"), own.alias("samples"))
    block = lambda c: F.call_function("div", c, n)
    blocks = parts.groupBy("mix_id", block(F.col("_start")).alias("block")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    ends = frames.where(whole > 0).groupBy("mix_id").agg(F.min(block(first)).alias("_lo"), F.max(block(last - F.pmod(last, n))).alias("_hi_block"))
    spine = stepped(ends, F.col("_lo"), F.col("_hi_block"), 1, "block").select("mix_id", "block")
    silence = F.array_repeat(F.lit(0.0), size * channels)
    placed = lambda p: F.concat(F.slice(silence, F.lit(1), p["at"]), p["samples"])
    total = F.aggregate(F.coalesce("parts", F.array()), silence, lambda acc, p: F.zip_with(acc, placed(p), lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))))
    clipped = F.transform(total, lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(-1.0)))
    return spine.join(blocks, ["mix_id", "block"], "left").select("mix_id", "block", (F.col("block") * n).alias("pts"), clipped.alias("samples"))


def mix_samples(samples: DataFrame) -> DataFrame:
    """The same in sample form (mix_id, at, input, v): partial sums are combined before the shuffle."""
    return samples.groupBy("mix_id", "at").agg(F.greatest(F.least(F.sum("v"), F.lit(1.0)), F.lit(-1.0)).alias("v"))


def fill_silence(frames: DataFrame, most: int | None = None) -> DataFrame:
    """``frames`` (input, pts, n_samples) and a silent row (is_silence) for each gap before one."""
    ends = frames.withColumn("_own", F.col("pts") + F.col("n_samples"))
    rows = previous(ends, ["_own"], ["input"], ["pts"], ["_end"], find_cuts(frames, ["input"], "pts", most)).withColumn("is_silence", F.lit(False))
    gaps = rows.where(F.col("pts") > F.col("_end")).select("input", F.col("_end").alias("pts"), (F.col("pts") - F.col("_end")).alias("n_samples"), F.lit(True).alias("is_silence"))
    return rows.select("input", "pts", "n_samples", "is_silence").unionByName(gaps)


def silent_samples(n: str = "n_samples"):
    return F.array_repeat(F.lit(0.0), F.col(n).cast("int"))


def rechunk(frames: DataFrame, size: int, flush: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(input, chunk, samples): the same samples in frames of ``size``. The short last one is given
    only for inputs in ``flush`` (input), which have ended. Size 0 passes frames through."""
    if not size:
        return frames.select("input", F.col("frame_idx").cast("bigint").alias("chunk"), "samples")
    counted = running_sum(frames.withColumn("_n", F.size("samples").cast("bigint")), "_n", ["input"], ["frame_idx"], "_before", find_cuts(frames, ["input"], "frame_idx", most))
    # A frame is cut where chunks end: its parts, not its samples, are shuffled.
    first, last = F.floor(F.col("_before") / size), F.floor((F.col("_before") + F.col("_n") - 1) / size)
    parts = counted.where("_n > 0").withColumn("chunk", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("chunk") * size - F.col("_before"), F.lit(0))
    end = F.least((F.col("chunk") + 1) * size - F.col("_before"), F.col("_n"))
    parts = parts.select("input", "chunk", F.struct("frame_idx", F.slice("samples", (start + 1).cast("int"), (end - start).cast("int")).alias("s")).alias("part"))
    out = parts.groupBy("input", "chunk").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["s"])).alias("samples"))
    if flush is None:
        return out.where(F.size("samples") == size)
    ended = flush.select("input").distinct().withColumn("_ended", F.lit(True))
    return out.join(ended, "input", "left").where((F.size("samples") == size) | F.col("_ended")).drop("_ended")


def ramps(changes: DataFrame, ramp: int, most: int | None = None) -> DataFrame:
    """(input, nth, at, start_gain, target, step, n): the line that the gain follows from each change on; of
    one instant the last (the highest nth) counts.

    ``changes``: input, at, gain, muted and perhaps ``reset``. A ramp begins at the gain reached so far,
    also in the middle of another one; a change that keeps the target changes nothing. A reset snaps: the
    gain is at its target from there on (the row's own, where it has a gain, else the last one) and no
    ramp goes on; of one instant it comes after the change.

    Only changes that come before a ramp's end depend on each other: scans find where that isn't so, and
    each stretch of changes between is folded by itself, so that one input's changes spread over tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = gain = target = since = None
        step = 0.0
        for pdf in batches:
            rows = []
            for key, stretch, nth, at, new, before, snaps in zip(*(pdf[c].tolist() for c in ("input", "_stretch", "nth", "at", "target", "_before", "_snaps")), strict=True):
                if (key, stretch) != own:
                    own, gain = (key, stretch), new if snaps else before
                else:
                    gain += step * (at - since)
                target, since = new, at
                step = (target - gain) / ramp if ramp and not snaps else 0.0
                gain = gain if ramp else target
                rows.append((key, nth, at, gain, target, step, 0 if snaps else ramp))
            yield pd.DataFrame(rows, columns=["input", "nth", "at", "start_gain", "target", "step", "n"])

    reset = F.coalesce(F.col("reset"), F.lit(False)) if "reset" in changes.columns else F.lit(False)
    rows = changes.select("input", F.col("at").cast("bigint").alias("at"), effective_gain(F.col("gain"), F.col("muted")).alias("target"), reset.alias("reset"))
    rows = rows.where("input is not null and (target is not null or reset)")
    keys, order, cuts = ["input"], ["at", "reset", "target"], find_cuts(rows, ["input"], "at", most)
    rows = rows.withColumn("_target", F.col("target"))
    rows = scan(rows, keys, order, {"_target": ("last", "_target")}, cuts).where("_target is not null")
    rows = scan(rows, keys, order, {"_before": ("previous", "_target")}, cuts)
    rows = rows.where("reset or _before is null or _target <> _before").withColumn("_snaps", F.col("reset") | F.col("_before").isNull())
    rows = scan(rows.withColumn("_one", F.lit(1).cast("bigint")), keys, order, {"_last": ("previous", "at"), "_settled": ("previous", "_snaps"), "nth": ("sum", "_one")}, cuts)
    alone = F.col("_snaps") | F.col("_settled") | (F.col("at") - F.col("_last") >= ramp)
    rows = scan(rows.withColumn("_new", alone.cast("bigint")), keys, order, {"_stretch": ("sum", "_new")}, cuts).withColumn("_stretch", F.col("_stretch") + F.col("_new"))
    parts = clustered(rows.select("input", "_stretch", "nth", "at", F.col("_target").alias("target"), "_before", "_snaps"), "input", "_stretch").sortWithinPartitions("input", "_stretch", "nth")
    return parts.mapInPandas(run, "input long, nth long, at long, start_gain double, target double, step double, n long")


def gain_ramp(frames: DataFrame, changes: DataFrame, ramp_ns: int, rate: int, most: int | None = None) -> DataFrame:
    """``frames`` (input, pts, samples) with their samples ramped. A frame takes the gain set at or
    before its first sample and follows it in closed form; gain 1 before any change."""
    n = -(-ramp_ns * rate // 1_000_000_000)
    lines = ramps(changes, n, most).withColumnRenamed("at", "pts")
    got = asof(frames, lines, ["input"], "pts", F.struct(F.col("pts").alias("since"), "start_gain", "target", "step", "n"), "nth", most)
    k = F.col("known")

    def gain(i):
        done = F.col("pts") - k["since"] + i + 1
        return F.when(k.isNull(), F.lit(1.0)).when(done >= k["n"], k["target"]).otherwise(k["start_gain"] + k["step"] * done)

    return got.withColumn("samples", F.transform("samples", lambda v, i: v * gain(i))).drop("known")


#: Weight of the centre and of each back channel in a front one, as is usual: half the power. Fixed value.
HALF_POWER = 0.5**0.5


def mixing_matrix(channels: int, to: int) -> list[list[float]]:
    """What each channel of the output takes of each of the input. Layouts are mono, stereo (left, right)
    and 5.1 (left, right, centre, low, back left, back right). Weights of one output add up to 1 at most,
    so that nothing is clipped by it; the low channel is left out where there is none."""
    if channels == to:
        return [[float(i == o) for i in range(channels)] for o in range(to)]
    front = {1: [[1.0], [1.0]], 2: [[1.0, 0.0], [0.0, 1.0]], 6: [[1.0, 0.0, HALF_POWER, 0.0, HALF_POWER, 0.0], [0.0, 1.0, HALF_POWER, 0.0, 0.0, HALF_POWER]]}
    if channels not in front or to not in front:
        raise ValueError(f"no mixing matrix from {channels} to {to} channels")
    left, right = ([w / sum(row) for w in row] for row in front[channels])
    if to == 1:
        return [[(a + b) / 2 for a, b in zip(left, right, strict=True)]]
    if to == 2:
        return [left, right]
    none = [0.0] * channels
    return [none, none, [1.0], none, none, none] if channels == 1 else [left, right, none, none, none, none]


LAYOUTS = (1, 2, 6)


def remixed(samples: Column, channels: Column, n: Column, to: int) -> Column:
    """``n`` (at least one) packed samples of ``channels`` as packed samples of ``to`` channels; an error
    for layouts without a matrix."""
    out = F.raise_error(F.concat(F.lit(f"no mixing matrix to {to} channels from "), F.coalesce(channels.cast("string"), F.lit("null"))))

    def each(own: int):
        value = lambda i, weights: sum((F.lit(w) * F.get(samples, i * own + c) for c, w in enumerate(weights) if w), F.lit(0.0))
        return lambda i: F.array(*[value(i, weights) for weights in mixing_matrix(own, to)])

    for own in LAYOUTS:
        mixed = samples if own == to else F.flatten(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), each(own)))
        out = F.when(channels == own, mixed).otherwise(out)
    return out


def resample_blocks(frames: DataFrame, rate: int, channels: int = 1, block: int = 256, most: int | None = None) -> DataFrame:
    """(input, run, out_idx, pts, samples): ``frames`` (input, frame_idx, rate, samples, and where they
    have them channels, else 1, and pts in samples of their rate, else 0) at one rate and layout, packed.

    A change of format begins a new run. Channels are mixed by a matrix; then each is interpolated
    linearly between neighbouring samples. A run's output has floor(n * rate / its rate) samples of each
    channel; sample k lies at input position k * its rate / rate. out_idx is a block's first sample in its
    run, pts its first on the output's timeline, which begins at the first frame's pts and has no gaps, also
    between runs. Frames are cut into blocks of input samples that overlap by one, and each block gives the
    output that lies in it: parts of frames are shuffled, not samples.
    """
    cuts = find_cuts(frames, ["input"], "frame_idx", most)
    own = F.col("channels").cast("int") if "channels" in frames.columns else F.lit(1)
    at = F.col("pts").cast("bigint") if "pts" in frames.columns else F.lit(0).cast("bigint")
    rows = frames.select("input", "frame_idx", F.struct(F.col("rate").cast("bigint").alias("rate"), own.alias("channels")).alias("format"), at.alias("pts"), "samples")
    first = rows.groupBy("input").agg(F.min_by(F.struct("pts", "format.rate"), F.struct("frame_idx")).alias("_first"))
    rows = previous(rows.drop("pts"), ["format"], ["input"], ["frame_idx"], ["_before"], cuts)
    rows = rows.withColumn("_new", F.coalesce((F.col("format") != F.col("_before")).cast("bigint"), F.lit(0))).drop("_before")
    runs = running_sum(rows, "_new", ["input"], ["frame_idx"], "run", cuts).withColumn("run", F.col("run") + F.col("_new"))
    runs = runs.select("input", "run", "frame_idx", "format.rate", "format.channels", "samples", F.floor(F.size("samples") / F.col("format.channels")).alias("_n"))
    div = lambda a, b: F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("bigint"))
    total = runs.groupBy("input", "run", "rate").agg(F.sum("_n").alias("_total")).withColumn("_out", div(F.col("_total") * rate, F.col("rate")))
    earlier = Window.partitionBy("input").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row per run
    began = F.coalesce(rescale(F.col("_first.pts"), F.lit(1), F.col("_first.rate"), F.lit(1), F.lit(rate)), F.lit(0).cast("bigint"))
    total = total.withColumn("_start", F.coalesce(F.sum("_out").over(earlier), F.lit(0))).join(first, "input").withColumn("_start", F.col("_start") + began)
    runs = running_sum(runs, "_n", ["input", "run"], ["frame_idx"], "_before", cuts).join(total.drop("_first", "rate"), ["input", "run"]).where("_n > 0")
    runs = runs.withColumn("samples", remixed(F.col("samples"), F.col("channels"), F.col("_n"), channels))
    # Block b has the samples from b * block up to and with (b + 1) * block.
    lowest = div(F.greatest(F.col("_before") - 1, F.lit(0).cast("bigint")), block)
    parts = runs.withColumn("b", F.explode(F.sequence(lowest, div(F.col("_before") + F.col("_n") - 1, block))))
    low = F.greatest(F.col("b") * block - F.col("_before"), F.lit(0))
    high = F.least((F.col("b") + 1) * block + 1 - F.col("_before"), F.col("_n"))
    part = F.struct("frame_idx", F.slice("samples", (low * channels + 1).cast("int"), ((high - low) * channels).cast("int")).alias("s"))
    blocks = parts.groupBy("input", "run", "rate", "_out", "_start", "b").agg(F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["s"])).alias("s"))
    begin = F.col("b") * block
    up = lambda x: div(x * rate + F.col("rate") - 1, F.col("rate"))
    last = F.least(up(begin + block), F.col("_out")) - 1
    blocks = blocks.withColumn("out_idx", up(begin)).withColumn("_high", last).where("out_idx <= _high")

    def value(k: Column) -> list[Column]:
        at = div(k * F.col("rate"), rate)
        share = F.pmod(k * F.col("rate"), F.lit(rate).cast("bigint")) / rate
        place = ((at - begin) * channels).cast("int")
        left = [F.get("s", place + c) for c in range(channels)]
        right = [F.coalesce(F.get("s", place + channels + c), x) for c, x in enumerate(left)]
        return [a * (1 - share) + b * share for a, b in zip(left, right, strict=True)]

    samples = F.flatten(F.transform(F.sequence("out_idx", "_high"), lambda k: F.array(*value(k))))
    return blocks.select("input", "run", "out_idx", (F.col("_start") + F.col("out_idx")).alias("pts"), samples.alias("samples"))


def resample(frames: DataFrame, rate: int, block: int = 256, most: int | None = None, channels: int = 1) -> DataFrame:
    """(input, run, out_idx, pts, channel, v): what ``resample_blocks`` gives, one row per value."""
    each = resample_blocks(frames, rate, channels, block, most).select("input", "run", "out_idx", "pts", F.posexplode("samples").alias("_i", "v"))
    step = F.floor(F.col("_i") / channels)
    return each.select("input", "run", (F.col("out_idx") + step).alias("out_idx"), (F.col("pts") + step).alias("pts"), (F.col("_i") % channels).alias("channel"), "v")


def capture_loss(frames: DataFrame, dropped: DataFrame, most: int | None = None) -> DataFrame:
    """Per input: samples missing between frames and Dropped events (input, event)."""
    ends = frames.withColumn("_own", F.col("pts") + F.col("n_samples"))
    rows = previous(ends, ["_own"], ["input"], ["pts"], ["_end"], find_cuts(frames, ["input"], "pts", most))
    gap = F.when(F.col("_end").isNotNull(), F.greatest(F.col("pts") - F.col("_end"), F.lit(0)))
    lost = rows.withColumn("_gap", gap).groupBy("input").agg(F.coalesce(F.sum("_gap"), F.lit(0)).alias("lost_samples"), F.count_if(F.col("_gap") > 0).alias("gaps"))
    events = dropped.where("event = 'Dropped'").groupBy("input").agg(F.count("*").alias("drop_events"))
    return lost.join(events, "input", "left").withColumn("drop_events", F.coalesce("drop_events", F.lit(0)))
