"""Registrations, branches, seeks, newest frames: joins on time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import asof, find_cuts, following, last_known, previous, scan
from .ranges import stepped


def seek_keyframe(requests: DataFrame, packets: DataFrame, most: int | None = None) -> DataFrame:
    """requested and landed of each seek (stream_id, request_id, target): the last keyframe at or
    before the target, else the stream's first keyframe, else the target itself."""
    keys = packets.where("is_key").select("stream_id", "seq", F.coalesce("pts", "dts", F.lit(0)).alias("at"))
    got = asof(requests.withColumn("at", F.col("target")), keys, ["stream_id"], "at", F.col("at"), "seq", most)
    first = keys.groupBy("stream_id").agg(F.min("at").alias("first"))
    out = got.join(first, "stream_id", "left")
    return out.select("stream_id", "request_id", F.col("target").alias("requested"), F.coalesce("known", "first", "target").alias("landed"))


def latest_frame(ticks: DataFrame, frames: DataFrame, marks: DataFrame, keys: tuple[str, ...] = ("input",), most: int | None = None) -> DataFrame:
    """frame_id of the newest frame at each tick of each input; none after an end or seek in
    ``marks`` (keys, at, seq) until the next frame. At one instant a mark comes before a frame."""
    cols = [*keys, "at", "seq"]
    rows = frames.select(*cols, F.lit(1).alias("_p"), F.struct(F.col("frame_id")).alias("s")).unionByName(marks.select(*cols, F.lit(0).alias("_p"), F.struct(F.lit(None).cast(frames.schema["frame_id"].dataType).alias("frame_id")).alias("s")))
    got = asof(ticks, rows.withColumn("_t", F.col("seq") * 2 + F.col("_p")), list(keys), "at", F.col("s"), "_t", most)
    return got.withColumn("frame_id", F.col("known.frame_id")).drop("known")


def current_registration(rows: DataFrame, registrations: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (name, reg_id, at) sent under the newest registration of their name at that time, and
    the inert others. ``registrations``: name, reg_id, valid_from; a newer one ends the older at the
    instant it begins."""
    spans = following(registrations, "valid_from", ["name"], ["valid_from", "reg_id"], "valid_to", most)
    live = (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    joined = rows.join(spans, ["name", "reg_id"], "left").withColumn("_live", F.coalesce(live, F.lit(False)))
    out = joined.drop("valid_from", "valid_to")
    return out.where("_live").drop("_live"), out.where("not _live").drop("_live")


def branch_fanout(buffers: DataFrame, branches: DataFrame, failures: DataFrame | None = None, bin: int | None = None) -> DataFrame:
    """One row per buffer (tee_id, at, buffer_id) and branch attached then: attached_at <= at <
    detached_at. A failing (buffer_id, branch_id) loses only its own copy.

    With ``bin`` both sides are cut into bins of time, a branch into all that it is attached in (an
    open one up to the tee's last buffer), and joined on tee and bin: a tee with very many buffers and
    branches is then spread over tasks and compares only what is near in time.
    """
    live = (F.col("at") >= F.col("attached_at")) & (F.col("detached_at").isNull() | (F.col("at") < F.col("detached_at")))
    keys = ["tee_id"]
    if bin is not None:
        start = lambda c: c - F.pmod(c, F.lit(bin).cast("bigint"))
        last = buffers.groupBy("tee_id").agg(F.max("at").alias("_last"))
        end = F.least(F.coalesce(F.col("detached_at") - 1, F.col("_last")), F.col("_last"))
        branches = branches.join(last, "tee_id").where(end >= F.col("attached_at"))
        branches = branches.withColumn("_bin", F.explode(F.sequence(start(F.col("attached_at")), start(end), F.lit(bin).cast("bigint")))).drop("_last")
        buffers, keys = buffers.withColumn("_bin", start(F.col("at"))), ["tee_id", "_bin"]
    out = buffers.join(branches, keys).where(live).drop("attached_at", "detached_at", "_bin")
    return out if failures is None else out.join(failures, ["buffer_id", "branch_id"], "left_anti")


def branch_totals(buffers: DataFrame, branches: DataFrame, value: str, most: int | None = None) -> DataFrame:
    """(tee_id, branch_id, n, total): how many copies each branch gets in ``branch_fanout``, and the sum of
    their ``value`` (a whole number); branches that get none are left out. Copies that fail are told by
    classes: a branch loses the buffers whose ``fails`` equals its own (null equals nothing).

    No copy is made. Counts and sums run along each tee's time, over all buffers and over those of each
    class, and a branch reads them at its two ends, so that work grows with buffers and branches and not
    with their product.
    """
    own = buffers.where("tee_id is not null and at is not null").select("tee_id", "at", "fails", F.lit(1).alias("_side"), F.lit(1).cast("bigint").alias("_n"), F.col(value).cast("bigint").alias("_v"), F.lit(None).cast(branches.schema["branch_id"].dataType).alias("branch_id"), F.lit(0).alias("_sign"))
    # An open end lies behind all buffers; of equal times a branch's ends come first, as its span is half open.
    open_end, start, end = F.lit((1 << 63) - 1), F.struct(F.col("attached_at").alias("at"), F.lit(-1).alias("sign")), F.col("detached_at")
    live = branches.where("tee_id is not null and attached_at is not null and (detached_at is null or detached_at > attached_at)")
    ends = live.select("tee_id", "branch_id", "fails", F.explode(F.array(start, F.struct(F.coalesce(end, open_end).alias("at"), F.lit(1).alias("sign")))).alias("_e"))
    ends = ends.select("tee_id", F.col("_e.at").alias("at"), "fails", F.lit(0).alias("_side"), F.lit(0).cast("bigint").alias("_n"), F.lit(0).cast("bigint").alias("_v"), "branch_id", F.col("_e.sign").alias("_sign"))
    rows = own.unionByName(ends)
    cuts, order = find_cuts(rows, ["tee_id"], "at", most), ["at", "_side"]
    rows = scan(rows, ["tee_id", "fails"], order, {"_lost_n": ("sum", "_n"), "_lost_v": ("sum", "_v")}, cuts)
    rows = scan(rows, ["tee_id"], order, {"_all_n": ("sum", "_n"), "_all_v": ("sum", "_v")}, cuts).where("_side = 0")
    got = lambda c: F.sum(F.col("_sign") * (F.coalesce(F.col(f"_all_{c}"), F.lit(0)) - F.when(F.col("fails").isNotNull(), F.coalesce(F.col(f"_lost_{c}"), F.lit(0))).otherwise(0)))
    return rows.groupBy("tee_id", "branch_id").agg(got("n").alias("n"), got("v").alias("total")).where("n > 0")


def steady_rate(frames: DataFrame, interval: int, most: int | None = None) -> DataFrame:
    """(source, at, frame_id, is_repeat, run): a fixed rate from irregular captures by repeating the newest
    image, from the source's first frame to its last. run counts the repeats up to here; its largest value
    is the longest stall. Of several frames at one instant the highest frame_id counts.

    Each frame gives the ticks up to the next one, so what is scanned is frames; ticks are made last, in
    ranges, and never held or sorted. Frames without a source or time give none.
    """
    keys = ["source"]
    own = frames.where("source is not null and at is not null").select("source", F.col("at").cast("bigint").alias("at"), "frame_id")
    span = own.groupBy("source").agg(F.min("at").alias("_lo"))
    rows = following(own, "at", keys, ["at", "frame_id"], "_next", most).join(span, "source")
    place = lambda t: F.call_function("div", t - F.col("_lo") + (interval - 1), F.lit(interval).cast("bigint"))  # noqa: E731  ticks before t
    rows = rows.withColumns({"_first": place(F.col("at")), "_end": place(F.coalesce("_next", F.col("at") + 1))}).where("_first < _end")
    cuts = find_cuts(rows, keys, "at", most)
    rows = previous(rows, ["frame_id"], keys, ["at"], ["_shown"], cuts)
    rows = rows.withColumn("_since", F.when(F.coalesce(F.col("frame_id") != F.col("_shown"), F.lit(True)), F.col("_first")))
    rows = last_known(rows, "_since", keys, ["at"], cuts)
    ticks = stepped(rows.select("source", "frame_id", "_lo", "_since", "_first", "_end"), F.col("_first"), F.col("_end") - 1, 1, "_k")
    run = F.col("_k") - F.col("_since")
    return ticks.select("source", (F.col("_lo") + F.col("_k") * interval).alias("at"), "frame_id", (run > 0).alias("is_repeat"), run.alias("run"))
