"""Packets and tracks: choosing, validating, rescaling, ordering, merging, finishing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import nominal_duration, rescale
from .asof import asof, find_cuts, running_sum

KINDS = ("video", "audio", "data")


def load_packets(packets: DataFrame, streams: list[int] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Packets of chosen streams and kinds; both filters reach the scan."""
    if streams is not None:
        packets = packets.where(F.col("stream_id").isin(streams))
    return packets.where(F.col("kind").isin(kinds)) if kinds is not None else packets


def select_tracks(packets: DataFrame, streams: DataFrame, kinds: tuple[str, ...] = ("video", "audio")) -> DataFrame:
    """Packets of the tracks whose kind in ``streams`` is wanted; others drop silently."""
    wanted = streams.where(F.col("kind").isin(*kinds)).select("stream_id", "track_id").distinct()
    return packets.join(wanted, ["stream_id", "track_id"], "left_semi")


def error_code(known_kinds: tuple[str, ...] = KINDS):
    """Why a packet can't be used, null if it can."""
    ns = F.col("pts").cast("decimal(20,0)") * F.col("tb_num").cast("decimal(10,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    too_far = ns > F.lit((1 << 63) - 1).cast("decimal(20,0)") * F.col("tb_den").cast("decimal(10,0)")
    return (
        F.when((F.col("tb_num") <= 0) | (F.col("tb_den") <= 0) | F.col("tb_num").isNull() | F.col("tb_den").isNull(), "invalid_time_base")
        .when(F.col("pts").isNull(), "missing_pts")
        .when(~F.coalesce(F.col("kind").isin(*known_kinds), F.lit(False)), "unsupported_kind")
        .when(F.col("pts") < 0, "negative_pts")
        .when(too_far, "timestamp_overflow")
    )


def validate_packets(packets: DataFrame, known_kinds: tuple[str, ...] = KINDS) -> tuple[DataFrame, DataFrame]:
    """Good packets, and the others with error_code."""
    coded = packets.withColumn("error_code", error_code(known_kinds))
    return coded.where("error_code is null").drop("error_code"), coded.where("error_code is not null")


def rescale_packets(packets: DataFrame, outputs: DataFrame) -> DataFrame:
    """pts, dts and duration in each track's output time base; ``outputs``: stream_id, track_id,
    out_track, out_num, out_den. Tracks without an output go."""
    joined = packets.join(outputs, ["stream_id", "track_id"])
    scaled = lambda c: rescale(F.col(c), F.col("tb_num"), F.col("tb_den"), F.col("out_num"), F.col("out_den"))
    return joined.withColumns({c: scaled(c) for c in ("pts", "dts", "duration")} | {"tb_num": F.col("out_num"), "tb_den": F.col("out_den")}).drop("out_num", "out_den")


def fill_duration(packets: DataFrame) -> DataFrame:
    """Where duration is 0, one nominal frame of rate_num / rate_den."""
    nominal = nominal_duration(F.col("rate_num"), F.col("rate_den"), F.col("tb_num"), F.col("tb_den"))
    return packets.withColumn("duration", F.when(F.col("duration") == 0, nominal).otherwise(F.col("duration")))


def interleave(packets: DataFrame, file: str = "stream_id", most: int | None = None) -> DataFrame:
    """file_seq (from 1): the order of a file's packets by dts as time, then track, then arrival. Times
    are compared in nanoseconds of their own time bases; packets without one come first. Files
    of more than ``most`` packets are numbered in pieces, which need not fit in one task."""
    time = F.coalesce(rescale(F.col("dts"), F.col("tb_num"), F.col("tb_den"), 1, 1_000_000_000), F.lit(-(1 << 62)).cast("bigint"))
    rows = packets.withColumn("_time", time).withColumn("_one", F.lit(1).cast("bigint"))
    out = running_sum(rows, "_one", [file], ["_time", "track_id", "seq"], "file_seq", find_cuts(rows, [file], "_time", most))
    return out.withColumn("file_seq", F.col("file_seq") + 1).drop("_time", "_one")


def merge_sources(*frames: DataFrame) -> DataFrame:
    """Several sources in one timeline with a shared start."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def unlinked_streams(streams: DataFrame, links: DataFrame) -> DataFrame:
    """Streams and tracks that no branch takes."""
    return streams.join(links, ["stream_id", "track_id"], "left_anti")


def probe_streams(packets: DataFrame) -> DataFrame:
    return packets.groupBy("stream_id", "track_id", "kind").agg(F.count("*").alias("packets"), F.min("pts").alias("first_pts"), F.max("pts").alias("last_pts"))


def count_buffers(buffers: DataFrame, by: str = "stream_id") -> DataFrame:
    """Packets and decoded frames (video and audio) apart; the end of a stream counts as neither."""
    return buffers.groupBy(by).agg(F.count_if(F.col("kind") == "Packet").alias("packets"), F.count_if(F.col("kind").isin("Video", "Audio")).alias("frames"))


def finalize_tracks(track_events: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per file: expected and finished tracks, whether it is final and since when. A track counts
    once, at its first Eos or Stop; events of tracks not in ``tracks`` (file_id, track_id) don't."""
    done = track_events.where(F.col("event").isin("Eos", "Stop")).groupBy("file_id", "track_id").agg(F.min("at").alias("done_at"))
    state = tracks.join(done, ["file_id", "track_id"], "left").groupBy("file_id").agg(F.count("*").alias("expected"), F.count("done_at").alias("finished"), F.max("done_at").alias("last"))
    final = F.col("expected") == F.col("finished")
    return state.select("file_id", "expected", "finished", final.alias("is_final"), F.when(final, F.col("last")).alias("finalized_at"))


def negotiated(offers: DataFrame, answers: DataFrame) -> DataFrame:
    """Codecs (connection, codec) that both ends support."""
    return offers.select("connection", "codec").intersect(answers.select("connection", "codec"))


def checked_choices(choices: DataFrame, allowed: DataFrame) -> DataFrame:
    """``choices`` (connection, at, codec, ...) of outbound codecs with error 'codec_not_negotiated' where
    the connection's ``allowed`` (connection, codec) lack it, else null."""
    known = allowed.select("connection", "codec").distinct().withColumn("_ok", F.lit(True))
    return choices.join(known, ["connection", "codec"], "left").withColumn("error", F.when(F.col("_ok").isNull(), "codec_not_negotiated")).drop("_ok")


def outbound_codecs(packets: DataFrame, choices: DataFrame, allowed: DataFrame, most: int | None = None) -> DataFrame:
    """``packets`` (connection, at, ...) with the codec that is declared for each: the last accepted choice
    at or before it. A choice outside the negotiated codecs changes nothing. Before any accepted choice
    there is no codec and error is 'codec_not_declared': none is guessed."""
    accepted = checked_choices(choices, allowed).where("error is null")
    got = asof(packets, accepted, ["connection"], "at", F.col("codec"), most=most).withColumnRenamed("known", "codec")
    return got.withColumn("error", F.when(F.col("codec").isNull(), "codec_not_declared"))
